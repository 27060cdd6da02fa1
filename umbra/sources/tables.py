"""Tables of few bytes and many rows, dealt over tasks by their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task.  A compressed table of keys has some millions of rows in one split of a file, and work a row that is much
#: dearer than reading it would then run in one task.
TASK_ROWS = 5_000


def spread(rows: DataFrame, *by: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows in as many parts as their number asks for, by the columns `by`; up to one part they stay as they are."""
    parts = -(-rows.count() // task_rows)  # of a Parquet table: from its footers
    return rows.repartition(parts, *by) if parts > 1 else rows
