"""Counts that a masking job takes while it runs, and a stop at too many failures, both without a second pass.

Counts are Spark's observations: each task adds up its rows, and the job's end has the sums.  A job that is to stop at a
share of failures writes beside its target; when the counts are there, what was written is moved to the target or removed.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from umbra.errors import TooManyFailures

from .validate import MAX_FAILURES


def observed(masked: DataFrame, types: tuple[str, ...] = (), error: str | None = None) -> tuple[DataFrame, Observation]:
    """masked (text, masked_text, spans) with an observation: nodes, masked_nodes, masks, chars, masked_chars, failed (rows with
    `error`), and masks of each of `types` by its name.  Its get is there once a job over the table has ended."""
    seen = Observation()
    size = lambda c: F.coalesce(F.sum(F.char_length(c)), F.lit(0)).cast("long")
    masks = lambda spans: F.coalesce(F.sum(F.size(spans)), F.lit(0)).cast("long")
    spans = F.coalesce("spans", F.array().cast(masked.schema["spans"].dataType))
    failed = F.count(F.col(error) if error else F.lit(None))
    counts = [
        F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.size(spans) > 0, 1)).alias("masked_nodes"), masks(spans).alias("masks"), size("text").alias("chars"), size("masked_text").alias("masked_chars"), failed.alias("failed"),
        *[masks(F.filter(spans, _is(t))).alias(t) for t in types],
    ]
    return masked.observe(seen, *counts), seen


def _is(kind: str):
    return lambda s: s["entity_type"] == kind


def write_or_stop(rows: DataFrame, path: str, error: str = "error", most: float = MAX_FAILURES) -> dict:
    """Write rows as Parquet to path in one job; if more than `most` of them have an error nothing is there and it raises.

    Gives the counts rows, failed and rate."""
    seen = Observation()
    spark, beside = rows.sparkSession, f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    to, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside))
    files = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    try:
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.col(error)).alias("failed")).write.parquet(beside)
        counts = seen.get
        rate = counts["failed"] / counts["rows"] if counts["rows"] else 0.0
        if rate > most:
            raise TooManyFailures(f"{rate:.0%} of all rows failed, {most:.0%} are borne", rate=rate)
        files.delete(to, True)
        if not files.rename(at, to):
            raise OSError(f"{beside} could not be moved to {path}")
    finally:
        with contextlib.suppress(Exception):  # what was moved is no longer there
            files.delete(at, True)
    return counts | {"rate": rate}
