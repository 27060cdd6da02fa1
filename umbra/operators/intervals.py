"""Joins of places and intervals within a key (a document), without comparing every place with every interval.

Positions are cut into buckets of `width`, and an interval stands in each bucket that it touches: as many rows as its length
asks for, so a hot document is dealt over its buckets.  Where the intervals of a key are disjoint, both sides are put in
one table, and within a bucket a place takes the interval that began last: one sort, no join.  Where intervals may overlap, they
meet by an equal join on key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bucket.
WIDTH = 4096


def _buckets(start: Column, last: Column, width: int) -> Column:
    """The numbers of the buckets from that of start to that of last, one at least."""
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(first, F.floor(last / width)))


def holding(places: DataFrame, intervals: DataFrame, *by: str, place: str = "start", start: str = "start_offset", end: str = "end_offset", keep: tuple[str, ...] = (), width: int = WIDTH) -> DataFrame:
    """places with the interval that began last at or before each (column `place`): its start, end and columns `keep`.

    intervals: by, start, end and keep, disjoint within by.  The interval may end before the place; the caller says what
    counts.  Null where none began, or where the last to begin does not reach the place's bucket."""
    names = places.columns
    given = [start, end, *keep]
    place_side = places.select(F.lit(1).alias("_kind"), F.struct(*names).alias("_row"), *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.floor(F.col(place) / width).alias("_bucket"), F.col(place).cast("long").alias("_at"), F.lit(None).cast(_struct(intervals, given)).alias("_interval"))
    rows = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = rows.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.struct(*given).alias("_interval"), F.explode(_buckets(F.col(start), F.col(end), width)).alias("_bucket"))  # an empty place may lie at the end
    interval_side = rows.select(F.lit(0).alias("_kind"), F.lit(None).cast(_struct(places, names)).alias("_row"), *[f"_by{i}" for i in range(len(by))], "_bucket", F.greatest(F.col(f"_interval.{start}").cast("long"), F.col("_bucket") * width).alias("_at"), "_interval")
    w = Window.partitionBy(*[f"_by{i}" for i in range(len(by))], "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = place_side.unionByName(interval_side).withColumn("_interval", F.last("_interval", ignorenulls=True).over(w)).filter("_kind = 1")
    return held.select(*[F.col(f"_row.{n}").alias(n) for n in names], *[F.col(f"_interval.{n}").alias(n) for n in given])


def _struct(df: DataFrame, names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:{df.schema[n].dataType.simpleString()}" for n in names) + ">"


def overlapping(a: DataFrame, b: DataFrame, *by: str, start: str = "start", end: str = "end", width: int = WIDTH) -> DataFrame:
    """All pairs of rows of a and b, equal in by, whose [start, end) overlap: columns of a, and those of b after by with _b
    behind their names.  Each pair comes from one bucket, that where its overlap begins."""
    left = a.withColumn("_bucket", F.explode(_buckets(F.col(start), F.col(end) - 1, width)))
    right = b.select(*[F.col(n).alias(n if n in by else f"{n}_b") for n in b.columns]).withColumn("_bucket", F.explode(_buckets(F.col(f"{start}_b"), F.col(f"{end}_b") - 1, width)))
    met = left.join(right, [*by, "_bucket"])
    first = F.greatest(start, f"{start}_b")
    return met.filter((first < F.least(end, f"{end}_b")) & (F.floor(first / width) == F.col("_bucket"))).drop("_bucket")
