"""Folds over long arrays as expressions whose cost grows with the array and not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements of a part.  A step of a fold copies what its part has so far, so a part is short.
PART = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, start: Column, add: Callable[[Column, Column], Column]) -> Column:
    """array<long>: for each of the numbers what add() makes of start and all before it; add is associative.

    Parts of PART numbers are added up first, those in turn, and then the parts from where they begin: PART copies a
    number, and one for each pair of parts."""
    begin = start.cast("long")

    def each(a: Column, first: Column) -> Column:
        held = F.struct(first.alias("s"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(a, held, lambda h, n: F.struct(add(h["s"], n).alias("s"), F.concat(h["out"], F.array(h["s"])).alias("out")), lambda h: h["out"])

    def of(a: Column) -> Column:
        part = lambda k: F.slice(a, k * PART + 1, F.lit(PART))
        parts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PART).cast("int"))
        totals = F.transform(parts, lambda k: F.aggregate(part(k), begin, add))
        many = let(each(totals, begin), lambda b: F.flatten(F.transform(b, lambda s, k: each(part(k), s))))
        return F.when(F.size(a) == 0, F.array().cast("array<long>")).when(F.size(a) <= PART, each(a, begin)).otherwise(many)

    return let(F.transform(numbers, lambda n: n.cast("long")), of)


def running_sums(numbers: Column) -> Column:
    """For each of the numbers the sum of those before it."""
    return running(numbers, F.lit(0), lambda a, b: a + b)


def running_max(numbers: Column) -> Column:
    """For each of the numbers the largest before it; for the first one below all that are met."""
    return running(numbers, F.lit(-(1 << 62)), lambda a, b: F.greatest(a, b))


def kept_in_order(spans: Column, start: str = "start", end: str = "end") -> Column:
    """Of spans in order those that begin at or after the end of the last that was kept.

    The reach of what was kept is folded as numbers alone, part by part, and the spans are chosen by it."""
    step = lambda a, s: F.struct(F.greatest(a["reach"], F.when(s[start] >= a["reach"], s[end].cast("long")).otherwise(a["reach"])).alias("reach"), F.concat(a["out"], F.array(s[start] >= a["reach"])).alias("out"))
    last = lambda reach, s: F.when(s[start] >= reach, F.greatest(reach, s[end].cast("long"))).otherwise(reach)

    def of(a: Column) -> Column:
        part = lambda k: F.slice(a, k * PART + 1, F.lit(PART))
        parts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PART).cast("int"))
        least = F.lit(-(1 << 62)).cast("long")
        begin = F.struct(least.alias("reach"), F.array().cast("array<long>").alias("out"))
        reaches = F.aggregate(parts, begin, lambda b, k: F.struct(F.aggregate(part(k), b["reach"], last).alias("reach"), F.concat(b["out"], F.array(b["reach"])).alias("out")), lambda b: b["out"])
        marks = lambda r, k: F.aggregate(part(k), F.struct(r.alias("reach"), F.array().cast("array<boolean>").alias("out")), step, lambda x: x["out"])
        kept = let(F.flatten(F.transform(reaches, marks)), lambda keep: F.filter(a, lambda s, i: F.get(keep, i)))
        return F.when(F.size(a) == 0, a).otherwise(kept)

    return let(spans, of)


def last_at_most(size: Column, key: Callable[[Column], Column], x: Column) -> Column:
    """The index of the last of `size` ascending keys that is at most x, or -1: a binary search, key(i) gives the key at i."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(size + 1)).cast("int"))

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        open_ = a["hi"] - a["lo"] > 1
        below = key(middle) <= x
        return F.struct(F.when(open_ & below, middle).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(a["hi"]).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(-1).alias("lo"), size.cast("int").alias("hi")), step, lambda a: a["lo"])


def exploded(rows: DataFrame, array: Column, *keep: str | Column, name: str = "s") -> DataFrame:
    """keep and a row an element (name) of an array.

    With explode() the optimizer adds a filter on the array's size, and pushes it below the projection that makes the array
    (and below a shuffle): all work for the array is done twice then.  A filter on the exploded place stays above."""
    return rows.select(*keep, F.posexplode_outer(array).alias("_at", name)).filter("_at is not null").drop("_at")
