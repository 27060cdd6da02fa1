"""Interval joins against every pair, their plans, and their time in one large document."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from umbra.operators import intervals, mask
from umbra.sources import documents as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark, seed, gap=2):
    rng = random.Random(seed)
    nodes, places = [], []
    for doc in (1, 2, None):
        at = 0
        for i in range(30):
            n = rng.choice([0, 1, 3, 10, 200])
            nodes.append((doc, f"n{i}", at, at + n))
            at += n + gap
        places += [(doc, a := rng.randrange(-3, at + 20), a + rng.randrange(6), i) for i in range(200)]
    places += [(3, 1, 2, 0), (1, None, 4, 1)] + places[:5]
    return nodes, places, spark.createDataFrame(nodes, "doc_id long, node_id string, start_offset long, end_offset long"), spark.createDataFrame(places, "doc_id long, start int, end int, node_end_ int")


@pytest.mark.parametrize("width", [4, 64, 4096])
def test_to_node_against_every_pair(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "WIDTH", width)
    nodes, places, n, p = tables(spark, width)
    got = intervals.holding(p, n, "doc_id", keep=("node_id",), width=width).select("doc_id", "start", "end", F.when((F.col("start") >= F.col("start_offset")) & (F.col("end") <= F.col("end_offset")), F.col("node_id")).alias("node_id"))
    want = []
    for doc, a, b, _ in places:
        held = [x for d, x, s, e in nodes if d == doc and a is not None and s <= a and b <= e]
        want.append((doc, a, b, held[-1] if held else None))
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)


def test_to_node_and_of_segment_compare_no_pairs(spark):
    nodes, places, n, p = tables(spark, 5)
    held = D.to_node(p, n)
    assert "Join" not in plan(held) and "Window" in plan(held)
    assert held.columns == ["doc_id", "start", "end", "node_end_", "node_id", "node_start", "node_end"]
    got = mask.of_segment(p.drop("node_end_"), n)
    want = collections.Counter((d, a, b, x, a - s, min(b, e) - s) for d, a, b, _ in places for d2, x, s, e in nodes if d == d2 and a is not None and s <= a < e)
    assert "Join" not in plan(got) and collections.Counter(map(tuple, got.collect())) == want


def test_one_document_with_most_rows(spark):
    """A hundred thousand nodes and as many places: every pair would be 10**10 comparisons."""
    nodes = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("string").alias("node_id"), (F.col("id") * 12).alias("start_offset"), (F.col("id") * 12 + 10).alias("end_offset"))
    places = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 12 + 3).alias("start"), (F.col("id") * 12 + 8).alias("end"))
    began = time.perf_counter()
    right = D.to_node(places, nodes).filter((F.col("node_start") == 3) & (F.col("node_id") == (F.col("start") / 12).cast("long").cast("string"))).count()
    assert right == 100_000 and time.perf_counter() - began < 60


@pytest.mark.parametrize("width", [4, 50])
def test_overlapping_against_every_pair(spark, width):
    rng = random.Random(width)
    make = lambda n: [(rng.choice([1, 2]), a := rng.randrange(300), a + rng.choice([0, 1, 5, 120]), i) for i in range(n)]
    a, b = make(80), make(60)
    got = intervals.overlapping(spark.createDataFrame(a, "doc_id long, start int, end int, n int"), spark.createDataFrame(b, "doc_id long, start int, end int, n int"), "doc_id", width=width)
    want = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])}
    rows = [(r.n, r.n_b) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_places_in_segment_arrays(spark):
    rng = random.Random(9)
    segments, at = [], 0
    for i in range(500):
        n = rng.randrange(1, 30)
        segments.append((at, at + n, f"n{i}"))
        at += n + 2
    places = [rng.randrange(-5, at + 30) for _ in range(400)] + [0, at]
    df = spark.createDataFrame([(segments, p) for p in places] + [([], 3)], "segments array<struct<start:int,end:int,node_id:string>>, p int")
    got = [r.x for r in df.select(D.segment_at(F.col("segments"), F.col("p"))["node_id"].alias("x")).collect()]
    assert got == [([s for s in segments if s[0] <= p] or segments)[-1 if p >= 0 else 0][2] for p in places] + [None]
