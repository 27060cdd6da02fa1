"""Folds over long arrays, and texts of very many spans."""

import random
import time
from itertools import accumulate

from pyspark.sql import functions as F

from umbra.functions import arrays
from umbra.operators import detect, mask, policy, resolve


def test_running_folds(spark):
    rng = random.Random(0)
    for n in (0, 1, 2, arrays.PART - 1, arrays.PART, arrays.PART + 1, 5 * arrays.PART + 3):
        xs = [rng.randrange(-5, 9) for _ in range(n)]
        row = spark.createDataFrame([(xs,)], "a array<int>").select(arrays.running_sums(F.col("a")).alias("s"), arrays.running_max(F.col("a")).alias("m")).head()
        assert row.s == list(accumulate(xs, initial=0))[:n] and row.m == list(accumulate(xs, max, initial=-(1 << 62)))[:n]


def test_resolution_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for n in (0, 1, 5, 40, 300):
        for wide in (3, 30):
            spans = []
            for _ in range(n):
                a = rng.randrange(max(1, 4 * n))
                spans.append((rng.choice(["A", "B"]), a, a + rng.randrange(wide), rng.choice([0.5, 0.9]), "t"))
            rows.append((sorted(spans, key=lambda s: (s[1], s[2], -s[3], s[0])),))
    df = spark.createDataFrame(rows, f"spans array<{detect.SPAN}>")
    turn = lambda spans: sorted(_in_turn(sorted(spans, key=lambda s: (-s[3], s[1]) + s)), key=lambda s: (s[1], s[2], -s[3], s[0]))
    got = df.select("spans", resolve.score_first(F.col("spans")).alias("x"), resolve.greedy(F.col("spans")).alias("g")).collect()
    for r in got:
        spans = [tuple(s) for s in r.spans]
        assert [tuple(s) for s in r.x] == turn(spans)
        kept = []
        for s in sorted(spans, key=lambda s: (s[1], -s[3], s[1] - s[2]) + s):
            if not kept or s[1] >= kept[-1][2]:
                kept.append(s)
        assert [tuple(s) for s in r.g] == kept


def _in_turn(spans):
    kept = []
    for s in spans:
        if all(not (y[1] < s[2] and s[1] < y[2]) for y in kept):
            kept.append(s)
    return kept


def test_a_hundred_thousand_spans_in_one_text(spark):
    """Found, resolved in both ways, masked and restored; twice the spans take about twice the time."""
    seconds = {}
    for n in (50_000, 100_000):
        text = " ".join(f"u{i}@mail.org" for i in range(n))
        nodes = spark.createDataFrame([(1, "#/0", text)], "doc_id long, node_id string, text string")
        began = time.perf_counter()
        done = mask.mask(nodes, policy.DEFAULT, [detect.EMAIL], "score_first")
        r = done.select("masked_text", F.size("spans").alias("n"), F.try_element_at("spans", F.lit(-1)).alias("last")).head()
        seconds[n] = time.perf_counter() - began
        assert r.n == n and r.masked_text == " ".join(["[EMAIL]"] * n) and r.last.masked_end == len(r.masked_text)
    assert seconds[100_000] < 60 and seconds[100_000] < 4 * seconds[50_000] + 5
    back = mask.unmask_rows(done).select((F.col("restored_text") == F.col("text")).alias("same")).head()
    assert back.same
