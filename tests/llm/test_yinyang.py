"""Exact k-means against brute force in Python's integers, also with bounds at work, ties, and huge components."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from umbra.llm import yinyang

SCHEMA = "vec_id long, embedding array<double>, cluster int, v string"


def brute(rows, k, rounds, width, scale=64):
    kept = [(i, [math.floor(x * scale) if abs(x) < 1e200 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        own = [min((square(v, w), j) for j, w in enumerate(c)) for _, v in kept]
        if n < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    top = (1 << 63) - 1
    inertia = collections.Counter()
    for d, j in own:
        inertia[j] += d
    return collections.Counter((i, j, min(d, top), min(inertia[j], top), min(sum(inertia.values()), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True))


def got(spark, rows, k, rounds, width, groups=4):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    out, centroids, sums, told = yinyang.cluster(df, k=k, rounds=rounds, groups=groups, width=width)
    found = yinyang.digest(out, centroids, sums, width).collect()
    return collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found), told


def clustered(n, width, seed=3, spread=0.05):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, width)) * 3
    return [(i, (middles[rng.integers(12)] + spread * rng.normal(size=width)).tolist()) for i in range(n)]


def test_clustered_vectors_and_filters(spark):
    rows = clustered(3000, 8)
    found, told = got(spark, rows, 16, 6, 8)
    assert found == brute(rows, 16, 6, 8)
    assert told[0][1] == 0 and told[0][4] == 3000 * 16  # the first assignment measures all
    assert told[-1][1] > 2500 and told[-1][4] < 3000 * 4  # later ones few
    assert all(t[0] == 3000 for t in told)


def test_random_vectors_and_ties(spark):
    rng = random.Random(4)
    rows = [(i % 700, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(3)]) for i in range(900)]
    for groups in (1, 3, 16):
        assert got(spark, rows, 16, 4, 3, groups)[0] == brute(rows, 16, 4, 3)


def test_cases(spark):
    bad = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 0.0]), (6, []), (None, [0.5, 0.5])]
    rows = bad + [(7, [0.1, -0.1]), (7, [0.1, -0.1]), (8, [9.0, 9.0]), (9, [1e300, -1e300]), (10, [1e12, 3.0]), (11, [1e12, 4.0]), (12, [-1.7e308, 1.7e308])]
    for k in (2, 5, 16):
        assert got(spark, rows, k, 3, 2)[0] == brute(rows, k, 3, 2), k
    small = [r for r in rows if r[0] not in (9, 12)]
    assert got(spark, small, 3, 3, 2)[0] == brute(small, 3, 3, 2)


@pytest.mark.parametrize("rows", [[], [(None, [0.5, 0.5])], [(1, None)]])
def test_nothing_to_cluster(spark, rows):
    assert not got(spark, rows, 4, 3, 2)[0]


def test_limbs():
    for n in (0, 1, -1, 1 << 40, -(1 << 40), 10**50, -(10**50), 7**400):
        assert sum(x << (yinyang.LIMB * i) for i, x in enumerate(yinyang.limbs(n))) == n
        assert all(abs(x) <= 1 << yinyang.LIMB for x in yinyang.limbs(n))
