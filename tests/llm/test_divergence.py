"""Source divergence against brute force, the sketch, and shares of any size."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, id int, p int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [m.translate(LOWER) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, least, top, scale=10**9, prior=5):
    rows = [(t or "", lang or "", s or "") for _, t, lang, s in rows]
    docs, whole, own = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    groups = {(lang, s) for _, lang, s in rows}
    for t, lang, s in rows:
        found = words(t)
        docs.update({(lang, w) for w in found})
        whole.update((lang, w) for w in found)
        own[lang, s].update(found)
    out = collections.Counter()
    for lang, s in groups:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        total = lambda c: sum(c[w] for w in kept)
        share = lambda c: {w: 1 + scale * (c[w] + prior) // (total(c) + prior * len(kept)) for w in kept}
        mine, all_ = share(own[lang, s]), share(collections.Counter({w: n for (x, w), n in whole.items() if x == lang}))
        pairs = [(b, sum(abs(mine[w] - q) for w, q in share(own[lang, b]).items())) for x, b in groups if x == lang and b != s]
        terms = [(w, mine[w] - all_[w]) for w in kept if own[lang, s][w] and mine[w] > all_[w]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out.update((lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < top)
    return out


def got(spark, rows, least, top):
    docs = spark.createDataFrame([(i, t, lang, s, "x", 1, 2, 3) for i, t, lang, s in rows], SCHEMA).repartition(5)
    return collections.Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, least=least, top=top).collect())


def corpus(n, seed=2):
    rng = random.Random(seed)
    pool = ["The", "the", "naïve", "ÉCOLE", "école", "x1y", "日本", "😀a", "b-c", "z_z", "don't", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = [(i, " ".join(rng.choices(pool, weights=range(len(pool), 0, -1), k=rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", "Z", None])) for i in range(n)]
    return rows + [(None, None, "en", "a"), (1, "", "xx", "only"), (2, "rare words here", "yy", "s"), (3, "other words here", "yy", "t"), (4, "\x00 12 _", "yy", "empty")]


@pytest.mark.parametrize(("least", "top"), [(3, 50), (8, 4), (1, 2), (1000, 5)])
def test_against_brute_force(spark, least, top):
    rows = corpus(300)
    assert got(spark, rows, least, top) == brute(rows, least, top)


def test_hot_source_repeats_and_long_text(spark):
    rows = [(1, "same words of a hot source", "en", "hot")] * 200 + corpus(50) + [(5, "long Text " * 100_000, "en", "a")]
    assert got(spark, rows, 5, 50) == brute(rows, 5, 50)


def test_no_documents(spark):
    assert not got(spark, [], 2, 5)


def test_sketch_drops_rare_terms_and_never_a_kept_one(spark):
    rng = random.Random(1)
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(i, " ".join([f"q{name(rng.randrange(200_000))}" for _ in range(40)] + [f"k{name(rng.randrange(20))}"]), "en", "a") for i in range(3000)]
    docs = spark.createDataFrame([(i, t, lang, s, "x", 1, 2, 3) for i, t, lang, s in rows], SCHEMA).repartition(7)
    read = divergence._read(docs, "text", "lang", "source")
    cells = divergence.Cells(16, 3)
    bits = divergence.sketch(read, cells, 30)
    left = {r.term for r in divergence.survivors(read, cells, bits).select("term").distinct().collect()}
    frequent = collections.Counter(w for _, t, _, _ in rows for w in set(words(t)))
    assert {w for w, n in frequent.items() if n >= 30} <= left
    assert len(left) < 0.02 * len(frequent)


def test_merging_counts_that_stop():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 12, (9, 1 << divergence.BLOCK_BITS)) * (rng.random((9, 1 << divergence.BLOCK_BITS)) < 0.1)
    parts = [divergence._parts(np.minimum(b, 10)) for b in blocks]
    assert ((divergence.merged(*zip(*parts, strict=True), 10) >= 10) == (blocks.sum(0) >= 10)).all()


def test_share_of_any_size(spark):
    rows = [(3, 10, 2), (10**15, 10**17, 10**6), (9 * 10**17, 9 * 10**17, 1), (0, 0, 7)]
    df = spark.createDataFrame(rows, "c long, t long, v long").select(divergence.share(F.col("c"), F.col("t"), F.col("v"), 10**9, 5).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v in rows]
