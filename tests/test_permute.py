"""Format-preserving permutations: whole small domains, rules of types, the way back, and whole tables."""

import itertools
import re
import string

import pytest
from pyspark.sql import functions as F

from umbra.functions import strategies as S
from umbra.functions.permute import luhn_digit, permuted
from umbra.operators import detect, mask, policy


def both(spark, rows, key="k1"):
    """{(kind, text): surrogate}; each is turned back."""
    df = spark.createDataFrame(rows, "k string, t string").withColumn("p", permuted(F.col("k"), F.col("t"), key))
    got = df.withColumn("b", permuted(F.col("k"), F.col("p"), key, back=True)).collect()
    assert [r.b for r in got] == [r.t for r in got]
    return {(r.k, r.t): r.p for r in got}


def form(t):
    return "".join("9" if c in string.digits else "X" if c in string.ascii_uppercase else "x" if c in string.ascii_lowercase else c for c in t)


def test_whole_domains_are_permuted(spark):
    domains = [list(string.digits), [f"{a}-{b}" for a in string.digits for b in string.digits], ["".join(x) for x in itertools.product("ab3", repeat=3)], [f"{i:03d}é" for i in range(1000)], [f"{i:03d}" for i in range(1000)]]
    rows = [("OTHER", t) for texts in domains for t in texts]
    got = both(spark, rows)
    assert len(set(got.values())) == len(got) and all(form(p) == form(t) for (_, t), p in got.items())
    whole = {t: got["OTHER", t] for t in domains[-1]}
    assert set(whole.values()) == set(whole) and sum(t == p for t, p in whole.items()) < 12
    assert got != both(spark, rows, "k2")


def test_texts_of_any_length(spark):
    texts = ["", "-", "é😀", "a", "Ab", "abc 123 ÄÖ", "x" * 12, "x" * 13, "9" * 40, "Aa0" * 60, "z" * 24 + "-" + "Z" * 25]
    got = {t: p for (_, t), p in both(spark, [("OTHER", t) for t in texts] + [(None, "ab12")]).items()}
    assert all(form(p) == form(t) for t, p in got.items()) and got[""] == "" and got["é😀"] == "é😀"
    assert sum(a != b for a, b in zip("9" * 40, got["9" * 40], strict=True)) > 25


def test_types_keep_their_rules(spark):
    import datetime

    texts = {
        "CREDIT_CARD": ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "4111111111111112", *[f"{i:03d}" for i in range(1000)]],
        "IP_ADDRESS": ["10.0.0.1", "255.255.255.255", "1.22.133.04", "999.1.1.1", *[f"1.{a}.2.{b}" for a in range(0, 256, 5) for b in range(0, 256, 7)]],
        "DATE_TIME": ["1900-01-01", "2099-12-31", "2024-02-29", "2023-02-29", "0000-99-99", *[f"{1950 + i}-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(100)]],
        "US_SSN": [f"{a:03d}-45-{a:04d}" for a in range(1000)] + ["123456789"],
        "EMAIL_ADDRESS": ["jo.7@mail.site.org", "JO.7@mail.site.org", "a@b.co", "nobody@host"],
    }
    every = both(spark, [(k, t) for k, own in texts.items() for t in own])
    got = {k: {t: every[k, t] for t in own} for k, own in texts.items()}
    assert all(len(set(x.values())) == len(x) and all(form(t) == form(p) for t, p in x.items()) for x in got.values())
    luhn = lambda t: (sum(map(int, (d := re.sub(r"\D", "", t))[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0
    real = lambda t: bool(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", t)) and _is_date(datetime, t)
    given = lambda t: t[:3] not in ("000", "666") and t[0] != "9"
    octets = lambda t: max(map(int, t.split("."))) < 256
    for kind, rule in (("CREDIT_CARD", luhn), ("DATE_TIME", real), ("US_SSN", given), ("IP_ADDRESS", octets)):
        assert all(rule(t) == rule(p) for t, p in got[kind].items()), kind
    assert got["EMAIL_ADDRESS"]["jo.7@mail.site.org"].endswith(".org")


def _is_date(datetime, t):
    try:
        datetime.date.fromisoformat(t)
        return True
    except ValueError:
        return False


def test_luhn_digit(spark):
    rows = spark.createDataFrame([("411111111111111",), ("7992739871",), ("0",)], "t string").select(luhn_digit(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == ["1", "3", "0"]


def test_as_a_strategy_and_back_without_originals(spark):
    p = policy.Policy(S.Strategy("permute", {"key": "secret"}))
    nodes = spark.createDataFrame([(1, "#/0", "mail a.b@c.org or 4111 1111 1111 1111 from 10.0.0.1"), (2, "#/0", None), (3, "#/0", "a.b@c.org")], "doc_id long, node_id string, text string")
    done = mask.mask(nodes, p)
    kept = mask.anchors(done, p, keep_original=False)
    assert kept.filter("original_text is not null").count() == 0
    back = mask.unmask(done.select("doc_id", "node_id", "text", "masked_text"), kept, policy=p)
    assert all(r.text == r.restored_text and (r.text is None or r.text != r.masked_text) for r in back.collect())
    values = {r.masked_value for r in kept.filter("entity_type = 'EMAIL_ADDRESS'").collect()}
    assert len(values) == 1  # the same address has the same surrogate in every document
    assert "Python" not in done._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        S.Strategy("permute")


def test_a_whole_table_never_collides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = detect.entities(detect.detect(docs), "doc_id").select("entity_type", "text").distinct()
    counts = found.withColumn("p", permuted(F.col("entity_type"), F.col("text"), "k")).groupBy("entity_type").agg(F.countDistinct("text").alias("a"), F.countDistinct("p").alias("b"))
    assert all(r.a == r.b for r in counts.collect())
