"""The bucketed vault by its plans, and sealed maps: round trip, tampering, unknown keys, other masters."""

import hashlib
import hmac
import json
import uuid

import pytest
from pyspark.sql import functions as F

from umbra.errors import ValidationError
from umbra.operators import mask, policy, vault

OLD, NEW = b"o" * 32, b"n" * 32


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    nodes = spark.range(400).select("id", F.concat(F.lit("mail u"), F.col("id"), F.lit("@x.org or 10.0.0."), F.col("id") % 250).alias("text"))
    nodes = nodes.select((F.col("id") / 2).cast("long").alias("doc_id"), F.concat(F.lit("#/"), F.col("id") % 2).alias("node_id"), "text")
    done = mask.mask(nodes, policy.DEFAULT)
    name = f"vault_{uuid.uuid4().hex}"
    vault.store(mask.anchors(done), name, 8, str(tmp_path_factory.mktemp("vault") / "t"))
    yield name, done.select("doc_id", "node_id", "text", "masked_text")
    spark.sql(f"DROP TABLE {name}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_documents_read_few_buckets(spark, stored):
    name, masked = stored
    some = masked.filter("doc_id in (3, 5)").unionByName(spark.createDataFrame([(9999, "#/0", "gone", "[EMAIL]"), (None, "#/0", "n", "n")], masked.schema))
    back = vault.unmask(some, name)
    assert {(r.doc_id, r.node_id): r.restored_text == r.text for r in back.filter("doc_id < 9999").collect()} == {(d, f"#/{n}"): True for d in (3, 5) for n in (0, 1)}
    assert back.filter("doc_id = 9999").head().restored_text == "[EMAIL]" and back.filter("doc_id is null").head().restored_text == "n"
    text = plan(back)
    assert "SelectedBucketsCount" in text and "SelectedBucketsCount: 8 out of 8" not in text


def test_many_documents_do_not_shuffle_the_vault(spark, stored):
    name, masked = stored
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        back = vault.unmask(masked, name, few=10)
        text = plan(back)
        side = text[text.rindex("Sort ["):] if text.count("Sort [") > 1 else text
        assert "Exchange" not in side and "FileScan" in side and "Bucketed: true" in text
        assert back.filter("restored_text <> text").count() == 0 and back.count() == 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hmac(spark):
    for key, text in ((b"k", b"abc"), (b"k" * 64, b""), (b"k" * 99, b"long key")):
        got = spark.createDataFrame([(bytearray(text),)], "b binary").select(vault.hmac_sha256(key, F.col("b")).alias("h")).head().h
        assert got == hmac.new(key, text, hashlib.sha256).hexdigest()


def test_sealed_maps(spark):
    maps = spark.createDataFrame([("a", '{"x": 1}'), ("b", '{"é": "😀"}'), ("c", "")], "doc_id string, value string")
    sealed = vault.seal(maps, OLD, "old").cache()
    raw = {r.doc_id: r.value for r in sealed.collect()}
    assert all(set(json.loads(v)) == {"doc_id", "key_id", "wrapped_key", "encrypted_content", "signature"} and "😀" not in v for v in raw.values())
    opened = lambda df, keys: {r.doc_id: (r.value, r.error) for r in vault.unseal(df, keys).collect()}
    assert opened(sealed, {"old": OLD, "new": NEW}) == {"a": ('{"x": 1}', None), "b": ('{"é": "😀"}', None), "c": ("", None)}
    assert opened(sealed, {"new": NEW})["a"] == (None, "unknown key") and opened(sealed, {"old": NEW})["a"] == (None, "tampered")
    again = vault.rewrapped(sealed, {"old": OLD}, NEW, "new")
    assert opened(again, {"new": NEW}) == opened(sealed, {"old": OLD})
    before, after = json.loads(raw["a"]), json.loads(again.filter("doc_id = 'a'").head().value)
    assert before["encrypted_content"] == after["encrypted_content"] and before["wrapped_key"] != after["wrapped_key"]
    with pytest.raises(ValidationError):
        vault.seal(maps, b"short", "k")


@pytest.mark.parametrize("field", ["doc_id", "wrapped_key", "encrypted_content", "signature"])
def test_any_change_is_found(spark, field):
    sealed = vault.seal(spark.createDataFrame([("a", '{"x": 1}')], "doc_id string, value string"), OLD, "old").head()
    d = json.loads(sealed.value)
    d[field] = ("b" if d[field][0] != "b" else "c") + d[field][1:]
    r = vault.unseal(spark.createDataFrame([(d["doc_id"], json.dumps(d))], "doc_id string, value string"), {"old": OLD}).head()
    assert (r.value, r.error) == (None, "tampered")


def test_what_is_no_sealed_map(spark):
    rows = spark.createDataFrame([("a", "{}"), ("b", "no"), ("c", None)], "doc_id string, value string")
    assert [r.error for r in vault.unseal(rows, {"old": OLD}).collect()] == ["not a sealed map"] * 3
