"""SQL functions against the DataFrame API, on random texts and on documents."""

import random

import pytest
from pyspark.sql import functions as F

from umbra import sql
from umbra.errors import ValidationError
from umbra.functions import strategies as S
from umbra.operators import detect, mask, policy

PARTS = ["a.b@c.org", "x@", "@", ".", "-", " ", "10.0.0.1", "300.1.1.1", "4111111111111111", "4111 1111 1111 1111", "+44 20 7946 0958", "555-123-4567", "(555) 123-4567", "123-45-6789", "https://x.org/p", "2024-02-29", "DE89370400440532013000", "DE89370400440532013001", "é", "😀", "_", "7", "\n"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(9)))) for i in range(400)] + [(-1, None), (-2, "")]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000))


def test_table_function_is_detect(spark, texts):
    sql.register(spark)
    texts.createOrReplaceTempView("texts")
    got = spark.sql("SELECT t.doc_id, e.* FROM texts t, LATERAL detect_pii(t.text) e")
    want = detect.entities(detect.detect(texts), "doc_id")
    a, b = (sorted(map(tuple, df.select("doc_id", "entity_type", "start", "end", "confidence", "text").collect())) for df in (got, want))
    assert a == b and len({r[1] for r in a}) == 8
    counts = spark.sql("SELECT e.entity_type, count(*) AS n FROM texts t, LATERAL detect_pii(t.text) e GROUP BY 1").collect()
    assert sum(r.n for r in counts) == len(a)


def test_masking_function_is_mask(spark, texts):
    sql.register(spark)
    texts.createOrReplaceTempView("texts")
    own = policy.Policy(S.Strategy("template", {"template": "[{entity_type}]"}))
    want = {r.doc_id: r.masked_text for r in mask.mask(texts.withColumn("node_id", F.lit("n")), own).collect()}
    assert {r.doc_id: r.m for r in spark.sql("SELECT doc_id, mask_pii(text) AS m FROM texts").collect()} == want


def test_recognizers_without_a_form(spark):
    with pytest.raises(ValidationError):
        sql.register(spark, (detect.TITLED_PERSON,))
