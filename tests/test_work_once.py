"""Rows of a small file are dealt over tasks, and what an array of spans costs is paid once."""

import os

from pyspark.sql import functions as F

from umbra.operators import detect, mask, resolve
from umbra.plans import catalogue
from umbra.sources.tables import spread


def _below_explode(df) -> str:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[plan.index("Generate ") :]


def test_nothing_is_detected_for_a_filter_on_the_number_of_spans(spark):
    docs = spark.createDataFrame([(1, "mail a@example.org"), (2, "none"), (3, None)], "doc_id long, text string").repartition(2)
    found = detect.entities(detect.detect(docs), "doc_id")
    assert "Filter" not in _below_explode(found)
    assert [(r.doc_id, r.start, r.text) for r in found.collect()] == [(1, 5, "a@example.org")]
    rows = mask.anchors(mask.mask(docs.withColumn("node_id", F.lit("#"))))
    assert "Filter" not in _below_explode(rows)
    assert [(r.doc_id, r.seq) for r in rows.collect()] == [(1, 0)]


def test_rows_of_one_split_are_dealt_over_tasks(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(300_000, 312_000).select(F.col("id").cast("int").alias("c_custkey")).coalesce(1).write.parquet(os.path.join(folder, "customer.parquet"))
    table = spark.read.parquet(os.path.join(folder, "customer.parquet"))
    assert table.rdd.getNumPartitions() == 1 and spread(table, "c_custkey").rdd.getNumPartitions() == 3
    assert spread(table.limit(3), "c_custkey").count() == 3
    texts = catalogue._forms(spark, folder)  # keys beyond what 32 bits hold times 7919
    assert texts.rdd.getNumPartitions() == 3
    assert texts.select("doc_id", "text").distinct().count() == 12_000


def test_faults_of_spans_are_those_of_the_rows(spark):
    schema = "id int, spans array<struct<entity_type:string,start:int,end:int,confidence:double,text:string>>"
    row = lambda *spans: [("T", a, b, c, "x" * (b - a)) for a, b, c in spans]
    docs = spark.createDataFrame([(1, row((0, 5, 0.99), (0, 5, 0.99), (3, 20, 0.5))), (2, row((0, 4, 0.96), (4, 9, 0.97))), (3, []), (1, row((1, 5, 0.99))), (4, None)], schema)
    after = detect.entities(docs.withColumn("spans", resolve.RESOLVERS["longest"](F.col("spans"))), "id")
    want = sorted(map(tuple, resolve.normalisation_faults(detect.entities(docs, "id"), after, "id").collect()))
    got = resolve.faults_of_spans(docs, "longest", "id")
    assert sorted(map(tuple, got.collect())) == want == [(1, 0, 5, "lost"), (1, 3, 20, "overlap")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1  # spans are made once
