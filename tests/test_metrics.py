"""Counts of a running job, and the stop at too many failures: one job each."""

import uuid

import pytest
from pyspark.sql import functions as F

from umbra.engine import Engine, batch_summary
from umbra.errors import TooManyFailures
from umbra.operators import metrics


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counts_are_those_of_the_summary(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "#/0", "a@b.org and 10.0.0.1"), (1, "#/1", "é a@b.org"), (2, "#/0", None), (3, "#/0", "")], "doc_id long, node_id string, text string")
    done, anchors = Engine().mask(nodes)
    counted, seen = metrics.observed(done, ("EMAIL_ADDRESS", "IP_ADDRESS", "URL"))
    _, n = jobs(spark, lambda: counted.write.parquet(str(tmp_path / "out")))
    got, want = seen.get, batch_summary(done, anchors).head()
    assert n == 1 and all(got[k] == want[k] for k in ("nodes", "masked_nodes", "masks", "chars", "masked_chars"))
    assert (got["EMAIL_ADDRESS"], got["IP_ADDRESS"], got["URL"], got["failed"]) == (2, 1, 0, 0)


def test_write_or_stop(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") < 20, "bad").alias("error"))
    out, n = jobs(spark, lambda: metrics.write_or_stop(rows, str(tmp_path / "good")))
    assert out == {"rows": 100, "failed": 20, "rate": 0.2} and n == 1
    assert spark.read.parquet(str(tmp_path / "good")).count() == 100
    with pytest.raises(TooManyFailures):
        metrics.write_or_stop(rows, str(tmp_path / "bad"), most=0.1)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["good"]
    assert metrics.write_or_stop(rows.limit(0), str(tmp_path / "good"))["rate"] == 0 and spark.read.parquet(str(tmp_path / "good")).count() == 0
