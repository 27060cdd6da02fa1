"""The same masking over a stream of nodes: narrow, so it needs neither state nor a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators.mask import anchors, mask
from umbra.operators.policy import DEFAULT, Policy


def mask_stream(spark: SparkSession, source: str, schema, nodes_to: str, anchors_to: str, checkpoint: str, policy: Policy = DEFAULT):
    """Masks Parquet files of nodes as they come; each micro-batch writes its nodes and anchors once, under its number.

    A batch is detected once: its masked rows are kept for both writes.  A batch that is run again overwrites its own."""

    def write(batch: DataFrame, number: int) -> None:
        done = mask(batch, policy).persist()
        try:
            done.drop("spans", "text").write.mode("overwrite").parquet(f"{nodes_to}/batch={number}")
            anchors(done, policy).write.mode("overwrite").parquet(f"{anchors_to}/batch={number}")
        finally:
            done.unpersist()

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(detected: DataFrame, time: str = "ts", window: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Entities of a stream of detected nodes by type and window of event time; rows later than `late` are left out."""
    rows = detected.withWatermark(time, late).select(time, F.explode("spans").alias("s")).select(time, "s.entity_type")
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return rows.groupBy(frame.alias("window"), "entity_type").agg(F.count(F.lit(1)).alias("n"))
