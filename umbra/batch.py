"""A folder of files masked in one go: converted, masked, written with their maps and a manifest, all or nothing.

Every step writes a Parquet table beside the target, and the next reads it, so a file is converted once and a lost executor
costs no more than its tasks.  At the end the folder is moved to its target; after a failure nothing is there.  A file that
cannot be converted stands in the manifest with its message, and does not stop the others unless too many fail.  Spark's reader
passes over files of no bytes, so those have no row.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.engine import Engine
from umbra.errors import TooManyFailures, ValidationError
from umbra.operators.validate import MAX_FAILURES
from umbra.sources import documents as D

#: What an output folder holds: masked documents, the maps of their anchors, the manifest.
TABLES = ("documents", "maps", "manifest")


def _manifest(files: DataFrame, converted: DataFrame, maps: DataFrame) -> DataFrame:
    """A row a file: name, bytes, sha256, status ("masked", "clean" or "failed"), error, nodes, masks and masks by type."""
    nodes = D.nodes(converted.filter("_corrupt_record is null")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"))
    types = F.transform("anchors", lambda a: a["entity_type"])
    made = maps.select("doc_id", F.size("anchors").cast("long").alias("masks"), F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t))))).alias("types"))
    failed = converted.select("doc_id", F.col("_corrupt_record").alias("error"))
    rows = files.join(failed, "doc_id", "left").join(nodes, "doc_id", "left").join(made, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("masks") > 0, "masked").otherwise("clean")
    return rows.select("doc_id", "bytes", "sha256", status.alias("status"), "error", zero("nodes"), zero("masks"), "types")


def run(spark: SparkSession, path: str, out: str, convert: Callable[[bytes], str] = D.plain_text, engine: Engine | None = None, pattern: str = "*", overwrite: bool = False, most_failures: float = MAX_FAILURES) -> dict:
    """Mask the files of `path`; gives the manifest's totals.  convert(bytes) -> JSON of a document, as read_with() takes it."""
    own = engine or Engine()
    beside = f"{out.rstrip('/')}.part-{uuid.uuid4().hex}"
    to, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (out, beside))
    store = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if store.exists(to) and not overwrite:
        raise ValidationError(f"{out} is there already")

    def kept(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{beside}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{beside}/{name}")

    try:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        files = kept("_files", raw.select(F.col("path").alias("doc_id"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")))
        converted = kept("_converted", D.read_with(spark, path, convert, pattern))
        total, failed = converted.agg(F.count(F.lit(1)), F.count("_corrupt_record")).head()
        if total and failed / total > most_failures:
            raise TooManyFailures(f"{failed} of {total} files could not be converted", rate=failed / total)
        masked, maps = own.mask_documents(converted.filter("_corrupt_record is null"))
        kept("documents", masked.drop("_corrupt_record"))
        manifest = kept("manifest", _manifest(files, converted, kept("maps", maps)))
        by = {r["status"]: r["n"] for r in manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        masks = manifest.agg(F.coalesce(F.sum("masks"), F.lit(0))).head()[0]
        for name in ("_files", "_converted"):
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{beside}/{name}"), True)
        if overwrite:
            store.delete(to, True)
        if not store.rename(at, to):
            raise OSError(f"{beside} could not be moved to {out}")
    finally:
        with contextlib.suppress(Exception):  # what was moved is no longer there
            store.delete(at, True)
    return {"files": total, **{s: by.get(s, 0) for s in ("masked", "clean", "failed")}, "masks": masks}


def manifest_json(spark: SparkSession, out: str) -> str:
    """The manifest as a line of JSON a file, in order of their names, for batches that a person reads."""
    rows = spark.read.parquet(f"{out}/manifest").orderBy("doc_id").toLocalIterator()
    return "\n".join(json.dumps(r.asDict(recursive=True), ensure_ascii=False) for r in rows)
