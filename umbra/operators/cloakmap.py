"""Mapping records of a masked document: build, statistics, integrity, merge, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.functions.strategies import REVERSIBLE

from .policy import Policy

FIELDS = ("node_id", "start", "end", "entity_type", "confidence", "masked_value", "masked_start", "masked_end", "replacement_id", "checksum_salt", "original_checksum", "strategy_used", "original_text")
ANCHOR = "struct<node_id:string,start:int,end:int,entity_type:string,confidence:double,masked_value:string,masked_start:int,masked_end:int,replacement_id:string,checksum_salt:string,original_checksum:string,strategy_used:string,original_text:string>"
OPERATOR = "struct<engine_used:string,operators:map<string,string>,entities:array<string>,anchors:long>"
SCHEMA = f"version string, doc_id string, doc_hash string, anchors array<{ANCHOR}>, policy_snapshot string, created_at string, metadata map<string,string>, operator_metadata {OPERATOR}, encrypted_content string, signature string"
# The versions that are known, and the largest file.
VERSIONS = ("1.0", "2.0")
MAX_BYTES = 100 * 1024 * 1024
REQUIRED = ("version", "doc_id", "doc_hash", "anchors")


def build(anchors: DataFrame, documents: DataFrame, policy: Policy, version: str = "2.0", created_at: str | None = None) -> DataFrame:
    """One row a document (doc_id, text): its hash, the policy and the anchors in order; documents without are kept."""
    if version not in VERSIONS:
        raise ValueError(f"versions are {VERSIONS}")
    grouped = anchors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("anchors"))
    rows = documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_hash")).join(grouped, "doc_id", "left")
    none = F.array().cast(grouped.schema["anchors"].dataType)
    when = F.lit(created_at) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(F.lit(version).alias("version"), "doc_id", "doc_hash", F.coalesce("anchors", none).alias("anchors"), F.lit(policy.to_json()).alias("policy_snapshot"), when.alias("created_at"))


def statistics(anchors: DataFrame, *by: str) -> DataFrame:
    length, masked = F.col("end") - F.col("start"), F.char_length("masked_value")
    return anchors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 10).alias("avg_confidence"), F.sum(length).cast("long").alias("original_chars"), F.sum(masked).cast("long").alias("masked_chars"), F.sum(masked - length).cast("long").alias("delta"))


def faults(anchors: DataFrame) -> DataFrame:
    """anchors that break an invariant, with the messages."""
    checks = {
        "bad place": (F.col("start") < 0) | (F.col("end") <= F.col("start")),
        "bad confidence": ~F.col("confidence").between(0, 1),
        "bad checksum": ~F.col("original_checksum").rlike("^[0-9a-f]{64}$"),
        "blank id": F.trim("replacement_id") == "",
        "blank type": F.trim("entity_type") == "",
    }
    messages = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))
    return anchors.withColumn("faults", messages).filter(F.size("faults") > 0)


def duplicate_ids(anchors: DataFrame) -> DataFrame:
    return anchors.groupBy("replacement_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def overlaps(anchors: DataFrame) -> DataFrame:
    """Anchors that begin before an earlier one of their node ends."""
    w = Window.partitionBy("doc_id", "node_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return anchors.withColumn("reach", F.max("end").over(w)).filter(F.col("start") < F.col("reach")).drop("reach")


def touching(anchors: DataFrame, node: str, start: int, end: int) -> DataFrame:
    """Anchors of a node that overlap a range."""
    return anchors.filter((F.col("node_id") == node) & (F.col("start") < end) & (F.col("end") > start))


def anchors_of(maps: DataFrame) -> DataFrame:
    """The anchors of maps as rows."""
    return maps.select("doc_id", F.explode("anchors").alias("a")).select("doc_id", "a.*")


def id_to_mask(maps: DataFrame) -> DataFrame:
    """doc_id and the map from replacement ids to masked values; of ids that repeat the last counts."""
    pairs = F.transform("anchors", lambda a: F.struct(a["replacement_id"].alias("key"), a["masked_value"].alias("value")))
    once = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    return maps.select("doc_id", once.alias("masks"))


def counts_by_type(maps: DataFrame) -> DataFrame:
    return anchors_of(maps).groupBy("doc_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def verified(anchors: DataFrame) -> DataFrame:
    """anchors with ok: the original text matches its checksum, salted or plain."""
    plain, salted = F.sha2("original_text", 256), F.sha2(F.concat("checksum_salt", "original_text"), 256)
    return anchors.withColumn("ok", F.coalesce(F.col("original_checksum").isin(plain, salted), F.lit(False)))


def hash_verified(maps: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id and same: whether a map was made of this text (doc_id, text); null without the text."""
    return maps.select("doc_id", "doc_hash").join(documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_h")), "doc_id", "left").select("doc_id", (F.col("doc_hash") == F.col("_h")).alias("same"))


def validated(maps: DataFrame) -> DataFrame:
    """doc_id, errors and warnings of each map; a map with errors is not to be used."""
    ids = F.transform("anchors", lambda a: a["replacement_id"])
    ordered = F.array_sort(F.transform("anchors", lambda a: F.struct(a["node_id"].alias("n"), a["start"].alias("s"), a["end"].alias("e"))))
    start = F.struct(F.lit("").alias("n"), F.lit(0).alias("e"), F.lit(False).alias("bad"))
    same = lambda a, x: a["n"] == x["n"]
    crossing = F.aggregate(ordered, start, lambda a, x: F.struct(x["n"].alias("n"), F.when(same(a, x), F.greatest(a["e"], x["e"])).otherwise(x["e"]).alias("e"), (a["bad"] | (same(a, x) & (x["s"] < a["e"]))).alias("bad")), lambda a: a["bad"])
    bad = lambda f: F.exists("anchors", f)
    errors = {
        "no version": F.col("version").isNull(),
        "unknown version": ~F.col("version").isin(*VERSIONS),
        "no document": F.length(F.trim(F.coalesce("doc_id", F.lit("")))) == 0,
        "bad hash": ~F.coalesce("doc_hash", F.lit("")).rlike("^[0-9a-f]{64}$"),
        "no anchors": F.col("anchors").isNull(),
        "ids repeat": F.size(F.array_distinct(ids)) < F.size(ids),
        "anchors overlap": crossing,
        "bad place": bad(lambda a: (a["start"] < 0) | (a["end"] <= a["start"])),
        "bad checksum": bad(lambda a: ~F.coalesce(a["original_checksum"], F.lit("")).rlike("^[0-9a-f]{64}$")),
    }
    warnings = {
        "nothing was masked": F.size("anchors") == 0,
        "no policy": F.col("policy_snapshot").isNull() if "policy_snapshot" in maps.columns else F.lit(True),
        "unsure detections": bad(lambda a: a["confidence"] < 0.5),
    }
    listed = lambda checks: F.array_compact(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(name)) for name, x in checks.items()]))
    return maps.select("doc_id", listed(errors).alias("errors"), listed(warnings).alias("warnings"))


def merge(maps: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(maps of one document and version as one, with the policy of the last (created_at); faults: doc_id, errors).

    target names the document that all maps are merged into; anchors that are equal count once, and ids that repeat or
    anchors that overlap after that are faults."""
    rows = maps.withColumn("doc_id", F.lit(target)) if target else maps
    by = ["doc_id", "version"] if target else ["doc_id", "version", "doc_hash"]
    hash_ = [F.max_by("doc_hash", "created_at").alias("doc_hash")] if target else []
    together = F.array_sort(F.array_distinct(F.flatten(F.collect_list("anchors"))))
    out = rows.groupBy(*by).agg(together.alias("anchors"), F.max_by("policy_snapshot", "created_at").alias("policy_snapshot"), F.max("created_at").alias("created_at"), *hash_)
    wrong = validated(out).select("doc_id", F.filter("errors", lambda e: e.isin("ids repeat", "anchors overlap")).alias("errors"))
    return out, wrong.filter(F.size("errors") > 0)


def to_json(maps: DataFrame) -> DataFrame:
    return maps.select("doc_id", F.to_json(F.struct(*maps.columns)).alias("value"))


def from_json(lines: DataFrame, schema=SCHEMA) -> DataFrame:
    """Rows that are no map of a known version carry error instead."""
    rows = lines.withColumn("m", F.from_json("value", schema))
    known = F.col("m.version").isin(*VERSIONS) & F.col("m.doc_id").isNotNull()
    return rows.select(F.when(known, F.col("m")).alias("m"), F.when(~F.coalesce(known, F.lit(False)), F.lit("not a map of a known version")).alias("error")).select("m.*", "error")


def save(maps: DataFrame, path: str) -> None:
    """One line of JSON a map."""
    to_json(maps).select("value").write.mode("overwrite").text(path)


def _problem(size: Column, value: Column, m: Column) -> Column:
    missing = F.array_compact(F.array(*[F.when(m[name].isNull(), F.lit(name)) for name in REQUIRED]))
    return (
        F.when(size > MAX_BYTES, F.lit("larger than 100 MB"))
        .when(F.length(F.trim(value)) == 0, F.lit("empty"))
        .when(m.isNull() | (F.size(missing) == len(REQUIRED)), F.lit("not JSON of a map"))
        .when(m["encrypted_content"].isNotNull(), F.lit("encrypted maps are not supported"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(~m["version"].isin(*VERSIONS), F.concat(F.lit("unknown version "), m["version"]))
    )


def load(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Maps of files, a map a file or a line; strict: any that cannot be read raises, else it is a row with error."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    whole = F.from_json("value", SCHEMA)
    single = whole.isNotNull() & whole["version"].isNotNull() & ~F.trim("value").rlike(r"\}\s*\n\s*\{")
    lines = F.when(single | (F.instr("value", "\n") == 0), F.array("value")).otherwise(F.filter(F.split("value", "\n"), lambda x: x.rlike(r"\S")))
    return loaded(files.select("path", "size", F.explode(F.when(F.size(lines) > 0, lines).otherwise(F.array("value"))).alias("value")), strict)


def loaded(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Maps of a column of texts (value; path and size, where known), as load() reads them."""
    size = F.col("size") if "size" in lines.columns else F.octet_length("value")
    rows = lines.withColumn("m", F.from_json("value", SCHEMA)).withColumn("error", _problem(size, F.col("value"), F.col("m")))
    if strict:
        rows = rows.withColumn("m", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("no map: "), F.col("error"))).cast(rows.schema["m"].dataType)).otherwise(F.col("m")))
    return rows.select(*[c for c in ("path",) if c in lines.columns], "m.*", "error")


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """path, size, version, doc_id, anchors, valid and error of each file, and its first 1024 characters."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "value")
    rows = rows.withColumn("m", F.from_json("value", SCHEMA)).withColumn("error", _problem(F.col("size"), F.col("value"), F.col("m")))
    return rows.select("path", "size", "m.version", "m.doc_id", F.size("m.anchors").alias("anchors"), F.col("error").isNull().alias("valid"), "error", F.substring("value", 1, 1024).alias("head"))


def with_operators(maps: DataFrame, engine: str = "umbra") -> DataFrame:
    """Maps with what was done: the engine, a strategy for each type, the types and the number of anchors; maps without
    anchors stay as they are."""
    types = F.array_sort(F.array_distinct(F.transform("anchors", lambda a: a["entity_type"])))
    how = F.map_from_entries(F.transform(types, lambda t: F.struct(t.alias("k"), F.filter("anchors", lambda a: a["entity_type"] == t)[0]["strategy_used"].alias("v"))))
    made = F.struct(F.lit(engine).alias("engine_used"), how.alias("operators"), types.alias("entities"), F.size("anchors").cast("long").alias("anchors"))
    return maps.withColumn("operator_metadata", F.when(F.size("anchors") > 0, made))


def migrated(maps: DataFrame, engine: str = "umbra") -> DataFrame:
    """Maps of version 1.0 as maps of 2.0; others stay."""
    return with_operators(maps, engine).withColumn("version", F.when(F.col("version") == "1.0", "2.0").otherwise(F.col("version")))


def flags(maps: DataFrame) -> DataFrame:
    """doc_id, reversible (no anchor of a custom strategy), v2, with_operators, encrypted and signed."""
    has = lambda c: F.col(c).isNotNull() if c in maps.columns else F.lit(False)
    back = F.forall("anchors", lambda a: a["strategy_used"].isin(*sorted(REVERSIBLE)))
    return maps.select("doc_id", back.alias("reversible"), F.startswith(F.col("version"), F.lit("2.")).alias("v2"), has("operator_metadata").alias("with_operators"), has("encrypted_content").alias("encrypted"), has("signature").alias("signed"))
