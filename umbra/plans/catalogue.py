"""The registered queries over the driver's tables; oracles.py has the SQL that another engine runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra import sql as sql_functions
from umbra.functions import strategies as S
from umbra.functions import text as T
from umbra.functions.arrays import exploded
from umbra.functions.permute import permuted
from umbra.operators import cloakmap, detect, intervals, mask, phrases, policy, resolve, tagger, vault
from umbra.sources import documents as D
from umbra.sources.tables import spread

from . import names
from .oracles import CROSSING, FOUR, PATTERNS, SHORT
from .oracles import sql as oracle_sql

Query = Callable[[SparkSession, str], DataFrame]
MAIN = [PATTERNS[SHORT[n]] for n in FOUR]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("node_id", F.lit("#/texts/0"))


def _entities(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    found = detect.detect(_docs(spark, sf_dir), [PATTERNS[SHORT[n]] for n in names or FOUR])
    return detect.entities(found, "doc_id", "lang")


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir, *SHORT)


def _crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.entities(detect.detect(_docs(spark, sf_dir), [*detect.RECOGNIZERS, *CROSSING]), "doc_id")


# Strategies by the name of their query.


def _native(kind: str, **parameters) -> Callable[[Column, Column], Column]:
    strategy = S.Strategy(kind, parameters)
    return lambda k, t: S.native(strategy, k, t)


def _operator(kind: str, **parameters) -> Callable[[Column, Column], Column]:
    strategy = S.Strategy(kind, parameters)
    return lambda k, t: S.operator_form(strategy, k, t)


STRATEGIES = {
    "redact": _native("redact"),
    "redact_fixed": _native("redact", preserve_length=False, redact_char="#"),
    "template": _native("template", template="[{entity_type}:{length}]"),
    "template_form": _native("template", template="<{original_format}>"),
    "template_format": _native("template", auto_generate=True),
    "template_merge_mark": _native("template", template="[PII]", preserve_format=True),
    "template_merge_format": _native("template", template="~{format}", preserve_format=True),
    "hash_sha256": _native("hash"),
    "hash_salted": _native("hash", salt="pepper", truncate=16, prefix="h_"),
    "hash_prefix": _native("hash", salt="pepper", truncate=12, consistent_length=False),
    "hash_entity_salt": _native("hash", per_entity_salt={"EMAIL_ADDRESS": "e1", "default": "d1"}),
    "hash_md5": _native("hash", algorithm="md5"),
    "hash_sha1": _native("hash", algorithm="sha1"),
    "hash_base64": _native("hash", format_output="base64"),
    "hash_structure": _native("hash", preserve_format_structure=True),
    "operator_hash": _operator("hash", salt="x", prefix="op_", truncate=20),
    "operator_partial": _operator("partial"),
    "partial_end": _native("partial", format_aware=False),
    "partial_start": _native("partial", format_aware=False, position="start", visible_chars=3, mask_char="X"),
    "partial_middle": _native("partial", format_aware=False, position="middle"),
    "partial_long": _native("partial", format_aware=False, visible_chars=30),
    "partial_short": _native("partial", format_aware=False, min_length=12),
    "partial_format": _native("partial"),
    "partial_format_start": _native("partial", position="start"),
    "partial_format_middle": _native("partial", position="middle"),
    "compose": lambda k, t: S.compose(t, k, S.REDACT, S.Strategy("hash", {"algorithm": "md5"})),
}


def _strategy(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _entities(spark, sf_dir)
        return rows.select("doc_id", "entity_type", "start", STRATEGIES[name](F.col("entity_type"), F.col("text")).alias("masked"))

    return query


def _resolved(how: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.detect(_docs(spark, sf_dir), [*detect.RECOGNIZERS, *CROSSING])
        return detect.entities(found.withColumn("spans", resolve.RESOLVERS[how](F.col("spans"))), "doc_id").drop("text")

    return query


def _filtered(p: policy.Policy) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _entities(spark, sf_dir).withColumn("s", F.struct("entity_type", "start", "end", "confidence", "text")).filter(p.masks(F.col("s"), F.lit("paragraph"))).drop("s", "lang")

    return query


def _masked(spark: SparkSession, sf_dir: str, p: policy.Policy = policy.DEFAULT) -> DataFrame:
    return mask.mask(_nodes(spark, sf_dir), p, MAIN)


def _masked_hash(p: policy.Policy) -> Query:
    return lambda spark, sf_dir: _masked(spark, sf_dir, p).select("doc_id", F.sha2("masked_text", 256).alias("masked_sha256"))


def mask_documents_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).select("doc_id", F.size("spans").alias("n_spans"), F.sha2("masked_text", 256).alias("masked_sha256"), F.char_length("masked_text").cast("long").alias("masked_chars"))


def shout(original_text: str, entity_type: str, confidence: float) -> str:
    return f"<{entity_type.lower()} {len(original_text)}>"


def shout_some(original_text: str, entity_type: str, confidence: float) -> str | None:
    """Fails for texts of even length, and gives nothing for addresses of IP."""
    if entity_type == "IP_ADDRESS":
        return None
    if len(original_text) % 2 == 0:
        raise ValueError("even")
    return shout(original_text, entity_type, confidence)


FAILING = policy.Policy(S.Strategy("custom", {"callback": shout_some}), fallbacks=True)
CUSTOM = policy.Policy(S.Strategy("custom", {"callback": shout}))
SURROGATE = policy.Policy(S.Strategy("surrogate", {"seed": "catalogue"}))


def mask_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surrogate against what its kind must look like, its original, and the places in the masked text."""
    rows = exploded(_masked(spark, sf_dir, SURROGATE), F.col("spans"), "doc_id", "masked_text").select("doc_id", "masked_text", "s.*")
    new = F.col("replacement")
    digits = F.regexp_replace("text", "[^0-9]", "")
    form = (
        F.when(F.col("entity_type") == "EMAIL_ADDRESS", new.rlike(r"^[^@]+@[^@]+\.[^@]+$"))
        .when(F.col("entity_type") == "CREDIT_CARD", new.rlike(r"^(4000|4111|4444|5000|5555)[0-9 -]{12,}$"))
        .when(F.col("entity_type") == "PHONE_NUMBER", F.col("text").startswith("+") & new.rlike(r"^\+1 20[0-9]|^\+1 210") | ~F.col("text").startswith("+") & (F.char_length(F.regexp_replace(new, "[^0-9]", "")) == F.char_length(digits)) | F.col("text").contains("("))
        .otherwise(T.format_pattern(new) == T.format_pattern(F.col("text")))
    )
    again = F.substring("masked_text", F.col("masked_start") + 1, F.col("masked_end") - F.col("masked_start")) == new
    return rows.select("doc_id", "entity_type", "start", form.alias("keeps_form"), (new != F.col("text")).alias("differs"), again.alias("found_again"))


def unmask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.unmask_rows(_masked(spark, sf_dir)).select("doc_id", (F.col("restored_text") == F.col("text")).alias("same"))


def unmask_by_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _masked(spark, sf_dir)
    back = mask.unmask(done.select("doc_id", "node_id", "text", "masked_text"), mask.anchors(done))
    return back.select("doc_id", (F.col("restored_text") == F.col("text")).alias("same"))


def anchors_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.anchors(_masked(spark, sf_dir)).select("doc_id", "node_id", "start", "end", "entity_type", "masked_value", "replacement_id", "original_checksum")


def replacements_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mask.replacements(_masked(spark, sf_dir))
    return rows.select("doc_id", F.array_join(F.transform("replacements", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"), r["text"])), ",").alias("replacements"))


def cloakmap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloakmap.statistics(mask.anchors(_masked(spark, sf_dir)), "entity_type")


def _maps(spark: SparkSession, sf_dir: str, version: str = "2.0") -> DataFrame:
    done = _masked(spark, sf_dir)
    maps = cloakmap.build(mask.anchors(done), done.select("doc_id", "text"), policy.DEFAULT, version, "2026-01-01T00:00:00Z")
    return maps.withColumn("doc_id", F.col("doc_id").cast("string"))


def cloakmap_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maps(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "version", "doc_hash", F.size("anchors").alias("n_anchors"))


def cloakmap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = cloakmap.migrated(_maps(spark, sf_dir, "1.0"))
    said = cloakmap.validated(maps).select("doc_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))
    return cloakmap.flags(maps).join(said, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))


def cloakmap_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cloakmap.to_json(_maps(spark, sf_dir))
    back = cloakmap.loaded(lines.select("value"), strict=True)
    again = cloakmap.to_json(back.drop("error", "metadata", "operator_metadata", "encrypted_content", "signature"))
    joined = lines.join(again.withColumnRenamed("value", "_v"), "doc_id").join(back.select("doc_id", F.size("anchors").alias("n_anchors")), "doc_id")
    fields = "version string, doc_id string, doc_hash string, anchors string, policy_snapshot string, created_at string"
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "n_anchors", (F.from_json("value", fields) == F.from_json("_v", fields)).alias("same"))


def cloakmap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloakmap.counts_by_type(_maps(spark, sf_dir)).withColumn("doc_id", F.col("doc_id").cast("long"))


def checksum_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloakmap.verified(mask.anchors(_masked(spark, sf_dir))).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _masked(spark, sf_dir)
    return mask.resolve_anchors(done, mask.anchors(done))


def anchor_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "start", "masked_start", "found", "delta", F.col("found_confidence").alias("confidence"))


def anchor_resolve_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.resolution_statistics(_found(spark, sf_dir), "entity_type")


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.integrity(_found(spark, sf_dir), "doc_id")


def restore_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were edited after masking, by a word at their beginning."""
    done = _masked(spark, sf_dir)
    edited = done.select("doc_id", "node_id", F.concat(F.lit("new "), "masked_text").alias("masked_text"))
    return mask.restore(edited, mask.anchors(done))[0].select("doc_id", F.sha2("restored_text", 256).alias("sha256"))


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors looked for in masked texts that were changed by document: moved by 0, 12, 33 or 70 characters, without
    their addresses of mail, or gone."""
    done, k = _masked(spark, sf_dir), F.col("doc_id") % 6
    moved = F.when(k == 1, 12).when(k == 2, 33).when(k == 3, 70).otherwise(0)
    text = F.concat(F.repeat(F.lit("z"), moved), F.when(k == 4, F.replace("masked_text", F.lit("[EMAIL]"), F.lit(""))).otherwise(F.col("masked_text")))
    return mask.resolve_anchors(done.filter(k != 5).select("doc_id", "node_id", text.alias("masked_text")), mask.anchors(done))


def anchor_resolve_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir).select("doc_id", "start", "entity_type", "found", "delta", F.round("found_confidence", 6).alias("confidence"), "reason")


def restoration_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.restoration_statistics(_edited(spark, sf_dir), "entity_type").select("entity_type", "anchors", "restored", "verified", "no_node", "no_value", "unsure")


def maps_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps encrypted and opened again, and opened after one character was changed."""
    lines = cloakmap.to_json(_maps(spark, sf_dir))
    sealed = vault.seal(lines, b"catalogue-master-key-of-32-bytes", "k1")
    keys = {"k1": b"catalogue-master-key-of-32-bytes"}
    opened = vault.unseal(sealed, keys).withColumnRenamed("value", "plain")
    bent = vault.unseal(sealed.withColumn("value", F.regexp_replace("value", '"encrypted_content":"(.)', '"encrypted_content":"-$1')), keys).select("doc_id", F.col("error").alias("bent"))
    rows = lines.join(opened, "doc_id").join(bent, "doc_id")
    fields = "version string, doc_id string, doc_hash string, anchors string"
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (F.from_json("plain", fields) == F.from_json("value", fields)).alias("same"), "error", F.col("bent").alias("error_of_bent"))


def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lines(_docs(spark, sf_dir)).select("doc_id", "ordinal", "start_offset", "end_offset")


def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.full_text(D.lines(_docs(spark, sf_dir))).select("doc_id", F.sha2("text", 256).alias("sha256"))


def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.document_hash(D.lines(_docs(spark, sf_dir)), "")


def extraction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.extraction_statistics(D.lines(_docs(spark, sf_dir)))


def place_in_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the full text, from the second character of each line, with their node, if one holds them."""
    rows = D.lines(_docs(spark, sf_dir))
    return D.to_node(rows.select("doc_id", (F.col("start_offset") + 1).alias("start"), (F.col("start_offset") + 6).alias("end")), rows)


def place_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.lines(_docs(spark, sf_dir))
    places = rows.select("doc_id", "node_id", "ordinal", F.lit(1).alias("node_start"), F.lit(3).alias("node_end"))
    return D.to_global(places, rows).select("doc_id", "ordinal", "start", "end")


def _in_full_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(addresses and numbers of the full texts, their lines as nodes)."""
    rows = D.lines(_docs(spark, sf_dir))
    return detect.entities(detect.detect(D.full_text(rows), MAIN), "doc_id").select("doc_id", "entity_type", "start", "end"), rows


def entities_in_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the full text with the line that holds them."""
    return D.to_node(*_in_full_texts(spark, sf_dir))


def anchors_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the full text with the line that their beginning is in, widened so that some end beyond it."""
    found, rows = _in_full_texts(spark, sf_dir)
    return mask.of_segment(found.withColumn("end", F.col("end") + 30), rows)


def spans_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a recognizer's span and a crossing one's that overlap."""
    a = _all(spark, sf_dir).select("doc_id", "entity_type", "start", "end")
    b = detect.entities(detect.detect(_docs(spark, sf_dir), list(CROSSING)), "doc_id").select("doc_id", "entity_type", "start", "end")
    return intervals.overlapping(a, b, "doc_id")


def clamped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that begin with a line and reach far beyond it, cut to the line."""
    whole = D.segments(D.lines(_docs(spark, sf_dir)))
    far = F.transform("segments", lambda g: F.struct(F.lit("X").alias("entity_type"), g["start"].alias("start"), (g["end"] + 50).alias("end"), F.lit(1.0).alias("confidence"), F.lit("").alias("text")))
    cut = whole.select("doc_id", F.explode(mask.clamped(far, F.col("text"), F.col("segments"))).alias("s"))
    rows = D.lines(_docs(spark, sf_dir)).select("doc_id", "ordinal", F.col("start_offset").cast("int").alias("start"))
    return cut.select("doc_id", "s.start", "s.end").join(rows, ["doc_id", "start"]).select("doc_id", "ordinal", "start", "end")


def entity_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts"))


def detect_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by the table function, joined laterally."""
    sql_functions.register(spark)
    return spark.sql("SELECT d.doc_id, e.entity_type, e.start, e.end, e.confidence, e.text FROM {docs} d, LATERAL detect_pii(d.text) e", docs=_docs(spark, sf_dir))


def entity_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("lang", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def entity_counts_by_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def entity_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask.normalised_types(_all(spark, sf_dir)).select("doc_id", "start", "entity_type")


def above_default_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.above_default_thresholds(_all(spark, sf_dir)).select("doc_id", "entity_type", "start")


def entities_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir).withColumn("node_id", F.lit("#/texts/0"))
    return mask.numbered(rows).select("doc_id", "start", "entity_type", "replacement_id")


def analysis_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.analysis(detect.analyze_segments(_docs(spark, sf_dir), replace(detect.ANALYZERS["default"], threshold=0.8)), "doc_id")


def entities_by_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = _entities(spark, sf_dir, "ip").select("text")
    return detect_lists(_entities(spark, sf_dir), ips, ips.filter(F.col("text").startswith("1")))


def detect_lists(entities: DataFrame, allow: DataFrame, deny: DataFrame) -> DataFrame:
    return policy.by_lists(entities, allow, deny).select("doc_id", "start", "listed")


def entities_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _entities(spark, sf_dir)
    done = exploded(_masked(spark, sf_dir), F.col("spans"), "doc_id").select("doc_id", "s.*")
    return detect.paired(found, done, "doc_id").drop("original_text")


def overlap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.islands(_entities(spark, sf_dir), "doc_id", gap=200)
    return rows.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def resolve_highest_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.highest_confidence(_crossing(spark, sf_dir), "doc_id").select("doc_id", "entity_type", "start", "end")


def resolve_merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_adjacent(_entities(spark, sf_dir), "doc_id", gap=200).select("doc_id", "entity_type", "start", "end", "parts", "text")


def normalise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.normalised(_crossing(spark, sf_dir), "doc_id")[1]


def normalisation_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resolution by length breaks of the promise to keep sure entities."""
    found = detect.detect(_docs(spark, sf_dir), [*detect.RECOGNIZERS, *CROSSING])
    return resolve.faults_of_spans(found, "longest", "doc_id")


def policy_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = policy.Rule
    p = policy.Policy(
        per_entity={"EMAIL_ADDRESS": S.Strategy("template", {"template": "[E]"})},
        contexts={"heading": rule(strategy=S.Strategy("template", {"template": "[HEAD]"}), threshold=0.88, threshold_overrides={"PHONE_NUMBER": 0.7}), "table": rule(enabled=False)},
        min_confidence=0.8,
    )
    rows = _entities(spark, sf_dir).withColumn("context", F.when(F.col("doc_id") % 3 == 0, "heading").when(F.col("doc_id") % 3 == 1, "table").otherwise("paragraph"))
    rows = rows.withColumn("s", F.struct("entity_type", "start", "end", "confidence", "text")).filter(p.masks(F.col("s"), F.col("context")))
    return rows.select("doc_id", "entity_type", "start", "context", p.replacement(F.col("s"), F.col("context")).alias("masked"))


def names_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger trained on the sentences of four fifths of the customers, measured on the others'."""
    texts = names.corpus(spark, sf_dir)
    model, _ = tagger.fit(texts.filter("c_custkey % 5 <> 0"))
    held = texts.filter("c_custkey % 5 = 0")
    gold = held.select("id", F.explode("spans").alias("s")).select("id", "s.*")
    found = detect.entities(detect.detect(held.drop("spans"), [model.recognizer()]), "id")
    rows = tagger.accuracy(found, gold, "id")
    return rows.select("entity_type", "gold", (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("precision") >= 0.9).alias("precision_reached"))


def _listed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words from the texts of `benchmark`."""
    w = F.split("text", " ")
    some = F.array(*[F.array_join(F.slice(w, a, n), " ") for a, n in ((1, 2), (1, 3), (4, 2), (5, 3), (9, 2))])
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(some).alias("text"))
    return rows.filter(F.col("text").rlike("^[A-Za-z0-9]+( [A-Za-z0-9]+)+$")).distinct()


def phrases_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the automaton."""
    own = phrases.of_table("LISTED", _listed_phrases(spark, sf_dir))
    return detect.entities(detect.detect(_docs(spark, sf_dir), [own]), "doc_id").select("doc_id", "start", "end", "text")


def phrases_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the join."""
    return phrases.joined(_docs(spark, sf_dir), _listed_phrases(spark, sf_dir), "doc_id")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text a customer with an SSN, an address of the web, a date and an account number that follow from its key; a third of the
    account numbers have a wrong check."""
    k = F.col("c_custkey").cast("long")
    number = F.lpad((k * 7919 + 123).cast("string"), 18, "3")
    wanted = 98 - F.pmod(F.concat(number, F.lit("131400")).cast("decimal(38,0)"), F.lit(97).cast("decimal(38,0)")).cast("int")
    check = F.when(k % 3 == 0, F.pmod(wanted + 5, F.lit(97))).otherwise(wanted)
    ssn = F.concat_ws("-", F.lpad((k % 900 + 1).cast("string"), 3, "0"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0"))
    date = F.concat_ws("-", (k % 100 + 1950).cast("string"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    text = F.concat(F.lit("Dossier "), ssn, F.lit(" vu à https://www.host"), k.cast("string"), F.lit(".org/p?q=1 le "), date, F.lit(", compte DE"), F.lpad(check.cast("string"), 2, "0"), number, F.lit("; fin"))
    customers = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey")
    return customers.select(k.alias("doc_id"), text.alias("text"), F.lit("fr").alias("lang"))


def forms_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.entities(detect.detect(_forms(spark, sf_dir)), "doc_id")


def forms_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mask.mask(_forms(spark, sf_dir).withColumn("node_id", F.lit("#/0")), policy.DEFAULT)
    return done.select("doc_id", F.size("spans").alias("n_spans"), F.sha2("masked_text", 256).alias("masked_sha256"))


def surrogates_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates by a keyed permutation: the form stays, the key turns each back."""
    rows = _entities(spark, sf_dir).withColumn("fake", permuted(F.col("entity_type"), F.col("text"), "catalogue"))
    same_form = F.regexp_replace(F.regexp_replace("fake", "[0-9]", "9"), "[a-z]", "x") == F.regexp_replace(F.regexp_replace("text", "[0-9]", "9"), "[a-z]", "x")
    back = permuted(F.col("entity_type"), F.col("fake"), "catalogue", back=True) == F.col("text")
    upper = F.regexp_replace("text", "[^A-Z]", "") == ""
    return rows.select("doc_id", "entity_type", "start", (same_form | ~upper).alias("keeps_form"), back.alias("turned_back"))


def surrogates_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different texts of the whole table, and different surrogates of them."""
    rows = _entities(spark, sf_dir).select("entity_type", "text", permuted(F.col("entity_type"), F.col("text"), "catalogue").alias("fake"))
    return rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts"), F.countDistinct("fake").alias("n_surrogates"))


def _scalar(make) -> Query:
    return lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.sha2(make(F.col("text")), 256).alias("sha256"))


def _rendered(make) -> Query:
    return lambda spark, sf_dir: make(D.lines(_docs(spark, sf_dir))).select("doc_id", F.sha2("text", 256).alias("sha256"))


def surrogate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir).withColumn("fake", S.surrogate("seed")(F.col("entity_type"), F.col("text")))
    kept = (T.format_pattern(F.col("fake")) == T.format_pattern(F.col("text"))).cast("int")
    return rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.avg(kept).alias("format_kept"), F.avg((F.col("fake") != F.col("text")).cast("int")).alias("changed"), F.countDistinct("fake").alias("distinct_fakes"))


def mask_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.columns(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", "c_name", "c_mktsegment")
    return rows.select("doc_id", "node_id", S.partial(F.col("text"), 3, format_aware=False).alias("masked"))


def rebuild_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one text and one table cell, masked by their nodes and put together again."""
    cell = F.struct(F.lit("a@b.co").alias("text"))
    table = F.struct(F.lit("#/tables/0").alias("self_ref"), F.struct(F.lit(1).alias("num_rows"), F.lit(1).alias("num_cols"), F.array(cell).alias("table_cells"), F.array(F.array(cell)).alias("grid")).alias("data"))
    text = F.struct(F.lit("#/texts/0").alias("self_ref"), F.lit("text").alias("label"), F.col("text"), F.col("text").alias("orig"))
    side = F.struct(F.lit("").alias("text"))
    pair = F.struct(F.lit("#/kv/0").alias("self_ref"), side.alias("key"), side.alias("value"))
    docs = _docs(spark, sf_dir).select("doc_id", F.array(text).alias("texts"), F.array(table).alias("tables"), F.array(pair).alias("key_value_items"))
    done = D.rebuild(docs, mask.mask(D.nodes(docs), policy.DEFAULT, MAIN))
    return done.select("doc_id", F.sha2(F.col("texts")[0]["text"], 256).alias("text_sha256"), F.sha2(F.col("texts")[0]["orig"], 256).alias("orig_sha256"), F.sha2(F.col("tables")[0]["data"]["grid"][0][0]["text"], 256).alias("cell_sha256"))


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.detect_format(F.col("html"), F.col("url")).alias("format"))


def detect_format_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without telling content by their names, and others by their content."""
    cases = [("x", "a.json"), ("x", "a.md"), ("x", "a.HTM"), ("x", "a.xml"), ("# head\n", "a"), ("<?xml version='1.0'?>", "a.txt"), (" [1]", "a.md"), ("x", "a.pdf")]
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cases]), (F.col("page_id") % 8 + 1).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", T.detect_format(pick(0), pick(1)).alias("format"))


def render_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.sha2(D.mark_html(F.replace("html", F.lit("<p>"), F.lit("<p>[REDACTED]"))), 256).alias("sha256"))


STRICT = policy.Policy(thresholds={"PHONE_NUMBER": 0.8, "EMAIL_ADDRESS": 0.5}, min_confidence=0.86)
LISTS = policy.Policy(allow=frozenset({"4952935900253052"}), deny=frozenset({"1.1.1.1"}), min_length=15)
QUERIES = (
    mask_documents_default, mask_surrogate, unmask_roundtrip, unmask_by_anchors, anchors_build, replacements_list, cloakmap_stats, cloakmap_build, cloakmap_flags, cloakmap_round_trip, cloakmap_counts, checksum_verify, anchor_resolve,
    anchor_resolve_statistics, anchor_resolve_edited, restoration_by_reason, maps_sealed, integrity, restore_edited, segment_offsets, full_text, document_hash, extraction_statistics, place_in_node, place_in_text, entities_in_lines, anchors_of_lines, spans_overlapping, clamped_spans, entity_counts_by_type, detect_by_sql, entity_counts_by_lang, entity_counts_by_doc,
    entity_type_names, above_default_thresholds, entities_numbered, analysis_by_document, entities_by_lists, entities_paired, overlap_islands, resolve_highest_confidence, resolve_merge_adjacent, normalise_counts, normalisation_lost,
    policy_contexts, names_held_out, phrases_found, phrases_joined, forms_detected, forms_masked, surrogates_permuted, surrogates_distinct, surrogate_quality, mask_columns, rebuild_documents, detect_format, detect_format_by_name, render_html,
)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f.__name__: f for f in QUERIES}
    out |= {f"detect_{n}": (lambda spark, sf_dir, n=n: _entities(spark, sf_dir, n)) for n in SHORT}
    out |= {f"mask_{n}": _strategy(n) for n in STRATEGIES}
    out |= {f"overlap_{n}": _resolved(n) for n in resolve.RESOLVERS}
    out |= {"policy_threshold": _filtered(STRICT), "policy_lists_and_length": _filtered(LISTS)}
    out |= {"mask_custom": _masked_hash(CUSTOM), "mask_with_fallbacks": _masked_hash(FAILING), "mask_mixed_policy": _masked_hash(policy.MIXED_STRATEGY_POLICY)}
    out |= {"format_pattern": _scalar(T.format_pattern), "format_template": _scalar(T.generic_template), "normalise_whitespace": _scalar(T.normalise_whitespace), "normalise_whitespace_aggressive": _scalar(lambda c: T.normalise_whitespace(c, True))}
    out |= {"render_markdown": _rendered(D.to_markdown), "render_xml": _rendered(D.to_xml), "render_html_document": _rendered(D.to_html)}
    return out


__all__ = ["oracle_sql", "queries"]
