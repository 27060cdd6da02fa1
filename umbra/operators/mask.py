"""Masking and exact unmasking of node texts; both narrow but for the join of anchors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from umbra.functions.arrays import last_at_most, let, running_sums
from umbra.functions.text import entity_type

from .detect import RECOGNIZERS, detect
from .intervals import holding
from .policy import DEFAULT, Policy
from .resolve import RESOLVERS

#: Spans from which a text is cut as an array of its characters: its length once, and not once a span.
MANY = 24
# How far from its place a masked value is looked for, the steps of confidence, and the least that counts.
WINDOW, REACH, SEARCHED, LEAST = 20, 100, 0.8, 0.5
#: What an anchor without a place costs where anchors that collide are placed in order, in characters of shift.
UNPLACED = 20


def splice(text: Column, spans: Column, new: str = "replacement") -> Column:
    """text with each span (sorted, disjoint; start, end) replaced by its field `new`."""
    end_before = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    tail_at = F.try_element_at(spans, F.lit(-1))["end"]
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, end_before(i) + 1, s["start"] - end_before(i)), s[new]))
    few = F.concat(F.array_join(parts, ""), F.substring(text, tail_at + 1, F.char_length(text)))
    chars = F.array(F.filter(F.split(text, ""), lambda c: c != ""))
    cut = lambda a, at, n: F.array_join(F.slice(a, at + 1, F.greatest(n, F.lit(0))), "")

    def of_chars(a: Column) -> Column:
        pieces = F.transform(spans, lambda s, i: F.concat(cut(a, end_before(i), s["start"] - end_before(i)), s[new]))
        return F.concat(F.array_join(pieces, ""), cut(a, tail_at, F.size(a) - tail_at))

    many = F.transform(chars, of_chars)[0]  # the array of characters is made once
    return F.when(F.size(spans) > MANY, many).when(F.size(spans) > 0, few).otherwise(text)


def with_masked_places(spans: Column) -> Column:
    """spans with masked_start, masked_end: where the replacements lie in the masked text."""
    grown = F.transform(spans, lambda s: F.char_length(s["replacement"]) - s["end"] + s["start"])

    def place(s: Column, shift: Column) -> Column:
        at = (s["start"] + shift).cast("int")
        fields = [s[n].alias(n) for n in ("entity_type", "start", "end", "confidence", "text", "replacement")]
        return F.struct(*fields, at.alias("masked_start"), (at + F.char_length(s["replacement"])).alias("masked_end"))

    return F.zip_with(spans, running_sums(grown), place)


def filtered(nodes: DataFrame, policy: Policy) -> DataFrame:
    return nodes.withColumn("spans", F.filter("spans", lambda s: policy.masks(s, F.col("context"))))


def replaced(nodes: DataFrame, policy: Policy) -> DataFrame:
    """nodes whose spans carry their replacement: column expressions, and one Python call a row for the strategies that
    need Python, if the policy has any.  An empty or missing replacement is the first fallback that gives one where the policy
    has fallbacks, else an asterisk."""
    context = F.col("context")
    own = nodes.withColumn("spans", F.transform("spans", lambda s: F.struct(*[s[n].alias(n) for n in ("entity_type", "start", "end", "confidence", "text")], policy.replacement(s, context).alias("replacement"))))
    if not policy.native:
        own = own.withColumn("_python", policy.replacements_in_python(F.col("spans"), context))
        joined = F.zip_with("spans", "_python", lambda s, r: s.withField("replacement", F.coalesce(s["replacement"], r)))
        own = own.withColumn("spans", joined).drop("_python")
    instead = lambda s: policy.fallback(s, context) if policy.fallbacks else F.lit("*")
    full = lambda s: F.when(F.char_length(s["replacement"]) > 0, s["replacement"]).otherwise(instead(s))
    return own.withColumn("spans", F.transform("spans", lambda s: s.withField("replacement", full(s))))


def mask(nodes: DataFrame, policy: Policy = DEFAULT, recognizers=RECOGNIZERS, resolution: str = "greedy", detected: bool = False) -> DataFrame:
    """nodes (doc_id, node_id, text; context, else "paragraph") with masked_text and spans as they were masked.

    Null texts stay null; nodes without spans keep their text."""
    if "context" not in nodes.columns:
        nodes = nodes.withColumn("context", F.lit("paragraph"))
    found = nodes if detected else detect(nodes, recognizers)
    found = filtered(found, policy)
    found = replaced(found.withColumn("spans", RESOLVERS[resolution](F.col("spans"))), policy)
    found = found.withColumn("spans", with_masked_places(F.col("spans")))
    return found.withColumn("masked_text", splice(F.col("text"), F.col("spans")))


def replacements(masked: DataFrame) -> DataFrame:
    """doc_id, node_id and the list of (start, end, text) that a node's masking made."""
    return masked.select("doc_id", "node_id", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("text"))).alias("replacements"))


def anchors(masked: DataFrame, policy: Policy = DEFAULT, salt: str = "", keep_original: bool = True) -> DataFrame:
    """One row a masked span: places before and after, ids and salted checksums, all derived from the row."""
    context = [c for c in ("context",) if c in masked.columns]
    rows = masked.select("doc_id", "node_id", *context, F.posexplode_outer("spans").alias("seq", "s")).filter("seq is not null").select("doc_id", "node_id", *context, "seq", "s.*")
    key = F.concat_ws(":", "doc_id", "node_id", "entity_type", F.col("start").cast("string"))
    own_salt = F.substring(F.sha2(F.concat(F.lit(salt + ":"), key), 256), 1, 16)
    return rows.select(
        "doc_id", "node_id", "seq", "start", "end", "entity_type", "confidence", F.col("replacement").alias("masked_value"), "masked_start", "masked_end",
        F.concat(F.lit("repl_"), F.substring(F.sha2(key, 256), 1, 16)).alias("replacement_id"), own_salt.alias("checksum_salt"), F.sha2(F.concat(own_salt, F.col("text")), 256).alias("original_checksum"),
        policy.strategy_name(F.col("entity_type"), F.col("context") if context else None).alias("strategy_used"), (F.col("text") if keep_original else F.lit(None).cast("string")).alias("original_text"),
    )


def numbered(found: DataFrame) -> DataFrame:
    """Detected entities (doc_id, node_id, start, ...) as anchors to be masked: numbered ids within a document."""
    w = Window.partitionBy("doc_id").orderBy("node_id", "start", "end", "entity_type")
    return found.withColumn("replacement_id", F.concat(F.lit("repl_"), F.lpad(F.row_number().over(w).cast("string"), 6, "0"))).withColumn("masked_value", F.lit("[DETECTED]"))


def placeholder(kind: Column) -> Column:
    """What stands for an original that is not known."""
    return F.concat(F.lit("["), kind, F.lit("]"))


def originals(kept: DataFrame, vault: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    """Anchors with original: their own, that of the vault (replacement_id, original), what the policy's keys turn back, or a
    placeholder."""
    if vault is not None:
        kept = kept.join(vault.select("replacement_id", F.col("original").alias("_vault")), "replacement_id", "left")
    turned = [policy.turned_back(F.col("entity_type"), F.col("masked_value"), F.col("context") if "context" in kept.columns else F.lit("paragraph"))] if policy is not None else []
    known = [F.col("original_text"), *([F.col("_vault")] if vault is not None else []), *turned, placeholder(F.col("entity_type"))]
    return kept.withColumn("original", F.coalesce(*known)).drop("_vault")


def unmask(masked: DataFrame, kept: DataFrame, vault: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    """masked (doc_id, node_id, masked_text) with restored_text, by the masked places of the anchors.

    Nodes without anchors keep their text.  policy: that of the masking, for strategies that a key turns back."""
    rows = originals(kept, vault, policy)
    at = F.array_sort(F.collect_list(F.struct(F.col("masked_start").alias("start"), F.col("masked_end").alias("end"), "original")))
    grouped = rows.groupBy("doc_id", "node_id").agg(at.alias("_a"))
    joined = masked.join(grouped, ["doc_id", "node_id"], "left")
    none = F.array().cast("array<struct<start:int,end:int,original:string>>")
    joined = joined.withColumn("_a", F.coalesce("_a", none))
    return joined.withColumn("restored_text", splice(F.col("masked_text"), F.col("_a"), "original")).drop("_a")


def unmask_rows(masked: DataFrame) -> DataFrame:
    """masked, whose rows still carry their spans, with restored_text; narrow: no join, nothing is detected again."""
    at = F.transform("spans", lambda s: F.struct(s["masked_start"].alias("start"), s["masked_end"].alias("end"), s["text"].alias("original")))
    return masked.withColumn("_a", at).withColumn("restored_text", splice(F.col("masked_text"), F.col("_a"), "original")).drop("_a")


def resolve_anchors(masked: DataFrame, kept: DataFrame, window: int = WINDOW, reach: int = REACH, shifted: bool = True, all_places: bool = False) -> DataFrame:
    """Anchors with found (place in an edited masked text or null), delta, found_confidence and reason.

    The expected place, 1.0; else the nearest within `window` (1 - delta / 100); else the nearest occurrence within
    `reach` (0.8 of that); below 0.5 the anchor fails.  A value of asterisks is only found where the run of asterisks has
    its length.  shifted: the expected place counts the masks before it; without, the anchors' own places hold.
    all_places: with places, all that are sure enough, and the expected one."""
    before = F.sum(F.char_length("masked_value") - F.col("end") + F.col("start")).over(Window.partitionBy("doc_id", "node_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.coalesce(before, F.lit(0)) if shifted else F.lit(0)
    rows = kept.withColumn("expected", (F.col("start") + shift).cast("int")).join(masked.select("doc_id", "node_id", "masked_text"), ["doc_id", "node_id"], "left")
    value, n, size = F.col("masked_value"), F.char_length("masked_value"), F.char_length("masked_text")
    lo = F.greatest(F.col("expected") - reach, F.lit(0))
    hi = F.least(F.col("expected") + reach, size - n)
    # the part of the text in question is cut out once, with a character on either side
    rows = rows.withColumns({"_n": n, "_lo": lo, "_hi": hi, "_pad": F.when(lo > 0, 1).otherwise(0), "_cut": F.substring("masked_text", F.greatest(lo - 1, F.lit(0)) + 1, hi - lo + n + 2)})
    at = lambda i: i - F.col("_lo") + F.col("_pad")
    char = lambda place: F.when(place >= 0, F.substring("_cut", place + 1, F.lit(1))).otherwise(F.lit(""))
    isolated = lambda i: ~value.rlike(r"^\*+$") | ((char(at(i) - 1) != "*") & (char(at(i) + F.col("_n")) != "*"))
    places = F.when((F.col("_hi") >= F.col("_lo")) & (F.col("_n") > 0), F.sequence("_lo", "_hi")).otherwise(F.array().cast("array<int>"))
    hits = F.filter(places, lambda i: (F.substring("_cut", at(i) + 1, F.col("_n")) == value) & (isolated(i) | (i == F.col("expected"))))
    best = F.get(F.array_sort(F.transform(hits, lambda i: F.struct(F.abs(i - F.col("expected")).alias("delta"), i.alias("at")))), F.lit(0))
    rows = rows.withColumn("_hits", hits) if all_places else rows
    rows = rows.withColumn("_b", best)
    sure = lambda delta: F.when(delta == 0, 1.0).when(delta <= window, 1 - delta / 100).otherwise((1 - delta / 100) * SEARCHED)
    delta = F.col("_b.delta")
    confidence = sure(delta)
    rows = rows.withColumn("places", F.filter("_hits", lambda i: sure(F.abs(i - F.col("expected"))) >= LEAST)).drop("_hits") if all_places else rows
    rows = rows.withColumns({"delta": delta, "found_confidence": confidence, "found": F.when(confidence >= LEAST, F.col("_b.at"))})
    reason = F.when(F.col("masked_text").isNull(), "node not found").when(F.col("_b").isNull(), "value not found").when(confidence < LEAST, "confidence too low")
    return rows.withColumn("reason", F.when(F.col("found").isNull(), reason)).drop("_b", "_n", "_lo", "_hi", "_pad", "_cut", "masked_text")


def in_order_places(anchors: list[tuple[int, int, list[int]]]) -> list[int | None]:
    """A place for each anchor (expected place, length, places in question), in order and without overlap, or None.

    The places of least cost: what the shift against the expected place changes from one anchor to the next (the first one's
    counts up to UNPLACED), and UNPLACED for an anchor without a place; of equal cost those of more anchors."""
    # shift of the last placed anchor -> (cost, anchors without a place, end of the last placed one, chain of (anchor, place))
    states: dict[int | None, tuple] = {None: (0, 0, 0, None)}
    for k, (at, n, places) in enumerate(anchors):
        after = {shift: (cost + UNPLACED, without + 1, end, chain) for shift, (cost, without, end, chain) in states.items()}
        for place in places:
            for shift, (cost, without, end, chain) in states.items():
                if place >= end:
                    moved = min(abs(place - at), UNPLACED) if shift is None else abs(place - at - shift)
                    new = (cost + moved, without, place + n, (k, place, chain))
                    if place - at not in after or new[:3] < after[place - at][:3]:
                        after[place - at] = new
        states = after
    out: list[int | None] = [None] * len(anchors)
    chain = min(states.values(), key=lambda s: s[:2])[3]
    while chain:
        out[chain[0]], chain = chain[1], chain[2]
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _moved(nodes: pd.Series) -> pd.Series:
    """in_order_places() of the anchors of each node; null: null."""
    return pd.Series([None if a is None else in_order_places([(s["at"], s["n"], list(s["places"] if s["places"] is not None else ())) for s in a]) for a in nodes], dtype=object)


def restore(masked: DataFrame, kept: DataFrame, vault: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(masked with restored_text, the resolved anchors): unmasking of texts that may have been edited since.

    Each anchor is put back where resolve_anchors() finds it.  Where anchors of a node are found at one place, or out of
    their order, as equal masks a few characters apart are after a small shift, all of the node keep their order and take
    a place each (in_order_places())."""
    found = originals(resolve_anchors(masked, kept, all_places=True, **options), vault)
    length = F.char_length("masked_value")
    one = F.struct("start", "entity_type", F.col("expected").alias("at"), "found", length.alias("n"), "places", F.col("found_confidence").alias("confidence"), F.col("original").alias("text"))
    grouped = found.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    hit = F.filter("_all", lambda s: s["found"].isNotNull())
    ends = F.transform(hit, lambda s: s["found"] + s["n"])
    crossed = F.exists(F.zip_with(F.slice(hit, 2, F.greatest(F.size(hit), F.lit(1))), ends, lambda s, end: s["found"] < end), lambda x: F.coalesce(x, F.lit(False)))
    grouped = grouped.withColumn("_moved", _moved(F.when(crossed, F.transform("_all", lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), s["places"].alias("places"))))))
    placed = F.when(F.col("_moved").isNull(), F.col("_all")).otherwise(F.zip_with("_all", "_moved", lambda s, to: s.withField("found", to)))
    spans = F.transform(F.filter(placed, lambda s: s["found"].isNotNull()), lambda s: F.struct(s["entity_type"].alias("entity_type"), s["found"].alias("start"), (s["found"] + s["n"]).alias("end"), s["confidence"].alias("confidence"), s["text"].alias("text")))
    grouped = grouped.select("doc_id", "node_id", spans.alias("_a"))
    found = found.drop("places")
    joined = masked.join(grouped, ["doc_id", "node_id"], "left").withColumn("_a", RESOLVERS["sure_and_long"](F.coalesce("_a", F.array().cast(grouped.schema["_a"].dataType))))
    return joined.withColumn("restored_text", splice(F.col("masked_text"), F.col("_a"), "text")).drop("_a"), found


def resolution_statistics(found: DataFrame, *by: str) -> DataFrame:
    """Of resolved anchors: how many, found, by confidence, and how far they moved."""
    c, moved = F.col("found_confidence"), F.when(F.col("found").isNotNull(), F.col("delta"))
    share = F.count("found") / F.count(F.lit(1))
    return found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("anchors"), F.count("found").alias("found"), F.round(share, 10).alias("success_rate"),
        F.count(F.when(F.col("found").isNotNull() & (c >= 0.9), 1)).alias("sure"), F.count(F.when(F.col("found").isNotNull() & (c >= 0.7) & (c < 0.9), 1)).alias("likely"), F.count(F.when(F.col("found").isNotNull() & (c < 0.7), 1)).alias("weak"),
        F.round(F.avg(moved), 10).alias("avg_delta"), F.max(moved).alias("max_delta"),
    )


def restoration_statistics(found: DataFrame, *by: str) -> DataFrame:
    """Of resolved anchors: restored, verified by their checksums, the change of length, and failures by reason."""
    ok = F.col("found").isNotNull()
    plain, salted = F.sha2("original_text", 256), F.sha2(F.concat("checksum_salt", "original_text"), 256)
    verified = ok & F.coalesce(F.col("original_checksum").isin(plain, salted), F.lit(False))
    failed = lambda why: F.count(F.when(F.col("reason") == why, 1))
    return found.groupBy(*by).agg(
        F.count(F.lit(1)).alias("anchors"), F.count(F.when(ok, 1)).alias("restored"), F.round(100 * F.count(F.when(ok, 1)) / F.count(F.lit(1)), 10).alias("success_percent"),
        F.count(F.when(verified, 1)).alias("verified"), F.sum(F.when(ok, F.char_length("original_text") - F.char_length("masked_value")).otherwise(0)).cast("long").alias("length_delta"),
        failed("node not found").alias("no_node"), failed("value not found").alias("no_value"), failed("confidence too low").alias("unsure"),
    )


def integrity(found: DataFrame, *by: str) -> DataFrame:
    """One row of `by`: valid, if every anchor was found, and how many were not."""
    return found.groupBy(*by).agg((F.count("found") == F.count(F.lit(1))).alias("valid"), (F.count(F.lit(1)) - F.count("found")).alias("failed"))


def clamped(spans: Column, text: Column, segments: Column) -> Column:
    """Spans of a joined text, cut so that none leaves its segment (segments: array of start, end, in order).

    A span ends before the first empty line in it, and with the segment that holds its start; a span that starts in no
    segment, or is blank then, is left out."""
    begun = lambda s: F.get(segments, last_at_most(F.size(segments), lambda i: F.get(segments, i)["start"], s["start"]))
    own = lambda s: let(begun(s), lambda g: F.when(s["start"] < g["end"], g))
    inner = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    line = lambda s: F.instr(inner(s), "\n\n")
    end = lambda s: F.least(F.when(line(s) > 0, s["start"] + line(s) - 1).otherwise(s["end"]), own(s)["end"])
    cut = F.transform(F.filter(spans, lambda s: own(s).isNotNull()), lambda s: s.withField("end", end(s).cast("int")))
    cut = F.transform(cut, lambda s: s.withField("text", inner(s)))
    return F.filter(cut, lambda s: s["text"].rlike(r"\S"))


def of_segment(kept: DataFrame, segments: DataFrame) -> DataFrame:
    """Anchors of a whole text (doc_id, start, end) with the segment (node_id, start_offset, end_offset) that holds their
    start, and their places in it; an end beyond the segment is its end."""
    s = segments.select("doc_id", F.col("node_id").alias("segment_id"), "start_offset", "end_offset")
    rows = holding(kept, s, "doc_id", keep=("segment_id",)).filter(F.col("start") < F.col("end_offset"))
    local = (F.col("start") - F.col("start_offset")).alias("local_start")
    return rows.select(*kept.columns, "segment_id", local, (F.least("end", "end_offset") - F.col("start_offset")).alias("local_end"))


def normalised_types(found: DataFrame) -> DataFrame:
    return found.withColumn("entity_type", entity_type(F.col("entity_type")))
