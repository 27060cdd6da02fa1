"""Overlap resolution over span arrays (in a row) and over entity rows (windows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.arrays import exploded, kept_in_order, let, running_max

from .detect import SPAN, in_order

# How specific the types are.
CRITICAL = ("US_SSN", "CREDIT_CARD", "US_PASSPORT", "US_DRIVER_LICENSE")
HIGH = ("PHONE_NUMBER", "EMAIL_ADDRESS", "IBAN_CODE", "US_BANK_NUMBER")
MEDIUM = ("PERSON", "LOCATION", "ORGANIZATION", "NRP")
LOW = ("URL", "IP_ADDRESS", "DATE_TIME", "MEDICAL_LICENSE")
PRIORITY = {name: rank for rank, names in enumerate((CRITICAL, HIGH, MEDIUM, LOW), 1) for name in names}
DEFAULT_PRIORITY = 3
#: Distance up to which entities belong together, and the confidence from which all are kept.
GAP, SURE = 4, 0.95


def sorted_by(spans: Column, *keys) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*[k(s).alias(f"k{i}") for i, k in enumerate(keys)], s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def kept_in_turn(spans: Column) -> Column:
    """Spans in the order given, each kept if it is disjoint from all kept before; by start.

    Spans are cut into islands, which no span of another one overlaps, and settled island by island: the cost grows with the
    spans, and with the square of an island's only."""
    empty = F.array().cast(f"array<{SPAN}>")
    apart = lambda a, x: ~F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("rank"), s.alias("s"))))

    def settled(island: Column) -> Column:
        turns = F.array_sort(F.transform(island, lambda x: F.struct(x["rank"].alias("rank"), x["s"].alias("s"))))
        kept = F.aggregate(turns, empty, lambda a, x: F.when(apart(a, x["s"]), F.concat(a, F.array(x["s"]))).otherwise(a))
        return F.when(F.size(island) == 1, F.transform(island, lambda x: x["s"])).otherwise(kept)

    def of(a: Column) -> Column:
        heads = let(running_max(F.transform(a, lambda x: x["end"])), lambda reach: F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i)["start"] >= F.get(reach, i)))
        cut = let(heads, lambda h: F.transform(h, lambda x, k: F.slice(a, x + 1, F.coalesce(F.get(h, k + 1), F.size(a)) - x)))
        return F.when(F.size(a) == 0, empty).otherwise(F.flatten(F.transform(cut, settled)))

    return in_order(let(ranked, of))


def swept(spans: Column) -> Column:
    """Spans in the order given, each kept if it starts at or after the end of the last one kept."""
    return kept_in_order(spans)


def greedy(spans: Column) -> Column:
    """By start, then score, then length, swept."""
    return swept(sorted_by(spans, lambda s: s["start"], lambda s: -s["confidence"], lambda s: s["start"] - s["end"]))


def start_and_score(spans: Column) -> Column:
    """By start, then score, swept."""
    return swept(sorted_by(spans, lambda s: s["start"], lambda s: -s["confidence"]))


def score_first(spans: Column) -> Column:
    return kept_in_turn(sorted_by(spans, lambda s: -s["confidence"], lambda s: s["start"]))


def longest_first(spans: Column) -> Column:
    return kept_in_turn(sorted_by(spans, lambda s: s["start"] - s["end"], lambda s: s["start"]))


def priority(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), kind), F.lit(DEFAULT_PRIORITY))


def most_specific(spans: Column) -> Column:
    return kept_in_turn(sorted_by(spans, lambda s: priority(s["entity_type"]), lambda s: -s["confidence"], lambda s: s["start"]))


def first_detected(spans: Column) -> Column:
    return kept_in_turn(sorted_by(spans, lambda s: s["start"], lambda s: s["end"]))


def sure_and_long(spans: Column) -> Column:
    """By score, length, start: how conflicts of anchors are settled."""
    return kept_in_turn(sorted_by(spans, lambda s: -s["confidence"], lambda s: s["start"] - s["end"], lambda s: s["start"]))


RESOLVERS = {"greedy": greedy, "start_and_score": start_and_score, "score_first": score_first, "longest": longest_first, "most_specific": most_specific, "first": first_detected, "sure_and_long": sure_and_long}


def conflicting(spans: Column) -> Column:
    """Whether any two spans of a row overlap."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(-1).alias("end"), F.lit(False).alias("bad"))
    return F.aggregate(ordered, start, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["bad"] | (s["start"] < a["end"])).alias("bad")), lambda a: a["bad"])


def rejecting(nodes: DataFrame) -> DataFrame:
    """nodes; a row whose spans overlap raises, for callers that resolve nothing."""
    fault = F.raise_error(F.lit("entities overlap"))
    return nodes.withColumn("spans", F.when(conflicting(F.col("spans")), fault.cast(f"array<{SPAN}>")).otherwise(F.col("spans")))


def islands(entities: DataFrame, *by: str, gap: int = GAP) -> DataFrame:
    """entities with island: groups that overlap or lie at most `gap` apart, numbered from 0."""
    w = Window.partitionBy(*by).orderBy("start", "end", "entity_type")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(F.col("start") > reach + gap, 1).otherwise(0)
    return entities.withColumn("_o", opened).withColumn("island", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def highest_confidence(entities: DataFrame, *by: str, keep: float = SURE) -> DataFrame:
    """Of each island all entities of at least `keep`, else the best one."""
    w = Window.partitionBy(*by, "island")
    ranked = islands(entities, *by).withColumn("_n", F.count(F.when(F.col("confidence") >= keep, 1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("confidence"), "start", "end", "entity_type")))
    return ranked.filter(F.when(F.col("_n") > 0, F.col("confidence") >= keep).otherwise(F.col("_r") == 1)).drop("_n", "_r")


def merge_adjacent(entities: DataFrame, *by: str, gap: int = GAP) -> DataFrame:
    """One entity for each island of a type: outer bounds, the highest confidence, and the texts in order."""
    keys = (*by, "entity_type")
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), lambda x: x["text"]), "").alias("text")] if "text" in entities.columns else []
    return islands(entities, *keys, gap=gap).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("parts"), *text)


def normalised(entities: DataFrame, *by: str, how: str = "highest_confidence", gap: int = GAP) -> tuple[DataFrame, DataFrame]:
    """(entities after conflicts are settled island by island, counts: entities, groups, conflicts, kept).

    how: highest_confidence, merge_adjacent, or a name of RESOLVERS."""
    if how == "highest_confidence":
        out = highest_confidence(entities, *by).drop("island")
    elif how == "merge_adjacent":
        out = merge_adjacent(entities, *by, gap=gap).drop("island", "parts")
    else:
        spans = F.collect_list(F.struct("entity_type", "start", "end", "confidence", "text").cast(SPAN))
        grouped = islands(entities, *by, gap=gap).groupBy(*by, "island").agg(spans.alias("s"))
        out = exploded(grouped, RESOLVERS[how](F.col("s")), *by).select(*by, "s.*")
    sizes = islands(entities, *by, gap=gap).groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n"))
    both = sizes.select("n", F.lit(0).alias("kept")).unionByName(out.select(F.lit(0).alias("n"), F.lit(1).alias("kept")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = both.agg(total("n").alias("entities"), F.count(F.when(F.col("n") > 0, 1)).alias("groups"), F.count(F.when(F.col("n") > 1, 1)).alias("conflicts"), total("kept").alias("kept"))
    return out, counts


def normalisation_faults(before: DataFrame, after: DataFrame, *by: str, keep: float = SURE) -> DataFrame:
    """Rows that break what normalisation promises: by, start, end, fault ("overlap", or "lost": a sure entity that no
    kept one covers)."""
    kept = after.select(*by, "start", "end", F.lit(0).alias("_sure"))
    return _faults(kept.unionByName(before.filter(F.col("confidence") >= keep).select(*by, "start", "end", F.lit(1).alias("_sure"))), *by)


def faults_of_spans(found: DataFrame, how: str, *by: str, keep: float = SURE) -> DataFrame:
    """normalisation_faults() of rows with spans whose spans a name of RESOLVERS settles row by row; they are read once."""
    mark = lambda sure: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(sure).alias("_sure"))
    both = F.concat(F.transform(RESOLVERS[how](F.col("spans")), mark(0)), F.transform(F.filter("spans", lambda s: s["confidence"] >= keep), mark(1)))
    return _faults(exploded(found, both, *by).select(*by, "s.*"), *by)


def _faults(both: DataFrame, *by: str) -> DataFrame:
    """by, start, end, fault of kept entities (_sure 0) and sure ones (1), by one window.

    Before a sure entity lie all kept ones that start no later, and equal sure ones side by side."""
    order = Window.partitionBy(*by).orderBy("start", "_sure", "end")
    own = F.struct("start", "_sure", "end")
    farthest = F.max(F.when(F.col("_sure") == 0, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = both.withColumns({"_r": farthest, "_again": F.coalesce(F.lag(own).over(order) == own, F.lit(False))})
    overlap = (F.col("_sure") == 0) & F.coalesce(F.col("start") < F.col("_r"), F.lit(False))
    lost = (F.col("_sure") == 1) & ~F.col("_again") & ~F.coalesce(F.col("_r") >= F.col("end"), F.lit(False))
    return rows.filter(overlap | lost).select(*by, "start", "end", F.when(overlap, F.lit("overlap")).otherwise(F.lit("lost")).alias("fault"))
