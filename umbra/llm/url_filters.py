"""URL filters: explicit host/path rules, then association rules mined from the rules' own verdicts.

The rule list labels every url that one of its rules fits.  FP-growth mines the token combinations of labelled urls
together with their label; combinations that imply a label with enough support and confidence become learned rules,
if they say more than the label's share among all labelled urls does: of what is missing from that share to certainty
their confidence must make up `min_certainty`.
An inverted index files each learned rule under its rarest token; a url is looked up by its tokens, and a rule found
that way is accepted when all its other tokens are among the url's.  Everything is DataFrame operations.

A url has one token for each of a fixed set of slots (below), whatever its length, so a transaction has at most
len(SLOTS) items, and the mining cannot explode on long urls.

Cases: null url or no "://": host and path empty, and tokens still exist (empty host), so such rows get the method's
verdict like any other.  Repeated rows are each judged.  With no labelled url or no learned rule that fits, the
verdict is `default`.  Extra columns of the input are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_side, forget, written

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Learned rules up to this number are broadcast (a few MB); more are joined by a shuffle.
BROADCAST_RULES = 20_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # the longest is outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """One token a slot: scheme, top domain, domain, host, first two path segments, extension, first query key."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    at = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)), F.lit(""))
    slots = {
        "scheme": F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^([^:]*)://", 1),
        "top": at(labels, -1),
        "domain": F.concat_ws(".", at(labels, -2), at(labels, -1)),
        "host": host,
        "first": at(segments, 1),
        "second": at(segments, 2),
        "ext": F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1),
        "key": F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^=&#]*)", 1),
    }
    return F.array_compact(F.array(*[F.when(v != "", F.concat(F.lit(k + "="), v)) for k, v in slots.items()]))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_certainty: float = 0.25) -> DataFrame:
    """Learned rules of labelled (tokens, verdict): rule_id, tokens (sorted), verdict, confidence, support, rarest.

    Transactions are first counted by their tokens and label with a map-side combine only inside FP-growth itself;
    items below the support never enter a tree, and items go to conditional trees dealt by item group.
    A rule that a shorter one of the same verdict and at least its confidence covers is pruned.
    """
    items = labelled.select(F.concat(F.col("tokens"), F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = (
        model.associationRules.filter(F.col("consequent")[0].startswith("verdict="))
        .filter(~F.exists("antecedent", lambda x: x.startswith("verdict=")))
        # confidence / lift is the share of the label
        .filter(F.col("confidence") - F.col("confidence") / F.col("lift") >= F.lit(min_certainty) * (1 - F.col("confidence") / F.col("lift")))
        .filter("lift > 1")
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 9, 1000).alias("verdict"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
    )
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    parts = rules.select("*", F.explode("tokens").alias("token")).join(single, "token")
    rarest = parts.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("rarest"))
    return rarest.withColumn("rule_id", F.sha2(F.concat_ws("\x01", "verdict", "tokens"), 256))


def pruned(rules: DataFrame) -> DataFrame:
    """Rules without those that a shorter rule of the same verdict, one token less, covers with no less confidence."""
    less = rules.select(F.col("verdict"), F.col("tokens").alias("of"), F.col("confidence").alias("general"))
    drop = (
        rules.select("rule_id", "verdict", "confidence", F.explode(F.transform("tokens", lambda x: F.array_remove(F.col("tokens"), x))).alias("of"))
        .join(less, ["verdict", "of"])
        .filter(F.col("general") >= F.col("confidence"))
        .select("rule_id")
        .distinct()
    )
    return rules.join(drop, "rule_id", "left_anti")


def match(urls: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """url, learned: the best learned rule of each distinct url that has one (by confidence, support, length, text)."""
    n = rules.count()
    index = rules.withColumnsRenamed({"tokens": "needs"})
    index = F.broadcast(index) if n <= broadcast_rules else index
    hits = (
        urls.select("url", "tokens", F.explode("tokens").alias("rarest"))
        .join(index, "rarest")
        .filter(F.size(F.array_except("needs", "tokens")) == 0)
    )
    best = F.max(F.struct("confidence", "support", F.size("needs").alias("n"), F.concat_ws(" ", "needs").alias("rule"), "verdict"))
    return hits.groupBy("url").agg(best.alias("learned"))


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, min_support: float = 0.002, min_confidence: float = 0.6, min_certainty: float = 0.25, default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict, learned_rule, confidence; one row for each row of pages.

    Columns of pages named like a result column are replaced by it.
    """
    made = ["host", "path", "rule", "verdict", "learned_rule", "confidence", "learned", "_given", "_url"]
    base = pages.drop(*made)
    u = F.col(url)
    judged = base.withColumns({"host": host_of(u), "path": path_of(u)})
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": text, "_given": verdict})
    seen = base.select(u.alias("url"), host_of(u).alias("host"), path_of(u).alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.select("url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), verdict.alias("verdict"))
    labelled = seen.filter("verdict is not null")
    if labelled.isEmpty():
        return judged.withColumns({"verdict": F.lit(default), "learned_rule": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")}).drop("_given")
    learned = written(pruned(mine(labelled, min_support, min_confidence, min_certainty)))
    open_urls = seen.filter("verdict is null").select("url", "tokens").distinct()
    # a table, so that the join can split a hot url; urls with a given verdict, and null, need no join
    best = written(match(open_urls, learned)).withColumnRenamed("url", "_url")
    forget(learned)
    open_rows = judged["_given"].isNull() & judged[url].isNotNull()
    side = checked_side(best, F.octet_length("_url") + F.octet_length("learned.rule"))
    joined = judged.filter(open_rows).join(side, F.col(url) == F.col("_url"), "left").drop("_url")
    out = joined.unionByName(judged.filter(~open_rows).withColumn("learned", F.lit(None).cast(best.schema["learned"].dataType)))
    return out.select(
        *[c for c in base.columns], "host", "path", "rule",
        F.coalesce("_given", F.col("learned.verdict"), F.lit(default)).alias("verdict"),
        F.col("learned.rule").alias("learned_rule"), F.col("learned.confidence").alias("confidence"),
    )
