"""Secrets: base patterns, and the ownership of each value over the whole corpus.

Base spans are the matches of three fixed patterns.  Beside them a text's bare candidates are taken: maximal runs of the
characters of keys, RUN or longer, with a letter and a digit, outside every match of the assignment pattern and holding
neither a base key nor a base digest.  Each span stands for a value (of an assignment what is assigned), known by its
128-bit hash.

Ownership: the corpus is counted by value: distinct owners, distinct repositories (an owner's groups) and occurrences.
Counting goes value, owner, repository; then value, owner; then value, so each step is a sum that tasks prepare, and a
value that stands in a third of all rows is one row a task and repository.  The verdict of a value:
  example  `widely` owners or more have it, or it holds a word of PLACEHOLDERS, or has fewer than 6 different characters;
  live     one owner has it, and it looks random: RUN characters or more, a letter and a digit, 8 different ones or more;
  unclear  the rest.
The method adds bare candidates that are a copy of a base value with verdict live (with that value's kind), or live
themselves and of the shape of keys: 20 characters or more, 12 different ones, capital and small letters and digits (kind
assign), or 32 or more hexadecimal digits in capitals (kind hex).  Base spans stay, whatever their verdict; those of examples are told apart by the
columns n_example and n_live and by the spans' verdict.

All is DataFrame expressions.  A text is marked by regexp_replace, split at the marks, and places are running sums of the
parts' lengths, so a text costs its length, also with very many spans.  The verdicts meet the documents by the value: the
side of the verdicts is broadcast if its measured size is small, else joined by a shuffle in which Spark splits hot values.

Cases: null or empty text: no spans, counts of 0.  A null owner is one owner of its own, as is a null repository.  Repeated
rows are one owner and repository, but count as occurrences each; they have equal spans.  A null id stays null.  U+FFFF and
U+FFFE, which are no characters, read as U+FFFD.  A base span may lie within one of another kind (a digest that is
assigned); each is reported.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.arrays import let, running_sums

from .common import checked_side, forget, written

# The kinds, in the order of ties, and the base patterns (Java's i takes A-Z and a-z alone).
KINDS = ("assign", "access", "hex")
KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORD + "[\"']?\\x20*+[:=]\\x20*+[\"']?[A-Za-z0-9+/_.=-]++"
VALUE = KEYWORD + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs below these lengths are dropped, and a run that begins inside one is shorter still, so the least length may be asked for.
ACCESS = "AKIA[A-Z0-9]{12,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}+"
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "xxxx", "1234567890", "your_", "your-")
#: Characters of a bare candidate, at least.
RUN = 16
_KEY = "[A-Za-z0-9+/_=-]"
BARE = f"(?<!{_KEY})(?=[A-Za-z+/_=-]*+[0-9]){_KEY}{{{RUN},}}+"
MARK, INNER, INSTEAD = "\uffff", "\ufffe", "\ufffd"
#: Characters of a value that are looked at for how random it is.
LOOKED = 1000
FOUND = "array<struct<kind:int,start:int,end:int,v:string,base:boolean>>"


def _marked(text: Column, pattern: str, mark: str) -> Column:
    return F.regexp_replace(text, f"({pattern})", f"{mark}$1{mark}")


def _none() -> Column:
    return F.array().cast(FOUND)


def _span(kind: int, start: Column, text: Column, value: Column, base: bool) -> Column:
    return F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), (start + F.char_length(text)).cast("int").alias("end"), value.alias("v"), F.lit(base).alias("base"))


def _placed(pieces: Column) -> Column:
    """Pieces of a text (t, kind) with where each begins (s)."""
    sums = running_sums(F.transform(pieces, lambda x: F.char_length(x["t"])))
    return let(sums, lambda s: F.transform(pieces, lambda x, i: F.struct(x["t"].alias("t"), x["kind"].alias("kind"), F.get(s, i).alias("s"))))


def _piece(text: Column, kind: Column) -> Column:
    return F.struct(text.alias("t"), kind.alias("kind"))


def _whole_matches(text: Column, kind: int, pattern: str, needs: str) -> Column:
    """Spans of a pattern whose matches are their own values."""
    pieces = F.transform(F.split(_marked(text, pattern, MARK), MARK, -1), lambda t, i: _piece(t, i % 2))
    spans = let(pieces, lambda p: F.transform(F.filter(_placed(p), lambda x: x["kind"] == 1), lambda x: _span(kind, x["s"], x["t"], x["t"], True)))
    return F.when(text.rlike(needs), spans).otherwise(_none())


def _bare(run: Column) -> Column:
    """Whether a run may be a candidate: a letter, and no base key or digest, which are found already."""
    return run.rlike("[A-Za-z]") & ~run.rlike(ACCESS) & ~run.rlike("[0-9a-f]{32}")


def _assigned_and_bare(text: Column) -> Column:
    """Spans of the assignment pattern, and the bare candidates between its matches (kind 3)."""
    assigned = F.when(text.rlike(f"{KEYWORD}[\"']?\\x20*+[:=]"), _marked(text, ASSIGN, MARK)).otherwise(text)
    cut = lambda gap: F.transform(F.split(_marked(gap, BARE, INNER), INNER, -1), lambda t, i: _piece(t, (i % 2) * 3 + 1))
    # gap, match, gap, ...; each gap again cut into gap (kind 1), run (4), gap, ...
    pieces = F.flatten(F.transform(F.split(assigned, MARK, -1), lambda t, i: F.when(i % 2 == 1, F.array(_piece(t, F.lit(0)))).otherwise(cut(t))))

    def of(x: Column) -> Column:
        value = F.regexp_extract(x["t"], VALUE, 1)
        return F.when((x["kind"] == 0) & (F.char_length(value) >= 8), _span(0, x["s"], x["t"], value, True)).when((x["kind"] == 4) & _bare(x["t"]), _span(3, x["s"], x["t"], x["t"], False))

    return let(pieces, lambda p: F.when(F.size(p) < 2, _none()).otherwise(F.array_compact(F.transform(F.filter(_placed(p), lambda x: x["kind"] != 1), of))))


def _different(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(F.substring(value, 1, LOOKED), "")))


def _looked(s: Column) -> Column:
    """A span with its value's hash and look in place of its text.  shape: the kind that a bare value of this look has."""
    v = s["v"]
    low = F.lower(F.substring(v, 1, LOOKED))
    known = F.lit(False)
    for word in PLACEHOLDERS:
        known = known | F.contains(low, F.lit(word))
    random = (F.char_length(v) >= RUN) & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (_different(v) >= 8)
    shape = F.when((F.char_length(v) >= 20) & (_different(v) >= 12) & v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"), 0).when(v.rlike("^[0-9A-F]{32,}$"), 2)
    return F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.unhex(F.substring(F.sha2(v.cast("binary"), 256), 1, 32)).alias("value"), s["base"].alias("base"),
        (known | (_different(v) < 6)).alias("placeholder"), random.alias("random"), shape.cast("int").alias("shape"),
    )


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """doc_id, key, owner, repository and hits: base spans and bare candidates by start, each with its value's hash and look; narrow.

    key: a hash of id and text, equal for repeated rows."""
    text = F.replace(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(INSTEAD)), F.lit(INNER), F.lit(INSTEAD))
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    repository = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in repository_cols]) if repository_cols else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.xxhash64(F.coalesce(F.col(owner_col).cast("string"), F.lit("\0"))).alias("owner"), repository.alias("repository"), text.alias("t"))
    t = F.col("t")
    all_ = F.concat(_assigned_and_bare(t), _whole_matches(t, 1, ACCESS, "AKIA[A-Z0-9]"), _whole_matches(t, 2, HEX, "[0-9a-f]{32}"))
    return rows.select("doc_id", "key", "owner", "repository", F.array_sort(F.transform(all_, _looked)).alias("hits"))


def ownership(found: DataFrame, widely: int = 3) -> DataFrame:
    """value, owners, repositories, occurrences, verdict, kind: every value with how far it is copied.

    kind: that of the base spans which hold it (the first of KINDS), or null where only bare candidates do; shape: as a
    bare candidate's look says."""
    hits = found.select("owner", "repository", F.explode("hits").alias("h")).select("owner", "repository", "h.*")
    look = [F.min(F.when(F.col("base"), F.col("kind"))).alias("kind"), F.max("placeholder").alias("placeholder"), F.max("random").alias("random"), F.min("shape").alias("shape")]
    again = [F.min("kind").alias("kind"), F.max("placeholder").alias("placeholder"), F.max("random").alias("random"), F.min("shape").alias("shape")]
    by_repository = hits.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"), *look)
    by_owner = by_repository.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"), *again)
    by_value = by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences"), *again)
    verdict = F.when((F.col("owners") >= widely) | F.col("placeholder"), "example").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("unclear")
    return by_value.select("value", "owners", "repositories", "occurrences", verdict.alias("verdict"), "kind", "shape")


def find(docs: DataFrame, widely: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """doc_id, base and spans (in order; kind number, start, end, base, verdict, owners, repositories) of every row."""
    found = written(extract(docs, id_col, text_col, owner_col, repository_cols))
    known = written(ownership(found, widely).filter("kind is not null or (verdict = 'live' and shape is not null)"))
    # repeated rows have equal spans: one of each, before they meet their values
    hits = found.select("key", F.explode("hits").alias("h")).select("key", "h.start", "h.kind", "h.end", "h.base", "h.value").distinct()
    side = checked_side(known.withColumnRenamed("kind", "of"), F.lit(64))
    added = F.when(F.col("verdict") == "live", F.coalesce("of", "shape"))
    met = hits.join(side, "value").withColumn("kind", F.when(F.col("base"), F.col("kind")).otherwise(added)).filter("kind is not null")
    lists = written(met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base", "verdict", "owners", "repositories"))).alias("spans")))
    forget(known)
    rows = found.select("doc_id", "key", F.transform(F.filter("hits", lambda h: h["base"]), lambda h: F.struct(h["start"], h["kind"], h["end"])).alias("base"))
    out = rows.join(checked_side(lists, 64 * F.size("spans")), "key", "left")
    return out.select("doc_id", "base", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,verdict:string,owners:bigint,repositories:bigint>>")).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts and hash of the base spans, all spans as text, and how many are live or examples."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda a, field, value: F.size(F.filter(a, lambda s: s[field] == value)).cast("long")
    counts = [count("base", "kind", k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    told = [count("spans", "verdict", v).alias(f"n_{v}") for v in ("live", "example")]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), count("spans", "base", False).alias("n_added"), *told)
