"""Personal data: base patterns, and identifiers that bootstrapped contextual patterns add.

Base spans are the matches of four fixed patterns.  They are the seeds of the bootstrapping: the words around a seed
form lexical patterns, and the same patterns elsewhere in the corpus surround instances that no base pattern knows.
Patterns and instances form a graph.  In each round Spark scores a pattern by the share of its instances' occurrences
that are believed to be of its kind, and an instance by the best pattern that holds it, times how well its coarse shape
fits the kind; seeds are believed throughout.  Patterns of high confidence and support then mark their instances.

A text is cut into units: its base spans, and the words between them.  An instance is a base span, or a word holding a
digit or an @, without outer punctuation, or numbers in a row with single blanks between.  Its patterns are contexts
alone: two units before and one after, two before, one before and one after; digits in them count as one, and addresses
as @.  Words of any length count: in patterns and in the graph, those above LONG characters stand as a digest.

The coarse shape of an instance is whether it holds an @, whether it holds letters, and if its digits are under 3, under 7
or more.  It fits a kind by the mean of the shares of the kind's different seeds that agree in each of the three.

The graph is counted by (pattern, instance) with a map-side combine, so a hot pattern or instance is one row a task.
Patterns that pass meet the instances by a join on the pattern, whose smaller side is a written table, so Spark can
broadcast it where it is small and split a hot pattern where it is not; nothing but the table of shapes (a row a kind and
shape) comes to the driver.  All steps are linear in the length of a text.

Cases: null or empty text: no spans.  Repeated rows are separate documents in the counts, and have equal spans.  An added
span never overlaps a base span or another added one; of those that overlap the first, then the longest is taken.
Without seeds nothing is added.  Words without digit or @ are never instances.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checked_side, column, forget, slices, written

# The kinds, in the order of ties, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(WORD)
_MARK = re.compile(r"[0-9@]")
_OUTER = ".,;:!?\"'()[]{}<>=&$%#*|"
_NUMBER = re.compile(r"\+?[0-9](?:[0-9()./-]*[0-9])?")
_JOIN = re.compile(r"\)?\x20\(?")
_CONTEXT_DIGITS = re.compile(r"[0-9]+")
#: Characters from which a word of a pattern, or an instance, is held as a digest.
LONG = 64
SPANS = "array<struct<kind:int,start:int,end:int>>"
FOUND = f"doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base {SPANS}, hits array<struct<patterns:array<string>,instance:string,shape:string,kind:int,start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns' matches that pass their checks, by start, then kind."""
    out = []
    if not text:
        return out
    if "@" in text:
        done = 0
        for m in EMAIL_TAIL.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in EMAIL_HEAD:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    if _DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((3, m.start(), m.end()))
    out.sort(key=lambda s: (s[1], s[0]))
    return out


def contexts(text: str | None, base: list[tuple[int, int, int]] | None = None) -> list[tuple[list[str], str, str, int | None, int, int]]:
    """(patterns, instance, shape, kind of the base span or None, start, end) of every instance of a text."""
    if not text or not _MARK.search(text):
        return []
    units, at = [], 0  # (start, end, kind or None)
    for kind, start, end in base_spans(text) if base is None else base:
        if start >= at:
            units += [(m.start(), m.end(), None) for m in _WORD.finditer(text, at, start)]
            units.append((start, end, kind))
        at = max(at, end)
    units += [(m.start(), m.end(), None) for m in _WORD.finditer(text, at)]
    plains: dict[int, str] = {}

    def plain(i: int) -> str:
        if not 0 <= i < len(units):
            return ""
        if i not in plains:
            a, b, kind = units[i]
            plains[i] = _plain(text[a:b]) if kind is None else "@" if kind == 0 else "0"
        return plains[i]

    out = []

    def add(first: int, last: int, kind: int | None, start: int, end: int) -> None:
        before = [plain(first - 2), plain(first - 1)]
        if start and text[start - 1].strip(_OUTER) and not text[start - 1].isspace():
            before[1] += "\x1e"  # the word goes on without a blank
        kinds = (("3", *before, plain(last + 1)), ("2", *before), ("1", before[1], plain(last + 1)))
        whole = text[start:end]
        out.append((["\x1f".join(k) for k in kinds if any(k[1:])], _short(whole), coarse(whole), kind, start, end))

    row: list[tuple[int, int, int]] = []  # (unit, start, end) of numbers in a row

    def close() -> None:
        if len(row) > 1:
            start = row[0][1]
            start -= start > 0 and text[start - 1] == "(" and ")" in text[start : row[1][1]]
            add(row[0][0], row[-1][0], None, start, row[-1][2])
        row.clear()

    for i, (a, b, kind) in enumerate(units):
        if kind is not None:
            close()
            add(i, i, kind, a, b)
            continue
        word = text[a:b]
        core = word.strip(_OUTER)
        start = a + len(word) - len(word.lstrip(_OUTER))
        end = start + len(core)
        # what touches a base span is a rest of the same word
        touches = (i and units[i - 1][2] is not None and units[i - 1][1] == start) or (i + 1 < len(units) and units[i + 1][2] is not None and units[i + 1][0] == end)
        if touches or not _MARK.search(core):
            close()
            continue
        add(i, i, None, start, end)
        if not _NUMBER.fullmatch(core):
            close()
            continue
        if row and not _JOIN.fullmatch(text[row[-1][2] : start]):
            close()
        row.append((i, start, end))
    close()
    return out


def _short(word: str) -> str:
    return word if len(word) <= LONG else "#" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def coarse(instance: str) -> str:
    """Three letters: @ or not, letters or not, few, some or many digits."""
    n = sum(c in "0123456789" for c in instance)
    return ("@" if "@" in instance else "-") + ("a" if any(map(str.isalpha, instance)) else "-") + ("0" if n < 3 else "3" if n < 7 else "7")


def _plain(word: str) -> str:
    """A word of a context: lower-cased, without outer punctuation if more is there, each run of digits as one."""
    return "@" if "@" in word else _short(_CONTEXT_DIGITS.sub("0", (word.strip(_OUTER) or word).lower()))


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_HIT = pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.string()), ("shape", pa.string()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def _columns(texts: list) -> list[pa.Array]:
    """The columns of FOUND after doc_id and key."""
    base = [base_spans(t) for t in texts]
    hits = [contexts(t, b) for t, b in zip(texts, base, strict=True)]
    dicts = lambda rows, kind: pa.array([[dict(zip(kind.names, x, strict=True)) for x in r] for r in rows], pa.list_(kind))
    counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(4)]
    return [*counts, dicts(base, _SPAN), dicts(hits, _HIT)]


_NAMES = ["doc_id", "key", *[f"n_{k}" for k in KINDS], "base", "hits"]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of a row's id and text, never null; rows that repeat have the same, and the same spans."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FOUND: each document's base spans and the contexts of its instances; narrow."""

    def run(batches):
        for batch in slices(batches, 250):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *_columns(column(batch, "text"))], _NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key")).mapInArrow(run, FOUND)


def fits(graph: DataFrame) -> dict[tuple[int, str], float]:
    """(kind, coarse shape) -> how well the shape fits the kind, from the different seeds of the graph."""
    seeds = graph.filter("seeds > 0").select("instance", "shape", "seed").distinct().groupBy("seed", "shape").count().collect()  # a row a kind and shape
    out = {}
    for kind in {r["seed"] for r in seeds}:
        own = [(r["shape"], r["count"]) for r in seeds if r["seed"] == kind]
        total = sum(n for _, n in own)
        for shape in (a + b + c for a in "@-" for b in "a-" for c in "037"):
            out[kind, shape] = sum(n for s, n in own for i in range(3) if s[i] == shape[i]) / (3 * total)
    return out


def bootstrap(found: DataFrame, rounds: int = 2, min_confidence: float = 0.8, min_support: int = 3, hold_back: int = 0) -> tuple[DataFrame, dict[tuple[int, str], float]]:
    """(pattern, kind, confidence: the patterns of high confidence, after `rounds` rounds over the graph; fits()).

    An occurrence is a seed of kind k when it is a base span of that kind.  Support is the number of different
    instances believed (at least min_confidence) that the pattern holds.  hold_back: of so many different instances one is no seed."""
    kind = F.when(~held_back(F.col("h.instance"), hold_back), F.col("h.kind")) if hold_back else F.col("h.kind")
    hits = found.select(F.explode("hits").alias("h")).select(F.explode("h.patterns").alias("pattern"), "h.instance", "h.shape", kind.alias("kind"))
    graph = hits.groupBy("pattern", "instance", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("seeds"), F.min("kind").alias("seed"))
    # Only patterns that hold a seed or meet an instance of one can ever be scored, but all their occurrences count.
    graph = written(graph)
    fit = fits(graph)
    pairs = [F.lit(x) for (k, s), v in fit.items() for x in (f"{k}{s}", v)]
    fit_of = F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat(F.col("kind").cast("string"), "shape")), F.lit(0.0)) if pairs else F.lit(0.0)
    belief = written(graph.filter("seeds > 0").groupBy("instance").agg(F.min("seed").alias("kind"), F.lit(1.0).alias("belief")))  # a table, so that the join can split a hot instance
    patterns = None
    for number in range(rounds):
        edges = graph.join(belief, "instance", "left")
        by_kind = edges.filter("kind is not null").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("mass"), F.count(F.when(F.col("belief") >= min_confidence, 1)).alias("support"))
        best = by_kind.groupBy("pattern").agg(F.max(F.struct("mass", "support", (-F.col("kind")).alias("k"))).alias("b")).select("pattern", F.col("b.mass").alias("mass"), F.col("b.support").alias("support"), (-F.col("b.k")).alias("kind"))
        whole = graph.groupBy("pattern").agg(F.sum("n").alias("all"))
        patterns = best.join(whole, "pattern").withColumn("confidence", F.col("mass") / F.col("all"))
        patterns = patterns.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support))
        patterns = written(patterns.select("pattern", F.col("kind").cast("int").alias("kind"), "confidence"))
        if number + 1 == rounds:
            break
        grown = graph.join(patterns, "pattern").withColumn("score", F.col("confidence") * fit_of).groupBy("instance").agg(F.max(F.struct(F.col("score").alias("belief"), (-F.col("kind")).alias("k"))).alias("b")).select("instance", (-F.col("b.k")).alias("kind"), F.col("b.belief").alias("belief"))
        both = belief.unionByName(grown).groupBy("instance").agg(F.max(F.struct("belief", (-F.col("kind")).alias("k"))).alias("b"))
        belief = written(both.select("instance", (-F.col("b.k")).cast("int").alias("kind"), F.col("b.belief").alias("belief")))
    forget(graph)
    return patterns, fit


def held_back(instance: Column, of: int) -> Column:
    return F.pmod(F.xxhash64(instance), F.lit(of)) == 0


def fit_of(fit: dict[tuple[int, str], float]) -> Column:
    """The fit of the columns kind and shape."""
    pairs = [F.lit(x) for (k, s), v in fit.items() for x in (f"{k}{s}", v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat(F.col("kind").cast("string"), "shape")), F.lit(0.0)) if pairs else F.lit(0.0)


def scored(hits: DataFrame, patterns: DataFrame, fit: dict[tuple[int, str], float], *by: str) -> DataFrame:
    """by, kind, score: the best score of each hit (columns by, shape, patterns) that a known pattern holds."""
    met = hits.select(*by, "shape", F.explode("patterns").alias("pattern")).join(patterns, "pattern").withColumn("score", F.col("confidence") * fit_of(fit))
    best = met.groupBy(*by).agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    return best.select(*by, (-F.col("b.k")).cast("int").alias("kind"), F.col("b.score").alias("score"))


def additions(found: DataFrame, patterns: DataFrame, fit: dict[tuple[int, str], float], min_score: float) -> DataFrame:
    """key, added: the spans that patterns add to the documents of a key, disjoint and in order; only where there are any."""
    hits = found.select("key", F.explode("hits").alias("h")).filter("h.kind is null").select("key", "h.shape", "h.patterns", "h.start", "h.end")
    best = scored(hits, patterns, fit, "key", "start", "end").filter(F.col("score") >= min_score)
    lists = best.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))

    def disjoint(batches):
        for batch in slices(batches):
            rows = []
            for spans in column(batch, "added"):
                out, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
                    if s["start"] >= at:
                        out.append(s)
                        at = s["end"]
                rows.append(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], ["key", "added"])

    return lists.mapInArrow(disjoint, f"key long, added {SPANS}")


def learned_additions(docs: DataFrame, rounds: int = 2, min_confidence: float = 0.8, min_support: int = 3, min_score: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(FOUND rows of docs, additions()), both written tables.

    An instance is added when the confidence of one of its patterns times the fit of its shape is at least min_score."""
    found = written(extract(docs, id_col, text_col))
    patterns, fit = bootstrap(found, rounds, min_confidence, min_support)
    added = written(additions(found, patterns, fit, min_score))
    forget(patterns)
    return found, added


def side_of(added: DataFrame) -> DataFrame:
    return checked_side(added, F.lit(16) * F.size("added"))


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email .. n_phone (of the base spans), base and spans: arrays of (kind number, start, end)."""
    found, added = learned_additions(docs, **options)
    rows = found.select("doc_id", "key", *[f"n_{k}" for k in KINDS], "base").join(side_of(added), "key", "left").drop("key")
    span = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    order = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), span)
    return rows.withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(order(F.concat("base", "added")))).drop("added")


def recall_of_held_back(docs: DataFrame, of: int = 5, rounds: int = 2, min_confidence: float = 0.8, min_support: int = 3, min_score: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """kind, n, found: of the occurrences of base spans that were held back as seeds (one of `of` different instances),
    how many the contextual patterns alone find with their kind."""
    found = written(extract(docs, id_col, text_col))
    patterns, fit = bootstrap(found, rounds, min_confidence, min_support, of)
    hits = found.select(F.monotonically_increasing_id().alias("row"), F.explode("hits").alias("h")).filter(F.col("h.kind").isNotNull() & held_back(F.col("h.instance"), of))
    hits = written(hits.select("row", "h.start", F.col("h.kind").alias("true"), "h.shape", "h.patterns"))
    best = scored(hits, patterns, fit, "row", "start").filter(F.col("score") >= min_score).select("row", "start", F.col("kind").alias("got"))
    both = hits.join(best, ["row", "start"], "left")
    return both.groupBy(F.col("true").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("got") == F.col("true"), 1)).alias("found"))


def masked(docs: DataFrame, added: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each base span and each added one replaced by its kind in brackets; overlapping spans as one."""
    names = docs.columns
    place = names.index(text_col)
    side = side_of(added).select(F.col("key").alias("_key"), F.col("added").alias("_added"))
    rows = docs.withColumn("_key", row_key(id_col, text_col)).join(side, "_key", "left").select(*names, "_added")

    def mask(text: str | None, more: list | None) -> str | None:
        spans = sorted(((a, k, b) for k, a, b in [*base_spans(text), *((s["kind"], s["start"], s["end"]) for s in more or ())]))
        out, at = [], 0
        for start, kind, end in spans:
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
        return "".join([*out, text[at:]]) if spans else text

    def run(batches):
        for batch in slices(batches, 250):
            texts = [mask(*x) for x in zip(batch.column(place).to_pylist(), column(batch, "_added"), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, the hash of the base spans, all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
