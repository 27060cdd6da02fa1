"""Span detection by recognizers: a pattern, a score and an optional check, as array expressions.

A pattern runs once over a text: its matches are put between marks, and one split at the marks gives gaps and matches in
turn, whose lengths are the places.  Recognizers of the other form are Python functions, called over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.arrays import exploded, let, running_sums
from umbra.functions.checks import crypto, iban
from umbra.functions.text import default_threshold

SPAN = "struct<entity_type:string,start:int,end:int,confidence:double,text:string>"
#: A character that is never in a Unicode text, set around matches; one that is there all the same becomes U+FFFD.
MARK, INSTEAD = "\uffff", "\ufffd"


#: Between an ASCII word character and anything else; the platform's own takes in letters of other alphabets.
_BOUNDARY = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


@dataclass(frozen=True)
class Recognizer:
    """pattern is read alike by other engines: no look-around.  fast, where given, finds the same and is quicker here.

    first: the characters that a match can begin with, so that other places cost one look.  needs: a text that every match
    holds; texts without it are not searched.  A `\\b` is an ASCII word boundary in both."""

    entity_type: str
    pattern: str
    score: float
    check: Callable[[Column], Column] | None = None
    fast: str | None = None
    first: str | None = None
    needs: str | None = None

    @property
    def here(self) -> str:
        own = (self.fast or self.pattern).replace(r"\b", _BOUNDARY)
        return f"(?=[{self.first}])(?:{own})" if self.first else own


@dataclass(frozen=True)
class FunctionRecognizer:
    """find(text) -> [(start, end, confidence)], for models and dictionaries that no pattern holds."""

    entity_type: str
    find: Callable[[str], list[tuple[int, int, float]]]


@dataclass(frozen=True)
class BatchRecognizer:
    """A model with find_all(texts) -> for each text [(start, end, type, confidence)]: one call an Arrow batch.

    The model is broadcast, so each worker unpacks it once."""

    entity_types: tuple[str, ...]
    model: object

    @property
    def entity_type(self) -> str:
        return self.entity_types[0]


def types_of(r) -> tuple[str, ...]:
    return r.entity_types if isinstance(r, BatchRecognizer) else (r.entity_type,)


def luhn(text: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", ""))


def card(text: Column) -> Column:
    """13 to 19 digits that pass Luhn's check."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.char_length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def octets(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: p.cast("int") <= 255)


def phone(text: Column) -> Column:
    """7 to 15 digits."""
    return F.char_length(F.regexp_replace(text, "[^0-9]", "")).between(7, 15)


# A run of the characters of an address's head is tried from its beginning alone, or where the last match ended, so that a
# run without @ costs its length once.
_HEAD = "[A-Za-z0-9._%+-]"
# No repetition of a group is open: the platform's stack would grow with it.  A domain has 127 parts at most.
EMAIL = Recognizer("EMAIL_ADDRESS", rf"{_HEAD}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){{1,126}}", 0.95, fast=rf"(?:(?<!{_HEAD})|\G){_HEAD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){{1,126}}", needs="@")
_PHONES = (
    r"(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{2,4}\)[ -]?|[0-9]{2,4}[ -])[0-9]{3,4}[ -][0-9]{3,4}\b",
    r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{4}\b",
    r"\b[0-9]{10}\b",
)
_CARDS = (r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}\b", r"[0-9]{13,}")
RECOGNIZERS = (
    EMAIL,
    Recognizer("PHONE_NUMBER", "|".join(_PHONES), 0.75, phone, first="0-9+("),
    Recognizer("CREDIT_CARD", "|".join(_CARDS), 0.9, card, first="0-9"),
    Recognizer("IP_ADDRESS", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0.85, octets, first="0-9"),
    Recognizer("US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.85, first="0-9"),
    Recognizer("URL", r"https?://[^ \t\r\n]+", 0.8, needs="://"),
    Recognizer("DATE_TIME", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0.7, first="0-9"),
    Recognizer("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0.8, iban, first="A-Z"),
)
OTHERS = (
    Recognizer("US_PASSPORT", r"\b[A-Z][0-9]{8}\b", 0.6, first="A-Z"),
    Recognizer("US_DRIVER_LICENSE", r"\b[A-Z][0-9]{3}-[0-9]{4}-[0-9]{4}\b", 0.6, first="A-Z"),
    Recognizer("MEDICAL_LICENSE", r"\b[A-Z]{2}[0-9]{7}\b", 0.6, first="A-Z"),
    Recognizer("NRP", r"\b[0-9]{6}-[0-9]{7}\b", 0.6, first="0-9"),
    Recognizer("CRYPTO", r"\b(?:bc1[02-9ac-hj-np-z]{11,71}|[13][A-HJ-NP-Za-km-z1-9]{25,34})\b", 0.6, crypto, first="b13"),
    Recognizer("US_BANK_NUMBER", r"\b[0-9]{10,12}\b", 0.5),
)
# The sets of types that go by a name.
ENABLED = ("PHONE_NUMBER", "EMAIL_ADDRESS", "CREDIT_CARD", "US_SSN", "PERSON", "URL", "IP_ADDRESS", "DATE_TIME", "LOCATION")
ENGINE_ENABLED = (*ENABLED, "MEDICAL_LICENSE")
SMART_ENABLED = ("EMAIL_ADDRESS", "PERSON", "PHONE_NUMBER", "CREDIT_CARD", "US_SSN", "LOCATION", "DATE_TIME", "MEDICAL_LICENSE", "URL", "IP_ADDRESS", "US_DRIVER_LICENSE", "US_PASSPORT", "IBAN_CODE", "NRP", "CRYPTO")
KEPT_BY_DEFAULT = ("DATE_TIME", "URL")


def phrases(entity_type: str, names, score: float = 0.7) -> BatchRecognizer:
    """Recognizes the given names as whole words, the longest first: PERSON or LOCATION from a list, however long."""
    from .phrases import phrases as automaton  # that module needs this one

    return automaton(entity_type, names, score)


#: A title before one or two capitalised words.
_TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?")
TITLED_PERSON = FunctionRecognizer("PERSON", lambda text: [(m.start(), m.end(), 0.7) for m in _TITLED.finditer(text)])


def _limited(recognizers, types) -> tuple:
    """Recognizers of these types (None: of all); a model of several keeps those that are wanted."""
    out = []
    for r in recognizers:
        own = tuple(t for t in types_of(r) if types is None or t in types)
        if own:
            out.append(replace(r, entity_types=own) if isinstance(r, BatchRecognizer) else r)
    return tuple(out)


@dataclass(frozen=True)
class Analyzer:
    """Which recognizers run, and from which confidence their spans count."""

    recognizers: tuple = RECOGNIZERS
    enabled: tuple[str, ...] | None = None  # all
    threshold: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    language: str = "en"
    languages: tuple[str, ...] = ("en",)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z]{2}(-[A-Z]{2})?", self.language):
            raise ValueError("language is xx or xx-YY")
        if not 0 <= self.threshold <= 1 or any(not 0 <= x <= 1 for x in self.thresholds.values()):
            raise ValueError("a threshold is outside 0 to 1")

    def active(self) -> tuple:
        return _limited(self.recognizers, self.enabled)

    def supported(self) -> list[str]:
        return sorted({t for r in self.active() for t in types_of(r)})

    def enable(self, *types: str) -> Analyzer:
        known = {t for r in self.recognizers for t in types_of(r)}
        more = tuple(r for r in OTHERS if r.entity_type in types and r.entity_type not in known)
        return replace(self, recognizers=(*self.recognizers, *more), enabled=None if self.enabled is None else (*self.enabled, *types))

    def disable(self, *types: str) -> Analyzer:
        return replace(self, recognizers=_limited(self.recognizers, {t for r in self.recognizers for t in types_of(r)} - set(types)))

    def add(self, recognizer) -> Analyzer:
        return replace(self, recognizers=(*self.recognizers, recognizer))

    def detect(self, nodes: DataFrame, text_col: str = "text", types: tuple[str, ...] | None = None, threshold: float | None = None, language: str | None = None) -> DataFrame:
        """nodes with spans; types, threshold and language hold for this call."""
        if language and language.split("-")[0] not in {x.split("-")[0] for x in (self.language, *self.languages)}:
            raise ValueError(f"no recognizers for the language {language}")
        chosen = _limited(self.active(), types)
        limit = self.threshold if threshold is None else threshold
        found = detect(nodes, chosen, text_col)
        least = F.lit(limit)
        own = lambda s: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in self.thresholds.items() for x in p]), s["entity_type"]), least) if self.thresholds else least
        return found.withColumn("spans", F.filter("spans", lambda s: s["confidence"] >= own(s)))

    def diagnostics(self, spark) -> dict:
        """What the analyzer supports, and whether it finds an address in a text of one."""
        rows = self.detect(spark.createDataFrame([("write to test@example.com",)], "text string")).head()
        return {"languages": [self.language, *self.languages], "entities": self.supported(), "threshold": self.threshold, "works": any(s["text"] == "test@example.com" for s in rows["spans"])}


def from_policy(policy, recognizers=RECOGNIZERS) -> Analyzer:
    """The language is the locale's, the confidence the least of the thresholds."""
    return Analyzer(recognizers, threshold=min(policy.thresholds.values(), default=policy.min_confidence), language=policy.locale.split("-")[0])


def from_config(d: dict, recognizers=RECOGNIZERS) -> Analyzer:
    """An analyzer of a map: language, languages, confidence_threshold, thresholds, enabled, disabled, and recognizers
    (name, pattern, score)."""
    own = tuple(Recognizer(r["name"], r["pattern"], float(r.get("score", 0.5))) for r in d.get("recognizers") or ())
    languages = tuple(d.get("languages") or (d.get("language") or "en",))
    made = Analyzer((*recognizers, *own), threshold=float(d.get("confidence_threshold", 0.0)), thresholds=d.get("thresholds") or {}, language=d.get("language") or languages[0], languages=languages)
    if d.get("enabled"):
        made = replace(made, enabled=()).enable(*d["enabled"])
    return made.disable(*(d.get("disabled") or ()))


def load_config(path: str, environment: dict[str, str] | None = None) -> Analyzer:
    """from_config() of a YAML or JSON file; UMBRA_LANGUAGE and UMBRA_CONFIDENCE in the environment go before the file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        d = json.loads(text)
    else:
        import yaml

        d = yaml.safe_load(text) or {}
    env = environment or {}
    d |= {k: env[name] for k, name in (("language", "UMBRA_LANGUAGE"), ("confidence_threshold", "UMBRA_CONFIDENCE")) if name in env}
    return from_config(d)


# The analyzers that go by a name.
ANALYZERS = {
    "default": Analyzer(threshold=0.7),
    "high_precision": Analyzer(threshold=0.85),
    "high_recall": Analyzer(threshold=0.5),
    "multilingual": Analyzer(threshold=0.65, languages=("en", "de", "es", "fr")),
}


def analyzer(name: str) -> Analyzer:
    if name not in ANALYZERS:
        raise ValueError(f"no analyzer {name}; there are {sorted(ANALYZERS)}")
    return ANALYZERS[name]


def none_found() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _marked(text: Column, r: Recognizer) -> Column:
    """text with the recognizer's matches between marks, or an empty one where it cannot have any."""
    out = F.regexp_replace(text, f"({r.here})", f"{MARK}$1{MARK}")
    return F.when(F.contains(text, F.lit(r.needs)), out).otherwise(F.lit("")) if r.needs else out


def _places(marked: Column) -> Column:
    """start, end and text of the matches of a marked text: gap, match, gap, match, ..., gap."""

    def spans(parts: Column, starts: Column) -> Column:
        one = lambda i: F.struct(F.get(starts, i).cast("int").alias("start"), (F.get(starts, i) + F.char_length(F.get(parts, i))).cast("int").alias("end"), F.get(parts, i).alias("text"))
        return F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), one)

    cut = let(F.split(marked, MARK, -1), lambda p: let(running_sums(F.transform(p, F.char_length)), lambda s: spans(p, s)))
    return F.when(F.contains(marked, F.lit(MARK)), cut).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def spans_of(text: Column, *recognizers: Recognizer) -> Column:
    """The recognizers' spans of a text, one recognizer's after the other's: code points, end exclusive, each in order.

    The marked texts are cut by one expression, so a plan grows little with the recognizers."""

    def named(found: Column, r: Recognizer) -> Column:
        spans = F.transform(found, lambda s: F.struct(F.lit(r.entity_type).alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(r.score).alias("confidence"), s["text"].alias("text")))
        return F.filter(spans, lambda s: r.check(s["text"])) if r.check else spans

    plain = F.replace(text, F.lit(MARK), F.lit(INSTEAD))
    found = let(plain, lambda t: F.transform(F.array(*[_marked(t, r) for r in recognizers]), _places))
    return let(found, lambda f: F.concat(*[named(F.get(f, F.lit(i)), r) for i, r in enumerate(recognizers)]))


def spans_by_functions(text: Column, recognizers: list[FunctionRecognizer]) -> Column:
    """The spans of all recognizers that are functions, in one call a batch; one that fails gives none for that text."""

    @F.pandas_udf(f"array<{SPAN}>")
    def found(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = []
            for r in recognizers:
                try:
                    spans += [{"entity_type": r.entity_type, "start": int(a), "end": int(b), "confidence": float(c), "text": t[a:b]} for a, b, c in r.find(t or "")]
                except Exception:  # a user's function; detection goes on without it
                    continue
            out.append(spans)
        return pd.Series(out, dtype=object)

    return found.asNondeterministic()(text)  # so that no plan runs it twice


def spans_by_models(text: Column, models: list[BatchRecognizer], spark) -> Column:
    """The spans of all models, each called once a batch."""
    shared = [(spark.sparkContext.broadcast(m.model), frozenset(m.entity_types)) for m in models]

    @F.pandas_udf(f"array<{SPAN}>")
    def found(texts: pd.Series) -> pd.Series:
        plain = [t or "" for t in texts]
        out: list[list[dict]] = [[] for _ in plain]
        for model, wanted in shared:
            for t, own, spans in zip(plain, out, model.value.find_all(plain), strict=True):
                own += [{"entity_type": kind, "start": a, "end": b, "confidence": c, "text": t[a:b]} for a, b, kind, c in spans if kind in wanted]
        return pd.Series(out, dtype=object)

    return found.asNondeterministic()(text)  # so that no plan runs it twice


def in_order(spans: Column) -> Column:
    """By start, end, falling confidence, type."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), (-s["confidence"]).alias("c"), s["entity_type"].alias("d"), s.alias("s"))))
    return F.transform(keyed, lambda k: k["s"])


def detect(nodes: DataFrame, recognizers=RECOGNIZERS, text_col: str = "text") -> DataFrame:
    """nodes with spans: array of SPAN; narrow, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    functions = [r for r in recognizers if isinstance(r, FunctionRecognizer)]
    own = [r for r in recognizers if isinstance(r, Recognizer)]
    parts = [spans_of(text, *own)] if own else []
    if functions:
        nodes = nodes.withColumn("_by_functions", spans_by_functions(text, functions))
        parts.append(F.coalesce("_by_functions", none_found()))
    models = [r for r in recognizers if isinstance(r, BatchRecognizer)]
    if models:
        nodes = nodes.withColumn("_by_models", spans_by_models(text, models, nodes.sparkSession))
        parts.append(F.coalesce("_by_models", none_found()))
    found = in_order(F.concat(*parts)) if parts else none_found()
    return nodes.withColumn("spans", found).drop("_by_functions", "_by_models")


def inside(spans: Column, text: Column, strict: bool = False) -> Column:
    """The spans that lie within the text; strict: empty ones are left out too."""
    n = F.char_length(text)
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["start"] < s["end"] if strict else s["start"] <= s["end"]) & (s["end"] <= n))


def analyze_segments(nodes: DataFrame, own: Analyzer, least_chars: int = 2, policy=None) -> DataFrame:
    """nodes with spans and error: texts below least_chars have no spans; a text that cannot be read gives its error.

    With a policy the spans that it does not mask are left out."""
    bad = F.col("text").isNotNull() & ~F.expr("is_valid_utf8(text)") if _has_utf8_check(nodes) else F.lit(False)
    text = F.when(bad | (F.char_length("text") < least_chars), F.lit("")).otherwise(F.col("text"))
    rows = own.detect(nodes.withColumn("_t", text), "_t").drop("_t")
    if policy is not None:
        context = F.col("context") if "context" in nodes.columns else F.lit("paragraph")
        rows = rows.withColumn("spans", F.filter("spans", lambda s: policy.masks(s, context)))
    return rows.withColumn("error", F.when(bad, "the text is not UTF-8"))


def _has_utf8_check(df: DataFrame) -> bool:
    return df.sparkSession.catalog.functionExists("is_valid_utf8")


def analysis(rows: DataFrame, *by: str) -> DataFrame:
    """One row a document of analyze_segments(): segments, entities, errors and the share of segments without error."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.size("spans")).cast("long").alias("entities"),
        F.count("error").alias("errors"),
        (1 - F.count("error") / F.count(F.lit(1))).alias("success_rate"),
    )


def above_default_thresholds(entities_: DataFrame) -> DataFrame:
    return entities_.filter(F.col("confidence") >= default_threshold(F.col("entity_type")))


def entities(detected: DataFrame, *ids: str) -> DataFrame:
    return exploded(detected, F.col("spans"), *ids).select(*ids, "s.*")


def paired(original: DataFrame, masked: DataFrame, *by: str) -> DataFrame:
    """Full outer join of detected entities and masked ones on their places: what has no counterpart shows."""
    a = original.select(*by, "start", "end", F.col("entity_type").alias("original_type"), F.col("text").alias("original_text"))
    b = masked.select(*by, "start", "end", F.col("entity_type").alias("masked_type"), F.col("replacement").alias("masked_text"))
    return a.join(b, [*by, "start", "end"], "full")
