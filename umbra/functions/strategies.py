"""Masking strategies as column expressions; surrogates and callbacks in Python, over Arrow batches."""

from __future__ import annotations

import hashlib
import random
import string
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .permute import permuted
from .text import format_pattern, structured_template

# The kinds of strategies, their options, and what counts as a delimiter.
KINDS = ("redact", "template", "hash", "partial", "surrogate", "custom", "permute")
DELIMITERS = "-_.@ ()+"
ALGORITHMS = ("md5", "sha1", "sha256", "sha384", "sha512")
ENCODINGS = ("hex", "base64", "base32")
POSITIONS = ("start", "end", "middle", "random")
#: Bytes of a digest.
BYTES = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}
#: Kinds whose replacement a mapping can turn back.
REVERSIBLE = frozenset(KINDS) - {"custom"}


@dataclass(frozen=True)
class Strategy:
    """A kind and its parameters, checked when made."""

    kind: str
    parameters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        p = self.parameters
        if self.kind not in KINDS:
            raise ValueError(f"unknown strategy {self.kind}")
        for name in ("preserve_length", "auto_generate", "preserve_format", "consistent_length", "preserve_format_structure", "format_aware", "preserve_delimiters", "deterministic"):
            if not isinstance(p.get(name, False), bool):
                raise ValueError(f"{name} is true or false")
        problem = _CHECKS[self.kind](p)
        if problem:
            raise ValueError(problem)

    def with_parameters(self, **more) -> Strategy:
        return replace(self, parameters={**self.parameters, **more})

    def get(self, name: str, default=None):
        return self.parameters.get(name, default)

    @property
    def native(self) -> bool:
        """Whether the replacement is a column expression; the others run in Python."""
        return self.kind not in ("surrogate", "custom")


def _one_char(p: dict, *names: str) -> str | None:
    return next((f"{n} is one character" for n in names if n in p and not (isinstance(p[n], str) and len(p[n]) == 1)), None)


def _of_template(p: dict) -> str | None:
    if "template" not in p and not p.get("auto_generate"):
        return "a template, or auto_generate, is needed"
    return None if isinstance(p.get("template", ""), str) else "template is a string"


def _of_hash(p: dict) -> str | None:
    if p.get("algorithm", "sha256") not in ALGORITHMS:
        return "unknown hash algorithm"
    if p.get("format_output", "hex") not in ENCODINGS:
        return "unknown encoding of a hash"
    if not isinstance(p.get("salt", ""), str) or not isinstance(p.get("prefix", ""), str):
        return "salt and prefix are strings"
    if not isinstance(p.get("per_entity_salt") or {}, dict):
        return "per_entity_salt is a map"
    cut = p.get("truncate")
    return None if cut is None or isinstance(cut, int) and cut > 0 else "truncate is a positive number"


def _of_partial(p: dict) -> str | None:
    if not isinstance(p.get("visible_chars", 4), int) or p.get("visible_chars", 4) < 0:
        return "visible_chars is 0 or more"
    if p.get("position", "end") not in POSITIONS or not p.get("format_aware", True) and p.get("position") == "random":
        return "bad position"
    return _one_char(p, "mask_char")


_CHECKS: dict[str, Callable[[dict], str | None]] = {
    "redact": lambda p: _one_char(p, "redact_char", "char"),
    "template": _of_template,
    "hash": _of_hash,
    "partial": _of_partial,
    "surrogate": lambda p: None if isinstance(p.get("seed", ""), str) and isinstance(p.get("pattern", ""), str) else "seed and pattern are strings",
    "permute": lambda p: None if isinstance(p.get("key"), str) and p["key"] else "permute needs a key",
    "custom": lambda p: None if callable(p.get("callback")) else "custom needs a callback",
}

REDACT = Strategy("redact")
#: What a disabled context gives.
REDACT_FIXED = Strategy("redact", {"redact_char": "*", "preserve_length": False})
HASH = Strategy("hash")
PARTIAL = Strategy("partial")
AUTO_TEMPLATE = Strategy("template", {"auto_generate": True})


def redact(text: Column, char: str = "*", preserve_length: bool = True, length: int = 8) -> Column:
    return F.repeat(F.lit(char), F.char_length(text)) if preserve_length else F.repeat(F.lit(char), F.lit(length))


def template(kind: Column, text: Column, pattern: str | None = None, auto_generate: bool = False, preserve_format: bool = False) -> Column:
    """The pattern with its placeholders filled; auto_generate: the text's own form; preserve_format: both merged."""
    if auto_generate or pattern is None:
        out = structured_template(kind, text)
    elif preserve_format:
        out = merged_template(pattern, kind, text)
    else:
        out = F.lit(pattern or "[REDACTED]")
    for name, value in (("{entity_type}", kind), ("{length}", F.char_length(text).cast("string")), ("{original_format}", format_pattern(text))):
        out = F.replace(out, F.lit(name), value)
    return F.replace(out, F.lit("{}"), F.substring(F.sha2(F.concat_ws("\x1f", kind, text), 256), 1, 8))


def merged_template(pattern: str, kind: Column, text: Column) -> Column:
    if "{format}" in pattern:
        return F.replace(F.lit(pattern), F.lit("{format}"), structured_template(kind, text))
    if pattern.startswith("[") and pattern.endswith("]"):
        return F.concat(F.lit(pattern[:-1] + ":"), F.char_length(text).cast("string"), F.lit("]"))
    return F.lit(pattern)


def salted(kind: Column, text: Column, salt: str = "", per_entity_salt: dict | None = None) -> Column:
    """What is hashed: the text, then the salt, the type's own salt, the length and the type."""
    parts = [F.lit(salt)]
    if per_entity_salt:
        own = F.lit(str(per_entity_salt.get("default", "")))
        for name, value in sorted(per_entity_salt.items()):
            own = F.when(kind == name, F.lit(str(value))).otherwise(own)
        parts.append(own)
    parts += [F.concat(F.lit("len:"), F.char_length(text).cast("string")), F.concat(F.lit("type:"), kind)]
    return F.concat(text, F.concat_ws("|", *parts))


def digest(content: Column, algorithm: str = "sha256", encoding: str = "hex") -> tuple[Column, int]:
    """(the digest as text, its length)."""
    raw, size = content.cast("binary"), BYTES[algorithm]
    value = F.md5(raw) if algorithm == "md5" else F.sha1(raw) if algorithm == "sha1" else F.sha2(raw, size * 8)
    if encoding == "base64":
        return F.replace(F.base64(F.unhex(value)), F.lit("\r\n"), F.lit("")), -(-size // 3) * 4  # long ones come in lines
    if encoding == "base32":
        return _base32(value, size), -(-size // 5) * 8
    return value, size * 2


def _base32(value: Column, size: int) -> Column:
    """Base 32 of `size` bytes given in hex: five bytes at a time are a number of eight digits."""
    whole, digits = -(-size // 5), -(-size * 8 // 5)
    filled = F.rpad(value, whole * 10, "0")
    parts = [F.lpad(F.conv(F.substring(filled, i * 10 + 1, 10), 16, 32), 8, "0") for i in range(whole)]
    own = F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.rpad(F.substring(own, 1, digits), whole * 8, "=")


def hashed(kind: Column, text: Column, algorithm: str = "sha256", salt: str = "", per_entity_salt: dict | None = None, truncate: int | None = None, prefix: str = "", encoding: str = "hex", consistent_length: bool = True, structure: bool = False) -> Column:
    """The prefix and the digest of the salted text.  With consistent_length a truncated digest begins at a place that
    the text and the algorithm give (the first 28 bits of their SHA-256), else at its start."""
    value, length = digest(salted(kind, text, salt, per_entity_salt), algorithm, encoding)
    if truncate and truncate < length:
        at = F.lit(0)
        if consistent_length:
            at = F.pmod(F.conv(F.substring(F.sha2(F.concat(text, F.lit(algorithm)), 256), 1, 7), 16, 10).cast("int"), F.lit(max(1, length - truncate)))
        value, length = F.substring(value, at + 1, F.lit(truncate)), truncate
    return F.concat(F.lit(prefix), _structured(text, value, length) if structure else value)


def _structured(text: Column, value: Column, length: int) -> Column:
    """value with the text's delimiters at proportional places, where a letter or digit is."""
    places = F.when(F.char_length(text) > 0, F.sequence(F.lit(0), F.char_length(text) - 1)).otherwise(F.array().cast("array<int>"))
    marks = F.filter(places, lambda i: F.instr(F.lit(DELIMITERS), F.substring(text, i + 1, F.lit(1))) > 0)

    def put(a: Column, i: Column) -> Column:
        at = F.least(F.floor(i / F.char_length(text) * length).cast("int"), F.lit(length - 1))
        free = F.substring(a, at + 1, F.lit(1)).rlike("[0-9A-Za-z]")
        return F.when(free, F.overlay(a, F.substring(text, i + 1, F.lit(1)), at + 1)).otherwise(a)

    return F.aggregate(marks, value, put)


def hashed_plain(text: Column, algorithm: str = "sha256", salt: str = "", truncate: int | None = None, prefix: str = "") -> Column:
    """The operator form: the text and the salt alone are hashed, and the prefix counts in the truncation."""
    value = F.concat(F.lit(prefix), digest(F.concat(text, F.lit(salt)), algorithm)[0])
    return F.substring(value, 1, truncate) if truncate else value


def partial(text: Column, visible: int = 4, position: str = "end", char: str = "*", format_aware: bool = True, preserve_delimiters: bool = True, min_length: int = 1) -> Column:
    """Some characters stay.  With format_aware delimiters stay too, the visible characters are chosen among the others,
    and a text of no more than `visible` others stays whole; else a text of no more than `visible` characters keeps its
    first and last, if it has more than two.  Texts below min_length are masked whole.

    "random" takes the characters of the smallest stable hashes of text and place."""
    n = F.char_length(text)
    whole = F.repeat(F.lit(char), n)
    own = _format_aware(text, visible, position, char, preserve_delimiters) if format_aware else _plain(text, n, whole, visible, position, char)
    return F.when(n < min_length, whole).otherwise(own)


def _plain(text: Column, n: Column, whole: Column, visible: int, position: str, char: str) -> Column:
    stars = lambda k: F.repeat(F.lit(char), k)
    first, last = {"start": (visible, 0), "end": (0, visible), "middle": (visible - visible // 2, visible // 2)}[position]
    head = F.substring(text, 1, first)
    tail = F.substring(text, n - last + 1, F.lit(last)) if last else F.lit("")
    small = F.when(n <= 2, whole).otherwise(F.concat(F.substring(text, 1, 1), stars(n - 2), F.substring(text, n, F.lit(1))))
    return F.when(n <= visible, small).otherwise(F.concat(head, stars(n - visible), tail))


def _format_aware(text: Column, visible: int, position: str, char: str, preserve_delimiters: bool) -> Column:
    kept = DELIMITERS if preserve_delimiters else ""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    others = F.translate(text, kept, "") if kept else text
    total = F.char_length(others)
    if position == "random":
        ranks = F.sequence(F.lit(1), total)
        chosen = F.transform(F.slice(F.array_sort(F.transform(ranks, lambda r: F.struct(F.xxhash64(text, r).alias("h"), r.alias("r")))), 1, max(visible, 1)), lambda x: x["r"])

    def show(rank: Column) -> Column:
        if not visible:
            return F.lit(False)
        if position == "random":
            return F.array_contains(chosen, rank)
        first, last = {"start": (visible, 0), "end": (0, visible), "middle": (visible - visible // 2, visible // 2)}[position]
        return (rank <= first) | (rank > total - last)

    def place(c: Column, i: Column) -> Column:
        before = F.substring(text, 1, i + 1)
        rank = F.char_length(F.translate(before, kept, "") if kept else before)
        delimiter = F.instr(F.lit(kept), c) > 0 if kept else F.lit(False)
        return F.when(delimiter | show(rank), c).otherwise(F.lit(char))

    return F.when(total <= visible, text).otherwise(F.array_join(F.transform(chars, place), ""))


def partial_plain(text: Column, visible: int = 4, position: str = "end", char: str = "*") -> Column:
    """The operator form: no delimiters; a text of no more than `visible` characters stays; all but "start" is the end."""
    n = F.char_length(text)
    stars = F.repeat(F.lit(char), n - visible)
    shown = F.concat(F.substring(text, 1, visible), stars) if position == "start" else F.concat(stars, F.substring(text, n - visible + 1, F.lit(visible)) if visible else F.lit(""))
    return F.when(n <= visible, text).otherwise(shown)


# Fixed values of surrogates: parts that make them recognizable as invented.
AREA_CODES = (200, 201, 202, 203, 205, 206, 207, 208, 209, 210)
CARD_PREFIXES = ("4000", "4111", "4444", "5000", "5555")
SAFE_DOMAINS = ("example", "test", "sample", "demo")
SAFE_TOPS = ("com", "org", "net", "edu")
FIRST_NAMES = ("Alex", "Jordan", "Casey", "Riley", "Morgan", "Cameron")
LAST_NAMES = ("Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia")


def _shaped(text: str, rng: random.Random) -> str:
    """Digits for digits and letters for letters of the same case; all else stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(rng.choice(string.digits))
        elif c.isalpha():
            out.append(rng.choice(string.ascii_uppercase if c.isupper() else string.ascii_lowercase))
        else:
            out.append(c)
    return "".join(out)


def _phone(text: str, rng: random.Random) -> str:
    area, exchange, line = str(rng.choice(AREA_CODES)), str(rng.randint(200, 999)), str(rng.randint(1000, 9999))
    digits = "".join(c for c in text if c.isdigit())
    if text.startswith("+"):
        return f"+1 {area}-{exchange}-{line}"
    if "(" in text and ")" in text:
        return f"({area}) {exchange}-{line}"
    if len(digits) == 10:  # the digits take the places of the old ones
        fresh = iter(area + exchange + line)
        return "".join(next(fresh) if c.isdigit() else c for c in text)
    return _shaped(text, rng)


def _ssn(text: str, rng: random.Random) -> str:
    area = rng.choice([n for n in range(100, 900) if n != 666])
    return ("-" if "-" in text else "").join((str(area), str(rng.randint(10, 99)), str(rng.randint(1000, 9999))))


def _email(text: str, rng: random.Random) -> str:
    user, at, domain = text.partition("@")
    if not at:
        return _shaped(text, rng)
    *names, top = domain.split(".") if "." in domain else (domain,)
    if not names:
        return f"{_shaped(user, rng)}@{_shaped(top, rng)}"
    fresh = [rng.choice(SAFE_DOMAINS) if len(n) <= 8 else _shaped(n, rng) for n in names]
    return f"{_shaped(user, rng)}@{'.'.join(fresh)}.{rng.choice(SAFE_TOPS) if len(top) <= 3 else _shaped(top, rng)}"


def _card(text: str, rng: random.Random) -> str:
    prefix = rng.choice(CARD_PREFIXES)
    digits = prefix + "".join(rng.choice(string.digits) for _ in range(16 - len(prefix)))
    return next((s for s in "- " if s in text), "").join(digits[i : i + 4] for i in range(0, 16, 4))


def _person(text: str, rng: random.Random) -> str:
    words = text.split()
    if len(words) < 2:
        return rng.choice(FIRST_NAMES + LAST_NAMES)
    middle = [rng.choice(string.ascii_uppercase) if len(w) == 1 else rng.choice(FIRST_NAMES) for w in words[1:-1]]
    return " ".join((rng.choice(FIRST_NAMES), *middle, rng.choice(LAST_NAMES)))


SURROGATES = {"PHONE_NUMBER": _phone, "US_SSN": _ssn, "EMAIL_ADDRESS": _email, "EMAIL": _email, "CREDIT_CARD": _card, "PERSON": _person}


def _random(seed: str, kind: str | None, text: str, attempt: int = 0) -> random.Random:
    first = hashlib.sha256(f"{seed}|{text}|{kind}|{len(text)}".encode()).hexdigest()[:16]
    if attempt:
        first = hashlib.sha256(f"{first}:{attempt}".encode()).hexdigest()[:16]
    return random.Random(int(first, 16))


def surrogate_of(kind: str | None, text: str, seed: str = "", pattern: str | None = None, attempt: int = 0) -> str:
    """A fake of the same kind, the same for the same text and seed; pattern: X, x, 9 and ? stand for random characters."""
    if pattern:
        return from_pattern(pattern, _random(seed, "PATTERN", pattern, attempt))
    return SURROGATES.get(kind, _shaped)(text, _random(seed, kind, text, attempt))


def from_pattern(pattern: str, rng: random.Random) -> str:
    classes = {"X": string.ascii_uppercase, "x": string.ascii_lowercase, "9": string.digits, "?": string.ascii_letters + string.digits}
    return "".join(rng.choice(classes[c]) if c in classes else c for c in pattern)


def distinct_surrogate(kind: str | None, text: str, seed: str, taken: dict[str, str], pattern: str | None = None) -> str:
    """A surrogate that no other text in `taken` (surrogate -> text) has: ten attempts, then a number is appended."""
    tries = (surrogate_of(kind, text, seed, pattern, k) for k in range(10))
    first = surrogate_of(kind, text, seed, pattern)
    suffixed = (f"{first}_{k}" for k in range(1, 100))
    free = next((s for many in (tries, suffixed) for s in many if taken.get(s, text) == text), first)
    taken[free] = text
    return free


def attempted(callback: Callable, kind: str, text: str, confidence: float) -> str | None:
    """callback(original_text=, entity_type=, confidence=), or None where it fails or gives no text."""
    try:
        out = callback(original_text=text, entity_type=kind, confidence=confidence)
    except Exception:  # a user's function; the mask must still hide the text
        return None
    return out if isinstance(out, str) and out else None


def called(callback: Callable, kind: str, text: str, confidence: float) -> str:
    """attempted(), or asterisks."""
    return attempted(callback, kind, text, confidence) or "*" * max(1, len(text))


def in_python(strategy: Strategy, kind: str, text: str, confidence: float, seed: str = "", taken: dict[str, str] | None = None) -> str:
    """The replacement by a strategy that is not native."""
    if strategy.kind == "custom":
        return called(strategy.parameters["callback"], kind, text, confidence)
    return distinct_surrogate(kind, text, strategy.get("seed") or seed, {} if taken is None else taken, strategy.get("pattern"))


def surrogate(seed: str = "", pattern: str | None = None) -> Callable[[Column, Column], Column]:
    """(kind, text) -> surrogate_of()."""

    @F.pandas_udf("string")
    def fake(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else surrogate_of(k, t, seed, pattern) for k, t in zip(kind, text, strict=True)], dtype=object)

    return fake


def custom(callback: Callable) -> Callable[[Column, Column, Column], Column]:
    """(kind, text, confidence) -> called()."""

    @F.pandas_udf("string")
    def call(kind: pd.Series, text: pd.Series, confidence: pd.Series) -> pd.Series:
        return pd.Series([called(callback, k, t, c) for k, t, c in zip(kind, text, confidence, strict=True)], dtype=object)

    return call


def native(strategy: Strategy, kind: Column, text: Column) -> Column:
    """The replacement by a strategy that needs no Python."""
    p = strategy.parameters
    if strategy.kind == "redact":
        return redact(text, p.get("char", p.get("redact_char", "*")), p.get("preserve_length", True), p.get("redaction_length", 8))
    if strategy.kind == "template":
        return template(kind, text, p.get("template"), p.get("auto_generate", False), p.get("preserve_format", False))
    if strategy.kind == "hash":
        return hashed(kind, text, p.get("algorithm", "sha256"), p.get("salt", ""), p.get("per_entity_salt"), p.get("truncate"), p.get("prefix", ""), p.get("format_output", "hex"), p.get("consistent_length", True), p.get("preserve_format_structure", False))
    if strategy.kind == "partial":
        return partial(text, p.get("visible_chars", 4), p.get("position", "end"), p.get("mask_char", "*"), p.get("format_aware", True), p.get("preserve_delimiters", True), p.get("min_length", 1))
    if strategy.kind == "permute":
        return permuted(kind, text, p["key"])
    raise ValueError(f"{strategy.kind} is not native")


def operator_form(strategy: Strategy, kind: Column, text: Column) -> Column:
    """The replacement as the outer anonymizer's operators give it: hashes without added salts, plain partial masks,
    redaction of the text's length."""
    p = strategy.parameters
    if strategy.kind == "hash":
        return hashed_plain(text, p.get("algorithm", "sha256"), p.get("salt", ""), p.get("truncate"), p.get("prefix", ""))
    if strategy.kind == "partial":
        return partial_plain(text, p.get("visible_chars", 4), p.get("position", "end"), p.get("mask_char", "*"))
    if strategy.kind == "redact":
        return redact(text, p.get("char", p.get("redact_char", "*")))
    return native(strategy, kind, text)


def fallback_chain(strategy: Strategy, kind: str) -> list[Strategy]:
    """What is tried in turn where a strategy fails."""
    template_, fixed = Strategy("template", {"template": f"[{kind}]"}), REDACT_FIXED
    if strategy.kind == "partial":
        return [REDACT, template_]
    rest = [template_, REDACT, fixed]
    return [Strategy("hash", {"algorithm": "sha256", "truncate": 8}), *rest] if strategy.kind == "surrogate" else rest


def fallback(strategy: Strategy, kind: Column, text: Column) -> Column:
    """What stands in where a strategy gave nothing: the first of its fallbacks that gives a text, at last asterisks."""
    tried = [F.nullif(native(s, kind, text), F.lit("")) for s in fallback_chain(strategy, "{entity_type}")]
    return F.coalesce(*tried, F.repeat(F.lit("*"), F.greatest(F.char_length(text), F.lit(1))))


def with_fallback(value: Column, strategy: Strategy, kind_name: str, kind: Column, text: Column) -> Column:
    """value, or where it is null the first of the fallbacks, at last asterisks."""
    return F.coalesce(value, *[native(s, kind, text) for s in fallback_chain(strategy, kind_name)], F.repeat(F.lit("*"), F.greatest(F.char_length(text), F.lit(1))))


# How well the kinds suit the types.
SUITS = {
    "EMAIL_ADDRESS": {"surrogate": 3, "template": 2, "hash": 1},
    "PHONE_NUMBER": {"partial": 3, "template": 2, "surrogate": 1},
    "CREDIT_CARD": {"partial": 3, "hash": 2, "redact": 1},
    "US_SSN": {"redact": 3, "hash": 2, "partial": 1},
}


def prioritised(kind: str, confidence: float, strategies: list[Strategy]) -> list[Strategy]:
    """The strategies by how well they suit the type; sure detections favour redaction and hashes, others the rest."""
    favoured = ("redact", "hash") if confidence > 0.9 else ("partial", "template")
    return sorted(strategies, key=lambda s: -(SUITS.get(kind, {}).get(s.kind, 0) + (s.kind in favoured)))


def compose(text: Column, kind: Column, *strategies: Strategy) -> Column:
    """Strategies applied from left to right."""
    for s in strategies:
        text = native(s, kind, text)
    return text
