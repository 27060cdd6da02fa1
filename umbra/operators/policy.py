"""Masking policies: driver-side configuration, compiled to column expressions."""

from __future__ import annotations

import inspect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.permute import permuted
from umbra.functions.strategies import REDACT, REDACT_FIXED, Strategy, attempted, fallback, in_python, native
from umbra.functions.text import literal_map

CONTEXTS = {"heading", "table", "footer", "header", "list", "paragraph", "code", "formula"}
PRIVACY_LEVELS = ("low", "medium", "high")
#: What a rule of a context may say.
RULE_KEYS = {"strategy", "threshold", "enabled", "strategy_overrides", "threshold_overrides"}
#: What a policy that is strictly composed may change of those it extends.
STRICT_FIELDS = {"name", "description", "per_entity", "thresholds", "allow_list", "deny_list"}


@dataclass(frozen=True)
class Rule:
    """What holds in a context: whether entities are masked, their strategy, threshold, and both by type."""

    enabled: bool | None = None
    strategy: Strategy | None = None
    threshold: float | None = None
    strategy_overrides: dict[str, Strategy] = field(default_factory=dict)
    threshold_overrides: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Policy:
    default: Strategy = REDACT
    per_entity: dict[str, Strategy] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    allow: frozenset[str] = frozenset()
    deny: frozenset[str] = frozenset()
    contexts: dict[str, Rule] = field(default_factory=dict)
    min_length: int = 1
    min_confidence: float = 0.5
    locale: str = "en"
    seed: str = ""
    callbacks: dict[str, Callable] = field(default_factory=dict)
    privacy_level: str = "medium"
    #: Where a strategy fails or gives nothing, its fallbacks are tried in turn; without, an asterisk or asterisks stand there.
    fallbacks: bool = False

    def __post_init__(self) -> None:
        limits = [*self.thresholds.values(), self.min_confidence, *(x for r in self.contexts.values() for x in (r.threshold, *r.threshold_overrides.values()) if x is not None)]
        if any(not 0 <= x <= 1 for x in limits):
            raise ValueError("a threshold is outside 0 to 1")
        if not re.fullmatch(r"[a-z]{2}(-[A-Z]{2})?", self.locale):
            raise ValueError("locale is xx or xx-YY")
        if bad := set(self.contexts) - CONTEXTS:
            raise ValueError(f"unknown contexts {sorted(bad)}")
        if self.min_length < 0:
            raise ValueError("min_length is 0 or more")
        if self.privacy_level not in PRIVACY_LEVELS:
            raise ValueError("privacy_level is low, medium or high")
        for name, callback in self.callbacks.items():
            if not callable(callback) or not {"original_text", "entity_type", "confidence"} <= set(inspect.signature(callback).parameters):
                raise ValueError(f"the callback of {name} takes original_text, entity_type and confidence")

    def with_strategy(self, entity: str, strategy: Strategy) -> Policy:
        return replace(self, per_entity={**self.per_entity, entity: strategy})

    def with_threshold(self, entity: str, threshold: float) -> Policy:
        return replace(self, thresholds={**self.thresholds, entity: threshold})

    def callback(self, entity: str) -> Callable | None:
        return self.callbacks.get(entity)

    def threshold(self, kind: Column, context: Column) -> Column:
        """The context's for the type, the context's, the type's, the default."""
        out = F.coalesce(F.try_element_at(literal_map(self.thresholds), kind), F.lit(self.min_confidence)) if self.thresholds else F.lit(self.min_confidence)
        for name, rule in self.contexts.items():
            own = F.lit(rule.threshold).cast("double") if rule.threshold is not None else out
            own = F.coalesce(F.try_element_at(literal_map(rule.threshold_overrides), kind), own) if rule.threshold_overrides else own
            out = F.when(context == name, own).otherwise(out)
        return out

    def masks(self, span: Column, context: Column) -> Column:
        """Deny list, then allow list, length, threshold, context: the first that decides."""
        off = [n for n, r in self.contexts.items() if r.enabled is False]
        listed = lambda names: span["text"].isin(*sorted(names)) if names else F.lit(False)
        return F.when(listed(self.deny), True).when(listed(self.allow), False).when(F.char_length(span["text"]) < self.min_length, False).when(span["confidence"] < self.threshold(span["entity_type"], context), False).when(context.isin(*off) if off else F.lit(False), False).otherwise(True)

    def strategy(self, entity: str, context: str | None = None) -> Strategy:
        """The strategy of the context, the type, or the default; a disabled context gives a redaction of fixed length."""
        rule = self.contexts.get(context)
        if rule:
            if rule.enabled is False:
                return REDACT_FIXED
            own = rule.strategy_overrides.get(entity) or rule.strategy
            if own:
                return own
        return self.per_entity.get(entity, self.default)

    def _by_strategy(self, kind: Column, context: Column, of: Callable[[Strategy], Column]) -> Column:
        """of() of the strategy that strategy() gives, as one expression."""

        def by_type(strategies: dict[str, Strategy], rest: Column) -> Column:
            for name, s in sorted(strategies.items()):
                rest = F.when(kind == name, of(s)).otherwise(rest)
            return rest

        out = by_type(self.per_entity, of(self.default))
        for name, rule in self.contexts.items():
            own = of(REDACT_FIXED) if rule.enabled is False else by_type(rule.strategy_overrides, of(rule.strategy) if rule.strategy else out)
            out = F.when(context == name, own).otherwise(out)
        return out

    def strategies(self) -> list[Strategy]:
        rules = self.contexts.values()
        return [self.default, *self.per_entity.values(), *(s for r in rules for s in (*r.strategy_overrides.values(), *([r.strategy] if r.strategy else [])))]

    @property
    def native(self) -> bool:
        return all(s.native for s in self.strategies())

    def replacement(self, span: Column, context: Column) -> Column:
        """The span's replacement; null where its strategy runs in Python."""
        kind, text = span["entity_type"], span["text"]
        return self._by_strategy(kind, context, lambda s: native(s, kind, text) if s.native else F.lit(None).cast("string"))

    def turned_back(self, kind: Column, masked: Column, context: Column) -> Column:
        """The original of a replacement whose strategy has a key; null for other strategies."""
        return self._by_strategy(kind, context, lambda s: permuted(kind, masked, s.get("key"), back=True) if s.kind == "permute" else F.lit(None).cast("string"))

    def replacements_in_python(self, spans: Column, context: Column) -> Column:
        """For each span the replacement by a strategy that runs in Python, else null: one call for a whole row's spans,
        which gives different texts of a row different surrogates."""
        policy = self

        def given(how: Strategy, s, taken: dict[str, str]) -> str | None:
            if policy.fallbacks and how.kind == "custom":
                return attempted(how.get("callback"), s["entity_type"], s["text"], s["confidence"])
            return in_python(how, s["entity_type"], s["text"], s["confidence"], policy.seed, taken)

        @F.pandas_udf("array<string>")
        def replaced(spans: pd.Series, context: pd.Series) -> pd.Series:
            out = []
            for row, where in zip(spans, context, strict=True):
                if row is None:
                    out.append(None)
                    continue
                taken: dict[str, str] = {}
                chosen = [(s, policy.strategy(s["entity_type"], where)) for s in row]
                out.append([None if how.native else given(how, s, taken) for s, how in chosen])
            return pd.Series(out, dtype=object)

        return replaced.asNondeterministic()(spans, context)  # so that no plan runs it twice, or within another expression

    def fallback(self, span: Column, context: Column) -> Column:
        """What stands in for a span whose strategy gave nothing."""
        kind, text = span["entity_type"], span["text"]
        return self._by_strategy(kind, context, lambda s: fallback(s, kind, text))

    def strategy_name(self, kind: Column, context: Column | None = None) -> Column:
        return self._by_strategy(kind, F.lit(None).cast("string") if context is None else context, lambda s: F.lit(s.kind))

    def to_dict(self) -> dict:
        """The policy's file form; callbacks are left out."""
        plain = lambda s: {"kind": s.kind, "parameters": {k: v for k, v in s.parameters.items() if not callable(v)}}

        def rule(r: Rule) -> dict:
            found = {"enabled": r.enabled, "strategy": plain(r.strategy) if r.strategy else None, "threshold": r.threshold, "strategy_overrides": {k: plain(s) for k, s in r.strategy_overrides.items()} or None, "threshold_overrides": dict(r.threshold_overrides) or None}
            return {k: v for k, v in found.items() if v is not None}

        return {
            "default_strategy": plain(self.default), "per_entity": {k: plain(s) for k, s in self.per_entity.items()}, "thresholds": dict(self.thresholds), "allow_list": sorted(self.allow), "deny_list": sorted(self.deny),
            "context_rules": {k: rule(r) for k, r in self.contexts.items()}, "min_entity_length": self.min_length, "min_confidence": self.min_confidence, "locale": self.locale, "seed": self.seed, "privacy_level": self.privacy_level,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_dict(cls, d: dict) -> Policy:
        def make(s: dict) -> Strategy:
            p = s.get("parameters") or {}
            if s["kind"] == "custom" and "callback" not in p:  # callbacks are not in files
                return REDACT
            return Strategy(s["kind"], p)

        def rule(r: dict) -> Rule:
            if bad := set(r) - RULE_KEYS:
                raise ValueError(f"unknown keys in a context rule: {sorted(bad)}")
            return Rule(r.get("enabled"), make(r["strategy"]) if r.get("strategy") else None, r.get("threshold"), {n: make(s) for n, s in (r.get("strategy_overrides") or {}).items() if s.get("kind")}, r.get("threshold_overrides") or {})

        entities = {k: v for k, v in (d.get("per_entity") or {}).items() if v.get("enabled", True)}
        limits = (d.get("thresholds") or {}) | {k: v["threshold"] for k, v in entities.items() if v.get("threshold") is not None}
        level = str(d.get("privacy_level") or "medium").lower()
        return cls(
            make(d["default_strategy"]) if d.get("default_strategy") else REDACT, {k: make(v) for k, v in entities.items() if v.get("kind")}, limits, frozenset(x for x in d.get("allow_list") or () if isinstance(x, str)), frozenset(d.get("deny_list") or ()),
            {k: rule(v) for k, v in (d.get("context_rules") or {}).items()}, d.get("min_entity_length", 1), d.get("min_confidence", 0.5), d.get("locale") or "en", d.get("seed") or "", privacy_level=level if level in PRIVACY_LEVELS else "medium",
        )


def by_lists(entities: DataFrame, allow: DataFrame | None = None, deny: DataFrame | None = None) -> DataFrame:
    """entities with listed: "deny", "allow" or null by their text, for lists too long for a policy.

    The lists (column text) are joined; Spark broadcasts one that is small."""
    out, listed = entities, F.lit(None).cast("string")
    for name, rows in (("allow", allow), ("deny", deny)):  # the deny list decides
        if rows is not None:
            own = rows.select(F.col("text").alias(f"_{name}")).distinct()
            out = out.join(own, out["text"] == own[f"_{name}"], "left")
            listed = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(listed)
    return out.withColumn("listed", listed).drop("_allow", "_deny")


def merged(base: dict, over: dict) -> dict:
    """The contents of a policy file over those of one that it extends.

    Types' settings are merged field by field, thresholds, locales and context rules key by key, lists joined, other fields
    replaced where set.  A file whose policy_composition asks for merge_strategy "strict" replaces STRICT_FIELDS whole and
    nothing else."""
    own = {k: v for k, v in over.items() if v is not None}
    if (over.get("policy_composition") or {}).get("merge_strategy") == "strict":
        return {**base, **{k: v for k, v in own.items() if k in STRICT_FIELDS}}
    out = dict(base)
    for k, v in own.items():
        if k == "per_entity":
            held = out.get(k) or {}
            out[k] = {**held, **{name: {**held.get(name, {}), **{f: x for f, x in settings.items() if x is not None}} for name, settings in v.items()}}
        elif k in ("thresholds", "locales", "context_rules"):
            out[k] = {**(out.get(k) or {}), **v}
        elif k in ("allow_list", "deny_list"):
            out[k] = [*(out.get(k) or []), *v]
        else:
            out[k] = v
    return out


def load(path: str) -> Policy:
    return Policy.from_dict(read(path))


def read(path: str, _open: tuple[str, ...] = ()) -> dict:
    """A YAML policy file over those that it extends, in order; a cycle is an error."""
    import yaml

    here = str(Path(path).resolve())
    if here in _open:
        raise ValueError(f"policies extend each other: {' -> '.join((*_open, here))}")
    own = yaml.safe_load(Path(here).read_text(encoding="utf-8")) or {}
    if not isinstance(own, dict):
        raise ValueError("a policy file holds a map")
    parents = own.pop("extends", None) or []
    out: dict = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        out = merged(out, read(str(Path(here).parent / parent), (*_open, here)))
    return merged(out, own)


def problems(path: str) -> list[str]:
    """What is wrong with a policy file; nothing, if it can be loaded."""
    try:
        load(path)
    except FileNotFoundError:
        return [f"no file {path}"]
    except Exception as e:  # whatever a file holds, the answer is a message
        return [f"{type(e).__name__}: {e}"]
    return []


def _template(text: str) -> Strategy:
    return Strategy("template", {"template": text})


def _partial(visible: int, position: str, **more) -> Strategy:
    return Strategy("partial", {"visible_chars": visible, "position": position, **more})


# Types of high risk, and the policies that go by a name.
HIGH_RISK = (
    "CREDIT_CARD",
    "US_SSN",
    "MEDICAL_LICENSE",
    "US_PASSPORT",
    "US_DRIVER_LICENSE",
    "IBAN_CODE",
    "CRYPTO",
)
DEFAULT = Policy(
    _template("[REDACTED]"),
    {
        "EMAIL_ADDRESS": _template("[EMAIL]"),
        "PHONE_NUMBER": _template("[PHONE]"),
        "PERSON": _template("[NAME]"),
        "LOCATION": _template("[LOCATION]"),
        "CREDIT_CARD": _template("[CARD-****]"),
        "US_SSN": _partial(4, "end", mask_char="*"),
        "IBAN_CODE": _template("[IBAN]"),
        "MEDICAL_LICENSE": _template("[MED-LIC]"),
        "US_DRIVER_LICENSE": _template("[DL]"),
        "US_PASSPORT": _template("[PASSPORT]"),
        "NRP": _template("[NRP]"),
        "IP_ADDRESS": _template("[IP]"),
        "CRYPTO": _template("[CRYPTO]"),
        "DATE_TIME": _template("[DATE]"),
        "URL": _template("[URL]"),
    },
)
CONSERVATIVE = Policy(Strategy("redact", {"replacement": "[REMOVED]"}))
PERMISSIVE = Policy(_template("[PII]"), {name: _template(f"[{name.replace('_', '-')}]") for name in HIGH_RISK})
CONSERVATIVE_POLICY = Policy(REDACT, thresholds={"PHONE_NUMBER": 0.9, "EMAIL_ADDRESS": 0.9, "CREDIT_CARD": 0.8, "US_SSN": 0.9, "PERSON": 0.8})
TEMPLATE_POLICY = Policy(
    REDACT,
    {
        "PHONE_NUMBER": _template("[PHONE]"),
        "EMAIL_ADDRESS": _template("[EMAIL]"),
        "CREDIT_CARD": _template("[CREDIT_CARD]"),
        "US_SSN": _template("[SSN]"),
        "PERSON": _template("[NAME]"),
    },
)
PARTIAL_POLICY = Policy(REDACT, {"PHONE_NUMBER": _partial(4, "end"), "EMAIL_ADDRESS": _partial(3, "start"), "CREDIT_CARD": _partial(4, "end"), "US_SSN": _partial(4, "end")})
_AUTO = Strategy("template", {"auto_generate": True, "preserve_format": True})
FORMAT_AWARE_TEMPLATE_POLICY = Policy(
    REDACT,
    {
        "PHONE_NUMBER": _AUTO,
        "EMAIL_ADDRESS": _AUTO,
        "US_SSN": Strategy("template", {"template": "XXX-XX-XXXX", "preserve_format": True}),
        "CREDIT_CARD": Strategy("template", {"template": "XXXX-XXXX-XXXX-XXXX", "preserve_format": True}),
    },
)
_AWARE = {"format_aware": True, "preserve_delimiters": True, "deterministic": True}
FORMAT_AWARE_PARTIAL_POLICY = Policy(REDACT, {"PHONE_NUMBER": _partial(4, "end", **_AWARE), "EMAIL_ADDRESS": _partial(3, "start", **_AWARE), "CREDIT_CARD": _partial(4, "end", **_AWARE), "US_SSN": _partial(4, "end", **_AWARE)})
DETERMINISTIC_HASH_POLICY = Policy(
    Strategy(
        "hash",
        {
            "algorithm": "sha256",
            "truncate": 8,
            "format_output": "hex",
            "consistent_length": True,
            "per_entity_salt": {
                "PHONE_NUMBER": "phone_salt_v1",
                "EMAIL_ADDRESS": "email_salt_v1",
                "CREDIT_CARD": "cc_salt_v1",
                "US_SSN": "ssn_salt_v1",
                "PERSON": "name_salt_v1",
                "default": "default_salt_v1",
            },
        },
    ),
    seed="deterministic-hash-policy-v1",
)
MIXED_STRATEGY_POLICY = Policy(
    REDACT,
    {
        "PHONE_NUMBER": _partial(4, "end", format_aware=True, preserve_delimiters=True),
        "EMAIL_ADDRESS": _AUTO,
        "CREDIT_CARD": Strategy("hash", {"algorithm": "sha256", "truncate": 12, "prefix": "CC_", "per_entity_salt": {"CREDIT_CARD": "cc_secure_v1"}}),
        "US_SSN": _template("XXX-XX-XXXX"),
        "PERSON": Strategy("hash", {"algorithm": "sha256", "truncate": 8, "prefix": "NAME_", "per_entity_salt": {"PERSON": "name_secure_v1"}}),
    },
    {"PHONE_NUMBER": 0.8, "EMAIL_ADDRESS": 0.7, "CREDIT_CARD": 0.9, "US_SSN": 0.9, "PERSON": 0.75},
)
PRESETS = {
    "default": DEFAULT, "conservative": CONSERVATIVE, "permissive": PERMISSIVE, "conservative_thresholds": CONSERVATIVE_POLICY, "template": TEMPLATE_POLICY, "partial": PARTIAL_POLICY,
    "format_template": FORMAT_AWARE_TEMPLATE_POLICY, "format_partial": FORMAT_AWARE_PARTIAL_POLICY, "hash": DETERMINISTIC_HASH_POLICY, "mixed": MIXED_STRATEGY_POLICY,
}


def preset(name: str) -> Policy:
    if name not in PRESETS:
        raise ValueError(f"no policy {name}; there are {sorted(PRESETS)}")
    return PRESETS[name]
