"""Functions for users of SQL: a table function that finds entities in a text, and functions that mask one.

    SELECT d.doc_id, e.* FROM documents d, LATERAL detect_pii(d.text) e
    SELECT doc_id, mask_pii(text) FROM documents

A table function runs in Python (over Arrow), so a plan that can use the DataFrame API is faster with detect(); both find
the same.  mask_pii() masks by a policy whose strategies are native or a surrogate's, a batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from umbra.errors import ValidationError
from umbra.functions import checks
from umbra.operators import detect

ENTITY = "entity_type: string, start: int, end: int, confidence: double, text: string"


def _luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _card(text: str) -> bool:
    return 13 <= len(_digits(text)) <= 19 and _luhn(_digits(text))


def _phone(text: str) -> bool:
    return 7 <= len(_digits(text)) <= 15


def _octets(text: str) -> bool:
    return all(int(p) <= 255 for p in text.split("."))


def _iban(text: str) -> bool:
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


#: The recognizers' checks as functions of one text.
CHECKS: dict[Callable, Callable[[str], bool]] = {detect.card: _card, detect.phone: _phone, detect.octets: _octets, checks.iban: _iban}


def finder(recognizers=detect.RECOGNIZERS) -> Callable[[str | None], list[tuple[str, int, int, float, str]]]:
    """find(text) -> entities in the order of detect.detect()."""
    own = []
    for r in recognizers:
        if not isinstance(r, detect.Recognizer) or r.check is not None and r.check not in CHECKS:
            raise ValidationError(f"{r.entity_type} has no form for SQL")
        own.append((r.entity_type, re.compile(r.pattern.replace(r"\b", detect._BOUNDARY)), r.score, CHECKS.get(r.check), r.needs))

    def find(text: str | None) -> list[tuple[str, int, int, float, str]]:
        out = []
        for kind, pattern, score, check, needs in own:
            if text and (not needs or needs in text):
                out += [(kind, m.start(), m.end(), score, m.group()) for m in pattern.finditer(text) if check is None or check(m.group())]
        return sorted(out, key=lambda s: (s[1], s[2], -s[3], s[0]))

    return find


def register(spark: SparkSession, recognizers=detect.RECOGNIZERS, replacements: dict[str, str] | None = None) -> None:
    """detect_pii(text), a table function, and mask_pii(text), which puts a type's replacement (else its name in brackets) in
    the place of each entity, the first and of those the surest."""
    find = finder(recognizers)
    names = dict(replacements or {})

    class DetectPii:
        def eval(self, text: str):
            yield from find(text)

    spark.udtf.register("detect_pii", F.udtf(DetectPii, returnType=ENTITY, useArrow=True))

    @F.pandas_udf("string")
    def mask_pii(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _masked(t, find(t), names) for t in texts], dtype=object)

    spark.udf.register("mask_pii", mask_pii)


def _masked(text: str, found: list[tuple[str, int, int, float, str]], names: dict[str, str]) -> str:
    out, at = [], 0
    for kind, start, end, _, _ in sorted(found, key=lambda s: (s[1], -s[3], s[1] - s[2], s[0])):
        if start >= at:
            out += [text[at:start], names.get(kind, f"[{kind}]")]
            at = end
    return "".join([*out, text[at:]])
