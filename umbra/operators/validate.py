"""Checks of what comes in: arguments on the driver, rows as columns of messages."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.errors import TooManyFailures, ValidationError

# The files that can be converted, and the largest document.
SUFFIXES = (".pdf", ".docx", ".txt", ".md", ".html", ".json")
MAX_BYTES = 100 * 1024 * 1024
#: Failures from which a job should stop.
MAX_FAILURES = 0.3


def columns(df: DataFrame, **types: str) -> DataFrame:
    """df, if it has the columns with these types (simple names)."""
    have = dict(df.dtypes)
    wrong = [f"{name} {want}" for name, want in types.items() if have.get(name) != want]
    if wrong:
        raise ValidationError(f"missing columns: {', '.join(wrong)}", have=have)
    return df


def input_file(path: str, suffixes=SUFFIXES) -> Path:
    """An existing file of a known kind and a bearable size."""
    p = Path(path)
    if not p.is_file():
        raise ValidationError(f"no file {path}")
    if p.suffix.lower() not in suffixes:
        raise ValidationError(f"{p.suffix} is not among {', '.join(suffixes)}")
    if p.stat().st_size > MAX_BYTES:
        raise ValidationError(f"{path} is larger than 100 MB")
    return p


def entity_types(names) -> tuple[str, ...]:
    bad = [n for n in names if not re.fullmatch(r"[A-Z][A-Z0-9_]*", n)]
    if bad:
        raise ValidationError(f"no names of entity types: {bad}")
    return tuple(names)


def share(name: str, value: float) -> float:
    if not isinstance(value, int | float) or not 0 <= value <= 1:
        raise ValidationError(f"{name} is outside 0 to 1")
    return float(value)


def document_faults(documents: DataFrame) -> Column:
    """Messages about a document's row (doc_id, texts, tables)."""
    checks = {
        "no id": F.col("doc_id").isNull(),
        "no texts": F.col("texts").isNull() & F.col("tables").isNull(),
        "references repeat": F.size(F.array_distinct(F.transform(F.coalesce("texts", F.array()), lambda x: x["self_ref"]))) < F.size(F.coalesce("texts", F.array())),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))


def policy_faults(d: dict) -> list[str]:
    """Messages about a policy's file form."""
    out = []
    for name, kind in (("per_entity", dict), ("thresholds", dict), ("context_rules", dict), ("allow_list", list), ("deny_list", list)):
        if d.get(name) is not None and not isinstance(d[name], kind):
            out.append(f"{name} is no {kind.__name__}")
    for name, x in (d.get("thresholds") or {}).items() if isinstance(d.get("thresholds"), dict) else ():
        if not isinstance(x, int | float) or not 0 <= x <= 1:
            out.append(f"the threshold of {name} is outside 0 to 1")
    return out


def stop_on_failures(rows: DataFrame, error: str = "error", most: float = MAX_FAILURES) -> float:
    """The share of rows with an error; more than `most` raises.  Tasks that die are tried again by Spark itself."""
    rate = rows.agg(F.coalesce(F.avg(F.col(error).isNotNull().cast("int")), F.lit(0.0)).alias("r")).head()["r"]
    if rate > most:
        raise TooManyFailures(f"{rate:.0%} of all rows failed, {most:.0%} are borne", rate=rate)
    return rate
