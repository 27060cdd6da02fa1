"""Scalar text functions, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: node type -> context in which policy rules apply
CONTEXTS = {"Title": "heading", "SectionHeader": "heading", "List": "list", "Table": "table", "TableCell": "table", "Text": "paragraph", "KeyValue": "table", "KeyValueKey": "table", "KeyValueValue": "table", "Code": "code", "Formula": "formula"}
# Other names of entity types, and the confidence from which a type counts by default.
ALIASES = {
    "CREDIT_CARD": "CREDIT_CARD",
    "EMAIL_ADDRESS": "EMAIL",
    "EMAIL": "EMAIL",
    "PHONE_NUMBER": "PHONE_NUMBER",
    "PHONE": "PHONE_NUMBER",
    "PERSON": "PERSON",
    "LOCATION": "LOCATION",
    "DATE_TIME": "DATE_TIME",
    "IP_ADDRESS": "IP_ADDRESS",
    "US_SSN": "US_SSN",
    "SSN": "US_SSN",
    "IBAN": "IBAN",
    "URL": "URL",
    "MEDICAL_LICENSE": "MEDICAL_LICENSE",
    "US_DRIVER_LICENSE": "US_DRIVER_LICENSE",
    "ORGANIZATION": "ORGANIZATION",
    "ADDRESS": "ADDRESS",
    "CURRENCY": "CURRENCY",
    "AGE": "AGE",
}
THRESHOLDS = {"CREDIT_CARD": 0.7, "EMAIL": 0.5, "PHONE_NUMBER": 0.6, "US_SSN": 0.8, "PERSON": 0.6, "LOCATION": 0.5, "DATE_TIME": 0.5, "IP_ADDRESS": 0.7, "URL": 0.5, "IBAN": 0.7}
DEFAULT_THRESHOLD = 0.6


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def context_of(node_type: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(CONTEXTS), node_type), F.lit("paragraph"))


def entity_type(name: Column) -> Column:
    upper = F.upper(name)
    return F.coalesce(F.try_element_at(literal_map(ALIASES), upper), upper)


def default_threshold(name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(THRESHOLDS), entity_type(name)), F.lit(DEFAULT_THRESHOLD))


def normalise_whitespace(text: Column, aggressive: bool = False) -> Column:
    """Conservative: CR LF as LF, 3 or more spaces as 2, 4 or more line feeds as 3.  Aggressive: runs as one space."""
    if aggressive:
        return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"\r", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r" {3,}", "  "), r"\n{4,}", "\n\n\n")


def format_pattern(text: Column) -> Column:
    """Each character's class: L letter, D digit, S white space, P other."""
    x = F.regexp_replace(text, r"[\p{L}]", "L")
    x = F.regexp_replace(x, r"[\p{Nd}]", "D")
    x = F.regexp_replace(x, r"[ \t\n\f\r]", "S")
    return F.regexp_replace(x, r"[^LDS]", "P")


def generic_template(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\p{L}]", "X"), r"[\p{Nd}]", "#")


def _at(text: Column, place: int) -> Column:
    return F.substring(text, place + 1, 1)


def phone_template(text: Column) -> Column:
    """Ten digits, or groups of three, three and four by hyphens; an area in parentheses; an international number; else
    an X for each digit, then all other characters."""
    n = F.char_length(text)
    plain = text.rlike(r"^[0-9]{10}$") | ((n == 12) & (_at(text, 3) == "-") & (_at(text, 7) == "-"))
    area = (n == 14) & text.startswith("(") & text.contains(")")
    digits = F.regexp_replace(text, r"[^0-9]", "")
    generic = F.concat(F.repeat(F.lit("X"), F.char_length(digits)), F.regexp_replace(text, r"[0-9]", ""))
    abroad = F.concat(F.lit("+X "), F.repeat(F.lit("X"), n - 3))
    return F.when(plain, F.lit("XXX-XXX-XXXX")).when(area, F.lit("(XXX) XXX-XXXX")).when(text.contains("+"), abroad).otherwise(generic)


def ssn_template(text: Column) -> Column:
    hyphens = (F.char_length(text) == 11) & (_at(text, 3) == "-") & (_at(text, 6) == "-")
    return F.when(hyphens, F.lit("XXX-XX-XXXX")).otherwise(F.regexp_replace(text, r"[0-9]", "X"))


def card_template(text: Column) -> Column:
    n, count = F.char_length(text), lambda c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    hyphens = text.rlike(r"^[0-9]{16}$") | ((n == 19) & (count("-") == 3))
    blanks = (n == 19) & (count(" ") == 3)
    return F.when(hyphens, F.lit("XXXX-XXXX-XXXX-XXXX")).when(blanks, F.lit("XXXX XXXX XXXX XXXX")).otherwise(F.regexp_replace(text, r"[0-9]", "X"))


def email_template(text: Column) -> Column:
    """The lengths of the user's name and of the domain's parts stay; without an @ a fixed mark."""
    user, domain = F.substring_index(text, "@", 1), F.regexp_replace(text, r"^[^@]*@", "")
    return F.when(F.instr(text, "@") == 0, F.lit("[EMAIL]")).otherwise(F.concat(F.repeat(F.lit("x"), F.char_length(user)), F.lit("@"), F.regexp_replace(domain, r"[^.]", "x")))


def structured_template(kind: Column, text: Column) -> Column:
    own = F.when(kind == "PHONE_NUMBER", phone_template(text)).when(kind == "US_SSN", ssn_template(text)).when(kind == "CREDIT_CARD", card_template(text)).when(kind == "EMAIL_ADDRESS", email_template(text)).otherwise(generic_template(text))
    return F.when(F.char_length(text) == 0, F.lit("[REDACTED]")).otherwise(own)


def detect_format(text: Column, path: Column) -> Column:
    """By content, then by the file's extension: json, html, xml, markdown or text."""
    t, ext = F.ltrim(text), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_ext = F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("html", "htm"), "html").when(ext == "json", "json").when(ext == "xml", "xml").otherwise("text")
    return F.when(t.startswith("{") | t.startswith("["), "json").when(F.lower(t).startswith("<!doctype html") | F.lower(t).startswith("<html"), "html").when(t.startswith("<?xml"), "xml").when(t.startswith("# ") | F.contains(t, F.lit("\n## ")), "markdown").otherwise(by_ext)
