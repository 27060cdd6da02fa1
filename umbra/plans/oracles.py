"""The queries of the catalogue as DuckDB SQL, written from the rules and not from the expressions."""

from __future__ import annotations

from umbra.operators import detect

from .names import SENTENCES

#: Recognizers whose spans lie across those of the others, so that there is something to resolve.
CROSSING = (
    detect.Recognizer("LOCATION", "[0-9.]{2,}", 0.6, first="0-9."),
    detect.Recognizer("PERSON", "[0-9]+@[a-z0-9]+", 0.97, first="0-9", needs="@"),
    detect.Recognizer("ORGANIZATION", "[a-z]+ [a-z.0-9]+@[a-z0-9.]+ [a-z]+", 0.5, first="a-z", needs="@"),
)
PATTERNS = {r.entity_type: r for r in (*detect.RECOGNIZERS, *CROSSING)}
SHORT = {"email": "EMAIL_ADDRESS", "phone": "PHONE_NUMBER", "card": "CREDIT_CARD", "ip": "IP_ADDRESS", "ssn": "US_SSN", "url": "URL", "date": "DATE_TIME", "iban": "IBAN_CODE"}
OTHERS = {"number": "LOCATION", "domain": "PERSON", "line": "ORGANIZATION"}
FOUR = ("email", "phone", "card", "ip")


def checked(name: str) -> str:
    """SQL for the recognizer's check on m."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    if name == "card":
        digit = f"CAST(substr({digits}, length({digits}) - i + 1, 1) AS INTEGER)"
        luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END ELSE {digit} END)) % 10 = 0"
        return f"length({digits}) BETWEEN 13 AND 19 AND {luhn}"
    if name == "phone":
        return f"length({digits}) BETWEEN 7 AND 15"
    if name == "ip":
        return "len(list_filter(str_split(m, '.'), lambda p: CAST(p AS INTEGER) > 255)) = 0"
    if name == "iban":
        moved = "substr(m, 5) || substr(m, 1, 4)"
        numbers = f"array_to_string(list_transform(str_split({moved}, ''), lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
        return f"length(m) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(str_split({numbers}, ''), lambda c: CAST(c AS INTEGER))), lambda a, d: (a * 10 + d) % 97) = 1"
    return "TRUE"


def detected(name: str) -> str:
    r = PATTERNS[(SHORT | OTHERS)[name]]
    return f"""SELECT doc_id, lang, entity_type, "start", "end", confidence, m AS text FROM (
  SELECT doc_id, lang, '{r.entity_type}' AS entity_type, CAST({r.score} AS DOUBLE) AS confidence, m,
    CAST(sum(length(g) + length(m)) OVER w - length(m) AS INTEGER) AS "start", CAST(sum(length(g) + length(m)) OVER w AS INTEGER) AS "end"
  FROM (SELECT doc_id, lang, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, lang, regexp_extract_all(text, '{r.pattern}') AS ms, regexp_split_to_array(text, '{r.pattern}') AS gs FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {checked(name)}"""


def entities(*names: str) -> str:
    return "(" + " UNION ALL ".join(f"({detected(n)})" for n in names) + ")"


E = entities(*FOUR)
ALL = entities(*SHORT)
MIXED = entities(*SHORT, *OTHERS)


def swept(e: str, order: str = '"start", confidence DESC, "start" - "end"', prefix: str = "", extra: str = "") -> str:
    """WITH clauses whose last, kept, has the entities that are kept in turn if they start at or after the last end."""
    return f"""WITH RECURSIVE {prefix} found AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS k FROM {e}),
 walk AS (SELECT doc_id, k, "end" AS reach, TRUE AS ok FROM found WHERE k = 1
   UNION ALL SELECT f.doc_id, f.k, CASE WHEN f."start" >= w.reach THEN f."end" ELSE w.reach END, f."start" >= w.reach FROM walk w JOIN found f ON f.doc_id = w.doc_id AND f.k = w.k + 1),
 kept AS MATERIALIZED (SELECT f.* FROM found f JOIN walk w ON f.doc_id = w.doc_id AND f.k = w.k WHERE w.ok){extra}"""


def disjoint(e: str, order: str) -> str:
    """WITH clauses whose last, kept, has the entities that are kept in turn if they touch none that was kept."""
    return f"""WITH RECURSIVE found AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS k FROM {e}),
 walk AS (SELECT doc_id, k, [{{'a': "start", 'b': "end"}}] AS held, TRUE AS ok FROM found WHERE k = 1
   UNION ALL SELECT doc_id, k, CASE WHEN free THEN list_append(held, {{'a': s, 'b': e}}) ELSE held END, free FROM (
     SELECT f.doc_id, f.k, w.held, f."start" AS s, f."end" AS e, len(list_filter(w.held, lambda y: y.a < f."end" AND f."start" < y.b)) = 0 AS free FROM walk w JOIN found f ON f.doc_id = w.doc_id AND f.k = w.k + 1)),
 kept AS (SELECT f.* FROM found f JOIN walk w ON f.doc_id = w.doc_id AND f.k = w.k WHERE w.ok)"""


PRIORITY = "CASE WHEN entity_type IN ('US_SSN', 'CREDIT_CARD', 'US_PASSPORT', 'US_DRIVER_LICENSE') THEN 1 WHEN entity_type IN ('PHONE_NUMBER', 'EMAIL_ADDRESS', 'IBAN_CODE', 'US_BANK_NUMBER') THEN 2 WHEN entity_type IN ('URL', 'IP_ADDRESS', 'DATE_TIME', 'MEDICAL_LICENSE') THEN 4 ELSE 3 END"
TIES = 'entity_type, "start", "end", confidence'
ORDERS = {
    "score_first": f'confidence DESC, "start", {TIES}',
    "longest": f'"start" - "end", "start", {TIES}',
    "most_specific": f'{PRIORITY}, confidence DESC, "start", {TIES}',
    "first": f'"start", "end", {TIES}',
    "sure_and_long": f'confidence DESC, "start" - "end", "start", {TIES}',
}

# The default policy's replacement of a text by its type.
DEFAULT = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN '[EMAIL]' WHEN 'PHONE_NUMBER' THEN '[PHONE]' WHEN 'CREDIT_CARD' THEN '[CARD-****]' WHEN 'IP_ADDRESS' THEN '[IP]' END"


def spliced(replacement: str) -> str:
    """WITH clauses whose last, done, has doc_id, text, masked and n of every document."""
    return swept(E, extra=f""",
 made AS MATERIALIZED (SELECT *, {replacement} AS new, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS i, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY "start") AS before FROM kept),
 done AS MATERIALIZED (SELECT d.doc_id, d.text, coalesce(m.n, 0) AS n, CASE WHEN m.n IS NULL THEN d.text ELSE m.head || substr(d.text, m.last + 1) END AS masked FROM documents d LEFT JOIN (
   SELECT p.doc_id, count(*) AS n, max(p."end") AS last, string_agg(substr(x.text, p.before + 1, p."start" - p.before) || p.new, '' ORDER BY p.i) AS head FROM made p JOIN documents x ON x.doc_id = p.doc_id GROUP BY p.doc_id) m ON m.doc_id = d.doc_id),
 anchored AS MATERIALIZED (SELECT *, '#/texts/0' AS node_id, "start" + coalesce(sum(length(new) - ("end" - "start")) OVER (PARTITION BY doc_id ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS masked_start,
   concat_ws(':', doc_id, '#/texts/0', entity_type, "start") AS key FROM made)""")


MASKED = spliced(DEFAULT)


# Strategies, as SQL of entity_type and text.


def plain_partial(n: int, where: str, char: str = "*") -> str:
    stars = f"repeat('{char}', CAST(length(text) - {n} AS INTEGER))"
    shown = {"end": f"{stars} || substr(text, length(text) - {n - 1})", "start": f"substr(text, 1, {n}) || {stars}", "middle": f"substr(text, 1, {n - n // 2}) || {stars} || substr(text, length(text) - {n // 2 - 1})"}[where]
    few = f"CASE WHEN length(text) <= 2 THEN repeat('{char}', CAST(length(text) AS INTEGER)) ELSE text[1] || repeat('{char}', CAST(length(text) - 2 AS INTEGER)) || text[-1] END"
    return f"CASE WHEN length(text) <= {n} THEN {few} ELSE {shown} END"


MARKS = "'-_.@ ()+'"


def aware_partial(shown: str) -> str:
    """shown: SQL that says of the rank r among t other characters whether it stays."""
    others = f"length(translate(text, {MARKS}, ''))"
    rank = f"length(translate(substr(text, 1, i), {MARKS}, ''))"
    stays = shown.replace("$r", rank).replace("$t", others)
    return f"CASE WHEN {others} <= 4 THEN text ELSE list_aggregate(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN contains({MARKS}, substr(text, i, 1)) OR {stays} THEN substr(text, i, 1) ELSE '*' END), 'string_agg', '') END"


PHONE_FORM = r"""CASE WHEN regexp_full_match(text, '[0-9]{10}') OR (length(text) = 12 AND text[4] = '-' AND text[8] = '-') THEN 'XXX-XXX-XXXX'
 WHEN length(text) = 14 AND text LIKE '(%' AND text LIKE '%)%' THEN '(XXX) XXX-XXXX' WHEN text LIKE '%+%' THEN '+X ' || repeat('X', CAST(length(text) - 3 AS INTEGER))
 ELSE repeat('X', CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS INTEGER)) || regexp_replace(text, '[0-9]', '', 'g') END"""
CARD_FORM = """CASE WHEN regexp_full_match(text, '[0-9]{16}') OR (length(text) = 19 AND len(str_split(text, '-')) = 4) THEN 'XXXX-XXXX-XXXX-XXXX'
 WHEN length(text) = 19 AND len(str_split(text, ' ')) = 4 THEN 'XXXX XXXX XXXX XXXX' ELSE regexp_replace(text, '[0-9]', 'X', 'g') END"""
EMAIL_FORM = "repeat('x', CAST(strpos(text, '@') - 1 AS INTEGER)) || '@' || regexp_replace(substr(text, strpos(text, '@') + 1), '[^.]', 'x', 'g')"
GENERIC_FORM = r"regexp_replace(regexp_replace(text, '\p{L}', 'X', 'g'), '\p{Nd}', '#', 'g')"
FORM = f"CASE entity_type WHEN 'PHONE_NUMBER' THEN {PHONE_FORM} WHEN 'CREDIT_CARD' THEN {CARD_FORM} WHEN 'EMAIL_ADDRESS' THEN {EMAIL_FORM} ELSE {GENERIC_FORM} END"
CLASSES = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\p{L}', 'L', 'g'), '\p{Nd}', 'D', 'g'), '[ \t\n\f\r]', 'S', 'g'), '[^LDS]', 'P', 'g')"


def salted(salt: str = "", own: str | None = None) -> str:
    parts = [f"'{salt}'", *([own] if own else []), "'len:' || CAST(length(text) AS VARCHAR)", "'type:' || entity_type"]
    return "text || " + " || '|' || ".join(parts)


def offset(algorithm: str, room: int) -> str:
    """Where a truncated digest begins: the first 28 bits of a SHA-256, by its hexadecimal digits."""
    h = f"sha256(text || '{algorithm}')"
    number = " + ".join(f"(strpos('0123456789abcdef', substr({h}, {i + 1}, 1)) - 1) * {16 ** (6 - i)}" for i in range(7))
    return f"CAST(({number}) % {room} AS INTEGER)"


def truncated(digest: str, algorithm: str, n: int, room: int) -> str:
    return f"substr({digest}, {offset(algorithm, room)} + 1, {n})"


OWN_SALT = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'e1' ELSE 'd1' END"
# Delimiters at proportional places of a digest of 64 digits; places differ, as the texts are shorter than that.
STRUCTURE = f"""list_aggregate(list_transform(range(0, 64), lambda p: coalesce(
 list_filter(list_transform(range(0, length(text)), lambda i: CASE WHEN contains({MARKS}, substr(text, i + 1, 1)) AND least(CAST(floor(CAST(i AS DOUBLE) / length(text) * 64) AS INTEGER), 63) = p THEN substr(text, i + 1, 1) END), lambda c: c IS NOT NULL)[1],
 substr(sha256({salted()}), p + 1, 1))), 'string_agg', '')"""

STRATEGIES = {
    "redact": "repeat('*', CAST(length(text) AS INTEGER))",
    "redact_fixed": "'########'",
    "template": "'[' || entity_type || ':' || CAST(length(text) AS VARCHAR) || ']'",
    "template_form": f"'<' || {CLASSES} || '>'",
    "template_format": FORM,
    "template_merge_mark": "'[PII:' || CAST(length(text) AS VARCHAR) || ']'",
    "template_merge_format": f"'~' || {FORM}",
    "hash_sha256": f"sha256({salted()})",
    "hash_salted": f"'h_' || {truncated(f'sha256({salted("pepper")})', 'sha256', 16, 48)}",
    "hash_prefix": f"substr(sha256({salted('pepper')}), 1, 12)",
    "hash_entity_salt": f"sha256({salted('', OWN_SALT)})",
    "hash_md5": f"md5({salted()})",
    "hash_sha1": f"sha1({salted()})",
    "hash_base64": f"base64(unhex(sha256({salted()})))",
    "hash_structure": STRUCTURE,
    "operator_hash": "substr('op_' || sha256(text || 'x'), 1, 20)",
    "operator_partial": "CASE WHEN length(text) <= 4 THEN text ELSE repeat('*', CAST(length(text) - 4 AS INTEGER)) || substr(text, length(text) - 3) END",
    "partial_end": plain_partial(4, "end"),
    "partial_start": plain_partial(3, "start", "X"),
    "partial_middle": plain_partial(4, "middle"),
    "partial_long": plain_partial(30, "end"),
    "partial_short": "CASE WHEN length(text) < 12 THEN repeat('*', CAST(length(text) AS INTEGER)) ELSE " + plain_partial(4, "end") + " END",
    "partial_format": aware_partial("$r > $t - 4"),
    "partial_format_start": aware_partial("$r <= 4"),
    "partial_format_middle": aware_partial("($r <= 2 OR $r > $t - 2)"),
    "compose": f"md5(repeat('*', CAST(length(text) AS INTEGER)) || '|len:' || CAST(length(text) AS VARCHAR) || '|type:' || entity_type)",
}

LINES = r"""(SELECT doc_id, ordinal, t, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM (
  SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS ordinal, unnest(l) AS t FROM (SELECT doc_id, str_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(t, '\S'))"""


def islands(by: str, gap: int, e: str = E) -> str:
    return f"""(SELECT *, sum(o) OVER (PARTITION BY {by} ORDER BY "start", "end", entity_type ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY {by} ORDER BY "start", "end", entity_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS o FROM {e}))"""


HIGHEST = f"""(SELECT * FROM (SELECT *, count(*) FILTER (WHERE confidence >= 0.95) OVER (PARTITION BY doc_id, island) AS n,
      row_number() OVER (PARTITION BY doc_id, island ORDER BY confidence DESC, "start", "end", entity_type) AS r FROM {islands('doc_id', 4, MIXED)}) WHERE CASE WHEN n > 0 THEN confidence >= 0.95 ELSE r = 1 END)"""
COLUMN = "CASE WHEN length({c}) > 3 THEN repeat('*', CAST(length({c}) - 3 AS INTEGER)) || substr({c}, length({c}) - 2) WHEN length({c}) <= 2 THEN repeat('*', CAST(length({c}) AS INTEGER)) ELSE {c}[1] || '*' || {c}[-1] END"
ESCAPED = "replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
ALIASED = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' ELSE entity_type END"


def sql() -> dict[str, str]:
    out = {f"detect_{n}": detected(n) for n in SHORT}
    out |= {f"mask_{n}": f'SELECT doc_id, entity_type, "start", {s} AS masked FROM {E}' for n, s in STRATEGIES.items()}
    out |= {f"overlap_{n}": f'{disjoint(MIXED, o)} SELECT doc_id, entity_type, "start", "end", confidence FROM kept' for n, o in ORDERS.items()}
    out["overlap_greedy"] = f'{swept(MIXED, order=chr(34) + "start" + chr(34) + ", confidence DESC, " + chr(34) + "start" + chr(34) + " - " + chr(34) + "end" + chr(34) + ", entity_type")} SELECT doc_id, entity_type, "start", "end", confidence FROM kept'
    out["overlap_start_and_score"] = f"""{swept(MIXED, order='"start", confidence DESC, entity_type, "start" - "end"')} SELECT doc_id, entity_type, "start", "end", confidence FROM kept"""
    out["mask_documents_default"] = f"{MASKED} SELECT doc_id, CAST(n AS INTEGER) AS n_spans, sha256(masked) AS masked_sha256, CAST(length(masked) AS BIGINT) AS masked_chars FROM done"
    out["mask_mixed_policy"] = spliced(f"CASE entity_type WHEN 'EMAIL_ADDRESS' THEN {EMAIL_FORM} WHEN 'CREDIT_CARD' THEN 'CC_' || {truncated('sha256(' + salted('', repr('cc_secure_v1')) + ')', 'sha256', 12, 52)} WHEN 'IP_ADDRESS' THEN repeat('*', CAST(length(text) AS INTEGER)) END").replace(
        f"FROM {E}", f"FROM (SELECT * FROM {E} WHERE confidence >= CASE entity_type WHEN 'PHONE_NUMBER' THEN 0.8 WHEN 'EMAIL_ADDRESS' THEN 0.7 WHEN 'CREDIT_CARD' THEN 0.9 ELSE 0.5 END)") + " SELECT doc_id, sha256(masked) AS masked_sha256 FROM done"
    out["mask_custom"] = spliced("'<' || lower(entity_type) || ' ' || CAST(length(text) AS VARCHAR) || '>'") + " SELECT doc_id, sha256(masked) AS masked_sha256 FROM done"
    out["mask_with_fallbacks"] = spliced("CASE WHEN entity_type = 'IP_ADDRESS' OR length(text) % 2 = 0 THEN '[' || entity_type || ']' ELSE '<' || lower(entity_type) || ' ' || CAST(length(text) AS VARCHAR) || '>' END") + " SELECT doc_id, sha256(masked) AS masked_sha256 FROM done"
    out["mask_surrogate"] = f"""{swept(E)} SELECT doc_id, entity_type, "start", TRUE AS keeps_form, TRUE AS differs, TRUE AS found_again FROM kept"""
    out["unmask_roundtrip"] = out["unmask_by_anchors"] = "SELECT doc_id, TRUE AS same FROM documents"
    key = "substr(sha256(':' || key), 1, 16)"
    out["anchors_build"] = f"""{MASKED} SELECT doc_id, node_id, "start", "end", entity_type, new AS masked_value, 'repl_' || substr(sha256(key), 1, 16) AS replacement_id, sha256({key} || text) AS original_checksum FROM anchored"""
    out["replacements_list"] = f"""{MASKED} SELECT d.doc_id, coalesce((SELECT string_agg(a."start" || ':' || a."end" || ':' || a.new, ',' ORDER BY a."start") FROM anchored a WHERE a.doc_id = d.doc_id), '') AS replacements FROM done d"""
    out["cloakmap_stats"] = f"""{MASKED} SELECT entity_type, count(*) AS n, round(avg(confidence), 10) AS avg_confidence, CAST(sum("end" - "start") AS BIGINT) AS original_chars, CAST(sum(length(new)) AS BIGINT) AS masked_chars, CAST(sum(length(new) - ("end" - "start")) AS BIGINT) AS delta FROM anchored GROUP BY entity_type"""
    out["cloakmap_build"] = f"{MASKED} SELECT doc_id, '2.0' AS version, sha256(coalesce(text, '')) AS doc_hash, CAST(n AS INTEGER) AS n_anchors FROM done"
    out["cloakmap_flags"] = f"{MASKED} SELECT doc_id, TRUE AS reversible, TRUE AS v2, n > 0 AS with_operators, FALSE AS encrypted, FALSE AS signed, '' AS errors, CASE WHEN n = 0 THEN 'nothing was masked' ELSE '' END AS warnings FROM done"
    out["cloakmap_round_trip"] = f"{MASKED} SELECT doc_id, CAST(n AS INTEGER) AS n_anchors, TRUE AS same FROM done"
    out["cloakmap_counts"] = f"{MASKED} SELECT doc_id, entity_type, count(*) AS n FROM anchored GROUP BY doc_id, entity_type"
    out["checksum_verify"] = f"{MASKED} SELECT TRUE AS ok, count(*) AS n FROM anchored"
    out["anchor_resolve"] = f'{MASKED} SELECT doc_id, "start", CAST(masked_start AS INTEGER) AS masked_start, CAST(masked_start AS INTEGER) AS found, 0 AS delta, CAST(1.0 AS DOUBLE) AS confidence FROM anchored'
    out["anchor_resolve_statistics"] = f"{MASKED} SELECT entity_type, count(*) AS anchors, count(*) AS found, CAST(1 AS DOUBLE) AS success_rate, count(*) AS sure, CAST(0 AS BIGINT) AS likely, CAST(0 AS BIGINT) AS weak, CAST(0 AS DOUBLE) AS avg_delta, 0 AS max_delta FROM anchored GROUP BY entity_type"
    # The nearest place of the value within 100 characters of the expected one, in the edited text.
    edited = f"""{MASKED},
 looked AS MATERIALIZED (SELECT a.doc_id, a."start", a.entity_type, CAST(a.masked_start AS BIGINT) AS expected, a.new, a.text, CASE WHEN a.doc_id % 6 <> 5 THEN
   repeat('z', CASE a.doc_id % 6 WHEN 1 THEN 12 WHEN 2 THEN 33 WHEN 3 THEN 70 ELSE 0 END) || CASE WHEN a.doc_id % 6 = 4 THEN replace(d.masked, '[EMAIL]', '') ELSE d.masked END END AS t FROM anchored a JOIN done d ON d.doc_id = a.doc_id),
 placed AS (SELECT *, list_filter(range(greatest(expected - 100, 0), least(expected + 100, length(t) - length(new)) + 1), lambda i: substr(t, i + 1, length(new)) = new) AS hits FROM looked),
 best AS (SELECT *, list_min(list_transform(hits, lambda i: abs(i - expected))) AS delta FROM placed),
 sure AS (SELECT *, CASE WHEN delta = 0 THEN 1.0 WHEN delta <= 20 THEN 1 - delta / 100 ELSE (1 - delta / 100) * 0.8 END AS confidence FROM best),
 resolved AS MATERIALIZED (SELECT *, CASE WHEN confidence >= 0.5 THEN list_filter(hits, lambda i: abs(i - expected) = delta)[1] END AS found FROM sure),
 told AS (SELECT doc_id, "start", entity_type, CAST(found AS INTEGER) AS found, CAST(delta AS INTEGER) AS delta, round(CAST(confidence AS DOUBLE), 6) AS confidence, CASE WHEN found IS NOT NULL THEN NULL WHEN t IS NULL THEN 'node not found' WHEN delta IS NULL THEN 'value not found' ELSE 'confidence too low' END AS reason FROM resolved)"""
    out["anchor_resolve_edited"] = f"{edited} SELECT * FROM told"
    out["restoration_by_reason"] = f"""{edited} SELECT entity_type, count(*) AS anchors, count(found) AS restored, count(found) AS verified, count(*) FILTER (WHERE reason = 'node not found') AS no_node, count(*) FILTER (WHERE reason = 'value not found') AS no_value, count(*) FILTER (WHERE reason = 'confidence too low') AS unsure FROM told GROUP BY entity_type"""
    out["maps_sealed"] = "SELECT doc_id, TRUE AS same, CAST(NULL AS VARCHAR) AS error, 'tampered' AS error_of_bent FROM documents"
    out["restore_edited"] = "SELECT doc_id, sha256('new ' || text) AS sha256 FROM documents"
    out["integrity"] = f"{MASKED} SELECT doc_id, TRUE AS valid, CAST(0 AS BIGINT) AS failed FROM anchored GROUP BY doc_id"
    out["entity_counts_by_type"] = f"SELECT entity_type, count(*) AS n, count(DISTINCT text) AS n_texts FROM {E} GROUP BY entity_type"
    out["detect_by_sql"] = f'SELECT doc_id, entity_type, "start", "end", confidence, text FROM {ALL}'
    out["entity_counts_by_lang"] = f"SELECT lang, entity_type, count(*) AS n FROM {E} GROUP BY lang, entity_type"
    out["entity_counts_by_doc"] = f"SELECT doc_id, count(*) AS n FROM {E} GROUP BY doc_id"
    out["entity_type_names"] = f'SELECT doc_id, "start", {ALIASED} AS entity_type FROM {ALL}'
    out["above_default_thresholds"] = f"""SELECT doc_id, entity_type, "start" FROM {ALL} WHERE confidence >= CASE {ALIASED} WHEN 'CREDIT_CARD' THEN 0.7 WHEN 'EMAIL' THEN 0.5 WHEN 'PHONE_NUMBER' THEN 0.6 WHEN 'US_SSN' THEN 0.8 WHEN 'DATE_TIME' THEN 0.5 WHEN 'IP_ADDRESS' THEN 0.7 WHEN 'URL' THEN 0.5 ELSE 0.6 END"""
    out["entities_numbered"] = f"""SELECT doc_id, "start", entity_type, 'repl_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", entity_type) AS VARCHAR), 6, '0') AS replacement_id FROM {E}"""
    out["analysis_by_document"] = f"SELECT d.doc_id, count(DISTINCT d.doc_id) AS segments, CAST(count(e.doc_id) AS BIGINT) AS entities, CAST(0 AS BIGINT) AS errors, CAST(1 AS DOUBLE) AS success_rate FROM documents d LEFT JOIN (SELECT * FROM {ALL} WHERE confidence >= 0.8) e ON e.doc_id = d.doc_id GROUP BY d.doc_id"
    out["entities_by_lists"] = f"""SELECT doc_id, "start", CASE WHEN text IN (SELECT text FROM {E} WHERE entity_type = 'IP_ADDRESS' AND text LIKE '1%') THEN 'deny' WHEN text IN (SELECT text FROM {E} WHERE entity_type = 'IP_ADDRESS') THEN 'allow' END AS listed FROM {E}"""
    out["entities_paired"] = f"""{MASKED} SELECT f.doc_id, f."start", f."end", f.entity_type AS original_type, m.entity_type AS masked_type, m.new AS masked_text FROM found f LEFT JOIN made m ON m.doc_id = f.doc_id AND m."start" = f."start" AND m."end" = f."end" """
    out["overlap_islands"] = f'SELECT doc_id, CAST(island AS BIGINT) AS island, min("start") AS "start", max("end") AS "end", count(*) AS n FROM {islands("doc_id", 200)} GROUP BY doc_id, island'
    out["resolve_merge_adjacent"] = f"""SELECT doc_id, entity_type, min("start") AS "start", max("end") AS "end", count(*) AS parts, string_agg(text, '' ORDER BY "start", "end") AS text FROM {islands("doc_id, entity_type", 200)} GROUP BY doc_id, entity_type, island"""
    out["resolve_highest_confidence"] = f'SELECT doc_id, entity_type, "start", "end" FROM {HIGHEST}'
    out["normalise_counts"] = f"SELECT CAST(sum(n) AS BIGINT) AS entities, count(*) AS groups, count(*) FILTER (WHERE n > 1) AS conflicts, (SELECT count(*) FROM {HIGHEST}) AS kept FROM (SELECT doc_id, island, count(*) AS n FROM {islands('doc_id', 4, MIXED)} GROUP BY doc_id, island)"
    out["normalisation_lost"] = f"""{disjoint(MIXED, ORDERS['longest'])} SELECT f.doc_id, f."start", f."end", 'lost' AS fault FROM (SELECT DISTINCT doc_id, "start", "end" FROM found WHERE confidence >= 0.95) f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = f.doc_id AND k."start" <= f."start" AND k."end" >= f."end")"""
    out["policy_threshold"] = f"""SELECT doc_id, entity_type, "start", "end", confidence, text FROM {E} WHERE confidence >= CASE entity_type WHEN 'PHONE_NUMBER' THEN 0.8 WHEN 'EMAIL_ADDRESS' THEN 0.5 ELSE 0.86 END"""
    out["policy_lists_and_length"] = f"""SELECT doc_id, entity_type, "start", "end", confidence, text FROM {E} WHERE text = '1.1.1.1' OR (text <> '4952935900253052' AND length(text) >= 15)"""
    out["policy_contexts"] = f"""SELECT doc_id, entity_type, "start", CASE WHEN doc_id % 3 = 0 THEN 'heading' WHEN doc_id % 3 = 1 THEN 'table' ELSE 'paragraph' END AS context, CASE WHEN doc_id % 3 = 0 THEN '[HEAD]' WHEN entity_type = 'EMAIL_ADDRESS' THEN '[E]' ELSE repeat('*', CAST(length(text) AS INTEGER)) END AS masked FROM {E}
      WHERE doc_id % 3 <> 1 AND confidence >= CASE WHEN doc_id % 3 = 0 THEN CASE entity_type WHEN 'PHONE_NUMBER' THEN 0.7 ELSE 0.88 END ELSE 0.8 END"""
    out["format_template"] = f"SELECT doc_id, sha256({GENERIC_FORM}) AS sha256 FROM documents"
    out["format_pattern"] = f"SELECT doc_id, sha256({CLASSES}) AS sha256 FROM documents"
    out["normalise_whitespace_aggressive"] = r"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'))) AS sha256 FROM documents"
    out["normalise_whitespace"] = r"SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' {3,}', '  ', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')) AS sha256 FROM documents"
    out["segment_offsets"] = f"SELECT doc_id, ordinal, start_offset, start_offset + length(t) AS end_offset FROM {LINES}"
    out["full_text"] = f"SELECT doc_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY ordinal)) AS sha256 FROM {LINES} GROUP BY doc_id"
    out["document_hash"] = f"SELECT doc_id, sha256(string_agg(t, '' ORDER BY ordinal)) AS doc_hash FROM {LINES} GROUP BY doc_id"
    out["extraction_statistics"] = f"SELECT doc_id, 'Text' AS node_type, count(*) AS nodes, CAST(sum(length(t)) AS BIGINT) AS chars FROM {LINES} GROUP BY doc_id"
    spans = f"""(SELECT e.doc_id, l.ordinal, l.start_offset, l.start_offset + length(l.t) AS end_offset, e."start", e."end" FROM (
      SELECT doc_id, ordinal, CAST(start_offset + 1 AS BIGINT) AS "start", CAST(start_offset + 6 AS BIGINT) AS "end" FROM {LINES}) e JOIN {LINES} l ON l.doc_id = e.doc_id AND l.ordinal = e.ordinal)"""
    out["place_in_node"] = f"""SELECT doc_id, "start", "end", CASE WHEN "end" <= end_offset THEN '#/texts/' || ordinal END AS node_id, CASE WHEN "end" <= end_offset THEN "start" - start_offset END AS node_start, CASE WHEN "end" <= end_offset THEN "end" - start_offset END AS node_end FROM {spans}"""
    out["place_in_text"] = f"SELECT doc_id, ordinal, start_offset + 1 AS start, start_offset + 3 AS \"end\" FROM {LINES}"
    out["clamped_spans"] = f"""SELECT doc_id, ordinal, CAST(start_offset AS INTEGER) AS "start", CAST(start_offset + length(t) AS INTEGER) AS "end" FROM {LINES}"""
    joined = entities(*FOUR).replace("FROM documents", f"FROM (SELECT doc_id, '' AS lang, string_agg(t, chr(10) || chr(10) ORDER BY ordinal) AS text FROM {LINES} GROUP BY doc_id)")
    lines = f"""(SELECT doc_id, '#/texts/' || ordinal AS node_id, start_offset, start_offset + length(t) AS end_offset FROM {LINES})"""
    out["entities_in_lines"] = f"""SELECT e.doc_id, e.entity_type, e."start", e."end", l.node_id, e."start" - l.start_offset AS node_start, e."end" - l.start_offset AS node_end FROM {joined} e LEFT JOIN {lines} l ON l.doc_id = e.doc_id AND e."start" >= l.start_offset AND e."end" <= l.end_offset"""
    out["anchors_of_lines"] = f"""SELECT e.doc_id, e.entity_type, e."start", e."end" + 30 AS "end", l.node_id AS segment_id, e."start" - l.start_offset AS local_start, least(e."end" + 30, l.end_offset) - l.start_offset AS local_end FROM {joined} e JOIN {lines} l ON l.doc_id = e.doc_id AND e."start" >= l.start_offset AND e."start" < l.end_offset"""
    out["spans_overlapping"] = f"""SELECT a.doc_id, a.entity_type, a."start", a."end", b.entity_type AS entity_type_b, b."start" AS start_b, b."end" AS end_b FROM {ALL} a JOIN {entities(*OTHERS)} b ON b.doc_id = a.doc_id AND greatest(a."start", b."start") < least(a."end", b."end")"""
    out["render_markdown"] = f"SELECT doc_id, sha256(string_agg(replace(replace(replace(t, '[***]', '\\[***\\]'), '[___]', '\\[___\\]'), '[###]', '\\[###\\]'), chr(10) || chr(10) ORDER BY ordinal)) AS sha256 FROM {LINES} GROUP BY doc_id"
    out["render_xml"] = f"SELECT doc_id, sha256('<?xml version=\"1.0\" encoding=\"UTF-8\"?><document>' || string_agg('<node id=\"#/texts/' || ordinal || '\" type=\"Text\">' || {ESCAPED} || '</node>', '' ORDER BY ordinal) || '</document>') AS sha256 FROM {LINES} GROUP BY doc_id"
    style = "<style>.masked{background:#eee;border:1px solid #999;padding:0 2px}</style>"
    marked = f"replace(replace(replace(string_agg('<p>' || {ESCAPED} || '</p>', chr(10) ORDER BY ordinal), '[REDACTED]', '<span class=\"masked\">[REDACTED]</span>'), '[MASKED]', '<span class=\"masked\">[MASKED]</span>'), '[***]', '<span class=\"masked\">[***]</span>')"
    out["render_html_document"] = f"SELECT doc_id, sha256('<!DOCTYPE html><html><head>{style}</head><body>' || {marked} || '</body></html>') AS sha256 FROM {LINES} GROUP BY doc_id"
    listed = " UNION ".join(f"SELECT array_to_string(w[{a}:{a + n - 1}], ' ') AS phrase FROM (SELECT str_split(text, ' ') AS w FROM benchmark)" for a, n in ((1, 2), (1, 3), (4, 2), (5, 3), (9, 2)))
    token = r"[\p{L}\p{N}_]+|[ \t\n\f\r]+|[^\p{L}\p{N}_ \t\n\f\r]"
    prefix = f"""phrases AS MATERIALIZED (SELECT phrase FROM ({listed}) WHERE regexp_full_match(phrase, '[A-Za-z0-9]+( [A-Za-z0-9]+)+')),
 tok AS MATERIALIZED (SELECT doc_id, t, i, CAST(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) AS INTEGER) AS "start" FROM (SELECT doc_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{token}') AS ts FROM documents))),
 wide AS (SELECT doc_id, "start", t || lead(t, 1, '') OVER w || lead(t, 2, '') OVER w AS three, t || lead(t, 1, '') OVER w || lead(t, 2, '') OVER w || lead(t, 3, '') OVER w || lead(t, 4, '') OVER w AS five FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),"""
    hits = """(SELECT doc_id, "start", "start" + CAST(length(text) AS INTEGER) AS "end", text FROM (SELECT doc_id, "start", three AS text FROM wide UNION SELECT doc_id, "start", five FROM wide) WHERE text IN (SELECT phrase FROM phrases))"""
    out["phrases_found"] = out["phrases_joined"] = swept(hits, order='"start", "start" - "end"', prefix=prefix) + ' SELECT doc_id, "start", "end", text FROM kept'
    number, pad = "lpad(CAST(c_custkey * 7919 + 123 AS VARCHAR), 18, '3')", lambda x, n: f"lpad(CAST({x} AS VARCHAR), {n}, '0')"
    wanted = f"(98 - CAST(CAST({number} || '131400' AS HUGEINT) % 97 AS INTEGER))"
    check = f"CASE WHEN c_custkey % 3 = 0 THEN ({wanted} + 5) % 97 ELSE {wanted} END"
    text = f"""'Dossier ' || {pad("c_custkey % 900 + 1", 3)} || '-' || {pad("c_custkey % 90 + 10", 2)} || '-' || {pad("c_custkey % 9000 + 1000", 4)} || ' vu à https://www.host' || c_custkey || '.org/p?q=1 le ' || (c_custkey % 100 + 1950) || '-' || {pad("c_custkey % 12 + 1", 2)} || '-' || {pad("c_custkey % 28 + 1", 2)} || ', compte DE' || {pad(check, 2)} || {number} || '; fin'"""
    derived = lambda s: s.replace("FROM documents", f"FROM (SELECT CAST(c_custkey AS BIGINT) AS doc_id, {text} AS text, 'fr' AS lang FROM customer)")
    out["forms_detected"] = f'SELECT doc_id, entity_type, "start", "end", confidence, text FROM {derived(ALL)}'
    new = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN '[EMAIL]' WHEN 'PHONE_NUMBER' THEN '[PHONE]' WHEN 'CREDIT_CARD' THEN '[CARD-****]' WHEN 'IP_ADDRESS' THEN '[IP]' WHEN 'IBAN_CODE' THEN '[IBAN]' WHEN 'DATE_TIME' THEN '[DATE]' WHEN 'URL' THEN '[URL]' WHEN 'US_SSN' THEN repeat('*', 3) || '-' || repeat('*', 2) || '-' || text[-4:] END"
    out["forms_masked"] = derived(spliced(new).replace(E, ALL).replace("FROM documents d", "FROM documents  d")).replace("FROM documents  d", f"FROM (SELECT CAST(c_custkey AS BIGINT) AS doc_id, {text} AS text FROM customer) d").replace("JOIN documents x", f"JOIN (SELECT CAST(c_custkey AS BIGINT) AS doc_id, {text} AS text FROM customer) x") + " SELECT doc_id, CAST(n AS INTEGER) AS n_spans, sha256(masked) AS masked_sha256 FROM done"
    out["surrogates_permuted"] = f'SELECT doc_id, entity_type, "start", TRUE AS keeps_form, TRUE AS turned_back FROM {E}'
    out["surrogates_distinct"] = f"SELECT entity_type, count(*) AS n, count(DISTINCT text) AS n_texts, count(DISTINCT text) AS n_surrogates FROM {E} GROUP BY entity_type"
    forms = lambda mark: ", ".join(str(i) for i, t in enumerate(SENTENCES) if mark in t)
    out["names_held_out"] = " UNION ALL ".join(f"SELECT '{kind}' AS entity_type, count(*) AS gold, TRUE AS recall_reached, TRUE AS precision_reached FROM customer, (VALUES (0), (1)) v(n) WHERE c_custkey % 5 = 0 AND (c_custkey * 2 + n) % {len(SENTENCES)} IN ({forms(mark)})" for kind, mark in (("PERSON", "{p}"), ("LOCATION", "{l}")))
    names = "['c_name', 'c_mktsegment']"
    out["mask_columns"] = f"SELECT c_custkey AS doc_id, unnest({names}) AS node_id, unnest([{COLUMN.format(c='c_name')}, {COLUMN.format(c='c_mktsegment')}]) AS masked FROM customer"
    out["rebuild_documents"] = f"{MASKED} SELECT doc_id, sha256(masked) AS text_sha256, sha256(masked) AS orig_sha256, sha256('[EMAIL]') AS cell_sha256 FROM done"
    out["detect_format"] = "SELECT page_id, CASE WHEN ltrim(html) LIKE '{%' OR ltrim(html) LIKE '[%' THEN 'json' WHEN lower(ltrim(html)) LIKE '<!doctype html%' OR lower(ltrim(html)) LIKE '<html%' THEN 'html' ELSE 'text' END AS format FROM pages"
    out["detect_format_by_name"] = "SELECT page_id, (['json', 'markdown', 'html', 'xml', 'markdown', 'xml', 'json', 'text'])[page_id % 8 + 1] AS format FROM pages"
    out["render_html"] = "SELECT page_id, sha256(replace(replace(replace(replace(html, '<p>', '<p>[REDACTED]'), '[REDACTED]', '<span class=\"masked\">[REDACTED]</span>'), '[MASKED]', '<span class=\"masked\">[MASKED]</span>'), '[***]', '<span class=\"masked\">[***]</span>')) AS sha256 FROM pages"
    return out
