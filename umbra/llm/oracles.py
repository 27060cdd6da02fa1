"""DuckDB SQL for the queries of this package whose whole result it can express, written from the rules."""

from __future__ import annotations

TOPK = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _placed(pattern: str, of: str) -> str:
    """r, o (a number that is kept), m, s: the pattern's matches in t of the rows of `of`, with where they begin."""
    return f"""SELECT r, o, m, CAST(sum(length(g) + length(m)) OVER (PARTITION BY r, o ORDER BY i) - length(m) AS BIGINT) AS s FROM (
  SELECT r, o, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT r, o, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM {of}))"""


def secrets() -> str:
    either = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
    keyword = "(?:" + "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    before = rf"""{keyword}["'']?\x20*[:=]\x20*["'']?"""
    assign = before + "[A-Za-z0-9+/_.=-]+"
    key = "[A-Za-z0-9+/_=-]+"
    different = "len(list_distinct(str_split(substr(v, 1, 1000), '')))"
    known = " OR ".join(f"contains(lower(substr(v, 1, 1000)), '{w}')" for w in ("example", "sample", "dummy", "changeme", "placeholder", "xxxx", "1234567890", "your_", "your-"))
    text = lambda rows: f"coalesce(string_agg((['assign', 'access', 'hex'])[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e){rows}, '')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, 0 AS o, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
a AS MATERIALIZED ({_placed(assign, "d")}),
gaps AS MATERIALIZED (SELECT r, CAST(j AS BIGINT) AS j, t, CAST(coalesce(sum(length(t) + length(m)) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM (
  SELECT r, unnest(range(1, len(gs) + 1)) AS j, unnest(gs) AS t, unnest(list_concat(ms, [''])) AS m FROM (SELECT r, regexp_split_to_array(t, '{assign}') AS gs, regexp_extract_all(t, '{assign}') AS ms FROM d))),
hits AS MATERIALIZED (
  SELECT r, 0 AS k, s, s + length(m) AS e, regexp_extract(m, '{before}([A-Za-z0-9+/_.=-]+)', 1) AS v, TRUE AS base FROM a WHERE length(regexp_extract(m, '{before}([A-Za-z0-9+/_.=-]+)', 1)) >= 8
  UNION ALL SELECT r, 1, s, s + length(m), m, TRUE FROM ({_placed("AKIA[A-Z0-9]+", "d")}) WHERE length(m) >= 16
  UNION ALL SELECT r, 2, s, s + length(m), m, TRUE FROM ({_placed("[0-9a-f]+", "d")}) WHERE length(m) >= 32
  UNION ALL SELECT r, 3, o + s, o + s + length(m), m, FALSE FROM ({_placed(key, "gaps")}) WHERE length(m) >= 16 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, 'AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}')),
counted AS (SELECT h.v, count(DISTINCT coalesce(d.source, chr(1))) AS owners, min(CASE WHEN h.base THEN h.k END) AS kind FROM hits h JOIN d ON d.r = h.r GROUP BY h.v),
said AS MATERIALIZED (SELECT v, kind, CASE WHEN owners >= 3 OR {different} < 6 OR {known} THEN 'example' WHEN owners = 1 AND length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND {different} >= 8 THEN 'live' ELSE 'unclear' END AS verdict,
  CASE WHEN length(v) >= 20 AND {different} >= 12 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') THEN 0 WHEN regexp_full_match(v, '[0-9A-F]{{32,}}') THEN 2 END AS shape FROM counted),
spans AS (SELECT h.r, h.s, h.e, h.base, x.verdict, CASE WHEN h.base THEN h.k WHEN x.verdict = 'live' THEN coalesce(x.kind, x.shape) END AS k FROM hits h JOIN said x ON x.v = h.v),
told AS (SELECT r, count(*) FILTER (WHERE base AND k = 0) AS n_assign, count(*) FILTER (WHERE base AND k = 1) AS n_access, count(*) FILTER (WHERE base AND k = 2) AS n_hex,
  {text(" FILTER (WHERE base)")} AS base, {text("")} AS spans,
  count(*) FILTER (WHERE NOT base) AS n_added, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example FROM spans WHERE k IS NOT NULL GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(x.base, '')) AS base_sha256, coalesce(x.spans, '') AS spans,
  coalesce(n_added, 0) AS n_added, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN told x ON x.r = d.r"""


def clusters(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> str:
    """Each round assigns all vectors and takes exact means; every step is a materialised table."""
    steps = [f"""WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS i, v FROM e WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, i, d FROM (SELECT r, i, d, row_number() OVER (PARTITION BY r ORDER BY d, i) AS place FROM (
  SELECT e.r, c.i, list_sum(list_transform(range(1, {width + 1}), lambda j: (e.v[j] - c.v[j]) * (e.v[j] - c.v[j]))) AS d FROM e, c{n} c)) WHERE place = 1)""")
        if n < rounds:
            means = ", ".join(f"CAST(floor(CAST(sum(e.v[{j}]) AS DOUBLE) / count(*)) AS BIGINT)" for j in range(1, width + 1))
            steps.append(f"m{n} AS MATERIALIZED (SELECT a.i, [{means}] AS v FROM a{n} a JOIN e ON e.r = a.r GROUP BY a.i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN m{n} m ON m.i = c.i)")
    return ",\n".join(steps) + f"""
SELECT e.vec_id, CAST(a.i AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.i) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN e ON e.r = a.r JOIN c{rounds} c ON c.i = a.i"""


def _share(count: str, total: str) -> str:
    return f"CAST(1 + (CAST(1000000000 AS HUGEINT) * ({count} + 5)) // ({total} + 5 * v.kept) AS BIGINT)"


DIVERGENCE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT r, lang, source, unnest(regexp_extract_all(t, '[A-Za-z\x{{80}}-\x{{10FFFF}}]+')) AS m FROM d)),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS MATERIALIZED (SELECT lang, count(*) AS kept, sum(n) AS total FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
s AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, {_share('coalesce(c.n, 0)', 's.total')} AS p, {_share('k.n', 'v.total')} AS q
  FROM s JOIN v ON v.lang = s.lang JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
both_ AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_) WHERE part = 'pair' OR rank <= 50"""
