"""DuckDB SQL for the operators that SQL can express, written from their contracts."""

from __future__ import annotations

#: Verdict, host and path of the rules of op11.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _host_path(url: str) -> tuple[str, str, str]:
    after = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
    raw = f"regexp_extract({after}, '^[^/?#]*')"
    return after, f"translate({raw}, {_LOWER})", f"regexp_extract(substr({after}, length({raw}) + 1), '^[^?#]*')"


def _node(url: str) -> str:
    after, host, path = _host_path(url)
    asked = f"list_sort(list_filter(string_split(regexp_extract({after}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=&]*|gclid|fbclid|msclkid|mc_eid|ref)(=|$)')))"
    return f"CASE WHEN {host} <> '' THEN regexp_replace({host}, ':(80|443)?$', '') || regexp_replace({path}, '/$', '') || CASE WHEN len({asked}) > 0 THEN '?' || array_to_string({asked}, '&') ELSE '' END END"


def _url_filters() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in URL_RULES)
    _, host, path = _host_path("url")
    # links as whole urls only; the given pages declare none
    tags = "unnest(regexp_extract_all(html, '(?i)<(?:link|meta)[^<>]*>'))"
    link = "regexp_extract(tag, '(?i)(?:href|url)\\s*=\\s*[\"'']?(https?://[^\"''\\s>]*)', 1)"
    return f"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES {rules}),
tags AS (SELECT url, {tags} AS tag FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')),
links AS (SELECT url AS src, {link} AS dst FROM tags WHERE regexp_matches(tag, '(?i)rel\\s*=\\s*["'']?canonical|http-equiv\\s*=\\s*["'']?refresh')),
edges AS (SELECT DISTINCT {_node("src")} AS u, {_node("dst")} AS v FROM links WHERE dst <> ''),
urls AS (SELECT url FROM pages UNION SELECT dst FROM links WHERE dst <> ''),
seen AS (SELECT url, {host} AS host, {path} AS path, {_node("url")} AS node FROM urls),
ranked AS (
  SELECT s.url, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY s.url ORDER BY length(r.host || r.path) DESC, r.verdict, r.host || r.path) AS k
  FROM seen s JOIN rules r ON (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.path)
),
judged AS (SELECT s.*, r.rule, r.verdict FROM seen s LEFT JOIN ranked r ON r.url IS NOT DISTINCT FROM s.url AND r.k = 1),
reach(a, b) AS (
  SELECT DISTINCT node, node FROM judged WHERE node IS NOT NULL
  UNION
  SELECT r.a, CASE WHEN e.u = r.b THEN e.v ELSE e.u END FROM reach r JOIN edges e ON r.b IN (e.u, e.v)
),
shut AS (
  SELECT r.a FROM reach r JOIN judged j ON j.node = r.b WHERE j.verdict IS NOT NULL
  GROUP BY r.a HAVING bool_or(j.verdict = 'block') AND NOT bool_or(j.verdict = 'allow')
)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule,
  coalesce(j.verdict, CASE WHEN s.a IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN j.verdict IS NOT NULL THEN 'rule' WHEN s.a IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM pages p LEFT JOIN judged j ON j.url IS NOT DISTINCT FROM p.url LEFT JOIN shut s ON s.a = j.node"""


def _centroids(k: int = 8, dim: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3) -> str:
    floored = "((s - ((s % n) + n) % n) // n)"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT v.id, c.j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM parts v JOIN c{i} c USING (dim) GROUP BY v.id, c.j),
a{i} AS MATERIALIZED (SELECT id, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{i} GROUP BY id)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT a.j, v.dim, sum(v.x)::HUGEINT AS s, count(*) AS n FROM parts v JOIN a{i} a USING (id) GROUP BY a.j, v.dim),
c{i + 1} AS MATERIALIZED (SELECT c.j, c.dim, CASE WHEN m.n IS NULL THEN c.x ELSE {floored}::BIGINT END AS x FROM c{i} c LEFT JOIN m{i} m USING (j, dim))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
),
parts AS MATERIALIZED (SELECT id, unnest(x) AS x, generate_subscripts(x, 1) AS dim FROM kept),
first AS (SELECT id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {k}),
c0 AS MATERIALIZED (SELECT f.j::INT AS j, p.dim, p.x FROM first f JOIN parts p USING (id)),{",".join(steps)},
shas AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS sha FROM c{rounds} GROUP BY j)
SELECT kept.vec_id, a.j AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, s.sha AS centroid_sha256
FROM kept JOIN a{rounds} a USING (id) JOIN shas s USING (j)"""


URL_FILTERS = _url_filters()
CENTROIDS = _centroids()
COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), {_LOWER}) AS text FROM documents
),
cut AS (SELECT lang, d, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM pieces),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
runs AS MATERIALIZED (SELECT lang, w FROM listed WHERE len(w) > 0),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM runs),
grams AS (
  SELECT lang, 1 AS k, w[i] AS phrase FROM spots
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM spots WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM spots WHERE i + 2 <= len(w)
),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cands AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cover AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a AS f FROM cands WHERE k = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cands WHERE k = 3) GROUP BY ALL
),
kept AS (SELECT c.* FROM cands c LEFT JOIN cover v USING (lang, phrase) WHERE v.f IS NULL OR 100 * v.f < 50 * c.a),
cuts AS (
  SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM kept
),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.k = cut AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.phrase = array_to_string(w[cut + 1:], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang)"""
