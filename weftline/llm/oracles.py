"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

from . import secrets
from .warc import IDLE_ARGUMENTS, KEPT_FIELDS


def _folded(pattern: str) -> str:
    """The pattern with its keywords' letters in either case, spelled out (plain folding would go beyond ASCII)."""
    head, sep, tail = pattern.partition(")")
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in head) + sep + tail


def secret_scan() -> str:
    parts = []
    for k, r in enumerate(secrets.RULES):
        rx = (_folded(r.pattern) if r.any_case else r.pattern).replace("'", "''")
        parts.append(f"SELECT rid, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, unnest(string_split_regex(t, '{rx}')) AS gap, unnest(regexp_extract_all(t, '{rx}')) AS hit, unnest(regexp_extract_all(t, '{rx}', {r.group})) AS own, unnest(range(1, len(string_split_regex(t, '{rx}')) + 1)) AS i FROM d WHERE regexp_matches(t, '{rx}')")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE_KINDS)
    base = ", ".join(f"'{k}'" for k in secrets.BASE_KINDS)
    zero = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE_KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
p AS (SELECT rid, k, kind, least, own, hit, (sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY rid, k ORDER BY i) - length(hit))::BIGINT AS s FROM m),
f AS (SELECT rid, k, kind, s, s + length(hit) AS e FROM p WHERE hit IS NOT NULL AND length(own) >= least),
g AS (SELECT rid, {counts},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (kind IN ({base})) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY rid)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


EMBEDDING_LINKS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
c AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)"""


def warc_revisits() -> str:
    kept = ", ".join(f"'{x}'" for x in KEPT_FIELDS)
    host = r"regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '')"
    path = r"regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '')"
    query = rf"array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda a: a <> '' AND NOT regexp_matches(lower(a), '{IDLE_ARGUMENTS}'))), '&')"
    return rf"""
WITH p AS (SELECT page_id, url, html, sha256(coalesce(html, '')) AS body, '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag, page_id::VARCHAR AS d FROM pages WHERE page_id IS NOT NULL),
r AS (
  SELECT page_id * 8 AS record_id, url, page_id * 10 AS ts, true AS f, tag AS etag, body AS digest, [('content-length', length(coalesce(html, ''))::VARCHAR), ('content-type', 'text/html'), ('date', d), ('etag', tag)] AS h FROM p
  UNION ALL SELECT page_id * 8 + 1, regexp_replace(url, '^[a-z]+://', 'HTTP://WWW.') || '#again', page_id * 10 + 5, false, tag, NULL, [('content-length', '0'), ('date', (page_id + 1)::VARCHAR), ('etag', 'W/' || tag)] FROM p
  UNION ALL SELECT page_id * 8 + 2, url, page_id * 10 + 7, false, '"other"', NULL, [('date', d), ('etag', '"other"')] FROM p WHERE page_id % 4 = 1
  UNION ALL SELECT page_id * 8 + 3, url, page_id * 10 - 5, false, NULL, body, [('date', d)] FROM p WHERE page_id % 5 = 2
  UNION ALL SELECT page_id * 8 + 4, url, page_id * 10 + 9, false, NULL, NULL, [('date', d), ('x-cache', 'hit')] FROM p WHERE page_id % 7 = 3),
b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM r),
q AS (SELECT *, {query} AS query FROM b),
c AS (SELECT *, {host} || {path} || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM q),
j AS (SELECT v.record_id, v.canonical, v.h AS vh, v.etag AS ve, v.digest AS vd, s.record_id AS sid, s.h AS sh, s.etag AS se, s.digest AS sd
  FROM (SELECT * FROM c WHERE NOT f) v ASOF LEFT JOIN (SELECT * FROM c WHERE f) s ON v.canonical = s.canonical AND v.ts > s.ts),
w AS (SELECT *, CASE WHEN sid IS NULL THEN 'orphan' WHEN ve IS NOT NULL THEN CASE WHEN ve = se THEN 'resolved' ELSE 'changed' END
  WHEN vd IS NOT NULL THEN CASE WHEN vd = sd THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS verdict FROM j),
a AS (SELECT *, list_filter(vh, lambda e: e[1] NOT IN ({kept})) AS own FROM w)
SELECT record_id, canonical, CASE WHEN verdict IN ('resolved', 'unchecked') THEN sid END AS response_id, verdict,
  array_to_string(list_transform(list_sort(CASE WHEN verdict IN ('resolved', 'unchecked') THEN list_concat(list_filter(sh, lambda e: NOT list_contains(list_transform(own, lambda x: x[1]), e[1])), own) ELSE vh END), lambda e: e[1] || ': ' || e[2]), chr(10)) AS headers
FROM a"""


COLLOCATIONS = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS x FROM t),
w AS (SELECT lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda a: a <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 30),
s AS (SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT DISTINCT b.lang, b.phrase FROM c b JOIN c o ON o.lang = b.lang AND o.k > b.k AND 100 * o.a >= 80 * b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' '))
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM m JOIN n ON n.lang = m.lang WHERE (m.lang, phrase) NOT IN (SELECT (lang, phrase) FROM d)
QUALIFY rank <= 2000"""


LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, coalesce(s.first <> k.doc_id, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id"""
