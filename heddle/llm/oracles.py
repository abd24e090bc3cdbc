"""DuckDB SQL for the queries of this package that SQL can express; the others are tested against brute force.

Learned models, XXH64 fingerprints and the tokenizer have no SQL form, and the repeated strings of op7 take SQL more
memory than a machine has. Regular expressions stay within what both engines
read alike.
"""

from __future__ import annotations

from heddle.llm import secrets
from heddle.llm.url_filter import LISTED, RULES

_ENTRIES = ", ".join(f"('{key}', '{verdict}', true)" for verdict, key in RULES) + ", " + ", ".join(f"('{key}', 'block', false)" for key in LISTED)



def _matches(rank: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(t, '{pattern}') AS gaps,
    regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {rule.group}) AS vals
  FROM d WHERE regexp_matches(t, '{pattern}')"""


_BASE = ", ".join(f"'{rule.kind}'" for rule in secrets.BASE_RULES)

ORACLES: dict[str, str] = {
    "op2_secret_scans": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(k, rule) for k, rule in enumerate(secrets.RULES))}),
e AS (SELECT doc_id, rank, kind, hits, gaps, vals, least, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, rank, kind, length(hits[i]) AS size, list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS begin
  FROM e WHERE length(vals[i]) >= least),
w AS (SELECT doc_id, kind, rank, begin, kind || ':' || begin::BIGINT || ':' || (begin + size)::BIGINT AS span FROM s),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY begin, rank) FILTER (WHERE kind IN ({_BASE})) AS base, string_agg(span, ',' ORDER BY begin, rank) AS spans FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op3_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS span, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS s
  FROM iw, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
spans AS (SELECT DISTINCT span FROM items),
docs AS (
  SELECT DISTINCT doc_id, span, array_to_string(w[k:k + span - 1], ' ') AS s
  FROM dw, spans, unnest(range(1, len(w) - span + 2)) AS t(k) WHERE len(w) >= span),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY 1)
SELECT doc_id, item_id, any_value(n) AS n_item_shingles, count(*) AS n_found
FROM docs JOIN items USING (span, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING 10 * count(*) >= 8 * any_value(n)""",
    "op5_url_filter": rf"""
WITH e(key, verdict, is_rule) AS (VALUES {_ENTRIES}),
p AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (SELECT page_id, host, path, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]+$', '') AS chost, url_decode(path) AS cpath FROM q),
h AS (
  SELECT page_id, host, path, e.key, e.verdict, e.is_rule,
    row_number() OVER (PARTITION BY page_id ORDER BY e.is_rule DESC NULLS LAST, length(e.key) DESC, e.key) AS k
  FROM c LEFT JOIN e ON host <> ''
    AND CASE WHEN is_rule THEN (host = split_part(e.key, '/', 1) OR ends_with(host, '.' || split_part(e.key, '/', 1))) AND starts_with(path, substr(e.key, strpos(e.key, '/')))
      ELSE (chost = split_part(e.key, '/', 1) OR ends_with(chost, '.' || split_part(e.key, '/', 1))) AND starts_with(cpath, substr(e.key, strpos(e.key, '/'))) END)
SELECT page_id, host, path, CASE WHEN is_rule THEN key END AS rule, coalesce(verdict, 'allow') AS verdict FROM h WHERE k = 1""",
}
