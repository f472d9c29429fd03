"""SQL (DuckDB) of the queries whose patterns and byte strings SQL can express."""

from __future__ import annotations


def _spans(kind: int, pattern: str, value: str, keep: str) -> str:
    """Spans of a pattern's matches: their places follow from the lengths of the pieces between them."""
    return f"""SELECT doc_id, owner, repo, {kind} AS kind, CAST(s AS BIGINT) AS start, CAST(s + length(m) AS BIGINT) AS "end", {value} AS value FROM (
  SELECT doc_id, owner, repo, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, owner, repo, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, owner, repo, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps FROM t WHERE regexp_matches(text, '{pattern}')))) WHERE {keep}"""


_KEY = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?"
_VALUE = f"regexp_extract(m, '^{_KEY}([A-Za-z0-9+/_.=-]+)$', 1)"
_BARE = "[A-Za-z0-9+/_=-]+"

OP3_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '|' || coalesce(lang, '') AS repo FROM documents),
base AS MATERIALIZED ({_spans(0, _KEY + "[A-Za-z0-9+/_.=-]+", _VALUE, f"length({_VALUE}) >= 12")}
UNION ALL {_spans(1, "AKIA[A-Z0-9]+", "m", "length(m) >= 18")}
UNION ALL {_spans(2, "[0-9a-f]+", "m", "length(m) >= 16")}),
bare AS MATERIALIZED ({_spans(3, _BARE, "m", "length(m) >= 20 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND list_aggregate(string_split(m, ''), 'entropy') >= 3.0")}),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare b WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = b.doc_id AND x.start < b."end" AND b.start < x."end")),
own AS (SELECT value, count(DISTINCT owner) AS n_owners FROM every GROUP BY value),
kept AS (SELECT e.*, n_owners <= 2 AS specific, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || start || ':' || "end" AS shown FROM every e JOIN own USING (value) WHERE kind < 3 OR n_owners <= 2),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, coalesce(string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(shown, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (specific) AS n_owner_specific, count(*) FILTER (NOT specific) AS n_copied FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owner_specific, 0) AS n_owner_specific, coalesce(n_copied, 0) AS n_copied
FROM t LEFT JOIN g USING (doc_id)
"""

#: Bytes as hexadecimal text, two characters a byte; starts count from 0.
OP6_SQL = """
WITH t AS MATERIALIZED (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substring(h, 2 * p + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99)) AS p FROM t WHERE length(h) >= 200)),
d AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS rn FROM w) WHERE rn > 1),
i AS (SELECT doc_id, p, sum(brk) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS brk FROM d)),
r AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM i GROUP BY doc_id, run),
g AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS gone FROM r GROUP BY doc_id),
k AS (SELECT t.doc_id, length(h) AS n, coalesce(gone, 0) AS gone, coalesce(len(los), 0) AS spans, CASE WHEN los IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(los) + 2), lambda j: substring(h, CASE WHEN j = 1 THEN 1 ELSE 2 * his[j - 1] + 1 END, CASE WHEN j = 1 THEN 2 * los[1] WHEN j > len(los) THEN length(h) ELSE 2 * (los[j] - his[j - 1]) END)), '') END AS rest FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n / 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM k
"""
