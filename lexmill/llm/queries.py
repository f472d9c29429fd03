"""One query an operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, language, near_dup, page_text, paragraphs, quality_model, quality_rules, secrets, suffix_dedup
from .common import table
from .oracles import OP3_SQL, OP6_SQL


def tokenizer_path() -> str:
    """Place of the vocabulary of the BPE query; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.removed_units(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_docs(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.rule_ledger(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_page_main_text": op1_page_main_text,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scan": op3_secret_scan,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_language_id": op8_language_id,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_minhash_containment": op10_minhash_containment,
}

OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 6, 1))) AS i, words FROM w),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM g),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM d WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(least(coalesce(nx - i, 8), 8)) AS BIGINT) AS n_repeat_words FROM s GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS BIGINT) AS n_stutter, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_exclamations,
  CAST(length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS BIGINT) AS n_capitals, CAST(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]+', '', 'g')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (n_lines >= 4 AND 2 * n_dup_lines > n_lines)::INT
  + 16 * (n_words >= 20 AND 10 * n_capitals > 6 * n_letters)::INT + 32 * (10 * n_exclamations > 3 * n_words)::INT + 64 * (word_chars > 15 * n_words)::INT + 128 * (word_chars < 2 * n_words)::INT + 256 * (10 * n_stutter > 3 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d WHERE r.m < l.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, x.m AS component_id, x.m = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT d, min(m) AS m FROM r GROUP BY d) x ON x.d = d.doc_id
"""

OP10_SQL = r"""
WITH t AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT DISTINCT side, id, array_to_string(ws[i:i + 4], ' ') AS s, false AS short FROM (SELECT side, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT side, id, array_to_string(ws, ' '), true FROM w WHERE len(ws) BETWEEN 1 AND 4),
q AS (SELECT id, count(*) AS n FROM g WHERE side = 1 GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS c FROM g d JOIN g i ON d.s = i.s AND d.short = i.short WHERE d.side = 0 AND i.side = 1 GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item_shingles, CAST(c AS BIGINT) AS n_shared, c / n AS containment FROM p JOIN q ON q.id = p.item_id WHERE 100 * c >= 80 * n
"""

OP4_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents WHERE text IS NOT NULL),
w AS MATERIALIZED (SELECT doc_id, ws, len(ws) AS n, list_transform(ws, lambda v: CAST('0x' || substring(md5(v), 1, 7) AS BIGINT)) AS num,
  list_filter(list_transform(string_split(x, chr(10)), lambda l: len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))), lambda c: c > 0) AS ls
  FROM (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws FROM t) WHERE len(ws) > 0),
e AS MATERIALIZED (SELECT doc_id, n, unnest(range(1, len(ls) + 1)) AS i, ls, list_transform(range(1, len(ls) + 1), lambda k: list_sum(ls[1:k])) AS ends FROM w),
h AS (SELECT doc_id, 'line' AS kind, CAST(ends[i] - ls[i] AS BIGINT) AS s, CAST(ends[i] AS BIGINT) AS z, false AS whole FROM e UNION ALL
  SELECT doc_id, 'line', 0, n, true FROM w WHERE n < 50 AND len(ls) > 1),
r AS MATERIALIZED (SELECT doc_id, n, list_transform(range(1, n - 3), lambda i: (num[i] * 1103515245 + num[i + 1] * 1664525 + num[i + 2] * 214013 + num[i + 3] * 16843009 + num[i + 4] * 69069) % 2147483647) AS v FROM w WHERE n >= 50),
k AS (SELECT DISTINCT doc_id, p - 2 + list_position(win, list_min(win)) AS s FROM (SELECT doc_id, p, v[p:p + 29] AS win FROM (SELECT doc_id, v, unnest(range(1, n - 48)) AS p FROM r))),
u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, whole, s, kind) AS id, * FROM (SELECT doc_id, kind, s, z, whole FROM h UNION ALL SELECT doc_id, 'passage', s, s + 21, false FROM k)),
g AS MATERIALIZED (SELECT DISTINCT id, kind, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT id, kind, ws, unnest(range(s + 1, z - 3)) AS i FROM u JOIN w USING (doc_id) WHERE kind = 'line' AND z - s >= 5)
  UNION ALL SELECT id, kind, '<' || array_to_string(ws[s + 1:z], ' ') FROM u JOIN w USING (doc_id) WHERE z - s < 5),
q AS MATERIALIZED (SELECT id, kind, list(s ORDER BY s) AS ss FROM g GROUP BY ALL UNION ALL SELECT id, kind, [array_to_string(ws[s + 1:z], ' ')] FROM u JOIN w USING (doc_id) WHERE kind = 'passage'),
c AS MATERIALIZED (SELECT kind, ss, min(id) AS rep, len(ss) AS n FROM q GROUP BY kind, ss),
o AS MATERIALIZED (SELECT id, rep FROM q JOIN c USING (kind, ss)),
y AS (SELECT rep, kind, unnest(ss) AS s FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM y a JOIN y b ON a.s = b.s AND a.kind = b.kind AND a.rep <> b.rep GROUP BY ALL),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN c x ON x.rep = p.a JOIN c z ON z.rep = p.b WHERE 100 * p.c >= 80 * (x.n + z.n - p.c)),
m AS (SELECT rep AS d, rep AS t FROM c UNION SELECT l.b, m.t FROM m JOIN l ON l.a = m.d WHERE m.t < l.b)
SELECT x.doc_id, x.kind, x.s AS start, x.z - x.s AS n_words, y.doc_id AS kept_doc_id, y.s AS kept_start
FROM o JOIN (SELECT d, min(t) AS t FROM m GROUP BY d) j ON j.d = o.rep JOIN u x ON x.id = o.id JOIN u y ON y.id = j.t WHERE o.id <> j.t AND (x.doc_id <> y.doc_id OR x.s - y.s >= x.z - x.s)
"""

ORACLES: dict[str, str] = {"op3_secret_scan": OP3_SQL, "op6_suffix_dedup": OP6_SQL, "op4_paragraph_dedup": OP4_SQL, "op7_quality_rules": OP7_SQL, "op9_minhash_near_dedup": OP9_SQL, "op10_minhash_containment": OP10_SQL}
