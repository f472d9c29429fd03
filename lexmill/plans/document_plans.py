"""Queries over documents: duplicates, repetition, lengths, rules, features and blocking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, features, sampling
from ..operators.similar import similar_texts
from ..operators.tables import ARTICLES_SQL, articles, table
from ..sources.shared import cut
from .registry import Registry

R = Registry()

_GROUPS_SQL = """WITH {a}, k AS (SELECT *, sha256({key}) AS group_hash FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY group_hash ORDER BY length(body) DESC, publish_date, CAST(doc_id AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY group_hash) AS n FROM k)
SELECT group_hash, n AS n_docs, doc_id AS survivor_id FROM r WHERE rn = 1 AND n > 1"""


@R.query(_GROUPS_SQL.format(a=ARTICLES_SQL, key=r"trim(regexp_replace(body, '\s+', ' ', 'g'))"))
def doc_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents equal up to white space, with their survivor."""
    return dedup.duplicate_groups(articles(spark, sf_dir), T.collapse_spaces(F.col("body")))


@R.query(_GROUPS_SQL.format(a=ARTICLES_SQL, key=r"regexp_replace(lower(body), '[^0-9a-z]+', '', 'g')"))
def doc_normalized_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents equal in their compact text."""
    return dedup.duplicate_groups(articles(spark, sf_dir), T.compact(F.col("body")))


@R.query(f"""WITH {ARTICLES_SQL}, k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS f FROM a) SELECT doc_id AS duplicate_id, f AS duplicate_of FROM k WHERE doc_id <> f""")
def doc_first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of a text, each with the first."""
    return dedup.first_occurrences(articles(spark, sf_dir).select("doc_id", F.sha2("body", 256).alias("key")), "key", "doc_id")


@R.query(f"""WITH {ARTICLES_SQL}, k AS (SELECT *, sha256(body) AS h FROM a), r AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(body) DESC, publish_date, CAST(doc_id AS VARCHAR)) AS survivor_id FROM k)
SELECT doc_id, survivor_id FROM r WHERE doc_id <> survivor_id""")
def doc_rejected_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected copies with the survivor of their group."""
    return dedup.rejected_copies(articles(spark, sf_dir), F.col("body"))


_LINES_SQL = """l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM l), x AS (SELECT doc_id, i, ls[i] AS s FROM e)"""


@R.query(f"""WITH {_LINES_SQL}, c AS (SELECT doc_id, max(n) AS m FROM (SELECT doc_id, s, count(*) AS n FROM x GROUP BY ALL) GROUP BY doc_id),
g AS (SELECT doc_id, s, i - row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS island FROM x),
r AS (SELECT doc_id, max(n) AS m FROM (SELECT doc_id, s, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT l.doc_id, coalesce(c.m, 0) AS max_line_count, coalesce(r.m, 0) AS longest_run, coalesce(c.m, 0) >= 3 AS any3, coalesce(r.m, 0) >= 3 AS consecutive3, coalesce(c.m, 0) >= 5 AS severe5
FROM l LEFT JOIN c ON c.doc_id = l.doc_id LEFT JOIN r ON r.doc_id = l.doc_id""")
def doc_line_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines, longest run of equal lines, and the three flags of each document."""
    return dedup.line_repetition(table(spark, sf_dir, "documents"))


@R.query(f"""WITH {_LINES_SQL} SELECT doc_id, CASE WHEN len(ls) = 0 THEN 1.0::DOUBLE ELSE round(1.0::DOUBLE - len(list_distinct(ls))::DOUBLE / len(ls), 6) END AS repeat_ratio FROM l""")
def doc_repeat_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of paragraphs that repeat another."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.repeat_ratio(T.paragraphs(F.coalesce("text", F.lit("")))), 6).alias("repeat_ratio"))


@R.query("""SELECT lang, CASE WHEN length(text) <= 600 THEN 'short' WHEN length(text) <= 1200 THEN 'medium' WHEN length(text) <= 2000 THEN 'long' ELSE 'very_long' END AS bucket_le,
CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 1000 THEN 'medium' WHEN length(text) < 2000 THEN 'long' ELSE 'very_long' END AS bucket_lt, count(*) AS n FROM documents GROUP BY ALL""")
def doc_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and both kinds of length buckets."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", T.length_bucket_le(F.length("text")).alias("bucket_le"), T.length_bucket_lt(F.length("text")).alias("bucket_lt")).agg(F.count("*").alias("n"))


@R.query("""WITH d AS (SELECT lang, length(text) AS n FROM documents), s AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY lang) AS c FROM d)
SELECT lang, count(*) AS n_docs, round(avg(n), 6) AS mean, round(median(n)::DOUBLE, 6) AS median, round(stddev_pop(n), 6) AS sd, round(quantile_cont(n, 0.9)::DOUBLE, 6) AS p90_linear, CAST(quantile_disc(n, 0.9) AS BIGINT) AS p90_rank,
CAST(max(n) FILTER (i = floor(0.75 * (c - 1))) AS BIGINT) AS p75_lower, round(avg((n <= 2048)::INT), 6) AS share_2048, round(avg((n <= 4096)::INT), 6) AS share_4096 FROM s GROUP BY lang""")
def doc_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, spread and the three definitions of a percentile, by language.

    The lower-index percentile is Spark's own rank function: percentile_disc at the share whose rank is that index.
    """
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n"))
    counts = d.groupBy("lang", "n").agg(F.count("*").alias("c"))  # lengths are few; the running sum is over them, not over rows
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy("n")
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy("lang")))
    lower = run.filter(F.col("upto") > F.floor(0.75 * (F.col("total") - 1))).groupBy("lang").agg(F.min("n").cast("long").alias("p75_lower"))
    r = lambda c: F.round(c, 6)
    main = d.groupBy("lang").agg(
        F.count("*").alias("n_docs"), r(F.avg("n")).alias("mean"), r(F.percentile("n", F.lit(0.5))).alias("median"), r(F.stddev_pop("n")).alias("sd"), r(F.percentile("n", F.lit(0.9))).alias("p90_linear"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n)").cast("long").alias("p90_rank"), r(F.avg((F.col("n") <= 2048).cast("int"))).alias("share_2048"), r(F.avg((F.col("n") <= 4096).cast("int"))).alias("share_4096"),
    )
    return main.join(lower, "lang")


_VERDICT_SQL = f"""WITH {ARTICLES_SQL}, n AS (SELECT doc_id, title, trim(body) AS body, regexp_replace(body, '\\s+', '', 'g') AS nb, regexp_replace(title, '\\s+', '', 'g') AS nt,
  list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM a),
r AS (SELECT *, CASE WHEN len(ps) = 0 THEN 1.0 ELSE 1.0 - len(list_distinct(ps))::DOUBLE / len(ps) END AS rr,
 list_filter([CASE WHEN title = '' THEN 'missing_title' END, CASE WHEN body = '' THEN 'missing_body' END, CASE WHEN contains(title || body, chr(65533)) THEN 'encoding_replacement_character' END, CASE WHEN nb = nt AND length(nb) <= 80 THEN 'title_only_no_news_body' END], lambda x: x IS NOT NULL) AS rej FROM n),
w AS (SELECT *, list_filter([CASE WHEN length(nb) <= 40 AND len(ps) <= 1 AND len(rej) = 0 THEN 'extremely_short_single_block' WHEN length(nb) < 180 THEN 'short_body_requires_semantic_review' END, CASE WHEN rr >= 0.5 AND len(ps) >= 4 THEN 'abnormal_repeated_paragraphs' END,
 CASE WHEN regexp_matches(body, '(?i)<(?:div|p|span|script|style)\\b|&nbsp;|javascript:') THEN 'html_or_script_residue' END], lambda x: x IS NOT NULL) AS warn FROM r)
SELECT doc_id, CASE WHEN len(rej) > 0 THEN 'deterministic_reject' WHEN len(warn) > 0 THEN 'deterministic_warning' ELSE 'deterministic_pass' END AS status, array_to_string(list_sort(rej), '|') AS reject_codes, array_to_string(list_sort(warn), '|') AS warning_codes FROM w"""


@R.query(_VERDICT_SQL)
def doc_quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule verdicts of each document: reject and warning codes."""
    from ..operators.contracts import deterministic_review

    return deterministic_review(articles(spark, sf_dir)).select("doc_id", "status", F.array_join("reject_codes", "|").alias("reject_codes"), F.array_join("warning_codes", "|").alias("warning_codes"))


@R.query(r"""SELECT doc_id, regexp_matches(text, '[０-９]') AS fullwidth_digit, regexp_matches(text, '[\x{FFFD}\x{E000}-\x{F8FF}]') AS replacement_or_private, regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS control_character, regexp_matches(text, '[\x{4e00}-\x{9fff}] [\x{4e00}-\x{9fff}]') AS ocr_spacing FROM documents""")
def doc_anomaly_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text anomalies that spoil a target."""
    return table(spark, sf_dir, "documents").select("doc_id", *T.anomaly_flags(F.col("text")))


def _theme_sql() -> str:
    score = lambda ws: " + ".join(f"CAST((length(b) - length(replace(b, '{w}', ''))) / {len(w)} AS BIGINT)" for w in ws)
    items = ", ".join(f"{{'n': {score(ws)}, 'name': '{t}'}}" for t, ws in T.THEMES.items())
    return f"WITH {ARTICLES_SQL}, t AS (SELECT doc_id, lower(title || substring(body, 1, 1200)) AS b FROM a), m AS (SELECT doc_id, list_max([{items}]) AS x FROM t) SELECT doc_id, CASE WHEN x.n > 0 THEN x.name ELSE '{T.DEFAULT_THEME}' END AS theme FROM m"


@R.query(_theme_sql())
def doc_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme of each article, from its title and the first 1,200 characters, as the scorer is defined."""
    return articles(spark, sf_dir).select("doc_id", T.theme(F.concat("title", F.substring("body", 1, 1200))).alias("theme"))


SCAN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "key_assignment": r"(?i)(?:api_?key|token|password|secret)[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9_-]{12,}", "absolute_path": r"(?:[A-Z]:\\|/home/|/Users/)[A-Za-z0-9._-]+", "endpoint": r"https?://[A-Za-z0-9.-]+"}


def _scan_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, i AS line, '{n}' AS code FROM x WHERE regexp_matches(s, '{p.replace(chr(39), chr(39) * 2)}')" for n, p in SCAN.items())
    return f"WITH e AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), y AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM e), x AS (SELECT doc_id, i, ls[i] AS s FROM y) {parts}"


@R.query(_scan_sql())
def doc_release_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release scan: code and line of each finding, never the value. Lines are found inside the row; only findings leave it."""
    found = F.filter(
        F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s, i: F.array(*[F.when(s.rlike(p), F.struct((i + 1).cast("long").alias("line"), F.lit(n).alias("code"))) for n, p in SCAN.items()]))),
        lambda x: x.isNotNull(),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.line", "x.code")


_TITLE_TERMS = "t AS (SELECT doc_id, regexp_replace(lower(title), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS c FROM a)"
_TFIDF_SQL = f"""WITH {ARTICLES_SQL}, {_TITLE_TERMS},
g AS (SELECT doc_id, substring(c, i, 2) AS term FROM (SELECT doc_id, c, unnest(range(1, greatest(length(c), 1))) AS i FROM t)
  UNION ALL SELECT doc_id, substring(c, i, 3) FROM (SELECT doc_id, c, unnest(range(1, greatest(length(c) - 1, 1))) AS i FROM t)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM a),
s AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
v AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM s, n WHERE df >= 2 AND df <= greatest(1, floor(n * 0.5)) ORDER BY round((ln((1 + n) / (1 + df)) + 1) * ln(1 + cf), 9) DESC, term LIMIT 2000),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN v USING (term)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
x AS (SELECT doc_id, term, w / norm AS weight FROM w JOIN m USING (doc_id))"""


def _title_vectors(spark: SparkSession, sf_dir: str, max_df_ratio: float = 0.5) -> DataFrame:
    a = articles(spark, sf_dir)
    return features.tfidf(a, "doc_id", T.char_ngram_range(T.compact(F.col("title")), 2, 3), 2, max_df_ratio, 2000)


@R.query(_TFIDF_SQL + """, r AS (SELECT doc_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM x) SELECT doc_id, rank, term, weight FROM r WHERE rank <= 5""")
def doc_tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five heaviest character n-grams of each title: a top-k report."""
    return features.top_terms(_title_vectors(spark, sf_dir), "doc_id", 5)


@R.query("""WITH l AS (SELECT d.doc_id, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS ws, quality FROM documents d JOIN labels USING (doc_id)), f AS (SELECT DISTINCT doc_id, quality, unnest(ws) AS feature FROM l)
SELECT feature, CAST(sum((quality = 1)::INT) AS BIGINT) AS pos, CAST(sum((quality = 0)::INT) AS BIGINT) AS neg FROM f GROUP BY feature""")
def nb_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of features among eligible and other documents."""
    return features.naive_bayes(_labelled(spark, sf_dir), "doc_id", "quality", T.mixed_tokens(F.col("text")))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").agg(F.sum((F.col("quality") == 1).cast("long")).alias("p"), F.sum((F.col("quality") == 0).cast("long")).alias("n"))


def _probabilities(spark: SparkSession, sf_dir: str, terms) -> DataFrame:
    return features.naive_bayes_scores(table(spark, sf_dir, "documents"), "doc_id", terms, features.naive_bayes(_labelled(spark, sf_dir), "doc_id", "quality", terms), _totals(spark, sf_dir))


_NB_SQL = """{p} AS (WITH f AS (SELECT DISTINCT doc_id, unnest({terms}) AS feature FROM documents), tot AS (SELECT sum((quality = 1)::INT) AS p, sum((quality = 0)::INT) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
  m AS (SELECT feature, ln((sum((quality = 1)::INT) + 0.01 * any_value(p)) / (any_value(p) * 1.02)) - ln((sum((quality = 0)::INT) + 0.01 * any_value(n)) / (any_value(n) * 1.02)) AS rate FROM f JOIN labels USING (doc_id), tot GROUP BY feature),
  s AS (SELECT doc_id, avg(rate) AS e FROM f JOIN m USING (feature) GROUP BY doc_id)
  SELECT d.doc_id, 1 / (1 + exp(-greatest(-40, least(40, ln(p / n) + 12 * coalesce(e, 0))))) AS pr FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id, tot)"""


@R.query("WITH " + _NB_SQL.format(p="q", terms="regexp_extract_all(lower(text), '[a-z0-9]+')") + " SELECT doc_id, round(pr, 6) AS probability FROM q")
def nb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility of each document by the token model."""
    return _probabilities(spark, sf_dir, T.mixed_tokens(F.col("text"))).select("doc_id", F.round("probability", 6).alias("probability"))


_LINE_TERMS = "list_filter(list_transform(string_split(lower(text), chr(10)), lambda x: substring(trim(x), 1, 3)), lambda x: x <> '')"


@R.query(f"""WITH {_NB_SQL.format(p="q1", terms=_LINE_TERMS)}, {_NB_SQL.format(p="q2", terms="regexp_extract_all(lower(text), '[a-z0-9]+')")}, {ARTICLES_SQL},
n AS (SELECT doc_id, length(regexp_replace(body, '\\s+', '', 'g')) AS len, regexp_replace(body, '\\s+', '', 'g') = regexp_replace(title, '\\s+', '', 'g') AS same FROM a),
x AS (SELECT n.*, round(q1.pr, 6) AS p1, round(q2.pr, 6) AS p2, (same::INT + (len < 120)::INT) AS flags FROM n JOIN q1 USING (doc_id) JOIN q2 USING (doc_id)),
c AS (SELECT *, CASE WHEN len = 0 THEN 'rejected' WHEN p1 >= 0.72 AND flags = 0 THEN 'eligible' WHEN p1 < 0.18 AND (flags > 0 OR len < 180) THEN 'rejected' ELSE 'borderline' END AS "primary",
 CASE WHEN len = 0 OR p2 < 0.16 THEN 'rejected' WHEN p2 >= 0.67 THEN 'eligible' ELSE 'uncertain' END AS "second" FROM x)
SELECT doc_id, "primary", "second", CASE WHEN "primary" = 'eligible' THEN 'accept' WHEN "primary" = 'rejected' THEN 'reject' WHEN len = 0 THEN 'reject' WHEN (p1 + p2) / 2 >= 0.52 AND "second" <> 'rejected' THEN 'accept' WHEN (p1 + p2) / 2 <= 0.30 AND "second" = 'rejected' THEN 'reject' ELSE 'quarantine' END AS "final" FROM c""")
def nb_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary, second and judge decisions; the primary model reads the openings of lines, the second all tokens."""
    openings = F.filter(F.transform(F.split(F.lower("text"), "\n"), lambda x: F.substring(F.trim(x), 1, 3)), lambda x: x != "")
    p1 = _probabilities(spark, sf_dir, openings).select("doc_id", F.round("probability", 6).alias("p1"))
    p2 = nb_scores(spark, sf_dir).withColumnRenamed("probability", "p2")
    bare, name = T.delete_spaces(F.col("body")), T.delete_spaces(F.col("title"))
    flags = F.array_compact(F.array(F.when(bare == name, "no_independent_body_content"), F.when(F.length(bare) < 120, "fact_density_or_completeness_risk")))
    rows = articles(spark, sf_dir).select("doc_id", flags.alias("flags"), F.length(bare).alias("len"), F.lit(False).alias("attachment")).join(p1, "doc_id").join(p2, "doc_id")
    return features.decision_cascade(rows, F.col("p1"), F.col("p2"), F.col("flags"), F.col("len"), F.col("attachment")).select("doc_id", "primary", "second", "final")


_DISTINCT_TITLES = f"{ARTICLES_SQL}, u AS (SELECT min(doc_id) AS id, lower(title) AS c FROM a WHERE length(title) >= 5 GROUP BY lower(title))"


@R.query(f"""WITH {_DISTINCT_TITLES}, g AS (SELECT DISTINCT id, substring(c, i, 5) AS s FROM (SELECT id, c, unnest(range(1, length(c) - 3)) AS i FROM u)), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS similarity FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 90 * (x.n + y.n - c)""")
def doc_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different titles whose 5-gram sets are 0.9 alike, between the first rows of equal titles."""
    u = articles(spark, sf_dir).filter(F.length("title") >= 5).groupBy(F.lower("title").alias("c")).agg(F.min("doc_id").alias("id"))
    u = cut(u.select("id", "c"))
    return similar_texts(u, "id", "c", u.select("id", F.length("c")), 90).select("a", "b", "similarity")


@R.query(f"""WITH {_DISTINCT_TITLES}, d AS (SELECT id, c, month(DATE '2024-01-01' + CAST(id % 365 AS INTEGER)) AS m, DATE '2024-01-01' + CAST(id % 365 AS INTEGER) AS day FROM u),
g AS (SELECT DISTINCT id, m, substring(c, i, 3) AS s FROM (SELECT id, c, m, unnest(range(1, greatest(length(c) - 1, 1))) AS i FROM d)), r AS (SELECT m, s FROM g GROUP BY m, s HAVING count(*) BETWEEN 2 AND 6),
k AS (SELECT g.* FROM g JOIN r USING (m, s)), p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.m = b.m AND a.s = b.s AND a.id < b.id),
b2 AS (SELECT id, list_distinct(list_transform(range(1, length(c)), lambda i: substring(c, i, 2))) AS s FROM d),
x AS (SELECT a, b, len(list_intersect(l.s, q.s)) / greatest(len(list_distinct(list_concat(l.s, q.s))), 1) AS sim, abs(date_diff('day', da.day, db.day)) AS gap FROM p JOIN b2 l ON l.id = a JOIN b2 q ON q.id = b JOIN d da ON da.id = a JOIN d db ON db.id = b)
SELECT 'ev2pair_' || substring(sha256(a || '|' || b), 1, 16) AS pair_id, a, b, CAST(gap AS BIGINT) AS date_gap_days, round(sim, 6) AS title_similarity, sim >= 0.62 AS ambiguous FROM x WHERE sim >= 0.3 AND gap <= 90""")
def doc_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs by rare title trigrams of one month, then title similarity and day gap: cheap tests first."""
    from ..operators.grouping import candidate_pairs

    u = articles(spark, sf_dir).filter(F.length("title") >= 5).groupBy(F.lower("title").alias("title")).agg(F.min("doc_id").alias("id"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("id", F.lit(365)).cast("int"))
    return candidate_pairs(u.select("id", "title", day.alias("publish_date"), F.month(day).alias("period")), cap=6, least=0.3, max_days=90)


@R.query("SELECT doc_id, length(text) AS n_chars, sha256(concat('{\"doc_id\":', doc_id, ',\"lang\":', to_json(lang), ',\"source\":', to_json(source), '}')) AS record_sha256, sha256(text) AS text_sha256 FROM documents")
def canonical_record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of a record's canonical JSON (sorted keys) and of its text."""
    d = table(spark, sf_dir, "documents")
    record = F.to_json(F.struct("doc_id", "lang", "source"), {"ignoreNullFields": "false"})
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(record, 256).alias("record_sha256"), F.sha2("text", 256).alias("text_sha256"))


@R.query("""WITH d AS (SELECT *, length(text) AS n FROM documents), g AS (SELECT text, count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1)
SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total_chars, CAST(min(n) AS BIGINT) AS min_chars, CAST(max(n) AS BIGINT) AS max_chars, round(avg(length(text) - length(replace(text, chr(10), ''))), 6) AS mean_newlines, (SELECT count(*) FROM g) AS duplicate_groups, (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM g) AS duplicate_excess FROM d""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, newline counts and duplicate groups of the corpus, in one row."""
    d = table(spark, sf_dir, "documents")
    n = F.length("text")
    main = d.agg(F.count("*").alias("n_docs"), F.sum(n).cast("long").alias("total_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.round(F.avg(n - F.length(F.replace("text", F.lit("\n"), F.lit("")))), 6).alias("mean_newlines"))
    g = d.groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("c")).filter("c > 1")
    return main.join(F.broadcast(g.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("duplicate_excess"))))


@R.query("""WITH d AS (SELECT doc_id, text FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '(?i)[0-9]+(?:\\.[0-9]+)?(?:%|％|万|亿|兆|个|项|家|次|年|月|日|天|小时|分钟|秒|公里|米|元|G|GB|TB|P|bps)?'))), '|') AS numbers,
CAST(len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]|[A-Za-z0-9]+')) AS BIGINT) AS metric_tokens, round(1.0 * length(regexp_replace(text, '[^0-9]+', '', 'g')) / length(text), 6) AS digit_share FROM d WHERE length(text) > 0""")
def doc_token_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with units, metric tokens and digit share of each document."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    x = F.col("text")
    return d.select("doc_id", F.array_join(T.number_unit_tokens(x), "|").alias("numbers"), F.size(T.metric_tokens(x)).cast("long").alias("metric_tokens"), F.round(F.length(F.regexp_replace(x, "[^0-9]+", "")) / F.length(x), 6).alias("digit_share"))


@R.query(f"""WITH {ARTICLES_SQL} SELECT doc_id, '标题：' || title || chr(10) || chr(10) || '正文：' || substring(body, 1, 40) AS target, sha256('标题：' || title || chr(10) || chr(10) || '正文：' || body) AS target_sha256, printf('F%02d', CAST(doc_id % 100 AS INTEGER)) AS fact_id FROM a""")
def target_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered targets with their hash; the first 40 characters of the body as a preview column."""
    a = articles(spark, sf_dir)
    return a.select("doc_id", T.target_text(F.col("title"), F.substring("body", 1, 40)).alias("target"), F.sha2(T.target_text(F.col("title"), F.col("body")), 256).alias("target_sha256"), F.format_string("F%02d", F.pmod("doc_id", F.lit(100))).alias("fact_id"))


@R.query("""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed|' || doc_id), doc_id) AS rank FROM documents) SELECT doc_id, lang, rank FROM h WHERE rank <= 20""")
def hash_rank_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents a language by seeded hash."""
    return sampling.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "seed", 20, strata=("lang",))


@R.query("""WITH d AS (SELECT doc_id, length(text) AS n, lang FROM documents), s1 AS (SELECT doc_id FROM d WHERE n > 5000 ORDER BY sha256('q|long|' || doc_id), doc_id LIMIT 30),
s2 AS (SELECT doc_id FROM d WHERE lang <> 'en' AND doc_id NOT IN (SELECT doc_id FROM s1) ORDER BY sha256('q|foreign|' || doc_id), doc_id LIMIT 30),
s3 AS (SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s1) AND doc_id NOT IN (SELECT doc_id FROM s2) ORDER BY sha256('q|ordinary|' || doc_id), doc_id LIMIT 30)
SELECT doc_id, 'long' AS stratum FROM s1 UNION ALL SELECT doc_id, 'foreign' FROM s2 UNION ALL SELECT doc_id, 'ordinary' FROM s3""")
def stratified_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas by stratum in order of priority, without replacement."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), "lang")
    return sampling.quota_sample(d, "doc_id", "q", [("long", F.col("n") > 5000, 30), ("foreign", F.col("lang") != "en", 30), ("ordinary", F.lit(True), 30)]).select("doc_id", "stratum")


@R.query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('audit|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM h WHERE r <= ceil(n * 5 / 100)""")
def audit_sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five in a hundred documents, rounded up, by seeded hash."""
    return sampling.rate_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "audit", 5)


@R.query("""WITH t AS (SELECT doc_id, CAST('0x' || substring(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 3 AS k FROM documents), r AS (SELECT doc_id, unnest([0, 1, 2]) AS i, k FROM t), l AS (SELECT 'c' || i AS condition, ['A', 'B', 'C'][CAST((i + k) % 3 + 1 AS INTEGER)] AS label FROM r)
SELECT condition, label, count(*) AS n FROM l GROUP BY ALL""")
def blind_rotation_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each condition has each blind label."""
    return sampling.rotation(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", ("A", "B", "C")).groupBy("condition", "label").agg(F.count("*").alias("n"))


@R.query("SELECT lang, count(*) AS n, CAST(ceil(count(*) * 4 / 5) AS BIGINT) AS train, CAST(round_even(count(*) / 10, 0) AS BIGINT) AS validation, count(*) - CAST(ceil(count(*) * 4 / 5) AS BIGINT) - CAST(round_even(count(*) / 10, 0) AS BIGINT) AS test FROM documents GROUP BY lang")
def split_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split sizes of each language: rounded up, half to even, and the rest."""
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("*", *[c.alias(k) for k, c in sampling.split_targets(F.col("n")).items()])


_SPLIT_SQL = "s AS (SELECT *, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, CAST('0x' || substring(sha256('split|' || {key}), 1, 8) AS BIGINT) % 10 AS b FROM documents))"


@R.query("WITH " + _SPLIT_SQL.format(key="sha256(text)") + """ SELECT x.split AS left_split, y.split AS right_split, count(DISTINCT x.text) AS shared_texts FROM s x JOIN s y ON x.text = y.text AND x.split < y.split GROUP BY ALL
UNION ALL SELECT 'all', 'all', count(DISTINCT text) FROM s""")
def split_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that two splits share: none, as the split follows the text; and the number of texts in all."""
    s = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h")).withColumn("split", sampling.split_of(F.col("h"), "split"))
    per = s.groupBy("h").agg(F.sort_array(F.collect_set("split")).alias("splits"))
    pairs = per.select(F.explode(F.flatten(F.transform("splits", lambda x: F.transform(F.filter("splits", lambda y: y > x), lambda y: F.struct(x.alias("l"), y.alias("r")))))).alias("p"))
    leaks = pairs.groupBy(F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split")).agg(F.count("*").alias("shared_texts"))
    return leaks.unionByName(per.agg(F.lit("all").alias("left_split"), F.lit("all").alias("right_split"), F.count("*").alias("shared_texts")))


@R.query("WITH " + _SPLIT_SQL.format(key="doc_id") + """, g AS (SELECT split, lang FROM (SELECT DISTINCT split FROM s), (SELECT DISTINCT lang FROM s)), c AS (SELECT g.split, g.lang, count(s.doc_id) AS n FROM g LEFT JOIN s ON s.split = g.split AND s.lang = g.lang GROUP BY ALL),
h AS (SELECT split, lang, n, 100.0 * n / sum(n) OVER (PARTITION BY split) AS share, 100.0 * sum(n) OVER (PARTITION BY lang) / sum(n) OVER () AS overall FROM c) SELECT split, round(max(abs(share - overall)), 6) AS max_deviation_pp, CAST(sum(n) AS BIGINT) AS n_docs FROM h GROUP BY split""")
def split_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest deviation of a language's share from its overall share, by split, in points."""
    s = table(spark, sf_dir, "documents").select("lang", sampling.split_of(F.col("doc_id"), "split").alias("split")).groupBy("split", "lang").agg(F.count("*").alias("n"))
    grid = s.select("split").distinct().crossJoin(F.broadcast(s.select("lang").distinct()))  # splits by languages: a few rows of counts
    c = grid.join(s, ["split", "lang"], "left").fillna({"n": 0})
    by = lambda k, name: c.groupBy(k).agg(F.sum("n").alias(name))
    h = c.join(by("split", "ns"), "split").join(by("lang", "nl"), "lang").join(F.broadcast(c.agg(F.sum("n").alias("nt"))))
    return h.groupBy("split").agg(F.round(F.max(F.abs(100.0 * F.col("n") / F.col("ns") - 100.0 * F.col("nl") / F.col("nt"))), 6).alias("max_deviation_pp"), F.sum("n").alias("n_docs"))


@R.query("""WITH g AS (SELECT source, lang, list_sort(list(doc_id)) AS ids FROM documents GROUP BY ALL) SELECT source, lang, CAST(len(ids) AS BIGINT) AS n, CAST(ids[1] AS BIGINT) AS first_id, 'grp_' || substring(sha256('v1|' || source || '|' || lang), 1, 16) AS group_id FROM g""")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable group ids from a version and a group's key; sizes and first members without gathering a group."""
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return g.withColumn("group_id", F.concat(F.lit("grp_"), F.substring(F.sha2(F.concat_ws("|", F.lit("v1"), "source", "lang"), 256), 1, 16)))


@R.query(f"""WITH {ARTICLES_SQL}, p AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM a) SELECT doc_id, CAST(len(ps) AS BIGINT) AS n_paragraphs, sha256(array_to_string(list_transform(ps, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10))) AS evidence_sha256 FROM p""")
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each article and the hash of their evidence text."""
    p = T.paragraphs(F.col("body"))
    return articles(spark, sf_dir).select("doc_id", F.size(p).cast("long").alias("n_paragraphs"), F.sha2(T.join_evidence(p), 256).alias("evidence_sha256"))


@R.query("SELECT lang, source, count(*) AS n, grouping(lang) + grouping(source) AS level FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by language and source with totals."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), (F.grouping("lang").cast("long") + F.grouping("source").cast("long")).alias("level"))


@R.query("""WITH l AS (SELECT doc_id AS id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), r AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'added' WHEN r.id IS NULL THEN 'removed' WHEN l.h <> r.h THEN 'changed' ELSE 'same' END AS status FROM l FULL JOIN r ON l.id = r.id""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed entries of two manifests. The filters make the two versions that are compared."""
    from ..operators.lineage import manifest_diff as diff

    d = table(spark, sf_dir, "documents")
    left = d.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    right = d.filter("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return diff(left, right, "id", "h")
