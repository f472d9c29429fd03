"""Queries of the review, audit and evaluation side: policies, coverage, groups, choices and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contracts, metrics, sampling
from ..operators.tables import ARTICLES_SQL, JUDGED_SQL, articles, judged, table
from .other_plans import _COND, _ISSUES, _PAIRS_SQL, _SPLIT_SQL_CONV, _conditions, _issues, _pairs
from .registry import Registry

R = Registry()


@R.query("""WITH s AS (SELECT conv_id, min(turn) AS t, max(role = 'system')::BOOLEAN AS has_system, CASE conv_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, split, split = 'train' AS gradient_usage, split = 'train' OR has_system AS training_usage, split = 'train' AS training_eligible, split = 'validation' AS model_selection_usage, split = 'validation' AS hyperparameter_selection_usage, split <> 'train' AS checkpoint_selection_usage, split = 'test' AS final_evaluation_usage FROM s)
SELECT conv_id, split, array_to_string(list_sort(list_filter([CASE WHEN training_usage <> (split = 'train') THEN 'training_usage' END, CASE WHEN checkpoint_selection_usage <> (split = 'validation') THEN 'checkpoint_selection_usage' END], lambda x: x IS NOT NULL)), '|') AS errors FROM u""")
def usage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each conversation against what its split allows; the test rows break two rules on purpose."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.col("role") == "system").alias("has_system"))
    s = s.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int")))
    is_ = lambda x: F.col("split") == x
    u = s.withColumns({"gradient_usage": is_("train"), "training_usage": is_("train") | F.col("has_system"), "training_eligible": is_("train"), "model_selection_usage": is_("validation"), "hyperparameter_selection_usage": is_("validation"), "checkpoint_selection_usage": ~is_("train"), "final_evaluation_usage": is_("test")})
    return u.select("conv_id", "split", F.array_join(contracts.usage_errors(u), "|").alias("errors"))


@R.query(f"WITH {JUDGED_SQL} SELECT condition, count(*) AS n, count(*) FILTER (raw_total NOT BETWEEN 0 AND 90) AS out_of_range, count(*) FILTER (publishable = (unsupported > 0)) AS contract_breaks FROM j GROUP BY condition")
def judge_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of range and reviews whose verdict contradicts their issues."""
    return judged(spark, sf_dir).groupBy("condition").agg(F.count("*").alias("n"), F.count_if(contracts.score_range(F.col("raw_total"), 90)).alias("out_of_range"), F.count_if(contracts.review_contract(F.col("publishable"), F.col("unsupported"))).alias("contract_breaks"))


@R.query("""WITH d AS (SELECT doc_id, lang, sha256(text) AS h, length(text) AS n FROM documents), u AS (SELECT lang, h, min(doc_id) AS scored_id FROM d GROUP BY ALL) SELECT d.doc_id, u.scored_id, u.scored_id <> d.doc_id AS reused, s.n AS score FROM d JOIN u USING (lang, h) JOIN d s ON s.doc_id = u.scored_id""")
def score_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score a distinct text of a language, handed to its copies."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("h"), F.length("text").cast("long").alias("score"))
    u = d.groupBy("lang", "h").agg(F.min(F.struct("doc_id", "score")).alias("m"))
    return d.select("doc_id", "lang", "h").join(u, ["lang", "h"]).select("doc_id", F.col("m.doc_id").alias("scored_id"), (F.col("m.doc_id") != F.col("doc_id")).alias("reused"), F.col("m.score").alias("score"))


@R.query("""WITH f AS (SELECT doc_id FROM documents WHERE doc_id < 10), h AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f) ORDER BY sha256('fixed' || chr(58) || doc_id), doc_id LIMIT 14) SELECT doc_id, true AS fixed FROM f UNION ALL SELECT doc_id, false FROM h""")
def fixed_then_supplement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed ids first, then supplements by hash up to 24 in all."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    fixed = d.filter("doc_id < 10")
    more = sampling.hash_sample(d.join(fixed, "doc_id", "left_anti"), "doc_id", "fixed", 14, sep=":")
    return fixed.withColumn("fixed", F.lit(True)).unionByName(more.withColumn("fixed", F.lit(False)))


@R.query(f"""WITH {_ISSUES}, s AS (SELECT user_id, max((severity = 'blocking')::INT) AS bad FROM i GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY sha256('esc|' || user_id), user_id) AS k, count(*) OVER () AS n FROM s),
a AS (SELECT avg(bad) AS rate FROM r WHERE k <= ceil(n * 5 / 100)) SELECT r.user_id, CASE WHEN k <= ceil(n * 5 / 100) THEN 1 ELSE 2 END AS round FROM r, a WHERE k <= ceil(n * 5 / 100) OR (rate > 0.02 AND k <= ceil(n * 10 / 100))""")
def adaptive_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first audit of 5 %; where over 2 % of it is bad, a second, disjoint 5 %. The rate is one row on the cluster."""
    s = _issues(spark, sf_dir).groupBy("user_id").agg(F.max((F.col("severity") == "blocking").cast("int")).alias("bad"))
    first = sampling.rate_sample(s, "user_id", "esc", 5).withColumn("round", F.lit(1))
    rate = first.agg(F.avg("bad").alias("rate"))
    second = sampling.rate_sample(s, "user_id", "esc", 10).join(first.select("user_id"), "user_id", "left_anti").withColumn("round", F.lit(2)).join(F.broadcast(rate)).filter("rate > 0.02").drop("rate")
    return first.unionByName(second).select("user_id", "round")


@R.query(f"""WITH {_ISSUES}, s AS (SELECT user_id, bool_or(severity <> 'minor') AS hard, bool_or(severity = 'blocking') AS blocking, CASE WHEN count(*) >= 10 THEN 'long' WHEN count(DISTINCT issue_type) >= 3 THEN 'several' ELSE 'ordinary' END AS stratum FROM i GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY sha256('esc|' || user_id), user_id) AS k, ceil(count(*) OVER () * 5 / 100) AS m FROM s), a AS (SELECT avg(hard::INT) > 0.02 OR bool_or(blocking) AS go FROM r WHERE k <= m),
b AS (SELECT r.* FROM r, a WHERE go AND k > m AND k <= 2 * m), c AS (SELECT avg(hard::INT) > 0.02 AS go FROM b)
SELECT user_id, 1 AS round FROM r WHERE k <= m UNION ALL SELECT user_id, 2 FROM b UNION ALL SELECT user_id, 3 FROM r, c WHERE go AND k > 2 * m AND stratum IN (SELECT stratum FROM b WHERE hard)""")
def adaptive_escalation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three rounds of the adaptive audit; users are stratified by how many issues and types of issue they have."""
    n = F.when(F.count("*") >= 10, "long").when(F.count_distinct("issue_type") >= 3, "several").otherwise("ordinary")
    s = _issues(spark, sf_dir).groupBy("user_id").agg(F.max(F.col("severity") != "minor").alias("hard"), F.max(F.col("severity") == "blocking").alias("blocking"), n.alias("stratum"))
    return sampling.escalation(s, "user_id", "esc", 5, 0.02)


@R.query("""WITH g AS (SELECT source AS grp, doc_id, length(text) AS n, CAST(substring(sha256('split|' || doc_id), 1, 1) IN ('0', '1') AS INT) AS side FROM documents), e AS (SELECT doc_id, grp, n % 97 AS body, n % 89 AS title FROM g)
SELECT doc_id, grp AS group_id FROM (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id % 200 ORDER BY body DESC, title DESC, grp, doc_id) AS rn FROM e) WHERE rn = 1""")
def best_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best anchor of each bucket: body, then title similarity falling, then the group's name."""
    n = F.length("text")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("g"), (n % 97).alias("body"), (n % 89).alias("title"), (F.col("doc_id") % 200).alias("bucket"))
    best = d.groupBy("bucket").agg(F.min(F.struct((-F.col("body")).alias("b"), (-F.col("title")).alias("t"), "g", "doc_id")).alias("x"))
    return best.select(F.col("x.doc_id").alias("doc_id"), F.col("x.g").alias("group_id"))


@R.query("""WITH s AS (SELECT source, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, lang, n_chars > 200 AS high FROM documents) SELECT source, lang, count(DISTINCT split) AS n_splits, bool_and(high) AS all_high, count(*) AS n FROM s GROUP BY ALL HAVING count(DISTINCT split) > 1""")
def split_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose members lie in several splits."""
    s = table(spark, sf_dir, "documents").select("source", "lang", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"), (F.col("n_chars") > 200).alias("high"))
    return s.groupBy("source", "lang").agg(F.count_distinct("split").alias("n_splits"), F.min("high").alias("all_high"), F.count("*").alias("n")).filter("n_splits > 1")


@R.query(f"""WITH {ARTICLES_SQL}, t AS (SELECT source, title, lang, row_number() OVER (PARTITION BY source ORDER BY length(title), title) AS rn FROM a), c AS (SELECT source, lang, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rn FROM c),
d AS (SELECT source, CAST(min(publish_date) AS VARCHAR) AS date_start, CAST(max(publish_date) AS VARCHAR) AS date_end, count(*) AS n, array_to_string(list_sort(list_distinct(list(lang))), ',') AS langs FROM a GROUP BY source)
SELECT d.source, t.title AS representative_title, m.lang AS main_lang, date_start, date_end, n AS group_size, langs FROM d JOIN t USING (source) JOIN m USING (source) WHERE t.rn = 1 AND m.rn = 1""")
def group_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representative title (shortest, then first), commonest language (ties by name), dates and languages of each group."""
    a = articles(spark, sf_dir)
    main = a.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("k"), "lang")).alias("x")).select("source", F.col("x.lang").alias("main_lang"))
    rest = a.groupBy("source").agg(
        F.min(F.struct(F.length("title").alias("k"), "title")).alias("x"), F.min("publish_date").cast("string").alias("date_start"), F.max("publish_date").cast("string").alias("date_end"),
        F.count("*").alias("group_size"), F.array_join(F.slice(F.array_sort(F.collect_set("lang")), 1, 12), ",").alias("langs"),
    )
    return rest.join(main, "source").select("source", F.col("x.title").alias("representative_title"), "main_lang", "date_start", "date_end", "group_size", "langs")


@R.query(f"""WITH {ARTICLES_SQL}, p AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM a), f AS (SELECT doc_id, ps, unnest(range(1, least(len(ps), 5) + 1)) AS i FROM p)
SELECT doc_id, printf('F%02d', CAST(i AS INTEGER)) AS fact_id, sha256(ps[i]) AS evidence_sha256, CASE WHEN i < len(ps) THEN sha256(ps[i + 1]) END AS next_sha256 FROM f""")
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five facts of each article with their evidence paragraphs, by position in the row."""
    p = articles(spark, sf_dir).select("doc_id", T.paragraphs(F.col("body")).alias("ps"))
    facts = F.transform(F.slice("ps", 1, 5), lambda x, i: F.struct(F.format_string("F%02d", i + 1).alias("fact_id"), F.sha2(x, 256).alias("evidence_sha256"), F.sha2(F.get("ps", i + 1), 256).alias("next_sha256")))
    return p.select("doc_id", F.explode(facts).alias("x")).select("doc_id", "x.*")


@R.query(f"""WITH {ARTICLES_SQL}, p AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM a), f AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)
SELECT doc_id, printf('F%02d', CAST(i AS INTEGER)) AS fact_id, sha256(ps[i]) AS evidence_sha256, CASE WHEN i < len(ps) THEN sha256(ps[i + 1]) END AS next_sha256 FROM f""")
def fact_evidence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fact of each article with its evidence paragraph, by position in the row."""
    p = articles(spark, sf_dir).select("doc_id", T.paragraphs(F.col("body")).alias("ps"))
    facts = F.transform("ps", lambda x, i: F.struct(F.format_string("F%02d", i + 1).alias("fact_id"), F.sha2(x, 256).alias("evidence_sha256"), F.sha2(F.get("ps", i + 1), 256).alias("next_sha256")))
    return p.select("doc_id", F.explode(facts).alias("x")).select("doc_id", "x.*")


@R.query("""WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN 'soon' ELSE ' ' END AS raw, CAST(ts AS DATE) AS d FROM events) SELECT event_id, CASE WHEN event_id % 4 < 2 THEN d END AS publish_date, event_id % 4 >= 2 AS warned FROM r""")
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates from ISO dates and timestamps; anything else is null with a warning."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, "soon").otherwise(" ")
    d = contracts.normalized_date(raw)
    return table(spark, sf_dir, "events").select("event_id", d.alias("publish_date"), d.isNull().alias("warned"))


@R.query("""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN contains(lower(text), 'checkpoint') THEN 'checkpoint' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END, CASE WHEN regexp_matches(lower(text), '(?:^|[^a-z0-9])bit(?:[^a-z0-9]|$)') THEN 'bit' END], lambda x: x IS NOT NULL)), '|') AS terms FROM documents""")
def leak_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that would give a candidate's identity away."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(contracts.leak_terms(F.col("text"), ("checkpoint", "license"), ("bit",)), "|").alias("terms"))


@R.query(r"""WITH l AS (SELECT conv_id * 1000 + turn AS id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM conversations WHERE role = 'assistant'),
c AS (SELECT *, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}]', '', 'g')) AS zh, length(regexp_replace(text, '[^A-Za-z\x{4e00}-\x{9fff}]', '', 'g')) AS lt FROM l)
SELECT id, CAST(zh AS BIGINT) AS chinese_characters, round(zh / greatest(1, lt), 6) AS chinese_ratio, len(ls) >= 2 AND length(coalesce(ls[1], '')) <= 120 AND length(array_to_string(ls[2:], '')) >= 40 AS normal_title_body, trim(regexp_replace(text, '\s+', '', 'g')) = '' AS empty, regexp_matches(text, '\x{FFFD}|[\x00-\x08]') AS garbled, zh < 20 OR len(ls) < 2 AS non_task FROM c""")
def generated_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health flags of the assistant turns."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), *[v.alias(k) for k, v in contracts.generated_flags(F.col("text")).items()])


@R.query("""WITH a(alias, canonical) AS (VALUES ('click', 'interaction'), ('view', 'interaction'), ('error', 'failure'), ('purchase', 'conversion'), ('signup', 'conversion')), i AS (SELECT user_id, canonical, max(CASE WHEN value > 20 THEN 3 WHEN value > 10 THEN 2 ELSE 1 END) AS rank, count(*) AS n FROM events JOIN a ON alias = event_type GROUP BY ALL)
SELECT user_id, canonical, n, CASE rank WHEN 3 THEN 'blocking' WHEN 2 THEN 'major' ELSE 'minor' END AS severity, rank >= 2 AS detected FROM i""")
def issue_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by canonical type with their greatest severity, and whether it satisfies the expected one (major)."""
    alias = F.create_map(*[F.lit(x) for p in {"click": "interaction", "view": "interaction", "error": "failure", "purchase": "conversion", "signup": "conversion"}.items() for x in p])
    rank = F.when(F.col("value") > 20, 3).when(F.col("value") > 10, 2).otherwise(1)
    e = table(spark, sf_dir, "events").select("user_id", alias[F.col("event_type")].alias("canonical"), rank.alias("rank")).filter("canonical is not null")
    i = e.groupBy("user_id", "canonical").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    return i.select("user_id", "canonical", "n", F.element_at(F.array(F.lit("minor"), F.lit("major"), F.lit("blocking")), F.col("rank")).alias("severity"), (F.col("rank") >= 2).alias("detected"))


@R.query(f"WITH {JUDGED_SQL}, d AS (SELECT a.sample_id, a.condition, b.raw_total - a.raw_total AS delta FROM j a JOIN j b USING (sample_id, condition) WHERE a.stage = 'draft' AND b.stage = 'final') SELECT sample_id, condition, delta FROM d ORDER BY delta, sample_id, condition LIMIT 12")
def worst_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve pairs that lost most: a top-k report."""
    d = metrics.paired(judged(spark, sf_dir), "raw_total").select("sample_id", "condition", (F.col("final") - F.col("draft")).alias("delta"))
    return d.orderBy("delta", "sample_id", "condition").limit(12)


@R.query(f"""WITH {JUDGED_SQL}, d AS (SELECT sample_id, condition, a.publishable AS pa, b.publishable AS pb, b.raw_total - a.raw_total AS delta FROM j a JOIN j b USING (sample_id, condition) WHERE a.stage = 'draft' AND b.stage = 'final'),
k AS (SELECT *, CASE WHEN NOT pa AND pb THEN 'rescue' ELSE 'harm' END AS kind FROM d WHERE pa <> pb), r AS (SELECT *, row_number() OVER (PARTITION BY condition, kind ORDER BY CASE WHEN kind = 'rescue' THEN -delta ELSE delta END, sample_id) AS rn, count(*) OVER (PARTITION BY condition, kind) AS n FROM k) SELECT condition, kind, n, sample_id, delta FROM r WHERE rn = 1""")
def case_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescued and harmed samples: how many, and the most telling of each condition."""
    j = judged(spark, sf_dir)
    d = metrics.paired(j, "publishable").toDF("sample_id", "condition", "pa", "pb").join(metrics.paired(j, "raw_total").select("sample_id", "condition", (F.col("final") - F.col("draft")).alias("delta")), ["sample_id", "condition"])
    k = d.filter("pa <> pb").withColumn("kind", F.when(F.col("pb"), "rescue").otherwise("harm"))
    best = F.min(F.struct(F.when(F.col("kind") == "rescue", -F.col("delta")).otherwise(F.col("delta")).alias("k"), "sample_id", "delta"))
    return k.groupBy("condition", "kind").agg(F.count("*").alias("n"), best.alias("x")).select("condition", "kind", "n", F.col("x.sample_id").alias("sample_id"), F.col("x.delta").alias("delta"))


@R.query(f"""WITH {JUDGED_SQL}, {_COND}, b AS (SELECT * FROM k WHERE name = 'q4_draft'), t AS (SELECT * FROM k WHERE name = 'q8_final') SELECT k.name, round((k.adjusted - b.adjusted) / (t.adjusted - b.adjusted), 6) AS recovery_adjusted, round((b.claims - k.claims) / (b.claims - t.claims), 6) AS recovery_claims FROM k, b, t""")
def recovery_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the way from a base to a target each condition goes; the sign follows what is better."""
    k = _conditions(spark, sf_dir)
    pick = lambda n, p: F.broadcast(k.filter(F.col("name") == n).select(F.col("adjusted").alias(f"{p}a"), F.col("claims").alias(f"{p}c")))
    x = k.join(pick("q4_draft", "b")).join(pick("q8_final", "t"))
    r = lambda c: F.round(c, 6)
    return x.select("name", r(F.try_divide(F.col("adjusted") - F.col("ba"), F.col("ta") - F.col("ba"))).alias("recovery_adjusted"), r(F.try_divide(F.col("bc") - F.col("claims"), F.col("bc") - F.col("tc"))).alias("recovery_claims"))


@R.query(f"""WITH {JUDGED_SQL}, {_COND}, e AS (SELECT *, array_to_string(list_sort(list_filter([CASE WHEN claims > 0.9 THEN 'claims' END, CASE WHEN publishable < 0.5 THEN 'publishable' END], lambda x: x IS NOT NULL)), '|') AS codes FROM k) SELECT name, codes, row_number() OVER (ORDER BY codes <> '', claims, risks, adjusted DESC, name) AS rank FROM e""")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions ranked with the eligible first; the table has one row a condition."""
    k = _conditions(spark, sf_dir)
    e = k.withColumn("codes", F.array_join(contracts.codes({"claims": F.col("claims") > 0.9, "publishable": F.col("publishable") < 0.5}), "|"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("codes") != "", "claims", "risks", F.col("adjusted").desc(), "name")
    return e.select("name", "codes", F.row_number().over(w).alias("rank"))


@R.query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT 'duplicate_outputs' AS "check", count(*) = count(DISTINCT event_id) AS holds FROM events UNION ALL SELECT 'timestamps_present', count(*) = count(ts) FROM events UNION ALL SELECT 'few_a_day', max(n) <= 20 FROM s""")
def resume_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks of a resumable run, each in one aggregation."""
    e = table(spark, sf_dir, "events")
    one = lambda name, df, c: df.agg(c.alias("holds")).select(F.lit(name).alias("check"), "holds")
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return one("duplicate_outputs", e, F.count("*") == F.count_distinct("event_id")).unionByName(one("timestamps_present", e, F.count("*") == F.count("ts"))).unionByName(one("few_a_day", days, F.max("n") <= 20))


@R.query("""WITH a AS (SELECT c_custkey AS id, 'balance' AS stage, 'negative' AS reason FROM customer WHERE c_acctbal < 0), b AS (SELECT c_custkey, 'orders', 'none' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) SELECT id, stage, reason FROM a UNION ALL SELECT * FROM b""")
def drop_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections of all stages in one ledger."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    row = lambda df, s, r: df.select("id", F.lit(s).alias("stage"), F.lit(r).alias("reason"))
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return row(c.filter("c_acctbal < 0"), "balance", "negative").unionByName(row(c.join(used, "id", "left_anti"), "orders", "none"))


@R.query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R') EXCEPT SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal < 0""")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one set that another lacks: a semi join and a difference."""
    s = table(spark, sf_dir, "supplier")
    used = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(used, "s_suppkey", "left_semi").select("s_suppkey", "s_name").exceptAll(s.filter("s_acctbal < 0").select("s_suppkey", "s_name"))


@R.query(f"""WITH {ARTICLES_SQL}, {_SPLIT_SQL_CONV}, u AS (SELECT min(doc_id) AS id, title FROM a WHERE length(title) >= 8 GROUP BY title), d AS (SELECT id, title, split FROM u JOIN s ON s.doc_id = id), g AS (SELECT DISTINCT id, substring(title, i, 3) AS t FROM (SELECT id, title, unnest(range(1, length(title) - 1)) AS i FROM d)),
r AS (SELECT t FROM g GROUP BY t HAVING count(*) BETWEEN 2 AND 24), k AS (SELECT g.* FROM g JOIN r USING (t)), p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.t = y.t AND x.id < y.id JOIN d dx ON dx.id = x.id JOIN d dy ON dy.id = y.id WHERE dx.split <> dy.split),
q AS (SELECT id, list_distinct(list(t)) AS ts FROM g GROUP BY id) SELECT a, b, round(len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))), 4) AS title_similarity FROM p JOIN q x ON x.id = a JOIN q y ON y.id = b WHERE len(list_intersect(x.ts, y.ts)) >= 0.4 * len(list_distinct(list_concat(x.ts, y.ts)))""")
def cross_split_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of alike titles in different splits, by rare trigrams that 2 to 24 titles share."""
    from ..operators.dedup import shared_rare_keys

    u = articles(spark, sf_dir).filter(F.length("title") >= 8).groupBy("title").agg(F.min("doc_id").alias("id")).withColumn("split", sampling.split_of(F.col("id"), "split")).withColumn("g", T.char_ngram_set(F.col("title"), 3)).withColumn("all", F.lit(1))
    pairs = shared_rare_keys(u, "id", "g", 24, ["all"])
    side = lambda p: u.select(F.col("id").alias(p), F.col("split").alias(f"s{p}"), F.col("g").alias(f"g{p}"))
    x = pairs.join(side("a"), "a").join(side("b"), "b").filter("sa <> sb")
    common, union = F.size(F.array_intersect("ga", "gb")), F.size(F.array_union("ga", "gb"))
    return x.filter(common >= 0.4 * union).select("a", "b", F.round(common / union, 4).alias("title_similarity"))


@R.query(f"""WITH {_PAIRS_SQL}, x AS (SELECT id, '<user>' || reference || '<assistant>' || prediction || '</s>' AS r, prediction FROM p) SELECT id, starts_with(r, '<user>') AND ends_with(r, '</s>') AS framed, (length(r) - length(replace(r, '<assistant>', ''))) // 11 = 1 AS one_answer, ends_with(r, prediction || '</s>') AS target_last FROM x""")
def template_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame and end marks of rendered rows."""
    r = F.concat(F.lit("<user>"), F.col("reference"), F.lit("<assistant>"), F.col("prediction"), F.lit("</s>"))
    return _pairs(spark, sf_dir).select("id", (r.startswith("<user>") & r.endswith("</s>")).alias("framed"), (T.occurrences(r, "<assistant>") == 1).alias("one_answer"), r.endswith(F.concat("prediction", F.lit("</s>"))).alias("target_last"))


@R.query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (quality = 1) AS ok FROM labels) SELECT n, ok, CASE WHEN ok >= 2200 THEN 'preferred_target_met' WHEN ok >= 100 THEN 'hard_min_met_preferred_not_met' ELSE 'hard_min_not_met' END AS status FROM s""")
def target_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pool of eligible rows meets its targets."""
    s = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("ok"))
    return s.select("n", "ok", contracts.target_policy(F.col("ok"), 100, 2200).alias("status"))


@R.query("""WITH m AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'HTTP 429 quota' WHEN 2 THEN 'quota spent' WHEN 3 THEN 'server overloaded' WHEN 4 THEN 'invalid JSON' ELSE 'odd' END AS t FROM events WHERE event_type = 'error')
SELECT CASE WHEN t LIKE '%timed out%' THEN 'timeout' WHEN t LIKE '%429%' THEN 'explicit_rate_limit' WHEN t LIKE '%quota%' THEN 'quota' WHEN t LIKE '%overloaded%' THEN 'explicit_capacity' WHEN t LIKE '%invalid%' THEN 'parse' ELSE 'unknown_provider_error' END AS failure_class, count(*) AS n FROM m GROUP BY 1""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider failures by class; the first that matches counts."""
    k = F.col("event_id") % 6
    t = F.when(k == 0, "Request timed out").when(k == 1, "HTTP 429 quota").when(k == 2, "quota spent").when(k == 3, "server overloaded").when(k == 4, "invalid JSON").otherwise("odd")
    return table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy(contracts.failure_class(t).alias("failure_class")).agg(F.count("*").alias("n"))


@R.query(f"WITH {JUDGED_SQL}, d AS (SELECT sample_id, list_sort(list_distinct(list(publishable))) AS v, count(*) AS n FROM j WHERE stage = 'final' GROUP BY sample_id) SELECT count(*) AS n_samples, round(avg((len(v) = 1)::INT), 6) AS verdict_agreement FROM d WHERE n > 1")
def reviewer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the verdicts of a sample agree."""
    d = judged(spark, sf_dir).filter("stage = 'final'").groupBy("sample_id").agg(F.count_distinct("publishable").alias("v"), F.count("*").alias("n")).filter("n > 1")
    return d.agg(F.count("*").alias("n_samples"), F.round(F.avg((F.col("v") == 1).cast("int")), 6).alias("verdict_agreement"))


@R.query(f"""WITH {JUDGED_SQL}, {_COND}, b AS (SELECT * FROM k WHERE name = 'q4_draft') SELECT k.name, k.adjusted >= b.adjusted - 0.35 AND k.publishable >= b.publishable - 0.02 AS sufficient FROM k, b""")
def base_relative_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that stay within a margin of the base."""
    k = _conditions(spark, sf_dir)
    b = F.broadcast(k.filter("name = 'q4_draft'").select(F.col("adjusted").alias("ba"), F.col("publishable").alias("bp")))
    return k.join(b).select("name", ((F.col("adjusted") >= F.col("ba") - 0.35) & (F.col("publishable") >= F.col("bp") - 0.02)).alias("sufficient"))


@R.query(f"""WITH {_ISSUES}, v AS (SELECT user_id, CASE max(CASE severity WHEN 'blocking' THEN 3 WHEN 'major' THEN 2 ELSE 1 END) WHEN 3 THEN 'BLOCKING' WHEN 2 THEN 'MAJOR' ELSE 'MINOR' END AS verdict, count(*) FILTER (severity = 'blocking') > 0.12 * count(*) AS dropped, array_to_string(list_sort(list(DISTINCT issue_type) FILTER (severity = 'blocking')), '+') AS signature FROM i GROUP BY user_id),
s AS (SELECT * FROM v WHERE NOT dropped), r AS (SELECT coalesce(max(c), 0) AS most_repeated FROM (SELECT count(*) AS c FROM s WHERE signature <> '' GROUP BY signature)), c AS (SELECT count(*) AS n, count(*) FILTER (verdict = 'BLOCKING') AS blocking, count(*) FILTER (verdict = 'MAJOR') AS major, CAST(0 AS BIGINT) AS technical FROM s)
SELECT n, blocking, major, technical, most_repeated, blocking = 0 AND major <= 0.02 * n AND technical = 0 AND most_repeated < 2 AS passed FROM c, r""")
def final_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final quality gate over the survivors of an audit."""
    from ..operators.selection import final_gate as gate

    rank = F.when(F.col("severity") == "blocking", 3).when(F.col("severity") == "major", 2).otherwise(1)
    v = _issues(spark, sf_dir).groupBy("user_id").agg(F.max(rank).alias("r"), F.avg((F.col("severity") == "blocking").cast("double")).alias("share"), F.sort_array(F.collect_set(F.when(F.col("severity") == "blocking", F.col("issue_type")))).alias("t"))
    audited = v.select(F.when(F.col("share") > 0.12, "dropped").otherwise("kept").alias("state"), F.element_at(F.array(F.lit("MINOR"), F.lit("MAJOR"), F.lit("BLOCKING")), F.col("r")).alias("verdict"), F.when(F.size("t") > 0, F.array_join("t", "+")).alias("signature"))
    return gate(audited)


@R.query(f"""WITH {_ISSUES}, m(issue_type, review_type) AS (VALUES ('click', 'style'), ('view', 'style'), ('error', 'fact'), ('purchase', 'fact'), ('signup', 'structure')), a AS (SELECT review_type AS issue, count(*) AS n FROM i JOIN m USING (issue_type) WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT 'fact' AS issue, count(*) AS n FROM i WHERE event_id % 2 = 1 AND severity = 'blocking')
SELECT issue, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM r) GROUP BY issue""")
def cross_taxonomy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two taxonomies merged through a map of types."""
    kinds = F.create_map(*[F.lit(x) for p in {"click": "style", "view": "style", "error": "fact", "purchase": "fact", "signup": "structure"}.items() for x in p])
    i = _issues(spark, sf_dir)
    a = i.filter("event_id % 2 = 0").select(kinds[F.col("issue_type")].alias("issue")).filter("issue is not null")
    r = i.filter("event_id % 2 = 1 and severity = 'blocking'").select(F.lit("fact").alias("issue"))
    return a.unionByName(r).groupBy("issue").agg(F.count("*").alias("n"))


@R.query(f"""WITH {JUDGED_SQL}, {_COND}, c AS (SELECT condition, round(avg(raw_total), 6) AS mean_raw FROM j WHERE stage = 'final' GROUP BY condition), d AS (SELECT condition, count(*) AS n_pairs FROM (SELECT sample_id, condition FROM j GROUP BY ALL HAVING count(*) = 2) GROUP BY condition)
SELECT c.condition, c.mean_raw, d.n_pairs, k.adjusted AS final_adjusted, k.publishable AS final_publishable FROM c JOIN d USING (condition) JOIN k ON k.name = c.condition || '_final'""")
def tradeoff_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reports of a condition merged into one table."""
    j = judged(spark, sf_dir)
    c = j.filter("stage = 'final'").groupBy("condition").agg(F.round(F.avg("raw_total"), 6).alias("mean_raw"))
    d = j.groupBy("sample_id", "condition").agg(F.count("*").alias("k")).filter("k = 2").groupBy("condition").agg(F.count("*").alias("n_pairs"))
    k = _conditions(spark, sf_dir).filter(F.col("name").endswith("_final")).select(F.regexp_replace("name", "_final$", "").alias("condition"), F.col("adjusted").alias("final_adjusted"), F.col("publishable").alias("final_publishable"))
    return c.join(d, "condition").join(k, "condition")


@R.query(f"""WITH {_PAIRS_SQL} SELECT id, array_to_string(list_sort(list_filter([CASE WHEN length(trim(reference)) < 20 THEN 'prompt_too_short' END, CASE WHEN length(prediction) > 4000 THEN 'target_too_long' END, CASE WHEN prediction = reference THEN 'copied_prompt' END], lambda x: x IS NOT NULL)), '|') AS errors FROM p""")
def export_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of an export record as codes."""
    p, r = F.col("prediction"), F.col("reference")
    return _pairs(spark, sf_dir).select("id", F.array_join(contracts.codes({"prompt_too_short": F.length(F.trim(r)) < 20, "target_too_long": F.length(p) > 4000, "copied_prompt": p == r}), "|").alias("errors"))


@R.query("""SELECT event_id, CAST(json_extract(p, '$.data.k') AS BIGINT) AS k, json_extract_string(p, '$.data.name') AS name, CASE WHEN json_extract(p, '$.data.k') IS NULL THEN 'missing_k' END AS code FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{"data": {}}' ELSE '{"data": {"k": ' || (event_id % 7) || ', "name": "n' || event_id || '"}}' END AS p FROM events)""")
def payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads to typed rows, with the code of what is missing."""
    e = F.col("event_id")
    p = F.when(e % 5 == 0, F.lit('{"data": {}}')).otherwise(F.concat(F.lit('{"data": {"k": '), (e % 7).cast("string"), F.lit(', "name": "n'), e.cast("string"), F.lit('"}}')))
    x = table(spark, sf_dir, "events").select("event_id", F.from_json(p, "data struct<k:long,name:string>").alias("j"))
    return x.select("event_id", F.col("j.data.k").alias("k"), F.col("j.data.name").alias("name"), F.when(F.col("j.data.k").isNull(), "missing_k").alias("code"))


@R.query("""SELECT s.doc_id, s.scored_id = s.doc_id OR s.n = o.n AS identical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS scored_id, length(text) AS n FROM documents) s JOIN (SELECT doc_id, length(text) AS n FROM documents) o ON o.doc_id = s.scored_id WHERE s.doc_id <> s.scored_id""")
def reuse_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied scores against their source."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("own"))
    lang_free = own.join(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")), "doc_id")
    first = lang_free.groupBy("h").agg(F.min(F.struct("doc_id", "own")).alias("m"))
    return lang_free.join(first, "h").filter(F.col("doc_id") != F.col("m.doc_id")).select("doc_id", (F.col("own") == F.col("m.own")).alias("identical"))


@R.query(r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'invalid_url' WHEN regexp_extract(url, '^https?://([^/?#:]*)', 1) NOT LIKE '%.example.com' THEN 'unsupported_domain' WHEN NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '^/(?:en|de)/') THEN 'unsupported_path' END AS code FROM pages""")
def listing_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing URLs by host suffix and path prefix, with the code of what is wrong."""
    from ..operators.pages import url_parts

    p = url_parts(F.col("url"))
    code = F.when(~p["scheme"].isin("http", "https"), "invalid_url").when(~p["host"].endswith(".example.com"), "unsupported_domain").when(~p["path"].rlike("^/(?:en|de)/"), "unsupported_path")
    return table(spark, sf_dir, "pages").select("page_id", code.alias("code"))


@R.query(f"WITH {ARTICLES_SQL}, f AS (SELECT doc_id, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps, body FROM a) SELECT doc_id, CASE WHEN regexp_replace(array_to_string(ps, ''), '\\s+', '', 'g') = regexp_replace(body, '\\s+', '', 'g') THEN 'own' ELSE 'body' END AS paragraph_source FROM f")
def paragraph_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the paragraphs of an article hold its whole body."""
    own = T.paragraphs(F.col("body"))
    return articles(spark, sf_dir).select("doc_id", T.complete_paragraphs(F.col("body"), own, F.array().cast("array<string>"))["source"].alias("paragraph_source"))
