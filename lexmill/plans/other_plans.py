"""Queries over conversations, pages, events and judged scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contracts, ledgers, lineage, metrics, pages
from ..operators.tables import JUDGED_SQL, judged, table
from .registry import Registry

R = Registry()

_SPLIT_SQL_CONV = "s AS (SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substring(sha256('split|' || doc_id), 1, 8) AS BIGINT) % 10 AS b FROM documents))"
_CONV = "c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


@R.query(f"""WITH {_CONV}, e AS (SELECT conv_id, len(m) AS n, list_transform(m, lambda x: x.role) AS roles, len(list_filter(m, lambda x: trim(coalesce(x.text, '')) = '')) > 0 AS empty FROM c)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, array_to_string(roles, ',') AS roles, array_to_string(list_filter([CASE WHEN empty THEN 'empty_content' END, CASE WHEN n <> 3 THEN 'message_count' END, CASE WHEN NOT (coalesce(roles[1], '') = 'system' AND coalesce(roles[2], '') = 'user' AND coalesce(roles[3], '') = 'assistant') THEN 'roles' END], lambda x: x IS NOT NULL), '|') AS errors FROM e""")
def conv_message_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations against the contract of three messages."""
    return contracts.message_contract(table(spark, sf_dir, "conversations"))


_PAIRS_SQL = "p AS (SELECT conv_id * 1000 + turn AS id, text AS prediction, prev AS reference FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prole FROM conversations) WHERE role = 'assistant' AND prole = 'user')"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the user turn before: the prediction and the reference of text metrics."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, sf_dir, "conversations").withColumn("prev", F.lag("text").over(w)).withColumn("prole", F.lag("role").over(w))
    return x.filter("role = 'assistant' and prole = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prediction"), F.col("prev").alias("reference"))


@R.query(f"WITH {_PAIRS_SQL} SELECT id, to_json([{{'content': reference, 'role': 'user'}}, {{'content': prediction, 'role': 'assistant'}}]) AS messages_json, sha256(prediction) AS target_sha256 FROM p")
def conv_training_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages-only view for training, as canonical JSON."""
    m = F.to_json(F.array(F.struct(F.col("reference").alias("content"), F.lit("user").alias("role")), F.struct(F.col("prediction").alias("content"), F.lit("assistant").alias("role"))))
    return _pairs(spark, sf_dir).select("id", m.alias("messages_json"), F.sha2("prediction", 256).alias("target_sha256"))


@R.query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, '主题：' || chr(10) || ts[1] || chr(10) || chr(10) || '事实要点：' || chr(10) || array_to_string(list_transform(range(1, len(ts) + 1), lambda i: i || '. ' || ts[i]), chr(10)) AS prompt FROM c""")
def conv_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with numbered facts: the user turns of a conversation."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("ts"))
    return c.select("conv_id", F.concat(F.lit("主题：\n"), F.get("ts", F.lit(0)), F.lit("\n\n事实要点：\n"), T.numbered(F.col("ts"))).alias("prompt"))


_TOKENS = "list_transform(regexp_extract_all({c}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]|[A-Za-z0-9]+'), lambda x: lower(x))"


def _overlap_sql(n: int) -> str:
    def grams(c: str) -> str:
        return f"SELECT id, array_to_string(t[i:i + {n - 1}], ' ') AS g, count(*) AS k FROM (SELECT id, t, unnest(range(1, greatest(len(t) - {n - 2}, 1))) AS i FROM (SELECT id, {_TOKENS.format(c=c)} AS t FROM p)) GROUP BY ALL"

    return f"o{n} AS (SELECT id, sum(least(coalesce(x.k, 0), coalesce(y.k, 0))) AS m, sum(coalesce(x.k, 0)) AS a, sum(coalesce(y.k, 0)) AS b FROM ({grams('prediction')}) x FULL JOIN ({grams('reference')}) y USING (id, g) GROUP BY id)"


@R.query(f"""WITH {_PAIRS_SQL}, {', '.join(_overlap_sql(n) for n in range(1, 5))}, l AS (SELECT CAST(sum(len({_TOKENS.format(c='prediction')})) AS BIGINT) AS c, CAST(sum(len({_TOKENS.format(c='reference')})) AS BIGINT) AS r FROM p),
s AS (SELECT {', '.join(f"(SELECT CAST(sum(m) AS BIGINT) FROM o{n}) AS m{n}, (SELECT CAST(sum(a) AS BIGINT) FROM o{n}) AS t{n}" for n in range(1, 5))}, c, r FROM l)
SELECT m1, m2, m3, m4, t1, t2, t3, t4, c AS prediction_length, r AS reference_length, round((CASE WHEN c = 0 THEN 0 WHEN c > r THEN 1 ELSE exp(1 - r / c) END) * exp((ln((m1 + 1) / (t1 + 1)) + ln((m2 + 1) / (t2 + 1)) + ln((m3 + 1) / (t3 + 1)) + ln((m4 + 1) / (t4 + 1))) / 4), 6) AS bleu4 FROM s""")
def bleu4_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU of assistant turns against user turns."""
    return metrics.bleu4(_pairs(spark, sf_dir), "id")


@R.query(f"""WITH {_PAIRS_SQL}, {_overlap_sql(1)}, {_overlap_sql(2)}, f AS (SELECT p.id, CASE WHEN coalesce(o1.m, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * o1.m / (o1.a + o1.b) END AS r1, CASE WHEN coalesce(o2.m, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * o2.m / (o2.a + o2.b) END AS r2 FROM p LEFT JOIN o1 ON o1.id = p.id LEFT JOIN o2 ON o2.id = p.id)
SELECT count(*) AS n_pairs, round(avg(r1), 6) AS rouge1, round(avg(r2), 6) AS rouge2 FROM f""")
def rouge12_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ROUGE-1 and ROUGE-2 over the pairs."""
    p = _pairs(spark, sf_dir)
    return metrics.rouge_n(p, "id", 1).join(metrics.rouge_n(p, "id", 2), "id").agg(F.count("*").alias("n_pairs"), F.round(F.avg("rouge1"), 6).alias("rouge1"), F.round(F.avg("rouge2"), 6).alias("rouge2"))


@R.query(f"""WITH {_PAIRS_SQL}, l AS (SELECT len({_TOKENS.format(c='reference')}) AS prompt, len({_TOKENS.format(c='prediction')}) AS target FROM p) SELECT count(*) AS n, round(quantile_cont(prompt, 0.95)::DOUBLE, 6) AS prompt_p95, round(quantile_cont(target, 0.95)::DOUBLE, 6) AS target_p95, CAST(max(prompt + target) AS BIGINT) AS total_max,
CASE WHEN quantile_cont(prompt + target, 0.95) <= 2048 THEN 2048 ELSE 4096 END AS cutoff FROM l""")
def conv_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lengths of prompts and targets and the cutoff they call for."""
    n = _pairs(spark, sf_dir).select(F.size(T.metric_tokens(F.col("reference"))).alias("prompt"), F.size(T.metric_tokens(F.col("prediction"))).alias("target"))
    p = lambda c: F.percentile(c, F.lit(0.95))
    return n.agg(F.count("*").alias("n"), F.round(p(F.col("prompt")), 6).alias("prompt_p95"), F.round(p(F.col("target")), 6).alias("target_p95"), F.max(F.col("prompt") + F.col("target")).cast("long").alias("total_max"), F.when(p(F.col("prompt") + F.col("target")) <= 2048, 2048).otherwise(4096).alias("cutoff"))


@R.query(r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:([0-9]+)', 1) AS port, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
c AS (SELECT *, CASE WHEN s NOT IN ('http', 'https') THEN 'invalid_url' WHEN port <> '' AND port NOT IN ('80', '443') THEN 'invalid_url' WHEN q <> '' THEN 'query_not_allowed' END AS code FROM p),
r AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'ref=')), '&') AS rest FROM c)
SELECT page_id, CASE WHEN code IS NULL THEN s || '://' || h || path END AS canonical, code, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN rest <> '' THEN '?' || rest ELSE '' END AS without_ref, regexp_extract(path, '/([0-9]+)(?:\.html)?/?$', 1) AS article_id FROM r""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs or their error codes, URLs without one parameter, and ids from paths."""
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select("page_id", pages.canonical_url(u).alias("x"), pages.drop_parameter(u, "ref").alias("without_ref"), F.regexp_extract(pages.url_parts(u)["path"], r"/([0-9]+)(?:\.html)?/?$", 1).alias("article_id")).select("page_id", F.col("x.url").alias("canonical"), "x.code", "without_ref", "article_id")


@R.query("""SELECT page_id, CASE WHEN contains(html, 'class="newsArea"') THEN 'new' WHEN contains(html, '<article>') THEN 'article' ELSE 'unknown' END AS template, CAST(length(html) AS BIGINT) AS html_chars FROM pages""")
def page_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template of each page by marks in its source."""
    return table(spark, sf_dir, "pages").select("page_id", pages.template(F.col("html"), {"new": 'class="newsArea"', "article": "<article>"}).alias("template"), F.length("html").cast("long").alias("html_chars"))


@R.query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible blocks and subheadings of each page."""
    return pages.block_rows(table(spark, sf_dir, "pages"))


@R.query("""SELECT event_id, user_id, round(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 3) AS gap_seconds FROM events""")
def ledger_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between a user's events."""
    return ledgers.request_gaps(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id", "gap_seconds")


@R.query("""WITH x AS (SELECT event_id, user_id, event_type = 'error' AS e, lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id FROM x WHERE e AND coalesce(p, false)""")
def ledger_error_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which a user has two errors in a row."""
    return ledgers.error_pairs(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@R.query("""WITH x AS (SELECT user_id, (event_type = 'error')::INT AS f, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, sum(1 - f) AS run, sum(f) AS f FROM x GROUP BY ALL)
SELECT user_id, CAST(max(run) AS BIGINT) AS longest_success_streak, CAST(sum(f) AS BIGINT) AS n_failures FROM r GROUP BY user_id""")
def ledger_success_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest streak of successes between failures, by user."""
    return ledgers.success_streaks(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@R.query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase' AND value > 10) AS large_purchases, count(DISTINCT user_id) AS users, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1""")
def ledger_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and token sums by day, in one pass."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 10)).alias("large_purchases"),
        F.count_distinct("user_id").alias("users"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"),
    )


_REL = "greatest(0, least(raw_total, CASE WHEN major_risks >= 2 THEN 59 WHEN major_risks = 1 THEN 69 WHEN NOT publishable THEN 79 ELSE 100 END) - 3 * unsupported)"


@R.query(f"WITH {JUDGED_SQL} SELECT sample_id, condition, stage, CAST({_REL} AS BIGINT) AS adjusted FROM j")
def release_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release-adjusted score of each judged row."""
    return judged(spark, sf_dir).select("sample_id", "condition", "stage", metrics.release_adjusted(F.col("raw_total"), F.col("major_risks"), F.col("publishable"), F.col("unsupported")).cast("long").alias("adjusted"))


@R.query(f"WITH {JUDGED_SQL} SELECT condition, stage, count(*) AS n, round(avg(raw_total), 6) AS mean_raw, round(median(raw_total)::DOUBLE, 6) AS median_raw, round(stddev_pop(raw_total), 6) AS sd_raw, round(avg({_REL}), 6) AS mean_adjusted, round(avg(publishable::INT), 6) AS publishable_rate, CAST(sum(major_risks) AS BIGINT) AS major_risks FROM j GROUP BY ALL")
def score_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of the judged rows by condition and stage."""
    j = judged(spark, sf_dir)
    adjusted = metrics.release_adjusted(F.col("raw_total"), F.col("major_risks"), F.col("publishable"), F.col("unsupported"))
    r = lambda c: F.round(c, 6)
    return j.groupBy("condition", "stage").agg(F.count("*").alias("n"), r(F.avg("raw_total")).alias("mean_raw"), r(F.percentile("raw_total", F.lit(0.5))).alias("median_raw"), r(F.stddev_pop("raw_total")).alias("sd_raw"), r(F.avg(adjusted)).alias("mean_adjusted"), r(F.avg(F.col("publishable").cast("int"))).alias("publishable_rate"), F.sum("major_risks").alias("major_risks"))


_PAIR = "d AS (SELECT sample_id, condition, a.{v} AS draft, b.{v} AS final{x} FROM j a JOIN j b USING (sample_id, condition) WHERE a.stage = 'draft' AND b.stage = 'final')"


@R.query(f"WITH {JUDGED_SQL}, {_PAIR.format(v='raw_total', x='')} SELECT condition, count(*) AS n_pairs, round(avg(final - draft), 6) AS mean_delta, round(median(final - draft)::DOUBLE, 6) AS median_delta, count(*) FILTER (final > draft) AS improved, count(*) FILTER (final = draft) AS unchanged, count(*) FILTER (final < draft) AS worsened FROM d GROUP BY condition")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired change of the raw total from draft to final."""
    return metrics.paired_delta(judged(spark, sf_dir), "raw_total")


@R.query(f"""WITH {JUDGED_SQL}, {_PAIR.format(v='publishable', x='')}, t AS (SELECT condition, count(*) FILTER (draft AND final) AS kept, count(*) FILTER (NOT draft AND final) AS rescued, count(*) FILTER (draft AND NOT final) AS harmed, count(*) FILTER (NOT draft AND NOT final) AS failed, count(*) FILTER (sample_id % 4 <> 0) AS triggered FROM d GROUP BY condition)
SELECT *, CASE WHEN triggered > 0 THEN round(rescued / triggered, 6) END AS rescue_efficiency, CASE WHEN triggered > 0 THEN round(harmed / triggered, 6) END AS harm_rate FROM t""")
def publishability_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of publishability and their rates."""
    return metrics.publishability_transition(judged(spark, sf_dir), F.col("sample_id") % 4 != 0)


@R.query(f"WITH {JUDGED_SQL}, {_PAIR.format(v='unsupported', x='')} SELECT condition, count(*) FILTER (final < draft) AS reduced, count(*) FILTER (final = draft) AS unchanged, count(*) FILTER (final > draft) AS increased, CAST(sum(draft) AS BIGINT) AS total_draft, CAST(sum(final) AS BIGINT) AS total_final FROM d GROUP BY condition")
def count_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How counts of unsupported claims change."""
    n = lambda c: F.sum(c.cast("long"))
    a, b = F.col("draft"), F.col("final")
    return metrics.paired(judged(spark, sf_dir), "unsupported").groupBy("condition").agg(n(b < a).alias("reduced"), n(b == a).alias("unchanged"), n(b > a).alias("increased"), F.sum("draft").alias("total_draft"), F.sum("final").alias("total_final"))


_COND = f"k AS (SELECT condition || '_' || stage AS name, round(avg(unsupported), 6) AS claims, CAST(sum(major_risks) AS BIGINT) AS risks, round(avg({_REL}), 6) AS adjusted, round(avg(publishable::INT), 6) AS publishable FROM j GROUP BY ALL)"


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = metrics.release_adjusted(F.col("raw_total"), F.col("major_risks"), F.col("publishable"), F.col("unsupported"))
    return judged(spark, sf_dir).groupBy(F.concat_ws("_", "condition", "stage").alias("name")).agg(F.round(F.avg("unsupported"), 6).alias("claims"), F.sum("major_risks").alias("risks"), F.round(F.avg(adjusted), 6).alias("adjusted"), F.round(F.avg(F.col("publishable").cast("int")), 6).alias("publishable"))


@R.query(f"WITH {JUDGED_SQL}, {_COND} SELECT name, claims, risks, adjusted, publishable FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.name <> a.name AND b.claims <= a.claims AND b.risks <= a.risks AND b.adjusted >= a.adjusted AND b.publishable >= a.publishable AND (b.claims < a.claims OR b.risks < a.risks OR b.adjusted > a.adjusted OR b.publishable > a.publishable))")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions that no other dominates in two costs and two gains."""
    return metrics.pareto_frontier(_conditions(spark, sf_dir), "name", ["claims", "risks"], ["adjusted", "publishable"])


@R.query(f"""WITH {JUDGED_SQL}, f AS (SELECT sample_id, condition, raw_total FROM j WHERE stage = 'final'), b AS (SELECT sample_id, max(raw_total) AS best, count(*) AS n FROM f GROUP BY sample_id), x AS (SELECT f.*, best, n, sum((raw_total = best)::INT) OVER (PARTITION BY sample_id) AS tops FROM f JOIN b USING (sample_id) WHERE n > 1)
SELECT condition, count(*) FILTER (raw_total = best AND tops = 1) AS wins, count(*) FILTER (raw_total = best AND tops > 1) AS ties, count(*) FILTER (raw_total < best) AS losses FROM x GROUP BY condition""")
def win_tie_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins, ties and losses of conditions on their common samples."""
    return metrics.win_tie_loss(judged(spark, sf_dir).filter("stage = 'final'"), "raw_total")


@R.query(f"WITH {JUDGED_SQL}, p AS (SELECT condition, stage, avg(raw_total) AS m FROM j GROUP BY ALL) SELECT condition, round(avg(m), 6) AS macro_mean, CAST(count(*) AS BIGINT) AS n_stages FROM p GROUP BY condition")
def nested_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of stage means by condition."""
    return judged(spark, sf_dir).groupBy("condition", "stage").agg(F.avg("raw_total").alias("m")).groupBy("condition").agg(F.round(F.avg("m"), 6).alias("macro_mean"), F.count("*").alias("n_stages"))


_ISSUES = "i AS (SELECT event_id, user_id, event_type AS issue_type, CASE WHEN value > 20 THEN 'blocking' WHEN value > 10 THEN 'major' ELSE 'minor' END AS severity, CAST(ts AS DATE) AS day FROM events)"


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.col("event_type").alias("issue_type"), F.when(F.col("value") > 20, "blocking").when(F.col("value") > 10, "major").otherwise("minor").alias("severity"), F.to_date("ts").alias("day"))


@R.query(f"WITH {_ISSUES} SELECT issue_type, severity, count(*) AS n, count(DISTINCT user_id) AS samples FROM i GROUP BY ALL")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by type and severity."""
    return _issues(spark, sf_dir).groupBy("issue_type", "severity").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("samples"))


@R.query(f"WITH {_ISSUES}, m AS (SELECT user_id, issue_type, max(CASE severity WHEN 'blocking' THEN 3 WHEN 'major' THEN 2 ELSE 1 END) AS s FROM i GROUP BY ALL) SELECT user_id, coalesce(max(s) FILTER (issue_type = 'click'), 0) AS click, coalesce(max(s) FILTER (issue_type = 'error'), 0) AS error, coalesce(max(s) FILTER (issue_type = 'purchase'), 0) AS purchase, coalesce(max(s) FILTER (issue_type = 'signup'), 0) AS signup, coalesce(max(s) FILTER (issue_type = 'view'), 0) AS view FROM m GROUP BY user_id")
def issue_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest severity of each issue type by sample, as a matrix."""
    s = F.when(F.col("severity") == "blocking", 3).when(F.col("severity") == "major", 2).otherwise(1)
    kinds = ["click", "error", "purchase", "signup", "view"]
    return _issues(spark, sf_dir).withColumn("s", s).groupBy("user_id").pivot("issue_type", kinds).agg(F.max("s")).fillna(0)


@R.query(f"""WITH {_ISSUES}, g AS (SELECT user_id, day, array_to_string(list_sort(list(DISTINCT issue_type)), '+') AS signature FROM i WHERE severity <> 'minor' GROUP BY ALL) SELECT signature, count(*) AS n FROM g GROUP BY signature HAVING count(*) >= 2""")
def repeated_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of issue types that occur at least twice. A signature is a set of few types, so it is bounded."""
    g = _issues(spark, sf_dir).filter("severity <> 'minor'").groupBy("user_id", "day").agg(F.array_join(F.sort_array(F.collect_set("issue_type")), "+").alias("signature"))
    return g.groupBy("signature").agg(F.count("*").alias("n")).filter("n >= 2")


@R.query(f"""WITH {_ISSUES}, s AS (SELECT user_id, count(*) AS n, count(*) FILTER (severity = 'blocking') AS blocking, count(*) FILTER (severity = 'major') AS major FROM i GROUP BY user_id)
SELECT user_id, CASE WHEN blocking > 0.12 * n THEN 'dropped' WHEN major > 0 THEN 'accepted_with_warning' ELSE 'accepted' END AS state, blocking <= 0.05 * n AND major <= 0.2 * n AS gate FROM s""")
def terminal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal state and audit gate of each sample."""
    s = _issues(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if(F.col("severity") == "major").alias("major"))
    drop = F.when(F.col("blocking") > 0.12 * F.col("n"), "DROP").otherwise("PASS")
    return s.select("user_id", lineage.terminal_state(drop, F.lit(None).cast("string"), F.lit(0), F.col("major")).alias("state"), ((F.col("blocking") <= 0.05 * F.col("n")) & (F.col("major") <= 0.2 * F.col("n"))).alias("gate"))


@R.query(f"""WITH {_ISSUES}, a AS (SELECT DISTINCT user_id, issue_type FROM i WHERE event_id % 2 = 0 AND severity <> 'minor'), b AS (SELECT DISTINCT user_id, issue_type FROM i WHERE event_id % 2 = 1 AND severity <> 'minor')
SELECT user_id, issue_type FROM a JOIN b USING (user_id, issue_type)""")
def confirmed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that both of two reviewers report; the parity of the event names the reviewer."""
    i = _issues(spark, sf_dir).filter("severity <> 'minor'")
    side = lambda k: i.filter(F.col("event_id") % 2 == k).select("user_id", "issue_type").distinct()
    return side(0).join(side(1), ["user_id", "issue_type"])


@R.query("""SELECT o_custkey AS sample_id, o_orderkey AS record_id, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS tier, n_name AS source FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def lineage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of records: sample, status, tier and source, by equi-joins; Spark broadcasts a side only under its own size bound."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).select(F.col("o_custkey").alias("sample_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("tier"), F.col("n_name").alias("source"))


@R.query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) ")
def comparison_safe_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that were never exposed: an anti join."""
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@R.query("""WITH l AS (SELECT c_mktsegment AS a, CAST(count(*) AS VARCHAR) AS n, CAST(min(c_custkey) AS VARCHAR) AS f FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1), r AS (SELECT c_mktsegment AS a, CAST(count(*) AS VARCHAR) AS n, CAST(min(c_custkey) AS VARCHAR) AS f FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY 1)
SELECT * FROM (SELECT 'a' AS field, l.a AS left_value, r.a AS right_value FROM l, r UNION ALL SELECT 'n', l.n, r.n FROM l, r UNION ALL SELECT 'f', l.f, r.f FROM l, r) WHERE left_value IS DISTINCT FROM right_value""")
def experiment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which two experiment rows differ."""
    c = table(spark, sf_dir, "customer")
    row = lambda v: c.filter(F.col("c_mktsegment") == v).groupBy(F.col("c_mktsegment").alias("a")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("f"))
    return lineage.differing_fields(row("BUILDING"), row("MACHINERY"))


@R.query("""SELECT coalesce(r_name, 'all') AS region, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name)""")
def region_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by split with a grand total: a rollup over a three-way join."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, n.n_nationkey == s.s_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    return j.rollup("r_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance")).select(F.coalesce("r_name", F.lit("all")).alias("region"), "suppliers", "balance")
