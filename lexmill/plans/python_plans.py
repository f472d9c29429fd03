"""Queries whose semantics SQL can't express: they are held against plain Python in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import python_text as P
from ..functions import text as T
from ..operators import dedup, facts, grouping
from ..operators.dedup import shared_rare_keys
from ..operators.graph import components
from ..operators.tables import articles, table
from ..sources.shared import cut
from .other_plans import _pairs
from .registry import Registry

R = Registry()


@R.query()
def rouge_l_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ROUGE-L of the pairs, by bit-parallel longest common subsequences."""
    lcs = P.arrow(lambda a, b: P.lcs_length(list(a), list(b)), "long")
    p = _pairs(spark, sf_dir).select(T.metric_tokens(F.col("prediction")).alias("p"), T.metric_tokens(F.col("reference")).alias("r"))
    m = p.select(lcs("p", "r").alias("m"), F.size("p").alias("a"), F.size("r").alias("b"))
    return m.agg(F.count("*").alias("n_pairs"), F.round(F.avg(F.when(F.col("m") == 0, 0.0).otherwise(2.0 * F.col("m") / (F.col("a") + F.col("b")))), 6).alias("rouge_l"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of each title."""
    return articles(spark, sf_dir).filter(F.length("title") >= 5).groupBy("title").agg(F.min("doc_id").alias("id"))


@R.query()
def simhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of each article's whole body with its four 16-bit bands, low to high."""
    h = articles(spark, sf_dir).select(F.col("doc_id").alias("id"), P.arrow(lambda x: P.simhash64(x), "long")("body").alias("simhash"))
    return h.select("id", "simhash", *[F.shiftrightunsigned("simhash", 16 * k).bitwiseAND(F.lit(0xFFFF)).cast("long").alias(f"band{k}") for k in range(4)])


@R.query()
def doc_body_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles whose whole bodies' 5-gram sets are 0.9 alike, and the exact copies of each body."""
    return dedup.body_pairs(articles(spark, sf_dir), 90)


@R.query()
def doc_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles whose title vectors have a cosine of 0.9, and the copies b of each title with their first row a."""
    from ..operators import features
    from .document_plans import _title_vectors

    a = articles(spark, sf_dir).select("doc_id", "title")
    first = a.groupBy("title").agg(F.min("doc_id").alias("a"))
    copies = a.join(first, "title").filter("doc_id <> a and title <> ''").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("cosine"), F.lit("exact").alias("kind"))
    v = _title_vectors(spark, sf_dir).join(first.select(F.col("a").alias("doc_id")), "doc_id", "left_semi")
    return copies.unionByName(features.cosine_pairs(v, "doc_id", 0.9).withColumn("kind", F.lit("near")))


@R.query()
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected articles of the three stages of deduplication, over whole texts."""
    return dedup.deduplicate(articles(spark, sf_dir))


@R.query()
def doc_event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of one event among all articles, by year and rare title trigrams or equal titles, with the decision."""
    a = articles(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", "body", "publish_date")
    return grouping.event_candidates(a, cap=6, least=0.3, max_days=90, exact_days=180)


@R.query()
def event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete-link groups of the candidate pairs that are the same event, at most 12 articles a group."""
    c = doc_event_candidates(spark, sf_dir).filter("same_event")
    edges = cut(c.select("a", "b", F.col("body_similarity").alias("body"), F.col("title_similarity").alias("title"), "pair_id"))
    return grouping.event_groups(edges, components(grouping.spanning(edges)), cap=12)


@R.query()
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of groups of articles (source and language) in 80/10/10, balanced by year half and length.

    The table of groups, one row a group, goes to the driver as the operator is defined; its size follows the number of
    sources, not of rows, and is checked.
    """
    a = articles(spark, sf_dir)
    g = a.groupBy(F.concat_ws("_", "source", "lang").alias("group_id"), F.when(F.month("publish_date") <= 6, "h1").otherwise("h2").alias("half"), T.length_bucket_le(F.length("body")).alias("bucket")).agg(F.count("*").alias("n"))
    limit = 200_000
    rows = g.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("too many groups for assignment on the driver; group more coarsely")
    groups: dict[str, dict] = {}
    for r in rows:
        x = groups.setdefault(r.group_id, {"group_id": r.group_id, "size": 0, "half": {}, "bucket": {}})
        x["size"] += r.n
        for d in ("half", "bucket"):
            x[d][r[d]] = x[d].get(r[d], 0) + r.n
    n = sum(x["size"] for x in groups.values())
    train, validation = -(-n * 4 // 5), round(n / 10)
    got = grouping.assign_splits(list(groups.values()), {"train": train, "validation": validation, "test": n - train - validation}, "seed", ("half", "bucket"))
    return spark.createDataFrame(sorted((k, v, groups[k]["size"]) for k, v in got.items()) or [], "group_id string, split string, size long")


@R.query()
def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence similarity of titles that share a rare trigram."""
    t = _titles(spark, sf_dir)
    pairs = shared_rare_keys(t.withColumn("k", T.char_ngrams(F.col("title"), 3)).withColumn("all", F.lit(1)), "id", "k", 4, ["all"])
    x = pairs.join(t.toDF("ta", "a"), "a").join(t.toDF("tb", "b"), "b")
    return x.select("a", "b", F.round(P.arrow(lambda p, q: P.sequence_ratio(p, q), "double")("ta", "tb"), 6).alias("ratio"))


@R.query()
def semantic_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact-sized units of each article: how many, the longest, and a hash of them in order."""
    units = P.arrow(lambda ps: [t for _, t in P.semantic_units(list(ps))], "array<string>")
    u = articles(spark, sf_dir).select("doc_id", units(T.paragraphs(F.col("body"))).alias("u"))
    return u.select("doc_id", F.size("u").cast("long").alias("n_units"), F.coalesce(F.array_max(F.transform("u", F.length)), F.lit(0)).cast("long").alias("longest"), F.sha2(F.array_join("u", "\n"), 256).alias("units_sha256"))


def _validated(paragraphs: list[str]) -> list[str]:
    ps = list(paragraphs)
    rows = [{"fact_id": f"F{i:02d}", "fact": t, "evidence_paragraph_ids": ids} for i, (ids, t) in enumerate(P.semantic_units(ps), 1)]
    return [str(len(rows)), f"{facts.coverage(rows, ps):.6f}", *facts.validate_facts(rows, ps)]


@R.query()
def fact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of each article held as facts against the paragraphs that they cite: codes of what is wrong, coverage."""
    v = articles(spark, sf_dir).select("doc_id", P.arrow(lambda ps: _validated(ps), "array<string>")(T.paragraphs(F.col("body"))).alias("v"))
    return v.select("doc_id", F.get("v", F.lit(0)).cast("long").alias("n_facts"), F.get("v", F.lit(1)).cast("double").alias("coverage"), F.slice("v", 3, F.size("v")).alias("codes"))


def _supported(prediction: str, reference: str) -> list[list[str]]:
    kept, missing, new = facts.retention([reference], prediction)
    shown = lambda x: [f"{k}:{v}" for k, v in x]
    return [facts.unsupported_numbers(prediction, reference), facts.unsupported_dates(prediction, reference), shown(kept), shown(missing), shown(new)]


@R.query()
def turn_fact_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each assistant turn: numbers and dates that the user turn before does not support, and anchors kept, missing and new."""
    held = P.arrow(lambda a, b: _supported(a, b), "array<array<string>>")
    names = ("unsupported_numbers", "unsupported_dates", "retained", "missing", "new")
    return _pairs(spark, sf_dir).select("id", held("prediction", "reference").alias("v")).select("id", *[F.get("v", F.lit(k)).alias(n) for k, n in enumerate(names)])


@R.query()
def title_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of each title in normalized form."""
    return articles(spark, sf_dir).select("doc_id", P.arrow(lambda x: P.entities(x), "array<string>")("title").alias("entities"), P.arrow(lambda x: P.event_text(x), "string")("title").alias("normalized"))


@R.query()
def span_repeat_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns in which a span of 8 to 80 characters stands three times in a row."""
    return _pairs(spark, sf_dir).select("id", P.arrow(lambda x: P.span_repeats(x), "boolean")("prediction").alias("span_repeat"))


@R.query()
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation packed in order into batches of at most 5 rows and 4,000 characters."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("sizes"))
    pack = P.arrow(lambda s: P.pack_batches(list(s), 5, 4000), "array<array<int>>")
    return c.select("conv_id", pack("sizes").alias("batches"))


@R.query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean paired change of each condition with a bootstrap interval of 10,000 draws (seed 42) and the exact McNemar p.

    Draws need the differences' counts only: a condition is reduced to its histogram, so the driver holds a few hundred
    numbers whatever the number of pairs, and a draw of n pairs is one multinomial draw.
    """
    import numpy as np

    from ..operators import metrics
    from ..operators.tables import judged

    j = judged(spark, sf_dir)
    h = metrics.paired(j, "raw_total").groupBy("condition", (F.col("final") - F.col("draft")).alias("d")).agg(F.count("*").alias("n")).collect()
    t = {r.condition: r for r in metrics.publishability_transition(j, F.lit(True)).collect()}
    out = []
    for c in sorted({r.condition for r in h}):
        d, n = (np.array(x, float) for x in zip(*[(r.d, r.n) for r in sorted(h, key=lambda r: r.d) if r.condition == c]))
        draws = np.random.default_rng(42).multinomial(int(n.sum()), n / n.sum(), 10_000) @ d / n.sum()
        lo, hi = np.quantile(draws, [0.025, 0.975])
        out.append((c, float((d * n).sum() / n.sum()), float(lo), float(hi), metrics.mcnemar(t[c].rescued, t[c].harmed)))
    return spark.createDataFrame(out, "condition string, mean_delta double, low double, high double, mcnemar_p double")
