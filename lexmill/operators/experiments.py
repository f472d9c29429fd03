"""Validation of crawl results, review matching and issue ledgers that work on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preflight_decision(title: Column, body: Column, gap: Column) -> Column:
    """(decision, quarantine) of a pair of different splits: the same event, uncertain, or different. An uncertain pair
    counts as different unless its bodies are 0.8 alike; then both articles wait."""
    near = lambda days: gap.isNull() | (gap <= days)
    same = (title >= 0.92) & (body >= 0.72) & near(14)
    unsure = ~same & (title >= 0.82) & (body >= 0.45) & near(31)
    return F.struct(F.when(same, "same_event").when(unsure, "uncertain").otherwise("different_event").alias("decision"), (unsure & (body >= 0.80)).alias("quarantine"))


def merged_issues(issues: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One issue a sample, type and set of facts, with the greatest severity and how many reports it stands for."""
    rank = F.element_at(F.create_map(*[F.lit(x) for p in {"minor": 1, "major": 2, "blocking": 3}.items() for x in p]), F.col("severity"))
    key = F.array_join(F.array_sort(F.array_distinct("fact_ids")), ",")
    g = issues.groupBy(sample, "issue_type", key.alias("facts")).agg(F.max(rank).alias("r"), F.count("*").alias("n_reports"))
    return g.select(sample, "issue_type", "facts", F.element_at(F.array(F.lit("minor"), F.lit("major"), F.lit("blocking")), F.col("r")).alias("severity"), "n_reports")


def confirmed(a: DataFrame, b: DataFrame, judge: DataFrame, keys: list[str]) -> DataFrame:
    """Issues that both reviewers report, and those of one that the judge upholds (judge: keys, upheld)."""
    both = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)
    one = a.select(*keys).unionByName(b.select(*keys)).distinct().join(both, keys, "left_anti")
    upheld = one.join(judge.filter("upheld").select(*keys).distinct(), keys, "left_semi")
    return both.withColumn("by", F.lit("both")).unionByName(upheld.withColumn("by", F.lit("judge")))


def independence(reviews: DataFrame) -> DataFrame:
    """One row over pairs of reviews (same_output, same_issues, explanation_ratio): counts, the mean ratio where the
    issues agree, and whether the reviewers look like one."""
    x = reviews.agg(F.count("*").alias("n"), F.count_if("same_output").alias("exact"), F.count_if("same_issues").alias("alike"), F.avg(F.when(F.col("same_issues"), F.col("explanation_ratio"))).alias("mean_ratio"))
    return x.withColumn("suspicious", (F.col("exact") >= 45) | ((F.col("alike") >= 48) & F.coalesce(F.col("mean_ratio") >= 0.95, F.lit(False))))


def with_best(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order; ties must be broken by the order itself."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def copy_share(fact: Column, sentence: Column) -> Column:
    """Share of common characters of a fact and a sentence: 2|c| / (|f| + |s|) over sets of characters."""
    f, s = F.array_distinct(F.split(fact, "")), F.array_distinct(F.split(sentence, ""))
    return F.when((F.length(fact) == 0) & (F.length(sentence) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(f, s)) / (F.size(f) + F.size(s)))
