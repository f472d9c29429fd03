"""Binding of the test tables to the engine's concepts: articles, messages, ledgers and judged scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


#: Tables whose rows are texts: work on them costs far more than moving them.
TEXTS = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is. A table of texts with fewer splits than the cluster has cores is dealt out evenly; a large one
    has more splits than cores and is read where it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, body, publish_date (a day of 2024 that follows from the id), lang, source."""
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id"), F.lit(365)).cast("int"))
    return d.select("doc_id", T.title(F.coalesce("text", F.lit(""))).alias("title"), F.coalesce("text", F.lit("")).alias("body"), day.alias("publish_date"), "lang", "source")


ARTICLES_SQL = """a AS (SELECT doc_id, coalesce(substring(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 1, 80), '') AS title,
  coalesce(text, '') AS body, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS publish_date, lang, source FROM documents)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's score cube: sample_id, condition, stage, raw_total, major_risks, publishable, unsupported."""
    x = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return (
        x.select(
            F.col("l_orderkey").alias("sample_id"), F.element_at(F.array(F.lit("q4"), F.lit("q6"), F.lit("q8")), (n % 3 + 1).cast("int")).alias("condition"),
            F.when(n <= 3, "draft").otherwise("final").alias("stage"), F.col("l_quantity").cast("long").alias("q"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("p"),
        )
        .groupBy("sample_id", "condition", "stage")
        .agg((F.max("q") * 2).alias("raw_total"), F.max(F.col("s") % 3).alias("major_risks"), F.min(F.col("f") != "R").alias("publishable"), F.min(F.col("p") % 4).alias("unsupported"))
    )


JUDGED_SQL = """j AS (SELECT l_orderkey AS sample_id, CASE l_linenumber % 3 WHEN 0 THEN 'q4' WHEN 1 THEN 'q6' ELSE 'q8' END AS condition, CASE WHEN l_linenumber <= 3 THEN 'draft' ELSE 'final' END AS stage,
  max(CAST(l_quantity AS BIGINT)) * 2 AS raw_total, max(l_suppkey % 3) AS major_risks, bool_and(l_returnflag <> 'R') AS publishable, min(l_partkey % 4) AS unsupported FROM lineitem GROUP BY ALL)"""
