"""Request and invocation ledgers: gaps, streaks and conditional counts over ordered logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def request_gaps(log: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Seconds since the key's row before; null for its first."""
    w = Window.partitionBy(key).orderBy(ts, order)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return log.withColumn("gap_seconds", F.round(micros(F.col(ts)) / 1e6 - micros(F.lag(ts).over(w)) / 1e6, 3))


def error_pairs(log: DataFrame, key: str, ts: str, order: str, error) -> DataFrame:
    """Rows at which a key has two errors in a row: where a stop rule would act."""
    w = Window.partitionBy(key).orderBy(ts, order)
    return log.withColumn("_e", error).filter("_e is not null").withColumn("_p", F.lag("_e").over(w)).filter(F.col("_e") & F.coalesce("_p", F.lit(False))).drop("_e", "_p")


def success_streaks(log: DataFrame, key: str, ts: str, order: str, failure) -> DataFrame:
    """(key, longest_success_streak, n_failures): islands between failures."""
    w = Window.partitionBy(key).orderBy(ts, order)
    x = log.withColumn("_f", failure.cast("long")).withColumn("_i", F.sum("_f").over(w))
    runs = x.groupBy(key, "_i").agg(F.sum(1 - F.col("_f")).alias("run"), F.sum("_f").alias("f"))
    return runs.groupBy(key).agg(F.max("run").alias("longest_success_streak"), F.sum("f").alias("n_failures"))
