"""Manifests, lineage and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_diff(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Status of each entry of two manifests."""
    l, r = left.select(F.col(key), F.col(digest).alias("_l")), right.select(F.col(key), F.col(digest).alias("_r"))  # noqa: E741
    status = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.col("_l") != F.col("_r"), "changed").otherwise("same")
    return l.join(r, key, "full_outer").select(key, status.alias("status"))


def integrity(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Names of the checks that do not hold over all rows; no row where all do."""
    row = rows.agg(*[F.coalesce(F.min(c), F.lit(True)).alias(n) for n, c in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("holds")) for n in checks])).alias("x")).select("x.*").filter("not holds").select("check")


def differing_fields(left: DataFrame, right: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Fields in which two one-row tables differ."""
    names = [c for c in left.columns if c not in ignored]
    both = left.select(*[F.col(c).cast("string").alias(f"l_{c}") for c in names]).join(F.broadcast(right.select(*[F.col(c).cast("string").alias(f"r_{c}") for c in names])))
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value")) for c in names])).alias("x")).select("x.*").filter("not (left_value <=> right_value)")


def terminal_state(review: Column, rereview: Column, core_issues: Column, soft_warnings: Column) -> Column:
    """dropped, accepted_with_warning or accepted."""
    return F.when((review == "DROP") | F.coalesce(rereview != "PASS", F.lit(False)) | (core_issues > 0), "dropped").when(soft_warnings > 0, "accepted_with_warning").otherwise("accepted")
