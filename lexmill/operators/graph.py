"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import cut, release

MAX_ROUNDS = 60


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """Distinct edges in a table of their own, with their number and the sum of their hashes, taken while writing."""
    seen = Observation()
    out = cut(edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
    return out, seen.get


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that a link names; component is the smallest node that can be reached.

    Alternating large-star and small-star steps: every node hands its larger neighbours, then its smaller ones, to its
    smallest neighbour. The number of rounds grows with the logarithm of a component's size; each step is one
    aggregation and one join, so a node with very many links is split like any skewed join. Null ends are dropped.
    """
    e, sums = _kept(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")))
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        down = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        before, old = sums, e
        e, sums = _kept(small.filter("u <> v").select("v", "u"))
        release(old)
        if sums == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
