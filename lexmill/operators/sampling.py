"""Seeded samples, quotas, rotations and split targets. Ranks come from hashes, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha_rank


def hash_sample(rows: DataFrame, key: str, seed: str, k: int, sep: str = "|", strata: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of least seeded hash, of all or of each stratum, with their rank."""
    h = rows.withColumn("_h", sha_rank(seed, sep, F.col(key)))
    if not strata:
        return h.orderBy("_h", key).limit(k).drop("_h")
    w = Window.partitionBy(*strata).orderBy("_h", key)
    return h.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_h")


def quota_sample(rows: DataFrame, key: str, seed: str, strata: list[tuple[str, Column, int]]) -> DataFrame:
    """Rows of each stratum in order, up to its quota, without a row that an earlier stratum took; k rows a stratum."""
    out = None
    for name, holds, quota in strata:
        left = rows.filter(holds)
        if out is not None:
            left = left.join(out.select(key), key, "left_anti")
        got = hash_sample(left, key, f"{seed}|{name}", quota).withColumn("stratum", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def rate_sample(rows: DataFrame, key: str, seed: str, percent: int, times: int = 1) -> DataFrame:
    """`times` ceil(percent of the rows) rows of least hash: a rank over the whole table, in two steps.

    Rows are counted by a prefix of their hash; the prefixes that lie fully under the bound are taken as they are, and
    only the one prefix that holds the bound is ranked.
    """
    h = rows.withColumn("_h", sha_rank(seed, "|", F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    counts = h.groupBy("_b").agg(F.count("*").alias("_c"))
    k = F.ceil(F.sum("_c").over(Window.partitionBy()) * percent / 100) * times
    upto = F.sum("_c").over(Window.partitionBy(F.lit(1)).orderBy("_b"))
    bounds = F.broadcast(counts.select("_b", (k - (upto - F.col("_c"))).alias("_left"), "_c").filter("_left > 0"))  # 4096 rows at most
    whole = h.join(bounds, "_b")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    part = whole.filter("_left < _c").withColumn("_r", rank).filter("_r <= _left")
    return whole.filter("_left >= _c").select(*rows.columns).unionByName(part.select(*rows.columns))


def escalation(rows: DataFrame, key: str, seed: str, percent: int, rate: float) -> DataFrame:
    """(key, round) of an audit of rows (key, stratum, hard, blocking) that widens while it finds hard rows.

    Round 1 is a percentage of the rows; round 2 as many others, if over `rate` of round 1 is hard or any of it blocks;
    round 3 all remaining rows of the strata that hold a hard row of round 2, if over `rate` of round 2 is hard.
    """
    first = rate_sample(rows, key, seed, percent)
    go = first.agg(F.avg(F.col("hard").cast("int")).alias("r"), F.max("blocking").alias("b")).filter((F.col("r") > rate) | F.col("b")).select()
    second = rate_sample(rows, key, seed, percent, 2).join(first.select(key), key, "left_anti").join(F.broadcast(go))
    bad = second.filter("hard").select("stratum").distinct()
    more = F.broadcast(second.agg(F.avg(F.col("hard").cast("int")).alias("r")).filter(F.col("r") > rate).select())
    seen = first.select(key).unionByName(second.select(key))
    third = rows.join(seen, key, "left_anti").join(bad, "stratum", "left_semi").join(more)
    out = None
    for n, part in enumerate((first, second, third), 1):
        part = part.select(key, F.lit(n).alias("round"))
        out = part if out is None else out.unionByName(part)
    return out


def rotation(rows: DataFrame, key: str, labels: tuple[str, ...]) -> DataFrame:
    """(key, condition, label): blind labels rotated by a hash of the key, balanced in expectation and free of order."""
    n = len(labels)
    turn = F.pmod(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    at = [F.struct(F.lit(f"c{i}").alias("condition"), F.element_at(F.array(*map(F.lit, labels)), F.pmod(F.lit(i) + turn, F.lit(n)).cast("int") + 1).alias("label")) for i in range(n)]
    return rows.select(key, F.explode(F.array(*at)).alias("x")).select(key, "x.*")


def split_of(key: Column, seed: str) -> Column:
    """train, validation or test by the hash of a key, 80/10/10; rows of one key stay together."""
    b = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "|"), key.cast("string")), 256), 1, 8), 16, 10).cast("long"), F.lit(10))
    return F.when(b < 8, "train").when(b == 8, "validation").otherwise("test")


def split_targets(n: Column) -> dict[str, Column]:
    """Sizes of the splits of n rows: 80 % rounded up, 10 % rounded half to even, the rest."""
    train, validation = F.ceil(n * 4 / 5).cast("long"), F.bround(n / 10).cast("long")
    return {"train": train, "validation": validation, "test": n - train - validation}
