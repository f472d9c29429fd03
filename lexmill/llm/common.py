"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import table as table
from ..sources.shared import BATCH as BATCH, bound_batches as bound_batches, cut as cut, small_batches as small_batches

#: White space of the word contracts, as a character class body.
SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression to a lambda variable, so that it is evaluated once a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


#: Rows of a table of thresholds up to which it is sent to all workers; beyond that it is joined.
MAX_SENT = 10_000


def _sent(df: DataFrame) -> DataFrame:
    """A small table as a broadcast, once its rows are counted; else as it is."""
    rows = df.limit(MAX_SENT + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= MAX_SENT else df


def least_hashed(rows: DataFrame, key: str, k: int, by: str | None = None) -> DataFrame:
    """The k rows of least hash of a key, of all or of each value of `by`: a bounded sample that does not depend on order.

    Keys are counted by the first 12 bits of their hash, then by the next 12 where the bound falls, so that only k rows
    and a 2**-24th of the others are moved and ranked, however many rows and partitions there are.
    """
    h = F.xxhash64(key)
    own = [by] if by else []
    one = own or [F.lit(1)]
    bits = {"_h": h, "_b1": F.shiftrightunsigned(h, 52), "_b2": F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(4095))}
    # hashes alone are counted; texts are read for the rows that may be picked
    keys = rows.select(key, *own).withColumns(bits)

    def bound(counted: DataFrame, b: str, need: Column, extra: list[str]) -> DataFrame:
        """(by, extra, last bucket that is needed, rows still needed in it), from at most 4096 counts a value of `by`."""
        c = counted.groupBy(*own, *extra, b).agg(F.count("*").alias("_c")).withColumn("_u", F.sum("_c").over(Window.partitionBy(*one).orderBy(b)))
        return c.filter(F.col("_u") - F.col("_c") < need).groupBy(*own, *extra).agg(F.max(F.struct(F.col(b).alias("b"), (need - F.col("_u") + F.col("_c")).alias("need"))).alias("_x")).select(*own, *extra, F.col("_x.b").alias(f"_l{b[2:]}"), F.col("_x.need").alias("_need"))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, by) if by else left.join(right)

    first = _sent(bound(keys, "_b1", F.lit(k), []))
    second = _sent(bound(joined(keys, first).filter("_b1 = _l1").withColumnRenamed("_need", "_left"), "_b2", F.col("_left"), ["_l1", "_left"]).drop("_need", "_left"))
    near = joined(rows.withColumns(bits), second).filter("_b1 < _l1 or (_b1 = _l1 and _b2 <= _l2)")
    rank = F.row_number().over(Window.partitionBy(*one).orderBy("_b1", "_b2", "_h", key))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_h", "_b1", "_b2", "_l1", "_l2")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift and multiply); a bijection on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
