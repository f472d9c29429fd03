"""Tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: set[tuple[SparkSession, str]] = set()
_paths: dict[int, tuple] = {}


def _clean() -> None:
    """Drop the written tables of this session, where the session still runs."""
    for spark, path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            pass


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


atexit.register(_clean)


def _folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where driver and executors are one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "/tmp/checkpoints/lexmill"
    return top.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder that the cluster names in spark.checkpoint.dir.

    A lost executor costs no recomputation, columns are compressed and can be pruned. The tables go when the driver
    ends, or earlier by `release`.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, key=id(out): _paths.pop(key, None)), spark, path)
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by `cut` that no later action reads. Other frames are passed over."""
    for df in tables:
        ref, spark, path = _paths.get(id(df), (None, None, None))
        if ref is not None and ref() is df:
            _delete(spark, path)
            _written.discard((spark, path))
            del _paths[id(df)]


#: Most bytes and rows of an Arrow batch inside of `small_batches`.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


def bound_batches(spark: SparkSession) -> None:
    """From now on the session moves rows to Python in batches of bounded bytes, so that buffers of an executor and its
    workers stay small however wide the rows are. Smaller limits of the session stay."""
    for k, v in BATCH.items():
        own = spark.conf.get(k).lower().rstrip("b")
        if not own.isdigit() or int(own) <= 0 or int(own) > v:
            spark.conf.set(k, str(v))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """`bound_batches` for the actions inside; limits are put back afterwards."""
    before = {k: spark.conf.get(k) for k in BATCH}
    bound_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
