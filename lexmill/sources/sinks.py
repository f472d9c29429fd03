"""Sinks: canonical JSON lines, and frozen datasets with checksums that are never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(df: DataFrame, columns: list[str] | None = None):
    """A record as JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*sorted(columns or df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted rows as canonical JSON lines."""
    df.orderBy(*order).select(canonical_json(df).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, escape='"')


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """file, sha256 of the files under a folder, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def freeze(splits: dict[str, DataFrame], folder: str, version: str) -> None:
    """Write splits beside their checksums and a version; an existing folder is an error. The version comes last: a
    folder without one is not a dataset."""
    spark = next(iter(splits.values())).sparkSession
    for name, df in splits.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    sums = [checksums(spark, f"{folder}/{n}").filter("file like '%.parquet'").withColumn("split", F.lit(n)) for n in splits]
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    out.write.mode("errorifexists").json(f"{folder}/checksums")
    spark.createDataFrame([(version,)], "value string").write.mode("errorifexists").text(f"{folder}/VERSION")


def changed_files(spark: SparkSession, folder: str, splits: list[str]) -> DataFrame:
    """Files whose checksum is not the frozen one, or that are missing or new."""
    from ..operators.lineage import manifest_diff

    frozen = spark.read.schema("file string, sha256 string, split string").json(f"{folder}/checksums")
    now = None
    for n in splits:
        s = checksums(spark, f"{folder}/{n}").filter("file like '%.parquet'")
        now = s if now is None else now.unionByName(s)
    return manifest_diff(frozen, now, "file", "sha256").filter("status <> 'same'")
