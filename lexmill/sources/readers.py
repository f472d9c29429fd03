"""Scans: JSON lines, CSV, checkpoint folders, trainer logs, run manifests, id lists and flat YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped. Strict: a line that is not valid fails the read; else it is kept in
    `_corrupt_record`."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if strict:
        return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("x")).select("x.*")
    kept = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    return lines.select(F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("x")).select("x.*")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def checkpoints(spark: SparkSession, folder: str, schema: str, id_col: str) -> DataFrame:
    """Results of a checkpoint folder; an id that occurs twice is an error."""
    rows = spark.read.schema(schema).json(folder)
    twice = rows.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"duplicate ids in {folder}")
    return rows


def trainer_log(spark: SparkSession, path: str) -> DataFrame:
    """step, epoch, loss, eval_loss, examples_seen of a trainer's log history."""
    schema = "log_history array<struct<step:long,epoch:double,loss:double,eval_loss:double,effective_batch:long>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("log_history").alias("x")).select("x.*")
    return rows.withColumn("examples_seen", F.col("step") * F.col("effective_batch"))


def best_and_last(log: DataFrame) -> DataFrame:
    """Best evaluation loss with its step, and the last one."""
    e = log.filter("eval_loss is not null")
    return e.agg(F.min("eval_loss").alias("best_loss"), F.min_by("step", F.struct("eval_loss", "step")).alias("best_step"), F.max_by("eval_loss", "step").alias("last_loss"))


def runs(manifests: DataFrame, measured: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row a run: fields of its metrics over those of its manifest, empty where neither has one."""
    m = measured.select(key, *[F.col(c).cast("string").alias(f"_m_{c}") for c in fields if c in measured.columns])
    value = lambda c: F.coalesce(*([F.col(f"_m_{c}")] if c in measured.columns else []), *([F.col(c).cast("string")] if c in manifests.columns else []), F.lit("")).alias(c)
    return manifests.join(m, key, "left").select(key, *[value(c) for c in fields])


def id_list(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Ids of a text file, one a line; checks that they are unique and as many as expected."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")
    n, d = ids.agg(F.count("*"), F.count_distinct("id")).first()
    if n != d or expected not in (None, n):
        raise ValueError(f"{path}: {n} ids, {d} distinct, {expected} expected")
    return ids


def flat_yaml(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a flat YAML file; comments and blank lines are skipped, quotes around a value dropped."""
    parts = F.split("value", ":", 2)
    rows = spark.read.text(path).filter("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return rows.select(F.trim(parts[0]).alias("key"), F.regexp_replace(F.trim(parts[1]), r"^(['\"])(.*)\1$", "$2").alias("value"))


ALLOWED = {"training": {"train"}, "selection": {"validation"}, "final": {"test"}}


def split_for(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of a split that a purpose may read; an unknown purpose reads nothing."""
    if purpose not in ALLOWED:
        raise PermissionError(f"no split may be read for {purpose!r}")
    return df.filter(F.col("split").isin(*ALLOWED[purpose]))
