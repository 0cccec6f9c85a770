"""Sinks: append-only CSV, compaction, pivoted summaries, JSON lines, caches and audit artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sluicegate.ident import fingerprint
from sluicegate.operators.ledger import upsert


def append_csv(df: DataFrame, path: str) -> None:
    """Rows in new files, each with a header; money with 10 decimals where a column is named cost_usd."""
    if "cost_usd" in df.columns:
        df = df.withColumn("cost_usd", F.format_string("%.10f", "cost_usd"))
    df.write.mode("append").option("header", True).csv(path)


def compact(spark: SparkSession, source: str, target: str, columns: list[str], drop) -> None:
    """The rows of source without those of the predicate, in a new folder that takes its place when it is complete."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(source)
    rows.where(~drop).write.mode("errorifexists").option("header", True).csv(target)


def pivot_scores(df: DataFrame, models: list[str]) -> DataFrame:
    """One row a task with published__<model> columns.  df: task, model, score."""
    wide = df.groupBy("task").pivot("model", models).agg(F.max("score"))
    return wide.select("task", *(F.col(f"`{m}`").alias(f"published__{m}") for m in models))


def partitioned_csv(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def manifest(spark: SparkSession, path: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_bank(parts: dict[str, DataFrame], path: str) -> None:
    """Named parts as JSON lines; the manifest, with their schemas, comes last, so that a bank without one is unfinished."""
    for name, df in parts.items():
        json_lines(df, f"{path}/{name}", "overwrite")
    manifest(parts[next(iter(parts))].sparkSession, f"{path}/manifest", {name: json.loads(df.schema.json()) for name, df in parts.items()})


def load_bank(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    found = read_manifest(spark, f"{path}/manifest")
    return {name: spark.read.schema(T.StructType.fromJson(schema)).json(f"{path}/{name}") for name, schema in found.items()}


def cached(df: DataFrame, key: str, columns: list[str], folder: str, compute) -> DataFrame:
    """compute(df), kept as Parquet under the fingerprint of the content; a second call with equal content reads it."""
    digest = fingerprint(df, key, *columns).first()["fingerprint"]
    path = f"{folder}/{digest}"
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        compute(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def score_cache(cache: DataFrame, asked: DataFrame, key: str, compute) -> DataFrame:
    """The cache with asked keys that it lacked computed and put in."""
    return upsert(cache, compute(asked.join(cache, key, "left_anti")), key)


def audit(df: DataFrame, expected: dict, path: str) -> None:
    """Write a one-row result as JSON and raise where it drifts from the expected values."""
    found = df.first().asDict()
    df.coalesce(1).write.mode("overwrite").json(path)
    drift = {k: (found.get(k), v) for k, v in expected.items() if found.get(k) != v}
    if drift:
        raise ValueError(f"results drifted: {drift}")
