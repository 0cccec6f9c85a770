"""Readers with schemas that are checked, and a registry of named datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from sluicegate.operators.joined import DataContractError

_DATASETS: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register(name: str):
    """Decorator: a loader spark -> DataFrame under a name."""

    def add(f: Callable[[SparkSession], DataFrame]):
        if name in _DATASETS:
            raise ValueError(f"dataset {name} is registered already")
        _DATASETS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str) -> DataFrame:
    if name not in _DATASETS:
        raise KeyError(f"no dataset {name}; there are {', '.join(available())}")
    return _DATASETS[name](spark)


def available() -> list[str]:
    return sorted(_DATASETS)


def _strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def exact_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """All-string rows, without nulls: an empty field is an empty string.  The header must be exactly columns, in order, and
    every line must parse.  Only the header line comes to the driver."""
    import csv

    head = spark.read.text(path).limit(1).collect()
    found = next(csv.reader([head[0][0].lstrip("﻿")], delimiter=sep)) if head else []
    if found != columns:
        raise DataContractError(f"{path}: header {found}, expected {columns}")
    return spark.read.schema(_strings(columns)).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path).na.fill("")


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns cast as named; an empty value is null, and one that doesn't cast raises when it is read."""
    return df.withColumns({c: F.when(F.col(c) != "", F.col(c)).cast(k) for c, k in kinds.items()})


#: The columns of the two prediction files.
FILE_A = ["task", "candidate", "repeat", "fold", "item_idx", "text_sha256", "gold", "pred", "p_pred", "kept", "set_size"]
FILE_B = ["task", "model_key", "item_idx", "text_sha256", "gold", "raw_output", "pred", "parse_ok", "in_tokens", "out_tokens", "cached_tokens", "cost_usd", "latency_s", "ts"]


def _one(df: DataFrame, *columns: str) -> None:
    for c in columns:
        if df.select(c).distinct().limit(2).count() != 1:
            raise DataContractError(f"{c} must have one value")


def file_a(spark: SparkSession, path: str) -> DataFrame:
    """Out-of-fold predictions of a cheap arm: labels stripped and lower-cased; every repeat has each item once, and the
    same items."""
    df = typed(exact_csv(spark, path, FILE_A), repeat="int", fold="int", item_idx="int", p_pred="double", kept="int", set_size="int")
    df = df.withColumns({c: F.lower(F.trim(c)) for c in ("gold", "pred")})
    _one(df, "task", "candidate")
    if not df.groupBy("repeat", "item_idx").count().where("count > 1").isEmpty():
        raise DataContractError(f"{path}: a repeat has an item twice")
    n = df.select("repeat").distinct().count()
    if not df.groupBy("item_idx").agg(F.countDistinct("repeat").alias("r")).where(F.col("r") != n).isEmpty():
        raise DataContractError(f"{path}: repeats cover different items")
    return df


def file_b(spark: SparkSession, path: str) -> DataFrame:
    """Outputs of an expensive arm: items 0 .. n - 1, each once; gold stripped and lower-cased, pred as it is."""
    df = typed(exact_csv(spark, path, FILE_B), item_idx="int", parse_ok="int", in_tokens="int", out_tokens="int", cached_tokens="int", cost_usd="double", latency_s="double")
    df = df.withColumn("gold", F.lower(F.trim("gold")))
    _one(df, "task", "model_key")
    s = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_idx").alias("d"), F.min("item_idx").alias("lo"), F.max("item_idx").alias("hi")).first()
    if s["n"] != s["d"] or s["lo"] != 0 or s["hi"] != s["n"] - 1:
        raise DataContractError(f"{path}: items are not 0 .. n - 1, each once")
    return df


def is_error_row(column: str = "raw_output"):
    """Rows of calls that failed."""
    return F.startswith(F.col(column), F.lit("<error:"))


def with_text(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """text: the input columns joined by a blank line; rows without a label go."""
    return df.where(F.col(label).isNotNull() & (F.trim(F.col(label)) != "")).withColumn("text", F.concat_ws("\n\n", *columns))


def splits(frames: dict[str, DataFrame]) -> DataFrame:
    """Named splits as one frame with a split column."""
    out = None
    for name, df in frames.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def class_names(df: DataFrame, column: str) -> list[str]:
    """Class names from the column's metadata."""
    return list(df.schema[column].metadata.get("names", []))


def published_scores(df: DataFrame) -> DataFrame:
    """Per task: scores by model, and the best model (smallest name on ties).  df: task, model, score."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "model"))
    return df.groupBy("task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "score")))).alias("scores"), best["model"].alias("best_model"), (-best["s"]).alias("best_score"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """Usage records of differing shapes in one: model, tokens_in, tokens_out, cost, job."""
    s = "model string, engine string, prompt_tokens long, input_tokens long, completion_tokens long, output_tokens long, cost double, usd double, job string, task string"
    d = jsonl(spark, path, s)
    return d.select(F.coalesce("model", "engine").alias("model"), F.coalesce("prompt_tokens", "input_tokens").alias("tokens_in"), F.coalesce("completion_tokens", "output_tokens").alias("tokens_out"), F.coalesce("cost", "usd").alias("cost"), F.coalesce("job", "task").alias("job"))


def upload(spark: SparkSession, path: str, max_rows: int = 10_000) -> DataFrame:
    """(text, label) of an uploaded JSONL: aliases text, sentence, query and label, intent, category, class; raises on a line
    that isn't JSON or lacks either, on too many rows and on fewer than two classes."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = "text string, sentence string, query string, label string, intent string, category string, `class` string"
    rows = lines.select("value", F.from_json("value", fields).alias("r"))
    rows = rows.select("value", F.coalesce("r.text", "r.sentence", "r.query").alias("text"), F.coalesce("r.label", "r.intent", "r.category", "r.class").alias("label"))
    bad = rows.where("text is null or trim(text) = '' or label is null").limit(1).collect()
    if bad:
        raise DataContractError(f"{path}: no text and label in {bad[0]['value'][:80]!r}")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    if n["n"] > max_rows or n["k"] < 2:
        raise DataContractError(f"{path}: {n['n']} rows and {n['k']} classes; at most {max_rows} rows and two classes at least are needed")
    return rows.select("text", "label")


def artifacts(spark: SparkSession, glob: str, schema: str, task: str = "task") -> DataFrame:
    """The newest artifact of each task, by the files' modification times."""
    d = spark.read.schema(schema).option("multiLine", True).json(glob).select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_path"))
    return d.withColumn("_r", F.row_number().over(W.partitionBy(task).orderBy(F.desc("_at"), "_path"))).where("_r = 1").drop("_r", "_at", "_path")


def aligned_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, lines from 0, for a join with another file by line.  Lines are numbered per file part
    and parts by their place in the file, so no task reads the whole file."""
    d = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"))
    local = d.withColumn("_n", F.row_number().over(W.partitionBy("_s").orderBy("_i")))
    sizes = local.groupBy("_s").agg(F.max("_n").alias("_c"))
    offsets = sizes.select("_s", (F.sum("_c").over(W.partitionBy(F.lit(0)).orderBy("_s")) - F.col("_c")).alias("_o"))
    return local.join(F.broadcast(offsets), "_s").select((F.col("_o") + F.col("_n") - 1).alias("line"), "value")


def ontology(spark: SparkSession, path: str, row_tag: str = "owl:Class") -> DataFrame:
    """(id, label, parents, alternatives, definition) from an OWL/XML file."""
    schema = "`_rdf:about` string, `rdfs:label` string, `rdfs:subClassOf` array<struct<`_rdf:resource`: string>>, `skos:altLabel` array<string>, `skos:definition` string"
    d = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    parents = F.transform(F.coalesce("rdfs:subClassOf", F.array().cast("array<struct<`_rdf:resource`: string>>")), lambda p: p["_rdf:resource"])
    return d.select(F.col("`_rdf:about`").alias("id"), F.col("`rdfs:label`").alias("label"), F.array_compact(parents).alias("parents"), F.coalesce("`skos:altLabel`", F.array().cast("array<string>")).alias("alternatives"), F.col("`skos:definition`").alias("definition"))
