"""Queries that go through sources and sinks: what is written to the shared folder is read back by the checked readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluicegate.operators.sizes import shared_folder
from sluicegate.plans.arms import ARMS, LONG, arms, long_preds
from sluicegate.plans.base import query, rounded
from sluicegate.session import read
from sluicegate.sources import adapters, readers, writers


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/sources/{uuid.uuid4().hex}"


@query(f"WITH {ARMS} SELECT r::INT AS repeat, 'class ' || gold AS gold, count(*) AS n, count(*) FILTER (gold = free_pred) AS hits, sum((free_conf >= 0.3)::INT)::BIGINT AS kept, round(sum(free_conf), 4) AS confidence FROM arms, range(2) r(r) GROUP BY ALL")
def prediction_file(spark, sf_dir):
    """A cheap arm's prediction file with two repeats, written as CSV and read with its checks."""
    a = arms(spark, sf_dir).withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1))))
    name = lambda c: F.concat(F.lit(" Class "), F.col(c).cast("string"))
    rows = a.select(F.lit("t").alias("task"), F.lit("c").alias("candidate"), "repeat", "fold", "item_idx", F.sha2(F.col("item_idx").cast("string"), 256).alias("text_sha256"), name("gold").alias("gold"), name("free_pred").alias("pred"), F.col("free_conf").alias("p_pred"), (F.col("free_conf") >= 0.3).cast("int").alias("kept"), F.lit(1).alias("set_size"))
    path = _folder(spark)
    writers.append_csv(rows.select(readers.FILE_A), path)
    got = readers.file_a(spark, path)
    return rounded(got.groupBy("repeat", "gold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("hits"), F.sum("kept").alias("kept"), F.sum("p_pred").alias("confidence")), 4)


@query(f"WITH {ARMS} SELECT count(*) AS items, count(*) FILTER (item_idx % 7 = 0) AS errors, count(*) FILTER (item_idx % 7 <> 0) AS kept, sum(item_idx % 50) FILTER (item_idx % 7 <> 0)::BIGINT AS tokens, round(sum(item_idx / 1000.0) FILTER (item_idx % 7 <> 0), 4) AS cost FROM arms")
def output_file(spark, sf_dir):
    """An expensive arm's output file: appended to, read with its checks, and compacted without the rows of failed calls."""
    a = arms(spark, sf_dir)
    failed = F.col("item_idx") % 7 == 0
    name = lambda c: F.col(c).cast("string")
    rows = a.select(F.lit("t").alias("task"), F.lit("m").alias("model_key"), "item_idx", F.lit("x").alias("text_sha256"), name("gold").alias("gold"), F.when(failed, "<error: Timeout>").otherwise("it is, \"so\"").alias("raw_output"), name("expert_pred").alias("pred"), (~failed).cast("int").alias("parse_ok"),
        (F.col("item_idx") % 50).alias("in_tokens"), F.lit(1).alias("out_tokens"), F.lit(0).alias("cached_tokens"), (F.col("item_idx") / 1000.0).alias("cost_usd"), F.lit(0.5).alias("latency_s"), F.lit("2024-01-01").alias("ts"))
    path = _folder(spark)
    for half in (0, 1):
        writers.append_csv(rows.where(F.col("item_idx") % 2 == half).select(readers.FILE_B), f"{path}/raw")
    got = readers.file_b(spark, f"{path}/raw")
    writers.compact(spark, f"{path}/raw", f"{path}/kept", readers.FILE_B, readers.is_error_row())
    kept = readers.typed(readers.exact_csv(spark, f"{path}/kept", readers.FILE_B), in_tokens="int", cost_usd="double")
    all_ = got.agg(F.count(F.lit(1)).alias("items"), F.count_if(readers.is_error_row()).alias("errors"))
    return rounded(all_.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept"), F.sum("in_tokens").alias("tokens"), F.sum("cost_usd").alias("cost"))), 4)


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name, '' AS note FROM nation")
def tab_separated(spark, sf_dir):
    """Strict strings with tabs between them; an empty field stays an empty string."""
    path = _folder(spark)
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.lit("").alias("note")).write.option("header", True).option("sep", "\t").option("emptyValue", "").csv(path)
    return readers.exact_csv(spark, path, ["key", "name", "note"], sep="\t")


_SCORES = f"WITH {LONG}, s AS (SELECT 'task ' || fold AS task, model, round(avg((gold = pred)::INT), 6) AS score FROM preds GROUP BY ALL)"


def _scores(spark, sf_dir):
    right = F.round(F.avg((F.col("gold") == F.col("pred")).cast("double")), 6)
    return long_preds(arms(spark, sf_dir)).groupBy(F.concat(F.lit("task "), F.col("fold").cast("string")).alias("task"), "model").agg(right.alias("score"))


@query(_SCORES + " SELECT task, arg_min(model, (-score, model)) AS best_model, max(score) AS best_score, count(*)::INT AS models FROM s GROUP BY 1")
def published_scores(spark, sf_dir):
    """Scores by task and model from a CSV file, with the best model of each task."""
    path = _folder(spark)
    writers.append_csv(_scores(spark, sf_dir), path)
    s = readers.typed(readers.exact_csv(spark, path, ["task", "model", "score"]), score="double")
    return readers.published_scores(s).select("task", "best_model", "best_score", F.size("scores").alias("models"))


@query(_SCORES + " SELECT task, max(score) FILTER (model = 'free') AS published__free, max(score) FILTER (model = 'expert') AS published__expert, NULL::DOUBLE AS published__none FROM s GROUP BY 1")
def pivoted_scores(spark, sf_dir):
    """One row a task with a column for each named model, in files by task."""
    path = _folder(spark)
    writers.partitioned_csv(writers.pivot_scores(_scores(spark, sf_dir), ["free", "expert", "none"]), path, "task")
    return spark.read.schema("published__free double, published__expert double, published__none double, task string").option("header", True).csv(path)


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def decision_log(spark, sf_dir):
    """JSON lines appended in two writes and read with their schema; the manifest beside them names the columns."""
    path = _folder(spark)
    c = read(spark, sf_dir, "conversations")
    for half in (0, 1):
        writers.json_lines(c.where(F.col("conv_id") % 2 == half), f"{path}/decisions")
    writers.manifest(spark, f"{path}/manifest", {"columns": [f"{k} {v}" for k, v in c.dtypes]})
    got = readers.jsonl(spark, f"{path}/decisions", ", ".join(writers.read_manifest(spark, f"{path}/manifest")["columns"]))
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("conv_id").alias("conversations"))


@query("SELECT 'turns' AS part, count(*) AS rows FROM conversations UNION ALL SELECT 'roles', count(DISTINCT role) FROM conversations UNION ALL SELECT 'regions', count(*) FROM region UNION ALL SELECT 'nations', count(*) FROM nation")
def bank(spark, sf_dir):
    """A bank of four JSON-lines parts, written and loaded as a whole."""
    c = read(spark, sf_dir, "conversations")
    path = _folder(spark)
    writers.write_bank({"turns": c, "roles": c.select("role").distinct(), "regions": read(spark, sf_dir, "region"), "nations": read(spark, sf_dir, "nation")}, path)
    out = None
    for name, df in writers.load_bank(spark, path).items():
        part = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_type AS model, sum(event_id % 100)::BIGINT AS tokens_in, sum(user_id)::BIGINT AS tokens_out, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS jobs FROM events GROUP BY 1")
def usage_records(spark, sf_dir):
    """Usage records in two shapes, read as one."""
    e = read(spark, sf_dir, "events")
    path = _folder(spark)
    job = F.when(F.col("event_id") % 3 == 0, "j")
    writers.json_lines(e.where("event_id % 2 = 0").select(F.col("event_type").alias("model"), (F.col("event_id") % 100).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"), job.alias("job")), path)
    writers.json_lines(e.where("event_id % 2 = 1").select(F.col("event_type").alias("engine"), (F.col("event_id") % 100).alias("input_tokens"), F.col("user_id").alias("output_tokens"), job.alias("task")), path)
    u = readers.usage_log(spark, path)
    return u.groupBy("model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count(F.lit(1)).alias("n"), F.count("job").alias("jobs"))


@query("SELECT role AS label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def uploaded_examples(spark, sf_dir):
    """An upload with alias names for its fields, checked and read."""
    c = read(spark, sf_dir, "conversations").where("trim(text) <> ''")
    path = _folder(spark)
    writers.json_lines(c.where("conv_id % 2 = 0").select("text", F.col("role").alias("label")), path)
    writers.json_lines(c.where("conv_id % 2 = 1").select(F.col("text").alias("sentence"), F.col("role").alias("intent")), path)
    return readers.upload(spark, path, 1_000_000).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS line, n_name AS value FROM nation")
def numbered_lines(spark, sf_dir):
    """The lines of a text file with their numbers, as a sidecar is joined by."""
    path = _folder(spark)
    read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return readers.aligned_lines(spark, path)


@readers.register("benchmark passages")
def _passages(spark):
    return read(spark, spark.conf.get("sluicegate.data"), "benchmark")


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM benchmark")
def registered_dataset(spark, sf_dir):
    """A dataset by its registered name; its folder is a setting of the session."""
    spark.conf.set("sluicegate.data", sf_dir)
    return readers.load(spark, "benchmark passages").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT split, count(*) AS n, sum(length(lang || chr(10) || chr(10) || source))::BIGINT AS chars FROM (SELECT lang, source, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) GROUP BY 1")
def labelled_splits(spark, sf_dir):
    """Text built of input columns for labelled rows, as named splits in one frame."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("label", F.col("quality").cast("string"))
    t = readers.with_text(d.drop("text"), ["lang", "source"], "label")
    s = readers.splits({"train": t.where("doc_id % 5 <> 0"), "test": t.where("doc_id % 5 = 0")})
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT r_regionkey::INT AS place, r_name AS name FROM region")
def named_classes(spark, sf_dir):
    """Class names that travel in a column's metadata."""
    r = read(spark, sf_dir, "region").orderBy("r_regionkey")
    names = [x["r_name"] for x in r.collect()]  # a row for each region
    path = _folder(spark)
    r.select(F.col("r_regionkey").alias("class", metadata={"names": names})).write.parquet(path)
    return spark.createDataFrame(list(enumerate(readers.class_names(spark.read.parquet(path), "class"))), "place int, name string")


@query("SELECT count(*) AS n, sum(length(text))::BIGINT AS chars, 1 AS computed FROM benchmark")
def content_cache(spark, sf_dir):
    """Lengths kept under the content's fingerprint: the second call reads what the first wrote."""
    b, calls = read(spark, sf_dir, "benchmark"), []
    compute = lambda df: calls.append(1) or df.select("item_id", F.length("text").alias("chars"))
    path = _folder(spark)
    for _ in range(2):
        got = writers.cached(b, "item_id", ["text"], path, compute)
    return got.agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.lit(len(calls)).alias("computed"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN -1 ELSE length(text) END::INT AS score FROM benchmark")
def score_upsert(spark, sf_dir):
    """A score cache asked for all items: what it has stays, the rest is computed and put in."""
    b = read(spark, sf_dir, "benchmark")
    cache = b.where("item_id % 3 = 0").select("item_id", F.lit(-1).alias("score"))
    return writers.score_cache(cache, b, "item_id", lambda df: df.select("item_id", F.length("text").alias("score")))


@query("SELECT count(*) AS n, count(DISTINCT lang) AS langs FROM documents")
def audited_counts(spark, sf_dir):
    """An audit row, written and held against the values that are expected of it."""
    d = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))
    path = _folder(spark)
    writers.audit(d, {"langs": read(spark, sf_dir, "documents").select("lang").distinct().count()}, path)
    return spark.read.schema(d.schema).json(path)


def _adapted(spark, sf_dir):
    """Labelled documents as rows of a dataset: text, label and split."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").where("quality IS NOT NULL AND text IS NOT NULL")
    label = F.concat_ws("_", "lang", F.when(F.col("quality") == 1, "good").otherwise("poor"))
    return d.select("doc_id", "text", label.alias("label"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))


_ADAPTED = """WITH d AS (SELECT doc_id, text, lang || ' ' || CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL), k AS (SELECT * FROM d WHERE label <> 'es poor')
"""


@query(_ADAPTED + "SELECT split, md5(text) AS text, label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS class FROM k")
def dataset_adapter(spark, sf_dir):
    """A dataset written and read through its data source: pooled splits, a reject class left out, classes renumbered."""
    adapters.register(spark)
    path = _folder(spark)
    _adapted(spark, sf_dir).select("text", "label", "split").write.format("labelled_lines").mode("append").save(path)
    rows = spark.read.format("labelled_lines").option("underscores", True).option("drop", "es_poor").option("partition_bytes", 1 << 20).load(path)
    return adapters.numbered(rows).select("split", F.md5("text").alias("text"), "label", "class")


@query(_ADAPTED + "SELECT split, md5(text) AS text, replace(label, ' ', '_') AS label FROM d")
def dataset_adapter_stream(spark, sf_dir):
    """The dataset as a stream: a third of it, more of it in a second trigger, and the rest after a restart from the
    checkpoint."""
    adapters.register(spark)
    path, out = _folder(spark), _folder(spark)
    rows = _adapted(spark, sf_dir).select("doc_id", "text", "label", "split")
    for part in range(3):
        rows.where(F.col("doc_id") % 3 == part).drop("doc_id").write.format("labelled_lines").mode("append").save(path)
        stream = spark.readStream.format("labelled_lines").option("partition_bytes", 1 << 20).load(path)
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(adapters.SCHEMA).parquet(f"{out}/rows").select("split", F.md5("text").alias("text"), "label")
