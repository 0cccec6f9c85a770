"""Aggregates over repeats, estimates from published scores, calibration grids, budgets and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.operators.classification import balanced_accuracy


def cv_aggregate(df: DataFrame, gold: str, pred: str, repeat: str) -> DataFrame:
    """Mean over repeats of each repeat's accuracy and balanced accuracy, and the pooled accuracy."""
    per = balanced_accuracy(df, gold, pred, repeat)
    return per.agg(F.count(F.lit(1)).alias("repeats"), F.avg("accuracy").alias("accuracy"), F.avg("balanced").alias("balanced"), (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("pooled"))


def estimated_cascade(classes: DataFrame) -> DataFrame:
    """Mean over classes of keep rate x accuracy on kept + (1 - keep rate) x published score; the published score where
    nothing is kept, classes without one (NaN or null) skipped.  classes: class, keep_rate, kept_accuracy, published."""
    value = F.when(F.col("keep_rate") == 0, F.col("published")).otherwise(F.col("keep_rate") * F.col("kept_accuracy") + (1 - F.col("keep_rate")) * F.col("published"))
    known = classes.where(F.col("published").isNotNull() & ~F.isnan("published"))
    return known.agg(F.count(F.lit(1)).alias("classes"), F.avg(value).alias("estimate"))


def demands(df: DataFrame, size: str, *by: str) -> DataFrame:
    """Largest and 95th percentile size, for a capability screen."""
    return df.groupBy(*by).agg(F.max(size).alias("most"), F.percentile(size, F.lit(0.95)).alias("p95"))


def screen(models: DataFrame, most: Column) -> DataFrame:
    """verdict: why a model can't run, or runnable.  models: model, window, price."""
    verdict = F.when(F.col("window").isNull(), "unavailable").when(F.col("window") < most, "rejected").when(F.col("price").isNull() | F.isnan("price") | (F.col("price") < 0), "unverified").otherwise("runnable")
    return models.withColumn("verdict", verdict)


def call_balance(df: DataFrame, key: str, order: list[str], gold: str, called: str) -> DataFrame:
    """Mean of the hit rates of calls and of non-calls, the last row of each key counting."""
    last = df.groupBy(key).agg(F.max(F.struct(*order, gold, called)).alias("r")).select(F.col(f"r.{gold}").alias("g"), F.col(f"r.{called}").alias("c"))
    per = last.groupBy("g").agg(F.avg((F.col("g") == F.col("c")).cast("double")).alias("a"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n"), F.avg("a").alias("balanced"))


def backfill_calls(calls: Column, total: Column, mean: Column) -> Column:
    """Stored number of calls, else total over mean, half to even."""
    return F.coalesce(calls, F.bround(total / mean)).cast("long")


def cache_hits(neighbours: DataFrame, t: float) -> DataFrame:
    """The nearest entry of each query where its similarity is at least t: query_id, vec_id, sim."""
    near = neighbours.where(F.col("sim") >= t).groupBy("query_id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "vec_id")).alias("b"))
    return near.select("query_id", F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("sim"))


def rerank(neighbours: DataFrame, scores: DataFrame) -> DataFrame:
    """The candidate with the best outside score of each query (lowest id on ties), beside the first by similarity."""
    met = neighbours.join(scores, ["query_id", "vec_id"])
    return met.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "vec_id"))["vec_id"].alias("reranked"), F.min(F.struct("rank", "vec_id"))["vec_id"].alias("first"))


def paired_repeats(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Per repeat: rows that only one of two right-or-wrong columns has right, and the difference in accuracy."""
    x, y = F.col(a), F.col(b)
    return df.groupBy(*by).agg(F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), (F.avg(x.cast("double")) - F.avg(y.cast("double"))).alias("difference"))


def weight_grid(df: DataFrame, p: str, truth: str, weights: tuple[float, ...], *by: str) -> DataFrame:
    """The weight w with the most rows right for w p >= 0.5 (the smallest on ties).  Rows are met with the grid as counts."""
    grid = F.explode(F.array(*(F.lit(w) for w in weights))).alias("weight")
    hits = df.select(*by, p, truth, grid).groupBy(*by, "weight").agg(F.sum(((F.col("weight") * F.col(p) >= 0.5) == F.col(truth)).cast("int")).alias("right"))
    return hits.groupBy(*by).agg(F.min(F.struct((-F.col("right")).alias("r"), "weight")).alias("b")).select(*by, F.col("b.weight").alias("weight"), (-F.col("b.r")).alias("right"))


def under_budget(df: DataFrame, by: str, score: str, size: str, order: str, budget: int, most: int | None = None) -> DataFrame:
    """Best passages first (the earlier on ties), each kept if it fits what is left of the budget, given in document order:
    by, order, place.  A passage that does not fit is passed over; later ones may still fit.
    most: passages kept at most."""
    items = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"), F.col(size).cast("long").alias("n"))))
    zero = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>").alias("out"))
    fits = lambda s, x: (x["n"] <= s["left"]) & (F.lit(True) if most is None else F.size(s["out"]) < most)
    take = lambda s, x: F.when(fits(s, x), F.struct((s["left"] - x["n"]).alias("left"), F.concat(s["out"], F.array(x["o"])).alias("out"))).otherwise(s)
    kept = df.groupBy(by).agg(F.array_sort(F.aggregate(items, zero, take)["out"]).alias("_o"))
    return kept.select(by, F.posexplode("_o").alias("place", order)).select(by, order, (F.col("place") + 1).alias("place"))


def paraphrase_tiers(pairs: DataFrame, t: float = 0.92) -> DataFrame:
    """tier of each pair: exact text, same set of fields, similar by at least t, else distinct.  pairs: a, b, fa, fb, sim."""
    tier = F.when(F.col("a") == F.col("b"), "exact").when(F.array_sort(F.array_distinct("fa")) == F.array_sort(F.array_distinct("fb")), "fields").when(F.col("sim") >= t, "similar").otherwise("distinct")
    return pairs.withColumn("tier", tier)
