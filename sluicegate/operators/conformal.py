"""Conformal prediction sets over class probabilities (item_idx, gold, fold, class, p), fitted on the other folds.

Three named modes of the calibration quantile, on nonconformity 1 - p(true class):
clamp     index ceil((n - 1) min(1, ceil((n + 1)(1 - alpha)) / n)); sets may be empty
infinite  k = ceil((n + 1)(1 - alpha)) in doubles, infinite where k > n; sets hold the best class at least, eps 1e-9
exact     the same k in decimals, clamped to n; sets are p >= 1 - q and may be empty
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def thresholds(probs: DataFrame, alpha: float = 0.1, mode: str = "clamp", mondrian: bool = False) -> DataFrame:
    """(fold, class, q): the threshold of each test fold and class; a class without calibration rows has the pooled one."""
    folds = probs.select(F.col("fold").alias("test")).distinct()
    cal = probs.where("class = gold").select("fold", "class", (1 - F.col("p")).alias("s")).join(F.broadcast(folds), F.col("fold") != F.col("test"))

    def quantile(*by: str) -> DataFrame:
        ranked = cal.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("s"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*by)))
        n = F.col("n")
        if mode == "clamp":
            k = F.ceil((n - 1) * F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1 - alpha)) / n) - 1e-12) + 1
        elif mode == "infinite":
            k = F.greatest(F.lit(1), F.ceil((n + 1) * F.lit(1 - alpha)))
        else:
            k = F.greatest(F.lit(1), F.least(n, F.ceil((n + 1).cast("decimal(20,0)") * F.expr(f"1 - cast('{alpha}' as decimal(10,8))")).cast("long")))
        return ranked.groupBy(*by).agg(F.max(F.when(F.col("r") == k, F.col("s"))).alias("q")).select(*by, F.coalesce("q", F.lit(float("inf"))).alias("q"))

    classes = probs.select("class").distinct()
    pooled = quantile("test").join(F.broadcast(classes), F.lit(True))
    if not mondrian:
        return pooled.select(F.col("test").alias("fold"), "class", "q")
    own = quantile("test", "class").withColumnRenamed("q", "own")
    return pooled.join(own, ["test", "class"], "left").select(F.col("test").alias("fold"), "class", F.coalesce("own", "q").alias("q"))


def sets(probs: DataFrame, cuts: DataFrame, mode: str = "clamp") -> DataFrame:
    """(item_idx, gold, fold, members, size, covered)."""
    met = probs.join(F.broadcast(cuts), ["fold", "class"])
    inside = {"clamp": 1 - F.col("p") <= F.col("q"), "infinite": 1 - F.col("p") <= F.col("q") + 1e-9, "exact": F.col("p") >= 1 - F.col("q")}[mode]
    best = F.max(F.struct("p", (-F.col("class")).alias("c")))
    out = met.groupBy("item_idx", "gold", "fold").agg(F.array_sort(F.array_compact(F.collect_list(F.when(inside, F.col("class"))))).alias("members"), (-best["c"]).alias("_best"))
    if mode == "infinite":
        out = out.withColumn("members", F.when(F.size("members") == 0, F.array("_best")).otherwise(F.col("members")))
    return out.select("item_idx", "gold", "fold", "members", F.size("members").alias("size"), F.array_contains("members", F.col("gold")).alias("covered"))


def coverage(found: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Per true class: n, coverage, mean set size and whether the coverage holds."""
    c = F.avg(F.col("covered").cast("double"))
    return found.groupBy(F.col("gold").alias("class")).agg(F.count(F.lit(1)).alias("n"), c.alias("coverage"), F.avg("size").alias("mean_set_size"), (c >= 1 - alpha).alias("holds"))


def kept_and_sent(found: DataFrame, *by: str) -> DataFrame:
    """Rows with a set of one are kept: keep rate, and how often their member is the true class."""
    kept = F.col("size") == 1
    return found.groupBy(*by).agg(F.avg(kept.cast("double")).alias("keep_rate"), F.avg(F.when(kept, F.col("covered").cast("double"))).alias("coverage_on_kept"))
