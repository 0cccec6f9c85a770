"""Confidence metrics: calibration bins, AUROC, selective accuracy, thresholds over ranked rows, recall at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.operators.ranks import global_rank, running
from sluicegate.operators.sizes import cut


def reliability_bins(df: DataFrame, conf: str, right: str, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) over equal-width bins (lo, hi], the first closed."""
    b = F.greatest(F.lit(0), F.ceil(F.col(conf) * bins).cast("int") - 1)
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("confidence"), F.avg(F.col(right).cast("double")).alias("accuracy"))


def ece(df: DataFrame, conf: str, right: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: gaps of the bins, weighted by their rows."""
    b = reliability_bins(df, conf, right, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def auroc(df: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """Rank-sum AUROC with average ranks for ties; from counts per distinct score, so that ties are one row."""
    y = F.col(positive).cast("int")
    levels = cut(df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("m")))
    ranked = running(levels, score, "m", "sum", "_before", by=by).withColumn("_rank", F.coalesce("_before", F.lit(0)) + (F.col("m") + 1) / 2)
    p, n = F.sum("pos"), F.sum("m")
    return ranked.groupBy(*by).agg(((F.sum(F.col("_rank") * F.col("pos")) - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0))).alias("auroc"))


def error_share_in_tail(df: DataFrame, conf: str, right: str, key: str, share: float = 0.2) -> DataFrame:
    """Share of all errors among the round(share * n) least confident rows (half to even)."""
    ranked = global_rank(df, conf, key, "_r").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n"))))
    wrong = (~F.col(right)).cast("int")
    return ranked.agg((F.sum(F.when(F.col("_r") <= F.bround(share * F.col("_n")), wrong).otherwise(0)) / F.nullif(F.sum(wrong), F.lit(0))).alias("error_share"))


def escalation_dial(df: DataFrame, conf: str, right: str, other_right: str, key: str, shares: tuple[float, ...]) -> DataFrame:
    """Accuracy when the round(share * n) least confident rows go to the other arm."""
    totals = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(right).cast("int")).alias("_hits"))
    ranked = global_rank(df, conf, key, "_r").select("_r", (F.col(other_right).cast("int") - F.col(right).cast("int")).alias("_gain"))
    grid = df.sparkSession.createDataFrame([(float(s),) for s in shares], "share double").crossJoin(totals)
    met = ranked.join(F.broadcast(grid), F.col("_r") <= F.bround(F.col("share") * F.col("_n"))).groupBy("share").agg(F.sum("_gain").alias("_sum"))
    return grid.join(met, "share", "left").select("share", ((F.col("_hits") + F.coalesce("_sum", F.lit(0))) / F.col("_n")).alias("accuracy"))


def selective(df: DataFrame, conf: str, right: str, thresholds: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """Coverage and precision of the rows with conf >= t."""
    t = df.withColumn("threshold", F.explode(F.array(*(F.lit(x) for x in thresholds))))
    kept = F.col(conf) >= F.col("threshold")
    return t.groupBy("threshold").agg(F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, F.col(right).cast("double"))).alias("precision"))


def _down(df: DataFrame, conf: str, right: str, *by: str) -> DataFrame:
    """Running rows and hits from the top, ties of conf together."""
    levels = cut(df.groupBy(*by, conf).agg(F.count(F.lit(1)).alias("_m"), F.sum(F.col(right).cast("int")).alias("_h")))
    rows = running(running(levels, conf, "_m", "sum", "_bm", descending=True, by=by), conf, "_h", "sum", "_bh", descending=True, by=by)
    z = F.lit(0)
    return rows.select(*by, conf, (F.col("_m") + F.coalesce("_bm", z)).alias("n"), (F.col("_h") + F.coalesce("_bh", z)).alias("hits"))


def found_at_precision(df: DataFrame, conf: str, right: str, target: float, *by: str) -> DataFrame:
    """The most rows whose running precision from the top is at least target, and the threshold there (null: none)."""
    ok = F.col("hits") / F.col("n") >= target
    d = _down(df, conf, right, *by)
    return d.groupBy(*by).agg(F.coalesce(F.max(F.when(ok, F.col("n"))), F.lit(0)).cast("long").alias("found"), F.min(F.when(ok, F.col(conf))).alias("threshold"))


def lowest_threshold(df: DataFrame, conf: str, right: str, bar: float, support: int, *by: str) -> DataFrame:
    """The smallest t such that rows with conf >= t are at least support and right at rate bar or better."""
    ok = (F.col("hits") / F.col("n") >= bar) & (F.col("n") >= support)
    return _down(df, conf, right, *by).groupBy(*by).agg(F.min(F.when(ok, F.col(conf))).alias("threshold"))


def threshold_descent(df: DataFrame, conf: str, right: str, bar: float, *by: str) -> DataFrame:
    """Walk the threshold down and stop before the first step that misses the bar, unlike found_at_precision."""
    d = _down(df, conf, right, *by)
    missed = d.groupBy(*by).agg(F.max(F.when(F.col("hits") / F.col("n") < bar, F.col(conf))).alias("_miss"))
    met = d.join(F.broadcast(missed), list(by)) if by else d.crossJoin(F.broadcast(missed))  # a row for each group
    return met.groupBy(*by).agg(F.min(F.when(F.col("_miss").isNull() | (F.col(conf) > F.col("_miss")), F.col(conf))).alias("threshold"))


def best_f1_threshold(df: DataFrame, conf: str, positive: str) -> DataFrame:
    """The threshold with the best F1 for conf >= t; the highest such on ties."""
    d = _down(df, conf, positive).crossJoin(F.broadcast(df.agg(F.sum(F.col(positive).cast("int")).alias("_p"))))
    f1 = 2 * F.col("hits") / (F.col("n") + F.col("_p"))
    return d.withColumn("f1", f1).orderBy(F.desc("f1"), F.desc(conf)).limit(1).select(F.col(conf).alias("threshold"), "f1")


def error_band(df: DataFrame, conf: str, wrong: str, key: str, size: int) -> DataFrame:
    """The run of size rows in the order of conf that holds the most errors; the first on ties.

    Ranks are global; runs are counted in blocks of the rank axis, each with the size - 1 ranks before it, so that a
    window sees a bounded number of rows.
    """
    block = max(size, 65_536)
    ranked = global_rank(df, conf, key, "_r").select("_r", F.col(wrong).cast("int").alias("_w"))
    own = F.floor((F.col("_r") - 1) / block)
    spread = ranked.select("_r", "_w", F.explode(F.array_distinct(F.array(own, F.floor((F.col("_r") + size - 2) / block)))).alias("_b"))
    order = W.partitionBy("_b").orderBy("_r")
    runs = spread.withColumn("errors", F.sum("_w").over(order.rowsBetween(-(size - 1), 0))).where((F.floor((F.col("_r") - 1) / block) == F.col("_b")) & (F.col("_r") >= size))
    return runs.orderBy(F.desc("errors"), "_r").limit(1).select((F.col("_r") - size + 1).alias("first_rank"), F.col("_r").alias("last_rank"), "errors")


def recall_at_k(train: DataFrame, test: DataFrame, value: str, ks: tuple[int, ...], *by: str) -> DataFrame:
    """Share of test rows whose value is among the k most frequent of the training rows of its group (smallest on ties)."""
    freq = train.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ranks = freq.withColumn("_rank", F.row_number().over(part.orderBy(F.desc("_n"), value))).drop("_n")
    met = test.join(ranks, [*by, value], "left")
    return met.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.coalesce(F.col("_rank") <= k, F.lit(False)).cast("double")).alias(f"recall_at_{k}") for k in ks))


def compose_at_1(df: DataFrame, right: str, *turn: str) -> DataFrame:
    """Share of turns of which all positions are right, and of positions."""
    t = df.groupBy(*turn).agg(F.bool_and(right).alias("_all"), F.count(F.lit(1)).alias("_n"), F.sum(F.col(right).cast("int")).alias("_h"))
    return t.agg(F.count(F.lit(1)).alias("turns"), F.avg(F.col("_all").cast("double")).alias("compose_at_1"), (F.sum("_h") / F.sum("_n")).alias("position_accuracy"))


def decision_band(df: DataFrame, p: str, truth: str, target: float, support: int = 20, step: float = 0.02) -> DataFrame:
    """(lo, hi) that decides the most rows (p <= lo: no, p >= hi: yes) with agreement at least target; narrowest first on
    ties.  Rows meet the grid as counts per grid cell, not as pairs."""
    cells = round(1 / step)
    up, down = F.ceil(F.col(p) / step - 1e-9).cast("int"), F.floor(F.col(p) / step + 1e-9).cast("int")
    low = df.groupBy(up.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col(truth)).cast("int")).alias("ok"))
    high = df.groupBy(down.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(truth).cast("int")).alias("ok"))
    grid = df.sparkSession.range(cells + 1).select(F.col("id").cast("int").alias("g"))
    a = grid.join(F.broadcast(low), F.col("c") <= F.col("g"), "left").groupBy(F.col("g").alias("lo")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n0"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok0"))
    b = grid.join(F.broadcast(high), F.col("c") >= F.col("g"), "left").groupBy(F.col("g").alias("hi")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n1"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok1"))
    met = a.join(F.broadcast(b), F.col("lo") < F.col("hi")).withColumn("decided", F.col("n0") + F.col("n1")).withColumn("agreement", (F.col("ok0") + F.col("ok1")) / F.nullif(F.col("decided"), F.lit(0)))
    return met.where((F.col("decided") >= support) & (F.col("agreement") >= target)).orderBy(F.desc("decided"), "lo", "hi").limit(1).select((F.col("lo") * F.lit(step)).alias("lo"), (F.col("hi") * F.lit(step)).alias("hi"), "decided", "agreement")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and Cohen's kappa of two label columns."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("m"))
    n = cells.agg(F.sum("m").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("m")).otherwise(0)).alias("same"))
    rows, cols = cells.groupBy(F.col(a).alias("v")).agg(F.sum("m").alias("r")), cells.groupBy(F.col(b).alias("v")).agg(F.sum("m").alias("c"))
    chance = rows.join(cols, "v").agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("rc", F.lit(0)) / (F.col("n").cast("double") * F.col("n"))
    return n.crossJoin(chance).select(po.alias("agreement"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def weighted_shares(df: DataFrame, weight: Column, value: Column, *by: str) -> DataFrame:
    """Weighted share of value and effective sample size of the weights."""
    return df.groupBy(*by).agg((F.sum(weight * value) / F.sum(weight)).alias("share"), (F.sum(weight) * F.sum(weight) / F.sum(weight * weight)).alias("effective_n"))
