"""Bootstrap by hashed Poisson weights: the weight of an item in replicate b depends on (item, b, seed) alone, so rows
need no positions, partitions combine by sums, and any engine with md5 draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.ident import bucket

#: Cumulative probabilities of Poisson(1) in millionths, from 0 on.
_CUTS = (367879, 735759, 919699, 981012, 996340, 999406)


def weight(key: str, seed: str) -> Column:
    """Poisson(1) weight (0 to 6) of key in replicate b."""
    u = bucket(F.concat(F.col(key).cast("string"), F.lit("/"), F.col("b").cast("string")), 1_000_000, seed)
    return sum(((u >= c).cast("int") for c in _CUTS), F.lit(0))


def replicates(df: DataFrame, key: str, value: str, b: int, seed: str = "") -> DataFrame:
    """(b, weight, mean): weighted means of value (null for a replicate of no rows); a map-side partial sum for each replicate,
    then b rows."""
    grown = df.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b")).withColumn("_w", weight(key, seed))
    return grown.groupBy("b").agg(F.sum("_w").alias("weight"), F.try_divide(F.sum(F.col("_w") * F.col(value)), F.sum("_w")).alias("mean"))


def cluster_replicates(df: DataFrame, cluster: str, value: str, b: int, seed: str = "") -> DataFrame:
    """As replicates, resampling clusters; the mean is over rows."""
    sums = df.groupBy(cluster).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    grown = sums.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("_w", weight(cluster, seed))
    return grown.groupBy("b").agg(F.sum("_w").alias("weight"), F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("mean"))


def interval(reps: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of replicate means."""
    a = (1 - confidence) / 2
    return reps.agg(F.percentile("mean", F.lit(a)).alias("lo"), F.percentile("mean", F.lit(1 - a)).alias("hi"))


def acceleration(df: DataFrame, value: str) -> DataFrame:
    """(n, mean, a): the acceleration of the mean, from the jackknife.

    Leaving row i out moves the mean by (mean - x_i) / (n - 1), so the jackknife's third and second moments are those of the
    rows, and one pass over differences from a first pass's mean gives them; no row is left out in turn.
    """
    mean = df.agg(F.avg(value).alias("_m"))
    d = F.col(value) - F.col("_m")
    sums = df.select(value).crossJoin(F.broadcast(mean)).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(d**2).alias("s2"), F.sum(d**3).alias("s3"))
    return sums.select("n", "mean", F.when(F.col("s2") > 0, F.col("s3") / (6 * F.pow("s2", 1.5))).otherwise(0.0).alias("a"))


def corrected_interval(df: DataFrame, value: str, reps: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(lo, hi, bias, a): the bias-corrected and accelerated interval of the mean of value, from its replicates.

    bias is the normal quantile of the share of replicates below the mean (half of the equal ones).  Without replicates on
    both sides of the mean it has no finite value, and the interval is the percentile one.
    """
    from statistics import NormalDist

    normal = NormalDist()
    own = acceleration(df, value).first()
    if not own["n"]:
        return reps.agg(*(F.lit(None).cast("double").alias(c) for c in ("lo", "hi", "bias", "a")))
    below = reps.agg(F.avg((F.col("mean") < own["mean"]).cast("double") + (F.col("mean") == own["mean"]).cast("double") / 2).alias("p")).first()["p"]
    tails = [(1 - confidence) / 2, (1 + confidence) / 2]
    bias = None
    if below is not None and 0 < below < 1:
        bias = normal.inv_cdf(below)
        z = [bias + normal.inv_cdf(t) for t in tails]
        tails = [normal.cdf(bias + x / (1 - own["a"] * x)) for x in z]
    lo, hi = (F.percentile("mean", F.lit(t)).alias(n) for t, n in zip(tails, ("lo", "hi"), strict=True))
    return reps.agg(lo, hi, F.lit(bias).cast("double").alias("bias"), F.lit(own["a"]).alias("a"))


def non_inferior(reps: DataFrame, margin: float, alpha: float = 0.05) -> DataFrame:
    """Whether the one-sided lower bound of the replicate differences is above -margin."""
    lower = F.percentile("mean", F.lit(alpha))
    return reps.agg(lower.alias("lower"), (lower > -margin).alias("passes"))
