"""Ranks over all rows without a task that orders them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def global_rank(df: DataFrame, score: str, key: str, name: str = "_rank", parts: int = 64, descending: bool = False) -> DataFrame:
    """name: 1-based rank by score, then by key ascending.

    Quantiles of the score (approximate; any cut gives the same ranks) split rows into parts; rows are ranked within
    parts, and a part begins after the sizes of those before it.
    """
    cuts = df.approxQuantile(score, [i / parts for i in range(1, parts)], 0.01)
    x = F.col(score).cast("double")
    part = F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<double>"), lambda c: c < x)) if cuts else F.lit(0)
    rows = df.withColumn("_part", -part if descending else part)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select("_part", (F.sum("_size").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_size")).alias("_before"))  # parts rows
    order = W.partitionBy("_part").orderBy(F.desc(score) if descending else F.asc(score), key)
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.row_number().over(order)).drop("_part", "_before")


def _ranges(df: DataFrame, order: str, parts: int, descending: bool):
    """Column: the number of the range of order that a row lies in; approximate quantiles cut the ranges."""
    cuts = df.select(F.col(order).cast("double").alias("_x")).approxQuantile("_x", [i / parts for i in range(1, parts)], 0.01)
    x = F.col(order).cast("double")
    part = F.size(F.filter(F.lit(sorted(set(cuts))).cast("array<double>"), lambda c: c < x)) if cuts else F.lit(0)
    return -part if descending else part


def running(df: DataFrame, order: str, value: str, how: str, name: str, parts: int = 64, descending: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """name: the sum or the max of value over the rows (of the same by) that come before in order, null for the first.

    df has one row for each value of order (and by).  Ranges of order are aggregated first, then rows within a range, so
    that no task sees all rows.
    """
    if how not in ("sum", "max"):
        raise ValueError(how)
    f = F.sum if how == "sum" else F.max
    rows = df.withColumn("_part", _ranges(df, order, parts, descending))
    total = rows.groupBy(*by, "_part").agg(f(value).alias("_all"))
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # parts rows
    total = total.select(*by, "_part", f("_all").over(every.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_base"))
    inner = W.partitionBy(*by, "_part").orderBy(F.desc(order) if descending else F.asc(order)).rowsBetween(W.unboundedPreceding, -1)
    met = rows.withColumn("_own", f(value).over(inner)).join(total, [*by, "_part"])
    both = F.coalesce(F.col("_base") + F.col("_own"), "_base", "_own") if how == "sum" else F.greatest("_base", "_own")
    return met.withColumn(name, both).drop("_part", "_own", "_base")
