"""Costs, Pareto frontiers, intervals, as-of joins, recursion and usage tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.operators.ranks import running
from sluicegate.operators.sizes import cut, small


def token_cost(tokens_in: Column, cached: Column, tokens_out: Column, price_in: float, price_cached: float, price_out: float) -> Column:
    """Cost of a call: fresh input, cached input and output tokens at prices a million tokens."""
    fresh = F.greatest(F.lit(0), tokens_in - F.least(cached, tokens_in))
    return (fresh * price_in + F.least(cached, tokens_in) * price_cached + tokens_out * price_out) / 1e6


def ledger(df: DataFrame, cost: str, *by: str) -> DataFrame:
    """Calls and cost for each group, subtotal and the whole (rollup); nulls mark totals."""
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost"))


def pareto(df: DataFrame, cost: str, gain: str) -> DataFrame:
    """Rows that no row with at most their cost beats or equals in gain (a strict running maximum).

    Only the best gain of each cost can be on the frontier; the running maximum goes over ranges of cost in two levels.
    """
    best = cut(df.groupBy(cost).agg(F.max(gain).alias(gain)))
    before = running(best, cost, gain, "max", "_b")
    front = before.where(F.col("_b").isNull() | (F.col(gain) > F.col("_b"))).drop("_b")
    return df.join(small(front), [cost, gain], "left_semi")


def merge_intervals(df: DataFrame, start: str, end: str, *by: str) -> DataFrame:
    """Unions of overlapping or touching intervals of each group."""
    order = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.select(*by, start, end).withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    island = marked.withColumn("_i", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of half-open intervals [s, e) and [t, u) of one key that overlap; both are cut into cells of width, so that
    the join is on (key, cell), and a pair is kept in the cell where the later of both begins."""
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor((F.greatest(e, s + 1) - 1) / width)))
    x = a.withColumn("_cell", cells(F.col("s"), F.col("e")))
    y = b.withColumn("_cell", cells(F.col("t"), F.col("u")))
    met = x.join(y, [key, "_cell"]).where((F.col("s") < F.col("u")) & (F.col("t") < F.col("e")))
    return met.where(F.col("_cell") == F.floor(F.greatest("s", "t") / width)).drop("_cell")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its time; one exchange, no pairs."""
    rows = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    other = right.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    order = W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0)
    return rows.unionByName(other).withColumn("_v", F.last("_v", True).over(order)).where("_side = 1").drop("_side").withColumnRenamed("_v", value)


def forward(left: DataFrame, ends: DataFrame, key: str, at: str, end: str) -> DataFrame:
    """left with the first end of its key at or after its position."""
    rows = left.select("*", F.lit(None).cast("long").alias(end), F.lit(0).alias("_side"))
    other = ends.select(*[F.col(key) if c == key else F.col(end).alias(c) if c == at else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(end).cast("long").alias(end), F.lit(1).alias("_side"))
    order = W.partitionBy(key).orderBy(at, "_side").rowsBetween(0, W.unboundedFollowing)
    return rows.unionByName(other).withColumn(end, F.first(end, True).over(order)).where("_side = 0").drop("_side")


def daily_series(df: DataFrame, at: str, days: int, last: Column) -> DataFrame:
    """Requests on each of the last days up to last, days without any as 0."""
    per = df.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    calendar = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    return calendar.join(per, "day", "left").select("day", F.coalesce("requests", F.lit(0)).cast("long").alias("requests"))


def index_percentiles(df: DataFrame, value: str, ps: dict[str, float], *by: str) -> DataFrame:
    """Percentiles by index min(n - 1, int(n p)) of the sorted values, not interpolated."""
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    pick = [F.max(F.when(F.col("_r") == F.least(F.col("_n"), F.floor(F.col("_n") * p) + 1), F.col(value))).alias(name) for name, p in ps.items()]
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *pick)


def quota(df: DataFrame, user: str, at: str, key: str, limit: int) -> DataFrame:
    """allowed: whether a request is among its user's first limit of the day."""
    nth = F.row_number().over(W.partitionBy(user, F.to_date(at)).orderBy(at, key))
    return df.withColumn("allowed", nth <= limit)


def budget_stop(df: DataFrame, by: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """spent: running cost of each ledger; allowed while it is within the cap."""
    spent = F.sum(cost).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("spent", spent).withColumn("allowed", F.col("spent") <= cap)


def replay(df: DataFrame, order: list[str], by: str, warm: int, cap: int, signal: Column) -> DataFrame:
    """A stream replayed in order with cap calls: the first warm rows, then those with the signal, while calls last."""
    o = W.partitionBy(by).orderBy(*order)
    rows = df.withColumn("_n", F.row_number().over(o)).withColumn("_want", (F.col("_n") <= warm) | signal)
    return rows.withColumn("called", F.col("_want") & (F.sum(F.col("_want").cast("int")).over(o.rowsBetween(W.unboundedPreceding, 0)) <= cap)).drop("_n", "_want")


def patch_merge(base: DataFrame, patch: DataFrame, key: str, known: list | None = None) -> DataFrame:
    """base with all rows of the patch's keys replaced; unknown keys are refused where known ones are given."""
    if known is not None and not patch.where(~F.col(key).isin(known)).isEmpty():
        raise ValueError("the patch holds an unexpected key")
    return base.join(patch.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(patch.select(base.columns))


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Cache upsert: new rows replace base rows of their key."""
    return base.join(new, key, "left_anti").unionByName(new)


def pack(df: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """pack: number of the pack of each piece; a pack takes pieces in order until the next would pass the budget."""
    items = F.array_sort(F.collect_list(F.struct(order, size)))

    def add(state: Column, x: Column) -> Column:
        new = state["left"] < x[size]
        p = F.when(new & (F.size(state["out"]) > 0), state["pack"] + 1).otherwise(state["pack"])
        left = F.when(new, F.greatest(F.lit(0).cast("long"), budget - x[size])).otherwise(state["left"] - x[size])
        return F.struct(p.alias("pack"), left.alias("left"), F.concat(state["out"], F.array(F.struct(x[order].alias(order), p.alias("pack")))).alias("out"))

    zero = F.struct(F.lit(0).alias("pack"), F.lit(budget).cast("long").alias("left"), F.array().cast(f"array<struct<{order}:bigint,pack:int>>").alias("out"))
    return df.groupBy(by).agg(F.aggregate(items, zero, add)["out"].alias("_o")).select(by, F.inline("_o"))


def even_stride(df: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """At most cap rows of each group at positions int(i n / cap)."""
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    i = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    picked = df.withColumn("_i", i).withColumn("_n", n)
    j = F.ceil(F.col("_i") * cap / F.col("_n"))
    return picked.where((F.col("_n") <= cap) | ((F.floor(j * F.col("_n") / cap) == F.col("_i")) & (j < cap))).drop("_i", "_n")
