"""Conversations: context windows, disclosure, n-gram transitions and backoff.  Key: conv_id, turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_ORDER = ("conv_id", "turn")


def _over(*frame: int):
    return W.partitionBy("conv_id").orderBy("turn").rowsBetween(*frame)


def context(df: DataFrame, last: int, value: Column) -> DataFrame:
    """context: the values of the last turns before each turn, in order."""
    return df.withColumn("context", F.collect_list(value).over(_over(-last, -1)))


def first_and_last(df: DataFrame, first: int, last: int, value: Column) -> DataFrame:
    """context: the first and the last turns before each turn, none twice."""
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    head = F.collect_list(F.when(F.col("_n") <= first, F.struct("_n", value.alias("v")))).over(_over(W.unboundedPreceding, -1))
    tail = F.collect_list(F.struct("_n", value.alias("v"))).over(_over(-last, -1))
    both = F.array_sort(F.array_union(head, tail))
    return df.withColumn("_n", nth).withColumn("context", F.transform(both, lambda x: x["v"])).drop("_n")


def recency(df: DataFrame, cap: int) -> DataFrame:
    """recency: turns that follow in the conversation, at most cap."""
    return df.withColumn("recency", F.least(F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))) - 1, F.lit(cap)))


def disclosed(df: DataFrame, fields: DataFrame) -> DataFrame:
    """known: fields that an earlier turn disclosed; fields: conv_id, turn, field.  Visible strictly after their turn."""
    first = fields.groupBy("conv_id", "field").agg(F.min("turn").alias("_at"))
    per = first.groupBy("conv_id").agg(F.collect_list(F.struct("_at", "field")).alias("_f"))
    known = F.array_sort(F.transform(F.filter(F.coalesce("_f", F.array().cast("array<struct<_at:bigint,field:string>>")), lambda f: f["_at"] < F.col("turn")), lambda f: f["field"]))
    return df.join(per, "conv_id", "left").withColumn("known", known).drop("_f")


def actions_so_far(df: DataFrame, action: Column) -> DataFrame:
    """actions: non-null actions of earlier turns, in order."""
    return df.withColumn("actions", F.collect_list(action).over(_over(W.unboundedPreceding, -1)))


def transitions(df: DataFrame, value: str, orders: int) -> DataFrame:
    """(n, context, next, count): what follows the last n values, n from 0 to orders; contexts joined by a blank."""
    before = [F.lag(value, i).over(W.partitionBy("conv_id").orderBy("turn")) for i in range(1, orders + 1)]
    rows = df.select(F.col(value).alias("next"), *(b.alias(f"_{i}") for i, b in enumerate(before, 1)))
    contexts = [F.struct(F.lit(n).alias("n"), (F.concat_ws(" ", *(F.col(f"_{i}") for i in range(n, 0, -1))) if n else F.lit("")).alias("context"), (F.col(f"_{n}").isNotNull() if n else F.lit(True)).alias("ok")) for n in range(orders + 1)]
    return rows.select("next", F.inline(F.array(*contexts))).where("ok").groupBy("n", "context", "next").agg(F.count(F.lit(1)).alias("count"))


def backoff(df: DataFrame, counts: DataFrame, value: str, orders: int) -> DataFrame:
    """predicted: the most frequent continuation (smallest on ties) of the longest known context; used: its length."""
    best = counts.groupBy("n", "context").agg(F.min(F.struct((-F.col("count")).alias("c"), "next")).alias("b")).select("n", "context", F.col("b.next").alias("guess"))
    rows = df
    for i in range(1, orders + 1):
        rows = rows.withColumn(f"_{i}", F.lag(value, i).over(W.partitionBy("conv_id").orderBy("turn")))
    for n in range(orders, -1, -1):
        key = F.concat_ws(" ", *(F.col(f"_{i}") for i in range(n, 0, -1))) if n else F.lit("")
        table = best.where(F.col("n") == n).select(F.col("context").alias("_ctx"), F.col("guess").alias(f"_g{n}"))
        rows = rows.withColumn("_key", F.when(F.col(f"_{n}").isNotNull(), key) if n else key).join(F.broadcast(table) if n < 2 else table, F.col("_key") == F.col("_ctx"), "left").drop("_ctx", "_key")
    used = F.coalesce(*(F.when(F.col(f"_g{n}").isNotNull(), n) for n in range(orders, -1, -1)))
    guess = F.coalesce(*(F.col(f"_g{n}") for n in range(orders, -1, -1)))
    return rows.select(*df.columns, guess.alias("predicted"), used.alias("used"))


def templates(df: DataFrame, text: Column, examples: int) -> DataFrame:
    """(template, count, examples): delexicalized texts, with the alphabetically first examples."""
    rows = df.select(text.alias("template"), "text")
    return rows.groupBy("template").agg(F.count(F.lit(1)).alias("count"), F.slice(F.array_sort(F.collect_set("text")), 1, examples).alias("examples"))


def coverage_by_count(df: DataFrame, template: str, thresholds: tuple[int, ...]) -> DataFrame:
    """For each least count: share of rows whose template is that frequent, and share of conversations all of whose are."""
    counted = df.withColumn("_c", F.count(F.lit(1)).over(W.partitionBy(template)))
    grid = counted.withColumn("least", F.explode(F.array(*(F.lit(t) for t in thresholds)))).withColumn("_ok", F.col("_c") >= F.col("least"))
    per = grid.groupBy("least", "conv_id").agg(F.bool_and("_ok").alias("_all"), F.count(F.lit(1)).alias("_n"), F.sum(F.col("_ok").cast("int")).alias("_k"))
    return per.groupBy("least").agg((F.sum("_k") / F.sum("_n")).alias("rows"), F.avg(F.col("_all").cast("double")).alias("conversations"))


def turn_key(split: Column, conv: Column, turn: Column) -> Column:
    """split:conversation:turn."""
    return F.concat_ws(":", split, conv.cast("string"), turn.cast("string"))


def state_line(df: DataFrame, facts: DataFrame, actions: DataFrame, empty: str = "none") -> DataFrame:
    """state: what was disclosed and done before each turn, "disclosed: a=1; b=2 || actions: x(1, 2); y()".

    facts: conv_id, turn, field, value, where a field's first disclosure counts; actions: conv_id, turn, action, values.
    Facts come in the order of their turns, then fields; nothing of the turn itself or later shows.
    """
    first = facts.groupBy("conv_id", "field").agg(F.min(F.struct("turn", "value")).alias("f"))
    known = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("f.turn").alias("t"), "field", F.col("f.value").alias("v")))).alias("_f"))
    done = actions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("t"), "action", F.coalesce("values", F.array().cast("array<string>")).alias("v")))).alias("_a"))
    met = df.join(known, "conv_id", "left").join(done, "conv_id", "left")
    line = lambda own, show: F.coalesce(F.nullif(F.array_join(F.transform(F.filter(own, lambda x: x["t"] < F.col("turn")), show), "; "), F.lit("")), F.lit(empty))
    fact, act = line("_f", lambda x: F.concat(x["field"], F.lit("="), x["v"])), line("_a", lambda x: F.concat(x["action"], F.lit("("), F.array_join(x["v"], ", "), F.lit(")")))
    return met.withColumn("state", F.concat(F.lit("disclosed: "), fact, F.lit(" || actions: "), act)).drop("_f", "_a")
