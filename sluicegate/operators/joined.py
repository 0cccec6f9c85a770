"""Validated joins of prediction files, and statistics over repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class DataContractError(ValueError):
    """A file breaks its contract."""


def _require(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise DataContractError(f"{message}: {df.limit(3).collect()}")


def paired(a: DataFrame, b: DataFrame, check: bool = True) -> DataFrame:
    """Inner join of repeats of file A (repeat, item_idx, gold, ...) with file B (item_idx, gold_b, ...), many to one.

    Raises where B repeats an item, holds one that A lacks, skips one below its largest, disagrees about gold, or where
    repeats of A cover different items.
    """
    if check:
        _require(b.groupBy("item_idx").count().where("count > 1"), "file B repeats an item")
        _require(a.groupBy("repeat", "item_idx").count().where("count > 1"), "file A repeats an item")
        repeats = a.agg(F.countDistinct("repeat").alias("_r"))
        _require(a.groupBy("item_idx").agg(F.countDistinct("repeat").alias("n")).crossJoin(F.broadcast(repeats)).where("n <> _r"), "repeats cover different items")
        _require(b.join(a, "item_idx", "left_anti"), "file B holds an item that file A lacks")
        top = b.agg(F.max("item_idx").alias("_top"))
        _require(a.select("item_idx").distinct().crossJoin(F.broadcast(top)).where("item_idx <= _top").join(b, "item_idx", "left_anti"), "file B has a gap")
        _require(a.join(b, "item_idx").where("not (gold <=> gold_b)"), "the files disagree about gold")
    return a.join(b, "item_idx")


def cascade_statistics(df: DataFrame) -> DataFrame:
    """Per repeat: accuracy of keep-or-send, share sent, accuracies of both parts, and of an oracle."""
    kept, d = F.col("kept"), "double"
    own, other = (F.col("pred") == F.col("gold")), (F.col("expert_pred") == F.col("gold"))
    return df.groupBy("repeat").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(kept, own).otherwise(other).cast(d)).alias("cascade_accuracy"), F.avg((~kept).cast(d)).alias("sent_share"),
        F.avg(F.when(kept, own.cast(d))).alias("kept_accuracy"), F.avg(F.when(~kept, other.cast(d))).alias("sent_accuracy"), F.avg((own | other).cast(d)).alias("oracle_accuracy"),
    )


def mean_over(df: DataFrame, numbers: list[str], words: list[str], *by: str) -> DataFrame:
    """Means of numbers (nulls skipped) over repeats; words stay if all repeats agree, else 'unclear'."""
    same = [F.when(F.count_distinct(w) == 1, F.min(w)).otherwise("unclear").alias(w) for w in words]
    return df.groupBy(*by).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in numbers), *same)
