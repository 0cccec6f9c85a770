"""Prediction rows for the operators on labelled items: two arms and class probabilities over `embeddings`.

Models are outside this library; here their outputs are functions of a row's hash, with accuracies that differ by class,
so that every operator has something to find.  ARMS is the same relation as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicegate.ident import bucket
from sluicegate.session import read

CLASSES = 10


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_idx, gold, fold, free_pred, free_conf, expert_pred, third_pred."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_idx"), F.col("label").alias("gold"))

    def pick(seed: str, good):
        other = (F.col("gold") + 1 + bucket("item_idx", CLASSES - 1, seed + "o")) % CLASSES
        return F.when(bucket("item_idx", 100, seed) < good, F.col("gold")).otherwise(other).cast("int")

    e = e.withColumn("fold", bucket("item_idx", 5)).withColumn("free_pred", pick("free", 45 + 5 * F.col("gold")))
    e = e.withColumn("expert_pred", pick("expert", 88 - 3 * F.col("gold"))).withColumn("third_pred", pick("third", F.lit(70)))
    right = (F.col("free_pred") == F.col("gold")).cast("int")
    return e.withColumn("free_conf", (bucket("item_idx", 700, "conf") + 300 * right) / F.lit(1000.0))


def _b(seed: str, k: int, key: str = "vec_id") -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '{seed}'), 1, 8))::BIGINT % {k})::INT"


def _pick(seed: str, good: str) -> str:
    return f"(CASE WHEN {_b(seed, 100)} < {good} THEN label ELSE (label + 1 + {_b(seed + 'o', CLASSES - 1)}) % {CLASSES} END)::INT"


ARMS = f"""arms0 AS (
    SELECT vec_id AS item_idx, label AS gold, {_b('', 5)} AS fold, {_pick('free', '45 + 5 * label')} AS free_pred,
           {_pick('expert', '88 - 3 * label')} AS expert_pred, {_pick('third', '70')} AS third_pred, {_b('conf', 700)} AS u
    FROM embeddings
), arms AS (SELECT * EXCLUDE (u), (u + 300 * (free_pred = gold)::INT) / 1000.0::DOUBLE AS free_conf FROM arms0)"""


def long_preds(arms_: DataFrame) -> DataFrame:
    """(item_idx, gold, fold, model, pred) for the arms free, expert and third."""
    return arms_.select("item_idx", "gold", "fold", F.expr("stack(3, 'free', free_pred, 'expert', expert_pred, 'third', third_pred) AS (model, pred)"))


LONG = ARMS + """, preds AS (
    SELECT item_idx, gold, fold, 'free' AS model, free_pred AS pred FROM arms UNION ALL
    SELECT item_idx, gold, fold, 'expert', expert_pred FROM arms UNION ALL SELECT item_idx, gold, fold, 'third', third_pred FROM arms)"""


def probabilities(arms_: DataFrame) -> DataFrame:
    """(item_idx, gold, fold, class, p): class probabilities of the free arm, summing to 1."""
    classes = F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("class")
    w = arms_.select("item_idx", "gold", "fold", "free_pred", classes)
    key = F.concat(F.col("item_idx").cast("string"), F.lit("/"), F.col("class").cast("string"))
    w = w.withColumn("w", 1 + bucket(key, 50, "p") + F.when(F.col("class") == F.col("free_pred"), 150).otherwise(0))
    total = w.groupBy("item_idx").agg(F.sum("w").alias("total"))
    return w.join(total, "item_idx").select("item_idx", "gold", "fold", "class", (F.col("w") / F.col("total")).alias("p"))


PROBS = ARMS + f""", weights AS (
    SELECT item_idx, gold, fold, class, 1 + {_b('p', 50, "(item_idx || '/' || class)")} + CASE WHEN class = free_pred THEN 150 ELSE 0 END AS w
    FROM arms, range({CLASSES}) r(class)
), probs AS (SELECT item_idx, gold, fold, class::INT AS class, w::DOUBLE / sum(w) OVER (PARTITION BY item_idx) AS p FROM weights)"""
