"""Constructions over several models, fitted out of fold: reliability tables and a stacked classifier, and the choice
between them and the best single model."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.operators.classification import balanced_accuracy
from sluicegate.operators.signals import against_best
from sluicegate.operators.sizes import cut, small

#: Lower edges of the confidence bins, and the rows that a bin must have to count by itself.
EDGES, LEAST = (0.0, 0.6, 0.7, 0.8, 0.9), 25


def bin_of(conf: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """The bin of a confidence: the last edge that it reaches, the first bin below all of them."""
    return reduce(lambda out, i: F.when(conf >= edges[i], i).otherwise(out), range(1, len(edges)), F.lit(0))


def reliability_selection(preds: DataFrame, edges: tuple[float, ...] = EDGES, least: int = LEAST) -> DataFrame:
    """(item_idx, fold, gold, model, pred, conf, reliability): for each item the vote of the model that was right most often,
    in the other folds, where it predicted this class with this confidence.

    preds: item_idx, fold, gold, model, pred, conf.  A bin of fewer than least rows takes the rate of all the model's votes for
    the class, 0 without any; of equal rates the first model by name counts.  The table is counted once, a row for each fold,
    model, class and bin, and a fold's training counts are the totals less its own.
    """
    rows = preds.withColumn("bin", bin_of(F.col("conf"), edges))
    own = cut(rows.groupBy("fold", "model", "pred", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("gold")).alias("hits")))
    folds = own.select("fold").distinct()

    def trained(*by: str) -> DataFrame:
        """Counts by model, class and by in the folds but one."""
        each = own.groupBy("fold", "model", "pred", *by).agg(F.sum("n").alias("own_n"), F.sum("hits").alias("own_hits"))
        whole = each.groupBy("model", "pred", *by).agg(F.sum("own_n").alias("n"), F.sum("own_hits").alias("hits")).crossJoin(F.broadcast(folds))  # a row for each fold
        left = whole.join(each, ["fold", "model", "pred", *by], "left").na.fill(0, ["own_n", "own_hits"])
        return left.select("fold", "model", "pred", *by, (F.col("n") - F.col("own_n")).alias("n"), (F.col("hits") - F.col("own_hits")).alias("hits"))

    base = trained().select("fold", "model", "pred", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0).alias("base"))
    table = trained("bin").join(base, ["fold", "model", "pred"])
    table = cut(table.select("fold", "model", "pred", "bin", F.when(F.col("n") >= least, F.col("hits") / F.col("n")).otherwise(F.col("base")).alias("reliability")))
    scored = rows.join(small(table), ["fold", "model", "pred", "bin"], "left").na.fill(0.0, ["reliability"])
    best = F.min(F.struct((-F.col("reliability")).alias("r"), "model", "pred", "conf")).alias("b")
    return scored.groupBy("item_idx", "fold", "gold").agg(best).select("item_idx", "fold", "gold", "b.model", "b.pred", "b.conf", (-F.col("b.r")).alias("reliability"))


def stacked(features: DataFrame, strength: float = 1.0, rounds: int = 500) -> DataFrame:
    """(item_idx, fold, gold, pred, conf): for each fold, a multinomial logistic regression that is fitted to the other folds.

    features: item_idx, fold, gold, x (array<double>, such as all models' class probabilities, in one order).  Classes weigh
    the same, whatever their sizes; the penalty is |w|^2 / (2 strength) beside the summed losses, without the intercepts.
    A fold whose training rows have one class only gets that class.
    """
    rows = cut(features.select("item_idx", "fold", F.col("gold").cast("double").alias("label"), array_to_vector("x").alias("features")))
    counts = rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each fold and class
    out = None
    for fold in sorted({r["fold"] for r in counts}):
        size = {}
        for r in counts:
            if r["fold"] != fold:
                size[r["label"]] = size.get(r["label"], 0) + r["n"]
        test = rows.where(F.col("fold") == fold)
        total = sum(size.values())
        if len(size) < 2:
            only = next(iter(size), None)
            said = test.select("item_idx", "fold", "label", F.lit(only).cast("double").alias("prediction"), F.lit(1.0).alias("conf"))
        else:
            # Spark's losses are averaged by weight, so the penalty is divided by the weights' sum, which is the rows' number
            weight = reduce(lambda w, k: F.when(F.col("label") == k, total / (len(size) * size[k])).otherwise(w), size, F.lit(0.0))
            train = rows.where(F.col("fold") != fold).withColumn("weight", weight)
            fit = LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / (strength * total), standardization=False, maxIter=rounds, tol=1e-10).fit(train)
            said = fit.transform(test).select("item_idx", "fold", "label", "prediction", F.array_max(vector_to_array("probability")).alias("conf"))
        out = said if out is None else out.unionByName(said)
    if out is None:
        return features.select("item_idx", "fold", "gold", F.col("gold").alias("pred"), F.lit(1.0).alias("conf"))
    kind = features.schema["gold"].dataType
    return out.select("item_idx", "fold", F.col("label").cast(kind).alias("gold"), F.col("prediction").cast(kind).alias("pred"), "conf")


def choice(preds: DataFrame, constructions: DataFrame, b: int = 200, seed: str = "", alpha: float = 0.05) -> DataFrame:
    """(model, balanced, delta, p, significant, chosen): the best single model and the constructions over it.

    preds and constructions: item_idx, gold, model, pred.  A construction is chosen if it is above the best model and stays so
    after Holm's correction; of several the best by balanced accuracy, and without any the best model.  So one that is a little
    better but not surely better does not stand in the way of one that is.
    """
    score = lambda d: balanced_accuracy(d, "gold", "pred", "model").select("model", "balanced")
    best = score(preds).orderBy(F.desc("balanced"), "model").first()
    leader = preds.where(F.col("model") == best["model"])
    rows = cut(leader.select("item_idx", "gold", "model", "pred").unionByName(constructions.select("item_idx", "gold", "model", "pred")))
    tests = against_best(rows, b, seed, alpha, leader=best["model"])
    found = score(rows).join(tests.select("model", "delta", "p", "significant"), "model", "left")
    wins = F.coalesce(F.col("significant") & (F.col("delta") > 0), F.lit(False))
    order = F.min(F.when(wins, F.struct((-F.col("balanced")).alias("s"), "model")))["model"]
    top = found.agg(F.coalesce(order, F.lit(best["model"])).alias("top"))
    return found.crossJoin(F.broadcast(top)).select("model", "balanced", "delta", "p", "significant", (F.col("model") == F.col("top")).alias("chosen"))
