"""Registries: scorers as columns, metrics as aggregates, candidates that fit and predict, and the deferral rules by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.functions import text as T
from sluicegate.operators import classification as C, deferral as D, selection as S, signals as G


def _exact(pred: Column, gold: Column) -> Column:
    return F.coalesce((T.squad_normalize(pred) == T.squad_normalize(gold)).cast("double"), F.lit(0.0))


def _tokens(x: Column) -> Column:
    return F.filter(F.split(T.squad_normalize(x), " "), lambda w: w != "")


def _token_f1(pred: Column, gold: Column) -> Column:
    return F.coalesce(T.token_f1(_tokens(pred), _tokens(gold)), F.lit(0.0))


def _best(one: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda pred, golds: F.coalesce(F.array_max(F.transform(golds, lambda g: one(pred, g))), F.lit(0.0))


#: name -> (answer, gold) -> score in [0, 1]; the any_of scorers take an array of gold answers.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"exact_match": _exact, "token_f1": _token_f1, "any_of_exact": _best(_exact), "any_of_f1": _best(_token_f1)}


def scorer(name: str) -> Callable[[Column, Column], Column]:
    if name not in SCORERS:
        raise KeyError(f"no scorer {name!r}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def _of(frame: DataFrame, value: Column, *by: str) -> DataFrame:
    return frame.select(*by, value.alias("value"))


#: name -> (rows, gold, pred, groups) -> a row with the value for each group.
METRICS: dict[str, Callable[..., DataFrame]] = {
    "accuracy": lambda df, gold, pred, *by: _of(C.balanced_accuracy(df, gold, pred, *by), F.col("accuracy"), *by),
    "balanced_accuracy": lambda df, gold, pred, *by: _of(C.balanced_accuracy(df, gold, pred, *by), F.col("balanced"), *by),
    "macro_f1": lambda df, gold, pred, *by: C.f1_report(df, gold, pred, *by).groupBy(*by).agg(F.avg("f1").alias("value")),
    "matthews": lambda df, gold, pred, *by: _of(C.matthews(df, gold, pred, *by), F.col("mcc"), *by),
}
METRICS["f1_macro"] = METRICS["macro_f1"]


def metric(name: str) -> Callable[..., DataFrame]:
    """A metric by its name, whatever its case, with - for _."""
    key = (name or "").strip().lower().replace("-", "_")
    if key not in METRICS:
        raise KeyError(f"no metric {name!r}; there are {', '.join(sorted(METRICS))}")
    return METRICS[key]


#: name -> (training rows, test rows) -> test rows with pred and conf.
CANDIDATES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def candidate(name: str):
    """Decorator: a candidate that fits on rows with gold and predicts others."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]):
        if name in CANDIDATES:
            raise ValueError(f"candidate {name} is registered already")
        CANDIDATES[name] = f
        return f

    return add


@candidate("majority")
def majority(train: DataFrame, test: DataFrame) -> DataFrame:
    """The most frequent class (the smallest on ties) with its share."""
    c = train.groupBy("gold").agg(F.count(F.lit(1)).alias("n"))
    top = c.agg(F.min(F.struct((-F.col("n")).alias("n"), "gold")).alias("b"), F.sum("n").alias("all"))
    return test.crossJoin(F.broadcast(top.select(F.col("b.gold").alias("pred"), (-F.col("b.n") / F.col("all")).alias("conf"))))


@candidate("nearest_centre")
def nearest_centre(train: DataFrame, test: DataFrame) -> DataFrame:
    """The class whose mean vector has the greatest inner product with the row's vector, which is its confidence."""
    i = train.select("gold", F.posexplode("vector").alias("i", "x")).groupBy("gold", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = i.groupBy(F.col("gold").alias("label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("centre"))
    near = S.nearest_class(test, centres, "vector", "item_idx").select("item_idx", F.col("label").alias("pred"), F.col("sim").alias("conf"))
    return test.join(near, "item_idx")


def cross_validated(df: DataFrame, name: str) -> DataFrame:
    """df with pred and conf of a candidate that was fitted on the other folds; a fit for each fold."""
    if name not in CANDIDATES:
        raise KeyError(f"no candidate {name!r}; there are {', '.join(sorted(CANDIDATES))}")
    out = None
    for fold in sorted(r["fold"] for r in df.select("fold").distinct().collect()):  # a row for each fold
        part = CANDIDATES[name](df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)).select(*df.columns, "pred", "conf")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no folds")
    return out


def allocate(df: DataFrame, rule: str, fraction: float, probs: DataFrame | None = None, members: list[str] | None = None, features: list[str] | None = None) -> DataFrame:
    """escalated by a rule's name, fitted on the other folds, at a share of each fold's rows.

    confidence, margin (probs: class probabilities) and committee (members: columns of other predictions) escalate what lies
    at or under the training quantile of their score, router (features) the fold's own quantile of its score; class_aware and
    per_class_conf spend the share by class; for precision_floor fraction is the margin and 0 the strictest promise.
    No share escalates nothing and a whole one everything, but for precision_floor.
    """
    if rule == "precision_floor":
        return D.precision_floor(df, fraction)
    if rule not in ("confidence", "margin", "committee", "router", "class_aware", "per_class_conf"):
        raise ValueError(f"no rule {rule!r}")
    if fraction <= 0 or fraction >= 1:
        return df.withColumn("escalated", F.lit(fraction >= 1))
    if rule == "class_aware":
        return D.class_aware(df, fraction)
    if rule == "per_class_conf":
        return S.per_class_confidence(df, fraction)
    if rule == "margin":
        scored, score = df.join(G.margin(probs), "item_idx"), "margin"
    elif rule == "committee":
        scored, score = G.committee(df, members or []), "committee"
    elif rule == "router":  # its scores are out-of-fold already, so the share is taken on the fold itself
        scored = G.router_scores(df, features or ["free_conf"])
        cuts = scored.groupBy("fold").agg(F.percentile("score", F.lit(float(fraction))).alias("_cut"))
        return scored.join(F.broadcast(cuts), "fold").withColumn("escalated", F.col("score") <= F.col("_cut")).select(*df.columns, "escalated")
    else:
        scored, score = df, "free_conf"
    shares = df.select("fold").distinct().withColumn("share", F.lit(float(fraction)))
    return D.confidence_cascade(scored, shares, score).select(*df.columns, "escalated")
