"""Deferral rules: which items of a fold go to the expensive arm, with thresholds fitted on the other folds.

Rows: item_idx, fold, gold, free_pred, free_conf, expert_pred.  Every rule returns the rows with a boolean `escalated`.
Statistics of "all folds but f" are all less f for sums; order statistics replicate a row to the k - 1 training sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.operators.classification import balanced_accuracy
from sluicegate.operators.ranks import running
from sluicegate.operators.sizes import cut


def _free() -> Column:
    return F.expr("int(free_pred = gold)")


def _expert() -> Column:
    return F.expr("int(expert_pred = gold)")


def class_gated(df: DataFrame, margin: float = 0.0) -> DataFrame:
    """Escalate a predicted class iff the expert was right more often on it in training, by more than margin; a class that
    training never saw stays."""
    cell = df.groupBy("fold", "free_pred").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("int(expert_pred = gold) - int(free_pred = gold)")).alias("gain"))
    folds = df.select("fold").distinct()
    total = cell.groupBy("free_pred").agg(F.sum("n").alias("all_n"), F.sum("gain").alias("all_gain"))
    own = folds.join(F.broadcast(total), F.lit(True)).join(cell, ["fold", "free_pred"], "left")
    n, gain = F.col("all_n") - F.coalesce("n", F.lit(0)), F.col("all_gain") - F.coalesce("gain", F.lit(0))
    rule = own.select("fold", "free_pred", ((n > 0) & (gain > margin * n)).alias("escalated"))
    return df.join(F.broadcast(rule), ["fold", "free_pred"])


def _train(df: DataFrame, *columns: str) -> DataFrame:
    """(test fold, columns) of the training rows of each fold."""
    folds = df.select(F.col("fold").alias("test")).distinct()
    return df.select(F.col("fold").alias("own"), *columns).join(F.broadcast(folds), F.col("own") != F.col("test")).drop("own")


def confidence_cascade(df: DataFrame, shares: DataFrame, score: str = "free_conf") -> DataFrame:
    """Escalate score <= the training quantile (linear) of the fold's share; nothing where the share is 0.

    shares: fold, share.
    """
    train = _train(df, score).join(F.broadcast(shares.withColumnRenamed("fold", "test")), "test")
    # the quantile at a share that differs by fold: ranks around (n - 1) * share
    order = W.partitionBy("test").orderBy(score)
    ranked = train.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("test")))
    place = (F.col("_n") - 1) * F.col("share")
    cut = ranked.groupBy("test").agg(
        F.max(F.when(F.col("_i") == F.floor(place), F.col(score))).alias("lo"), F.max(F.when(F.col("_i") == F.ceil(place), F.col(score))).alias("hi"), F.first(place - F.floor(place)).alias("w"), F.first("share").alias("share"),
    )
    cut = cut.select(F.col("test").alias("fold"), "share", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("w")).alias("cut"))
    return df.join(F.broadcast(cut), "fold").withColumn("escalated", (F.col("share") > 0) & (F.col(score) <= F.col("cut"))).drop("share", "cut")


def same_budget(df: DataFrame, decided: DataFrame) -> DataFrame:
    """The confidence cascade with the share that another rule spent in each fold."""
    return confidence_cascade(df, decided.groupBy("fold").agg(F.avg(F.col("escalated").cast("double")).alias("share")))


def class_aware(df: DataFrame, fraction: float) -> DataFrame:
    """Spend fraction of a fold's rows on predicted classes in the order of training advantage (positive ones): whole
    classes, then the least confident rows of the class where the budget ends."""
    cell = df.groupBy("fold", "free_pred").agg(F.count(F.lit(1)).alias("n"), F.sum(_expert() - _free()).alias("gain"))
    total = cell.groupBy("free_pred").agg(F.sum("n").alias("an"), F.sum("gain").alias("ag"))
    sized = cell.join(F.broadcast(total), "free_pred").withColumn("adv", F.try_divide(F.col("ag") - F.col("gain"), (F.col("an") - F.col("n")).cast("double")))
    budget = fraction * F.sum("n").over(W.partitionBy("fold"))
    sized = sized.withColumn("budget", budget).where("adv > 0")
    before = F.coalesce(F.sum("n").over(W.partitionBy("fold").orderBy(F.desc("adv"), "free_pred").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    plan = sized.select("fold", "free_pred", "n", (F.col("budget") - before).alias("left"))
    take = F.when(F.col("n") <= F.col("left"), F.col("n")).otherwise(F.greatest(F.lit(0), F.floor("left"))).cast("long")
    plan = plan.select("fold", "free_pred", take.alias("take"))
    rank = F.row_number().over(W.partitionBy("fold", "free_pred").orderBy("free_conf", "item_idx"))
    return df.join(F.broadcast(plan), ["fold", "free_pred"], "left").withColumn("escalated", rank <= F.coalesce("take", F.lit(0))).drop("take")


def precision_floor(df: DataFrame, margin: float, support: int = 30) -> DataFrame:
    """Keep, of each predicted class, the largest training prefix by confidence whose precision is (1 - margin) of the
    expert's precision on the class; escalate below, and classes that training never predicted."""
    train = _train(df, "gold", "free_pred", "free_conf", "expert_pred")
    pooled = train.groupBy("test").agg(F.avg(_expert().cast("double")).alias("pooled"))
    anchor = train.groupBy("test", F.col("expert_pred").alias("free_pred")).agg(F.avg(_expert().cast("double")).alias("anchor"))
    levels = train.groupBy("test", "free_pred", "free_conf").agg(F.count(F.lit(1)).alias("m"), F.sum(_free()).alias("h"))
    down = W.partitionBy("test", "free_pred").orderBy(F.desc("free_conf"))
    levels = levels.withColumn("n", F.sum("m").over(down)).withColumn("hits", F.sum("h").over(down))
    bars = levels.join(F.broadcast(anchor), ["test", "free_pred"], "left").join(F.broadcast(pooled), "test")
    ok = (F.col("hits") / F.col("n") >= (1 - margin) * F.coalesce("anchor", "pooled")) & (F.col("n") >= support)
    cut = bars.groupBy(F.col("test").alias("fold"), "free_pred").agg(F.min(F.when(ok, F.col("free_conf"))).alias("cut"))
    return df.join(F.broadcast(cut), ["fold", "free_pred"], "left").withColumn("escalated", F.coalesce(F.col("free_conf") < F.col("cut"), F.lit(True))).drop("cut")


def guaranteed_coverage(df: DataFrame, bar: float, support: int = 30) -> DataFrame:
    """Keep rows of a predicted class from the smallest training threshold with precision bar and support rows on."""
    train = _train(df, "gold", "free_pred", "free_conf")
    levels = train.groupBy("test", "free_pred", "free_conf").agg(F.count(F.lit(1)).alias("m"), F.sum(_free()).alias("h"))
    down = W.partitionBy("test", "free_pred").orderBy(F.desc("free_conf"))
    ok = (F.col("hits") / F.col("n") >= bar) & (F.col("n") >= support)
    cut = levels.withColumn("n", F.sum("m").over(down)).withColumn("hits", F.sum("h").over(down)).groupBy(F.col("test").alias("fold"), "free_pred").agg(F.min(F.when(ok, F.col("free_conf"))).alias("cut"))
    return df.join(F.broadcast(cut), ["fold", "free_pred"], "left").withColumn("escalated", F.coalesce(F.col("free_conf") < F.col("cut"), F.lit(True))).drop("cut")


def routed(decided: DataFrame) -> DataFrame:
    """pred: the expert's where escalated, else the free arm's."""
    return decided.withColumn("pred", F.when(F.col("escalated"), F.col("expert_pred")).otherwise(F.col("free_pred")))


def summary(decided: DataFrame, *by: str) -> DataFrame:
    """Balanced accuracy of both arms and of the routed one, and the escalated share."""
    rows = routed(decided)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("escalated").cast("double")).alias("share"))
    for name, pred in (("free", "free_pred"), ("expert", "expert_pred"), ("routed", "pred")):
        score = balanced_accuracy(rows, "gold", pred, *by).select(*by, F.col("balanced").alias(name))
        out = out.join(F.broadcast(score), list(by)) if by else out.crossJoin(F.broadcast(score))
    return out


def curve(df: DataFrame, fractions: tuple[float, ...], score: str = "free_conf") -> DataFrame:
    """The dial of the confidence rule: a row for each fraction (0: none, 1: all), with the gain per tenth of the spend."""
    cuts = _train(df, score).groupBy("test").agg(F.percentile(score, F.array(*(F.lit(float(f)) for f in fractions))).alias("q"))
    cuts = cuts.select(F.col("test").alias("fold"), F.posexplode("q").alias("i", "cut")).withColumn("fraction", F.element_at(F.array(*(F.lit(float(f)) for f in fractions)), F.col("i") + 1))
    rows = df.join(F.broadcast(cuts.drop("i")), "fold")
    sent = F.when(F.col("fraction") <= 0, False).when(F.col("fraction") >= 1, True).otherwise(F.col(score) <= F.col("cut"))
    points = summary(rows.withColumn("escalated", sent), "fraction").select("fraction", "share", F.col("routed").alias("balanced"))
    order = W.partitionBy(F.lit(0)).orderBy("fraction")  # a row for each fraction
    gain = (F.col("balanced") - F.lag("balanced").over(order)) / F.nullif(F.col("share") - F.lag("share").over(order), F.lit(0.0)) / 10
    return points.withColumn("gain_per_tenth", gain)


def cheapest_equivalent(points: DataFrame, floor: Column | float) -> DataFrame:
    """The least share whose score is within floor of the best; the higher score, then the smaller fraction on ties."""
    best = points.agg(F.max("balanced").alias("_best"))
    near = points.crossJoin(F.broadcast(best)).where(F.col("_best") - F.col("balanced") <= floor)
    return near.orderBy("share", F.desc("balanced"), "fraction").limit(1).select("fraction", "share", "balanced", (F.col("_best") - F.col("balanced")).alias("gives_up"))


def operating_point(points: DataFrame, target: float | None = None) -> DataFrame:
    """maxacc: the best score, least share within 1e-12; with target: the least share that reaches it."""
    if target is None:
        best = points.agg(F.max("balanced").alias("_t"))
        points = points.crossJoin(F.broadcast(best)).where(F.col("balanced") >= F.col("_t") - 1e-12).drop("_t")
    else:
        points = points.where(F.col("balanced") >= target - 1e-12)
    return points.orderBy("share", F.desc("balanced"), "fraction").limit(1)


def threshold_frontier(df: DataFrame) -> DataFrame:
    """(threshold, share, accuracy) of escalating free_conf < threshold, for every distinct confidence."""
    levels = cut(df.groupBy("free_conf").agg(F.count(F.lit(1)).alias("m"), F.sum(_free()).alias("f"), F.sum(_expert() - _free()).alias("g")))
    total = levels.agg(F.sum("m").alias("n"), F.sum("f").alias("hits"))
    z = F.lit(0)
    rows = running(running(levels, "free_conf", "m", "sum", "below"), "free_conf", "g", "sum", "gain").crossJoin(F.broadcast(total))
    return rows.select(F.col("free_conf").alias("threshold"), (F.coalesce("below", z) / F.col("n")).alias("share"), ((F.col("hits") + F.coalesce("gain", z)) / F.col("n")).alias("accuracy"))


def local_competence(df: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Escalate where, over an item's nearest training neighbours, the expert was right more often than the free arm.

    neighbours: item_idx, near (an item of another fold).
    """
    near = df.select(F.col("item_idx").alias("near"), _free().alias("f"), _expert().alias("e"))
    votes = neighbours.join(near, "near").groupBy("item_idx").agg(F.sum(F.col("e") - F.col("f")).alias("gain"))
    return df.join(votes, "item_idx", "left").withColumn("escalated", F.coalesce(F.col("gain") > 0, F.lit(False))).drop("gain")


def dynamic_selection(preds: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(item_idx, gold, ola, lca, knora, oracle): what is predicted by the models that do best around an item.

    preds: item_idx, gold, model, pred; neighbours: item_idx, near (a training item), rank from 1.  ola: the model that is right
    on most neighbours.  lca: the one that is right on the greatest share of the neighbours of the class that it predicts
    for the item (0 without any).  knora: the class that most of the models predict that are right on all of the nearest r
    neighbours, for the greatest r at which there is one; all models if the nearest defeats them all.  oracle: the class if any
    model is right, else the first model's.  Of equal models the first by name counts, of equal classes the least.

    Neighbours meet the models' hits in one join on the neighbour, and an item's k rows a model are aggregated; nothing of an item
    leaves its rows.  An item without neighbours is given to the first model, by knora to all.
    """
    hits = preds.select(F.col("item_idx").alias("near"), "model", F.col("gold").alias("near_gold"), (F.col("pred") == F.col("gold")).cast("int").alias("hit"))
    own = preds.select("item_idx", "gold", "model", "pred")
    met = neighbours.select("item_idx", "near", "rank").join(hits, "near").join(own.select("item_idx", "model", "pred"), ["item_idx", "model"])
    same = F.col("near_gold") == F.col("pred")
    first_wrong = F.min(F.when(F.col("hit") == 0, F.col("rank")))
    per = met.groupBy("item_idx", "model").agg(
        F.sum("hit").alias("hits"),
        (F.sum(F.when(same, F.col("hit")).otherwise(0)) / F.greatest(F.count_if(same), F.lit(1))).alias("local"),
        F.coalesce(first_wrong - 1, F.max("rank")).alias("run"),
    )
    per = own.join(per, ["item_idx", "model"], "left").na.fill(0, ["hits", "run"]).na.fill(0.0, ["local"])
    pick = lambda by: F.min(F.struct((-F.col(by)).alias("s"), "model", "pred"))["pred"]
    told = F.collect_list(F.struct("pred", "run", "model", "gold"))  # a row for each model
    found = per.groupBy("item_idx", "gold").agg(pick("hits").alias("ola"), pick("local").alias("lca"), told.alias("_all"), F.max("run").alias("_run"))
    votes = F.transform(F.filter("_all", lambda x: x["run"] == F.col("_run")), lambda x: x["pred"])
    ranked = F.transform(votes, lambda v: F.struct((-F.size(F.filter(votes, lambda u: u == v))).alias("n"), v.alias("pred")))
    first = F.array_min(F.transform("_all", lambda x: F.struct(x["model"].alias("model"), x["pred"].alias("pred"))))["pred"]
    oracle = F.when(F.exists("_all", lambda x: x["pred"] == F.col("gold")), F.col("gold")).otherwise(first)
    return found.select("item_idx", "gold", "ola", "lca", F.array_min(ranked)["pred"].alias("knora"), oracle.alias("oracle"))


def class_router(df: DataFrame, budget: float = 1.0) -> DataFrame:
    """Hand whole predicted classes over, greedily by the balanced accuracy they add in training, while they add and the
    budget holds; a row per fold and class comes to the driver, where the greedy choice runs."""
    per = _train(df, "gold", "free_pred", "expert_pred").groupBy("test", "free_pred", "gold").agg(F.count(F.lit(1)).alias("n"), F.sum(_expert() - _free()).alias("gain")).collect()
    size = df.groupBy("fold", "free_pred").count().collect()
    chosen = []
    for fold in sorted({r["fold"] for r in size}):
        support: dict = {}
        for r in per:
            if r["test"] == fold:
                support[r["gold"]] = support.get(r["gold"], 0) + r["n"]
        worth: dict = {}
        for r in per:
            if r["test"] == fold:
                worth[r["free_pred"]] = worth.get(r["free_pred"], 0.0) + r["gain"] / support[r["gold"]] / len(support)
        worth = {c: round(v, 12) for c, v in worth.items()}  # the order of sums does not show
        sizes = {r["free_pred"]: r["count"] for r in size if r["fold"] == fold}
        left = budget * sum(sizes.values())
        for c in sorted(worth, key=lambda c: (-worth[c], c)):
            if worth[c] > 0 and sizes.get(c, 0) <= left:
                left -= sizes.get(c, 0)
                chosen.append((fold, c, True))
    rule = df.sparkSession.createDataFrame(chosen, "fold int, free_pred int, escalated boolean")
    return df.join(F.broadcast(rule), ["fold", "free_pred"], "left").withColumn("escalated", F.coalesce("escalated", F.lit(False)))
