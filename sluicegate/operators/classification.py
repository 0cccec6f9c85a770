"""Classification metrics as aggregates: the rows carry gold and a prediction, a group is a run, model or fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_D = "double"


def _hit(gold: str, pred: str) -> Column:
    return (F.col(gold) == F.col(pred)).cast(_D)


def per_class_accuracy(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """n and accuracy of each true class."""
    return df.groupBy(*by, gold).agg(F.count(F.lit(1)).alias("n"), F.avg(_hit(gold, pred)).alias("accuracy"))


def balanced_accuracy(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """Accuracy, and the mean recall over classes with support; predictions outside the classes count as wrong."""
    hit = _hit(gold, pred)
    per = df.groupBy(*by, gold).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits"))
    return per.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("balanced"))


def class_counts(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """tp, support and predicted of each class that occurs as gold or as a prediction, from one pass over the rows."""
    sides = F.array(F.struct(F.col(gold).alias("class"), F.lit(1).alias("s"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("s"), F.lit(1).alias("p")))
    flat = df.select(*by, (F.col(gold) == F.col(pred)).cast("int").alias("hit"), F.inline(sides))
    return flat.groupBy(*by, "class").agg(F.sum(F.col("hit") * F.col("s")).alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted"))


def f1_report(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """Precision, recall and F1 of each class; 0 where a denominator is 0."""
    c = class_counts(df, gold, pred, *by)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")), "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))})


def f1_summary(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """Macro F1 over all classes, and F1 weighted by support."""
    return f1_report(df, gold, pred, *by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def matthews(df: DataFrame, gold: str, pred: str, *by: str) -> DataFrame:
    """Multiclass Matthews correlation from confusion margins; 0 where it is undefined."""
    c = class_counts(df, gold, pred, *by).groupBy(*by).agg(
        F.sum("tp").alias("c"), F.sum("support").alias("s"), F.sum(F.col("support") * F.col("predicted")).alias("pt"),
        F.sum(F.col("predicted") * F.col("predicted")).alias("pp"), F.sum(F.col("support") * F.col("support")).alias("tt"),
    )
    s2 = F.col("s").cast(_D) * F.col("s")
    below = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return c.select(*by, F.when(below > 0, (F.col("c").cast(_D) * F.col("s") - F.col("pt")) / below).otherwise(0.0).alias("mcc"))


def confusions(df: DataFrame, gold: str, pred: str, top: int) -> DataFrame:
    """The top off-diagonal cells with their share of the true class."""
    cells = df.groupBy(gold, pred).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy(gold))
    return cells.withColumn("share_of_true", share).where(F.col(gold) != F.col(pred)).orderBy(F.desc("n"), gold, pred).limit(top)


def routing_table(df: DataFrame, gold: str, free: str, other: str, escalated: Column | None = None) -> DataFrame:
    """The paired 2 x 2 of who is right, what routing can win and lose, and, with a decision, the share sent per cell."""
    f, o = F.col(free) == F.col(gold), F.col(other) == F.col(gold)
    cells = {"both_right": f & o, "free_only_right": f & ~o, "other_only_right": ~f & o, "neither_right": ~f & ~o}
    n = F.count(F.lit(1))
    out = [n.alias("n"), *(F.count_if(c).alias(k) for k, c in cells.items())]
    out += [(F.count_if(f | o) / n).alias("oracle_accuracy"), (F.count_if(cells["other_only_right"]) / n).alias("headroom"), (F.count_if(cells["free_only_right"]) / n).alias("at_risk")]
    out += [((F.count_if(cells["other_only_right"]) - F.count_if(cells["free_only_right"])) / n).alias("net_ceiling"), (F.count_if(cells["neither_right"]) / n).alias("unreachable")]
    if escalated is not None:
        out += [F.coalesce(F.count_if(c & escalated) / F.nullif(F.count_if(c), F.lit(0)), F.lit(0.0)).alias(f"{k}_sent") for k, c in cells.items()]
    return df.agg(*out)


def class_advantage(df: DataFrame, gold: str, free: str, other: str, *by: str) -> DataFrame:
    """Accuracy of both arms on each class that the free arm predicts, and the other's advantage."""
    a = df.groupBy(*by, F.col(free).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.avg(_hit(gold, free)).alias("free_acc"), F.avg(_hit(gold, other)).alias("other_acc"))
    return a.withColumn("advantage", F.col("other_acc") - F.col("free_acc"))


def base_rate_dominance(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision of each known class when it is predicted; NaN where it never is."""
    p = df.groupBy(F.col(pred).alias("class")).agg(F.count(F.lit(1)).alias("n_pred"), F.avg(_hit(gold, pred)).alias("precision"))
    known = df.select(F.col(gold).alias("class")).distinct()
    return known.join(p, "class", "left").select("class", F.coalesce("n_pred", F.lit(0)).cast("long").alias("n_pred"), F.coalesce("precision", F.lit(float("nan"))).alias("precision"))


def label_profile(df: DataFrame, label: str, text: str) -> DataFrame:
    """Rows, classes, majority share, imbalance, duplicate texts and the resolution floor sqrt(.25 / smallest) / sqrt(k)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("classes"), F.max("c").alias("most"), F.min("c").alias("least"))
    d = df.groupBy(text).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1).alias("duplicate_rows"))
    floor = F.sqrt(F.lit(0.25) / F.col("least")) / F.sqrt(F.col("classes").cast(_D))
    return c.crossJoin(d).select("n", "classes", (F.col("most") / F.col("n")).alias("majority_share"), (F.col("most") / F.col("least")).alias("imbalance"), "duplicate_rows", floor.alias("resolution_floor"))


def competence_board(preds: DataFrame, classes: DataFrame, prior: float = 20.0) -> DataFrame:
    """P(right | model predicts class), shrunk toward the model's accuracy by prior pseudo-counts, for every model and
    class; raw is NaN without support.  preds: model, gold, pred; classes: class."""
    hit = _hit("gold", "pred")
    own = preds.groupBy("model", F.col("pred").alias("class")).agg(F.count(F.lit(1)).alias("support"), F.sum(hit).alias("hits"))
    overall = preds.groupBy("model").agg(F.avg(hit).alias("overall"))
    grid = overall.join(F.broadcast(classes), F.lit(True))
    n, h = F.coalesce("support", F.lit(0)), F.coalesce("hits", F.lit(0.0))
    shrunk = F.when(n + F.lit(prior) > 0, (h + prior * F.col("overall")) / (n + prior)).otherwise(0.0)
    return grid.join(own, ["model", "class"], "left").select("model", "class", n.cast("long").alias("support"), F.when(n > 0, h / n).otherwise(float("nan")).alias("raw"), shrunk.alias("shrunk"))


def arbitrate(preds: DataFrame, board: DataFrame, order: list[str]) -> DataFrame:
    """Each item goes to the model whose claim, centred on its class's mean over models, is best; earlier models win ties."""
    centre = board.groupBy("class").agg(F.avg("shrunk").alias("centre"))
    claims = board.join(centre, "class").select("model", F.col("class").alias("pred"), (F.col("shrunk") - F.col("centre")).alias("claim"))
    place = F.array_position(F.lit(order), F.col("model")).cast("int")
    best = F.max(F.struct((F.col("claim") - 1e-12 * (place - 1)).alias("score"), (-place).alias("p"), F.col("pred").alias("pred"), F.col("model").alias("model")))
    won = preds.join(F.broadcast(claims), ["model", "pred"]).groupBy("item_idx").agg(F.first("gold").alias("gold"), best.alias("b"))
    return won.select("item_idx", "gold", F.col("b.pred").alias("pred"), F.col("b.model").alias("model"))


def pool_diversity(preds: DataFrame) -> DataFrame:
    """(oracle_balanced, mean_disagreement, oracle_if_independent, diversity_ratio): balanced accuracy of the pool's oracle,
    the mean pairwise disagreement, the oracle of members that are independent given the class, and the share of the
    headroom over the best member that the pool has of the one that those would have (null if they have none).

    A member that is right on a share of a class, with its hits dealt anew within the class, leaves an item uncovered with one
    less that share, whatever the others do; so the mean over all such deals is a product of shares, and none is drawn.
    """
    oracle = preds.groupBy("item_idx").agg(F.first("gold").alias("gold"), F.bool_or(F.col("gold") == F.col("pred")).cast(_D).alias("hit"))
    oracle = oracle.groupBy("gold").agg(F.avg("hit").alias("r")).agg(F.avg("r").alias("oracle_balanced"))
    # within an item, pairs that disagree = all pairs less the pairs inside each prediction's group
    pairs = preds.groupBy("item_idx", "pred").agg(F.count(F.lit(1)).alias("m")).groupBy("item_idx").agg((F.sum("m") * (F.sum("m") - 1) / 2).alias("all"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same"))
    right = preds.groupBy("gold", "model").agg(F.avg((F.col("gold") == F.col("pred")).cast(_D)).alias("a"))
    best = right.groupBy("model").agg(F.avg("a").alias("b")).agg(F.max("b").alias("_best"))
    missed = F.aggregate(F.collect_list(1 - F.col("a")), F.lit(1.0), lambda x, y: x * y)  # a number for each model
    alone = right.groupBy("gold").agg(missed.alias("m")).agg((1 - F.avg("m")).alias("oracle_if_independent"))
    out = oracle.crossJoin(pairs.agg((F.sum(F.col("all") - F.col("same")) / F.sum("all")).alias("mean_disagreement"))).crossJoin(alone).crossJoin(best)
    room = F.col("oracle_if_independent") - F.col("_best")
    return out.withColumn("diversity_ratio", F.when(room > 1e-9, (F.col("oracle_balanced") - F.col("_best")) / room)).drop("_best")


def committee(preds: DataFrame, primary: str) -> DataFrame:
    """Per item: members that disagree with the primary model, and the majority vote (smallest label on ties)."""
    votes = preds.groupBy("item_idx", "pred").agg(F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("model") == primary, F.col("pred"))).alias("main"))
    each = votes.groupBy("item_idx").agg(F.sum("v").alias("n"), F.max("main").alias("main"), F.min(F.struct((-F.col("v")).alias("v"), "pred")).alias("best"), F.collect_list(F.struct("pred", "v")).alias("all"))
    agreed = F.aggregate(F.filter("all", lambda x: x["pred"] == F.col("main")), F.lit(0).cast("long"), lambda a, x: a + x["v"])
    return each.select("item_idx", (F.col("n") - agreed).alias("disagree"), F.col("best.pred").alias("majority"))


def mode(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The most frequent value of each group, the smallest on ties, and its count."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    best = c.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias("mode"), (-F.col("b.n")).alias("n"))


def constant_guard(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """The model beside the constant modal class, on the same rows."""
    m = mode(df, gold).select(F.col("mode").alias("_m"))
    both = df.select(gold, pred).crossJoin(F.broadcast(m))
    model = balanced_accuracy(both, gold, pred).select(F.lit("model").alias("arm"), "accuracy", "balanced")
    return model.unionByName(balanced_accuracy(both, gold, "_m").select(F.lit("constant").alias("arm"), "accuracy", "balanced"))


def budget_split(df: DataFrame, pred: str, escalated: str) -> DataFrame:
    """Items, escalated share and share of the spend of each predicted class."""
    c = df.groupBy(F.col(pred).alias("class")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.col(escalated).cast("int")).alias("sent"))
    everything = W.partitionBy(F.lit(0))
    return c.select("class", "items", (F.col("sent") / F.col("items")).alias("escalated_share"), F.coalesce(F.col("sent") / F.nullif(F.sum("sent").over(everything), F.lit(0)), F.lit(0.0)).alias("share_of_spend"))


def roc_dominance(scores: DataFrame, rates: tuple[float, ...] = (0.10, 0.15, 0.20, 0.25, 0.30)) -> DataFrame:
    """Binary: for each pair of models, whether one is at least as good on both classes at every matched positive rate.

    scores: model, item, gold (0 or 1), p.  The threshold at a rate is the k-th highest p, ties included.
    """
    n = scores.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    rate = F.explode(F.array(*(F.lit(r) for r in rates))).alias("rate")
    cut = n.select("model", "n", rate).withColumn("k", F.greatest(F.lit(1).cast("long"), F.floor(F.col("rate") * F.col("n"))))
    # distinct scores with running counts from the top: the first that reaches k is the threshold
    levels = scores.groupBy("model", "p").agg(F.sum("gold").alias("pos"), F.count(F.lit(1)).alias("m"))
    down = W.partitionBy("model").orderBy(F.desc("p"))
    levels = levels.select("model", "p", F.sum("m").over(down).alias("upto"), F.sum("pos").over(down).alias("tp"), F.sum("pos").over(W.partitionBy("model")).alias("all_pos"), F.sum("m").over(W.partitionBy("model")).alias("all"))
    at = levels.join(cut.select("model", "rate", "k"), "model").where("upto >= k").groupBy("model", "rate").agg(F.max(F.struct("p", "tp", "upto", "all_pos", "all")).alias("t"))
    neg = F.col("t.all") - F.col("t.all_pos")
    acc = at.select("model", "rate", (F.col("t.tp") / F.col("t.all_pos")).alias("acc1"), ((neg - (F.col("t.upto") - F.col("t.tp"))) / neg).alias("acc0"))
    b = acc.select(F.col("model").alias("other"), "rate", F.col("acc1").alias("b1"), F.col("acc0").alias("b0"))
    met = acc.join(b, "rate").where("model < other")
    return met.groupBy("model", "other").agg(F.bool_and((F.col("acc1") >= F.col("b1")) & (F.col("acc0") >= F.col("b0"))).alias("first_dominates"), F.bool_and((F.col("b1") >= F.col("acc1")) & (F.col("b0") >= F.col("acc0"))).alias("second_dominates"))


def multilabel(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Micro precision, recall and F1, exact match and share of empty predictions of label arrays."""
    both = F.size(F.array_intersect(gold, pred))
    t, p, g = F.sum(both), F.sum(F.size(pred)), F.sum(F.size(gold))
    exact = (F.size(F.array_except(gold, pred)) == 0) & (F.size(F.array_except(pred, gold)) == 0)
    return df.agg((t / F.nullif(p, F.lit(0))).alias("micro_p"), (t / F.nullif(g, F.lit(0))).alias("micro_r"), (2 * t / F.nullif(p + g, F.lit(0))).alias("micro_f1"), F.avg(exact.cast(_D)).alias("exact"), F.avg((F.size(pred) == 0).cast(_D)).alias("empty"))
