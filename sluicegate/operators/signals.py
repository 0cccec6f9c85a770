"""Deferral signals, out-of-fold gates, headroom of per-class thresholds, fitted routers, and comparisons with a leader.

Rows of labelled items are those of deferral: item_idx, fold, gold, free_pred, free_conf, expert_pred.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.ident import bucket, order_key
from sluicegate.operators.boot import weight
from sluicegate.operators.classification import balanced_accuracy
from sluicegate.operators.deferral import routed
from sluicegate.operators.ranks import global_rank, running
from sluicegate.operators.sizes import cut

#: Queries and texts that meet in one task, and texts that are multiplied at once.
GROUP, STRIPE, ROWS = 2048, 5_000, 64


def margin(probs: DataFrame) -> DataFrame:
    """(item_idx, margin): the greatest class probability less the next (0 where there is none)."""
    two = F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, 2)
    return probs.groupBy("item_idx").agg(two.alias("_t")).select("item_idx", (F.col("_t")[0] - F.coalesce(F.get("_t", F.lit(1)), F.lit(0.0))).alias("margin"))


def committee(df: DataFrame, members: list[str]) -> DataFrame:
    """committee: members that agree with the free arm, plus its confidence, which orders items of equal agreement."""
    agree = sum((F.coalesce(F.col(m) == F.col("free_pred"), F.lit(False)).cast("int") for m in members), F.lit(0))
    return df.withColumn("committee", agree + F.col("free_conf"))


def resolution(df: DataFrame, gold: str) -> DataFrame:
    """(classes, rarest, half_width): the half width that balanced accuracy resolves, set by the rarest class."""
    c = df.groupBy(gold).agg(F.count(F.lit(1)).alias("_n"))
    return c.agg(F.count(F.lit(1)).alias("classes"), F.min("_n").alias("rarest"), (F.sqrt(0.25 / F.min("_n")) / F.sqrt(F.count(F.lit(1)))).alias("half_width"))


def class_replicates(preds: DataFrame, leader: str, b: int, seed: str = "") -> DataFrame:
    """(model, b, diff): bootstrap replicates of the balanced accuracy of each model less the leader's, resampled within
    each class by hashed Poisson weights.  preds: item_idx, gold, model, pred."""
    best = preds.where(F.col("model") == leader).select("item_idx", (F.col("gold") == F.col("pred")).cast("int").alias("_l"))
    d = preds.where(F.col("model") != leader).join(best, "item_idx").select("model", "item_idx", "gold", ((F.col("gold") == F.col("pred")).cast("int") - F.col("_l")).alias("d"))
    grown = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b - 1)))).withColumn("_w", weight("item_idx", seed))
    per = grown.groupBy("model", "b", "gold").agg((F.sum(F.col("_w") * F.col("d")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    return per.groupBy("model", "b").agg(F.avg("_m").alias("diff"))


def against_best(preds: DataFrame, b: int, seed: str = "", alpha: float = 0.05, leader: str | None = None) -> DataFrame:
    """(model, delta, lo, hi, p, significant): each candidate against the leader or else the one of the best balanced accuracy
    (first name on ties), with a paired bootstrap stratified by class, corrected by Holm's step-down over the candidates."""
    from sluicegate.functions.stats import holm

    scores = cut(balanced_accuracy(preds, "gold", "pred", "model"))
    leader = (scores.where(F.col("model") == leader) if leader else scores.orderBy(F.desc("balanced"), "model")).first()
    reps = class_replicates(preds, leader["model"], b, seed)
    low, high = F.avg((F.col("diff") <= 0).cast("double")), F.avg((F.col("diff") >= 0).cast("double"))
    tests = reps.groupBy("model").agg(F.percentile("diff", F.lit(0.025)).alias("lo"), F.percentile("diff", F.lit(0.975)).alias("hi"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"))
    out = tests.join(scores.select("model", (F.col("balanced") - leader["balanced"]).alias("delta")), "model")
    return holm(out.select("model", "delta", "lo", "hi", "p"), "p", alpha=alpha).withColumnRenamed("reject", "significant")


def group_rung(df: DataFrame, group: str, label: str, fraction: float, seed: str = "") -> DataFrame:
    """A rung of successive halving that keeps groups whole: of the groups of each class, the first round(fraction n) in
    hash order, one at least.  A group's class is the one most of its rows carry (the smallest on ties).  Rungs of one
    seed are nested; halves round to even."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    own = counts.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l")))["l"].alias("_class"))
    rank = F.row_number().over(W.partitionBy("_class").orderBy(order_key(group, seed), group))
    n = F.count(F.lit(1)).over(W.partitionBy("_class"))
    kept = own.withColumn("_r", rank).withColumn("_m", n).where(F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_m") * fraction))).select(group)
    return df.join(kept, group, "left_semi")


def threshold_gate(df: DataFrame, criterion: str) -> DataFrame:
    """escalated: free_conf below the threshold that the other folds choose; maxacc: the best accuracy, ni: at least the
    expert's, both with the least share, within 1e-12.  Thresholds are the training confidences, none and all."""
    if criterion not in ("maxacc", "ni"):
        raise ValueError(criterion)
    folds = df.select(F.col("fold").alias("test")).distinct()
    free, expert = F.expr("int(free_pred = gold)"), F.expr("int(expert_pred = gold)")
    train = df.select("fold", "free_conf", free.alias("f"), expert.alias("e")).join(F.broadcast(folds), F.col("fold") != F.col("test"))
    levels = cut(train.groupBy("test", "free_conf").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("e") - F.col("f")).alias("g")))
    totals = train.groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("hits"), F.sum("e").alias("expert"))
    up = running(running(levels, "free_conf", "m", "sum", "below", by=("test",)), "free_conf", "g", "sum", "gain", by=("test",))
    points = up.select("test", F.col("free_conf").alias("t"), F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("gain", F.lit(0)).alias("gain"))
    every = totals.select("test", F.lit(float("inf")).alias("t"), F.col("n").alias("below"), (F.col("expert") - F.col("hits")).alias("gain"))
    none = totals.select("test", F.lit(float("-inf")).alias("t"), F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("gain"))
    met = points.unionByName(every).unionByName(none).join(F.broadcast(totals), "test")
    share, accuracy = F.col("below") / F.col("n"), (F.col("hits") + F.col("gain")) / F.col("n")
    met = met.select("test", "t", share.alias("share"), accuracy.alias("accuracy"), (F.col("expert") / F.col("n")).alias("bar"))
    if criterion == "maxacc":
        met = met.drop("bar").join(F.broadcast(met.groupBy("test").agg(F.max("accuracy").alias("bar"))), "test")
    chosen = met.where(F.col("accuracy") >= F.col("bar") - 1e-12).groupBy("test").agg(F.min(F.struct("share", "t"))["t"].alias("t"))
    return df.join(F.broadcast(chosen.withColumnRenamed("test", "fold")), "fold").withColumn("escalated", F.col("free_conf") < F.col("t")).drop("t")


def evaluate_gate(decided: DataFrame, cost_per_1k: float) -> DataFrame:
    """Accuracy, share, cost, discordant counts against either arm, and the part of the oracle's gain that is recovered."""
    rows = routed(decided)
    right, free, expert = (F.col(c) == F.col("gold") for c in ("pred", "free_pred", "expert_pred"))
    one = lambda x: x.cast("double")
    best = F.greatest(F.avg(one(free)), F.avg(one(expert)))
    out = rows.agg(
        F.avg(one(right)).alias("accuracy"), F.avg(one(F.col("escalated"))).alias("share"), (F.avg(one(F.col("escalated"))) * cost_per_1k).alias("cost_per_1k"),
        F.count_if(right & ~free).alias("gained_on_free"), F.count_if(~right & free).alias("lost_on_free"), F.count_if(right & ~expert).alias("gained_on_expert"), F.count_if(~right & expert).alias("lost_on_expert"),
        best.alias("_best"), F.avg(one(free | expert)).alias("oracle"),
    )
    return out.withColumn("recovered", (F.col("accuracy") - F.col("_best")) / F.nullif(F.col("oracle") - F.col("_best"), F.lit(0.0))).drop("_best")


def shuffled_classes(df: DataFrame, seed: str) -> DataFrame:
    """group: the free arm's class of another row, dealt by hash order, so that class sizes stay and nothing else does."""
    a = global_rank(df.select("item_idx"), "item_idx", "item_idx", "_r")
    draw = df.select(F.col("item_idx").alias("_from"), F.col("free_pred").alias("group"), bucket("item_idx", 1 << 30, seed).alias("_u"))
    b = global_rank(draw, "_u", "_from", "_r")
    return df.join(a.join(b.select("_r", "group"), "_r").select("item_idx", "group"), "item_idx")


def headroom(df: DataFrame, fraction: float = 0.2, nulls: int = 3, seed: str = "", step: float = 0.02) -> DataFrame:
    """What per-class thresholds could win over one threshold at a budget, with the answers in hand: one row (oracle_global,
    oracle_per_class, headroom, null_headroom, over_null, half_width, worth_it).

    On each fold the one threshold takes the int(fraction n) least confident rows; per class, steps of max(1, int(step n))
    least confident rows go while their mean gain in balanced accuracy is positive, the greatest first (the smallest class
    on ties), the last one cut to the room left.  The null deals the classes anew.  Rows are summed by (group, step)
    first; a row for each of these, at most classes + 1 / step a fold, comes to the driver.
    """
    variants = df.select("*", F.col("free_pred").alias("group"), F.lit(-1).alias("variant"))
    for i in range(max(1, nulls)):
        variants = variants.unionByName(shuffled_classes(df, f"{seed}{i}").withColumn("variant", F.lit(i)))
    per_class = df.groupBy("fold", "gold").agg(F.count(F.lit(1)).alias("_tot"))
    folds = per_class.groupBy("fold").agg(F.count(F.lit(1)).alias("_k"), F.sum("_tot").alias("_n"))
    gain = (F.expr("int(expert_pred = gold)") - F.expr("int(free_pred = gold)")) / (F.col("_k") * F.col("_tot"))
    place = F.row_number().over(W.partitionBy("variant", "fold", "group").orderBy("free_conf", "item_idx")) - 1
    rows = variants.join(F.broadcast(per_class), ["fold", "gold"]).join(F.broadcast(folds), "fold").withColumn("_w", gain).withColumn("_at", place)
    rows = cut(rows.withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_n") * step))).withColumn("_room", F.floor(F.col("_n") * fraction)))
    cells = rows.groupBy("variant", "fold", "group", F.floor(F.col("_at") / F.col("_step")).alias("i")).agg(F.count(F.lit(1)).alias("m"), F.sum("_w").alias("w"), F.first("_step").alias("s"), F.first("_room").alias("room"))
    left: dict = {}
    for r in cells.collect():
        plan = left.setdefault((r["variant"], r["fold"]), {"room": r["room"], "step": r["s"], "taken": {}, "cells": {}})
        plan["cells"].setdefault(r["group"], {})[r["i"]] = (r["m"], r["w"])
    for plan in left.values():
        plan["taken"] = dict.fromkeys(plan["cells"], 0)
    spark = df.sparkSession
    while True:
        asks = []
        for (variant, fold), plan in left.items():
            while plan["room"] >= plan["step"] and not plan.get("done"):
                offers = [(-w / m, g, m) for g, own in plan["cells"].items() if (cell := own.get(-(-plan["taken"][g] // plan["step"]))) for m, w in [cell]]
                best = min(offers, default=(0, None, 0))
                if best[0] >= 0:
                    plan["done"] = True
                    break
                plan["taken"][best[1]] += best[2]
                plan["room"] -= best[2]
            if plan["room"] > 0 and not plan.get("done"):  # less room than a step: the next rows' mean is asked for
                asks += [(variant, fold, g, n, n + plan["room"]) for g, n in plan["taken"].items()]
        if not asks:
            break
        wanted = spark.createDataFrame(asks, "variant int, fold int, group int, a long, z long")
        met = rows.join(F.broadcast(wanted), ["variant", "fold", "group"]).where((F.col("_at") >= F.col("a")) & (F.col("_at") < F.col("z"))).groupBy("variant", "fold", "group").agg(F.count(F.lit(1)).alias("m"), F.sum("_w").alias("w"))
        offers: dict = {}
        for r in met.collect():
            offers.setdefault((r["variant"], r["fold"]), []).append((-r["w"] / r["m"], r["group"], r["m"]))
        for key, plan in left.items():
            if plan["room"] > 0 and not plan.get("done"):
                best = min(offers.get(key, []), default=(0, None, 0))
                if best[0] >= 0:
                    plan["done"] = True
                else:
                    plan["taken"][best[1]] += best[2]
                    plan["room"] -= best[2]
                    plan["step"] = plan["room"] + 1  # whole steps are over
    taken = spark.createDataFrame([(v, f, g, n) for (v, f), plan in left.items() for g, n in plan["taken"].items()], "variant int, fold int, group int, taken long")
    sent = rows.join(F.broadcast(taken), ["variant", "fold", "group"]).withColumn("escalated", F.col("_at") < F.col("taken"))
    own = balanced_accuracy(routed(sent), "gold", "pred", "variant").select("variant", "balanced")
    nth = F.row_number().over(W.partitionBy("fold").orderBy("free_conf", "item_idx"))
    plain = rows.where("variant = -1").withColumn("escalated", nth <= F.col("_room"))
    g = balanced_accuracy(routed(plain), "gold", "pred").select(F.col("balanced").alias("oracle_global"))
    p, null = F.max(F.when(F.col("variant") == -1, F.col("balanced"))), F.avg(F.when(F.col("variant") >= 0, F.col("balanced")))
    out = own.agg(p.alias("oracle_per_class"), null.alias("_null")).crossJoin(g).crossJoin(resolution(df, "gold").select("half_width"))
    out = out.withColumn("headroom", F.col("oracle_per_class") - F.col("oracle_global")).withColumn("null_headroom", F.col("_null") - F.col("oracle_global"))
    out = out.withColumn("over_null", F.col("headroom") - F.col("null_headroom"))
    return out.withColumn("worth_it", F.col("over_null") >= F.col("half_width")).drop("_null")


def router_scores(df: DataFrame, features: list[str], kind: str = "logistic", rounds: int = 20) -> DataFrame:
    """score: P(free arm right) - P(expert right) by two models fitted on the other folds; low means the expert is the
    better bet.  kind: logistic, or trees (boosted, depth 3).  An arm that is always or never right in training has its
    share as its probability."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = cut(VectorAssembler(inputCols=features, outputCol="_x").transform(df.withColumn("_f", F.expr("double(free_pred = gold)")).withColumn("_e", F.expr("double(expert_pred = gold)"))))
    out = None
    for fold in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):  # a row for each fold
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        for y in ("_f", "_e"):
            share = train.agg(F.avg(y)).first()[0]
            if share in (None, 0.0, 1.0):
                test = test.withColumn(f"_p{y}", F.lit(0.5 if share is None else share))
                continue
            model = (GBTClassifier(featuresCol="_x", labelCol=y, maxDepth=3, maxIter=rounds, seed=0) if kind == "trees" else LogisticRegression(featuresCol="_x", labelCol=y, maxIter=rounds)).fit(train)
            test = model.transform(test).withColumn(f"_p{y}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        part = test.withColumn("score", F.col("_p_f") - F.col("_p_e")).select(*df.columns, "score")
        out = part if out is None else out.unionByName(part)
    return df.withColumn("score", F.lit(None).cast("double")) if out is None else out


def tfidf_nearest(queries: DataFrame, base: DataFrame, tokens: Column, apart: str | None = None) -> DataFrame:
    """(query_id, id, cosine): the base text of the greatest cosine of tf-idf weights over words and word pairs, smoothed
    idf ln((1 + n) / (1 + df)) + 1 from the base; the lowest id on ties within 1e-9; queries that share no term have none.

    queries: query_id, and the text that tokens reads; base: id and text.  With apart, a column of both, a query meets texts
    with another value of it only, and rows where it is null meet none.  Terms that no query has take part in norms alone.

    Groups of queries meet stripes of texts, a pair of them in a task, which multiplies blocks of their weights in memory and
    gives one row a query; no pairs of query and text are exchanged.
    """
    if apart:
        queries, asked_of = queries.where(F.col(apart).isNotNull()), base.where(F.col(apart).isNotNull())
    else:
        asked_of = base
    w = F.col("_words")
    grams = F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y)))
    n = base.agg(F.count(F.lit(1)).alias("n"))
    group = [F.col(apart).cast("string").alias("own") if apart else F.lit(None).cast("string").alias("own")]
    tf = cut(base.select("id", tokens.alias("_words")).select("id", F.explode(grams).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf")))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    q = queries.select("query_id", tokens.alias("_words")).select("query_id", F.explode(grams).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    idf = cut(idf.join(q.select("term", F.lit(True).alias("asked")).distinct(), "term", "left"))

    def vectors(rows: DataFrame, key: str, count: str, of: DataFrame) -> DataFrame:
        w = (F.col(count) * F.col("idf")).alias("w")
        asked = F.array_sort(F.collect_list(F.when(F.col("asked"), F.struct(F.xxhash64("term").alias("t"), w))))
        own = rows.join(idf, "term").groupBy(key).agg(F.sqrt(F.sum(F.pow(w, 2))).alias("norm"), asked.alias("v"))
        own = own.where(F.size("v") > 0).join(of, key)
        return cut(own.select(F.col(key).alias("id"), "own", "norm", F.col("v.t").alias("t"), F.col("v.w").alias("w")))

    asks = vectors(q, "query_id", "qtf", queries.select("query_id", *group).distinct())
    held = vectors(tf, "id", "tf", asked_of.select("id", *group).distinct())
    groups, stripes = (int(-(-x.count() // most)) or 1 for x, most in ((asks, GROUP), (held, STRIPE)))
    part = lambda k: F.pmod(F.xxhash64("id"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    met = asks.withColumns({"group": part(groups), "stripe": every(stripes), "asks": F.lit(True)}).unionByName(held.withColumns({"group": every(groups), "stripe": part(stripes), "asks": F.lit(False)}))
    met = met.repartition(groups * stripes, "group", "stripe").sortWithinPartitions("group", "stripe", F.desc("asks")).select("group", "stripe", "asks", "id", "own", "norm", "t", "w")
    best = met.mapInArrow(_nearest, "query_id long, id long, cosine double").groupBy("query_id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "id")).alias("b"))
    return best.select("query_id", F.col("b.id").alias("id"), (-F.col("b.c")).alias("cosine"))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, id, cosine): of each group of queries and stripe of texts, each query's nearest text.  The queries of a
    group come first and are held as one list of entries by term; texts are multiplied ROWS at a time."""
    at, asked, best = None, [], None

    def flat(x: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, w = x.column("t"), x.column("w")
        return np.repeat(np.arange(len(x)), np.diff(t.offsets.to_numpy())), t.flatten().to_numpy(), w.flatten().to_numpy()

    def out() -> Iterator[pa.RecordBatch]:
        if best is not None and (found := best["cosine"] > 0).any():
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (best["query"], best["id"], best["cosine"])], ["query_id", "id", "cosine"])

    def index() -> dict:
        rows = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
        i, t, w = flat(rows)
        order = np.argsort(t, kind="stable")
        m, of = len(rows), {}
        for k, own in enumerate(rows.column("own").to_pylist()):
            of.setdefault(own, []).append(k)
        return {"i": i[order], "t": t[order], "w": w[order], "query": rows.column("id").to_numpy(), "norm": rows.column("norm").to_numpy(), "cosine": np.zeros(m), "id": np.zeros(m, np.int64), "of": of}

    for batch in batches:
        if not len(batch):
            continue
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("group", "stripe", "asks")])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for lo, hi in itertools.pairwise(cuts):
            if tuple(keys[lo, :2]) != at:
                yield from out()
                at, asked, best = tuple(keys[lo, :2]), [], None
            if keys[lo, 2]:
                asked.append(batch.slice(lo, hi - lo))
                continue
            if not asked:
                continue
            best = best or index()
            m = len(best["query"])
            for first in range(lo, hi, ROWS):
                x = batch.slice(first, min(ROWS, hi - first))
                x = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in x.columns], x.schema.names)
                i, t, w = flat(x)
                start, end = np.searchsorted(best["t"], t, "left"), np.searchsorted(best["t"], t, "right")
                n = end - start
                to = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                dot = np.bincount(np.repeat(i, n) * m + best["i"][to], np.repeat(w, n) * best["w"][to], len(x) * m).reshape(-1, m)
                cosine = np.round(dot / (x.column("norm").to_numpy()[:, None] * best["norm"][None, :]), 9)
                for j, own in enumerate(x.column("own").to_pylist()):
                    if own is not None and own in best["of"]:
                        cosine[j, best["of"][own]] = 0
                ids = x.column("id").to_numpy()
                top = cosine.max(axis=0)
                least = np.where(cosine == top, ids[:, None], np.iinfo(np.int64).max).min(axis=0)
                better = (top > best["cosine"]) | (top == best["cosine"]) & (top > 0) & (least < best["id"])
                best["cosine"][better], best["id"][better] = top[better], least[better]
    yield from out()


def novelty_metrics(df: DataFrame, fast: str, right: str) -> DataFrame:
    """Share of turns that were escalated, and of wrong ones among the others; null where there are none."""
    fast_, wrong = F.col(fast), ~F.col(right)
    return df.agg(F.count(F.lit(1)).alias("turns"), F.count_if(fast_).alias("fast_turns"), F.avg((~fast_).cast("double")).alias("escalation_rate"), F.avg(F.when(fast_, wrong.cast("double"))).alias("fast_error_rate"))


def best_flags(df: DataFrame, task: str, candidate: str, metric: str) -> DataFrame:
    """best: whether a candidate has the greatest metric of its task (the first name on ties)."""
    nth = F.row_number().over(W.partitionBy(task).orderBy(F.desc_nulls_last(metric), candidate))
    return df.withColumn("best", nth == 1)


def quoted_section(evidence: DataFrame, sections: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, evidence, start): the section that holds the first place where the evidence's first twelve words stand in
    the document, whatever stands between words; evidence of fewer than three words, or that isn't there, has none.

    evidence: doc_id, evidence; docs: doc_id, text; sections: doc_id, start, end (character positions).
    """
    words = F.slice(F.regexp_extract_all(F.substring("evidence", 1, 400), F.lit(r"\w+"), F.lit(0)), 1, 12)
    asked = evidence.withColumn("_w", words).where(F.size("_w") >= 3).join(docs.select("doc_id", "text"), "doc_id")
    found = asked.withColumn("_at", F.regexp_instr("text", F.array_join("_w", r"\W+")) - 1).where("_at >= 0").select("doc_id", "evidence", "_at")
    return found.join(sections, "doc_id").where((F.col("start") <= F.col("_at")) & (F.col("_at") < F.col("end"))).select("doc_id", "evidence", "start")
