"""Shortlists, nearest classes, isotonic allocation, halving rungs, coverage with control, rule learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.functions.text import dot
from sluicegate.operators.sizes import small
from sluicegate.ident import order_key


def shortlist(probs: DataFrame, m: int) -> DataFrame:
    """The m likeliest classes of each item (lowest class on ties): item_idx, class, p, rank."""
    rank = F.row_number().over(W.partitionBy("item_idx").orderBy(F.desc("p"), "class"))
    return probs.withColumn("rank", rank).where(F.col("rank") <= m).select("item_idx", "class", "p", "rank")


def pair_plan(items: int, classes: int, m: int, per_second: float) -> dict[str, float]:
    """Pairs and seconds of scoring a shortlist of m against all classes."""
    return {"pairs_all": float(items * classes), "pairs": float(items * min(m, classes)), "seconds_all": items * classes / per_second, "seconds": items * min(m, classes) / per_second}


def nearest_class(df: DataFrame, centres: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, label, sim): the class centre of the greatest inner product (rounded; lowest label on ties).

    centres: label, centre (array); a row for each class.
    """
    packed = centres.agg(F.collect_list(F.struct("label", "centre")).alias("_c"))
    met = df.crossJoin(F.broadcast(packed)).select(key, F.transform("_c", lambda c: F.struct((-F.round(dot(F.col(vector), c["centre"]), 6)).alias("n"), c["label"].alias("label"))).alias("_s"))
    best = F.array_min("_s")
    return met.select(key, best["label"].alias("label"), (-best["n"]).alias("sim"))


def locate(pieces: DataFrame, question: Column, expanded: Column, k: int) -> DataFrame:
    """Rank pieces by 2 |words in the question| + |words in its expansion|: doc_id, i, score, rank.  pieces: doc_id, i, words."""
    score = 2 * F.size(F.array_intersect("words", question)) + F.size(F.array_intersect("words", expanded))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "i"))
    return pieces.withColumn("score", score).withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") > 0)).select("doc_id", "i", "score", "rank")


def covers_all(postings: DataFrame, wanted: DataFrame, slots: int) -> DataFrame:
    """Pieces whose postings cover every slot of the question.  postings: piece, term; wanted: slot, term."""
    return postings.join(small(wanted), "term").groupBy("piece").agg(F.countDistinct("slot").alias("n")).where(F.col("n") == slots).select("piece")


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing fit by pooling adjacent violators."""
    values, weights, sizes = [], [], []
    for a, b in zip(y, w, strict=True):
        values.append(float(a))
        weights.append(float(b))
        sizes.append(1)
        while len(values) > 1 and values[-2] > values[-1]:
            v, u, s = values.pop(), weights.pop(), sizes.pop()
            values[-1] = (values[-1] * weights[-1] + v * u) / (weights[-1] + u)
            weights[-1] += u
            sizes[-1] += s
    return np.repeat(values, sizes)


def per_class_confidence(df: DataFrame, fraction: float, chunk: float = 0.02) -> DataFrame:
    """Escalate, within a fold's budget, chunks of the least confident rows of the predicted class whose modelled gain is
    greatest: expert accuracy on the class less an isotonic fit of the free arm's accuracy by confidence, both from training.

    Confidence is cut into chunks of the given width; a fold's training side is summed by class and chunk first, so a group
    holds chunks.
    """
    width = round(1 / chunk)
    bins = df.groupBy("fold", "free_pred", F.floor(F.col("free_conf") * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("int(free_pred = gold)")).alias("f"), F.sum(F.expr("int(expert_pred = gold)")).alias("e"))
    total = bins.groupBy("free_pred", "bin").agg(F.sum("n").alias("an"), F.sum("f").alias("af"), F.sum("e").alias("ae"))
    folds = df.select("fold").distinct()
    train = folds.join(F.broadcast(total), F.lit(True)).join(bins, ["fold", "free_pred", "bin"], "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    train = train.select("fold", "free_pred", "bin", (F.col("an") - z(F.col("n"))).alias("n"), (F.col("af") - z(F.col("f"))).alias("f"), (F.col("ae") - z(F.col("e"))).alias("e")).where("n > 0")
    own = df.groupBy("fold", "free_pred", F.floor(F.col("free_conf") * width).alias("bin")).agg(F.count(F.lit(1)).alias("rows")).select(*(F.col(c).alias(f"{c}_") for c in ("fold", "free_pred", "bin", "rows")))

    def plan(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.set_axis(["fold", "free_pred", "bin", "rows"], axis=1)
        gains = []
        for c, t in a.groupby("free_pred"):
            t = t.sort_values("bin")
            fit = isotonic((t["f"] / t["n"]).to_numpy(), t["n"].to_numpy())
            expert = t["e"].sum() / t["n"].sum()
            here = b[b["free_pred"] == c]
            for bin_, rows in zip(here["bin"], here["rows"], strict=True):
                at = min(max(int(np.searchsorted(t["bin"].to_numpy(), bin_, side="right")) - 1, 0), len(fit) - 1)
                gains.append((round(expert - fit[at], 9), c, bin_, rows))
        left, out = fraction * b["rows"].sum(), []
        for g, c, bin_, rows in sorted(gains, key=lambda x: (-x[0], x[1], x[2])):
            if g > 0 and rows <= left:
                left -= rows
                out.append((key[0], c, bin_))
        return pd.DataFrame(out, columns=["fold", "free_pred", "bin"])

    chosen = train.groupBy("fold").cogroup(own.groupBy("fold_")).applyInPandas(plan, "fold int, free_pred int, bin long").withColumn("_hit", F.lit(True))
    rows = df.withColumn("bin", F.floor(F.col("free_conf") * width))
    return rows.join(F.broadcast(chosen), ["fold", "free_pred", "bin"], "left").withColumn("escalated", F.coalesce("_hit", F.lit(False))).drop("_hit", "bin")


def rung(df: DataFrame, key: str, label: str, fraction: float, seed: str = "") -> DataFrame:
    """The first share of each class in hash order, rounded up: rungs of one seed are nested."""
    rank = F.row_number().over(W.partitionBy(label).orderBy(order_key(key, seed), key))
    n = F.count(F.lit(1)).over(W.partitionBy(label))
    return df.withColumn("_r", rank).withColumn("_n", n).where(F.col("_r") <= F.ceil(F.col("_n") * fraction)).drop("_r", "_n")


def survivors(scores: DataFrame, half_width: str) -> DataFrame:
    """Candidates whose upper limit reaches the lower limit of the best; scores: model, score, half_width."""
    best = scores.agg(F.max(F.col("score") - F.col(half_width)).alias("_lo"))
    return scores.crossJoin(F.broadcast(best)).where(F.col("score") + F.col(half_width) >= F.col("_lo")).drop("_lo")


def coverage_lift(sims: DataFrame, task: str, control: str, sim: str, t: float) -> DataFrame:
    """Share of criteria with a similarity of at least t to their own task, to a shuffled one, and the difference."""
    a = sims.groupBy("criterion").agg(F.max(F.when(F.col(task) == F.col("criterion_task"), F.col(sim))).alias("own"), F.max(F.when(F.col(control) == F.col("criterion_task"), F.col(sim))).alias("other"))
    own, other = F.avg(F.coalesce(F.col("own") >= t, F.lit(False)).cast("double")), F.avg(F.coalesce(F.col("other") >= t, F.lit(False)).cast("double"))
    return a.agg(own.alias("coverage"), other.alias("floor"), (own - other).alias("lift"))


def statement_features(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """Document features of statement scores: the two greatest, how many reach one half, and their sum."""
    top = F.sort_array(F.collect_list(p), asc=False)
    return df.groupBy(*by).agg(top.alias("_t"), F.count_if(F.col(p) >= 0.5).alias("half"), F.sum(p).alias("total")).select(*by, F.get("_t", F.lit(0)).alias("first"), F.coalesce(F.get("_t", F.lit(1)), F.lit(0.0)).alias("second"), "half", "total")


def joint_decode(df: DataFrame, links: pd.DataFrame) -> DataFrame:
    """Iterated conditional modes over a document's questions: each takes the answer of the best own score plus the weights
    of links from the others' answers, until nothing changes or a state comes again.  df: doc_id, question, answer, score; links: a, la, b, lb, weight (a bounded table)."""
    table = {(r.a, r.la, r.b, r.lb): r.weight for r in links.itertuples()}

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {q: dict(zip(g["answer"], g["score"], strict=True)) for q, g in pdf.groupby("question")}
        now = {q: min(s, key=lambda a, s=s: (-s[a], a)) for q, s in own.items()}
        seen = set()
        while (state := tuple(now[q] for q in sorted(own))) not in seen:
            seen.add(state)
            for q in sorted(own):
                value = lambda a, q=q: own[q][a] + sum(table.get((o, now[o], q, a), 0.0) for o in own if o != q)
                now[q] = min(own[q], key=lambda a, value=value: (-value(a), a))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "question": sorted(now), "answer": [now[q] for q in sorted(now)]})

    return df.groupBy("doc_id").applyInPandas(decode, "doc_id long, question string, answer string")


def word_diff(df: DataFrame, old: str, new: str, key: str) -> DataFrame:
    """(key, marked): the new text with removed words in [-x-] and added ones in {+x+}."""
    import difflib

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for a, b in zip(pdf[old].fillna("").str.split(), pdf[new].fillna("").str.split(), strict=True):
                parts = []
                for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    if op == "equal":
                        parts += a[i:j]
                    else:
                        parts += [f"[-{' '.join(a[i:j])}-]"] * (j > i) + [f"{{+{' '.join(b[k:m])}+}}"] * (m > k)
                out.append(" ".join(parts))
            yield pd.DataFrame({key: pdf[key], "marked": out})

    return df.select(key, old, new).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, marked string")
