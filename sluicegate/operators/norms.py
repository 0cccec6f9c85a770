"""Norms of a document and their priority: which hold, which are defeated, and what they say about an answer.

A norm is (doc_id, stmt, actions, actors, things, polarity, override, defers, except_secs, inline_exception, secs): polarity
is permit, oblige or ban; override says that it holds notwithstanding others; defers are the sections that it is subject
to, except_secs those that it excepts, secs those that it stands in.  Null arrays count as empty, null flags as false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluicegate.operators.sizes import cut

_ARRAYS, _FLAGS = ("actions", "actors", "things", "defers", "except_secs", "secs"), ("override", "inline_exception")
#: What decides on a norm's relations to others, beside its document.
_SIGNATURE = ["actions", "polarity", "override", "defers", "except_secs", "secs"]
#: The polarity of a norm that speaks against an answer, by what is asked.
OPPOSITE = {("CAN", "yes"): "ban", ("PROHIBITED", "yes"): "permit", ("MUST", "yes"): "ban", ("CAN", "no"): "permit", ("PROHIBITED", "no"): "ban"}


def _sound(norms: DataFrame) -> DataFrame:
    kinds = {c: norms.schema[c].dataType for c in norms.columns}
    arrays = {c: F.coalesce(F.col(c), F.array().cast(kinds[c])) for c in _ARRAYS if c in kinds}
    return norms.withColumns(arrays | {c: F.coalesce(F.col(c), F.lit(False)) for c in _FLAGS if c in kinds})


def _meet(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def attacks(norms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): norms of one document that are equal in all that their relations depend on are one class (doc_id, id
    and those columns); edges (winner, loser) name classes of opposite polarity with a common action, where the winner
    overrides, or the loser defers to or excepts its section.  Opposites without such a relation defeat each other.
    """
    sorted_ = {c: F.array_sort(F.array_distinct(c)) for c in ("actions", "defers", "except_secs", "secs")}
    rows = _sound(norms).withColumns(sorted_)
    classes = rows.select("doc_id", *_SIGNATURE).distinct().withColumn("id", F.md5(F.to_json(F.struct("doc_id", *_SIGNATURE))))
    side = F.when(F.col("polarity") == "ban", "ban").when(F.col("polarity").isin("permit", "oblige"), "allow")
    acts = classes.withColumn("side", side).where("side IS NOT NULL").withColumn("action", F.explode("actions"))
    keep = ["id", "actions", "override", "defers", "except_secs", "secs"]
    ban = acts.where("side = 'ban'").select("doc_id", "action", *(F.col(c).alias(f"b_{c}") for c in keep))
    allow = acts.where("side = 'allow'").select("doc_id", "action", *(F.col(c).alias(f"a_{c}") for c in keep))
    # a pair with several common actions is met at the least of them only
    met = ban.join(allow, ["doc_id", "action"]).where(F.array_min(F.array_intersect("a_actions", "b_actions")) == F.col("action"))

    def beats(x: str, y: str) -> Column:
        yields = _meet(F.col(f"{y}_defers"), F.col(f"{x}_secs")) | _meet(F.col(f"{y}_except_secs"), F.col(f"{x}_secs"))
        return (F.col(f"{x}_override") & ~F.col(f"{y}_override")) | yields

    one, two = beats("a", "b"), beats("b", "a")
    none = ~one & ~two
    pair = lambda c, w, x: F.when(c | none, F.struct(F.col(f"{w}_id").alias("winner"), F.col(f"{x}_id").alias("loser")))
    edges = met.select(F.explode(F.array_compact(F.array(pair(one, "a", "b"), pair(two, "b", "a")))).alias("e")).select("e.*")
    return classes, edges


#: Norms of a document up to which a task settles it; those of larger ones meet in exchanges.
AT_ONCE = 2000


def _matches(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all equal elements of x and y."""
    order = np.argsort(y, kind="stable")
    low, high = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    n = high - low
    return np.repeat(np.arange(len(x)), n), order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _settled(t: pa.Table) -> pa.Table:
    """t, whole documents without null elements, with status and stratum."""
    n = len(t)
    doc = t["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def keyed(*columns: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(norm, key) of the elements of each column; a key stands for an element in a document."""
        lists = [t[c].combine_chunks() for c in columns]
        rows = [np.repeat(np.arange(n), x.value_lengths().to_numpy(zero_copy_only=False)) for x in lists]
        codes = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.split(codes, np.cumsum([len(r) for r in rows])[:-1])
        return [(r, c * (n + 1) + doc[r]) for r, c in zip(rows, codes, strict=True)]

    polarity, override = np.array(t["polarity"].to_pylist(), object), t["override"].to_numpy()
    (row, key), = keyed("actions")
    ban, allow = polarity[row] == "ban", np.isin(polarity[row].astype(str), ["permit", "oblige"])
    i, j = _matches(key[ban], key[allow])
    pairs = np.unique(row[ban][i] * n + row[allow][j])
    x, y = pairs // n, pairs % n
    (d, dk), (e, ek), (s, sk) = keyed("defers", "except_secs", "secs")
    i, j = _matches(np.r_[dk, ek], sk)
    yields = np.unique(np.r_[d, e][i] * n + s[j])
    beats = lambda a, b: (override[a] & ~override[b]) | np.isin(b * n + a, yields)
    one, two = beats(x, y), beats(y, x)
    none = ~one & ~two
    winner, loser = np.r_[x[one | none], y[two | none]], np.r_[y[one | none], x[two | none]]
    status, stratum, round_ = np.zeros(n, np.int64), np.full(n, -1, np.int32), 0
    while True:
        heads = status == 0
        heads[loser] = False
        if not heads.any():
            break
        out = loser[heads[winner]]
        status[heads], status[out] = 1, 2
        stratum[heads] = stratum[out] = round_
        left = (status[winner] == 0) & (status[loser] == 0)
        winner, loser, round_ = winner[left], loser[left], round_ + 1
    names = pa.array(["unresolved", "holds", "defeated"])
    return t.append_column("status", names.take(pa.array(status))).append_column("stratum", pa.array(stratum))


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that are sorted by document, settled in pieces of whole documents."""
    kept = None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        kept = t if kept is None else pa.concat_tables([kept, t])
        doc = kept["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(doc == doc[-1])[0])
        if last:
            yield from _settled(kept.slice(0, last).combine_chunks()).to_batches()
            kept = kept.slice(last).combine_chunks()
    if kept is not None:
        yield from _settled(kept.combine_chunks()).to_batches()


def standing(norms: DataFrame) -> DataFrame:
    """norms with status and stratum: "holds" if every norm that beats it is defeated, "defeated" if one that beats it holds,
    else "unresolved" (cycles and what hangs on them); stratum is the round in which that was settled, -1 for unresolved.

    A round settles the norms that nothing open beats, and defeats what they beat; rounds follow the longest chain of defeats
    and end when one settles nothing.  Norms are exchanged once, by document, and a task settles some whole documents at a
    time; documents of more than AT_ONCE norms, or with null elements in arrays, are settled by ``exchanged``.  Norms
    without a document meet no others.
    """
    rows = _sound(norms)
    size = F.count(F.lit(1)) > AT_ONCE
    odd = F.bool_or(_any(F.exists(c, lambda x: x.isNull()) for c in ("actions", "defers", "except_secs", "secs")))
    apart = cut(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg((size | odd).alias("_apart")).where("_apart").select("doc_id"))
    large = not apart.isEmpty()
    most = rows.where("doc_id IS NOT NULL")
    most = most.join(apart, "doc_id", "left_anti") if large else most
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in most.schema), T.StructField("status", T.StringType()), T.StructField("stratum", T.IntegerType())])
    out = most.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_by_document, schema)
    out = out.unionByName(rows.where("doc_id IS NULL").withColumns({"status": F.lit("holds"), "stratum": F.lit(0)}))
    return out.unionByName(exchanged(rows.join(apart, "doc_id", "left_semi"))) if large else out


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def exchanged(norms: DataFrame) -> DataFrame:
    """``standing`` with documents of any size: classes of equal norms and their edges meet in exchanges, a round at a time."""
    classes, edges = attacks(norms)
    classes, edges = cut(classes), cut(edges.distinct())
    open_, settled, round_ = classes.select("id"), None, 0
    while True:
        heads = cut(open_.join(edges.select(F.col("loser").alias("id")).distinct(), "id", "left_anti"))
        if heads.isEmpty():
            break
        out = cut(edges.join(heads.withColumnRenamed("id", "winner"), "winner", "left_semi").select(F.col("loser").alias("id")).distinct())
        done = heads.withColumn("status", F.lit("holds")).unionByName(out.withColumn("status", F.lit("defeated"))).withColumn("stratum", F.lit(round_))
        settled = done if settled is None else settled.unionByName(done)
        gone = cut(done.select("id"))
        open_ = cut(open_.join(gone, "id", "left_anti"))
        left = edges.join(gone.withColumnRenamed("id", "winner"), "winner", "left_anti")
        edges = cut(left.join(gone.withColumnRenamed("id", "loser"), "loser", "left_anti").select("winner", "loser"))
        round_ += 1
    rest = open_.select("id", F.lit("unresolved").alias("status"), F.lit(-1).alias("stratum"))
    found = classes.join(rest if settled is None else settled.unionByName(rest), "id")
    key = F.md5(F.to_json(F.struct("doc_id", *(F.array_sort(F.array_distinct(c)).alias(c) if c in _ARRAYS else F.col(c) for c in _SIGNATURE))))
    return _sound(norms).withColumn("id", key).join(found.select("id", "status", "stratum"), "id").drop("id")


def answer_priority(norms: DataFrame, answers: DataFrame) -> DataFrame:
    """What the norms of its document say about each answer.

    answers: answer_id, doc_id, actions, actor, things, asks, answer, evidence (the stmt that it rests on).  Of the norms with
    a common action, an actor that is asked for (or "ANY", "ALL" or none) and a common thing if any is asked for: n_ban,
    n_permit, ban_unexcepted (bans, no permit, and no exception in or from a ban), and for the norms of the polarity
    that speaks against the answer: n_conflicts, overridden, evidence_overrides, defers, is_exception, unresolved.
    """
    norms = _sound(norms)
    kinds = {c: answers.schema[c].dataType for c in ("actions", "things")}
    asked = answers.withColumns({c: F.coalesce(F.col(c), F.array().cast(k)) for c, k in kinds.items()})
    against = F.lit(None).cast("string")
    for (asks, said), polarity in OPPOSITE.items():
        against = F.when((F.col("asks") == asks) & (F.col("answer") == said), polarity).otherwise(against)
    own = norms.select("doc_id", F.col("stmt").alias("evidence"), F.col("override").alias("e_override"), F.col("defers").alias("e_defers"), F.col("except_secs").alias("e_except"), F.col("inline_exception").alias("e_inline"), F.col("secs").alias("e_secs"))
    asked = cut(asked.withColumn("against", against).join(own, ["doc_id", "evidence"], "left").withColumn("found", F.col("e_override").isNotNull()))
    # other norms show in no column of the result; the join is by document alone, as norms may lie by document already
    told = norms.where(F.col("polarity").isin("ban", "permit")).select(F.col("doc_id").alias("n_doc"), "stmt", F.col("actions").alias("n_actions"), "actors", F.col("things").alias("n_things"), "polarity", "override", "inline_exception", "except_secs", "secs")
    met = asked.join(told, (F.col("doc_id") == F.col("n_doc")) & _meet(F.col("actions"), F.col("n_actions")))
    anyone = F.coalesce(F.col("actor"), F.lit("ANY")).isin("ANY", "ALL")
    met = met.where(anyone | F.array_contains("actors", F.col("actor"))).where((F.size("things") == 0) | _meet(F.col("things"), F.col("n_things")))
    conflict = F.coalesce((F.col("polarity") == F.col("against")) & ~F.col("found"), F.lit(False)) | F.coalesce((F.col("polarity") == F.col("against")) & (F.col("stmt") != F.col("evidence")), F.lit(False))
    e = lambda c: F.coalesce(F.col(c), F.lit(False))
    meets = lambda a, b: F.coalesce(_meet(F.col(a), F.col(b)), F.lit(False))
    steps = [
        ("overridden", F.col("override") & ~e("e_override")),
        ("evidence_overrides", e("e_override")),
        ("defers", F.col("found") & meets("secs", "e_defers")),
        ("is_exception", F.col("found") & (meets("secs", "e_except") | (F.col("inline_exception") & meets("secs", "e_secs")))),
        ("specific", F.col("found") & (e("e_inline") | (F.coalesce(F.size("e_except"), F.lit(0)) > 0))),
    ]
    why = F.lit("unresolved")
    for name, holds in reversed(steps):
        why = F.when(holds, name).otherwise(why)
    met = met.withColumn("why", F.when(conflict, why))
    ban = F.col("polarity") == "ban"
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    told = met.groupBy("answer_id").agg(
        F.count_if(ban).alias("n_ban"),
        F.count_if(F.col("polarity") == "permit").alias("n_permit"),
        (flag(ban) & ~flag(F.col("polarity") == "permit") & ~flag(ban & (F.col("inline_exception") | (F.size("except_secs") > 0)))).alias("ban_unexcepted"),
        F.count("why").alias("n_conflicts"),
        *(flag(F.col("why") == n).alias(n) for n in ("overridden", "evidence_overrides", "defers", "is_exception", "unresolved")),
    )
    out = asked.select("answer_id", F.col("found").alias("evidence_found")).join(told, "answer_id", "left")
    return out.na.fill(0, ["n_ban", "n_permit", "n_conflicts"]).na.fill(False, ["ban_unexcepted", "overridden", "evidence_overrides", "defers", "is_exception", "unresolved"])
