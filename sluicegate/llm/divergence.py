"""Operator 11, source divergence audit by term-block dense matrices.

The texts of a language are cut into terms; its kept terms are dealt over blocks of about ``BLOCK_TERMS`` terms by hash.
A block is a dense int64 tile of shares, group by term: a group without rows for a term has the share of count 0.  All
pairs of a tile's groups are met by broadcasting one group's row over the tile; the partial pair matrices of the blocks
are summed, and each group's heaps of its best terms of each block are merged.  Groups are dealt in blocks of
``BLOCK_GROUPS``, and a tile holds two of them at most, so a language with many sources has more tiles and no larger ones.

Terms are runs of A-Z, a-z and code points beyond 127, in lower case for A-Z; in UTF-8 these are the runs of such bytes.
Shares p are 1 + floor(10**9 * (count + 2) / (N + 2 V)), differences floor((p - q)**2 / (p + q)), all in integers.

Defined results: null text, lang and source are empty strings; a group without terms has the shares of count 0, and one in
a language without kept terms the value 0 beside every other source; a language of one source has no pairs; repeated rows
are separate documents; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from sluicegate.llm.common import LOWER, steps, table, utf8

#: Terms and groups of a tile's side, and bytes of text that one numpy step cuts.
BLOCK_TERMS, BLOCK_GROUPS, STEP = 4096, 64, 4 << 20
#: The unit of shares, and the terms that are reported for a group.
UNIT, TOP = 1_000_000_000, 10

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts, one after the other, and the row of each."""
    data, offsets = utf8(column)
    inside = _TERM[data]
    edge = inside.copy()  # where a term begins
    edge[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    edge[heads] = inside[heads]
    start = np.flatnonzero(edge)
    flat = LOWER[data[inside]]
    at = np.append(np.cumsum(inside)[start] - 1, len(flat)).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat)))
    return whole.dictionary_encode(), np.searchsorted(offsets, start, side="right") - 1


def share(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 kept)) in two steps of long division, exact up to counts of 9 * 10**13."""
    over, by = count + 2, total + 2 * kept
    high, rest = np.divmod(over * 100_000, by)
    return 1 + high * 10_000 + rest * 10_000 // by


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); shares are at most UNIT + 1, so the square fits 64 bits."""
    return (p - q) ** 2 // (p + q)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents that hold it.  Each group
    has a row with a null term as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text", STEP):
            names = pa.StructArray.from_arrays([b.column("lang"), b.column("source")], ["lang", "source"])
            pairs = {}
            group = np.array([pairs.setdefault((x["lang"], x["source"]), len(pairs)) for x in names.to_pylist()], np.int64)
            found, row = terms(b.column("text"))
            code, size = found.indices.to_numpy().astype(np.int64), max(len(found.dictionary), 1)
            # occurrences and documents of each (group, term)
            in_doc, n = np.unique(row * size + code, return_counts=True)
            key, back = np.unique(group[in_doc // size] * size + in_doc % size, return_inverse=True)
            occurs = np.bincount(back, n, len(key)).astype(np.int64)
            holds = np.bincount(back, minlength=len(key)).astype(np.int64)
            lang, source = (pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))
            of, term = pa.array(key // size), found.dictionary.take(pa.array(key % size)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang.take(of), source.take(of), term, pa.array(occurs), pa.array(holds)], ["lang", "source", "term", "n", "docs"])
            none = pa.array(np.zeros(len(pairs), np.int64))
            yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(pairs), pa.string()), none, none], ["lang", "source", "term", "n", "docs"])

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for a, c in (("lang", "lang"), ("source", "source"), ("text", text))))
    found = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Audit:
    """The tables of an audit: kept terms by language, groups with their totals, and the tiles."""

    def __init__(self, docs: DataFrame, least_docs: int = 10, text: str = "text", block_terms: int = BLOCK_TERMS, block_groups: int = BLOCK_GROUPS):
        self.block_groups = block_groups
        found = table(counts(docs, text), "terms")
        by_term = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
        kept = by_term.where(F.col("docs") >= least_docs).select("lang", "term", "total")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_total"))
        langs = langs.withColumn("blocks", F.ceil(F.col("v") / block_terms).cast("int"))
        # the terms with their block; a language's row is met by its terms, so its side is the small one whatever it holds
        block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
        self.langs = table(langs, "langs")
        self.kept = table(kept.join(self.langs, "lang").select("lang", "term", "total", block.alias("block")), "kept")
        self.own = table(found.where("n > 0").join(self.kept, ["lang", "term"]).select("lang", "source", "term", "n", "total", "block"), "own")
        place = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
        groups = found.select("lang", "source").distinct().join(self.own.groupBy("lang", "source").agg(F.sum("n").alias("group_total")), ["lang", "source"], "left")
        groups = groups.join(self.langs, "lang", "left").na.fill(0, ["group_total", "v", "lang_total"]).na.fill(1, ["blocks"])
        self.groups = table(groups.withColumn("side", (place / block_groups).cast("int")), "groups")

    def tiles(self) -> DataFrame:
        """(lang, source, part, item, value): partial pair values and each tile's best terms."""
        sides = self.groups.groupBy("lang").agg((F.max("side") + 1).alias("sides"))
        groups = self.groups.join(sides, "lang")
        # each block of groups meets itself and every other one
        to = F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("to")
        low, high = F.least("side", "to").alias("low"), F.greatest("side", "to").alias("high")
        size = self.kept.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("width"))
        heads = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        heads = heads.join(size, ["lang", "block"], "left").select("lang", "block", "source", "side", "sides", "group_total", "v", "lang_total", F.coalesce("width", F.lit(0)).alias("width"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"))
        rows = self.own.join(groups.select("lang", "source", "side", "sides", "group_total", "v", "lang_total"), ["lang", "source"])
        rows = rows.select("lang", "block", "source", "side", "sides", "group_total", "v", "lang_total", F.lit(0).cast("long").alias("width"), "term", "n", "total")
        met = heads.unionByName(rows).select("*", to).select("*", low, high).drop("sides", "to")
        return met.groupBy("lang", "block", "low", "high").applyInArrow(_tile, "lang string, source string, part string, item string, value long")

    def result(self) -> DataFrame:
        """(lang, source, part, item, value, rank)."""
        found = table(self.tiles(), "tiles")
        pair = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pair = pair.withColumn("rank", F.row_number().over(order).cast("int"))
        term = found.where("part = 'term'").withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= TOP)
        return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def _tile(rows: pa.Table) -> pa.Table:
    """One tile: two blocks of groups (or one with itself) by one block of terms."""
    head = pc.is_null(rows["term"])
    heads, cells = rows.filter(head).sort_by("source"), rows.filter(pc.invert(head))
    names = heads["source"].combine_chunks()
    side, (total, v, width, lang_total) = heads["side"].to_numpy(), (heads[c].to_numpy().astype(np.int64) for c in ("group_total", "v", "width", "lang_total"))
    low, high, lang = rows["low"][0].as_py(), rows["high"][0].as_py(), rows["lang"][0].as_py()
    coded = cells["term"].combine_chunks().dictionary_encode()
    g = pc.index_in(cells["source"], value_set=names).to_numpy().astype(np.int64)
    t, n = coded.indices.to_numpy().astype(np.int64), cells["n"].to_numpy().astype(np.int64)
    if v[0] == 0:
        value = np.zeros((len(names), len(names)), np.int64)
    else:
        tile = np.zeros((len(names), len(coded.dictionary)), np.int64)
        tile[g, t] = n
        p = share(tile, total[:, None], v[:, None])
        none = share(np.zeros_like(total), total, v)  # terms of the block that no group of this tile has
        value = np.stack([gap(p[i], p).sum(1) + (width[0] - tile.shape[1]) * gap(none[i], none) for i in range(len(names))])
    i, j = np.nonzero(~np.eye(len(names), dtype=bool) & ((side[:, None] == low) & (side == high) | (side[:, None] == high) & (side == low)))
    parts = [(names.take(pa.array(i)), names.take(pa.array(j)), value[i, j], "pair")]
    if low == high and v[0]:
        q = share(cells["total"].to_numpy().astype(np.int64), lang_total[g], v[g])
        own = p[g, t]
        more = np.flatnonzero(own > q)
        f = gap(own[more], q[more])
        # a bounded heap for each group: the best terms of this block, by value and then by the term's bytes
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(coded.dictionary))
        order = np.lexsort((place[t[more]], -f, g[more]))
        more, f = more[order], f[order]
        rank = np.arange(len(more)) - np.searchsorted(g[more], g[more])
        more, f = more[rank < TOP], f[rank < TOP]
        parts.append((names.take(pa.array(g[more])), coded.dictionary.take(pa.array(t[more])), f, "term"))
    return pa.concat_tables(pa.table({"lang": pa.array([lang] * len(s), pa.string()), "source": s.cast(pa.string()), "part": pa.array([part] * len(s), pa.string()), "item": item.cast(pa.string()), "value": pa.array(value, pa.int64())}) for s, item, value, part in parts)
