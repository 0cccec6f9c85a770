"""Operator 8, mixing sources to target weights by a low-discrepancy source schedule.

Documents of a source are shuffled by hash and laid end to end; the line is cut into blocks of ``block_words`` words.
Slot t of the schedule has the van der Corput point of t (its bits reversed); cumulative shares of the sources' needs
map the point to a source.  The rank of a slot among its source's slots is known in closed form: a source's interval is
a few dyadic intervals, and the slots in a dyadic interval are those with a fixed remainder modulo a power of two.  Rank
r takes block r modulo the number of blocks, in pass r // blocks; slots past a source's need are void, and the last slot
of a source takes what is left of its target.  Slots and blocks meet in an equi-join on (source, block).

Targets: the sources, by code point with null last, weigh 3, 1, 2, repeating; they share 150 % of all words; a target
stops at twice its source's words and the excess goes to the others by weight until none is above.

Defined results: a null or empty text has no words and takes nothing; null is a source of its own; a source without
words has target 0; rows that are equal in all of doc_id, source and text share what is taken; other columns, whatever
their names, are ignored.  One row for each source is read by the driver; nothing that grows with the documents is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sluicegate.llm.common import fresh, small, steps, table

#: Weights in turn, the share of all words that is taken, and how often a source may be taken.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
BLOCK_WORDS = 512
#: Parts of a source's shuffled line whose lengths are summed first.
LINE_PARTS = 4096
_BITS = 40


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: float = PASSES) -> list[float]:
    """Words to take from each source, in order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = {i for i in open_ if left * weight[i] / total > passes * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def reverse_bits(t: np.ndarray, bits: int = _BITS) -> np.ndarray:
    """The van der Corput point of t in units of 2**-bits."""
    out = np.zeros(len(t), np.int64)
    for i in range(bits):
        out |= ((t >> i) & 1) << (bits - 1 - i)
    return out


def dyadic(low: int, high: int, bits: int = _BITS) -> list[tuple[int, int]]:
    """[low, high) as (level, remainder): points of the dyadic interval are those of t = remainder modulo 2**level."""
    out = []
    while low < high:
        size = low & -low or 1 << bits
        while size > high - low:
            size >>= 1
        level = bits - size.bit_length() + 1
        prefix = low >> (bits - level) if level else 0
        out.append((level, int(f"{prefix:0{level}b}"[::-1], 2) if level else 0))
        low += size
    return out


def before(t: np.ndarray, pieces: list[tuple[int, int]]) -> np.ndarray:
    """How many slots below t have their point in the pieces."""
    total = np.zeros(len(t), np.int64)
    for level, rest in pieces:
        total += np.maximum(0, (t - rest + (1 << level) - 1) >> level)
    return total


def row_key(text: str = "text"):
    """The same for rows with the same doc_id, source and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "source", text)


class Schedule:
    """Sources' slots: need[i] of them are in use, and the first n_slots slots have at least so many of each."""

    def __init__(self, need: list[int]):
        self.need, total = need, sum(need)
        edges, so_far = [0], 0
        for n in need:
            so_far += n
            edges.append((so_far << _BITS) // max(total, 1))
        self.edges = np.array(edges, np.int64)
        self.pieces = [dyadic(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        slack = 64
        self.n_slots = total and total + slack
        while total and any(int(before(np.array([self.n_slots]), p)[0]) < n for p, n in zip(self.pieces, need, strict=True) if n):
            slack *= 2
            self.n_slots = total + slack

    def slots(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source and rank of each slot; rank -1: void."""
        source = np.searchsorted(self.edges, reverse_bits(t), side="right") - 1
        rank = np.full(len(t), -1, np.int64)
        for s in np.unique(source):
            own = source == s
            r = before(t[own], self.pieces[s])
            rank[own] = np.where(r < self.need[s], r, -1)
        return source, rank


class Mix:
    """The plan of a mix: rows (one for each document), the sources with their targets, and the slot schedule."""

    def __init__(self, docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0, text: str = "text"):
        self.spark, self.block_words = docs.sparkSession, block_words
        size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), row_key(text).alias("row"))
        self.rows = table(rows, "mix-rows").withColumn("place", F.xxhash64("row", F.lit(seed)))
        found = self.rows.groupBy("source").agg(F.sum("size").alias("words")).collect()  # a row for each source
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        words = [r["words"] for r in found]
        goal = targets(words)
        self.blocks = [-(-w // block_words) for w in words]
        take = [min(round(g), PASSES * w) for g, w in zip(goal, words, strict=True)]
        whole = [t // w if w else 0 for t, w in zip(take, words, strict=True)]
        rest = [t - q * w for t, q, w in zip(take, whole, words, strict=True)]
        self.schedule = Schedule([q * b + -(-r // block_words) for q, b, r in zip(whole, self.blocks, rest, strict=True)])
        self.last = [r % block_words for r in rest]
        sources = [(i, r["source"], w, float(g)) for i, (r, w, g) in enumerate(zip(found, words, goal, strict=True))]
        self.sources = small(self.spark.createDataFrame(sources, "s int, source string, source_size long, target double"), len(sources))

    def slots(self) -> DataFrame:
        """(slot, s, block, pass, cut): the schedule; cut is the words of the block that count, null for all."""
        plan, blocks, last = self.schedule, np.array(self.blocks or [0]), np.array(self.last or [0])
        need = np.array(plan.need or [0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = b.column("id").to_numpy()
                s, rank = plan.slots(t)
                t, s, rank = t[rank >= 0], s[rank >= 0], rank[rank >= 0]
                cut = np.where((rank == need[s] - 1) & (last[s] > 0), last[s], 0)
                columns = [pa.array(t), pa.array(s.astype(np.int32)), pa.array(rank % blocks[s]), pa.array((rank // blocks[s]).astype(np.int32)), pa.array(cut, mask=cut == 0)]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "s", "block", "pass", "cut"])

        return self.spark.range(plan.n_slots).mapInArrow(run, "slot long, s int, block long, pass int, cut long")

    def pieces(self) -> DataFrame:
        """(row, s, block, at, words): what each block holds of each document's line of words; two-level prefix sums, so
        that no task orders a whole source."""
        own = self.rows.where("size > 0").join(self.sources.select("s", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source")))
        own = own.groupBy("s", "row", "place").agg(F.sum("size").alias("size")).withColumn("part", F.pmod("place", F.lit(LINE_PARTS)).cast("int"))
        parts = own.groupBy("s", "part").agg(F.sum("size").alias("words"))
        earlier = F.sum("words").over(W.partitionBy("s").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        parts = parts.select("s", "part", F.coalesce(earlier, F.lit(0)).alias("base"))
        within = F.sum("size").over(W.partitionBy("s", "part").orderBy("place", "row").rowsBetween(W.unboundedPreceding, -1))
        start = F.col("base") + F.coalesce("within", F.lit(0))
        line = own.withColumn("within", within).join(parts, ["s", "part"]).select("s", "row", start.alias("start"), (start + F.col("size")).alias("end"))
        b = F.lit(self.block_words)
        cut = line.withColumn("block", F.expr(f"explode(sequence(start div {self.block_words}, (end - 1) div {self.block_words}))"))
        low, high = F.greatest("start", F.col("block") * b), F.least("end", (F.col("block") + 1) * b)
        return cut.select("s", "row", "block", (low - F.col("block") * b).alias("at"), (high - low).alias("words"))

    def taken(self) -> DataFrame:
        """(row, taken): words that the mix takes of each document with words."""
        met = self.pieces().join(self.slots(), ["s", "block"])
        words = F.greatest(F.lit(0), F.least(F.col("words"), F.coalesce("cut", F.lit(self.block_words)) - F.col("at")))
        return met.groupBy("row").agg(F.sum(words).cast("long").alias("taken"))

    def by_row(self) -> DataFrame:
        """(row, taken, n): as taken(), for every row key, with the number of equal rows that share it."""
        every = self.rows.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
        return every.join(self.taken(), "row", "left").select("row", "n", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))

    def result(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken), a row for each document."""
        met = shared_out(self.rows.join(table(self.by_row(), "mix-taken"), "row"), "row")
        rows = met.join(self.sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        return rows.select("doc_id", "size", "source_size", "target", "taken")


def shared_out(rows: DataFrame, key: str, taken: str = "taken", n: str = "n") -> DataFrame:
    """rows, each with its own part of what the n rows of its key take together; the first ones take one word more.

    Only rows that do not share evenly are numbered, in a written table: within its partitions, and the partitions' counts
    then give the places, so that no task holds all rows of a key.
    """
    odd = (F.col(n) > 1) & (F.col(taken) % F.col(n) > 0)
    share = F.expr(f"`{taken}` div `{n}`")
    if rows.where(odd).isEmpty():
        return rows.withColumn(taken, share)
    uid, part, nth, base = (fresh(rows, c) for c in ("mix_uid", "mix_part", "mix_nth", "mix_base"))
    own = table(rows.where(odd).withColumn(uid, F.monotonically_increasing_id()), "mix-shared").withColumn(part, F.shiftright(uid, 33))
    earlier = F.sum("count").over(W.partitionBy(key).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    bases = own.groupBy(key, part).count().select(key, part, F.coalesce(earlier, F.lit(0)).alias(base))
    own = own.withColumn(nth, F.row_number().over(W.partitionBy(key, part).orderBy(uid))).join(bases, [key, part])
    own = own.withColumn(taken, (share + F.when(F.col(nth) + F.col(base) <= F.col(taken) % F.col(n), 1).otherwise(0)).cast("long"))
    return rows.where(~odd).withColumn(taken, share).unionByName(own.select(rows.columns))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix as rows of docs: a document comes once for each whole time that it is taken, and once more, cut after as
    many words, if a part is left.  n_chars follows the text.  Documents that aren't taken go; so do texts without words.
    Rows that are equal in doc_id, source and text share what is taken of them.
    """
    mix = Mix(docs, block_words, seed)
    key, own, n = fresh(docs, "mix_row"), fresh(docs, "mix_taken"), fresh(docs, "mix_n")
    taken = table(mix.by_row().select(F.col("row").alias(key), F.col("taken").alias(own), F.col("n").alias(n)).where(F.col(own) > 0), "mix-taken")
    rows = shared_out(docs.withColumn(key, row_key()).join(small(taken, taken.count()), key), key, own, n)
    columns, schema = docs.columns, docs.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            pick, whole = [], []
            for i, (t, words) in enumerate(zip(texts, b.column(own).to_pylist(), strict=True)):
                raw = t.encode()
                size = len(raw.split()) if words else 0
                if not size:
                    continue
                pick += [i] * (words // size)
                whole += [t] * (words // size)
                if words % size:
                    # split() at the next white space leaves the rest as one last part
                    rest = raw.split(None, words % size)[-1]
                    pick.append(i)
                    whole.append(raw[: len(raw) - len(rest)].rstrip(b" \t\n\r\x0b\x0c").decode() if words % size < size else t)
            took = b.take(pa.array(pick, pa.int64()))
            made = {"text": pa.array(whole, pa.string()), "n_chars": pa.array([len(t) for t in whole], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made and (c == "text" or "n_chars" in columns) else took.column(c) for c in columns], columns)

    return rows.select(*columns, own).mapInArrow(run, out)
