"""Operator 10, substring dedup by collinear chaining.

1. Seeds: minimizers of the hashes of ``k`` consecutive words (the least of ``window`` neighbours), so that two texts
   with an equal run of k + window - 1 words share a seed.
2. Every occurrence of a seed is matched with the seed's first occurrence over all documents (the smallest doc_id) and
   with that of the next smaller doc_id that has it.  That is at most two matches for an occurrence, however many
   documents share it; no pairs within a group are made.  A seed that one step of a task meets often is matched there,
   and only its first holder in the step is matched with those of other steps, so that a passage of very many documents
   reaches its one task as a row for each step.
3. Matches of a document with another are joined to runs on a diagonal and chained by a Fenwick tree over the other
   document's positions: the best chain that ends in a run is its length plus the best earlier chain less the gap cost,
   which is linear in both gaps and so can be kept in the tree.
4. Shared seeds that lie in no passage found so are met once more in pairs, 16 to 56 words apart, as parts of a passage may
   have holders of their own that stand between it and the document that has it whole.
5. Chains are aligned on the words of both documents: gaps by longest common subsequence, ends along the diagonal or,
   where a shifted diagonal agrees, by subsequence too.  Stretches with an equal word in at least ``share`` of the
   columns and at least ``least`` words in either document, which no longer such stretch holds, are the passages.
6. Windows of ``least`` words that lie in no passage of their document are looked up as a whole and met with the first
   document that has them; runs of them that cover all their words are aligned like chains.  So every window of least
   words that an earlier document has lies among reported words, whatever holders its seeds met.

A passage of a document is thus reported against an earlier document that has it.  Fuzzy passages are found if their
seeds' holders name the other document and their runs hold ``SCORE`` words; README has the recall.

Defined results: words are maximal runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; null, empty and short texts
have no passage; rows with null doc_id are passed over; equal rows count as one document; rows with one doc_id and
different texts are documents of their own, one after the other in the order of their texts' hashes; repeats within a document alone are not passages; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from sluicegate.llm.common import Words, fresh, mix, picked, steps, table, trimmed, windows

#: Words of a seed, neighbours of a minimizer.
K, WINDOW = 5, 6
#: Words of a passage, share of equal words.
LEAST, SHARE = 50, 0.8
#: Cost of a skipped word in a chain; words on one diagonal that a run may skip; words looked at beyond a chain's ends.
GAP_COST, RUN_GAP, MARGIN = 0.1, 24, 64
#: Words by which a passage may go on beyond its outer seeds.
REACH = 32
#: Words between two seeds that are met as a pair, least and most.
NEAR, FAR = 16, 56
#: Occurrences of a seed in one step of a task for which it is met there.
OFTEN = 8
#: Equal words on a shifted diagonal for which an end is aligned.
SHIFTED = 3
#: Pairs of words that an alignment holds at once; words around the diagonal that it looks at beyond that.
CELLS, BAND = 1 << 20, 256
#: Words that the runs of a chain must hold: one seed alone is no candidate, two are.
SCORE = 8
#: Chains that meet one copy of an other document's words in a task.
MEMBERS = 128
#: Numbers that rows with arrays (stretches, roles of chains) may hold, all together, to be broadcast.
BROADCAST_NUMBERS = 50_000
#: Places of the bitmap of ids that leaves out texts before an exchange: 2 MB, whatever the input.
BITS = 1 << 24
#: Stands for the gap of a text's first minimizer.
FIRST = 127
#: Parts by whose number hashes are exchanged, a power of two; rows of whole parts that a task sorts at once, at least.
PARTS, SORTED = 1 << 12, 1 << 17
#: Rows of a step that makes pairs of seeds, or of a document that has more.
PAIRED = 10_000
#: Types of the columns of an entry, which holds a step's rows of one part.
KINDS = {"seed": "<i8", "doc": "<i8", "pos": "<i4", "gap": "<i1", "other": "<i8", "diagonal": "<i8", "n": "<i4"}

_FACTOR = np.uint64(0x9FB21C651E98DF25)


def spanned(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive ones from each place on, by doubling; the last n - 1 places wrap round and mean nothing."""
    base, power, size, total, done = hashes, np.array([_FACTOR]), 1, np.zeros(len(hashes), np.uint64), 0
    while size <= n:
        if n & size:
            total = total * power + np.roll(base, -done)
            done += size
        base, power, size = base * power + np.roll(base, -size), power * power, 2 * size
    return mix(total)


def entries(key: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows as entries (part, and columns of KINDS as bytes), one for each part that the hashes in key fall into."""
    part = (key.view(np.uint64) >> np.uint64(65 - PARTS.bit_length())).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    part = part[order]
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(start, len(part))

    def packed(x: np.ndarray | None, kind: np.dtype) -> pa.Array:
        size, data = (0, b"") if x is None else (kind.itemsize, np.ascontiguousarray(x[order], kind))
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((ends * size).astype(np.int32)), pa.py_buffer(data)])

    return pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int32)), *(packed(columns.get(c), np.dtype(kind)) for c, kind in KINDS.items())], ["part", *KINDS])


#: The schema of entries.
ENTRIES = ", ".join(["part int", *(f"{c} binary" for c in KINDS)])


def _unpacked(b: pa.RecordBatch, names: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of the rows of entries, and how many rows are in each entry."""
    out = []
    for c in names:
        column, kind = b.column(c).cast(pa.binary()), np.dtype(KINDS[c])
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        n = int(ends[-1] - ends[0]) // kind.itemsize
        out.append(np.frombuffer(column.buffers()[2], kind, n, int(ends[0])) if n else np.zeros(0, kind))
    return out, np.diff(ends) // kind.itemsize


def _parts(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], least: int = SORTED) -> Iterator[np.ndarray | pa.RecordBatch]:
    """The rows of entries that come sorted by part, as many whole parts at once as have least rows.  If seed is asked for,
    entries without seeds, which were met where they were found, come as they are."""
    waits, n, last = [], 0, None
    for b in batches:
        if "seed" in names:
            seeded = pc.greater(pc.binary_length(b.column("seed")), 0)
            if (done := b.filter(pc.invert(seeded))).num_rows:
                yield done
                b = b.filter(seeded)
        if not b.num_rows:
            continue
        columns, count = _unpacked(b, names)
        rows, part = np.column_stack([x.astype(np.int64) for x in columns]), b.column("part").to_numpy()
        if part[-1] != last:
            done = int(count[: np.searchsorted(part, part[-1])].sum())
            waits.append(rows[:done])
            if n + done >= least:
                yield np.concatenate(waits)
                waits, n = [], 0
            else:
                n += done
            rows, last = rows[done:], part[-1]
        waits.append(rows)
        n += len(rows)
    if n:
        yield np.concatenate(waits)


def _repeated(rows: np.ndarray) -> np.ndarray:
    """The rows (seed, doc, pos, ...) whose seed occurs more than once, sorted."""
    order = np.argsort(rows[:, 0])
    same = rows[order[1:], 0] == rows[order[:-1], 0]
    rows = rows[order[np.append(same, False) | np.append(False, same)]]
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def seeds(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Entries of (seed, doc, pos, gap): minimizers of each whole text; gap is the step from the text's minimizer before, FIRST
    for its first one.  And, where a step meets a seed often, entries without seed or gap of matches (doc, other, diagonal,
    pos), and with other and gap of shared seeds, as _matches gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = Words(b.column("text"))
            h, row = windows(w, w.hashes(), k)
            if not len(h):
                continue
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            # windows do not reach over a row's end; a row with fewer hashes than a window has one window
            size = np.diff(first)
            chosen = np.zeros(len(h), bool)
            if (m := len(h) - window + 1) > 0:
                best, low = np.full(m, window - 1), h[window - 1 :].copy()
                for j in range(window - 2, -1, -1):  # of equal ones the first
                    np.copyto(best, j, where=h[j : j + m] <= low)
                    np.minimum(low, h[j : j + m], out=low)
                best += np.arange(m)
                chosen[best[row[:m] == row[window - 1 :]]] = True
            few = np.flatnonzero((size > 0) & (size < window))
            chosen[[first[i] + int(h[first[i] : first[i + 1]].argmin()) for i in few.tolist()]] = True
            chosen = np.flatnonzero(chosen)
            doc = b.column("doc_id").to_numpy(zero_copy_only=False)
            gap = np.where(np.append(True, row[chosen[1:]] != row[chosen[:-1]]), FIRST, np.diff(chosen, prepend=0))
            found = np.column_stack([h[chosen].view(np.int64), doc[row[chosen]].astype(np.int64), chosen - first[row[chosen]], gap])
            order = np.argsort(found[:, 0])
            at = np.flatnonzero(np.append(True, np.diff(found[order, 0]) != 0))
            times = np.diff(np.append(at, len(order)))
            often = np.repeat(times >= OFTEN, times)
            rows = found[order[often]]
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            first, i, other, several = _meet(rows)
            lead = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)) if len(rows) else first
            left = np.concatenate([found[order[~often]], rows[first & (lead | ~several)]])
            yield entries(left[:, 0], seed=left[:, 0], doc=left[:, 1], pos=left[:, 2], gap=left[:, 3])
            if several.any():
                yield _met(rows[i], rows[other])
                yield _shared(rows[several], _holders(rows)[several], True)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return named.mapInArrow(trimmed(run), ENTRIES)


def _met(rows: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """Rows (seed, doc, pos, ...) and the rows that they are met with, as entries of (doc, other, diagonal, pos)."""
    return entries(mix(rows[:, 1].astype(np.uint64)), doc=rows[:, 1], pos=rows[:, 2], other=other[:, 1], diagonal=rows[:, 2] - other[:, 2])


def _shared(rows: np.ndarray, holders: np.ndarray, crowded: np.ndarray | bool) -> pa.RecordBatch:
    """Rows (seed, doc, pos, gap) of seeds that several documents hold, as entries of them and of a hash of their holders."""
    return entries(mix(rows[:, 1].astype(np.uint64)), doc=rows[:, 1], pos=rows[:, 2], gap=rows[:, 3], other=holders, diagonal=rows[:, 0] & -2 | crowded)


def _meet(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (seed, doc, pos, gap) in this order: which are of their seed's first holder; the pairs (row, other row) of
    occurrences with the first holder and the one before; which rows' seeds several documents hold."""
    if not len(rows):
        none = np.zeros(0, np.int64)
        return none.astype(bool), none, none, none.astype(bool)
    seed, doc = rows[:, 0], rows[:, 1]
    new_seed = np.append(True, seed[1:] != seed[:-1])
    holder = np.cumsum(new_seed | np.append(True, doc[1:] != doc[:-1])) - 1
    at = np.flatnonzero(np.append(True, np.diff(holder) != 0))
    start = np.flatnonzero(new_seed)
    group = np.cumsum(new_seed) - 1
    first = holder[start][group]
    a, c = np.flatnonzero(holder > first), np.flatnonzero(holder > first + 1)
    last = holder[np.append(start[1:], len(rows)) - 1][group]
    return holder == first, np.concatenate([a, c]), at[np.concatenate([first[a], holder[c] - 1])], last > first


def _holders(rows: np.ndarray) -> np.ndarray:
    """For each of rows (seed, doc, pos, gap) in this order: a hash of its seed's first holder and of the one before its own
    document."""
    if not len(rows):
        return np.zeros(0, np.int64)
    seed, doc = rows[:, 0], rows[:, 1]
    new_seed = np.append(True, seed[1:] != seed[:-1])
    new_doc = new_seed | np.append(True, doc[1:] != doc[:-1])
    holder, at = np.cumsum(new_doc) - 1, np.flatnonzero(new_doc)
    first = holder[np.flatnonzero(new_seed)][np.cumsum(new_seed) - 1]
    before = np.maximum(holder - 1, first)
    return mix(doc[at[first]].view(np.uint64) * _FACTOR + doc[at[before]].view(np.uint64)).view(np.int64)


def _matches(found: DataFrame) -> DataFrame:
    """Entries, by document, of (doc, other, diagonal, pos): occurrences of seeds met with the first holder and the one before.
    And with gap too, each occurrence of a seed that several documents hold: other is a hash of the two that it met, and
    diagonal the seed, whose last bit says that three documents hold it (or that a step met it often).

    A seed that a step of a task meets often is met there, and only its first holder in the step goes on.  Seeds come in
    entries of a part of all seeds, sorted by part; a part's rows are sorted and met here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, ("seed", "doc", "pos", "gap")):
            if isinstance(rows, pa.RecordBatch):
                yield rows
                continue
            rows = _repeated(rows)
            _, i, other, several = _meet(rows)
            if not several.any():
                continue
            yield _met(rows[i], rows[other])
            start = np.append(True, rows[1:, 0] != rows[:-1, 0])
            holder = start | np.append(True, rows[1:, 1] != rows[:-1, 1])
            crowded = np.add.reduceat(holder, np.flatnonzero(start), dtype=np.int64)[np.cumsum(start) - 1] > 2
            yield _shared(rows[several], _holders(rows)[several], crowded[several])

    return found.mapInArrow(trimmed(run), ENTRIES)


def _by_document(found: DataFrame) -> DataFrame:
    """Entries by document, those of a part beside each other."""
    return found.repartition("part").sortWithinPartitions("part")


def _stretches(shared: DataFrame, k: int, window: int, least: int) -> DataFrame:
    """(id, low, high): starts low to high - 1 of the windows of least words that may be repeated as a whole.

    The minimizers at s + window - 1 to s + least - k - window + 1 of a window that starts at s depend on its words alone,
    so all of them are shared if the window is: no start within reach of an unshared minimizer is left in, and no
    repeated window left out.
    """
    front, back = window - 1, least - k - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: np.ndarray) -> pa.RecordBatch:
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            doc, pos, gap = rows.T
            new = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] - gap[1:] > pos[:-1]) | (gap[1:] == FIRST))
            at = np.flatnonzero(new)
            last = pos[np.append(at[1:], len(pos)) - 1]
            # the unshared minimizer before lies at pos - gap, the one behind at last + window at the furthest
            low = np.where(gap[at] == FIRST, 0, np.maximum(pos[at] - gap[at] - front + 1, 0))
            high = last + window - back
            keep = high > low
            frame = pa.table([doc[at][keep], low[keep], high[keep]], ["id", "low", "high"]).group_by("id").aggregate([("low", "list"), ("high", "list")])
            kind = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([frame.column("id").combine_chunks(), frame.column("low_list").combine_chunks().cast(kind), frame.column("high_list").combine_chunks().cast(kind)], ["id", "low", "high"])

        for rows in _parts(batches, ("doc", "pos", "gap")):
            yield of(rows)

    return _by_document(shared.select("part", "doc", "pos", "gap")).mapInArrow(trimmed(run), "id long, low array<int>, high array<int>")


def _apart(shared: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Entries, by document, of (doc, other, diagonal, pos): pairs of shared seeds of one document, NEAR to FAR words apart, met with the first holder
    of the same pair and the one before, at both seeds.

    Parts of a passage may have holders of their own, which are all that its seeds meet; of a pair that spans two parts
    they are none.  So the earlier seed of a pair is one that three documents hold at least, and the two have met different
    holders; the seeds of one common line have met the same ones and make no pairs.  Nor do seeds that both lie in found
    passages of their document.  All other pairs are met.
    """

    def of(rows: np.ndarray) -> np.ndarray:
        doc, pos, seed, end, holders = rows.T
        known = end >= 0
        # how far the known passages that begin at or before a place reach; documents are told apart by a shift
        base = np.cumsum(np.append(False, doc[1:] != doc[:-1])) * (int(max(pos.max(), end.max())) + 1)
        reach = np.maximum.accumulate(np.where(known, end + base, 0))
        inside = reach >= pos + base + k
        at = np.flatnonzero(~known)
        place, inside, crowded = (pos + base)[at], inside[at], seed[at] & 1 == 1
        seed = seed[at] & -2
        low = np.searchsorted(place, place + NEAR)
        n = np.searchsorted(place, place + FAR, side="right") - low
        n[~crowded] = 0
        i = np.repeat(np.arange(len(at)), n)
        j = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(i)) if len(i) else i
        own = (doc[at][i] == doc[at][j]) & (holders[at][i] != holders[at][j]) & ~(inside[i] & inside[j])
        i, j = i[own], j[own]
        both = mix(seed[i].view(np.uint64) * _FACTOR + seed[j].view(np.uint64)).view(np.int64)
        return np.column_stack([both, doc[at][i], pos[at][i], pos[at][j] - pos[at][i]])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs, those that several rows of this step have already met here."""
            made = of(rows)
            if not len(made):
                return
            made = made[np.lexsort((made[:, 2], made[:, 1], made[:, 0]))]
            start = np.flatnonzero(np.append(True, made[1:, 0] != made[:-1, 0]))
            times = np.diff(np.append(start, len(made)))
            often = np.repeat(times >= OFTEN, times)
            rows = made[often]
            first, i, other, _ = _meet(rows)
            lead = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)) if len(rows) else first
            yield sent(np.concatenate([made[~often], rows[first & lead]]))
            yield sent(rows[i], rows[other])

        for rows in _parts(batches, ("doc", "pos", "diagonal", "gap", "other")):
            known = rows[:, 3] < 0
            rows = np.column_stack([rows[:, :2], np.where(known, 0, rows[:, 2]), np.where(known, rows[:, 2], -1), rows[:, 4]])
            rows = rows[np.lexsort((-rows[:, 3], rows[:, 1], rows[:, 0]))]
            start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            for one in np.split(rows, start[1:][np.diff(start // PAIRED) > 0]):
                yield from out(one)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Found passages as entries: their gap is -1 and their diagonal the end."""
        for b in batches:
            doc, start, end = (b.column(c).to_numpy() for c in ("doc_id", "start", "end"))
            yield entries(mix(doc.astype(np.uint64)), doc=doc, pos=start, diagonal=end, gap=np.full(len(doc), -1), other=np.zeros(len(doc), np.int64))

    def sent(rows: np.ndarray, other: np.ndarray | None = None) -> pa.RecordBatch:
        """Pairs to be met or, with other rows, met ones."""
        none = pa.nulls(len(rows), pa.int64())
        key, with_, there, far = (pa.array(rows[:, 0]), none, none, none) if other is None else (none, *(pa.array(other[:, c]) for c in (1, 2, 3)))
        return pa.RecordBatch.from_arrays([key, *(pa.array(rows[:, c]) for c in (1, 2, 3)), with_, there, far], ["seed", "doc", "pos", "gap", "other", "there", "far"])

    def matches(rows: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        """Rows and other rows (doc, pos, gap) as matches at both seeds."""
        doc, pos, gap = np.tile(rows[:, 0], 2), np.append(rows[:, 1], rows[:, 1] + rows[:, 2]), np.append(other[:, 1], other[:, 1] + other[:, 2])
        return entries(mix(doc.astype(np.uint64)), doc=doc, pos=pos, other=np.tile(other[:, 0], 2), diagonal=pos - gap)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)  # of the last pair: its first holder, its last one and the one before
        for b in batches:
            if b.column("seed").null_count:
                done = b.filter(pc.is_null(b.column("seed")))
                own, other = (np.column_stack([done.column(c).to_numpy() for c in names]) for names in (("doc", "pos", "gap"), ("other", "there", "far")))
                yield matches(own, other)
                b = b.filter(pc.is_valid(b.column("seed")))
            new = np.column_stack([b.column(c).to_numpy() for c in ("seed", "doc", "pos", "gap")])
            if not len(new):
                continue
            rows = np.concatenate([held, new])
            _, i, other, _ = _meet(rows)
            i, other = i[i >= len(held)], other[i >= len(held)]
            if len(i):
                yield matches(rows[i, 1:], rows[other, 1:])
            last = np.flatnonzero(rows[:, 0] == rows[-1, 0])
            heads = last[np.append(True, rows[last[1:], 1] != rows[last[:-1], 1])]
            held = rows[sorted({heads[0], *heads[-2:]})]

    asked = shared.unionByName(found.select("doc_id", "start", "end").distinct().mapInArrow(trimmed(passed), ENTRIES)).select("part", "doc", "pos", "diagonal", "gap", "other")
    pairs = _by_document(asked).mapInArrow(trimmed(pair), "seed long, doc long, pos long, gap long, other long, there long, far long")
    pairs = pairs.repartition(F.coalesce("seed", F.xxhash64("doc", "pos"))).sortWithinPartitions("seed", "doc", "pos")
    return pairs.mapInArrow(trimmed(meet), ENTRIES)


def _whole(docs: DataFrame, stretches: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(doc, other, diagonal, pos, n): runs of n windows of least words of the stretches that lie in no found passage of
    their document, met with the first document that has them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = Words(b.column("text"))
            h = spanned(w.hashes(), least)
            n = np.diff(w.first)
            at, doc, pos, asks = [], [], [], []
            for i, (name, low, high) in enumerate(zip(b.column("id").to_pylist(), b.column("low").to_pylist(), b.column("high").to_pylist(), strict=True)):
                last, done = int(n[i]) - least + 1, 0
                known = np.array([(x["start"], x["end"]) for x in b.column("known")[i].as_py() or ()], np.int64).reshape(-1, 2)
                known = known[known[:, 0].argsort()]
                reach = np.append(0, np.maximum.accumulate(known[:, 1]))  # of the passages that start at or before a place
                for s, e in zip(low, high, strict=True):
                    s, e = max(s, done), min(e, last)
                    if e > s:
                        pos.append(np.arange(s, e, dtype=np.int32))
                        at.append(pos[-1] + w.first[i])
                        doc.append(np.full(e - s, name, np.int64))
                        asks.append(reach[np.searchsorted(known[:, 0], pos[-1], side="right")] < pos[-1] + least)
                        done = e
            if at:
                rows = np.column_stack([h[np.concatenate(at)].view(np.int64), np.concatenate(doc), np.concatenate(pos), np.concatenate(asks)])
                rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
                first, i, other = met_first(rows)
                # of the windows of a step, the first holder's go on
                yield entries(rows[first, 0], seed=rows[first, 0], doc=rows[first, 1], pos=rows[first, 2], gap=rows[first, 3])
                if len(i):
                    doc, other, diagonal, pos, m = _needed(rows[i, 1], rows[other, 1], rows[i, 2] - rows[other, 2], rows[i, 2], np.ones(len(i), np.int64), least)
                    yield entries(mix(doc.astype(np.uint64)), doc=doc, pos=pos, other=other, diagonal=diagonal, n=m)

    met = ("doc", "other", "diagonal", "pos", "n")

    def met_first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted rows, the first of each seed, and (row, first row) of those of other documents that ask."""
        start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        first = np.repeat(start, np.diff(np.append(start, len(rows))))
        i = np.flatnonzero((rows[:, 1] != rows[first, 1]) & (rows[:, 3] > 0))
        return start, i, first[i]

    def sent(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c == "pos" else pa.int64()) for c, x in zip(met, rows, strict=True)], list(met))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, ("seed", "doc", "pos", "gap")):
            if isinstance(rows, pa.RecordBatch):
                yield sent(_unpacked(rows, met)[0])
                continue
            rows = _repeated(rows)
            _, i, other = met_first(rows)
            if len(i):
                yield sent([rows[i, 1], rows[other, 1], rows[i, 2] - rows[other, 2], rows[i, 2], np.ones(len(i), np.int64)])

    # rows that share a doc_id have their stretches listed together
    known = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("known")).withColumnRenamed("doc_id", "id")
    rows = table(stretches.join(known.hint("merge"), "id", "left"), "stretches")
    weight = rows.agg(F.sum(F.lit(2) + 2 * F.size("low") + 2 * F.coalesce(F.size("known"), F.lit(0)))).first()[0] or 0
    texts = _texts_of(docs, rows, weight)
    windows = texts.select("id", "low", "high", "known", "text").mapInArrow(trimmed(cut), ENTRIES)
    return windows.repartition("part").sortWithinPartitions("part").mapInArrow(trimmed(meet), "doc long, other long, diagonal long, pos int, n long")


def _runs(doc: np.ndarray, other: np.ndarray, diagonal: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows, those joined that follow each other on one diagonal; sorted."""
    order = np.lexsort((pos, diagonal, other, doc))
    doc, other, diagonal, pos, n = (x[order] for x in (doc, other, diagonal, pos, n))
    new = np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] > pos[:-1] + n[:-1]))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(pos)) - 1
    return doc[at], other[at], diagonal[at], pos[at], pos[last] + n[last] - pos[at]


def cover(start: np.ndarray, end: np.ndarray) -> list[int]:
    """Places of spans, sorted by start, that together cover all words of all of them; none can be left out."""
    out, reached, best, at = [], -1, -1, 0
    while at < len(start):
        if start[at] > reached:  # the best so far is needed to go on, or a new stretch begins
            if best >= 0 and end[best] > reached:
                out.append(best)
                reached, best = int(end[best]), -1
                continue
            best, reached = -1, int(start[at])
        if best < 0 or end[at] > end[best]:
            best = at
        at += 1
    if best >= 0 and end[best] > reached:
        out.append(best)
    return out


def _needed(doc: np.ndarray, other: np.ndarray, diagonal: np.ndarray, pos: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """The runs of windows of least words, as many as cover all words of each document's windows."""
    doc, other, diagonal, pos, n = _runs(doc, other, diagonal, pos, n)
    end = pos + n - 1 + least
    order = np.lexsort((pos, doc))
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    kept = np.concatenate([own[cover(pos[own], end[own])] for own in np.split(order, cuts)])
    return doc[kept], other[kept], diagonal[kept], pos[kept], n[kept]


def _texts_of(docs: DataFrame, rows: DataFrame, weight: int) -> DataFrame:
    """rows (with an id) beside their documents' texts.  weight: the numbers in rows.

    Few rows are broadcast.  Else both sides are exchanged, after the texts that surely have no row are left out: those
    whose id falls on an empty place of a bitmap of BITS ids, whatever their number.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    if weight <= BROADCAST_NUMBERS:
        return texts.join(F.broadcast(rows), "id")

    place = F.pmod(F.xxhash64("id"), F.lit(BITS))
    parts = rows.select(place.alias("place")).withColumn("word", F.expr("place div 64")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    parts = parts.groupBy(F.expr(f"word div {BITS // 64 // 64}")).agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    whole = np.zeros(BITS // 64, np.int64)
    for r in parts.toLocalIterator():  # BITS bits in all
        at, bits = zip(*r["words"], strict=True)
        whole[list(at)] = bits
    shared = docs.sparkSession.sparkContext.broadcast(whole)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            at = b.column("place").to_numpy()
            yield b.filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1)).select(["id", "text"])

    some = texts.withColumn("place", place).mapInArrow(trimmed(likely), "id long, text string")
    return some.join(rows.hint("merge"), "id")


def _covering(met: DataFrame, least: int) -> DataFrame:
    """(doc, other, p, q, n): runs of met windows of least words on one diagonal, as many as cover all words of the
    windows; each is a chain of its own.  Rows come sorted by doc and pos."""

    def of(rows: np.ndarray) -> pa.RecordBatch:
        doc, other, diagonal, start, n = _needed(*rows.T, least)
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32)), pa.array(x.astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(other), lists(start), lists(start - diagonal), lists(n - 1 + least)], ["doc", "other", "p", "q", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)
        for b in batches:
            rows = np.concatenate([held, np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in ("doc", "other", "diagonal", "pos", "n")])])
            cut = np.flatnonzero(rows[1:, 0] != rows[:-1, 0])
            cut = int(cut[-1]) + 1 if len(cut) else 0
            held = rows[cut:]
            if cut:
                yield of(rows[:cut])
        if len(held):
            yield of(held)

    return met.mapInArrow(trimmed(run), "doc long, other long, p array<int>, q array<int>, n array<int>")


class Fenwick:
    """Greatest value over a prefix, with the index that has it."""

    def __init__(self, n: int):
        self.value, self.index = [-1e300] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, value: float, index: int) -> None:
        i += 1
        while i < len(self.value):
            if value > self.value[i]:
                self.value[i], self.index[i] = value, index
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Over places below i."""
        value, index = -1e300, -1
        while i:
            if self.value[i] > value:
                value, index = self.value[i], self.index[i]
            i -= i & -i
        return value, index


def chains(runs: list[tuple[int, int, int]], gap: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of runs (p, q, words), best first; a run is in one chain at most, and a chain ends where the next
    run is taken already."""
    runs = sorted(runs)
    places = {q: i for i, q in enumerate(sorted({q for _, q, _ in runs}))}
    tree, score, back = Fenwick(len(places)), [], []
    at = 0
    for i, (p, q, n) in enumerate(runs):
        while runs[at][0] < p:  # runs with the same p do not follow each other
            x, y, m = runs[at]
            tree.put(places[y], score[at] + gap * (x + y + 2 * m), at)
            at += 1
        value, index = tree.best(places[q])
        value -= gap * (p + q)
        score.append(n + max(0.0, value))
        back.append(index if value > 0 else -1)
    out, used = [], set()
    for i in sorted(range(len(runs)), key=score.__getitem__, reverse=True):
        chain = []
        while i >= 0 and i not in used:
            chain.append(i)
            used.add(i)
            i = back[i]
        if chain:
            out.append([runs[j] for j in reversed(chain)])
    return out


def _chained(met: DataFrame, k: int, least: int) -> DataFrame:
    """(doc, other, p, q, n): a row for each chain that could hold a passage, with its runs as arrays."""
    schema = "doc long, other long, p array<int>, q array<int>, n array<int>"

    def of(rows: np.ndarray, out: list) -> None:
        doc, other, diagonal, pos = rows.T
        pair = np.append(True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]))
        new = pair | np.append(True, (diagonal[1:] != diagonal[:-1]) | (pos[1:] - pos[:-1] > RUN_GAP))
        at = np.flatnonzero(new)
        p, end = pos[at], pos[np.append(at[1:], len(pos)) - 1] + k
        q, n = p - diagonal[at], end - p
        starts = np.flatnonzero(pair[at])
        ends = np.append(starts[1:], len(at))
        # a chain of fewer words than SCORE is no candidate, so neither is a pair with fewer words in all its runs
        wide = np.add.reduceat(n, starts) >= SCORE
        for s, e in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            runs = list(zip(p[s:e].tolist(), q[s:e].tolist(), n[s:e].tolist(), strict=True))
            for chain in chains(runs) if len(runs) > 1 else [runs]:
                if sum(r[2] for r in chain) >= SCORE and chain[-1][0] + chain[-1][2] - chain[0][0] + 2 * REACH >= least:
                    out.append((int(doc[at[s]]), int(other[at[s]]), *map(list, zip(*chain, strict=True))))
                    # a long run that the run before overlaps would lose its beginning: it also stands alone
                    for x, r in zip(chain, chain[1:]):
                        if r[2] >= least and (x[0] + x[2] > r[0] or x[1] + x[2] > r[1]):
                            out.append((int(doc[at[s]]), int(other[at[s]]), *([v] for v in r)))

    def emit(out: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc", "other", "p", "q", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches, ("doc", "other", "diagonal", "pos")):
            out = []
            of(rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))], out)
            if out:
                yield emit(out)

    return _by_document(met.select("part", "doc", "other", "diagonal", "pos")).mapInArrow(trimmed(run), schema)


def _common(a: np.ndarray, b: np.ndarray, band: int | None = None) -> list[tuple[int, int]]:
    """Equal words (i, j) of a longest common subsequence of two stretches; with band, of those that stay within as many
    words of the line between the stretches' corners."""
    n, m = len(a), len(b)
    half = m if band is None else min(m, band + abs(m - n))
    centre = np.round(np.arange(n + 1) * (m / n)).astype(np.int64)
    low, high = np.maximum(centre - half, 0), np.minimum(centre + half, m)
    rows = [np.zeros(high[0] - low[0] + 1, np.int32)]
    for i in range(n):  # lengths of row i + 1 at columns low..high; columns outside the band don't count
        before = np.zeros(high[i + 1] - low[i + 1] + 2, np.int32)  # row i from column low - 1 on
        s, e = max(low[i], low[i + 1] - 1), min(high[i], high[i + 1])
        if e >= s:
            before[s - low[i + 1] + 1 : e - low[i + 1] + 2] = rows[i][s - low[i] : e - low[i] + 1]
        row = before[1:].copy()
        first = max(low[i + 1], 1)
        at = first - low[i + 1]
        row[at:] = np.maximum(row[at:], before[at : len(row)] + (b[first - 1 : high[i + 1]] == a[i]))
        rows.append(np.maximum.accumulate(row))
    value = lambda i, j: int(rows[i][j - low[i]]) if low[i] <= j <= high[i] else -1
    i, j, out = n, m, []
    while i and j:
        here = value(i, j)
        if a[i - 1] == b[j - 1] and here == max(value(i - 1, j - 1), 0) + 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif value(i - 1, j) == here:
            i -= 1
        else:
            j -= 1
            if j < low[i]:
                i -= 1
                j = min(j, int(high[i])) if i >= 0 else j
    return out[::-1]


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    ends, places, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(ends, v)
        back[i] = places[k - 1] if k else -1
        if k == len(ends):
            ends.append(v)
            places.append(i)
        else:
            ends[k], places[k] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _gap(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> list[tuple[int, int]]:
    """Equal words (i, j) of an alignment of two stretches: a longest common subsequence up to cells pairs of words;
    beyond, words that occur once in either part them, and parts without such words are aligned in a band."""
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n * m <= cells:
        i, j = np.nonzero(a[:, None] == b[None, :])
        if len(i) > 16 * (n + m):  # few different words
            return _common(a, b)
        # a common subsequence is one of increasing j over pairs in the order of i; of one i, the greatest j comes first
        order = np.lexsort((-j, i))
        i, j = i[order].tolist(), j[order].tolist()
        return [(i[k], j[k]) for k in _increasing(j)]
    once_a, at_a, many_a = np.unique(a, return_index=True, return_counts=True)
    once_b, at_b, many_b = np.unique(b, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(once_a[many_a == 1], once_b[many_b == 1], assume_unique=True, return_indices=True)
    i, j = at_a[many_a == 1][i], at_b[many_b == 1][j]
    order = np.argsort(i)
    i, j = i[order].tolist(), j[order].tolist()
    anchors = [(i[k], j[k]) for k in _increasing(j)]
    if not anchors:
        return _common(a, b, BAND)
    out, x, y = [], 0, 0
    for p, q in [*anchors, (n, m)]:
        out += [(x + i, y + j) for i, j in _gap(a[x:p], b[y:q], cells)]
        if p < n:
            out.append((p, q))
        x, y = p + 1, q + 1
    return out


def stretches(at: np.ndarray, partner: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """(first, last) equal words of the stretches of an alignment that have at least least words in either text and an
    equal word in at least share of their columns, and that lie in no other such stretch.

    A stretch is then cut back to its part of the highest score, an equal word counting 1/2 and any other column -1/2,
    if that still has least words; so words that happen to be equal beyond an end are left out.
    """
    m = len(at)
    if m < share * least:
        return []
    columns = np.concatenate([[0], np.cumsum(np.maximum(np.diff(at), np.diff(partner)))])
    # i..j is good if (j - i + 1) >= share * (columns[j] - columns[i] + 1): if up[j] >= low[i]
    up, low = np.arange(1, m + 1) - share * (columns + 1), np.arange(m) - share * columns
    starts = np.flatnonzero(low < np.append(np.inf, np.minimum.accumulate(low)[:-1]))  # a start with a lower one before lies in that one's stretch
    # the last j that each start reaches: the suffix maxima of up fall, so a binary search finds it
    top = np.maximum.accumulate(up[::-1])[::-1]
    ends = np.searchsorted(-top, -(low[starts] - 1e-9), side="right") - 1
    out, reached = [], -1
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        wide = min(at[j] - at[i], partner[j] - partner[i]) + 1 if j >= i else 0
        if j <= reached or wide < least or j - i + 1 < share * least:
            continue
        reached = j
        score = np.arange(1, j - i + 2) - (columns[i : j + 1] - columns[i] + 1) / 2
        e = i + int(np.flatnonzero(score == score.max())[-1])
        before = np.arange(e - i + 1) - (columns[i : e + 1] - columns[i]) / 2
        s = i + int(before.argmin())
        out.append((s, e) if min(at[e] - at[s], partner[e] - partner[s]) + 1 >= least else (i, j))
    return list(dict.fromkeys(out))


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]], least: int = LEAST, share: float = SHARE) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end, other start, other end, equal words) of word arrays a and b along a chain."""
    p0, q0, _ = chain[0]
    p1, q1 = chain[-1][0] + chain[-1][2], chain[-1][1] + chain[-1][2]
    there = set(b[max(q0 - MARGIN, 0) : q1 + MARGIN].tolist())
    if sum(map(there.__contains__, a[max(p0 - MARGIN, 0) : p1 + MARGIN].tolist())) < share * least:
        return []
    at, partner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def put(i: np.ndarray, j: np.ndarray) -> None:
        at.append(i)
        partner.append(j)

    def between(p: int, x: int, q: int, y: int) -> None:
        if found := _gap(a[p:x], b[q:y]):
            i, j = np.array(found).T
            put(p + i, q + j)

    def beyond(p: int, x: int, q: int, y: int, end: bool) -> None:
        """An end: on the diagonal of the outer run, and aligned only where words on a shifted one agree too."""
        i, j = np.nonzero(a[p:x, None] == b[None, q:y])
        if not len(i):
            return
        shift = (j - i) - (0 if end else len(b[q:y]) - len(a[p:x]))
        off = shift[shift != 0]
        if len(off) and np.bincount(off + 2 * MARGIN).max() >= SHIFTED:
            between(p, x, q, y)
        else:
            put(p + i[shift == 0], q + j[shift == 0])

    beyond(max(p0 - MARGIN, 0), p0, max(q0 - MARGIN, 0), q0, False)
    p, q = p0, q0
    for x, y, n in chain:
        if x < p or y < q:  # overlaps the run before: begin behind it
            skip = max(p - x, q - y)
            x, y, n = x + skip, y + skip, n - skip
            if n <= 0:
                continue
        if x > p and y > q:
            between(p, x, q, y)
        n = min(n, len(a) - x, len(b) - y)
        i = np.flatnonzero(a[x : x + n] == b[y : y + n])
        put(x + i, y + i)
        p, q = x + n, y + n
    beyond(p1, p1 + MARGIN, q1, q1 + MARGIN, True)
    at, partner = np.concatenate(at), np.concatenate(partner)
    return sorted((int(at[s]), int(at[e]) + 1, int(partner[s]), int(partner[e]) + 1, e - s + 1) for s, e in stretches(at, partner, least, share))


def told_apart(docs: DataFrame, own: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with a column own, the same for equal (doc_id, text) only and in the order of doc_id; null without either.  And
    where texts share a doc_id, a table (own, name, version): version is the hash of the text, and 0 for other doc_ids.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("name"), F.xxhash64("text").alias("version")).where("name is not null").where(F.col("text").isNotNull())
    spread = named.groupBy("name").agg(F.min("version").alias("low"), F.max("version").alias("high"))
    if not spread.where("low <> high").limit(1).count():
        return docs.withColumn(own, F.when(F.col("text").isNotNull(), F.col("doc_id").cast("long"))), None
    # numbers in the order of (doc_id, version): the rows are sorted by ranges, and numbers grow from range to range
    numbers = named.distinct().repartitionByRange("name", "version").sortWithinPartitions("name", "version").withColumn(own, F.monotonically_increasing_id())
    numbers = table(numbers, "numbers")
    several = spread.where("low <> high").select("name").withColumn("more", F.lit(True))
    names = table(numbers.join(several, "name", "left").select(own, "name", F.when(F.col("more"), F.col("version")).otherwise(F.lit(0)).alias("version")), "names")
    left, right = fresh(docs, "own_name"), fresh(docs, "own_version")
    marked = docs.withColumn(left, F.when(F.col("text").isNotNull(), F.col("doc_id").cast("long"))).withColumn(right, F.xxhash64("text"))
    numbers = numbers.select(F.col("name").alias(left), F.col("version").alias(right), own)
    return marked.join(numbers, [left, right], "left").drop(left, right), names


def passages(docs: DataFrame, k: int = K, window: int = WINDOW, least: int = LEAST, share: float = SHARE, versions: bool = False) -> DataFrame:
    """(doc_id, start, end, other_id, other_start, other_end, equal): passages, in words from 0.

    With versions, (version, other_version) too: 0 but where different texts share a doc_id, and there the hash (xxhash64)
    of the text that start and end count in.
    """
    own, names = told_apart(docs.select("doc_id", "text"), "own")
    found = _passages(own.select(F.col("own").alias("doc_id"), "text"), k, window, least, share)
    columns = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "equal", *["version", "other_version"] * versions]
    if names is None:
        zero = F.lit(0).cast("long")
        return found.withColumns({"version": zero, "other_version": zero}).select(columns)
    found = found.withColumnRenamed("doc_id", "own").join(names.select("own", F.col("name").alias("doc_id"), "version"), "own").drop("own")
    other = names.select(F.col("own").alias("other_id"), F.col("name").alias("other_name"), F.col("version").alias("other_version"))
    found = found.join(other, "other_id").drop("other_id").withColumnRenamed("other_name", "other_id")
    return found.select(columns)


def _passages(docs: DataFrame, k: int = K, window: int = WINDOW, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """passages() of documents whose doc_id stands for one text."""
    found = seeds(docs, k, window).repartition("part").sortWithinPartitions("part")
    met = table(_matches(found), "matches")
    near = table(_aligned(docs, _chained(met.where("octet_length(gap) = 0"), k, least), least, share), "passages")
    shared = met.where("octet_length(gap) > 0")
    apart = _apart(shared, near, k)
    stretched = _stretches(shared, k, window, least)
    whole = _whole(docs, stretched, near, least).repartition("doc").sortWithinPartitions("doc", "pos")
    return near.unionByName(_aligned(docs, _covering(whole, least).unionByName(_chained(apart, k, least)), least, share)).distinct()


def _aligned(docs: DataFrame, links: DataFrame, least: int, share: float) -> DataFrame:
    """Passages along the chains (doc, other, p, q, n)."""
    links = table(links, "chains")
    many = links.groupBy("other").agg(F.count(F.lit(1)).alias("m")).select("other", F.expr(f"cast((m + {MEMBERS - 1}) div {MEMBERS} as int)").alias("portions"))
    none = F.lit(None).cast("array<int>")
    asks = links.join(many.hint("merge"), "other").select(F.col("doc").alias("id"), F.struct("other", F.expr("cast(pmod(xxhash64(doc), portions) as int)").alias("portion"), F.lit(False).alias("leads"), "p", "q", "n").alias("role"))
    leads = many.select(F.col("other").alias("id"), "other", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion")).select("id", F.struct("other", "portion", F.lit(True).alias("leads"), none.alias("p"), none.alias("q"), none.alias("n")).alias("role"))
    roles = table(asks.unionByName(leads).groupBy("id").agg(F.collect_list("role").alias("roles")), "roles")
    runs = F.aggregate("roles", F.lit(0).cast("long"), lambda n, r: n + 3 + F.coalesce(F.size(r["p"]), F.lit(0)))
    weight = roles.agg(F.sum(F.lit(2) + runs)).first()[0] or 0
    role = "other long, portion int, leads boolean, p array<int>, q array<int>, n array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            w = Words(b.column("text"))
            h = (w.hashes() >> np.uint64(32)).astype("<u4")
            out = []
            for i, (name, own) in enumerate(zip(b.column("id").to_pylist(), b.column("roles").to_pylist(), strict=True)):
                words = h[w.first[i] : w.first[i + 1]]
                for r in own:
                    low, high = (0, len(words)) if r["leads"] else (max(0, r["p"][0] - MARGIN), r["p"][-1] + r["n"][-1] + MARGIN)
                    out.append((name, r["other"], r["portion"], r["leads"], r["p"], r["q"], r["n"], low, words[low:high].tobytes()))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.list_(pa.int32())] * 3, pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "other", "portion", "leads", "p", "q", "n", "low", "words"])

    texts = _texts_of(docs, roles, weight)
    sent = texts.select("id", "roles", "text").mapInArrow(trimmed(cut), f"id long, {role}, low long, words binary").repartition("other", "portion").sortWithinPartitions("other", "portion", F.desc("leads"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, others = None, []
        for b in batches:
            out = []
            columns = [b.column(c).to_pylist() for c in ("id", "other", "portion", "leads", "p", "q", "n", "low")]
            for i, (name, other, portion, leads, p, q, n, low) in enumerate(zip(*columns, strict=True)):
                words = np.frombuffer(b.column("words")[i].as_buffer(), "<u4")
                if (other, portion) != key:
                    key, others = (other, portion), []
                if leads:
                    others.append(words.copy())
                    continue
                for o in others:  # more than one only where rows share a doc_id
                    chain = [(x - low, y, z) for x, y, z in zip(p, q, n, strict=True)]
                    out += [(name, s + low, e + low, other, s2, e2, same) for s, e, s2, e2, same in align(words, o, chain, least, share)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "end", "other_id", "other_start", "other_end", "equal"])

    result = sent.mapInArrow(trimmed(meet), "doc_id long, start long, end long, other_id long, other_start long, other_end long, equal long")
    return result.distinct()


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, start, end): the union of each document's passages."""
    order = W.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = found.select("doc_id", "start", "end").distinct().withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def without_passages(docs: DataFrame, **options) -> DataFrame:
    """docs, with the passages that an earlier document has cut from the text; n_chars follows.  A document of which no
    word is left goes.  Rows that share a doc_id and differ in text are documents of their own, in the order of the texts'
    hashes: each loses its own passages only."""
    own_cuts, key = fresh(docs, "cuts"), fresh(docs, "cut_id")
    columns = docs.columns
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    docs, _ = told_apart(docs, key)
    cuts = spans(_passages(docs.select(F.col(key).alias("doc_id"), "text"), **options)).groupBy(F.col("doc_id").alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(own_cuts))
    cuts = table(cuts, "cuts")
    numbers = cuts.agg(F.sum(F.lit(2) + 2 * F.size(own_cuts))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            own = b.column(own_cuts).to_pylist()
            texts, keep = b.column("text").to_pylist(), []
            if any(own):
                w = Words(b.column("text"))
                for i, c in enumerate(own):
                    if not c:
                        keep.append(i)
                        continue
                    first, last, base = w.first[i], w.first[i + 1], w.offsets[i]
                    raw, parts, at = w.data[base : w.offsets[i + 1]].tobytes(), [], 0
                    left = last - first
                    for s in c:
                        start, end = first + s["start"], min(first + s["end"], last)
                        if start >= last:
                            break
                        parts.append(raw[at : w.start[start] - base])
                        at = (w.start[end] - base) if end < last else len(raw)
                        left -= end - start
                    texts[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
                    if left > 0:
                        keep.append(i)
            else:
                keep = list(range(len(own)))
            made = {"text": pa.array([texts[i] for i in keep], pa.string())}
            took = b.take(pa.array(keep, pa.int64()))
            lengths = pa.array([took.column("n_chars")[j].as_py() if not own[i] else len(texts[i]) for j, i in enumerate(keep)], pa.int64()) if "n_chars" in columns else None
            yield pa.RecordBatch.from_arrays([made["text"] if c == "text" else lengths if c == "n_chars" else took.column(c) for c in columns], columns)

    return picked(docs, cuts, numbers, key, "left").select(*columns, own_cuts).mapInArrow(trimmed(run), out)
