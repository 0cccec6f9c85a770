"""Operator 1, n-gram Jaccard join: blocked sparse products of the document by n-gram incidence matrix.

A document is the set of hashes of its k-word shingles.  Pairs with |A & B| / |A | B| >= num / den are linked.

1. One pass gives each document its set size, a 128-bit signature of the set and its smallest hashes.  Documents with
   the same set form a class; its smallest doc_id stands for it from here on.
2. Star: classes that share one of their smallest hashes are compared with the smallest class of that hash, not with
   each other.  The exact overlaps link the large groups of near copies; components follow.
3. Product: all hashes are ordered, those of busy cells last (cells: a table of fixed size, counted over all documents).
   A linked pair shares a hash among the first n - ceil(n num / den) + 1 of either.  These prefix entries are the sparse
   incidence; a column block accumulates overlap counts of the pairs of *different* components within the size bound,
   and drops pairs whose position cannot reach the overlap that their sizes demand.  The documents of long columns form
   families instead: blocks of their whole sets meet in pairs of blocks, one to a task, which counts all overlaps in
   memory and gives a spanning set of the links, so that no pairs of a large group are ever listed.  No entry and no
   pair is dropped.
4. Pairs of short columns get their exact overlap; components of all links follow.

Every link between two classes is either among these exact overlaps or joins two classes that are in one component by
other links; so components are exact, while links within a group of near copies aren't all listed.

Defined results: words are maximal runs outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text with 1 to k - 1 words is
one shingle; a null, empty or blank text has no shingle and links with nothing; rows with equal doc_id are compared as
documents of their own and then share the smallest component; a null doc_id has a component of its own, null; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sluicegate.llm.common import Words, fresh, mix, picked, small, steps, table, windows
from sluicegate.llm.components import components

#: Smallest hashes that make a document a candidate of a star.
STARS = 8
#: Cells in which shingles are counted for the order, 32 MB as int32, whatever the input; a task's counts are sent as bytes.
#: Where a cell holds too many shingles, its count no longer tells common ones from rare, and long columns grow.
CELL_BITS = 23
CELLS = 1 << CELL_BITS
#: Parts of the table that are summed by tasks of their own.
SLICES = 256
#: Classes of one star that meet its first one in one task.
STAR = 4096
#: Members that are compared with a leader in one task; entries of a column whose pairs are listed; sets of a block.
MEMBERS, COLUMN, BLOCK = 512, 32, 1024
#: Shingles of a block, so that blocks of long documents have fewer sets.
BLOCK_SHINGLES = 1_000_000
#: Classes whose components are broadcast; beyond it only those that differ from their first document are looked up.
CLASSES = 100_000
#: Entries that a task gathers before it sends them on; entries of a bucket of tokens, and the fewest buckets.
GATHERED, BUCKET, BUCKETS = 500_000, 500_000, 256

_U = np.uint64


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and where each row begins (n + 1 values)."""
    w = Words(column)
    h = w.hashes()
    grams, row = windows(w, h, k)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = count[short].astype(np.uint64)
        for j in range(k - 1):
            more = count[short] > j
            whole[more] = whole[more] * _U(0x9FB21C651E98DF25) + h[w.first[short[more]] + j]
        grams = np.concatenate([grams, mix(whole)])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        grams, row = grams[order], row[order]
    ends = np.searchsorted(row, np.arange(len(count) + 1))
    out, sizes = [], np.zeros(len(count) + 1, np.int64)
    for i in np.flatnonzero(np.diff(ends)).tolist():
        own = np.unique(grams[ends[i] : ends[i + 1]])
        out.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def needed(n, num: int, den: int):
    """The least overlap of a set of size n with any set that it links with."""
    return -(-n * num // den)


def _cell(grams: np.ndarray) -> np.ndarray:
    """The cell of each shingle, its first CELL_BITS bits."""
    return (grams >> _U(64 - CELL_BITS)).astype(np.int64)


def _features(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (doc_id, n, sig1, sig2, stars), and SLICES for each task with its cell counts (n the number
    of the slice, less SLICES)."""
    schema = "doc_id long, n long, sig1 long, sig2 long, stars array<long>, cells binary"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int32)
        for b in steps(batches):
            grams, at = shingles(b.column("text"), k)
            np.add.at(cells, _cell(grams), 1)
            sizes = np.diff(at)
            sigs, stars = [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                sigs.append(np.frombuffer(hashlib.blake2b(grams[i:j].tobytes(), digest_size=16).digest(), np.int64))
                stars.append(grams[i : min(j, i + STARS)].view(np.int64))
            sigs = np.array(sigs).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(sigs[:, 0]), pa.array(sigs[:, 1]), pa.array(stars, pa.list_(pa.int64())), pa.nulls(len(sizes), pa.binary())], names)
        if cells.any():
            slices = [x.tobytes() for x in np.split(np.minimum(cells, 255).astype(np.uint8), SLICES)]
            none = (pa.nulls(SLICES, f) for f in (pa.int64(), pa.int64(), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, pa.int64()), pa.array(np.arange(SLICES) - SLICES), *none, pa.array(slices)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _busy(cells: DataFrame) -> np.ndarray:
    """The sum of all tasks' cell counts: a slice of the table is one key of an exchange, and is summed by one task; the
    driver gets the 32 MB of the sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for n, x in zip(b.column("n").to_pylist(), b.column("cells"), strict=True):
                own = total.setdefault(n, np.zeros(CELLS // SLICES, np.int64))
                own += np.frombuffer(x.as_buffer(), np.uint8)
        if total:
            sums = [np.minimum(x, np.iinfo(np.int32).max).astype(np.int32).tobytes() for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(sums)], ["n", "cells"])

    out = np.zeros((SLICES, CELLS // SLICES), np.int32)
    sums = table(cells.select("n", "cells").repartition(SLICES, "n").mapInArrow(add, "n long, cells binary"), "cells")
    for r in sums.collect():  # SLICES rows
        out[r["n"] + SLICES] = np.frombuffer(r["cells"], np.int32)
    return out.reshape(-1)


def _overlaps(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b) of pairs that are linked, by exact overlap.  Rows of pairs: distinct (a, b).

    The sets of b's go to the task of a, in portions of MEMBERS: a's own set goes to each of its portions.
    """
    spark = docs.sparkSession
    pairs = table(pairs, "pairs")
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).withColumn("portions", F.expr(f"cast((m + {MEMBERS - 1}) div {MEMBERS} as int)"))
    roles = pairs.join(many, "a").select(F.col("b").alias("id"), F.col("a").alias("lead"), F.expr("cast(pmod(xxhash64(b), portions) as int)").alias("portion"), F.lit(False).alias("leads"))
    roles = roles.unionByName(many.select(F.col("a").alias("id"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(True).alias("leads")))
    roles = table(roles.groupBy("id").agg(F.collect_list(F.struct("lead", "portion", "leads")).alias("roles")), "roles")
    rows = roles.agg(F.sum(F.size("roles"))).first()[0] or 0

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            grams, at = shingles(b.column("text"), k)
            raw = grams.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("roles"), pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])], ["id", "roles", "grams"])

    own = picked(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), roles, rows, "id").select("id", "roles", "text")
    own = own.mapInArrow(sets, "id long, roles array<struct<lead: long, portion: int, leads: boolean>>, grams binary")
    sent = own.select("id", "grams", F.inline("roles")).repartition("lead", "portion").sortWithinPartitions("lead", "portion", F.desc("leads"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders = None, []
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("id", "lead", "portion", "leads")]
            for i, (name, lead, portion, leads) in enumerate(zip(*columns, strict=True)):
                grams = np.frombuffer(batch.column("grams")[i].as_buffer(), np.uint64)
                if (lead, portion) != at:
                    at, leaders = (lead, portion), []
                if leads:
                    leaders.append(grams)
                    continue
                for other in leaders:  # more than one only where rows share a doc_id
                    low, high = sorted((len(grams), len(other)))
                    if den * low < num * high:
                        continue
                    place = np.minimum(np.searchsorted(other, grams), len(other) - 1)
                    both = int((other[place] == grams).sum())
                    if den * both >= num * (low + high - both):
                        found.append((lead, name))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return sent.select("id", "lead", "portion", "leads", "grams").mapInArrow(compare, "a long, b long")


def _placed(docs: DataFrame, named: DataFrame, classes: DataFrame, count: int) -> DataFrame:
    """(doc_id, text, comp) of the documents that stand for a class, classes (rep, comp) being counted, and perhaps of some
    without words.  Of many classes, only the documents that stand for none, or are not the first of their component,
    are looked up; the other texts stay where they are."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    classes = classes.withColumnRenamed("rep", "doc_id")
    if count <= CLASSES:
        return own.join(F.broadcast(classes), "doc_id")
    aside = named.select("doc_id").distinct().join(classes, "doc_id", "left").where("comp is null or comp <> doc_id")
    aside = table(aside.withColumn("aside", F.lit(True)), "aside")
    found = picked(own, aside, aside.count(), "doc_id", "left").where("aside is null or comp is not null")
    return found.select("doc_id", "text", F.coalesce("comp", "doc_id").alias("comp"))


#: Columns of an entry and the bytes that each has on its way.  Of a token's hash 40 bits go: that others meet by chance adds
#: to what two documents may have in common, and the exact overlap decides.
_ENTRY = {"token": 5, "id": 8, "comp": 8, "n": 4, "pos": 4}


def _packed(rows: np.ndarray) -> bytes:
    """Rows of an entry's columns, byte by byte, so that like bytes lie together; comp as what differs from id."""
    rows = rows.copy()
    rows[:, 2] ^= rows[:, 1]
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(rows[:, i]).view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for i, w in enumerate(_ENTRY.values()))


def _unpacked(raw: bytes) -> np.ndarray:
    n, at = len(raw) // sum(_ENTRY.values()), 0
    out, data = np.zeros((n, len(_ENTRY)), np.int64), np.frombuffer(raw, np.uint8)
    for i, w in enumerate(_ENTRY.values()):
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = data[at : at + w * n].reshape(w, n).T
        out[:, i] = x.view(np.int64)[:, 0]
        at += w * n
    out[:, 2] ^= out[:, 1]
    return out


def _entries(placed: DataFrame, k: int, num: int, den: int, busy: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, entries): of each set the first hashes in the order of (count of the hash's cell, hash), with their places,
    packed by ranges of hashes."""
    cells = placed.sparkSession.sparkContext.broadcast(busy)

    def sent(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(gathered)
        rows = rows[np.argsort(rows[:, 0])]
        bucket = rows[:, 0] * buckets >> 40
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        raw = [_packed(rows[i:j]) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(raw, pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy, gathered, waiting = cells.value, [], 0
        for b in steps(batches):
            grams, at = shingles(b.column("text"), k)
            rank = busy[_cell(grams)]
            ids, comps = b.column("doc_id").to_pylist(), b.column("comp").to_pylist()
            for doc, comp, i, j in zip(ids, comps, at[:-1].tolist(), at[1:].tolist(), strict=True):
                if i == j:
                    continue
                n = j - i
                rows = np.empty((n - needed(n, num, den) + 1, len(_ENTRY)), np.int64)
                order = np.argsort(rank[i:j], kind="stable")[: len(rows)]  # grams are sorted already
                rows[:, 0] = (grams[i:j][order] >> _U(24)).view(np.int64)
                rows[:, 1:4] = doc, comp, n
                rows[:, 4] = np.arange(len(rows))
                gathered.append(rows)
                waiting += len(rows)
            if waiting > GATHERED:
                yield from sent(gathered)
                gathered, waiting = [], 0
        if gathered:
            yield from sent(gathered)

    return placed.select("doc_id", "text", "comp").mapInArrow(run, "bucket long, entries binary")


def _column(x: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Rows (a, b, n of a, n of b): pairs of one column that can reach the overlap that their sizes demand."""
    if (x[:, 2] == x[0, 2]).all():
        return []
    x = x[np.argsort(x[:, 3], kind="stable")]
    ids, comp, n, pos = x[:, 1], x[:, 2], x[:, 3], x[:, 4]
    i, j = np.nonzero((comp[:, None] != comp[None, :]) & (num * n[None, :] <= den * n[:, None]) & np.tri(len(x), k=-1, dtype=bool).T)
    most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
    keep = (num + den) * most >= num * (n[i] + n[j])
    i, j = i[keep], j[keep]
    swap = ids[i] > ids[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return [np.column_stack([ids[a], ids[b], n[a], n[b]])] if len(a) else []


def _products(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Overlap counts (a, b, na, nb, common) from packed entries that come bucket by bucket; the entries of a column that is
    longer than COLUMN are passed on instead (a null)."""
    schema = "a long, b long, na long, nb long, common long, token long, id long, comp long, n long"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def emit(pairs: list[np.ndarray], passed: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if pairs:
            p, c = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(p[:, i]) for i in range(4)), pa.array(c), *[pa.nulls(len(p), pa.int64())] * 4], names)
        if passed:
            x = np.concatenate(passed)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(x), pa.int64())] * 5, *(pa.array(x[:, i]) for i in range(4))], names)

    def columns(parts: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of short columns by token, those of long ones, and the tokens of these and the ones known before."""
        rows = np.concatenate(parts)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        size = np.diff(np.append(starts, len(rows)))
        beyond = (size > COLUMN) | np.isin(rows[starts, 0], known)
        each = np.repeat(beyond, size)
        return rows[~each], rows[each], np.union1d(known, rows[starts[beyond], 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting, limit, known = None, [], 0, 2 * BUCKET, np.zeros(0, np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows, passed, _ = columns(held, known)
            pairs, waiting = [], 0
            if len(passed):
                yield from emit([], [passed])
            starts = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(rows))
            several = ends - starts > 1
            for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                found = _column(rows[s:e], num, den)
                pairs += found
                waiting += sum(map(len, found))
                if waiting > 500_000:
                    yield from emit(pairs, [])
                    pairs, waiting = [], 0
            yield from emit(pairs, [])

        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("entries"), strict=True):
                if bucket != at:
                    yield from done()
                    at, held, waiting, limit, known = bucket, [], 0, 2 * BUCKET, known[:0]
                held.append(_unpacked(raw.as_buffer()))
                waiting += len(held[-1])
                if waiting > limit:  # long columns go, whatever their length
                    rows, passed, known = columns(held, known)
                    if len(passed):
                        yield from emit([], [passed])
                    held, waiting, limit = [rows], len(rows), 2 * (len(rows) + BUCKET)
        yield from done()

    return entries.mapInArrow(run, schema)


def overlaps(grams: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Counts of common hashes [document, document]: busy columns of the incidence as a dense product, others pair by
    pair."""
    order = np.argsort(grams, kind="stable")
    grams, doc = grams[order], doc[order]
    at = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    size = np.diff(np.append(at, len(grams)))
    total = np.zeros((n, n), np.float32)
    column = np.repeat(np.arange(len(at)), size)
    busy = np.flatnonzero(size >= 24)
    place = np.full(len(at), -1)
    place[busy] = np.arange(len(busy))
    for lo in range(0, len(busy), 4096):
        own = (place[column] >= lo) & (place[column] < lo + 4096)
        x = np.zeros((n, min(4096, len(busy) - lo)), np.float32)
        x[doc[own], place[column[own]] - lo] = 1
        total += x @ x.T
    for width in range(2, 24):
        first = at[size == width]
        some = 1_000_000 // (width * (width - 1)) + 1
        for lo in range(0, len(first), some):
            rows = doc[first[lo : lo + some, None] + np.arange(width)]
            i, j = np.triu_indices(width, 1)
            pair = np.bincount((rows[:, i].astype(np.int64) * n + rows[:, j]).reshape(-1), minlength=n * n).reshape(n, n)
            total += pair
            total += pair.T
    return total


def _families(docs: DataFrame, passed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): a spanning set of the links between different components among documents that share a long column.

    Documents of long columns that hold several components form families; a family's sets go, in blocks, to a task for
    each pair of blocks, which counts all overlaps in memory and gives the links' components, not the links.
    """
    mixed = passed.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.min("id").alias("first")).where("least < most")
    held = table(passed.join(mixed.select("token", "first"), "token").select("id", "comp", "n", "first").distinct(), "long-columns")
    family = components(held.select(F.col("first").alias("a"), F.col("id").alias("b")))
    member = held.select("id", "comp", "n").distinct().groupBy("id", "comp").agg(F.sum("n").alias("n")).join(family, "id").select("id", "comp", "n", F.col("component").alias("family"))
    member = table(member, "families")
    # sets that link differ in size by den / num at most: those of one band of sizes, or of neighbouring ones
    member = member.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9) if num < den else F.col("n"))
    blocks = member.groupBy("family", "band").agg(F.expr(f"greatest((count(1) + {BLOCK - 1}) div {BLOCK}, (sum(n) + {BLOCK_SHINGLES - 1}) div {BLOCK_SHINGLES})").alias("blocks"))
    blocks = table(blocks, "blocks")
    placed = member.join(blocks, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # a block meets itself, the others of its band and all of the bands beside it
    reach = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("other")
    others = placed.select("id", "comp", "family", "band", "block", reach).join(blocks.select("family", F.col("band").alias("other"), F.col("blocks").alias("others")), ["family", "other"])
    others = others.withColumn("with", F.explode(F.expr("sequence(0L, others - 1)")))
    one, two = F.struct("band", "block"), F.struct(F.col("other").alias("band"), F.col("with").alias("block"))
    roles = others.select("id", "comp", "family", F.least(one, two).alias("low"), F.greatest(one, two).alias("high"))
    place = lambda c: F.xxhash64(f"{c}.band", f"{c}.block")
    roles = roles.groupBy("id", "comp").agg(F.collect_list(F.struct("family", place("low").alias("low"), place("high").alias("high"))).alias("roles"))
    roles = table(roles, "roles")
    rows = roles.agg(F.sum(F.size("roles"))).first()[0] or 0

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            grams, at = shingles(b.column("text"), k)
            raw = grams.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("comp"), b.column("roles"), pa.array([raw[8 * i : 8 * j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])], ["id", "comp", "roles", "grams"])

    own = picked(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), roles, rows, "id").select("id", "comp", "roles", "text")
    own = own.mapInArrow(sets, "id long, comp long, roles array<struct<family: long, low: long, high: long>>, grams binary")
    sent = own.select("id", "comp", "grams", F.inline("roles")).repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")

    def links(members: list[tuple]) -> list[tuple[int, int]]:
        """Each document with the first one of its component, by links of the block pair and the components so far."""
        ids, comp, grams = zip(*members, strict=True)
        comp = np.unique(np.array(comp), return_inverse=True)[1]
        n = np.array([len(g) for g in grams])
        if len(ids) < 2 or comp.max() == 0:
            return []
        common = overlaps(np.concatenate(grams), np.repeat(np.arange(len(ids)), n), len(ids))
        linked = (comp[:, None] != comp[None, :]) & ((num + den) * common >= num * (n[:, None] + n[None, :]))
        label = np.arange(len(ids))
        i, j = np.nonzero(linked)
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            least = np.full(comp.max() + 1, len(ids))
            np.minimum.at(least, comp, new)
            new = np.minimum(new, least[comp])
            if (new == label).all():
                break
            label = new
        met = np.zeros(len(ids), bool)
        met[i] = True
        return [(ids[label[x]], ids[x]) for x in np.flatnonzero(met & (label != np.arange(len(ids)))).tolist()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members = None, []

        def out() -> Iterator[pa.RecordBatch]:
            if found := links(members) if members else []:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "comp", "family", "low", "high")]
            for i, (name, comp, family, low, high) in enumerate(zip(*columns, strict=True)):
                if (family, low, high) != at:
                    yield from out()
                    at, members = (family, low, high), []
                members.append((name, comp, np.frombuffer(batch.column("grams")[i].as_py(), np.uint64)))
        yield from out()

    return sent.select("id", "comp", "family", "low", "high", "grams").mapInArrow(compare, "a long, b long")


def _across(docs: DataFrame, placed: DataFrame, total: int, k: int, num: int, den: int, busy: np.ndarray) -> DataFrame:
    """(a, b): links between classes of different components, as many as join all that are linked; placed: their documents
    (doc_id, text, comp), total: the sum of the sizes of all sets."""
    buckets = max(BUCKETS, total * (den - num) // (den * BUCKET))
    entries = _entries(placed, k, num, den, busy, buckets).repartition("bucket").sortWithinPartitions("bucket")
    first = table(_products(entries, num, den), "products")
    total = first.where("a is not null").groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    # What both prefixes share, and all that one of them leaves out, bounds the overlap.  Documents that share a long
    # column are of one component or of one family, so for the pairs that matter here short columns hold all they share.
    rest = F.greatest(F.expr(f"(na * {num} + {den - 1}) div {den} - 1"), F.expr(f"(nb * {num} + {den - 1}) div {den} - 1"))
    pairs = total.where((num + den) * (F.col("common") + rest) >= num * (F.col("na") + F.col("nb"))).select("a", "b").distinct()
    passed = first.where("a is null").select("token", "id", "comp", "n")
    out = _overlaps(docs, pairs, k, num, den)
    return out if passed.isEmpty() else out.unionByName(_families(docs, passed, k, num, den))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs (columns doc_id and text)."""
    features = table(_features(docs, k), "shingles")
    cells = features.where("n < 0").select("n", "cells")
    rows = features.where("n >= 0").select("doc_id", "n", "sig1", "sig2", "stars")
    named = rows.where("n > 0 and doc_id is not null")
    classes = table(named.groupBy("sig1", "sig2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("stars").alias("stars")), "classes")
    # rows that share a doc_id, with different sets
    several = named.groupBy("doc_id").agg(F.min("sig1").alias("least"), F.max("sig1").alias("most")).where("least < most").select("doc_id")
    several = named.join(several, "doc_id").join(classes.select("sig1", "sig2", "rep"), ["sig1", "sig2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps"))
    same = several.select("a", F.explode("reps").alias("b"))
    # star
    stars = classes.select("rep", "n", F.explode("stars").alias("star"))
    leaders = stars.groupBy("star").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    leaders = table(leaders.select("star", F.col("lead.rep").alias("a"), F.col("lead.n").alias("na"), F.expr(f"(m + {STAR - 1}) div {STAR}").alias("parts")), "leaders")
    hot = leaders.where("parts > 1").select("star", "parts")  # a row for each STAR classes at most
    stars = stars.join(small(hot, hot.count()), "star", "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))).drop("parts")
    leaders = leaders.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).drop("parts")
    pairs = stars.join(leaders, ["star", "part"]).where((F.col("rep") != F.col("a")) & (F.least("n", "na") * den >= F.greatest("n", "na") * num)).select("a", F.col("rep").alias("b")).distinct()
    linked = table(_overlaps(docs, pairs, k, num, den).unionByName(same), "links")
    parts = components(linked)
    # product across the components found so far
    count = classes.count()
    named_parts = table(classes.select("rep").distinct().join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp")), "parts")
    busy = _busy(cells)
    total = named.agg(F.sum("n")).first()[0] or 0
    more = table(_across(docs, _placed(docs, named, named_parts, count), total, k, num, den, busy), "links")
    if not more.isEmpty():
        parts = components(more.unionByName(parts.select(F.col("component").alias("a"), F.col("id").alias("b"))))
    found = classes.select("sig1", "sig2", "rep").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("sig1", "sig2", F.coalesce("component", "rep").alias("component"))
    out = rows.join(found, ["sig1", "sig2"], "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without near copies: of each component of linked texts the row with the smallest doc_id stays (of
    several such, the one with the least hash), and of equal rows one.  Rows are told apart by doc_id and text, so texts
    that share a doc_id link by their words alone.  Rows without doc_id or without words link with nothing and stay, but
    for equal rows with a doc_id."""
    uid, first, nth = fresh(docs, "row_id"), fresh(docs, "first_id"), fresh(docs, "row_nth")
    own = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), "text"))
    found = table(join(docs.select(own.alias("doc_id"), "text"), k, num, den).where("doc_id is not null").groupBy("doc_id", "component_id").count(), "components")
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("component_id")
    linked = table(found.join(several, "component_id").select(F.col("doc_id").alias(uid), "component_id"), "linked")
    # of the linked rows, the doc_ids, and the first of each component
    ids = picked(docs.select(own.alias(uid), F.col("doc_id").cast("long").alias(first)), linked, linked.count(), uid).distinct()
    ids = table(ids.select(uid, first, "component_id"), "linked-ids")
    kept = ids.groupBy("component_id").agg(F.min(F.struct(first, uid))[uid].alias(uid))
    gone = table(ids.select(uid).join(kept, uid, "left_anti").distinct(), "copies")
    left = picked(docs.withColumn(uid, own), gone, gone.count(), uid, "left_anti")
    twice = table(found.where("count > 1").select(F.col("doc_id").alias(uid)), "repeated")
    n = twice.count()
    if not n:
        return left.select(docs.columns)
    equal = picked(left, twice, n, uid, "left_semi").withColumn(nth, F.row_number().over(W.partitionBy(uid).orderBy(*(c for c in docs.columns if c not in ("doc_id", "text")), uid))).where(F.col(nth) == 1)
    return picked(left, twice, n, uid, "left_anti").select(docs.columns).unionByName(equal.select(docs.columns))
