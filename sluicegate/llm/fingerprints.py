"""Operator 2, document fingerprints: randomised edit embedding, bit-sampled banding and verification.

Embedding: a walk over a stretch of text copies the character under it and moves on or stays, as a random bit for (step,
character) says; all texts share the bits.  After an edit two walks fall in step again, so that edit distance becomes
Hamming distance between the copied characters.  A walk is sequential and its step numbers shift with every edit
before; so the text is cut at content-defined places (a hash of the bytes before them) and each stretch is walked from
step 0, all stretches of a batch side by side in numpy.  Whole texts are embedded.

Sampling: a few steps of each walk, the same for all, form bands; a band's characters hash to one value.  The
fingerprint keeps, in each of its registers, one byte of the least of the values that fall there (one permutation
hashing), or marks it empty.  The share of equal registers estimates the Jaccard likeness of the band values; likeness is
given as 2 J / (1 + J), the share of bands in common, from 0 to 1.

Candidates (near_copies): documents whose fingerprints agree in all registers of a band are compared with the smallest
doc_id of that band only, and verified by edit distance on the whole texts, so that groups of copies make no pairs among
themselves; two documents that link with each other but not with that one are found where another band joins them.

Defined results: a null text counts as empty; empty texts have the empty fingerprint, which is like itself (1) and like
no other (0); rows in order of descending doc_id, null last, equal doc_id by the text's hash, then text; after the last
comes the first, and a single document is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sluicegate.llm.common import mix, small, steps, table

#: Registers of a fingerprint, two hexadecimal digits each; "--" is an empty one.
REGISTERS = 256
#: A stretch ends where the hash of the last bytes has this many zero bits, and after LONGEST bytes.
CUT_BITS, LONGEST = 7, 512
#: Bands of a walk and sampled steps of a band.
BANDS, SAMPLES = 16, 4
#: Registers of a band of the fingerprint: texts that agree in all registers of one band are compared.
WIDTH = 3

_U = np.uint64
_STEPS = 2 * LONGEST
#: Random bits for (step, byte): one of two moves.
_MOVES = (mix(np.arange(_STEPS * 256, dtype=np.uint64) + _U(77)) & _U(1)).astype(np.int32).reshape(_STEPS, 256)


def _sampled_steps() -> np.ndarray:
    """Steps [band, sample]: bands spread over the walk, so that a stretch of any length has some in its text."""
    ends = np.unique(np.round(np.geomspace(8, _STEPS, BANDS)).astype(int))
    starts = np.append(0, ends[:-1])
    out = []
    for i, (s, e) in enumerate(zip(starts, ends, strict=True)):
        r = mix(np.arange(SAMPLES, dtype=np.uint64) + _U(1000 * i + 13))
        out.append(np.sort(s + (r % _U(max(e - s, 1))).astype(int)))
    return np.array(out)


_SAMPLED = _sampled_steps()


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the content-defined stretches of texts that lie one after another."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    h = np.zeros(n, np.uint32)
    for back, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)):
        if back < n:
            h[back:] += data[: n - back].astype(np.uint32) * np.uint32(m)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    cut = (h >> np.uint32(32 - CUT_BITS)) == 0
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    # the hash may not look into the row before: near its start there is no cut
    cut &= np.arange(n) - offsets[row] >= 6
    ends = np.unique(np.concatenate([np.flatnonzero(cut) + 1, offsets[1:][np.diff(offsets) > 0]]))
    starts = np.append(0, ends[:-1])
    pieces = -(-(ends - starts) // LONGEST)
    if (pieces > 1).any():
        starts = np.concatenate([np.arange(s, e, LONGEST) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        ends = np.append(starts[1:], n)
    return starts, ends, row[starts]


def band_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the sampled characters [stretch, band] of the shared walks; 0 where the walk had ended before a band."""
    text = np.append(data, np.uint8(0))
    order = np.argsort(starts - ends, kind="stable")  # longest first, so that walks under way are a prefix
    at, stop = starts[order].astype(np.int64), ends[order]
    out = np.zeros((len(at), len(_SAMPLED)), np.uint64)
    live = len(at)
    wanted: dict[int, list[int]] = {}
    for band, chosen in enumerate(_SAMPLED):
        for s in chosen.tolist():
            wanted.setdefault(s, []).append(band)
    for step in range(int(_SAMPLED.max()) + 1):
        here, inside = at[:live], at[:live] < stop[:live]
        if step % 16 == 0:
            under = np.flatnonzero(inside)
            if not len(under):
                break
            live = int(under[-1]) + 1
            here, inside = at[:live], inside[:live]
        c = text[np.where(inside, here, len(data))]
        for band in wanted.get(step, ()):  # a walk that has ended adds nothing more
            value = out[:live, band] * _U(0x9FB21C651E98DF25) + c.astype(np.uint64) + _U(1 + (band << 16) + (step << 24))
            out[:live, band] = np.where(inside, value, out[:live, band])
        here += _MOVES[step][c]
    values = np.where(out != 0, mix(out), 0)
    result = np.zeros_like(values)
    result[order] = values
    return result


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Registers [text, REGISTERS] as int16; -1 is empty."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, row = stretches(data, offsets)
    out = np.full((len(texts), REGISTERS), -1, np.int16)
    if not len(starts):
        return out
    values = band_values(data, starts, ends)
    rows = np.repeat(row, values.shape[1])
    values = values.reshape(-1)
    rows, values = rows[values != 0], values[values != 0]
    cell = rows * REGISTERS + (values & _U(REGISTERS - 1)).astype(np.int64)
    order = np.lexsort((values, cell))
    cell, values = cell[order], values[order]
    first = np.append(True, cell[1:] != cell[:-1])
    out.reshape(-1)[cell[first]] = ((values[first] >> _U(20)) & _U(255)).astype(np.int16)
    return out


def shown(registers: np.ndarray) -> list[str]:
    """Two digits for each register."""
    names = np.array([*(f"{i:02x}" for i in range(256)), "--"])
    return ["".join(r) for r in names[registers].tolist()]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bands in common of fingerprints, row by row; equal bytes by chance are taken off."""
    filled = (a >= 0) | (b >= 0)
    total = filled.sum(1)
    same = ((a == b) & filled).sum(1)
    both = ((a >= 0) & (b >= 0)).sum(1)
    j = np.where(total > 0, np.clip((same - (both - same) / 255) / np.maximum(total, 1), 0, 1), 1.0)
    j[(a == b).all(1)] = 1.0
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many characters of the following text's beginning, or by all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_ROW = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _described(names: list, texts: list[str], follow: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f).encode() for t, f in zip(texts, follow, strict=True)]
    other = fingerprints(changed)
    return [
        pa.array(names, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
        pa.array(shown(own)), pa.array(shown(other)), pa.array(likeness(own, other)), pa.array(likeness(own, after)),
    ]


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    One range exchange puts rows in order of descending doc_id; a partition's last row meets the first row of the next
    partition in a table of two rows for each partition.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    names = [f.split(" ")[0] for f in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for b in steps(batches):
            ids = b.column("doc_id").to_pylist()
            texts = ["" if t is None else t for t in b.column("text").to_pylist()]
            own = fingerprints([t.encode() for t in texts])
            if last is None:
                yield edge(1, part, ids[0], texts[0])
            else:
                ids, texts, own = [last[0], *ids], [last[1], *texts], np.concatenate([last[2], own])
            last = ids[-1], texts[-1], own[-1:]
            if len(ids) > 1:
                m = len(ids) - 1
                made = _described(ids[:-1], texts[:-1], texts[1:], own[:-1], own[1:])
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array([part] * m, pa.int32()), *made, pa.nulls(m, pa.string())], names)
        if last is not None:
            yield edge(2, part, last[0], last[1])

    def edge(kind: int, part: int, name: int | None, text: str) -> pa.RecordBatch:
        none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([name], pa.int64()), *none, pa.array([text])], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = F.desc("doc_id")
    rows = rows.repartitionByRange(parts, order).sortWithinPartitions(order, F.xxhash64("text"), "text")
    out = table(rows.mapInArrow(run, _ROW), "fingerprints")
    # two rows for each partition are left to join: its last row with the first row of the next partition that has any
    firsts = out.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    there = sorted(r["part"] for r in out.where("kind = 1").select("part").collect())
    follows = spark.createDataFrame([(p, there[(i + 1) % len(there)]) for i, p in enumerate(there)], "part int, next_part int")
    lasts = out.where("kind = 2").select("part", "doc_id", "text").join(F.broadcast(follows), "part").join(firsts, "next_part")

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, after = b.column("text").to_pylist(), b.column("next_text").to_pylist()
            made = _described(b.column("doc_id").to_pylist(), texts, after, fingerprints([t.encode() for t in texts]), fingerprints([t.encode() for t in after]))
            yield pa.RecordBatch.from_arrays(made, names[2:-1])

    ends = lasts.select("doc_id", "text", "next_text").mapInArrow(join_edges, ", ".join(_ROW.split(", ")[2:-1]))
    return out.where("kind = 0").select(*names[2:-1]).unionByName(ends)


def distance(a: str, b: str, most: int) -> int | None:
    """Edit distance by bit-parallel columns, or None where it is over most."""
    if abs(len(a) - len(b)) > most:
        return None
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for j, c in enumerate(b):
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(x | up)), up & x
        score += bool(plus & top) - bool(minus & top)
        if score - (len(b) - j - 1) > most:
            return None
        plus, minus = (plus << 1 | 1) & full, minus << 1
        up, down = (minus | (full & ~((eq | down) | plus))) & full, plus & (eq | down)
    return score if score <= most else None


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = WIDTH, text: str = "text") -> DataFrame:
    """(doc_id, class_id): the smallest doc_id that verified links reach, for every named row of docs.

    Bands are runs of width registers; a link is 1 - edit distance / longer length >= similarity, between the smallest
    doc_id of a band's bucket and each other document of it.
    """
    from sluicegate.llm.components import components

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            f = fingerprints([(t or "").encode() for t in b.column("text").to_pylist()])
            bands = f[:, : REGISTERS // width * width].reshape(len(f), -1, width)
            keys = [[int.from_bytes(hashlib.blake2b(bytes([i]) + x.tobytes(), digest_size=8).digest(), "little", signed=True) for i, x in enumerate(r) if (x >= 0).any()] for r in bands]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "bands"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    marked = table(named.mapInArrow(mark, "doc_id long, bands array<long>"), "bands")
    buckets = marked.select("doc_id", F.explode("bands").alias("band"))
    leaders = buckets.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("band", "a")
    pairs = buckets.join(leaders, "band").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    met = pairs.join(named.select(F.col("doc_id").alias("b"), F.coalesce("text", F.lit("")).alias("tb")), "b").join(named.select(F.col("doc_id").alias("a"), F.coalesce("text", F.lit("")).alias("ta")), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)) if x == y or distance(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)) is not None]
            took = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column("a"), took.column("b")], ["a", "b"])

    linked = table(met.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"), "links")
    parts = components(linked).select(F.col("id").alias("doc_id"), "component")
    return marked.select("doc_id").join(small(parts, parts.count()), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
