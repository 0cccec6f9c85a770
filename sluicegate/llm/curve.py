"""Operator 13, packing along a space-filling curve.

A document is a vector of hashed token counts: each distinct token id adds a pseudo-random direction, weighed by
1 + log2 of its count, and the sum is the vector's projection to ``DIMS`` dimensions.  Projections are centred and scaled
by their mean and deviation over all documents and mapped to a grid of 2**BITS cells a side; the Hilbert index of the cell
orders the documents, so neighbours on the curve have similar tokens.  Ids are dealt over ranges of that order and laid
end to end; a sequence is a stretch of ``width`` tokens of the whole line, whatever documents it cuts, and what is left at
its end is cut into powers of two, which need no padding.

The range cuts are quantiles of the order's numbers; sums of the ranges' tokens come to the driver, a number for each
range.  A hash of the row breaks ties in the order, so copies, however many, spread over ranges.

Defined results: a null text counts as empty; an empty text has the end id alone and the centre's projection; a null
doc_id is kept; repeated rows are packed as often as they occur; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicegate.llm.bpe import encoder
from sluicegate.llm.common import mix, steps, table, utf8

#: Tokens of a sequence, dimensions of the projection, bits of a cell's coordinate, and bits of the row's hash behind them.
WIDTH, DIMS, BITS, TIES = 2048, 4, 7, 24


def directions(size: int, dims: int = DIMS) -> np.ndarray:
    """A pseudo-random direction for each token id: hashes as numbers of mean 0 and deviation 1."""
    h = mix(np.arange(1, size * dims + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return ((h >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5).reshape(size, dims) * np.sqrt(12)


def projections(ids: np.ndarray, ends: np.ndarray, toward: np.ndarray) -> np.ndarray:
    """The projection of each document, of unit length before it (documents without ids: 0)."""
    rows, size = len(ends) - 1, len(toward)
    key, n = np.unique(np.repeat(np.arange(rows), np.diff(ends)) * size + ids.astype(np.int64), return_counts=True)
    row, weight = key // size, 1 + np.log2(n)
    norm = np.sqrt(np.maximum(np.bincount(row, weight**2, rows), 1))
    found = np.stack([np.bincount(row, weight * toward[key % size, d], rows) for d in range(toward.shape[1])], 1)
    return found / norm[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of each row of cell coordinates below 2**bits.

    The coordinates are brought to transposed form from the highest bit down: where a coordinate's bit is set the low bits
    of the first one are inverted, else they are exchanged with the first one's; Gray decoding and interleaving follow.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            set_ = (x[d] >> b) & 1 == 1
            swap = np.where(set_, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    fix = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= fix
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[d] >> b) & 1)
    return out


def _cells(projected: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Grid cells: the logistic curve of the scaled projection, which is near its share of all documents."""
    z = np.clip((projected - mean) * scale, -30, 30)
    return np.minimum((1 / (1 + np.exp(-1.702 * z)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def encoded(docs: DataFrame, vocab_path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, projected, tokens, wide, ids): the ids of each whole text and the end id, in 16 bits each if all of the
    vocabulary fits (wide: 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab_path)
        size = max(own.merger.size, end_id + 1)
        kind, toward = "<u2" if size <= 1 << 16 else "<u4", directions(size)
        for b in steps(batches, text):
            ids, ends = own.encode_column(b.column(text))
            place = projections(ids, ends, toward)
            ids, ends = np.insert(ids, ends[1:], end_id), ends + np.arange(len(ends))
            flat = ids.astype(kind)
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends * flat.itemsize), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
            projected = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * DIMS, pa.int32()), pa.array(place.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(key), projected, pa.array(np.diff(ends)), pa.array([kind == "<u4"] * b.num_rows), held], [key, *_HELD])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"`{key}` long, projected array<double>, tokens long, wide boolean, ids binary")


_HELD = ["projected", "tokens", "wide", "ids"]


class Line:
    """All documents' ids as one line along the curve.

    ``held`` is the table of ids, ``cuts`` the ranges' limits in the order's numbers, ``base`` the tokens before each range.
    """

    def __init__(self, docs: DataFrame, vocab_path: str, end_id: int = 1, width: int = WIDTH, ranges: int | None = None, text: str = "text", key: str = "doc_id"):
        spark = docs.sparkSession
        self.key, self.width = key, width
        ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        # a row's number hashes its place in the written table: file by task, and row; the same input splits give the same
        written = table(encoded(docs, vocab_path, end_id, text, key), "curve-ids")
        file = F.regexp_extract("_metadata.file_name", r"part-(\d+)-.*-c(\d+)", 0)
        self.held = written.withColumn("row", F.xxhash64(F.regexp_extract(file, r"part-(\d+)", 1), F.regexp_extract(file, r"-c(\d+)$", 1), F.col("_metadata.row_index")))
        moments = written.agg(*(f(F.col("projected")[d]).alias(f"{n}{d}") for d in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
        self.mean = np.array([moments[f"m{d}"] or 0.0 for d in range(DIMS)])
        self.scale = 1 / np.maximum([moments[f"s{d}"] or 0.0 for d in range(DIMS)], 1e-9)
        self.cuts = np.zeros(0)
        light = self.held.select("projected", "row", "tokens")
        if ranges > 1:
            found = self.placed(light).approxQuantile("place", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
            self.cuts = np.unique(np.array(found, np.float64))
        total = np.zeros(len(self.cuts) + 1, np.int64)
        for r in self.placed(light).groupBy("range").agg(F.sum("tokens").alias("n")).collect():  # a row for each range
            total[r["range"]] = r["n"]
        self.base, self.tokens = np.cumsum(total) - total, int(total.sum())

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with their place in the order (curve index, then a hash of the row) and their range."""
        mean, scale, cuts = self.mean, self.scale, self.cuts
        names = [c for c in rows.columns if c != "projected"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = _cells(b.column("projected").flatten().to_numpy().reshape(-1, DIMS), mean, scale)
                tie = (b.column("row").to_numpy().astype(np.uint64) >> np.uint64(64 - TIES)).astype(np.int64)
                place = ((hilbert(cells) << TIES) | tie).astype(np.float64)  # below 2**53
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(place), pa.array(np.searchsorted(cuts, place, side="right").astype(np.int32))], [*names, "place", "range"])

        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
        return rows.mapInArrow(run, f"{kinds}, place double, range int")

    def limits(self) -> np.ndarray:
        """Where the sequences behind the last whole one begin on the line, and the line's end."""
        at = self.tokens // self.width * self.width
        out, rest = [at], self.tokens - at
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                out.append(out[-1] + (1 << bit))
        return np.array(out, np.int64)

    def pieces(self, with_ids: bool = False) -> DataFrame:
        """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ids (little-endian uint32) if asked for."""
        key, width, base, limits = self.key, self.width, self.base, self.limits()
        names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, now = 0, -1
            for b in batches:
                ranges, n = b.column("range").to_numpy(), b.column("tokens").to_numpy()
                for first, last in _runs(ranges):
                    if ranges[first] != now:
                        now = ranges[first]
                        at = int(base[now])
                    starts = at + np.cumsum(n[first:last]) - n[first:last]
                    to = int(starts[-1] + n[last - 1])
                    whole = np.arange(-(-at // width), -(-min(to, limits[0]) // width)) * width
                    edge = np.unique(np.concatenate([starts, whole, limits[(limits >= at) & (limits < to)]]))
                    doc = np.searchsorted(starts, edge, side="right") - 1
                    length = np.diff(np.append(edge, to))
                    late = np.searchsorted(limits, edge, side="right") - 1
                    sequence = np.where(edge < limits[0], edge // width, limits[0] // width + late)
                    offset = edge - np.where(edge < limits[0], sequence * width, limits[np.maximum(late, 0)])
                    ids = _ids(b.slice(first, last - first))
                    raw = [ids[i - at : i - at + k].tobytes() for i, k in zip(edge.tolist(), length.tolist(), strict=True)]
                    out = [b.column(key).slice(first, last - first).take(pa.array(doc)), pa.array(edge - starts[doc]), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(n[first:last][doc]), pa.array(sequence), pa.array(offset)]
                    yield pa.RecordBatch.from_arrays(out + [pa.array(raw, pa.binary())] * with_ids, names)
                    at = to

        dealt = self.placed(self.held).repartitionById(len(self.cuts) + 1, F.col("range")).sortWithinPartitions("range", "place", "row")
        kinds = ", ".join(f"`{c}` long" for c in names if c != "ids")
        return dealt.select(key, "range", "tokens", "wide", "ids").mapInArrow(run, kinds + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence from its pieces, little-endian uint32; pieces with ids are needed."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most WIDTH pieces
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place (excluded) of each stretch of equal values."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]])
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if len(values) else iter(())


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    """The ids of all rows, one after the other, as little-endian uint32."""
    data, _ = utf8(rows.column("ids"))
    return data.view("<u4" if rows.column("wide")[0].as_py() else "<u2").astype("<u4")
