"""Operator 6, token-ID / binary output: fixed-width bit packing with block offsets.

File format, a Parquet container so that Spark's commit protocol covers lost executors and any shared store works.  A
row is a segment of whole documents in ascending doc_id order:

``part, segment``  place in the file set; (part, segment) order is document order
``before``         ids before the segment in its part
``bits``           width of an id: the least number of bits that holds every id of the vocabulary
``block``          ids in a block; the last block may be shorter
``n_ids``          ids in the segment
``doc_id``         array<long>, the documents in order
``ends``           array<long>, end of each document within the segment, in ids
``offsets``        array<long>, byte offset of each block in the payload (blocks begin on a byte)
``payload``        binary, ids as bits-wide big-endian bit fields

``starts`` (a second, small table) has the number of ids before each part, so any document, segment or block is found
and unpacked alone.

Defined results: a null text counts as empty and still gets its end id; a null doc_id comes first; rows with equal
doc_id follow each other, ordered by their text's hash; other columns are ignored; an empty table makes an empty file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicegate.llm.common import shared_dir, steps
from sluicegate.llm.wordids import library

#: ids in a block, and in a segment before it is closed.
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 18
#: Bytes of text in a step: a word of a step is looked up once, so larger steps than usual pay.
STEP = 4 << 20

_SEGMENT = "part int, segment int, before long, bits int, block int, n_ids long, doc_id array<long>, ends array<long>, offsets array<long>, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as big-endian fields of the given width."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    fields = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(fields, axis=1)[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(raw: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first n ids of what pack wrote."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f">u{bits // 8}", n).astype(np.uint32)
    out = np.zeros((n, 32), np.uint8)
    out[:, 32 - bits :] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(out, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def pack_blocks(ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> tuple[bytes, list[int]]:
    """Payload and the byte offset of each block."""
    whole = [pack(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    return b"".join(whole), [0, *np.cumsum([len(x) for x in whole[:-1]]).tolist()] if whole else []


def unpack_range(payload: bytes, offsets: list[int], bits: int, block: int, n_ids: int, start: int, end: int) -> np.ndarray:
    """ids start..end of a segment; only the blocks that hold them are unpacked."""
    if end <= start:
        return np.zeros(0, np.uint32)
    first, last = start // block, (end - 1) // block
    view = memoryview(payload)
    got = [unpack(view[offsets[b] : offsets[b + 1] if b + 1 < len(offsets) else len(payload)], bits, min(block, n_ids - b * block)) for b in range(first, last + 1)]
    return np.concatenate(got)[start - first * block : end - first * block]


def write(docs: DataFrame, path: str, vocab_path: str, end_id: int | None = 2, parts: int | None = None, block: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, text: str = "text", key: str = "doc_id") -> None:
    """Encode each whole text, append end_id and write the file set to path (``segments`` and ``starts``).

    One range exchange by doc_id orders the documents; sizes of parts, not documents, come to the driver.
    """
    spark = docs.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(vocab_path)
        bits = max(1, (max(own.size - 1, end_id or 0)).bit_length())
        part, segment, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            payload, offsets = pack_blocks(flat, bits, block)
            row = [[part], [segment], [before], [bits], [block], [len(flat)], [names], [np.cumsum(np.concatenate(sizes)).tolist()], [offsets], [payload]]
            kinds = [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 2 + [pa.int64()] + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [f.split(" ")[0] for f in _SEGMENT.split(", ")])

        for b in steps(batches, text, STEP):
            flat, at = own.encode(b.column(text))
            if end_id is not None:
                flat, at = np.insert(flat, at[1:], end_id), at + np.arange(len(at))
            doc, row = b.column(key).to_pylist(), 0
            while row < len(doc):  # a segment closes behind the document that fills it
                to = min(len(doc), int(np.searchsorted(at, at[row] + segment_ids - held)))
                ids.append(flat[at[row] : at[to]])
                names += doc[row:to]
                sizes.append(np.diff(at[row : to + 1]))
                held += len(ids[-1])
                row = to
                if held >= segment_ids:
                    yield close()
                    segment, before, held = segment + 1, before + held, 0
                    ids, names, sizes = [], [], []
        if names:
            yield close()

    ordered = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(parts, key).sortWithinPartitions(key, F.xxhash64(text))
    ordered.mapInArrow(run, _SEGMENT).write.parquet(f"{path}/segments")
    by_part = spark.read.schema(_SEGMENT).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before, rows = 0, []
    for r in sorted(by_part.collect()):  # a row for each of parts at most
        rows.append((r["part"], before))
        before += r["n"]
    spark.createDataFrame(rows, "part int, start long").coalesce(1).write.parquet(f"{path}/starts")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a file set: doc_id, start, n_tokens, ids_crc32 (and ids, an array<long>, if asked for)."""
    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    starts = spark.read.schema("part int, start long").parquet(f"{path}/starts").withColumnRenamed("start", "base")  # a row for each part
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = np.array(r["ends"], np.int64)
                first = np.concatenate([[0], ends[:-1]])
                ids = unpack_range(r["payload"], r["offsets"], r["bits"], r["block"], r["n_ids"], 0, r["n_ids"]).astype("<u4")
                parts = [ids[a:z] for a, z in zip(first.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(r["doc_id"], pa.int64()), pa.array(first + r["base"] + r["before"]), pa.array(ends - first), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                out += [pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))] * with_ids
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return segments.join(F.broadcast(starts), "part").mapInArrow(run, schema)


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Random access: the ids of the documents with this doc_id, from their blocks alone."""
    found = spark.read.schema(_SEGMENT).parquet(f"{path}/segments").where(F.array_contains("doc_id", F.lit(doc_id).cast("long")))
    out = []
    for r in found.orderBy("part", "segment").toLocalIterator():
        for i, name in enumerate(r["doc_id"]):
            if name == doc_id:
                out.append(unpack_range(bytes(r["payload"]), r["offsets"], r["bits"], r["block"], r["n_ids"], r["ends"][i - 1] if i else 0, r["ends"][i]).tolist())
    return out


def written(docs: DataFrame, vocab_path: str, end_id: int | None = 2) -> DataFrame:
    """Write docs to a new file set in the shared folder and read it back."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, vocab_path, end_id)
    return read(docs.sparkSession, path)
