"""Shared parts of the corpus operators: shared-folder tables, Arrow text buffers, word hashing.

Word rule used throughout: words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text, which is
the same as ``[^\\x20\\x09-\\x0D]+`` over code points.  Hashes are 64-bit and depend on the bytes only, so every
executor and every retry computes the same value.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Text bytes that one numpy step holds at once; longer single texts form a step of their own.
STEP_BYTES = 2 << 20
#: Rows up to which a side counts as small enough to broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows up to which a side that picks rows of the texts is broadcast as it is; beyond it a bitmap of its keys is.
PICKED_ROWS = 50_000
#: Bits of a key in that bitmap, its rows, and the most words of 64 bits in a row: 8 MB, whatever the input.
KEY_BITS, BITMAP_ROWS, BITMAP_WORDS = 16, 1024, 1024
#: Spark's setting by which the shuffle files of a query go when the query ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_U = np.uint64
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, ``spark.checkpoint.dir``; it goes when the
    application ends.  Only a session within one machine may leave that setting out."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sluicegate-"))
        found = context.getCheckpointDir()
    own = f"{found.rstrip('/')}/sluicegate/{context.applicationId}"
    if own not in _MADE:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(own)
    return own


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.  What the write
    has exchanged goes with its end, as nothing else reads it."""
    path, conf = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(FREED, "false")
    conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, or the next one with a number that is no column of df in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in itertools.count() if (n := name + str(i) * bool(i)).lower() not in taken)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within limit, else df as it is."""
    return F.broadcast(df) if rows <= limit else df


def picked(df: DataFrame, side: DataFrame, rows: int, on: str, how: str = "inner") -> DataFrame:
    """df.join(side, on, how), how being inner, left, left_semi or left_anti, for a wide df (texts) and a side of counted
    rows.  A small side is broadcast.  Of a larger one only a bitmap of its hashed keys is, so that of df only the rows whose
    bit is set are exchanged: those that join, and a few more.  The others cannot join and stay where they are."""
    if rows <= PICKED_ROWS:
        return df.join(F.broadcast(side), on, how)
    words = min(BITMAP_WORDS, 1 << (rows * KEY_BITS // (64 * BITMAP_ROWS)).bit_length())
    row, word, bits = fresh(df, "bitmap_row"), fresh(df, "bitmap_word"), fresh(df, "bitmap")
    hashed = F.xxhash64(F.col(on))
    place = hashed.bitwiseAND(F.lit(BITMAP_ROWS - 1)), F.shiftrightunsigned(hashed, 16).bitwiseAND(F.lit(words - 1)), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(63)).cast("int")
    own = side.select(place[0].alias(row), place[1].alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), place[2]).alias(bits))
    none = df.sparkSession.range(BITMAP_ROWS * words).select((F.col("id") % BITMAP_ROWS).alias(row), F.expr(f"id div {BITMAP_ROWS}").alias(word), F.lit(0).cast("long").alias(bits))
    each = own.unionByName(none).groupBy(row, word).agg(F.bit_or(bits).alias(bits))
    bitmap = F.broadcast(table(each.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(word, bits)))[bits].alias(bits)), "bitmap"))
    held = (F.col(row) == place[0]) & (F.bit_get(F.get(bits, place[1].cast("int")), place[2]) == 1)
    met = df.join(bitmap, held, "left_semi").join(side, on, how)
    return met if how in ("inner", "left_semi") else met.unionByName(df.join(bitmap, held, "left_anti"), allowMissingColumns=True)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (nulls as empty) and its row offsets, both from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LIBC = ctypes.util.find_library("c")


def give_back() -> None:
    """Return freed memory of this Python worker to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    if _LIBC and hasattr(libc := ctypes.CDLL(_LIBC), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back at its end: a worker that waits for its next task then holds little."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return out


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about limit bytes of the text column, and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.diff(utf8(batch.column(column))[1])
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shift, multiply, three rounds)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))
_WORD = np.where(_SPACE, _U(0), _BYTE)
_LOWER_WORD = _WORD[LOWER]
_STEP = _U(0x5851F42D4C957F2D)
_POWER = np.cumprod(np.concatenate([[_U(1)], np.full(4095, _STEP)]).astype(np.uint64))


def _powers(longest: int) -> np.ndarray:
    global _POWER
    while len(_POWER) < longest:
        _POWER = np.concatenate([_POWER, _POWER * (_POWER[-1] * _STEP)])
    return _POWER


def span_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each of the spans that begin at start and tile data from the first of them on."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = np.diff(np.append(start, len(data)))
    within = np.arange(start[0], len(data)) - np.repeat(start, length)
    value = _BYTE[data[start[0] :]] * _powers(int(length.max()) + 1)[within]
    return mix(np.add.reduceat(value, start - start[0]) + length.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


class Words:
    """Words of a run of texts: start, end (byte positions), doc (row), first (first word of each row, n+1 values)."""

    def __init__(self, column):
        self.data, self.offsets = utf8(column)
        n = len(self.data)
        space = _SPACE[self.data]
        before = np.ones(n + 1, bool)
        before[1:] = space
        edges = self.offsets[:-1]
        before[edges] = True
        after = np.ones(n + 1, bool)
        after[:-1] = space
        after[self.offsets[1:]] = True
        word = ~space
        self.start = np.flatnonzero(word & before[:-1])
        self.end = np.flatnonzero(word & after[1:]) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; A-Z count as a-z if lower."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        lead = int(self.start[0])
        gaps = np.diff(np.append(self.start, len(self.data)))
        within = np.arange(lead, len(self.data)) - np.repeat(self.start, gaps)
        value = (_LOWER_WORD if lower else _WORD).take(self.data[lead:])  # 0 for white space after a word
        value *= _powers(int(length.max()) + 1).take(within, mode="clip")
        return mix(np.add.reduceat(value, self.start - lead) + length.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))

    def text(self, i: int, lower: bool = True) -> bytes:
        piece = self.data[self.start[i] : self.end[i]]
        return (LOWER[piece] if lower else piece).tobytes()


def windows(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one row, and the row of each."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(hashes) - k + 1
    total = np.full(m, k, np.uint64)
    for j in range(k):
        total = total * _U(0x9FB21C651E98DF25) + hashes[j : j + m]
    one = words.doc[:m] == words.doc[k - 1 :]
    return mix(total[one]), words.doc[:m][one]


def crc_mod(ids: DataFrame | str, k: int):
    """Column: crc32 of the id's decimal text, modulo k."""
    return F.pmod(F.crc32(F.col(ids).cast("string")), F.lit(k))
