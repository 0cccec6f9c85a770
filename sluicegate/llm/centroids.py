"""Operator 12, centroid clustering with block-norm screening.

A vector is compressed to the norms of its segments, once, beside its components as 32-bit integers.  By Cauchy-Schwarz
the inner product of a vector and a centroid is at most the inner product of their segment norms, so
``|x|^2 + |c|^2 - 2 norms(x).norms(c)`` is a lower bound of their squared distance.  The centroid of the least bound is met
first; its exact distance screens the others, and only those whose bound does not pass it get an exact integer distance.

A round is one pass over the written table: a task holds a block of vectors and the centroids, and sends on the counts
and component sums of its clusters, k * (dim + 1) numbers whatever the rows.  Centroids (k rows) are all that the driver
holds.

Defined results: vectors of another length than dim, null ones and those with a null or non-finite component take no part
and have no row; a vector with a null vec_id is clustered as any other and is a starting centroid after all others;
repeated rows are separate vectors; of equal hashes (a repeated vec_id) the lesser vector starts first; with fewer vectors
than k there are as many centroids as vectors; a table without sound vectors gives no rows; components beyond 2**27 in
size, whose distances may pass 64 bits, raise; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicegate.llm.common import table

#: Components of a segment, vectors that one numpy step holds, and the largest component that is exact in all steps.
SEGMENT, BLOCK, LARGEST = 4, 4096, 1 << 27


def segment_norms(x: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The Euclidean norms of consecutive segments of each row."""
    cuts = np.arange(0, x.shape[1], segment)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, cuts, axis=1))


class Screen:
    """Centroids with their segment norms; counts the pairs met and those that got an exact distance."""

    def __init__(self, centroids: np.ndarray, segment: int = SEGMENT):
        self.c = centroids.astype(np.int64)
        self.norms = segment_norms(self.c, segment)
        self.square = (self.c**2).sum(1).astype(np.float64)
        self.pairs = self.exact = 0

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the number of its nearest centroid, the least of equals, and the squared distance."""
        rows, x = np.arange(len(x)), x.astype(np.int64)
        square = (norms**2).sum(1)
        bound = square[:, None] + self.square - 2 * (norms @ self.norms.T)
        # what rounding can add to a bound: a share of the terms that it is made of
        bound -= 1e-9 * (square[:, None] + self.square) + 1e-6
        cluster = bound.argmin(1)
        best = ((x - self.c[cluster]) ** 2).sum(1)
        bound[rows, cluster] = np.inf
        open_ = bound <= best[:, None]
        self.pairs += open_.size
        self.exact += len(x)
        for k in range(len(self.c)):
            i = np.flatnonzero(open_[:, k])
            i = i[bound[i, k] <= best[i]]  # those that centroids met since then have closed
            self.exact += len(i)
            d = ((x[i] - self.c[k]) ** 2).sum(1)
            better = (d < best[i]) | ((d == best[i]) & (k < cluster[i]))
            i = i[better]
            best[i], cluster[i] = d[better], k
        return cluster, best


def compressed(vectors: DataFrame, dim: int = 64, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x, norms): sound vectors of dim components as floor(scale * component) in little-endian int32, and the norms
    of their segments in float64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = b.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = np.floor(scale * x)
                if len(x) and np.abs(x).max() > LARGEST:
                    raise ValueError(f"components beyond {LARGEST} after scaling are not exact in 64-bit distances")
                out = [_fixed(x.astype("<i4")), _fixed(segment_norms(x).astype("<f8"))]
                yield pa.RecordBatch.from_arrays([b.column(key), *out], [key, "x", "norms"])

    sound = (F.size(vector) == dim) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    kept = kept.where(F.col(vector).isNotNull()).where(sound)
    return kept.mapInArrow(run, f"`{key}` long, x binary, norms binary")


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row."""
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The rows of a binary column whose values all have width numbers of kind."""
    size = np.dtype(kind).itemsize * width
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return data[first : first + size * len(column)].view(kind).reshape(len(column), width)


def start(packed: DataFrame, k: int, salt: str, key: str) -> list[bytes]:
    """The k vectors whose ``salt + key`` has the least hash, as bytes, in that order."""
    order = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256).asc_nulls_last()
    return [bytes(r["x"]) for r in packed.orderBy(order, "x").select("x").limit(k).collect()]


def sums(packed: DataFrame, centroids: np.ndarray, report: bool = False) -> DataFrame:
    """(cluster, place, total): of each cluster the sum of its components at place, and its count at place -1; with report
    (cluster, place, total) of -1 has the pairs met (place 0) and those with an exact distance (place 1)."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = _rows(b.column("x"), "<i4", dim)
                cluster, _ = screen.nearest(x, _rows(b.column("norms"), "<f8", -(-dim // SEGMENT)))
                order = np.argsort(cluster, kind="stable")
                own, first = np.unique(cluster[order], return_index=True)
                total[own] += np.add.reduceat(x[order].astype(np.int64), first, axis=0)
                count += np.bincount(cluster, minlength=len(count))
        met = np.flatnonzero(count)
        if len(met):
            rows = [np.repeat(met, dim + 1), np.tile(np.arange(-1, dim), len(met)), np.column_stack([count[met], total[met]]).reshape(-1)]
            if report:
                rows = [np.append(v, extra) for v, extra in zip(rows, ([-1, -1], [0, 1], [screen.pairs, screen.exact]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in rows], ["cluster", "place", "total"])

    found = packed.select("x", "norms").mapInArrow(run, "cluster long, place long, total long")
    return found.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(centroids: np.ndarray, found: list) -> np.ndarray:
    """The centroids after a round: floors of exact means, empty ones as they were."""
    out = centroids.copy()
    count = {r["cluster"]: int(r["total"]) for r in found if r["place"] == -1}
    for r in found:
        if r["place"] >= 0 and r["cluster"] >= 0:
            out[r["cluster"], r["place"]] = int(r["total"]) // count[r["cluster"]]
    return out


def assigned(packed: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    """(key, cluster, distance) of each vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                cluster, distance = screen.nearest(_rows(b.column("x"), "<i4", dim), _rows(b.column("norms"), "<f8", -(-dim // SEGMENT)))
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(cluster.astype(np.int32)), pa.array(distance)], [key, "cluster", "distance"])

    return packed.mapInArrow(run, f"`{key}` long, cluster int, distance long")


class Clustering:
    """Lloyd's rounds over a table of vectors; ``centroids`` are the final ones."""

    def __init__(self, vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, salt: str = "2:", key: str = "vec_id", vector: str = "embedding"):
        self.key, self.spark = key, vectors.sparkSession
        self.packed = table(compressed(vectors, dim, scale, key, vector), "vectors")
        self.centroids = np.array([np.frombuffer(x, "<i4") for x in start(self.packed, k, salt, key)], np.int64).reshape(-1, dim)
        for _ in range(rounds if len(self.centroids) else 0):
            self.centroids = moved(self.centroids, sums(self.packed, self.centroids).collect())  # k * (dim + 1) rows

    def pruning(self) -> tuple[int, int]:
        """Pairs of vectors and final centroids, and those of them that needed an exact distance."""
        rows = {r["place"]: int(r["total"]) for r in sums(self.packed, self.centroids, report=True).where("cluster = -1").collect()}
        return rows.get(0, 0), rows.get(1, 0)

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids.tolist()]

    def result(self) -> DataFrame:
        """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector."""
        key = self.key
        rows = table(assigned(self.packed, self.centroids, key), "assigned")
        inertia = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
        whole = sum(inertia.values())
        info = [(i, inertia.get(i, 0), whole, d) for i, d in enumerate(self.digests())]
        info = self.spark.createDataFrame(info, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return rows.join(F.broadcast(info), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
