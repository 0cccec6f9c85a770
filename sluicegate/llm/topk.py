"""Operator 5, exact top-k search by multi-resolution segment statistics.

Every vector keeps, at several resolutions, the means and deviations of its segments.  For a segment of length L the
inner product is at most L (mean mean' + dev dev'), so the squared distance |q|^2 + |v|^2 - 2 q.v has a lower bound from
the statistics alone.  A block of candidates is met coarse to fine: pairs whose bound cannot reach the query's k-th best
score so far are dropped, and only survivors get the exact integer product.

Queries are packed in groups of at most ``group`` vectors, candidates in blocks; each (group, stripe of candidates) is
one key of one exchange, so a task holds one group of queries and streams its stripe.  A stripe gives k rows a query.

Defined results: vectors that are null or hold a null or non-finite component take no part; a query meets candidates
of its own length only; rows with the query's own vec_id are never its candidates; repeated rows are separate
candidates; a null vec_id is no query and no candidate; a query that occurs more than once counts once, by the least of
its vectors that take part; scores that may pass 2**53 in size, where doubles are no longer exact, raise; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

#: Queries that one task holds, candidates in a block.
GROUP, BLOCK = 4096, 2048
#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that a product of two rows bounds their inner product."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    lengths = np.diff(cuts)
    sums = np.add.reduceat(x, cuts[:-1], axis=1)
    squares = np.add.reduceat(x * x, cuts[:-1], axis=1)
    mean = sums / lengths
    dev = np.sqrt(np.maximum(squares / lengths - mean**2, 0))
    return np.hstack([mean, dev]) * np.sqrt(np.hstack([lengths, lengths]))


class Best:
    """The k best candidates so far of a group of queries: score descending, then vec_id ascending."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.norm = np.sqrt((x * x).sum(1).max()) if len(x) else 0.0
        self.stats = [statistics(x, s) for s in RESOLUTIONS]
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.pairs = self.exact = 0

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        if len(x) and self.norm * np.sqrt((x * x).sum(1).max()) >= 2**53:
            raise ValueError("inner products beyond 2**53 are not exact in doubles")
        bar = self.score[:, -1]
        live = None
        for own, s in zip(self.stats, RESOLUTIONS, strict=True):
            other = statistics(x, s)
            if live is None:
                q, c = np.nonzero(own @ other.T >= (bar - 1e-6 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0))))[:, None])
            elif len(live[0]) > 0.1 * len(self.ids) * len(ids):
                break  # few pairs fell; the product of whole blocks is cheaper than the finer bound
            else:
                q, c = live
                keep = np.einsum("ij,ij->i", own[q], other[c]) >= bar[q] - 1e-6 * (1 + np.abs(np.where(np.isfinite(bar[q]), bar[q], 0)))
                q, c = q[keep], c[keep]
            live = q, c
        q, c = live
        self.pairs += len(self.ids) * len(ids)
        self.exact += len(q)
        if len(q) > 0.1 * len(self.ids) * len(ids):
            score = (self.x @ x.T)[q, c]  # integers below 2**53, exact in doubles
        else:
            score = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.x[q[a : a + 65536]], x[c[a : a + 65536]]) for a in range(0, len(q), 65536))])
        keep = (self.ids[q] != ids[c]) & (score >= bar[q])
        q, c, score = q[keep], c[keep], score[keep]
        # old and new candidates of each query, best first
        touched = np.unique(q)
        if not len(touched):
            return
        row = np.concatenate([np.repeat(touched, self.k), q])
        s = np.concatenate([self.score[touched].reshape(-1), score])
        v = np.concatenate([self.vec[touched].reshape(-1), ids[c]])
        order = np.lexsort((v, -s, row))
        row, s, v = row[order], s[order], v[order]
        first = np.searchsorted(row, touched)
        pick = (first[:, None] + np.arange(self.k)).reshape(-1)
        self.score[touched], self.vec[touched] = s[pick].reshape(-1, self.k), v[pick].reshape(-1, self.k)


def pack(vectors: DataFrame, rows: int, scale: float | None, key: str, vector: str) -> DataFrame:
    """(dim, ids, values): blocks of at most rows vectors of one length; with scale, components become floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, values = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.array(values, "<f8").tobytes()])], ["dim", "ids", "values"])

        for b in batches:
            column = b.column(vector)
            flat, at = column.flatten(), np.concatenate([[0], np.cumsum([len(v) if v is not None else 0 for v in column.to_pylist()] if column.null_count else np.diff(column.offsets.to_numpy()))])
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            x = x if scale is None else np.floor(scale * x)
            for i, name in enumerate(b.column(key).to_pylist()):
                v = x[at[i] : at[i + 1]]
                if name is None or not len(v) or not np.isfinite(v).all():
                    continue
                held.setdefault(len(v), []).append((name, v))
                if len(held[len(v)]) == rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return vectors.select(F.col(key).cast("long").alias(key), vector).where(F.col(vector).isNotNull()).mapInArrow(run, "dim int, ids binary, values binary")


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: float | None = 256.0, key: str = "vec_id", vector: str = "embedding", group: int = GROUP, report: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the highest inner product for each query; with report instead
    (pairs, exact): the pairs that met, and those that the bounds left for the exact product."""
    spark = queries.sparkSession
    # a vector without part in the search is no vector of its query, whatever its place in the order
    sound = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(sound).groupBy(F.col(key).cast("long").alias(key)).agg(F.min(vector).alias(vector))
    n = one.count()
    groups = max(1, -(-n // group))
    stripes = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups))
    # both numbers follow the input and the cluster; a stripe's candidates pass through once for each group of queries
    own = pack(one.repartition(groups, F.pmod(F.xxhash64(key), F.lit(groups))), group, scale, key, vector)
    asked = own.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("kind"))
    met = pack(candidates, BLOCK, scale, key, vector).withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int"))
    met = met.select("dim", "ids", "values", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "stripe", F.lit(1).alias("kind"))
    both = asked.select("g", "stripe", "dim", "kind", "ids", "values").unionByName(met)
    both = both.repartition(groups * stripes, "g", "stripe").sortWithinPartitions("g", "stripe", "dim", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, []

        def out() -> Iterator[pa.RecordBatch]:
            for b in best:
                if report:
                    yield pa.RecordBatch.from_arrays([pa.array([b.pairs]), pa.array([b.exact]), pa.array([0])], ["query_id", "vec_id", "score"])
                    continue
                q, r = np.nonzero(np.isfinite(b.score))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[q]), pa.array(b.vec[q, r]), pa.array(b.score[q, r].astype(np.int64) if scale is not None else b.score[q, r])], ["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                g, stripe, dim, kind = (batch.column(c)[i].as_py() for c in ("g", "stripe", "dim", "kind"))
                if (g, stripe, dim) != at:
                    yield from out()
                    at, best = (g, stripe, dim), []
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), "<i8")
                x = np.frombuffer(batch.column("values")[i].as_buffer(), "<f8").reshape(len(ids), dim)
                if kind == 0:
                    best.append(Best(ids.copy(), x.copy(), k))
                else:
                    for b in best:
                        b.meet(ids, x)
        yield from out()

    kind = "double" if scale is None and not report else "long"
    found = both.mapInArrow(run, f"query_id long, vec_id long, score {kind}")
    if report:
        return found.agg(F.sum("query_id").alias("pairs"), F.sum("vec_id").alias("exact"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
