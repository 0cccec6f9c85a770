"""The k nearest vectors of each query by inner product, exactly, by products of blocks.

Queries and base rows are dealt over blocks of a bounded number of components, and each pair of blocks is one key of an
exchange.  A tile multiplies blocks in pieces, keeps what can still be among a query's k first, computes those products
anew in the order of the components, and sends on about k rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Components of a block, rows of its largest and of its smaller form, and rows and columns of a piece of a product.
CELLS, ROWS, FEW, PIECE = 1 << 20, 16384, 2048, 1024
#: Fixed value: components beyond it could overflow in a product.
LARGEST = 1e150


def sound(vector: str, dim: int):
    """Whether a vector can be multiplied in blocks."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST)), F.lit(False))


def _first(q: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """(kept, kth): the places of the pairs that can be among a query's k first by rounded value, ties to smaller ids, in the
    order of q; and those of each query's k-th pair.  A value near the middle of two roundings counts as either."""
    scaled = value / unit + 0.5
    doubt = 1e-6 + 4e-15 * np.abs(scaled)
    low, high = np.floor(scaled - doubt), np.floor(scaled + doubt)
    order = np.lexsort((ids, -low, q))
    q, low, high, ids = q[order], low[order], high[order], ids[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(q)]))
    place = np.arange(len(q)) - start[of]
    last = np.full(len(start), -1)
    last[of[place == k - 1]] = np.flatnonzero(place == k - 1)
    if not len(q):
        return order, order
    greatest = np.maximum.reduceat(np.where(place < k, ids, np.iinfo(np.int64).min), start)
    bar = np.where(last >= 0, low[last], -np.inf)
    keep = (place < k) | (high > bar[of]) | ((high == bar[of]) & (ids < greatest[of]))
    return order[keep], order[last[last >= 0]]


def _tile(qid, q, qgroup, bid, b, bgroup, k: int, unit: float):
    """(query rows, base rows, product) of the pairs that can be among the k first of their query."""
    scale = np.sqrt((q * q).sum(1)) * np.sqrt((b * b).sum(1).max()) * 1e-12 + 2 * unit
    qt, bt = np.ascontiguousarray(q.T), np.ascontiguousarray(b.T)
    for top in range(0, len(q), PIECE):
        rows = slice(top, min(top + PIECE, len(q)))
        bar = np.full(rows.stop - rows.start, -np.inf)
        at, to, value = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for left in range(0, len(b), PIECE):
            cols = slice(left, min(left + PIECE, len(b)))
            product = q[rows] @ b[cols].T
            product[qid[rows, None] == bid[None, cols]] = -np.inf
            if qgroup is not None:
                product[qgroup[rows, None] == bgroup[None, cols]] = -np.inf
            if product.shape[1] > k:  # the k-th of this piece alone bounds the k-th of all
                bar = np.maximum(bar, np.partition(product, -k, axis=1)[:, -k] - scale[rows]) if left == 0 else bar
            i, j = np.nonzero((product >= bar[:, None]) & (product > -np.inf))
            i, j = i + top, j + left
            exact = np.zeros(len(i))
            for x, y in zip(qt, bt, strict=True):
                exact += x[i] * y[j]
            at, to, value = np.r_[at, i], np.r_[to, j], np.r_[value, exact]
            kept, kth = _first(at, value, bid[to], k, unit)
            bar[at[kth] - top] = np.maximum(bar[at[kth] - top], value[kth] - scale[at[kth]])
            at, to, value = at[kept], to[kept], value[kept]
        yield at, to, value


def _rows(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dim)


def nearest_pairs(queries: DataFrame, base: DataFrame, k: int, digits: int, dim: int, apart: bool, n: int, m: int) -> DataFrame:
    """(query_id, vec_id, product): pairs of n sound queries (query_id, q) and m sound base rows (vec_id, v) with other ids
    (and other values of _group and _own, if apart) that hold the k first of each query."""
    most = max(64, min(ROWS, CELLS // dim))
    asks = max(1, -(-n // most))
    holds = max(1, -(-m // (most if asks >= 8 else max(64, min(most, FEW)))))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = queries.select(F.col("query_id").cast("long"), "q", *(["_group"] if apart else []), deal("query_id", asks).alias("_a"), every(holds).alias("_b"))
    held = base.select(F.col("vec_id").cast("long"), "v", *(["_own"] if apart else []), deal("vec_id", holds).alias("_b"), every(asks).alias("_a"))
    unit = 10.0**-digits

    def codes(x: pa.ChunkedArray, y: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        both = pa.chunked_array([*x.chunks, *y.chunks], x.type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        return both[: len(x)], both[len(x) :]

    def tile(_: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "product": pa.array([], pa.float64())})
        if not len(asked) or not len(held):
            return none
        qid, bid, q, b = asked["query_id"].to_numpy(), held["vec_id"].to_numpy(), _rows(asked["q"], dim), _rows(held["v"], dim)
        qgroup, bgroup = codes(asked["_group"], held["_own"]) if apart else (None, np.zeros(len(b), int))
        # of equal vectors of a group, a query takes those with the k smallest ids beside its own only
        same = np.unique(b, axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((bid, bgroup, same))
        new = np.r_[True, (np.diff(same[order]) != 0) | (np.diff(bgroup[order]) != 0)]
        other = new | np.r_[True, np.diff(bid[order]) != 0]
        nth = np.cumsum(other) - np.cumsum(other)[new][np.cumsum(new) - 1]
        left = np.sort(order[nth <= k])
        bid, b, bgroup = bid[left], b[left], bgroup[left]
        found = [pa.table({"query_id": qid[i], "vec_id": bid[j], "product": v}) for i, j, v in _tile(qid, q, qgroup, bid, b, bgroup, k, unit)]
        return pa.concat_tables(found)

    return asked.groupBy("_a", "_b").cogroup(held.groupBy("_a", "_b")).applyInArrow(tile, "query_id long, vec_id long, product double")
