"""Clusters of vectors that are alike within a group: exact single linkage by blocked products.

Vectors of a group that are equal are one node with its members.  A group's nodes are dealt over blocks, and each pair of a
group's blocks is one key of an exchange, so a group of any size is met in tiles of one size.  A tile first leaves out the
vectors whose products the largest segment norms of the other side bound below the bar (Cauchy-Schwarz), and computes the
rest.  Of the pairs that reach the bar it sends on a star for each set that they connect, at most a link a row, so no
task gives all pairs of a group, and the components of all links are the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicegate.operators.graph import components
from sluicegate.operators.sizes import cut

#: Vectors of a block, and components of a segment.
BLOCK, SEGMENT = 1024, 8


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.reduceat(x * x, np.arange(0, x.shape[1], SEGMENT), axis=1))


def stars(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric relation (with itself in it), the least row that it is connected with."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label[None, :], len(near)).min(1)
        least = least[least]
        if (least == label).all():
            return label
        label = np.minimum(label, least)


def clusters(rows: DataFrame, key: str, group: str, vector: str, least: float, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(key, group, cluster): the smallest key that a row reaches over rows of its group whose inner product is least or more,
    rounded to digits.

    Defined results: rows with a null key, group or vector, an empty vector or a null or non-finite component take no part;
    vectors of different lengths are not alike; repeated keys are one row if their vectors are equal.
    """
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(group).alias("grp"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = cut(own.where("id IS NOT NULL AND grp IS NOT NULL AND v IS NOT NULL").where("size(v) > 0").where(sound).distinct())
    one = own.groupBy("grp", "v").agg(F.min("id").alias("first")).withColumn("dim", F.size("v"))
    one = cut(one.withColumn("node", F.monotonically_increasing_id()))
    many = one.groupBy("grp", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = one.join(many, ["grp", "dim"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to")
    tiles = placed.select("grp", "dim", "node", "v", "block", to).select("grp", "dim", "node", "v", "block", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high"))

    def tile(table: pa.Table) -> pa.Table:
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, table["dim"][0].as_py())
        node, side = table["node"].to_numpy(), table["block"].to_numpy()
        a, b = np.flatnonzero(side == table["low"][0].as_py()), np.flatnonzero(side == table["high"][0].as_py())
        norms, bar = _norms(x), least - 10.0**-digits
        if len(a) and len(b):
            a, b = a[norms[a] @ norms[b].max(0) >= bar], b[norms[b] @ norms[a].max(0) >= bar]
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i = np.unique(np.concatenate([a, b]))
        p, q = np.searchsorted(i, a), np.searchsorted(i, b)
        hit = np.round(x[a] @ x[b].T, digits) >= least
        near = np.eye(len(i), dtype=bool)
        near[np.ix_(p, q)] |= hit
        near[np.ix_(q, p)] |= hit.T
        label = stars(near)
        linked = np.flatnonzero(label != np.arange(len(i)))
        return pa.table({"a": pa.array(node[i[linked]]), "b": pa.array(node[i[label[linked]]])})

    links = cut(tiles.groupBy("grp", "dim", "low", "high").applyInArrow(tile, "a long, b long"))
    found = components(links, one.select(F.col("node").alias("id"))).withColumnRenamed("id", "node")
    named = one.join(found, "node")
    least_key = named.groupBy("cluster").agg(F.min("first").alias("name"))
    named = named.join(least_key, "cluster").select("grp", "v", "name")
    return own.join(named, ["grp", "v"]).select(F.col("id").alias(key), F.col("grp").alias(group), F.col("name").alias("cluster"))
