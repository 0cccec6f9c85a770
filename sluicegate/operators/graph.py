"""Components and descendants of edge tables, without bound on their length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluicegate.operators.sizes import cut


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, cluster): the smallest id reachable over edges (a, b), for each id of nodes.

    Each round takes the least label among a node's neighbours and then that label's label (pointer jumping), until
    nothing changes, so a path takes rounds in the order of the logarithm of its length.  Null ends link nothing.
    """
    ends = edges.select("a", "b").where("a <> b")
    both = cut(ends.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(ends.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct())
    labels = cut(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        beyond = labels.select(F.col("id").alias("next"), F.col("label").alias("beyond"))
        step = cut(step.join(beyond, "next", "left").select("id", "old", F.least("next", F.coalesce("beyond", "next")).alias("label")))
        labels = step.select("id", "label")
        if step.where("label < old").isEmpty():
            return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("cluster"))


def descendants(edges: DataFrame, root: int) -> DataFrame:
    """(node, depth): root and the distinct nodes below it over (parent, child), with their least depth.

    A level at a time, from the nodes first met in the one before; nodes met already go no further, so that cycles end
    and a node on many paths comes once.
    """
    spark = edges.sparkSession
    links = cut(edges.select(F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child")).where("child is not null").distinct())
    seen = front = spark.createDataFrame([(root, 0)], "node long, depth int")
    depth = 0
    while True:
        depth += 1
        new = links.join(front.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        front = cut(new.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front)) if depth % 16 == 0 else seen.unionByName(front)


def path_to_root(edges: DataFrame, node: int) -> DataFrame:
    """(node, height): node and its ancestors over (parent, child), with their least distance."""
    up = descendants(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")), node)
    return up.withColumnRenamed("depth", "height")
