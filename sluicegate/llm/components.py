"""Connected components of an edge table by label propagation to the smallest neighbour with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluicegate.llm.common import table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each id of the edges and the smallest id reachable from it.  Edges with a null end or with equal
    ends link nothing.

    Every round takes the least label among a node's neighbours and then the label of that label; written tables in the
    shared folder cut the lineage.  Only the number of changes comes to the driver.
    """
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).unionByName(edges.select(F.col(b).alias("id"), F.col(a).alias("to"))).where("id <> to").distinct()
    both = table(both, "edges")
    labels = table(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        # the label of the new label: a node that is a label has one itself
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("beyond"))
        step = step.join(jump, "next", "left").select("id", F.col("component").alias("old"), F.least("next", F.coalesce("beyond", "next")).alias("component"))
        step = table(step, "labels")
        changed = step.where("component < old").limit(1).count()
        labels = step.select("id", "component")
        if not changed:
            return labels
