"""Sizes that decide on a join, and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, which are counted up to that, else df as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.  Only a session within one machine may leave
    that setting out."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir")
        if not found:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="sluicegate-")
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back from it: later jobs start there, and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
