"""The registry that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to digits decimals, long counts as they are; the order of sums then no longer shows."""

    def of(name: str, kind: str) -> Column:
        return F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`").cast("long").alias(name) if kind in ("decimal(20,0)", "decimal(38,0)") else F.col(f"`{name}`")

    return df.select(*(of(n, k) for n, k in df.dtypes))
