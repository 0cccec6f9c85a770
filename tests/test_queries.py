"""Every registered query beside its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from sluicegate.plans.registry import ORACLES, QUERIES
from tests.conftest import DATA


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        p = f"{DATA}/{t}"
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        assert rows
        return
    r = con.sql(ORACLES[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    ours = sorted((tuple(norm(x[c]) for c in columns) for x in rows), key=repr)
    theirs = sorted((tuple(norm(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert ours == theirs


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
