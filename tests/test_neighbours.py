"""The k nearest vectors against plain loops."""

import math
import random

from pyspark.sql import functions as F

from sluicegate.operators import corpus as O, neighbours as N


def _brute(rows, queries, k, apart):
    out = []
    for i, g, q in queries:
        sims = []
        for j, h, v in rows:
            if i == j or (apart and g == h):
                continue
            s = 0.0
            for a, b in zip(q, v):
                s += a * b
            sims.append((-math.floor(s * 1e6 + 0.5) / 1e6, j))
        out += [(i, j, -s, r + 1) for r, (s, j) in enumerate(sorted(sims)[:k])]
    return sorted(out)


def test_nearest_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "CELLS", 512)  # many blocks and pieces
    monkeypatch.setattr(N, "PIECE", 16)
    rng = random.Random(5)
    pool = [[rng.randint(-8, 8) / 8 for _ in range(4)] for _ in range(60)]
    rows = [(i, i % 3, pool[rng.randrange(60)] if i % 4 else pool[0]) for i in range(400)]  # a quarter are copies of one
    df = spark.createDataFrame(rows, "vec_id long, fold int, v array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "fold")
    for apart in (None, "fold"):
        found = O.nearest(asked, df, 7, apart=apart)
        assert sorted(map(tuple, found.select("query_id", "vec_id", "sim", "rank").collect())) == _brute(rows, rows, 7, apart)
        pairs = N.nearest_pairs(asked.withColumnRenamed("fold", "_group"), df.withColumnRenamed("fold", "_own"), 7, 6, 4, apart is not None, 400, 400)
        assert pairs.count() <= 400 * 4 * 2 * 7 * 2  # not all pairs leave a task


def test_nearest_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0]), (5, [float("nan"), 0.0]), (6, [0.2, None])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = O.nearest(df.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), df, 5)
    first = {r["query_id"]: r["vec_id"] for r in got.where("rank = 1").collect()}
    assert got.count() == 30 and first[1] == 5 and first[2] == 5
    assert [r["vec_id"] for r in got.where("query_id = 1").orderBy("rank").collect()] == [5, 2, 3, 4, 6]
    assert O.nearest(df.limit(0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), df, 5).count() == 0
