"""Clusters of like vectors against all pairs."""

import numpy as np
import pytest

from sluicegate.operators import dense


def by_pairs(rows, least):
    label = list(range(len(rows)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i, (_, g, u) in enumerate(rows):
        for j, (_, h, v) in enumerate(rows[:i]):
            if g == h and len(u) == len(v) and (list(u) == list(v) or round(float(np.dot(u, v)), 6) >= least):
                label[find(i)] = find(j)
    name = {}
    for i, r in enumerate(rows):
        name[find(i)] = min(name.get(find(i), r[0]), r[0])
    return sorted((r[0], r[1], name[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 40, 7])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (12, 16))
    rows = []
    for i in range(200):
        v = middle[i % 12] + rng.normal(0, 0.35, 16)
        rows.append((int(i), "ab"[i % 2], [float(x) for x in v / np.linalg.norm(v)]))
    rows += [(300 + i, "a", rows[0][2]) for i in range(20)] + [(5, "b", rows[4][2]), (500, "a", [1.0, 0.0]), (501, "a", [0.1, 0.2])]
    d = spark.createDataFrame(rows, "id long, field string, v array<double>").repartition(3)
    got = sorted(map(tuple, dense.clusters(d, "id", "field", "v", 0.9, block=block).collect()))
    assert got == by_pairs(rows, 0.9) and len({r[2] for r in got}) < 60


def test_edges(spark):
    nan = float("nan")
    d = spark.createDataFrame([(1, "a", None), (2, "a", []), (3, "a", [nan]), (4, "a", [None]), (None, "a", [1.0]), (5, None, [1.0]), (6, "a", [2.0]), (6, "a", [2.0])], "id long, field string, v array<double>").selectExpr("*", "1 AS node", "2 AS cluster")
    assert [tuple(r) for r in dense.clusters(d, "id", "field", "v", 0.9).collect()] == [(6, "a", 6)]
    assert dense.clusters(d.limit(0), "id", "field", "v", 0.9).count() == 0
