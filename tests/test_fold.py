"""The rule learner against a loop over lists, and its edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sluicegate.operators import fold

OPS = {"<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}


def by_loop(rows, features, longest=3, deepest=2, most=6):
    """Rules as nested tuples (literals, exceptions), from lists of (features, label)."""

    def ok(lit, x):
        f, op, v = lit
        return x[f] is not None and not (isinstance(x[f], float) and math.isnan(x[f])) and OPS[op](x[f], v)

    def fires(rule, x):
        return all(ok(lit, x) for lit in rule[0]) and not any(fires(e, x) for e in rule[1])

    def grow(pos, neg, depth, least):
        lits = []
        for f in features:
            seen = [x[f] for x in pos + neg if x[f] is not None and not (isinstance(x[f], float) and math.isnan(x[f]))]
            if seen and isinstance(seen[0], bool | str):
                lits += [(f, "==", v) for v in sorted(set(seen), key=str)]
            elif seen:
                seen.sort()
                lits += [(f, op, v) for v in sorted({seen[int(q * (len(seen) - 1))] for q in fold.SHARES}) for op in ("<=", ">")]
        out, rest = [], pos
        while len(rest) >= least and len(out) < most:
            rule, p, n = [], rest, neg
            while n and len(rule) < longest:
                scored = []
                for k, lit in enumerate(lits):
                    if any(lit[:2] == r[:2] for r in rule):
                        continue
                    a, b = sum(ok(lit, x) for x in p), sum(ok(lit, x) for x in n)
                    scored.append((fold.gain(a, len(p) - a, len(n) - b, b), -k))
                if not scored or max(scored)[0] == -math.inf:
                    break
                lit = lits[-max(scored)[1]]
                p2, n2 = [x for x in p if ok(lit, x)], [x for x in n if ok(lit, x)]
                if (len(p2), len(n2)) == (len(p), len(n)):
                    break
                rule.append(lit)
                p, n = p2, n2
            if not rule or len(p) < least:
                break
            out.append((rule, grow(n, p, depth + 1, 2) if n and depth < deepest else []))
            rest = [x for x in rest if not fires(out[-1], x)]
        return out

    found = grow([x for x, y in rows if y], [x for x, y in rows if not y], 0, 5)
    return found, fires


def plain(rule):
    return [(x.feature, x.op, x.value) for x in rule.literals], [plain(e) for e in rule.exceptions]


def flights(rng, n):
    """Birds fly unless they are penguins, unless those are carried; others fly if they are light and fast."""
    out = []
    for _ in range(n):
        kind = rng.choice(["bird", "bird", "penguin", "cat", None])
        weight, fast, speed = rng.choice([round(rng.random() * 10, 1), None]), rng.random() < 0.4, float(rng.randrange(20))
        flies = kind == "bird" or (kind == "penguin" and fast) or (kind == "cat" and weight is not None and weight <= 3 and speed > 12)
        out.append(({"kind": kind, "weight": weight, "fast": fast, "speed": speed}, flies ^ (rng.random() < 0.03)))
    return out


@pytest.mark.parametrize("seed,n,longest", [(1, 200, 1), (2, 300, 2), (3, 150, 3)])
def test_same_rules_as_a_loop(spark, seed, n, longest):
    rows = flights(random.Random(seed), n)
    names = ["kind", "weight", "fast", "speed"]
    d = spark.createDataFrame([(x["kind"], x["weight"], x["fast"], x["speed"], y) for x, y in rows], "kind string, weight double, fast boolean, speed double, y boolean")
    expected, fires = by_loop(rows, names, longest)
    got = fold.learn(d, "y", names, 0.0, longest=longest)
    assert [plain(r) for r in got] == [(a, [(c, e) for c, e in b]) for a, b in expected]
    assert longest > 1 or any(r.exceptions for r in got)
    told = {r["rule"]: (r["covered"], r["right"]) for r in fold.covered(d, "y", got).collect()}
    assert told == {i: (sum(fires(r, x) for x, _ in rows), sum(fires(r, x) and y for x, y in rows)) for i, r in enumerate(expected)}
    # the floor drops rules, not literals
    sharp = fold.learn(d, "y", names, 0.95, longest=longest)
    assert [plain(r) for r in sharp] == [plain(r) for i, r in enumerate(got) if told[i][1] / told[i][0] >= 0.95] and len(sharp) < len(got) + 1


def test_edges(spark):
    kind = "a double, b string, y boolean"
    assert fold.learn(spark.createDataFrame([], kind), "y", ["a", "b"]) == []
    assert fold.learn(spark.createDataFrame([(1.0, "x", False)] * 9 + [(2.0, "x", None)], kind), "y", ["a", "b"]) == []
    same = spark.createDataFrame([(1.0, "x", True)] * 9 + [(1.0, "x", False)] * 3, kind)
    assert fold.learn(same, "y", ["a", "b"], 0.0) == []
    odd = spark.createDataFrame([(float("nan"), None, True)] * 6 + [(5.0, "x", True)] * 6 + [(1.0, "x", False)] * 6, kind)
    rules = fold.learn(odd, "y", ["a", "b"])
    assert [str(r) for r in rules] == ["a > 1"]
    assert fold.covered(odd, "y", rules).collect()[0]["covered"] == 6 and fold.covered(odd, "y", []).count() == 0
    with pytest.raises(ValueError, match="bucket"):
        fold.learn(spark.createDataFrame([(1.0, str(i), i % 2 == 0) for i in range(fold.VALUES + 5)], kind), "y", ["a", "b"])


def test_literals_are_counted_on_columns(spark):
    """As by the conditions themselves, over nulls, NaN, decimals and several partitions."""
    rows = [(None if i % 11 == 0 else i % 3 == 0, None if i % 5 == 0 else "ab"[i % 2], None if i % 4 == 0 else i % 3 == 1, float("nan") if i % 7 == 0 else None if i % 6 == 0 else i / 3, i, i % 9) for i in range(90)]
    df = spark.createDataFrame(rows, "y boolean, s string, b boolean, x double, i int, n long").withColumn("m", F.col("n").cast("decimal(9,2)")).repartition(5)
    own = fold.Learner(df, "y", ["s", "b", "x", "i", "m"])
    y = F.col("_y")
    choices = fold.literals(own.rows, own.features)
    assert len({x.feature for x in choices}) == 5
    for pos, neg in ((y, ~y), (y & (F.col("i") > 40), ~y & (F.col("i") > 40)), (y & F.col("b"), ~y), (F.lit(False), F.lit(False))):
        assert own.met(pos, neg, choices) == own.counts(pos, neg, [x.column() for x in choices])
