"""Default rules with exceptions, learned from labelled rows by information gain.

A rule is a conjunction of literals (feature <= v, feature > v, feature == v) and not one of its exceptions, which are rules
themselves.  Rules cover the positives one after the other: a literal at a time, the one of the highest gain, until no
negative is left, no literal changes what is covered or the rule is long enough.  The negatives that a rule still covers
are then the positives of a search for its exceptions.

Each step is one pass over the rows: tasks count every literal among the positives and negatives that the rule covers so
far, on whole columns, and their counts are summed.  What has been decided is a condition on the features, so no rows are moved or collected; thresholds are
elements at exact ranks, read from quantile sketches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.operators.sizes import cut

#: Shares of a numeric feature's order at which its thresholds lie.
SHARES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
#: Values of a text or boolean feature that get a literal; more of them raise.
VALUES = 1000


@dataclass(frozen=True)
class Literal:
    feature: str
    op: str
    value: object

    def column(self) -> Column:
        """Whether it holds; a null (or NaN) feature holds for nothing."""
        x = F.col(f"`{self.feature}`")
        test = x == self.value if self.op == "==" else x <= self.value if self.op == "<=" else x > self.value
        sound = x.isNotNull() if self.op == "==" else x.isNotNull() & ~F.isnan(x.cast("double"))
        return sound & test

    def mask(self, x: pa.Array) -> np.ndarray:
        """Whether it holds, for the values of a batch."""
        if self.op == "==":
            return pc.fill_null(pc.equal(x, pa.scalar(self.value, x.type)), False).to_numpy(zero_copy_only=False)
        v = pc.cast(x, pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # nulls are NaN
        return v <= self.value if self.op == "<=" else v > self.value

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.value:.3g}" if isinstance(self.value, float) else f"{self.feature} {self.op} {self.value}"


@dataclass
class Rule:
    literals: list[Literal]
    exceptions: list[Rule] = field(default_factory=list)

    def column(self) -> Column:
        return every(x.column() for x in self.literals) & ~holds(self.exceptions)

    def __str__(self) -> str:
        said = " and ".join(map(str, self.literals))
        return said + "".join(f" unless ({e})" for e in self.exceptions)


def every(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def holds(rules: list[Rule]) -> Column:
    """Whether any of the rules holds; false without rules."""
    out = F.lit(False)
    for r in rules:
        out = out | r.column()
    return F.coalesce(out, F.lit(False))


def gain(tp: int, fn: int, tn: int, fp: int) -> float:
    """Less the entropy of what a literal covers and of what it leaves, by their shares; a literal that covers as many
    negatives as positives loses 1, and one without positives is no choice."""
    if not tp:
        return -math.inf

    def entropy(a: int, b: int) -> float:
        return -sum(x / (a + b) * math.log2(x / (a + b)) for x in (a, b)) if a and b else 0.0

    n = tp + fn + tn + fp
    return -((tp + fp) / n * entropy(tp, fp) + (tn + fn) / n * entropy(tn, fn)) - (0.0 if tp > fp else 1.0)


def literals(rows: DataFrame, features: list[str]) -> list[Literal]:
    """The literals of the features over rows: each value of a text or boolean one, and both sides of each threshold."""
    kinds = dict(rows.dtypes)
    numeric = [f for f in features if kinds[f] not in ("string", "boolean")]
    sound = {f: F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")) for f in numeric}
    counts = rows.agg(*(F.count(sound[f]).alias(f) for f in numeric)).first() if numeric else None
    used = [f for f in numeric if counts[f]]
    # the element of rank int(share * (n - 1)), from 0: half a rank above it leaves no doubt about the sketch's rounding
    at = {f: [(int(q * (counts[f] - 1)) + 0.5) / counts[f] for q in SHARES] for f in used}
    cuts = rows.agg(*(F.percentile_approx(sound[f], at[f], 1_000_000).alias(f) for f in used)).first() if used else None
    out = []
    for f in features:
        if f in numeric:
            out += [Literal(f, op, v) for v in sorted(set(cuts[f])) for op in ("<=", ">")] if f in used else []
            continue
        found = [r[0] for r in rows.select(f"`{f}`").where(F.col(f"`{f}`").isNotNull()).distinct().limit(VALUES + 1).collect()]
        if len(found) > VALUES:
            raise ValueError(f"{f} has more than {VALUES} values; bucket it first")
        out += [Literal(f, "==", v) for v in sorted(found, key=str)]
    return out


class Learner:
    def __init__(self, rows: DataFrame, label: str, features: list[str], longest: int = 3, deepest: int = 2, most: int = 6):
        self.rows = cut(rows.select(F.col(f"`{label}`").cast("boolean").alias("_y"), *(f"`{f}`" for f in features)).where("_y IS NOT NULL"))
        self.features, self.longest, self.deepest, self.most = features, longest, deepest, most

    def counts(self, pos: Column, neg: Column, tests: list[Column]) -> list[tuple[int, int]]:
        """(positives, negatives) for which each test holds."""
        pick = [F.count_if(side & t).alias(f"{s}{i}") for i, t in enumerate(tests) for s, side in (("p", pos), ("n", neg))]
        r = self.rows.where(pos | neg).agg(*pick).first()
        return [(r[f"p{i}"], r[f"n{i}"]) for i in range(len(tests))]

    def met(self, pos: Column, neg: Column, choices: list[Literal]) -> list[tuple[int, int]]:
        """(positives, negatives) for which each literal holds: two counts of each task and literal are summed."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(choices), 2), np.int64)
            for b in batches:
                side = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("_p", "_n")])
                for i, x in enumerate(choices):
                    total[i] += side[x.mask(b.column(x.feature))].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(choices))), pa.array(total[:, 0]), pa.array(total[:, 1])], ["i", "p", "n"])

        sides = [F.coalesce(c, F.lit(False)).alias(n) for c, n in ((pos, "_p"), (neg, "_n"))]
        used = dict.fromkeys(x.feature for x in choices)
        found = self.rows.where(pos | neg).select(*sides, *(f"`{f}`" for f in used)).mapInArrow(count, "i long, p long, n long")
        sums = {r["i"]: (r["p"], r["n"]) for r in found.groupBy("i").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}  # a row for each literal
        return [sums.get(i, (0, 0)) for i in range(len(choices))]

    def rule(self, pos: Column, neg: Column, choices: list[Literal]) -> tuple[list[Literal], int, int]:
        """The literals of one rule, and the positives and negatives that it covers."""
        chosen: list[Literal] = []
        p, n = self.counts(pos, neg, [F.lit(True)])[0]
        while n and len(chosen) < self.longest:
            taken = {(x.feature, x.op) for x in chosen}
            left = [x for x in choices if (x.feature, x.op) not in taken]
            if not left:
                break
            now = every(x.column() for x in chosen)
            met = self.met(pos & now, neg & now, left)
            gains = [gain(tp, p - tp, n - fp, fp) for tp, fp in met]
            best = max(range(len(left)), key=gains.__getitem__)  # the first of equals
            if gains[best] == -math.inf or met[best] == (p, n):
                break
            chosen.append(left[best])
            p, n = met[best]
        return chosen, p, n

    def rules(self, pos: Column, neg: Column, depth: int = 0, least: int = 5) -> list[Rule]:
        choices = literals(self.rows.where(pos | neg), self.features)
        out: list[Rule] = []
        left, many = pos, self.counts(pos, neg, [F.lit(True)])[0][0]
        while many >= least and len(out) < self.most:
            chosen, p, n = self.rule(left, neg, choices)
            if not chosen or p < least:
                break
            found = Rule(chosen)
            if n and depth < self.deepest:
                now = every(x.column() for x in chosen)
                found.exceptions = self.rules(neg & now, left & now, depth + 1, 2)
            out.append(found)
            left = left & ~F.coalesce(found.column(), F.lit(False))
            many = self.counts(left, neg, [F.lit(True)])[0][0]
        return out


def learn(rows: DataFrame, label: str, features: list[str], least_precision: float = 0.98, **options) -> list[Rule]:
    """The rules for the rows whose label is true that are right on at least least_precision of the rows they cover.

    Defined results: rows with a null label take no part; null and NaN features hold for no literal; without positives,
    or with features that tell nothing apart, there are no rules; repeated rows count as often as they occur.
    """
    own = Learner(rows, label, features, **options)
    y = F.col("_y")
    found = own.rules(y, ~y)
    return [r for r, (p, n) in zip(found, own.counts(y, ~y, [r.column() for r in found]), strict=True) if p + n and p / (p + n) >= least_precision] if found else []


def covered(rows: DataFrame, label: str, rules: list[Rule]) -> DataFrame:
    """(rule, said, covered, right): each rule's rows, and those of them whose label is true."""
    y = F.coalesce(F.col(f"`{label}`").cast("boolean"), F.lit(False))
    told = [F.struct(F.lit(i).alias("rule"), F.lit(str(r)).alias("said"), F.count_if(r.column()).alias("covered"), F.count_if(r.column() & y).alias("right")) for i, r in enumerate(rules)]
    if not told:
        return rows.sparkSession.createDataFrame([], "rule int, said string, covered long, right long")
    return rows.agg(F.array(*told).alias("r")).select(F.inline("r"))
