"""Constructions over several models: a stacked classifier against a plain descent, reliability tables, diversity, bootstrap."""

import random
from statistics import NormalDist

import numpy as np

from sluicegate.operators import boot, classification as C, stacking


def descend(x, y, k, strength, rounds=6000):
    """Balanced multinomial regression by gradient descent on the summed, weighted losses."""
    n, d = x.shape
    w, b = np.zeros((k, d)), np.zeros(k)
    weight = n / (len(set(y)) * np.bincount(y, minlength=k)[y])
    one = np.eye(k)[y]
    for _ in range(rounds):
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - one) * weight[:, None]
        w -= 2.0 / n * (g.T @ x + w / strength)
        b -= 2.0 / n * g.sum(0)
    return w, b


def test_stacked_against_descent(spark):
    rng = np.random.default_rng(2)
    n, k = 240, 3
    y = rng.choice(k, n, p=[0.6, 0.3, 0.1])
    x = np.eye(k)[y] * 0.8 + rng.normal(0, 0.6, (n, k))
    x = np.hstack([x, rng.normal(0, 1, (n, 2))])
    fold = np.arange(n) % 3
    rows = [(int(i), int(fold[i]), int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    got = {r["item_idx"]: r for r in stacking.stacked(spark.createDataFrame(rows, "item_idx long, fold int, gold int, x array<double>")).collect()}
    assert len(got) == n
    agree, off = 0, []
    for f in range(3):
        w, b = descend(x[fold != f], y[fold != f], k, 1.0)
        for i in np.flatnonzero(fold == f):
            z = x[i] @ w.T + b
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            agree += got[i]["pred"] == p.argmax() and got[i]["gold"] == y[i]
            off.append(abs(got[i]["conf"] - p.max()))
    assert agree >= n - 1 and max(off) < 0.01


def test_stacked_edges(spark):
    kind = "item_idx long, fold int, gold int, x array<double>"
    one = spark.createDataFrame([(i, i % 2, 0 if i % 2 else i % 4 // 2, [1.0]) for i in range(8)], kind)
    got = {r["item_idx"]: r["pred"] for r in stacking.stacked(one).collect()}
    assert all(got[i] == 0 for i in range(0, 8, 2)) and len(got) == 8  # fold 1 has one class only
    assert stacking.stacked(spark.createDataFrame([], kind)).count() == 0


def test_reliability_falls_back_to_the_class(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        gold = rng.randrange(3)
        for m, p in (("a", 0.9), ("b", 0.5)):
            rows.append((i, i % 3, gold, m, gold if rng.random() < p else rng.randrange(3), rng.choice([0.1, 0.6, 0.65, 0.85, 0.95, 1.0])))
    d = spark.createDataFrame(rows, "item_idx long, fold int, gold int, model string, pred int, conf double")
    edge = lambda c: sum(c >= e for e in stacking.EDGES[1:])
    for least in (1, 25, 10**6):
        got = {r["item_idx"]: (r["model"], r["pred"], round(r["reliability"], 9)) for r in stacking.reliability_selection(d, least=least).collect()}
        for i, f, _, _, _, _ in rows[::14]:
            scored = []
            for _, _, _, m, p, c in (r for r in rows if r[0] == i):
                same = [r for r in rows if r[1] != f and r[3] == m and r[4] == p]
                near = [r for r in same if edge(r[5]) == edge(c)]
                use = near if len(near) >= least else same
                scored.append((-sum(r[2] == p for r in use) / len(use) if use else 0.0, m, p))
            s, m, p = min(scored)
            assert got[i] == (m, p, round(-s, 9))


def test_choice_takes_a_sure_winner(spark):
    rng = random.Random(4)
    rows, made = [], []
    for i in range(400):
        gold = rng.randrange(2)
        say = lambda p: gold if rng.random() < p else 1 - gold  # noqa: B023, E731
        rows += [(i, gold, "a", say(0.7)), (i, gold, "b", say(0.6))]
        made += [(i, gold, "good", say(0.97)), (i, gold, "same", rows[-2][3])]
    kind = "item_idx long, gold int, model string, pred int"
    got = {r["model"]: r for r in stacking.choice(spark.createDataFrame(rows, kind), spark.createDataFrame(made, kind)).collect()}
    assert set(got) == {"a", "good", "same"} and got["good"]["chosen"] and not got["a"]["chosen"]
    none = stacking.choice(spark.createDataFrame(rows, kind), spark.createDataFrame([m for m in made if m[2] == "same"], kind)).collect()
    assert {r["model"]: r["chosen"] for r in none} == {"a": True, "same": False}


def test_independent_oracle_is_the_mean_of_deals(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, m, i % 3 if rng.random() < p else 9) for i in range(90) for m, p in (("a", 0.5), ("b", 0.4), ("c", 0.7))]
    r = C.pool_diversity(spark.createDataFrame(rows, "item_idx long, gold int, model string, pred int")).first()
    hits = {(m, c): [int(p == g) for _, g, n, p in rows if n == m and g == c] for m in "abc" for c in range(3)}
    sims = []
    for _ in range(3000):
        per = []
        for c in range(3):
            dealt = [rng.sample(hits[m, c], len(hits[m, c])) for m in "abc"]
            per.append(np.mean([any(x) for x in zip(*dealt)]))
        sims.append(np.mean(per))
    assert abs(r["oracle_if_independent"] - np.mean(sims)) < 0.003
    best = max(np.mean([np.mean(hits[m, c]) for c in range(3)]) for m in "abc")
    assert abs(r["diversity_ratio"] - (r["oracle_balanced"] - best) / (r["oracle_if_independent"] - best)) < 1e-9


def test_corrected_interval(spark):
    rng = np.random.default_rng(6)
    x = rng.exponential(1.0, 80)
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    reps = boot.replicates(d, "id", "v", 300, "bca").cache()
    got = boot.corrected_interval(d, "v", reps).first()
    left_out = np.array([(x.sum() - v) / (len(x) - 1) for v in x])
    u = left_out.mean() - left_out
    a = (u**3).sum() / (6 * (u**2).sum() ** 1.5)
    means = np.array([r["mean"] for r in reps.collect()])
    z0 = NormalDist().inv_cdf((means < x.mean()).mean() + (means == x.mean()).mean() / 2)
    at = [NormalDist().cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (NormalDist().inv_cdf(0.025), NormalDist().inv_cdf(0.975))]
    assert abs(got["a"] - a) < 1e-9 and abs(got["bias"] - z0) < 1e-9
    assert np.allclose([got["lo"], got["hi"]], np.quantile(means, at))
    same = spark.createDataFrame([(i, 2.0) for i in range(5)], "id long, v double")
    flat = boot.corrected_interval(same, "v", boot.replicates(same, "id", "v", 20)).first()
    assert (flat["lo"], flat["hi"]) == (2.0, 2.0)
    assert boot.corrected_interval(same.limit(0), "v", boot.replicates(same, "id", "v", 20)).first()["lo"] is None
