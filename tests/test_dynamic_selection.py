"""Selection around an item against a loop, and items without neighbours."""

import random
from collections import Counter

from sluicegate.operators import deferral as D


def test_against_a_loop(spark):
    rng = random.Random(1)
    models, items = ["a", "b", "c"], range(60)
    gold = {i: rng.randrange(4) for i in items}
    pred = {(i, m): gold[i] if rng.random() < 0.5 else rng.randrange(4) for i in items for m in models}
    near = {i: rng.sample([j for j in items if j != i], rng.randrange(0, 8)) for i in items}
    p = spark.createDataFrame([(i, gold[i], m, pred[i, m]) for i in items for m in models], "item_idx long, gold int, model string, pred int")
    n = spark.createDataFrame([(i, j, r + 1) for i in items for r, j in enumerate(near[i])], "item_idx long, near long, rank int")
    got = {r["item_idx"]: r for r in D.dynamic_selection(p, n).collect()}
    assert len(got) == 60
    for i in items:
        right = {m: [pred[j, m] == gold[j] for j in near[i]] for m in models}
        local = {m: [ok for ok, j in zip(right[m], near[i]) if gold[j] == pred[i, m]] for m in models}
        share = {m: sum(v) / len(v) if v else 0 for m, v in local.items()}
        run = {m: (right[m] + [False]).index(False) for m in models}
        votes = Counter(pred[i, m] for m in models if run[m] == max(run.values()))
        r = got[i]
        assert r["ola"] == pred[i, min(models, key=lambda m: (-sum(right[m]), m))]
        assert r["lca"] == pred[i, min(models, key=lambda m: (-share[m], m))]
        assert r["knora"] == min(votes, key=lambda c: (-votes[c], c))
        assert r["oracle"] == (gold[i] if gold[i] in [pred[i, m] for m in models] else pred[i, "a"])
