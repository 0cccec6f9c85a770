"""The nearest text by tf-idf, over several groups of queries and stripes of texts, beside all pairs."""

import math
from collections import Counter

from pyspark.sql import functions as F

from sluicegate.operators import signals as S


def test_nearest_over_groups_and_stripes(spark, monkeypatch):
    texts = {i: " ".join(f"w{(i * j * 7 + j) % 23}" for j in range(i % 9)) for i in range(60)} | {60: None, 61: texts_of_five()}
    base = spark.createDataFrame([(i, i // 2 if i != 3 else None, t) for i, t in texts.items()], "id long, grp long, text string")
    q = base.where("id % 5 = 0 or id = 3").select(F.col("id").alias("query_id"), "grp", "text")
    grams = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, t in texts.items() if (w := (t or "").split())}
    df = Counter(t for c in grams.values() for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    norm = {i: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for i, c in grams.items()}
    want = {}
    for i in (i for i in grams if i % 5 == 0):
        met = [(-round(sum(n * grams[j][t] * idf[t] ** 2 for t, n in grams[i].items() if t in grams[j]) / norm[i] / norm[j], 9), j) for j in grams if j != 3 and i // 2 != j // 2 and grams[i].keys() & grams[j].keys()]
        if met:
            want[i] = (min(met)[1], -min(met)[0])
    monkeypatch.setattr(S, "GROUP", 4)
    monkeypatch.setattr(S, "STRIPE", 7)
    monkeypatch.setattr(S, "ROWS", 3)
    got = {r["query_id"]: (r["id"], r["cosine"]) for r in S.tfidf_nearest(q, base, F.filter(F.split("text", " "), lambda x: x != ""), "grp").collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-9 for i in want)


def texts_of_five() -> str:
    return " ".join(f"w{(5 * j * 7 + j) % 23}" for j in range(5))
