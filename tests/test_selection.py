import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sluicegate.operators import selection as S
from sluicegate.plans.arms import arms


def test_isotonic():
    assert S.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]
    fit = S.isotonic(np.random.default_rng(0).random(50), np.ones(50))
    assert (np.diff(fit) >= 0).all()


def test_per_class_budget(spark, data):
    rows = S.per_class_confidence(arms(spark, data), 0.3).groupBy("fold").agg(F.avg(F.col("escalated").cast("double")).alias("share"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in rows) == 500 and all(r["share"] <= 0.3 for r in rows) and any(r["share"] > 0.15 for r in rows)


def test_joint_decode(spark):
    d = spark.createDataFrame([(1, "q", "yes", 0.6), (1, "q", "no", 0.5), (1, "r", "yes", 2.0), (1, "r", "no", 0.0)], "doc_id long, question string, answer string, score double")
    links = pd.DataFrame([("r", "yes", "q", "no", 0.5)], columns=["a", "la", "b", "lb", "weight"])
    assert {r["question"]: r["answer"] for r in S.joint_decode(d, links).collect()} == {"q": "no", "r": "yes"}
