import math

import pytest
from pyspark.sql import functions as F

from sluicegate.functions import stats, text as T


def test_intervals_and_quantiles():
    assert stats.clopper_pearson(8, 10) == pytest.approx((0.4439045, 0.9747893), abs=1e-6)
    assert stats.clopper_pearson(0, 10)[0] == 0 and stats.clopper_pearson(10, 10)[1] == 1
    assert stats.t_quantile(0.975, 9) == pytest.approx(2.2621572, abs=1e-6)
    assert stats.beta_cdf(0.3, 2, 5) == pytest.approx(0.579825, abs=1e-9)
    lo, hi = stats.tango_interval(9, 3, 44)
    assert lo < (9 - 3) / 44 < hi
    assert stats.seed_summary([1.0, 2.0, 3.0])[0] == 2


def test_erfc_and_mcnemar(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 2.9, 3.1, 5.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    for r in got:
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-8, abs=1e-14)
    d = spark.createDataFrame([(5, 5), (0, 0), (3, 12)], "b int, c int")
    rows = d.select("b", stats.mcnemar_p("b", "c", "mid-p").alias("m"), stats.mcnemar_p("b", "c", "mid-p-doubled").alias("d"), stats.mcnemar_p("b", "c", "exact").alias("e")).collect()
    pmf = math.comb(10, 5) / 2**10
    assert rows[0]["m"] == pytest.approx(1 - pmf) and rows[0]["d"] == pytest.approx(1)
    assert rows[1]["m"] == rows[1]["d"] == rows[1]["e"] == 1
    assert rows[2]["e"] == pytest.approx(2 * sum(math.comb(15, i) for i in range(4)) / 2**15)


def test_wilson_without_rows(spark):
    lo, _ = stats.wilson("k", "n")
    zero, _ = stats.wilson("k", "n", empty=0.0)
    r = spark.createDataFrame([(0, 0)], "k int, n int").select(lo.alias("lo"), zero.alias("zero")).first()
    assert math.isnan(r["lo"]) and r["zero"] == 0


def test_text(spark):
    d = spark.createDataFrame([("Mr. Smith left. He ran! Did he? Yes.",)], "t string")
    assert d.select(T.sentences("t")).first()[0] == ["Mr. Smith left.", "He ran!", "Did he?", "Yes."]
    assert d.select(T.sentences("t", 8)).first()[0] == ["Mr. Smith left. He ran! Did he? Yes."]
    assert d.select(T.fill_slots(F.lit("Hi {a}, {b}"), F.create_map(F.lit("a"), F.lit("you")))).first()[0] == "Hi you, {b}"
    assert d.select(T.softmax(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(False), F.lit(False)))).first()[0] == [0.5, 0.5]
    assert d.select(T.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))).first()[0] == 1
    assert d.select(T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0
    assert d.select(T.json_answer(F.lit('x {"a": "1"} y'))["a"]).first()[0] == "1"
    r = d.select(T.field_equal(F.lit("1,5"), F.lit("1.50")).alias("a"), T.field_equal(F.lit("2.0"), F.lit("2")).alias("b"), T.field_equal(F.lit("2024-01-31"), F.lit("2024/01/31")).alias("c"), T.field_equal(F.lit("The Cat."), F.lit("cat")).alias("d")).first()
    assert not r["a"] and r["b"] and r["c"] and r["d"]
    assert d.select(T.entropy(F.array(F.lit(1.0), F.lit(1.0)))).first()[0] == 1
