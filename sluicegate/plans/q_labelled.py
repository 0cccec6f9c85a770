"""Queries over labelled items: metrics, paired tests, thresholds, deferral and conformal sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sluicegate.functions import stats
from sluicegate.ident import bucket
from sluicegate.operators import boot, classification as C, conformal as K, deferral as D, joined as J, ranking as R, stacking
from sluicegate.plans.arms import ARMS, LONG, PROBS, _b, arms, long_preds, probabilities
from sluicegate.plans.base import query, rounded

FRACTIONS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0)


def _right(df: DataFrame) -> DataFrame:
    return df.withColumn("right", F.col("free_pred") == F.col("gold")).withColumn("expert_right", F.col("expert_pred") == F.col("gold"))


@query(f"WITH {ARMS} SELECT gold, count(*) AS n, round(avg((gold = free_pred)::INT), 6) AS accuracy FROM arms GROUP BY gold")
def per_class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.per_class_accuracy(arms(spark, sf_dir), "gold", "free_pred"))


@query(f"""WITH {LONG}, r AS (SELECT model, gold, count(*) AS n, sum((gold = pred)::INT) AS h FROM preds GROUP BY ALL)
SELECT model, sum(n)::BIGINT AS n, round(sum(h) / sum(n), 6) AS accuracy, round(avg(h / n), 6) AS balanced FROM r GROUP BY model""")
def balanced_accuracy(spark, sf_dir):
    return rounded(C.balanced_accuracy(long_preds(arms(spark, sf_dir)), "gold", "pred", "model"))


_F1 = f"""{LONG}, cls AS (
    SELECT model, class, sum(tp)::BIGINT AS tp, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted FROM (
        SELECT model, gold AS class, (gold = pred)::INT AS tp, 1 AS s, 0 AS p FROM preds UNION ALL SELECT model, pred, 0, 0, 1 FROM preds) GROUP BY model, class
), f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
    CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM cls)"""


@query(f"WITH {_F1} SELECT model, class, tp, support, predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def f1_report(spark, sf_dir):
    return rounded(C.f1_report(long_preds(arms(spark, sf_dir)), "gold", "pred", "model"))


@query(f"WITH {_F1} SELECT model, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f GROUP BY model")
def f1_summary(spark, sf_dir):
    return rounded(C.f1_summary(long_preds(arms(spark, sf_dir)), "gold", "pred", "model"))


@query(f"""WITH {_F1} SELECT model, round((sum(tp) * sum(support) - sum(support * predicted))::DOUBLE /
    sqrt((sum(support)::DOUBLE ** 2 - sum(predicted * predicted)) * (sum(support)::DOUBLE ** 2 - sum(support * support))), 6) AS mcc FROM f GROUP BY model""")
def matthews(spark, sf_dir):
    return rounded(C.matthews(long_preds(arms(spark, sf_dir)), "gold", "pred", "model"))


@query(f"""WITH {ARMS}, c AS (SELECT gold, free_pred, count(*) AS n FROM arms GROUP BY ALL), s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY gold), 6) AS share_of_true FROM c)
SELECT * FROM s WHERE gold <> free_pred ORDER BY n DESC, gold, free_pred LIMIT 12""")
def top_confusions(spark, sf_dir):
    return rounded(C.confusions(arms(spark, sf_dir), "gold", "free_pred", 12))


_CELLS = "count(*) FILTER (f AND o) AS both_right, count(*) FILTER (f AND NOT o) AS free_only_right, count(*) FILTER (NOT f AND o) AS other_only_right, count(*) FILTER (NOT f AND NOT o) AS neither_right"


@query(f"""WITH {ARMS}, c AS (SELECT gold = free_pred AS f, gold = expert_pred AS o FROM arms), a AS (SELECT count(*) AS n, {_CELLS} FROM c)
SELECT *, round((n - neither_right) / n, 6) AS oracle_accuracy, round(other_only_right / n, 6) AS headroom, round(free_only_right / n, 6) AS at_risk,
    round((other_only_right - free_only_right) / n, 6) AS net_ceiling, round(neither_right / n, 6) AS unreachable FROM a""")
def routing_cells(spark, sf_dir):
    return rounded(C.routing_table(arms(spark, sf_dir), "gold", "free_pred", "expert_pred"))


@query(f"""WITH {ARMS} SELECT free_pred AS class, count(*) AS n, round(avg((gold = free_pred)::INT), 6) AS free_acc, round(avg((gold = expert_pred)::INT), 6) AS other_acc,
    round(avg((gold = expert_pred)::INT) - avg((gold = free_pred)::INT), 6) AS advantage FROM arms GROUP BY free_pred""")
def class_advantage(spark, sf_dir):
    return rounded(C.class_advantage(arms(spark, sf_dir), "gold", "free_pred", "expert_pred"))


@query(f"""WITH {ARMS}, p AS (SELECT free_pred AS class, count(*) AS n_pred, avg((gold = free_pred)::INT) AS precision FROM arms GROUP BY 1)
SELECT k.class, coalesce(n_pred, 0) AS n_pred, round(coalesce(precision, 'nan'::DOUBLE), 6) AS precision FROM (SELECT DISTINCT gold AS class FROM arms) k LEFT JOIN p USING (class)""")
def base_rate_dominance(spark, sf_dir):
    return rounded(C.base_rate_dominance(arms(spark, sf_dir), "gold", "free_pred"))


@query("""WITH t AS (SELECT quality, text FROM labels JOIN documents USING (doc_id)), c AS (SELECT quality, count(*) AS c FROM t GROUP BY 1),
d AS (SELECT sum(c - 1)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS c FROM t GROUP BY text))
SELECT sum(c)::BIGINT AS n, count(*) AS classes, round(max(c) / sum(c), 6) AS majority_share, round(max(c) / min(c), 6) AS imbalance, any_value(duplicate_rows) AS duplicate_rows,
    round(sqrt(0.25 / min(c)) / sqrt(count(*)), 6) AS resolution_floor FROM c, d""")
def label_profile(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return rounded(C.label_profile(t, "quality", "text"))


@query(f"WITH {ARMS}, a AS (SELECT count(*) AS n, avg((gold = free_pred)::INT) AS p FROM arms) SELECT n, round(1.959963984540054 * sqrt(2 * p * (1 - p) / n), 6) AS resolvable FROM a")
def resolvable_difference(spark, sf_dir):
    a = arms(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gold") == F.col("free_pred")).cast("double")).alias("p"))
    return rounded(a.select("n", stats.resolvable_difference("n", "p").alias("resolvable")))


_BOARD = f"""{LONG}, own AS (SELECT model, pred AS class, count(*) AS support, sum((gold = pred)::INT) AS hits FROM preds GROUP BY ALL),
ov AS (SELECT model, avg((gold = pred)::INT) AS overall FROM preds GROUP BY 1), cl AS (SELECT DISTINCT gold AS class FROM arms),
board AS (SELECT ov.model, cl.class, coalesce(support, 0) AS support, CASE WHEN support > 0 THEN hits / support ELSE 'nan'::DOUBLE END AS raw, (coalesce(hits, 0) + 20 * overall) / (coalesce(support, 0) + 20) AS shrunk
    FROM ov CROSS JOIN cl LEFT JOIN own ON own.model = ov.model AND own.class = cl.class)"""


@query(f"WITH {_BOARD} SELECT model, class, support, round(raw, 6) AS raw, round(shrunk, 6) AS shrunk FROM board")
def competence_board(spark, sf_dir):
    a = arms(spark, sf_dir)
    return rounded(C.competence_board(long_preds(a), a.select(F.col("gold").alias("class")).distinct()))


@query(f"""WITH {_BOARD}, cc AS (SELECT *, avg(shrunk) OVER (PARTITION BY class) AS centre FROM board),
s AS (SELECT p.item_idx, p.gold, p.pred, p.model, round(shrunk - centre, 9) AS score, CASE p.model WHEN 'free' THEN 1 WHEN 'expert' THEN 2 ELSE 3 END AS o FROM preds p JOIN cc ON cc.model = p.model AND cc.class = p.pred),
w AS (SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY score DESC, o) AS r FROM s)
SELECT model, count(*) AS n, sum((gold = pred)::INT)::BIGINT AS hits FROM w WHERE r = 1 GROUP BY model""")
def arbitration(spark, sf_dir):
    a = arms(spark, sf_dir)
    board = C.competence_board(long_preds(a), a.select(F.col("gold").alias("class")).distinct())
    won = C.arbitrate(long_preds(a), board, ["free", "expert", "third"])
    return won.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("gold") == F.col("pred")).cast("int")).alias("hits"))


@query(f"""WITH {LONG}, o AS (SELECT gold, avg(h) AS r FROM (SELECT item_idx, any_value(gold) AS gold, bool_or(gold = pred)::INT AS h FROM preds GROUP BY item_idx) GROUP BY gold),
d AS (SELECT avg((a.pred <> b.pred)::INT) AS x FROM preds a JOIN preds b ON a.item_idx = b.item_idx AND a.model < b.model),
m AS (SELECT gold, model, avg((gold = pred)::INT) AS a FROM preds GROUP BY ALL), i AS (SELECT avg(1 - p) AS ind FROM (SELECT gold, product(1 - a) AS p FROM m GROUP BY 1)), t AS (SELECT max(b) AS best FROM (SELECT model, avg(a) AS b FROM m GROUP BY 1)),
q AS (SELECT avg(r) AS r FROM o)
SELECT round(r, 6) AS oracle_balanced, round(x, 6) AS mean_disagreement, round(ind, 6) AS oracle_if_independent, round((r - best) / (ind - best), 6) AS diversity_ratio FROM q, d, i, t""")
def pool_diversity(spark, sf_dir):
    return rounded(C.pool_diversity(long_preds(arms(spark, sf_dir))))


@query(f"""WITH {ARMS}, s AS (SELECT 'a' AS model, item_idx, (gold >= 5)::INT AS y, (free_conf * 0.5 + (free_pred >= 5)::INT)::DOUBLE AS p FROM arms UNION ALL
    SELECT 'b', item_idx, (gold >= 5)::INT, (free_conf * 0.5 + (expert_pred >= 5)::INT)::DOUBLE FROM arms),
k AS (SELECT model, rate, greatest(1, floor(rate * count(*)))::BIGINT AS k FROM s, (SELECT unnest([0.10, 0.15, 0.20, 0.25, 0.30]::DOUBLE[]) AS rate) GROUP BY model, rate),
t AS (SELECT model, rate, min(p) AS cut FROM (SELECT s.model, p, row_number() OVER (PARTITION BY s.model ORDER BY p DESC) AS rn FROM s) x JOIN k USING (model) WHERE rn <= k GROUP BY ALL),
acc AS (SELECT s.model, rate, avg((p >= cut)::INT) FILTER (y = 1) AS a1, avg((p < cut)::INT) FILTER (y = 0) AS a0 FROM s JOIN t USING (model) GROUP BY ALL)
SELECT x.model, z.model AS other, bool_and(x.a1 >= z.a1 AND x.a0 >= z.a0) AS first_dominates, bool_and(z.a1 >= x.a1 AND z.a0 >= x.a0) AS second_dominates
FROM acc x JOIN acc z ON x.rate = z.rate AND x.model < z.model GROUP BY ALL""")
def roc_dominance(spark, sf_dir):
    a = arms(spark, sf_dir)
    y = (F.col("gold") >= 5).cast("int").alias("gold")
    one = lambda name, pred: a.select(F.lit(name).alias("model"), F.col("item_idx").alias("item"), y, (F.col("free_conf") * 0.5 + (F.col(pred) >= 5).cast("int")).alias("p"))
    return C.roc_dominance(one("a", "free_pred").unionByName(one("b", "expert_pred")))


@query(f"""WITH {LONG}, m AS (SELECT item_idx, max(pred) FILTER (model = 'free') AS main FROM preds GROUP BY 1), v AS (SELECT item_idx, pred, count(*) AS v FROM preds GROUP BY ALL),
w AS (SELECT item_idx, pred, row_number() OVER (PARTITION BY item_idx ORDER BY v DESC, pred) AS r FROM v)
SELECT item_idx, (SELECT count(*) FROM preds p WHERE p.item_idx = m.item_idx AND p.pred <> main) AS disagree, w.pred AS majority FROM m JOIN w USING (item_idx) WHERE r = 1""")
def committee(spark, sf_dir):
    return C.committee(long_preds(arms(spark, sf_dir)), "free")


@query(f"WITH {ARMS}, c AS (SELECT fold, free_pred, count(*) AS n FROM arms GROUP BY ALL) SELECT fold, free_pred AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, free_pred) AS r FROM c) WHERE r = 1")
def deterministic_mode(spark, sf_dir):
    return C.mode(arms(spark, sf_dir), "free_pred", "fold")


_WILSON = "(k / n + z2 / (2 * n) {s} z * sqrt(k / n * (1 - k / n) / n + z2 / (4.0 * n * n)) ) / (1 + z2 / n)"


@query(f"""WITH {LONG}, a AS (SELECT model, sum((gold = pred)::INT)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054::DOUBLE AS z, 1.959963984540054::DOUBLE ** 2 AS z2 FROM preds GROUP BY model)
SELECT model, n::BIGINT AS n, round(greatest(0, {_WILSON.format(s='-')}), 6) AS lo, round(least(1, {_WILSON.format(s='+')}), 6) AS hi FROM a""")
def wilson_intervals(spark, sf_dir):
    a = long_preds(arms(spark, sf_dir)).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("k"))
    lo, hi = stats.wilson("k", "n")
    return rounded(a.select("model", "n", lo.alias("lo"), hi.alias("hi")))


@query(f"""WITH {ARMS}, x AS (SELECT count(*) FILTER (free_pred = gold AND expert_pred <> gold) AS b, count(*) FILTER (free_pred <> gold AND expert_pred = gold) AS c FROM arms),
t AS (SELECT b, c, i, exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) AS q FROM x, range(0, (SELECT least(b, c) + 1 FROM x)) r(i)),
s AS (SELECT b, c, sum(q) AS tail, max(q) FILTER (i = least(b, c)) AS point FROM t GROUP BY b, c)
SELECT b, c, round(least(1, 2 * tail), 6) AS exact, round(least(1, greatest(0, CASE WHEN b = c THEN 1 ELSE least(1, 2 * tail) END - point)), 6) AS mid_p, round(least(1, 2 * (tail - 0.5 * point)), 6) AS mid_p_doubled FROM s""")
def mcnemar_exact(spark, sf_dir):
    f, o = F.col("free_pred") == F.col("gold"), F.col("expert_pred") == F.col("gold")
    a = arms(spark, sf_dir).agg(F.count_if(f & ~o).alias("b"), F.count_if(~f & o).alias("c"))
    return rounded(a.select("b", "c", stats.mcnemar_p("b", "c", "exact").alias("exact"), stats.mcnemar_p("b", "c", "mid-p").alias("mid_p"), stats.mcnemar_p("b", "c", "mid-p-doubled").alias("mid_p_doubled")))


#: erfc(x) by its series, which is exact enough for the x below 3 that these tables give.
_ERFC = "(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda i: (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END) * {x} ** (2 * i + 1) / (gamma(i + 1) * (2 * i + 1)))))"


@query(f"""WITH {ARMS}, t AS (SELECT count(*) FILTER (free_pred = gold AND third_pred <> gold)::DOUBLE AS b, count(*) FILTER (free_pred <> gold AND third_pred = gold)::DOUBLE AS c FROM arms), x AS (SELECT *, abs(b - c) / sqrt(2 * (b + c)) AS x, greatest(abs(b - c) - 1, 0) / sqrt(2 * (b + c)) AS y FROM t)
SELECT b::BIGINT AS b, c::BIGINT AS c, round({_ERFC.format(x='x')}, 6) AS asymptotic, round({_ERFC.format(x='y')}, 6) AS chi2_cc, round({_ERFC.format(x='y')}, 6) AS auto FROM x WHERE b + c >= 25""")
def mcnemar_asymptotic(spark, sf_dir):
    """Two-sided p by the normal approximation, with and without continuity correction; tests hold erfc against math."""
    f, o = F.col("free_pred") == F.col("gold"), F.col("third_pred") == F.col("gold")
    a = arms(spark, sf_dir).agg(F.count_if(f & ~o).alias("b"), F.count_if(~f & o).alias("c"))
    return rounded(a.select("b", "c", *(stats.mcnemar_p("b", "c", m).alias(m.replace("-", "_")) for m in ("asymptotic", "chi2-cc", "auto"))))


_P = f"""{ARMS}, p AS (SELECT gold AS name, count(*) FILTER (free_pred = gold AND third_pred <> gold) AS b, count(*) FILTER (free_pred <> gold AND third_pred = gold) AS c FROM arms GROUP BY 1),
t AS (SELECT name, round((b - c) * (b - c) / greatest(b + c, 1) / (20 + b + c), 6) AS p FROM p)"""


def _class_p(spark, sf_dir):
    """A number in [0, 1) for each class, in the place of its test's p-value: what the corrections read."""
    f, t = F.col("free_pred") == F.col("gold"), F.col("third_pred") == F.col("gold")
    c = arms(spark, sf_dir).groupBy(F.col("gold").alias("name")).agg(F.count_if(f & ~t).alias("b"), F.count_if(~f & t).alias("c"))
    n = F.col("b") + F.col("c")
    return c.select("name", F.round((F.col("b") - F.col("c")) * (F.col("b") - F.col("c")) / F.greatest(n, F.lit(1)) / (20 + n), 6).alias("p"))


@query(f"WITH {_P}, r AS (SELECT name, p, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t), f AS (SELECT coalesce(min(k) FILTER (p > 0.05 / (m - k + 1)), 1000) AS stop FROM r) SELECT name, p, k < stop AS reject FROM r, f")
def holm_stepdown(spark, sf_dir):
    return stats.holm(_class_p(spark, sf_dir), "p")


@query(f"WITH {_P}, r AS (SELECT name, p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t), u AS (SELECT *, max(p) FILTER (p <= 0.05 * k / m) OVER () AS top FROM r) SELECT name, p, coalesce(p <= top, false) AS reject FROM u")
def benjamini_hochberg(spark, sf_dir):
    return stats.benjamini_hochberg(_class_p(spark, sf_dir), "p")


_BOOT = f"""{ARMS}, w AS (SELECT item_idx, b, {_b('boot', 1000000, "(item_idx || '/' || b)")} AS u, (free_pred = gold)::INT AS x, (expert_pred = gold)::INT AS y FROM arms, range(40) r(b)),
k AS (SELECT *, (u >= 367879)::INT + (u >= 735759)::INT + (u >= 919699)::INT + (u >= 981012)::INT + (u >= 996340)::INT + (u >= 999406)::INT AS n FROM w)"""


@query(f"WITH {_BOOT} SELECT b::INT AS b, sum(n)::BIGINT AS weight, round(sum(n * (y - x)) / sum(n), 6) AS diff FROM k GROUP BY b")
def bootstrap_replicates(spark, sf_dir):
    a = _right(arms(spark, sf_dir))
    d = a.select("item_idx", (F.col("expert_right").cast("int") - F.col("right").cast("int")).alias("d"))
    return rounded(boot.replicates(d, "item_idx", "d", 40, "boot").withColumnRenamed("mean", "diff"))


@query(f"WITH {_BOOT}, r AS (SELECT b, sum(n * (y - x)) / sum(n) AS d FROM k GROUP BY b) SELECT round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM r")
def bootstrap_interval(spark, sf_dir):
    a = _right(arms(spark, sf_dir))
    d = a.select("item_idx", (F.col("expert_right").cast("int") - F.col("right").cast("int")).alias("d"))
    return rounded(boot.interval(boot.replicates(d, "item_idx", "d", 40, "boot")))


@query(f"""WITH {_BOOT}, r AS (SELECT b, sum(n * (y - x)) / sum(n) AS d FROM k GROUP BY b), v AS (SELECT avg(y - x) AS m FROM (SELECT DISTINCT item_idx, x, y FROM k)),
j AS (SELECT (sum((y - x - m) ** 3) / (6 * sum((y - x - m) ** 2) ** 1.5)) AS a FROM (SELECT DISTINCT item_idx, x, y FROM k), v)
SELECT round(a, 6) AS a, (SELECT round(avg((d < m)::INT + (d = m)::INT / 2.0), 6) FROM r, v) AS below FROM j""")
def bootstrap_correction(spark, sf_dir):
    """What corrects a bootstrap interval: the jackknife's acceleration and the share of replicates below the mean."""
    a = _right(arms(spark, sf_dir))
    d = a.select("item_idx", (F.col("expert_right").cast("int") - F.col("right").cast("int")).alias("d"))
    reps = boot.replicates(d, "item_idx", "d", 40, "boot")
    own = boot.acceleration(d, "d")
    below = F.avg((F.col("mean") < F.col("m")).cast("double") + (F.col("mean") == F.col("m")).cast("double") / 2)
    share = reps.crossJoin(F.broadcast(own.select(F.col("mean").alias("m")))).agg(below.alias("below"))
    return rounded(own.select("a").crossJoin(share))


@query(f"""WITH c AS (SELECT conv_id, count(*) AS n, sum((role = 'assistant')::INT) AS s FROM conversations GROUP BY 1),
w AS (SELECT *, {_b('conv', 1000000, "(conv_id || '/' || b)")} AS u FROM c, range(40) r(b)),
k AS (SELECT *, (u >= 367879)::INT + (u >= 735759)::INT + (u >= 919699)::INT + (u >= 981012)::INT + (u >= 996340)::INT + (u >= 999406)::INT AS m FROM w)
SELECT b::INT AS b, sum(m)::BIGINT AS weight, round(sum(m * s) / sum(m * n), 6) AS mean FROM k GROUP BY b""")
def cluster_bootstrap(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", (F.col("role") == "assistant").cast("int").alias("x"))
    return rounded(boot.cluster_replicates(t, "conv_id", "x", 40, "conv"))


@query(f"""WITH {LONG}, r AS (SELECT model, gold, avg((gold = pred)::INT) AS a FROM preds GROUP BY ALL), s AS (SELECT model, avg(a) AS balanced FROM r GROUP BY model)
SELECT model, round(balanced, 6) AS balanced, row_number() OVER (ORDER BY balanced DESC, model)::INT AS rank, round(max(balanced) OVER () - balanced, 6) AS behind FROM s""")
def compare_candidates(spark, sf_dir):
    s = C.balanced_accuracy(long_preds(arms(spark, sf_dir)), "gold", "pred", "model")
    every = W.partitionBy(F.lit(0))  # a row for each model
    return rounded(s.select("model", "balanced", F.row_number().over(every.orderBy(F.desc("balanced"), "model")).alias("rank"), (F.max("balanced").over(every) - F.col("balanced")).alias("behind")))


_BINS = f"{ARMS}, b AS (SELECT greatest(0, ceil(free_conf * 10)::INT - 1) AS bin, count(*) AS n, avg(free_conf) AS confidence, avg((free_pred = gold)::INT) AS accuracy FROM arms GROUP BY 1)"


@query(f"WITH {_BINS} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def reliability_bins(spark, sf_dir):
    return rounded(R.reliability_bins(_right(arms(spark, sf_dir)), "free_conf", "right"))


@query(f"WITH {_BINS} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM b")
def ece(spark, sf_dir):
    return rounded(R.ece(_right(arms(spark, sf_dir)), "free_conf", "right"))


@query(f"""WITH {ARMS}, r AS (SELECT (free_pred = gold)::INT AS y, rank() OVER (ORDER BY free_conf) + (count(*) OVER (PARTITION BY free_conf) - 1) / 2 AS rk FROM arms)
SELECT round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM r""")
def auroc(spark, sf_dir):
    return rounded(R.auroc(_right(arms(spark, sf_dir)), "free_conf", "right"))


@query(f"""WITH {ARMS}, r AS (SELECT (free_pred <> gold)::INT AS w, row_number() OVER (ORDER BY free_conf, item_idx) AS rn, round_even(0.2 * count(*) OVER (), 0) AS k FROM arms)
SELECT round(sum(w) FILTER (rn <= k) / sum(w), 6) AS error_share FROM r""")
def error_share_least_confident(spark, sf_dir):
    return rounded(R.error_share_in_tail(_right(arms(spark, sf_dir)), "free_conf", "right", "item_idx"))


@query(f"""WITH {ARMS}, r AS (SELECT (free_pred = gold)::INT AS x, (expert_pred = gold)::INT AS y, row_number() OVER (ORDER BY free_conf, item_idx) AS rn, count(*) OVER () AS n FROM arms)
SELECT share, round(sum(CASE WHEN rn <= round_even(share * n, 0) THEN y ELSE x END) / count(*), 6) AS accuracy FROM r, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 1.0]::DOUBLE[]) AS share) GROUP BY share""")
def escalation_dial(spark, sf_dir):
    return rounded(R.escalation_dial(_right(arms(spark, sf_dir)), "free_conf", "right", "expert_right", "item_idx", (0.0, 0.1, 0.25, 0.5, 1.0)))


@query(f"""WITH {ARMS} SELECT threshold, round(avg((free_conf >= threshold)::INT), 6) AS coverage, round(avg((free_pred = gold)::INT) FILTER (free_conf >= threshold), 6) AS precision
FROM arms, (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS threshold) GROUP BY threshold""")
def selective_precision(spark, sf_dir):
    return rounded(R.selective(_right(arms(spark, sf_dir)), "free_conf", "right"))


_DOWN = f"""{ARMS}, l AS (SELECT free_conf AS c, count(*) AS m, sum((free_pred = gold)::INT) AS h FROM arms GROUP BY 1),
d AS (SELECT c, sum(m) OVER (ORDER BY c DESC) AS n, sum(h) OVER (ORDER BY c DESC) AS hits FROM l)"""


@query(f"WITH {_DOWN} SELECT coalesce(max(n) FILTER (hits / n >= 0.8), 0)::BIGINT AS found, min(c) FILTER (hits / n >= 0.8) AS threshold FROM d")
def found_at_precision(spark, sf_dir):
    return R.found_at_precision(_right(arms(spark, sf_dir)), "free_conf", "right", 0.8)


@query(f"WITH {_DOWN} SELECT min(c) FILTER (hits / n >= 0.75 AND n >= 30) AS threshold FROM d")
def lowest_threshold(spark, sf_dir):
    return R.lowest_threshold(_right(arms(spark, sf_dir)), "free_conf", "right", 0.75, 30)


@query(f"WITH {_DOWN}, o AS (SELECT c, bool_and(hits / n >= 0.75) OVER (ORDER BY c DESC) AS ok FROM d) SELECT min(c) FILTER (ok) AS threshold FROM o")
def threshold_descent(spark, sf_dir):
    return R.threshold_descent(_right(arms(spark, sf_dir)), "free_conf", "right", 0.75)


@query(f"WITH {_DOWN} SELECT c AS threshold, round(2 * hits / (n + (SELECT sum(h) FROM l)), 6) AS f1 FROM d ORDER BY 2 * hits / (n + (SELECT sum(h) FROM l)) DESC, c DESC LIMIT 1")
def best_f1_threshold(spark, sf_dir):
    return rounded(R.best_f1_threshold(_right(arms(spark, sf_dir)), "free_conf", "right"))


@query(f"""WITH {ARMS}, r AS (SELECT (free_pred <> gold)::INT AS w, row_number() OVER (ORDER BY free_conf, item_idx) AS rn FROM arms), s AS (SELECT rn, sum(w) OVER (ORDER BY rn ROWS 49 PRECEDING) AS e FROM r)
SELECT rn - 49 AS first_rank, rn AS last_rank, e::BIGINT AS errors FROM s WHERE rn >= 50 ORDER BY e DESC, rn LIMIT 1""")
def error_band(spark, sf_dir):
    return R.error_band(arms(spark, sf_dir).withColumn("wrong", F.col("free_pred") != F.col("gold")), "free_conf", "wrong", "item_idx", 50)


@query(f"""WITH {ARMS}, g AS (SELECT i, i * 0.02::DOUBLE AS t FROM range(51) r(i)), p AS (SELECT free_conf AS p, free_pred = gold AS y FROM arms),
b AS (SELECT l.i AS li, h.i AS hi, count(*) FILTER (ceil(p / 0.02 - 1e-9) <= l.i) + count(*) FILTER (floor(p / 0.02 + 1e-9) >= h.i) AS decided,
    count(*) FILTER (ceil(p / 0.02 - 1e-9) <= l.i AND NOT y) + count(*) FILTER (floor(p / 0.02 + 1e-9) >= h.i AND y) AS ok FROM g l, g h, p WHERE l.i < h.i GROUP BY ALL)
SELECT round(li * 0.02::DOUBLE, 6) AS lo, round(hi * 0.02::DOUBLE, 6) AS hi, decided, round(ok / decided, 6) AS agreement FROM b WHERE decided >= 20 AND ok / decided >= 0.7 ORDER BY decided DESC, li, b.hi LIMIT 1""")
def decision_band(spark, sf_dir):
    return rounded(R.decision_band(_right(arms(spark, sf_dir)), "free_conf", "right", 0.7))


@query(f"""WITH {ARMS}, x AS (SELECT count(*) AS n, sum((free_pred = expert_pred)::INT) AS same FROM arms), c AS (SELECT sum(r * c) AS rc FROM (SELECT free_pred AS v, count(*) AS r FROM arms GROUP BY 1) JOIN (SELECT expert_pred AS v, count(*) AS c FROM arms GROUP BY 1) USING (v))
SELECT round(same / n, 6) AS agreement, round((same / n - rc / (n * n)) / (1 - rc / (n * n)), 6) AS kappa FROM x, c""")
def cohen_kappa(spark, sf_dir):
    return rounded(R.kappa(arms(spark, sf_dir), "free_pred", "expert_pred"))


@query(f"""WITH {ARMS}, m AS (SELECT gold AS m FROM (SELECT gold, count(*) AS n FROM arms GROUP BY 1) ORDER BY n DESC, gold LIMIT 1), x AS (SELECT 'model' AS arm, gold, free_pred AS p FROM arms UNION ALL SELECT 'constant', gold, m FROM arms, m),
r AS (SELECT arm, gold, count(*) AS n, sum((gold = p)::INT) AS h FROM x GROUP BY ALL) SELECT arm, round(sum(h) / sum(n), 6) AS accuracy, round(avg(h / n), 6) AS balanced FROM r GROUP BY arm""")
def constant_guard(spark, sf_dir):
    return rounded(C.constant_guard(arms(spark, sf_dir), "gold", "free_pred"))


_CGD = f"""{ARMS}, cell AS (SELECT fold, free_pred, count(*) AS n, sum((expert_pred = gold)::INT - (free_pred = gold)::INT) AS g FROM arms GROUP BY ALL),
tot AS (SELECT free_pred, sum(n) AS n, sum(g) AS g FROM cell GROUP BY 1), folds AS (SELECT DISTINCT fold FROM arms),
cgdrule AS (SELECT f.fold, t.free_pred, t.n - coalesce(c.n, 0) > 0 AND t.g - coalesce(c.g, 0) > 0 AS escalated FROM folds f CROSS JOIN tot t LEFT JOIN cell c ON c.fold = f.fold AND c.free_pred = t.free_pred),
cgd AS (SELECT arms.*, escalated, CASE WHEN escalated THEN expert_pred ELSE free_pred END AS pred FROM arms JOIN cgdrule USING (fold, free_pred))"""


def _summary_sql(rel: str, by: str = "") -> str:
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""pc AS (SELECT {b}gold, count(*) AS n, sum(escalated::INT) AS s, avg((gold = free_pred)::INT) AS f, avg((gold = expert_pred)::INT) AS e, avg((gold = pred)::INT) AS r FROM {rel} GROUP BY ALL)
SELECT {b}sum(n)::BIGINT AS n, round(sum(s) / sum(n), 6) AS share, round(avg(f), 6) AS free, round(avg(e), 6) AS expert, round(avg(r), 6) AS routed FROM pc {g}"""


@query(f"WITH {_CGD}, {_summary_sql('cgd')}")
def cgd_summary(spark, sf_dir):
    """Class-gated deferral, out of fold."""
    return rounded(D.summary(D.class_gated(arms(spark, sf_dir))))


@query(f"WITH {_CGD}, {_summary_sql('cgd', 'fold')}")
def cgd_by_fold(spark, sf_dir):
    return rounded(D.summary(D.class_gated(arms(spark, sf_dir)), "fold"))


@query(f"""WITH {_CGD}, s AS (SELECT fold, avg(escalated::INT) AS share FROM cgd GROUP BY 1),
tr AS (SELECT s.fold, share, free_conf, row_number() OVER (PARTITION BY s.fold ORDER BY free_conf) - 1 AS i, count(*) OVER (PARTITION BY s.fold) - 1 AS m FROM s JOIN arms a ON a.fold <> s.fold),
q AS (SELECT fold, any_value(share) AS share, max(free_conf) FILTER (i = floor(m * share)) AS lo, max(free_conf) FILTER (i = ceil(m * share)) AS hi, any_value(m * share - floor(m * share)) AS w FROM tr GROUP BY fold),
cas AS (SELECT arms.*, share > 0 AND free_conf <= lo + (hi - lo) * w AS escalated FROM arms JOIN q USING (fold)), casc AS (SELECT *, CASE WHEN escalated THEN expert_pred ELSE free_pred END AS pred FROM cas), {_summary_sql('casc')}""")
def same_budget_cascade(spark, sf_dir):
    a = arms(spark, sf_dir)
    return rounded(D.summary(D.same_budget(a, D.class_gated(a))))


@query(f"""WITH {_CGD}, r AS (SELECT gold = free_pred AS f, gold = expert_pred AS o, escalated AS x FROM cgd), a AS (SELECT count(*) AS n, {_CELLS}, avg(x::INT) FILTER (f AND o) AS s1, avg(x::INT) FILTER (f AND NOT o) AS s2, avg(x::INT) FILTER (NOT f AND o) AS s3, avg(x::INT) FILTER (NOT f AND NOT o) AS s4 FROM r)
SELECT n, both_right, free_only_right, other_only_right, neither_right, round((n - neither_right) / n, 6) AS oracle_accuracy, round(other_only_right / n, 6) AS headroom, round(free_only_right / n, 6) AS at_risk, round((other_only_right - free_only_right) / n, 6) AS net_ceiling, round(neither_right / n, 6) AS unreachable,
round(coalesce(s1, 0), 6) AS both_right_sent, round(coalesce(s2, 0), 6) AS free_only_right_sent, round(coalesce(s3, 0), 6) AS other_only_right_sent, round(coalesce(s4, 0), 6) AS neither_right_sent FROM a""")
def routing_cells_sent(spark, sf_dir):
    return rounded(C.routing_table(D.class_gated(arms(spark, sf_dir)), "gold", "free_pred", "expert_pred", F.col("escalated")))


@query(f"WITH {_CGD} SELECT free_pred AS class, count(*) AS items, round(avg(escalated::INT), 6) AS escalated_share, round(sum(escalated::INT) / (SELECT sum(escalated::INT) FROM cgd), 6) AS share_of_spend FROM cgd GROUP BY 1")
def budget_split(spark, sf_dir):
    return rounded(C.budget_split(D.class_gated(arms(spark, sf_dir)), "free_pred", "escalated"))


@query(f"""WITH {ARMS}, cell AS (SELECT fold, free_pred, count(*) AS n, sum((expert_pred = gold)::INT - (free_pred = gold)::INT) AS g FROM arms GROUP BY ALL),
t AS (SELECT *, (sum(g) OVER (PARTITION BY free_pred) - g) / (sum(n) OVER (PARTITION BY free_pred) - n)::DOUBLE AS adv, 0.3 * sum(n) OVER (PARTITION BY fold) AS budget FROM cell),
o AS (SELECT *, budget - coalesce(sum(n) OVER (PARTITION BY fold ORDER BY adv DESC, free_pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM t WHERE adv > 0),
p AS (SELECT fold, free_pred, CASE WHEN n <= room THEN n ELSE greatest(0, floor(room)) END AS take FROM o),
ca AS (SELECT arms.*, row_number() OVER (PARTITION BY fold, free_pred ORDER BY free_conf, item_idx) <= coalesce(take, 0) AS escalated FROM arms LEFT JOIN p USING (fold, free_pred)),
cb AS (SELECT *, CASE WHEN escalated THEN expert_pred ELSE free_pred END AS pred FROM ca), {_summary_sql('cb')}""")
def class_aware(spark, sf_dir):
    return rounded(D.summary(D.class_aware(arms(spark, sf_dir), 0.3)))


def _floor_sql(bar: str) -> str:
    return f"""{ARMS}, folds AS (SELECT DISTINCT fold AS test FROM arms), tr AS (SELECT test, gold, free_pred, free_conf, expert_pred FROM arms JOIN folds ON fold <> test),
pool AS (SELECT test, avg((expert_pred = gold)::INT) AS pooled FROM tr GROUP BY 1), anc AS (SELECT test, expert_pred AS free_pred, avg((expert_pred = gold)::INT) AS anchor FROM tr GROUP BY ALL),
lv AS (SELECT test, free_pred, free_conf, count(*) AS m, sum((free_pred = gold)::INT) AS h FROM tr GROUP BY ALL),
dn AS (SELECT *, sum(m) OVER w AS n, sum(h) OVER w AS hits FROM lv WINDOW w AS (PARTITION BY test, free_pred ORDER BY free_conf DESC)),
cut AS (SELECT dn.test AS fold, dn.free_pred, min(free_conf) FILTER (hits / n >= {bar} AND n >= 30) AS cut FROM dn LEFT JOIN anc ON anc.test = dn.test AND anc.free_pred = dn.free_pred JOIN pool ON pool.test = dn.test GROUP BY ALL),
pa AS (SELECT arms.*, coalesce(free_conf < cut, true) AS escalated FROM arms LEFT JOIN cut USING (fold, free_pred)), pb AS (SELECT *, CASE WHEN escalated THEN expert_pred ELSE free_pred END AS pred FROM pa), {_summary_sql('pb')}"""


@query("WITH " + _floor_sql("0.9 * coalesce(anchor, pooled)"))
def precision_floor(spark, sf_dir):
    return rounded(D.summary(D.precision_floor(arms(spark, sf_dir), 0.1)))


@query("WITH " + _floor_sql("0.8"))
def guaranteed_coverage(spark, sf_dir):
    return rounded(D.summary(D.guaranteed_coverage(arms(spark, sf_dir), 0.8)))


_CURVE = f"""{ARMS}, folds AS (SELECT DISTINCT fold AS test FROM arms), fr AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0]::DOUBLE[]) AS fraction),
qs AS (SELECT test, [quantile_cont(free_conf, 0.0), quantile_cont(free_conf, 0.05), quantile_cont(free_conf, 0.1), quantile_cont(free_conf, 0.2), quantile_cont(free_conf, 0.3), quantile_cont(free_conf, 0.5), quantile_cont(free_conf, 0.75), quantile_cont(free_conf, 1.0)] AS q FROM arms JOIN folds ON fold <> test GROUP BY 1),
cut AS (SELECT test AS fold, fraction, q[list_position([0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0]::DOUBLE[], fraction)] AS cut FROM qs, fr),
ea AS (SELECT arms.*, fraction, CASE WHEN fraction <= 0 THEN false WHEN fraction >= 1 THEN true ELSE free_conf <= cut END AS escalated FROM arms JOIN cut USING (fold)),
pc AS (SELECT fraction, gold, count(*) AS n, sum(escalated::INT) AS s, avg((gold = CASE WHEN escalated THEN expert_pred ELSE free_pred END)::INT) AS r FROM ea GROUP BY ALL),
points AS (SELECT fraction, sum(s) / sum(n) AS share, avg(r) AS balanced FROM pc GROUP BY 1)"""


@query(f"""WITH {_CURVE} SELECT fraction, round(share, 6) AS share, round(balanced, 6) AS balanced, round((balanced - lag(balanced) OVER w) / nullif(share - lag(share) OVER w, 0) / 10, 6) AS gain_per_tenth FROM points WINDOW w AS (ORDER BY fraction)""")
def deferral_curve(spark, sf_dir):
    return rounded(D.curve(arms(spark, sf_dir), FRACTIONS))


@query(f"WITH {_CURVE} SELECT fraction, round(share, 6) AS share, round(balanced, 6) AS balanced, round((SELECT max(balanced) FROM points) - balanced, 6) AS gives_up FROM points WHERE (SELECT max(balanced) FROM points) - balanced <= 0.02 ORDER BY share, balanced DESC, fraction LIMIT 1")
def cheapest_equivalent(spark, sf_dir):
    return rounded(D.cheapest_equivalent(D.curve(arms(spark, sf_dir), FRACTIONS), 0.02))


@query(f"WITH {_CURVE} SELECT fraction, round(share, 6) AS share, round(balanced, 6) AS balanced FROM points WHERE balanced >= 0.7 - 1e-12 ORDER BY points.share, points.balanced DESC, fraction LIMIT 1")
def operating_point(spark, sf_dir):
    return rounded(D.operating_point(D.curve(arms(spark, sf_dir), FRACTIONS), 0.7).select("fraction", "share", "balanced"))


@query(f"""WITH {ARMS}, l AS (SELECT free_conf, count(*) AS m, sum((free_pred = gold)::INT) AS f, sum((expert_pred = gold)::INT) AS e FROM arms GROUP BY 1)
SELECT free_conf AS threshold, round(coalesce(sum(m) OVER w, 0) / sum(m) OVER (), 6) AS share, round((sum(f) OVER () + coalesce(sum(e - f) OVER w, 0)) / sum(m) OVER (), 6) AS accuracy FROM l WINDOW w AS (ORDER BY free_conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def threshold_frontier(spark, sf_dir):
    return rounded(D.threshold_frontier(arms(spark, sf_dir)))


@query(f"""WITH RECURSIVE {ARMS}, tr AS (SELECT o.test, a.* FROM arms a JOIN (SELECT DISTINCT fold AS test FROM arms) o ON a.fold <> o.test), sup AS (SELECT *, count(*) OVER (PARTITION BY test) AS k FROM (SELECT test, gold, count(*) AS n FROM tr GROUP BY ALL)),
g AS (SELECT test, free_pred, gold, sum((expert_pred = gold)::INT - (free_pred = gold)::INT) AS gain FROM tr GROUP BY ALL), w AS (SELECT test, free_pred, round(sum(gain / n / k), 12) AS worth FROM g JOIN sup USING (test, gold) GROUP BY ALL),
z AS (SELECT fold, free_pred, count(*) AS size FROM arms GROUP BY ALL), r AS (SELECT w.test AS fold, w.free_pred, coalesce(size, 0) AS size, row_number() OVER (PARTITION BY w.test ORDER BY worth DESC, w.free_pred) AS r FROM w LEFT JOIN z ON z.fold = w.test AND z.free_pred = w.free_pred WHERE worth > 0),
f(fold, r, room, free_pred, take) AS (SELECT fold, 0::BIGINT, 0.5 * count(*)::DOUBLE, -1, false FROM arms GROUP BY fold UNION ALL SELECT f.fold, r.r, CASE WHEN r.size <= f.room THEN f.room - r.size ELSE f.room END, r.free_pred, r.size <= f.room FROM f JOIN r ON r.fold = f.fold AND r.r = f.r + 1),
d AS (SELECT arms.*, coalesce(take, false) AS esc FROM arms LEFT JOIN f ON f.fold = arms.fold AND f.free_pred = arms.free_pred AND f.take), c AS (SELECT gold, avg((free_pred = gold)::INT) AS a, avg((expert_pred = gold)::INT) AS b, avg((CASE WHEN esc THEN expert_pred ELSE free_pred END = gold)::INT) AS e FROM d GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg(esc::INT) FROM d), 6) AS share, round(avg(a), 6) AS free, round(avg(b), 6) AS expert, round(avg(e), 6) AS routed FROM c""")
def class_router(spark, sf_dir):
    """A greedy choice over class totals; tests hold it against a plain loop as well."""
    return rounded(D.summary(D.class_router(arms(spark, sf_dir), 0.5)))


def _conformal_sql(k: str, inside: str, by: str, best: bool) -> str:
    join = "ON t.fold = p.fold" + (" AND t.class = p.class" if by else "")
    members = "list_sort(list(p.class) FILTER (" + inside + "))"
    members = f"CASE WHEN len(coalesce({members}, [])) = 0 THEN [arg_max(p.class, p.p * 1000000 - p.class)] ELSE {members} END" if best else f"coalesce({members}, [])"
    return f"""{PROBS}, cal AS (SELECT test AS fold, class, 1 - p AS s FROM probs JOIN (SELECT DISTINCT fold AS test FROM arms) ON fold <> test WHERE class = gold),
rk AS (SELECT fold, {by} s, row_number() OVER (PARTITION BY fold {', class' if by else ''} ORDER BY s) AS r, count(*) OVER (PARTITION BY fold {', class' if by else ''}) AS n FROM cal),
t AS (SELECT fold, {by} coalesce(max(s) FILTER (r = {k}), 'inf'::DOUBLE) AS q FROM rk GROUP BY ALL),
st AS (SELECT item_idx, any_value(gold) AS gold, {members} AS members FROM probs p JOIN t {join} GROUP BY item_idx),
cov AS (SELECT gold AS class, count(*) AS n, avg(list_contains(members, gold)::INT) AS c, avg(len(members)) AS z FROM st GROUP BY 1)
SELECT class, n, round(c, 6) AS coverage, round(z, 6) AS mean_set_size, c >= 0.9 AS holds FROM cov"""


@query("WITH " + _conformal_sql("ceil((n - 1) * least(1.0::DOUBLE, ceil((n + 1) * 0.9::DOUBLE) / n) - 1e-12) + 1", "1 - p.p <= t.q", "", False))
def conformal_clamp(spark, sf_dir):
    p = probabilities(arms(spark, sf_dir))
    return rounded(K.coverage(K.sets(p, K.thresholds(p, 0.1, "clamp"), "clamp")))


@query("WITH " + _conformal_sql("ceil((n - 1) * least(1.0::DOUBLE, ceil((n + 1) * 0.9::DOUBLE) / n) - 1e-12) + 1", "1 - p.p <= t.q", "class,", False))
def conformal_mondrian(spark, sf_dir):
    p = probabilities(arms(spark, sf_dir))
    return rounded(K.coverage(K.sets(p, K.thresholds(p, 0.1, "clamp", True), "clamp")))


@query("WITH " + _conformal_sql("greatest(1, ceil((n + 1) * 0.9::DOUBLE))", "1 - p.p <= t.q + 1e-9", "", True))
def conformal_infinite(spark, sf_dir):
    p = probabilities(arms(spark, sf_dir))
    return rounded(K.coverage(K.sets(p, K.thresholds(p, 0.1, "infinite"), "infinite")))


@query("WITH " + _conformal_sql("greatest(1, least(n, ceil((n + 1)::DECIMAL(20, 0) * 0.9)))", "p.p >= 1 - t.q", "", False))
def conformal_exact(spark, sf_dir):
    p = probabilities(arms(spark, sf_dir))
    return rounded(K.coverage(K.sets(p, K.thresholds(p, 0.1, "exact"), "exact")))


@query(f"""WITH {ARMS}, a AS (SELECT repeat::INT AS repeat, item_idx, CASE WHEN {_b('', 20, "(item_idx || '/' || repeat)")} = 0 THEN (free_pred + 1) % 10 ELSE free_pred END AS pred, free_conf >= 0.5 AS kept, gold FROM arms, range(3) r(repeat)),
j AS (SELECT a.*, expert_pred FROM a JOIN arms b USING (item_idx) WHERE item_idx < 400)
SELECT repeat, count(*) AS n, round(avg((CASE WHEN kept THEN pred ELSE expert_pred END = gold)::INT), 6) AS cascade_accuracy, round(avg((NOT kept)::INT), 6) AS sent_share, round(avg((pred = gold)::INT) FILTER (kept), 6) AS kept_accuracy, round(avg((expert_pred = gold)::INT) FILTER (NOT kept), 6) AS sent_accuracy, round(avg((pred = gold OR expert_pred = gold)::INT), 6) AS oracle_accuracy FROM j GROUP BY repeat""")
def paired_cascade(spark, sf_dir):
    """File A (repeats of the cheap arm) joined to the prefix that file B has, then cascade statistics."""
    x = arms(spark, sf_dir)
    a = x.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(2))))
    flip = bucket(F.concat(F.col("item_idx").cast("string"), F.lit("/"), F.col("repeat").cast("string")), 20) == 0
    a = a.select("repeat", "item_idx", "gold", F.when(flip, (F.col("free_pred") + 1) % 10).otherwise(F.col("free_pred")).alias("pred"), (F.col("free_conf") >= 0.5).alias("kept"))
    b = x.where("item_idx < 400").select("item_idx", F.col("gold").alias("gold_b"), "expert_pred")
    return rounded(J.cascade_statistics(J.paired(a, b)))


@query(f"""WITH {ARMS}, r AS (SELECT fold, avg((free_pred = gold)::INT) AS x, avg(free_conf) AS c, CASE WHEN avg((free_pred = gold)::INT) > 0.65 THEN 'good' ELSE 'bad' END AS verdict FROM arms GROUP BY fold)
SELECT round(avg(x), 6) AS accuracy, round(avg(c), 6) AS confidence, CASE WHEN count(DISTINCT verdict) = 1 THEN min(verdict) ELSE 'unclear' END AS verdict FROM r""")
def mean_over_repeats(spark, sf_dir):
    a = arms(spark, sf_dir).groupBy("fold").agg(F.avg((F.col("free_pred") == F.col("gold")).cast("double")).alias("accuracy"), F.avg("free_conf").alias("confidence"))
    return rounded(J.mean_over(a.withColumn("verdict", F.when(F.col("accuracy") > 0.65, "good").otherwise("bad")), ["accuracy", "confidence"], ["verdict"]))


@query(f"""WITH {LONG}, t AS (SELECT preds.*, least(0.999, {_b('bin', 500, "(item_idx || '/' || model)")} / 1000.0::DOUBLE + 0.5 * (gold = pred)::INT) AS conf FROM preds
), x AS (SELECT *, CASE WHEN conf >= 0.9 THEN 4 WHEN conf >= 0.8 THEN 3 WHEN conf >= 0.7 THEN 2 WHEN conf >= 0.6 THEN 1 ELSE 0 END AS bin FROM t
), f AS (SELECT DISTINCT fold AS test FROM preds
), b AS (SELECT test, model, pred, avg((pred = gold)::INT) AS r FROM x JOIN f ON fold <> test GROUP BY ALL
), c AS (SELECT test, model, pred, bin, avg((pred = gold)::INT) AS r, count(*) AS n FROM x JOIN f ON fold <> test GROUP BY ALL
), s AS (SELECT x.*, CASE WHEN c.n >= 25 THEN c.r ELSE coalesce(b.r, 0) END AS rel FROM x LEFT JOIN b ON b.test = x.fold AND b.model = x.model AND b.pred = x.pred LEFT JOIN c ON c.test = x.fold AND c.model = x.model AND c.pred = x.pred AND c.bin = x.bin)
SELECT item_idx, fold, gold, model, pred, round(conf, 6) AS conf, round(rel, 6) AS reliability FROM (SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY rel DESC, model) AS n FROM s) WHERE n = 1""")
def reliability_selection(spark, sf_dir):
    """For each item the vote that was right most often for its class and confidence in the other folds."""
    return rounded(stacking.reliability_selection(_confident(spark, sf_dir)))


def _confident(spark, sf_dir):
    """The arms' predictions, each with a confidence."""
    p = long_preds(arms(spark, sf_dir))
    u = bucket(F.concat_ws("/", F.col("item_idx").cast("string"), "model"), 500, "bin") / F.lit(1000.0)
    return p.withColumn("conf", F.least(F.lit(0.999), u + F.lit(0.5) * (F.col("gold") == F.col("pred")).cast("int")))


@query()
def stacked_choice(spark, sf_dir):
    """A stacked classifier and the reliability table over the arms, each against the best arm; tests hold the parts against
    loops."""
    p = _confident(spark, sf_dir)
    classes = F.sequence(F.lit(0), F.lit(9))
    share = F.transform(classes, lambda c: F.when(c == F.col("pred"), F.col("conf")).otherwise((1 - F.col("conf")) / 9))
    x = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("model", share.alias("p")))), lambda m: m["p"]))  # a row for each arm
    s = stacking.stacked(p.groupBy("item_idx", "fold", "gold").agg(x.alias("x"))).withColumn("model", F.lit("stacked"))
    r = stacking.reliability_selection(p).withColumn("model", F.lit("reliability"))
    made = s.select("item_idx", "gold", "model", "pred").unionByName(r.select("item_idx", "gold", "model", "pred"))
    return rounded(stacking.choice(p, made, 100, "stack"))
