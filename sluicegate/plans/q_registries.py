"""Queries over the registries of scorers, metrics, candidates and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sluicegate.operators import deferral as D, registries as R
from sluicegate.plans.arms import ARMS, LONG, PROBS, arms, long_preds, probabilities
from sluicegate.plans.base import query, rounded
from sluicegate.session import read

_NORM = r"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', ''))"
_F1 = "CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2 * coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda k: least(len(list_filter({a}, lambda v: v = k)), len(list_filter({b}, lambda v: v = k))))), 0) / (len({a}) + len({b})) END"


@query(f"""WITH t AS (SELECT item_id, text[1:60] AS p, CASE WHEN item_id % 3 = 0 THEN 'The ' || upper(text[1:60]) || '!' ELSE text[20:90] END AS g, text[1:30] AS h FROM benchmark),
n AS (SELECT item_id, {_NORM.format(x='p')} AS p, {_NORM.format(x='g')} AS g, {_NORM.format(x='h')} AS h FROM t), f AS (SELECT *, {_F1.format(a='p', b='g')} AS fg, {_F1.format(a='p', b='h')} AS fh FROM n)
SELECT item_id, (array_to_string(p, ' ') = array_to_string(g, ' '))::INT::DOUBLE AS exact_match, round(fg, 6) AS token_f1, (array_to_string(p, ' ') IN (array_to_string(g, ' '), array_to_string(h, ' ')))::INT::DOUBLE AS any_of_exact, round(greatest(fg, fh), 6) AS any_of_f1 FROM f""")
def scored_answers(spark, sf_dir):
    """Answers cut from each benchmark text against gold ones, by every scorer."""
    part = lambda a, n: F.substring("text", a, n)
    gold = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("The "), F.upper(part(1, 60)), F.lit("!"))).otherwise(part(20, 71))
    t = read(spark, sf_dir, "benchmark").select("item_id", part(1, 60).alias("p"), gold.alias("g"), F.array(gold, part(1, 30)).alias("gs"))
    one = {name: R.scorer(name)(F.col("p"), F.col("g")) for name in ("exact_match", "token_f1")}
    some = {name: R.scorer(name)(F.col("p"), F.col("gs")) for name in ("any_of_exact", "any_of_f1")}
    return rounded(t.select("item_id", *(c.alias(name) for name, c in (one | some).items())))


@query(f"""WITH {LONG}, r AS (SELECT model, gold AS c, avg((gold = pred)::INT) AS r, count(*) AS s, sum((gold = pred)::INT) AS tp FROM preds GROUP BY ALL), q AS (SELECT model, pred AS c, count(*) AS q FROM preds GROUP BY ALL)
SELECT r.model, 'accuracy' AS metric, round(sum(tp) / sum(s), 6) AS value FROM r GROUP BY 1 UNION ALL SELECT model, 'balanced-accuracy', round(avg(r), 6) FROM r GROUP BY 1 UNION ALL SELECT r.model, 'Macro_F1', round(avg(2 * tp / (s + coalesce(q, 0))), 6) FROM r LEFT JOIN q ON q.model = r.model AND q.c = r.c GROUP BY 1""")
def metric_table(spark, sf_dir):
    """Metrics by name for each arm."""
    p = long_preds(arms(spark, sf_dir))
    rows = [R.metric(name)(p, "gold", "pred", "model").select("model", F.lit(name).alias("metric"), "value") for name in ("accuracy", "balanced-accuracy", "Macro_F1")]
    return rounded(reduce(DataFrame.unionByName, rows))


@query(f"""WITH {ARMS}, c AS (SELECT o.f AS fold, gold, count(*) AS n FROM arms JOIN (SELECT DISTINCT fold AS f FROM arms) o ON fold <> o.f GROUP BY ALL), b AS (SELECT fold, arg_min(gold, (-n, gold)) AS pred, max(n) / sum(n) AS conf FROM c GROUP BY 1)
SELECT a.fold, any_value(pred) AS pred, round(any_value(conf), 6) AS conf, round(avg((pred = gold)::INT), 6) AS accuracy FROM arms a JOIN b ON a.fold = b.fold GROUP BY 1""")
def majority_candidate(spark, sf_dir):
    """A registered candidate, fitted on the other folds."""
    c = R.cross_validated(arms(spark, sf_dir).select("item_idx", "fold", "gold"), "majority")
    return rounded(c.groupBy("fold").agg(F.max("pred").alias("pred"), F.max("conf").alias("conf"), F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy")))


@query(f"""WITH {ARMS}, e AS (SELECT item_idx, fold, gold, embedding AS v FROM arms JOIN embeddings ON vec_id = item_idx), x AS (SELECT fold, gold, unnest(range(64)) AS i, unnest(v)::DOUBLE AS x FROM e),
m AS (SELECT o.f, gold, i, avg(x) AS m FROM x JOIN (SELECT DISTINCT fold AS f FROM e) o ON fold <> o.f GROUP BY ALL), l AS (SELECT f, gold AS label, list(m ORDER BY i) AS c FROM m GROUP BY ALL),
s AS (SELECT e.item_idx, e.fold, e.gold, label, round(list_sum(list_transform(list_zip(v, c), lambda z: z[1]::DOUBLE * z[2])), 6) AS sim FROM e JOIN l ON l.f = e.fold), k AS (SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY sim DESC, label) AS r FROM s)
SELECT fold, count(*) AS n, round(avg((label = gold)::INT), 6) AS accuracy, round(sum(sim), 3) AS conf FROM k WHERE r = 1 GROUP BY 1""")
def centre_candidate(spark, sf_dir):
    """Nearest class centres of the other folds' vectors."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_idx"), F.col("embedding").alias("vector"))
    c = R.cross_validated(arms(spark, sf_dir).select("item_idx", "fold", "gold").join(e, "item_idx"), "nearest_centre")
    return c.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") == F.col("gold")).cast("double")), 6).alias("accuracy"), F.round(F.sum("conf"), 3).alias("conf"))


_RULE = "SELECT '{rule}' AS rule, count(*) AS n, round(avg((s <= t)::INT), 6) AS share, round(avg((CASE WHEN s <= t THEN expert_pred ELSE free_pred END = gold)::INT), 6) AS accuracy FROM (SELECT *, {score} AS s FROM z) a JOIN (SELECT o.f, quantile_cont({score}, 0.3) AS t FROM z JOIN (SELECT DISTINCT fold AS f FROM z) o ON fold <> o.f GROUP BY 1) q ON q.f = a.fold"


@query(f"""WITH {PROBS}, m AS (SELECT item_idx, list_reverse_sort(list(p)) AS t FROM probs GROUP BY 1), z AS (SELECT arms.*, t[1] - t[2] AS margin, (expert_pred = free_pred)::INT + (third_pred = free_pred)::INT + free_conf AS committee FROM arms JOIN m USING (item_idx))
{_RULE.format(rule='confidence', score='free_conf')} UNION ALL {_RULE.format(rule='committee', score='committee')} UNION ALL SELECT 'none', count(*), 0.0, round(avg((free_pred = gold)::INT), 6) FROM z UNION ALL SELECT 'all', count(*), 1.0, round(avg((expert_pred = gold)::INT), 6) FROM z""")
def rules_by_name(spark, sf_dir):
    """Rules by their names at three tenths of the rows, and the two ends of the dial."""
    a = arms(spark, sf_dir)
    asked = [("confidence", "confidence", 0.3, {}), ("committee", "committee", 0.3, {"members": ["expert_pred", "third_pred"]}), ("none", "class_aware", 0.0, {}), ("all", "margin", 1.0, {"probs": probabilities(a)})]
    parts = []
    for name, rule, fraction, options in asked:
        d = D.routed(R.allocate(a, rule, fraction, **options))
        parts.append(d.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("n"), F.avg(F.col("escalated").cast("double")).alias("share"), F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy")))
    return rounded(reduce(DataFrame.unionByName, parts))
