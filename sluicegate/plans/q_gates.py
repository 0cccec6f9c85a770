"""Queries over gates, tiers, judges and units."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.functions import text as T
from sluicegate.operators import boot, corpus as O, deferral as D, gates as G
from sluicegate.plans.arms import ARMS, LONG, PROBS, _b, arms, long_preds, probabilities
from sluicegate.plans.base import query, rounded
from sluicegate.session import read


@query(f"WITH {ARMS}, r AS (SELECT CASE WHEN free_conf < 0.1 THEN 'novel' WHEN free_pred = 9 THEN 'unseen_action' WHEN third_pred <> free_pred AND free_conf < 0.3 THEN 'unavailable_slot' WHEN free_conf < 0.5 THEN 'low_confidence' END AS reason FROM arms), c AS (SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1) SELECT reason, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def escalation_reasons(spark, sf_dir):
    a = arms(spark, sf_dir)
    reason = G.first_reason(novel=F.col("free_conf") < 0.1, unseen_action=F.col("free_pred") == 9, unavailable_slot=(F.col("third_pred") != F.col("free_pred")) & (F.col("free_conf") < 0.3), low_confidence=F.col("free_conf") < 0.5)
    return rounded(G.reason_shares(a.withColumn("reason", reason), "reason"))


@query("WITH d AS (SELECT conv_id, length(text) < 400 AS fast FROM conversations), p AS (SELECT conv_id, bool_and(fast) AS a, count(*) AS n, sum(fast::INT) AS f FROM d GROUP BY 1) SELECT round(sum(f) / sum(n), 6) AS fast_rate, round(avg(a::INT), 6) AS containment FROM p")
def routing_metrics(spark, sf_dir):
    return rounded(G.routing_metrics(read(spark, sf_dir, "conversations").withColumn("fast", F.length("text") < 400), "fast", "conv_id"))


@query(f"WITH {ARMS}, x AS (SELECT 'a' AS component, CASE WHEN free_conf > 0.2 THEN free_pred = gold END AS ok FROM arms UNION ALL SELECT 'b', CASE WHEN free_conf <= 0.2 THEN expert_pred = gold END FROM arms) SELECT component, count(*) AS n, round(avg((NOT ok)::INT), 6) AS error FROM x WHERE ok IS NOT NULL GROUP BY 1")
def component_errors(spark, sf_dir):
    a = arms(spark, sf_dir).select(F.when(F.col("free_conf") > 0.2, F.col("free_pred") == F.col("gold")).alias("a"), F.when(F.col("free_conf") <= 0.2, F.col("expert_pred") == F.col("gold")).alias("b"))
    return rounded(G.component_errors(a, ["a", "b"]))


@query("SELECT event_type AS route, count(*) AS n, round(sum(CASE WHEN event_id % 4 <> 0 THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS cost, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_by_route(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("route"), "value", F.lit(0.5).alias("cost"), (F.col("event_id") % 4 == 0).alias("hit"))
    return rounded(G.latency_by_route(e, "route", "value", "cost", "hit"))


@query("""WITH r AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey) AS g, list(l_linenumber ORDER BY l_linenumber, l_partkey) FILTER (l_quantity > 10) AS p FROM lineitem GROUP BY 1),
e AS (SELECT l_orderkey, i, coalesce(g[i + 1], -1) AS g, coalesce(p[i + 1], -1) AS p FROM (SELECT *, unnest(range(greatest(1, len(g), coalesce(len(p), 0)))) AS i FROM r)) SELECT count(*) AS rows, round(avg((g = p)::INT), 6) AS joint, count(*) FILTER (p = -1) AS missing FROM e""")
def row_expansion(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem")
    in_order = lambda c: F.transform(F.array_sort(F.array_compact(F.collect_list(c))), lambda s: s["l_linenumber"])
    s = F.struct("l_linenumber", "l_partkey")
    r = x.groupBy("l_orderkey").agg(in_order(s).alias("g"), in_order(F.when(F.col("l_quantity") > 10, s)).alias("p"))
    e = G.expand(r, "g", "p", "l_orderkey")
    return rounded(e.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("gold_value") == F.col("pred_value")).cast("double")).alias("joint"), F.count_if(F.col("pred_value") == -1).alias("missing")))


@query(f"WITH {LONG} SELECT a.model AS judge_a, b.model AS judge_b, count(*) AS n, round(avg((a.pred = b.pred)::INT), 6) AS agreement FROM preds a JOIN preds b ON a.item_idx = b.item_idx AND a.model < b.model GROUP BY ALL")
def judge_agreement(spark, sf_dir):
    return rounded(G.judge_agreement(long_preds(arms(spark, sf_dir)), "item_idx", "model", "pred"))


@query(f"WITH {LONG}, u AS (SELECT item_idx, count(DISTINCT pred) = 1 AS u FROM preds GROUP BY 1) SELECT count(*) AS items, round(avg(u::INT), 6) AS unanimous FROM u")
def unanimous_judges(spark, sf_dir):
    return rounded(G.unanimous(long_preds(arms(spark, sf_dir)), "item_idx", "pred"))


_TIERS = f"{ARMS}, c AS (SELECT gold AS class, count(*) AS n, avg((free_pred = gold)::INT) AS f, avg((expert_pred = gold)::INT) AS e FROM arms GROUP BY 1), t AS (SELECT *, CASE WHEN f >= 0.7 THEN 'free' WHEN f >= 0.6 THEN 'review' ELSE 'large' END AS tier FROM c)"


def _tiers(spark, sf_dir):
    right = lambda p: F.avg((F.col(p) == F.col("gold")).cast("double"))
    c = arms(spark, sf_dir).groupBy(F.col("gold").alias("class")).agg(F.count(F.lit(1)).alias("n"), right("free_pred").alias("f"), right("expert_pred").alias("e"))
    return c.withColumn("tier", G.assign_tier(F.col("f"), 0.7, 0.1))


@query(f"WITH {_TIERS} SELECT class, n, tier, round(f, 6) AS f FROM t")
def tier_assignment(spark, sf_dir):
    return rounded(_tiers(spark, sf_dir).select("class", "n", "tier", "f"))


@query(f"WITH {_TIERS}, b AS (SELECT n, tier, CASE tier WHEN 'free' THEN f ELSE e END AS a, CASE tier WHEN 'free' THEN 0.1 WHEN 'review' THEN 0.5 ELSE 1.0 END::DOUBLE AS cost FROM t) SELECT round(sum(n * a) / sum(n), 6) AS accuracy, round(sum(n * cost) / sum(n), 6) AS cost, round(1 - sum(n * cost) / sum(n), 6) AS savings, round(sum(n) FILTER (tier = 'large') / sum(n), 6) AS baseline_share FROM b")
def blended_tiers(spark, sf_dir):
    t = _tiers(spark, sf_dir)
    t = t.select("class", "n", "tier", F.when(F.col("tier") == "free", F.col("f")).otherwise(F.col("e")).alias("accuracy"), F.when(F.col("tier") == "free", 0.1).when(F.col("tier") == "review", 0.5).otherwise(1.0).alias("cost"), F.lit(1.0).alias("baseline_cost"))
    return rounded(G.blended(t))


@query(f"""WITH {PROBS}, s AS (SELECT item_idx % 50 AS doc, item_idx AS unit, class AS label, p AS score FROM probs), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, unit) AS r FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, label) AS k FROM s WHERE label <> 0) SELECT b.doc, b.label, round(b.score, 6) AS score, (SELECT string_agg(unit::VARCHAR, ',' ORDER BY r) FROM r WHERE r.doc = b.doc AND r <= 3) AS evidence FROM b WHERE k = 1""")
def document_scores(spark, sf_dir):
    p = probabilities(arms(spark, sf_dir)).select((F.col("item_idx") % 50).alias("doc"), F.col("item_idx").alias("unit"), F.col("class").alias("label"), F.col("p").alias("score"))
    d = G.document_scores(p, "doc", "label", "score", 0)
    return rounded(d.select("doc", "label", "score", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence")))


@query(f"""WITH {PROBS}, f AS (SELECT item_idx, class // 2 AS family, sum(p) AS p FROM probs GROUP BY ALL), t AS (SELECT item_idx, arg_max(family, p * 1000000 - family) AS best, max(p) AS p1 FROM f WHERE family <> 0 GROUP BY 1),
s AS (SELECT item_idx, max(p) AS p2 FROM f JOIN t USING (item_idx) WHERE family <> 0 AND family <> best GROUP BY 1) SELECT item_idx, CASE WHEN (SELECT p FROM f WHERE f.item_idx = t.item_idx AND family = 0) < 0.2 AND p1 - p2 >= 0.25 THEN best END AS routed FROM t JOIN s USING (item_idx)""")
def route_gate(spark, sf_dir):
    p = probabilities(arms(spark, sf_dir)).withColumn("family", F.expr("class div 2").cast("int"))
    return G.route_gate(p, "item_idx", "family", "p", 0, 0.2, 0.25)


@query(f"WITH {LONG}, a AS (SELECT item_idx, CASE WHEN pred < 3 THEN 'yes' WHEN pred < 8 THEN 'no' END AS x FROM preds) SELECT item_idx, CASE WHEN count(*) FILTER (x = 'yes') > 0 THEN 'yes' WHEN count(*) > count(x) THEN NULL ELSE 'no' END AS any_yes, CASE WHEN count(*) FILTER (x = 'no') > 0 THEN 'no' WHEN count(*) > count(x) THEN NULL ELSE 'yes' END AS all_yes FROM a GROUP BY 1")
def three_valued_answers(spark, sf_dir):
    a = long_preds(arms(spark, sf_dir)).withColumn("x", F.when(F.col("pred") < 3, "yes").when(F.col("pred") < 8, "no"))
    return G.three_valued(a, "x", "item_idx")


@query(f"WITH {LONG} SELECT item_idx, CASE WHEN count(DISTINCT pred) = 1 THEN min(pred) END AS pred FROM preds GROUP BY 1")
def supervaluation(spark, sf_dir):
    return G.all_readings(long_preds(arms(spark, sf_dir)), "pred", "item_idx")


@query("WITH s AS (SELECT event_type, avg(CASE WHEN value > 60 THEN 1.0 WHEN value > 50 THEN 0.0 ELSE 0.0 END) AS lo, avg(CASE WHEN value > 60 THEN 1.0 WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS hi, length(event_type)::DOUBLE AS w FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT round(sum(w * lo) / sum(w), 6) AS lower, round(sum(w * hi) / sum(w), 6) AS upper FROM s")
def stratified_audit(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null").withColumn("right", F.when(F.col("value") > 60, True).when(F.col("value") > 50, F.lit(None).cast("boolean")).otherwise(False)).withColumn("w", F.length("event_type").cast("double"))
    return rounded(G.audit_estimate(e, "event_type", "w", "right"))


@query(f"WITH {PROBS} SELECT item_idx, round(max(p), 6) AS any_max, round(min(p), 6) AS all_min, round(1 - exp(sum(ln(1 - p))), 6) AS any_product FROM probs GROUP BY 1")
def fuzzy_any_all(spark, sf_dir):
    return rounded(G.fuzzy(probabilities(arms(spark, sf_dir)), "p", "item_idx"))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS g FROM events), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id)::INT AS rank FROM c WHERE g <= 2) SELECT * FROM r WHERE rank <= 5")
def capped_passages(spark, sf_dir):
    """At most two of a section, five of a document, best first."""
    e = read(spark, sf_dir, "events")
    return G.at_most(e, 2, ["user_id", "event_type"], [F.col("value").desc_nulls_last(), F.asc("event_id")], 5, ["user_id"]).select("user_id", "event_id", "rank")


@query("WITH w AS (SELECT user_id, event_id, sum((event_type = 'click')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS h FROM events) SELECT user_id, start, hits FROM (SELECT user_id, event_id AS start, h::BIGINT AS hits, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, event_id) AS r FROM w) WHERE r = 1")
def best_window(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("hit", (F.col("event_type") == "click").cast("int"))
    return G.best_window(e, "user_id", "event_id", "hit", 10)


@query("WITH a AS (SELECT user_id, event_type FROM events GROUP BY ALL), f AS (SELECT user_id FROM a GROUP BY 1 HAVING count(*) = 5) SELECT event_type, count(*) AS rows, count(f.user_id) AS kept FROM a LEFT JOIN f USING (user_id) GROUP BY 1")
def scorable_rows(spark, sf_dir):
    a = read(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return G.scorable_in_all(a, "user_id", "event_type", 5)


@query("SELECT doc_id, length(text) AS n FROM documents")
def fan_out(spark, sf_dir):
    """One computation for each distinct text, its result for every row."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    sizes = lambda keys: d.join(keys, "h", "left_semi").groupBy("h").agg(F.first(F.length("text")).cast("long").alias("n"))
    return G.fan_out(d.select("doc_id", "h"), "h", sizes).select("doc_id", "n")


@query(r"""WITH RECURSIVE t AS (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark), h AS (SELECT doc_id, i - 1 AS pos, n AS size, CASE n WHEN 2 THEN 'pair' ELSE 'word' END AS tag FROM t, unnest(range(1, len(w) + 1)) x(i), (VALUES (1), (2)) z(n) WHERE (n = 2 AND w[i] = 'of' AND w[i + 1] = 'the') OR (n = 1 AND w[i] IN ('the', 'of')))
SELECT doc_id, pos::INT AS "at", size::INT AS size, tag FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.doc_id = a.doc_id AND b.size = 2 AND a.size = 1 AND a.pos IN (b.pos, b.pos + 1))""")
def lexicon_tags(spark, sf_dir):
    lexicon = spark.createDataFrame([("the", "word"), ("of", "word"), ("of the", "pair")], "phrase string, tag string")
    tokens = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), T.words("text").alias("tokens"))
    return G.tag(tokens, lexicon, 2)


@query(r"""WITH n AS (SELECT DISTINCT 'docs/' || lower(replace(p_name, ' ', '-')) || '.txt' AS name FROM part), a AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'docs/' || lower(replace(p_name, ' ', '-')) || '.txt' WHEN 1 THEN upper(replace(p_name, ' ', '-')) || '.PDF' WHEN 2 THEN replace(p_name, ' ', '_') ELSE 'zzz' END AS asked FROM supplier JOIN part ON p_partkey = s_suppkey),
b AS (SELECT DISTINCT asked, name, regexp_replace(regexp_replace(lower(asked), '^.*/', ''), '\.[a-z0-9]+$', '') AS x, regexp_replace(regexp_replace(lower(name), '^.*/', ''), '\.[a-z0-9]+$', '') AS y FROM a, n),
c AS (SELECT asked, name, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1) AS close, x = y AS same FROM b), k AS (SELECT *, CASE WHEN asked = name THEN 0 WHEN same THEN 1 WHEN close >= 0.6 THEN 2 END AS k FROM c),
r AS (SELECT asked, name FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY k, close DESC, name) AS r FROM k WHERE k IS NOT NULL) WHERE r = 1) SELECT id, asked, name FROM a LEFT JOIN r USING (asked)""")
def resolve_names(spark, sf_dir):
    """Names of parts, asked for exactly, in other case and ending, with other separators, and not there."""
    plain = F.lower(F.regexp_replace("p_name", " ", "-"))
    part = read(spark, sf_dir, "part")
    names = part.select(F.concat(F.lit("docs/"), plain, F.lit(".txt")).alias("name")).distinct()
    asked = read(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("docs/"), plain, F.lit(".txt"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.upper(F.regexp_replace("p_name", " ", "-")), F.lit(".PDF")))
        .when(F.col("s_suppkey") % 4 == 2, F.regexp_replace("p_name", " ", "_")).otherwise("zzz").alias("asked"),
    )
    return asked.join(G.resolve_name(asked.select("asked").distinct(), names), "asked")


@query(f"""WITH {ARMS}, f AS (SELECT unnest([0.0, 0.3, 0.6]::DOUBLE[]) AS setting), o AS (SELECT DISTINCT fold AS outer_ FROM arms),
p AS (SELECT outer_, setting, avg((CASE WHEN free_conf < setting THEN expert_pred ELSE free_pred END = gold)::INT) AS score, avg((free_conf < setting)::INT) AS share FROM arms, f, o WHERE fold <> outer_ GROUP BY ALL)
SELECT outer_ AS "outer", setting, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY outer_ ORDER BY score DESC, share, setting) AS r FROM p) WHERE r = 1""")
def nested_operating_point(spark, sf_dir):
    """The threshold that the other folds choose, for each outer fold."""
    a = arms(spark, sf_dir)
    outer = a.select(F.col("fold").alias("outer")).distinct()
    x = a.join(F.broadcast(outer), F.col("fold") != F.col("outer")).withColumn("setting", F.explode(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.6))))
    sent = F.col("free_conf") < F.col("setting")
    right = F.when(sent, F.col("expert_pred")).otherwise(F.col("free_pred")) == F.col("gold")
    points = x.groupBy("outer", "setting").agg(F.avg(right.cast("double")).alias("score"), F.avg(sent.cast("double")).alias("share"))
    return rounded(G.nested_choice(points).select("outer", "setting", "score"))


_NEAR = f"""{LONG}, s AS MATERIALIZED (SELECT a.vec_id AS item_idx, b.vec_id AS near, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id JOIN arms x ON x.item_idx = a.vec_id JOIN arms y ON y.item_idx = b.vec_id WHERE x.fold <> y.fold),
k AS MATERIALIZED (SELECT item_idx, near, r FROM (SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY sim DESC, near) AS r FROM s) WHERE r <= 7)"""


def _near(spark, sf_dir, a):
    """Each item's seven nearest items of other folds."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")).join(a.select(F.col("item_idx").alias("vec_id"), "fold"), "vec_id")
    near = O.nearest(v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "fold"), v, 7, apart="fold")
    return near.select(F.col("query_id").alias("item_idx"), F.col("vec_id").alias("near"), "rank")


@query(f"""WITH {_NEAR}, v AS (SELECT k.item_idx, sum((expert_pred = gold)::INT - (free_pred = gold)::INT) AS g FROM k JOIN arms ON arms.item_idx = near GROUP BY 1)
SELECT item_idx, fold, coalesce(g, 0) > 0 AS escalated FROM arms LEFT JOIN v USING (item_idx)""")
def local_competence(spark, sf_dir):
    """Each fold's rows, by the arms' hits on their seven nearest rows of the other folds."""
    a = arms(spark, sf_dir)
    return D.local_competence(a, _near(spark, sf_dir, a)).select("item_idx", "fold", "escalated")


@query(f"""WITH {_NEAR}, h AS (
    SELECT k.item_idx, p.model, sum((n.pred = n.gold)::INT) AS hits, coalesce(avg((n.pred = n.gold)::INT) FILTER (n.gold = p.pred), 0) AS local, coalesce(min(k.r) FILTER (n.pred <> n.gold) - 1, max(k.r)) AS run
    FROM k JOIN preds n ON n.item_idx = k.near JOIN preds p ON p.item_idx = k.item_idx AND p.model = n.model GROUP BY k.item_idx, p.model
), m AS (SELECT p.item_idx, p.gold, p.model, p.pred, coalesce(hits, 0) AS hits, coalesce(local, 0) AS local, coalesce(run, 0) AS run FROM preds p LEFT JOIN h USING (item_idx, model)
), q AS (SELECT *, max(run) OVER (PARTITION BY item_idx) AS longest FROM m
), c AS (SELECT item_idx, pred, row_number() OVER (PARTITION BY item_idx ORDER BY count(*) DESC, pred) AS n FROM q WHERE run = longest GROUP BY item_idx, pred)
SELECT item_idx, gold, (list(pred ORDER BY hits DESC, model))[1] AS ola, (list(pred ORDER BY local DESC, model))[1] AS lca, (SELECT pred FROM c WHERE c.item_idx = m.item_idx AND n = 1) AS knora,
    CASE WHEN bool_or(pred = gold) THEN gold ELSE (list(pred ORDER BY model))[1] END AS oracle
FROM m GROUP BY item_idx, gold""")
def dynamic_selection(spark, sf_dir):
    """What the arms that do best around an item predict, over all folds, and the ceiling of any such choice."""
    a = arms(spark, sf_dir)
    return D.dynamic_selection(long_preds(a), _near(spark, sf_dir, a))


@query(f"""WITH {ARMS}, w AS (SELECT item_idx, b, {_b('ni', 1000000, "(item_idx || '/' || b)")} AS u, (free_pred = gold)::INT - (expert_pred = gold)::INT AS d FROM arms, range(60) r(b)),
k AS (SELECT b, d, (u >= 367879)::INT + (u >= 735759)::INT + (u >= 919699)::INT + (u >= 981012)::INT + (u >= 996340)::INT + (u >= 999406)::INT AS n FROM w), m AS (SELECT sum(n * d) / sum(n) AS m FROM k GROUP BY b) SELECT round(quantile_cont(m, 0.05), 6) AS lower, quantile_cont(m, 0.05) > -0.05 AS passes FROM m""")
def non_inferiority(spark, sf_dir):
    """Lower bootstrap bound of the difference against the margin."""
    a = arms(spark, sf_dir).select("item_idx", (F.expr("int(free_pred = gold)") - F.expr("int(expert_pred = gold)")).alias("d"))
    return rounded(boot.non_inferior(boot.replicates(a, "item_idx", "d", 60, "ni"), 0.05))
