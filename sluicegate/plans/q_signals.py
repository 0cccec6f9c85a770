"""Queries over deferral signals, gates, headroom, fitted routers and comparisons with a leader."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.functions import text as T
from sluicegate.operators import deferral as D, signals as G
from sluicegate.operators.classification import balanced_accuracy
from sluicegate.plans.arms import ARMS, LONG, PROBS, _b, arms, long_preds, probabilities
from sluicegate.plans.base import query, rounded
from sluicegate.session import read


@query(f"WITH {PROBS}, m AS (SELECT item_idx, list_reverse_sort(list(p)) AS t FROM probs GROUP BY 1) SELECT item_idx, round(t[1] - coalesce(t[2], 0), 6) AS margin, round((expert_pred = free_pred)::INT + (third_pred = free_pred)::INT + free_conf, 6) AS committee FROM m JOIN arms USING (item_idx)")
def deferral_signals(spark, sf_dir):
    """Margin and committee scores; low means escalate first."""
    a = arms(spark, sf_dir)
    return rounded(G.committee(a, ["expert_pred", "third_pred"]).select("item_idx", "committee").join(G.margin(probabilities(a)), "item_idx"))


@query(f"WITH {ARMS}, c AS (SELECT gold, count(*) AS n FROM arms GROUP BY 1) SELECT count(*) AS classes, min(n) AS rarest, round(sqrt(0.25 / min(n)) / sqrt(count(*)), 6) AS half_width FROM c")
def resolution_floor(spark, sf_dir):
    return rounded(G.resolution(arms(spark, sf_dir), "gold"))


_REPS = f"""{LONG}, a AS (SELECT model, gold, avg((gold = pred)::INT) AS a FROM preds GROUP BY ALL), s AS (SELECT model, avg(a) AS balanced FROM a GROUP BY 1), l AS (SELECT model AS leader, balanced AS top FROM s ORDER BY balanced DESC, model LIMIT 1),
d AS (SELECT p.model, p.item_idx, p.gold, (p.gold = p.pred)::INT - (q.gold = q.pred)::INT AS d FROM preds p JOIN preds q ON q.item_idx = p.item_idx, l WHERE q.model = leader AND p.model <> leader),
u AS (SELECT d.*, b, {_b('best', 1000000, "(item_idx || '/' || b)")} AS u FROM d, range(200) r(b)), w AS (SELECT *, (u >= 367879)::INT + (u >= 735759)::INT + (u >= 919699)::INT + (u >= 981012)::INT + (u >= 996340)::INT + (u >= 999406)::INT AS w FROM u),
c AS (SELECT model, b, gold, sum(w * d) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL), reps AS (SELECT model, b, avg(m) AS diff FROM c GROUP BY ALL)"""


@query(f"""WITH {_REPS}, t AS (SELECT model, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi, least(1.0, 2 * least(avg((diff <= 0)::INT), avg((diff >= 0)::INT))) AS p FROM reps GROUP BY 1),
k AS (SELECT t.*, balanced - top AS delta, row_number() OVER (ORDER BY p, model) AS k, count(*) OVER () AS m FROM t JOIN s USING (model), l), f AS (SELECT coalesce(min(k) FILTER (p > 0.05 / (m - k + 1)), 1000) AS stop FROM k)
SELECT model, round(delta, 6) AS delta, round(lo, 6) AS lo, round(hi, 6) AS hi, round(p, 6) AS p, k < stop AS significant FROM k, f""")
def candidates_against_best(spark, sf_dir):
    """Each arm against the best one, bootstrapped within classes, with Holm's correction."""
    return rounded(G.against_best(long_preds(arms(spark, sf_dir)), 200, "best"))


@query("""WITH e AS (SELECT user_id AS g, event_type AS l, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT g, arg_min(l, (-n, l)) AS cls FROM e GROUP BY 1), r AS (SELECT g, cls, row_number() OVER (PARTITION BY cls ORDER BY md5(g::VARCHAR || 'rung'), g) AS r, count(*) OVER (PARTITION BY cls) AS m FROM c),
k AS (SELECT g FROM r WHERE r <= greatest(1, round_even(m * 0.3::DOUBLE, 0))) SELECT user_id, count(*) AS n FROM events JOIN k ON g = user_id GROUP BY 1""")
def group_rung(spark, sf_dir):
    """Three tenths of the users of each main event type, with all their events."""
    return G.group_rung(read(spark, sf_dir, "events"), "user_id", "event_type", 0.3, "rung").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _gate_sql(rule: str) -> str:
    return f"""WITH {ARMS}, tr AS (SELECT o.test, a.* FROM arms a JOIN (SELECT DISTINCT fold AS test FROM arms) o ON a.fold <> o.test), c AS (SELECT test, free_conf AS t FROM tr UNION SELECT test, 'inf'::DOUBLE FROM tr UNION SELECT test, '-inf'::DOUBLE FROM tr),
p AS (SELECT c.test, c.t, avg((free_conf < t)::INT) AS share, avg(CASE WHEN free_conf < t THEN (expert_pred = gold)::INT ELSE (free_pred = gold)::INT END) AS acc, avg((expert_pred = gold)::INT) AS expert FROM c JOIN tr ON tr.test = c.test GROUP BY ALL),
m AS (SELECT *, max(acc) OVER (PARTITION BY test) AS top FROM p), k AS (SELECT test, arg_min(t, (share, t)) AS t FROM m WHERE acc >= {rule} - 1e-12 GROUP BY 1), e AS (SELECT arms.*, free_conf < t AS esc FROM arms JOIN k ON test = fold)
SELECT round(avg((CASE WHEN esc THEN expert_pred ELSE free_pred END = gold)::INT), 6) AS accuracy, round(avg(esc::INT), 6) AS share, round(avg(esc::INT) * 4.5, 6) AS cost_per_1k, count(*) FILTER (esc AND expert_pred = gold AND free_pred <> gold) AS gained_on_free, count(*) FILTER (esc AND expert_pred <> gold AND free_pred = gold) AS lost_on_free,
count(*) FILTER (NOT esc AND free_pred = gold AND expert_pred <> gold) AS gained_on_expert, count(*) FILTER (NOT esc AND free_pred <> gold AND expert_pred = gold) AS lost_on_expert, round(avg((free_pred = gold OR expert_pred = gold)::INT), 6) AS oracle,
round((avg((CASE WHEN esc THEN expert_pred ELSE free_pred END = gold)::INT) - greatest(avg((free_pred = gold)::INT), avg((expert_pred = gold)::INT))) / nullif(avg((free_pred = gold OR expert_pred = gold)::INT) - greatest(avg((free_pred = gold)::INT), avg((expert_pred = gold)::INT)), 0), 6) AS recovered FROM e"""


@query(_gate_sql("top"))
def threshold_gate_maxacc(spark, sf_dir):
    """Thresholds of the other folds' best accuracy, and what the gate gives."""
    return rounded(G.evaluate_gate(G.threshold_gate(arms(spark, sf_dir), "maxacc"), 4.5))


@query(_gate_sql("expert"))
def threshold_gate_ni(spark, sf_dir):
    """Thresholds of the least share that is no worse than the expert on the other folds."""
    return rounded(G.evaluate_gate(G.threshold_gate(arms(spark, sf_dir), "ni"), 4.5))


@query()
def class_headroom(spark, sf_dir):
    """A greedy choice over steps, with shuffled classes; a test holds it against a loop."""
    return rounded(G.headroom(arms(spark, sf_dir), 0.2, 3, "h"))


@query()
def fitted_router(spark, sf_dir):
    """Escalate where the fitted probabilities favour the expert; an optimizer has no SQL form."""
    a = arms(spark, sf_dir).withColumn("x", F.col("free_pred").cast("double")).withColumn("agree", (F.col("third_pred") == F.col("free_pred")).cast("double"))
    scored = G.router_scores(a, ["free_conf", "x", "agree"])
    return rounded(D.summary(scored.withColumn("escalated", F.col("score") < 0)))


_GRAMS = r"""t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM conversations), g AS (SELECT conv_id, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
b AS (SELECT id, term, count(*) AS tf FROM g GROUP BY ALL), n AS (SELECT count(*) AS n FROM t), i AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM b, n GROUP BY term, n),
q AS (SELECT id AS query_id, term, count(*) * any_value(idf) AS w, any_value(idf) AS idf FROM g JOIN i USING (term) WHERE conv_id % 50 = 0 GROUP BY ALL)"""


@query(f"""WITH {_GRAMS}, nb AS (SELECT id, sqrt(sum((tf * idf) ** 2)) AS n FROM b JOIN i USING (term) GROUP BY 1), nq AS (SELECT query_id, sqrt(sum(w ** 2)) AS n FROM q GROUP BY 1),
c AS (SELECT q.query_id, b.id, round(sum(b.tf * q.idf * q.w) / (any_value(nb.n) * any_value(nq.n)), 9) AS cosine FROM q JOIN b ON b.term = q.term AND b.id // 1000 <> q.query_id // 1000 JOIN nb ON nb.id = b.id JOIN nq ON nq.query_id = q.query_id GROUP BY ALL)
SELECT query_id, id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS r FROM c) WHERE r = 1""")
def tfidf_neighbour(spark, sf_dir):
    """The turn of another conversation that is nearest by tf-idf of words and word pairs; queries: conversations divisible by 50."""
    t = read(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    q = t.where("conv_id % 50 = 0").select(F.col("id").alias("query_id"), "conv_id", "text")
    return rounded(G.tfidf_nearest(q, t, T.words("text"), apart="conv_id"))


@query(f"WITH {ARMS} SELECT fold, count(*) AS turns, count(*) FILTER (free_conf >= 0.5) AS fast_turns, round(avg((free_conf < 0.5)::INT), 6) AS escalation_rate, round(avg((free_pred <> gold)::INT) FILTER (free_conf >= 0.5), 6) AS fast_error_rate FROM arms WHERE gold = 9 GROUP BY 1 HAVING fold = 2")
def novelty_metrics(spark, sf_dir):
    """Escalations and errors on the turns of a class that stands for novel ones."""
    a = arms(spark, sf_dir).where("gold = 9 and fold = 2").withColumn("fast", F.col("free_conf") >= 0.5).withColumn("right", F.col("free_pred") == F.col("gold"))
    return rounded(G.novelty_metrics(a, "fast", "right").withColumn("fold", F.lit(2)))


@query(f"WITH {LONG}, a AS (SELECT fold, model, avg((gold = pred)::INT) AS accuracy FROM preds GROUP BY ALL) SELECT fold, model, round(accuracy, 6) AS accuracy, row_number() OVER (PARTITION BY fold ORDER BY accuracy DESC, model) = 1 AS best FROM a")
def best_of_tasks(spark, sf_dir):
    s = balanced_accuracy(long_preds(arms(spark, sf_dir)), "gold", "pred", "fold", "model")
    return rounded(G.best_flags(s.select("fold", "model", "accuracy"), "fold", "model", "accuracy"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))) AS normalized FROM documents")
def plain_text(spark, sf_dir):
    """Letters a to z and digits of the compatibility form; the tables hold no character that the form would change into those."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.plain("text")).alias("normalized"))


@query(r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), s AS (SELECT doc_id, text, i, list_sum([0] || list_transform(ls[1:i - 1], lambda x: length(x) + 1))::INT AS start, length(ls[i]) AS n FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)),
e AS (SELECT doc_id, text, regexp_extract_all(text[1:400], '\w+')[1:5] AS w FROM documents), a AS (SELECT doc_id, text, w, regexp_extract(text, array_to_string(w, '\W+')) AS hit FROM e WHERE len(w) >= 3),
h AS (SELECT doc_id, instr(text, hit) - 1 AS place FROM a WHERE hit <> '') SELECT h.doc_id, s.start FROM h JOIN s USING (doc_id) WHERE s.start <= place AND place < s.start + n + 1""")
def evidence_sections(spark, sf_dir):
    """The line of each document where its first five words stand."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.split("text", "\n", -1)
    ends = F.aggregate(lines, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(x) + 1)))
    s = d.select("doc_id", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)).alias("start"), ends.alias("end"))).alias("s")).select("doc_id", "s.start", "s.end")
    e = d.select("doc_id", F.array_join(F.slice(F.regexp_extract_all(F.substring("text", 1, 400), F.lit(r"\w+"), F.lit(0)), 1, 5), " ").alias("evidence"))
    return G.quoted_section(e, s, d).select("doc_id", "start")
