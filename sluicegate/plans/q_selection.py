"""Queries over shortlists, nearest classes, rungs and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.functions import text as T
from sluicegate.operators import fold, corpus as O, deferral as D, selection as S
from sluicegate.plans.arms import ARMS, LONG, PROBS, arms, long_preds, probabilities
from sluicegate.plans.base import query, rounded
from sluicegate.session import read


@query(f"WITH {PROBS} SELECT item_idx, class, round(p, 6) AS p, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY p DESC, class) AS rank FROM probs) WHERE rank <= 3")
def label_shortlist(spark, sf_dir):
    return rounded(S.shortlist(probabilities(arms(spark, sf_dir)), 3))


@query("""WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL), l AS (SELECT label, list(m ORDER BY i) AS c FROM c GROUP BY 1),
s AS (SELECT e.vec_id, l.label, round(list_sum(list_transform(list_zip(e.embedding, l.c), lambda z: z[1]::DOUBLE * z[2])), 6) AS sim FROM embeddings e, l) SELECT count(*) AS n, count(DISTINCT label) AS labels, round(sum(sim), 3) AS total FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s) WHERE r = 1""")
def nearest_class(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    c = O.centroids(e, "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda x: x["mean"]).alias("centre"))
    n = S.nearest_class(e, c, "embedding", "vec_id")
    return rounded(n.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"), F.sum("sim").alias("total")), 3)


@query(r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM benchmark), s AS (SELECT item_id // 10 AS doc_id, item_id AS i, (2 * len(list_intersect(w, ['the', 'of'])) + len(list_intersect(w, ['and', 'in', 'to'])))::INT AS score FROM w)
SELECT doc_id, i, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM s) WHERE rank <= 3 AND score > 0""")
def locate_pieces(spark, sf_dir):
    p = read(spark, sf_dir, "benchmark").select(F.expr("item_id div 10").alias("doc_id"), F.col("item_id").alias("i"), F.array_distinct(T.words("text")).alias("words"))
    return S.locate(p, F.array(F.lit("the"), F.lit("of")), F.array(F.lit("and"), F.lit("in"), F.lit("to")), 3)


@query(r"""WITH w AS (SELECT item_id AS piece, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS w FROM benchmark) SELECT piece FROM w WHERE len(list_intersect(w, ['the', 'a'])) > 0 AND len(list_intersect(w, ['of', 'in'])) > 0""")
def slot_cover(spark, sf_dir):
    p = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("piece"), F.explode(F.array_distinct(T.words("text"))).alias("term"))
    return S.covers_all(p, spark.createDataFrame([(0, "the"), (0, "a"), (1, "of"), (1, "in")], "slot int, term string"), 2)


@query(f"""WITH RECURSIVE {ARMS}, o AS (SELECT fold, free_pred AS c, floor(free_conf * 50)::INT AS b, count(*) AS n, sum((free_pred = gold)::INT) AS f, sum((expert_pred = gold)::INT) AS e FROM arms GROUP BY ALL), a AS (SELECT c, b, sum(n) AS n, sum(f) AS f, sum(e) AS e FROM o GROUP BY ALL),
t AS (SELECT d.fold, a.c, a.b, a.n - coalesce(o.n, 0) AS n, a.f - coalesce(o.f, 0) AS f, a.e - coalesce(o.e, 0) AS e FROM a CROSS JOIN (SELECT DISTINCT fold FROM o) d LEFT JOIN o ON o.fold = d.fold AND o.c = a.c AND o.b = a.b WHERE a.n - coalesce(o.n, 0) > 0),
p AS (SELECT *, sum(n) OVER w AS sn, sum(f) OVER w AS sf, sum(n) OVER w - n AS pn, sum(f) OVER w - f AS pf FROM t WINDOW w AS (PARTITION BY fold, c ORDER BY b ROWS UNBOUNDED PRECEDING)),
m AS (SELECT x.fold, x.c, x.b, i.b AS lo, min((j.sf - i.pf) / (j.sn - i.pn)) AS v FROM p x JOIN p i ON i.fold = x.fold AND i.c = x.c AND i.b <= x.b JOIN p j ON j.fold = x.fold AND j.c = x.c AND j.b >= x.b GROUP BY ALL), iso AS (SELECT fold, c, b, max(v) AS fit FROM m GROUP BY ALL),
ex AS (SELECT fold, c, sum(e) / sum(n) AS expert, min(b) AS least FROM t GROUP BY ALL), cells AS (SELECT o.fold, o.c, o.b, o.n, coalesce(max(t.b), any_value(least)) AS place, any_value(expert) AS expert FROM o JOIN ex USING (fold, c) LEFT JOIN t ON t.fold = o.fold AND t.c = o.c AND t.b <= o.b GROUP BY o.fold, o.c, o.b, o.n),
g AS (SELECT cells.*, round(expert - fit, 9) AS gain FROM cells JOIN iso ON iso.fold = cells.fold AND iso.c = cells.c AND iso.b = cells.place), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY gain DESC, c, b) AS r FROM g WHERE gain > 0),
w(fold, r, room, c, b, take) AS (SELECT fold, 0::BIGINT, 0.3 * sum(n)::DOUBLE, -1, -1, false FROM o GROUP BY fold UNION ALL SELECT w.fold, r.r, CASE WHEN r.n <= w.room THEN w.room - r.n ELSE w.room END, r.c, r.b, r.n <= w.room FROM w JOIN r ON r.fold = w.fold AND r.r = w.r + 1),
d AS (SELECT arms.*, coalesce(take, false) AS esc FROM arms LEFT JOIN w ON w.fold = arms.fold AND w.c = free_pred AND w.b = floor(free_conf * 50)::INT AND w.take), k AS (SELECT gold, avg((free_pred = gold)::INT) AS a, avg((expert_pred = gold)::INT) AS b, avg((CASE WHEN esc THEN expert_pred ELSE free_pred END = gold)::INT) AS e FROM d GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg(esc::INT) FROM d), 6) AS share, round(avg(a), 6) AS free, round(avg(b), 6) AS expert, round(avg(e), 6) AS routed FROM k""")
def per_class_confidence(spark, sf_dir):
    """Isotonic fits, by pooling here and by the greatest least mean in SQL, and a greedy allocation."""
    return rounded(D.summary(S.per_class_confidence(arms(spark, sf_dir), 0.3)))


@query(f"WITH {ARMS} SELECT gold, count(*) AS n FROM (SELECT gold, row_number() OVER (PARTITION BY gold ORDER BY md5(item_idx::VARCHAR || 'r'), item_idx) AS r, count(*) OVER (PARTITION BY gold) AS c FROM arms) WHERE r <= ceil(c * 0.25::DOUBLE) GROUP BY 1")
def halving_rung(spark, sf_dir):
    return S.rung(arms(spark, sf_dir), "item_idx", "gold", 0.25, "r").groupBy("gold").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LONG}, s AS (SELECT model, avg((gold = pred)::INT) AS score, 1.96 * sqrt(avg((gold = pred)::INT) * (1 - avg((gold = pred)::INT)) / count(*)) AS h FROM preds GROUP BY 1) SELECT model, round(score, 6) AS score FROM s WHERE score + h >= (SELECT max(score - h) FROM s)")
def conservative_elimination(spark, sf_dir):
    a = F.avg((F.col("gold") == F.col("pred")).cast("double"))
    s = long_preds(arms(spark, sf_dir)).groupBy("model").agg(a.alias("score"), (1.96 * F.sqrt(a * (1 - a) / F.count(F.lit(1)))).alias("h"))
    return rounded(S.survivors(s, "h").select("model", "score"))


@query(f"WITH {PROBS}, s AS (SELECT item_idx % 20 AS doc, class, list_reverse_sort(list(p)) AS t, count(*) FILTER (p >= 0.5) AS half, sum(p) AS total FROM probs GROUP BY ALL) SELECT doc, class, round(t[1], 6) AS first, round(coalesce(t[2], 0), 6) AS second, half, round(total, 6) AS total FROM s")
def statement_features(spark, sf_dir):
    p = probabilities(arms(spark, sf_dir)).withColumn("doc", F.col("item_idx") % 20)
    return rounded(S.statement_features(p, ["doc", "class"], "p"))


@query()
def learned_rules(spark, sf_dir):
    """Rules with exceptions for good documents, learned from their statistics; tests hold the learner against a loop."""
    t = read(spark, sf_dir, "labels").where("quality in (0, 1)").join(read(spark, sf_dir, "documents"), "doc_id")
    words = F.regexp_count("text", F.lit(r"\S+"))
    x = t.select(
        (F.col("quality") == 1).alias("good"), "lang", F.col("n_chars").cast("double").alias("chars"), (F.regexp_count("text", F.lit("[!|]")) / (words + 1)).alias("marks"),
        (F.col("n_chars") / (words + 1)).alias("length"), (F.size(F.array_distinct(F.split("text", r"\s+"))) / (words + 1)).alias("distinct"), F.contains("text", F.lit("!!")).alias("bangs"),
    )
    rules = fold.learn(x, "good", ["lang", "chars", "marks", "length", "distinct", "bangs"], 0.9)
    return fold.covered(x, "good", rules)


@query()
def word_diffs(spark, sf_dir):
    """Marked differences of neighbouring benchmark items; sequence matching."""
    b = read(spark, sf_dir, "benchmark")
    pairs = b.select("item_id", F.col("text").alias("old")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("new")), "item_id")
    return S.word_diff(pairs, "old", "new", "item_id")
