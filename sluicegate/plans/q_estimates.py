"""Queries over repeats, estimates, caches and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.operators import classification as C, corpus as O, estimates as E
from sluicegate.plans.arms import ARMS, arms
from sluicegate.plans.base import query, rounded
from sluicegate.session import read


@query(f"WITH {ARMS}, g AS (SELECT fold, gold, avg((gold = free_pred)::INT) AS a, count(*) AS n, sum((gold = free_pred)::INT) AS h FROM arms GROUP BY ALL), f AS (SELECT fold, sum(h) / sum(n) AS acc, avg(a) AS bal, sum(n) AS n FROM g GROUP BY 1) SELECT count(*) AS repeats, round(avg(acc), 6) AS accuracy, round(avg(bal), 6) AS balanced, round(sum(acc * n) / sum(n), 6) AS pooled FROM f")
def cv_aggregate(spark, sf_dir):
    return rounded(E.cv_aggregate(arms(spark, sf_dir), "gold", "free_pred", "fold"))


@query(f"WITH {ARMS}, c AS (SELECT gold, avg((free_conf >= 0.6)::INT) AS k, avg((gold = free_pred)::INT) FILTER (free_conf >= 0.6) AS a, CASE WHEN gold = 3 THEN 'nan'::DOUBLE ELSE 0.7 + gold / 100 END AS p FROM arms GROUP BY gold) SELECT count(*) AS classes, round(avg(CASE WHEN k = 0 THEN p ELSE k * a + (1 - k) * p END), 6) AS estimate FROM c WHERE NOT isnan(p)")
def estimated_cascade(spark, sf_dir):
    kept = F.col("free_conf") >= 0.6
    c = arms(spark, sf_dir).groupBy(F.col("gold").alias("class")).agg(F.avg(kept.cast("double")).alias("keep_rate"), F.avg(F.when(kept, (F.col("gold") == F.col("free_pred")).cast("double"))).alias("kept_accuracy"))
    return rounded(E.estimated_cascade(c.withColumn("published", F.when(F.col("class") == 3, float("nan")).otherwise(0.7 + F.col("class") / 100))))


@query("SELECT lang, max(n_chars) AS most, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY 1")
def size_demands(spark, sf_dir):
    return rounded(E.demands(read(spark, sf_dir, "documents"), "n_chars", "lang"))


@query("""WITH d AS (SELECT max(n_chars) AS most FROM documents), m AS (SELECT s_name AS model, CASE WHEN s_suppkey % 9 <> 0 THEN round(s_acctbal)::BIGINT * (1 + s_nationkey) END AS capacity, CASE WHEN s_nationkey <> 3 THEN s_acctbal - 900 END AS price FROM supplier)
SELECT model, CASE WHEN capacity IS NULL THEN 'unavailable' WHEN capacity < most THEN 'rejected' WHEN price IS NULL OR price < 0 THEN 'unverified' ELSE 'runnable' END AS verdict FROM m, d""")
def capability_screen(spark, sf_dir):
    """Suppliers as models: what they can take in against the longest document, and whether their price is known."""
    s = read(spark, sf_dir, "supplier")
    window = F.when(F.col("s_suppkey") % 9 != 0, F.round("s_acctbal").cast("long") * (1 + F.col("s_nationkey")))
    price = F.when(F.col("s_nationkey") != 3, F.col("s_acctbal") - 900).otherwise(F.lit(float("nan")))
    m = s.select(F.col("s_name").alias("model"), window.alias("window"), price.alias("price"))
    most = read(spark, sf_dir, "documents").agg(F.max("n_chars").alias("most"))
    return E.screen(m.crossJoin(F.broadcast(most)), F.col("most")).select("model", "verdict")


@query("WITH l AS (SELECT user_id, arg_max(event_type = 'purchase', event_id) AS g, arg_max(value > 30, event_id) AS c FROM (SELECT user_id, event_id, event_type, coalesce(value, 0) AS value FROM events) GROUP BY 1), p AS (SELECT g, avg((g = c)::INT) AS a, count(*) AS n FROM l GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(avg(a), 6) AS balanced FROM p")
def call_balance(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("gold"), (F.coalesce("value", F.lit(0.0)) > 30).alias("called"))
    return rounded(E.call_balance(e, "user_id", ["event_id"], "gold", "called"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 7 END, round_even(o_totalprice / 1000, 0))::BIGINT AS calls FROM orders")
def backfilled_calls(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", E.backfill_calls(F.when(F.col("o_orderkey") % 3 == 0, 7), F.col("o_totalprice"), F.lit(1000.0)).alias("calls"))


_NEAR = """s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) AS sim FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5)"""


def _near(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return O.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 5)


@query(f"WITH {_NEAR} SELECT query_id, vec_id, sim FROM n WHERE rank = 1 AND sim >= 0.35")
def similarity_cache(spark, sf_dir):
    return E.cache_hits(_near(spark, sf_dir), 0.35)


@query(f"WITH {_NEAR} SELECT query_id, (SELECT vec_id FROM n x WHERE x.query_id = n.query_id ORDER BY (vec_id * 7) % 11 DESC, vec_id LIMIT 1) AS reranked, max(vec_id) FILTER (rank = 1) AS first FROM n GROUP BY query_id")
def reranked(spark, sf_dir):
    n = _near(spark, sf_dir)
    return E.rerank(n, n.select("query_id", "vec_id", ((F.col("vec_id") * 7) % 11).alias("score")))


@query(f"WITH {ARMS} SELECT fold, count(*) FILTER (free_pred = gold AND third_pred <> gold) AS only_a, count(*) FILTER (free_pred <> gold AND third_pred = gold) AS only_b, round(avg((free_pred = gold)::INT) - avg((third_pred = gold)::INT), 6) AS difference FROM arms GROUP BY 1")
def paired_repeats(spark, sf_dir):
    a = arms(spark, sf_dir).select("fold", (F.col("free_pred") == F.col("gold")).alias("a"), (F.col("third_pred") == F.col("gold")).alias("b"))
    return rounded(E.paired_repeats(a, "a", "b", "fold"))


@query(f"WITH {ARMS}, h AS (SELECT gold, w AS weight, sum(((w * free_conf >= 0.5) = (free_pred = gold))::INT) AS r FROM arms, (SELECT unnest([0.5, 0.75, 1.0, 1.5, 2.0]::DOUBLE[]) AS w) GROUP BY ALL) SELECT gold, weight, r::BIGINT AS \"right\" FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY r DESC, weight) AS k FROM h) WHERE k = 1")
def weight_grid(spark, sf_dir):
    a = arms(spark, sf_dir).withColumn("ok", F.col("free_pred") == F.col("gold"))
    return E.weight_grid(a, "free_conf", "ok", (0.5, 0.75, 1.0, 1.5, 2.0), "gold")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 17 DESC, turn) AS r FROM conversations),
f(conv_id, r, used, turn, kept) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, false FROM s UNION ALL SELECT f.conv_id, s.r, CASE WHEN f.used + s.n <= 400 THEN f.used + s.n ELSE f.used END, s.turn, f.used + s.n <= 400 FROM f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM f WHERE kept""")
def passages_under_budget(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"), (F.length("text") % 17).alias("score"))
    return E.under_budget(c, "conv_id", "score", "size", "turn", 400)


@query("WITH w AS (SELECT role, string_split(text, ' ')[1] AS w, count(*) AS n FROM conversations GROUP BY ALL) SELECT role, w AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, w) AS r FROM w) WHERE r = 1")
def inferred_role_words(spark, sf_dir):
    """The most frequent first word of each role."""
    c = read(spark, sf_dir, "conversations").withColumn("w", F.split("text", " ")[0])
    return C.mode(c, "w", "role")
