"""Queries of the corpus operators, and SQL for those that SQL can express.  Tables are read whole."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicegate.llm import bpe, centroids, counts, curve, divergence, fingerprints, jaccard, lattice, mixing, packing, passages, quality, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_documents(spark, sf_dir), k=4, num=85, den=100)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.described(_documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("edits", counts.three_edits())
    return counts.recount(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors.where("vec_id % 50 = 0"), vectors)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.written(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(quality.crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_documents(spark, sf_dir)).result()


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.learn_and_score(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_documents(spark, sf_dir), versions=True)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.Audit(_documents(spark, sf_dir)).result()


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.Clustering(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).result()


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve.Line(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).pieces()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard, op2_fingerprints, op3_bpe, op4_token_counts, op5_topk, op6_token_files, op7_quality, op8_mixing, op9_lm_score, op10_passages, op11_divergence, op12_centroids, op13_packing)}

def _rounds(n: int) -> str:
    """The common tables of n rounds and of the last assignment."""
    out = []
    for i in range(n + 1):
        out.append(f"""a{i} AS MATERIALIZED (
    SELECT r, (best % 1000)::INT AS cluster, (best // 1000)::BIGINT AS distance FROM (
        SELECT r, min(list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 1000 + cluster) AS best
        FROM v CROSS JOIN c{i} GROUP BY r
    )
)""")
        if i < n:
            out.append(f"""c{i + 1} AS MATERIALIZED (
    SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
        SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS c FROM (
            SELECT cluster, place, sum(e[place]) AS s, count(*)::HUGEINT AS n
            FROM a{i} JOIN v USING (r) CROSS JOIN (SELECT unnest(range(1, 65)) AS place) GROUP BY cluster, place
        ) GROUP BY cluster
    ) m USING (cluster)
)""")
    return ", ".join(out)


ORACLES: dict[str, str] = {
    "op5_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    "op11_divergence": """
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
), w AS (SELECT r, lang, source, unnest(terms) AS term FROM d
), kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), own AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total) AS n FROM kept GROUP BY lang
), groups AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own USING (lang, source) GROUP BY g.lang, g.source
), p AS MATERIALIZED (
    SELECT groups.lang, groups.source, kept.term, coalesce(own.n, 0) AS c,
        1 + (1000000000 * (coalesce(own.n, 0) + 2)) // (groups.n + 2 * v) AS p, 1 + (1000000000 * (kept.total + 2)) // (langs.n + 2 * v) AS q
    FROM groups JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN own ON own.lang = groups.lang AND own.source = groups.source AND own.term = kept.term
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(x.f), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT s.lang, s.source, t.source AS item, sum(((s.p - t.p) * (s.p - t.p)) // (s.p + t.p)) AS f
        FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL
    ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source GROUP BY a.lang, a.source, b.source
    UNION ALL
    SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10""",
    "op12_centroids": f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1)::INT AS cluster, e AS c
    FROM v ORDER BY sha256('2:' || vec_id) NULLS LAST, e LIMIT 40
), {_rounds(5)}
SELECT v.vec_id, a5.cluster, a5.distance, (sum(a5.distance) OVER (PARTITION BY a5.cluster))::BIGINT AS cluster_inertia,
    (sum(a5.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.c, ',')) AS centroid_sha256
FROM v JOIN a5 USING (r) JOIN c5 ON c5.cluster = a5.cluster""",
}
