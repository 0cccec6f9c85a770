"""Rule tables over the sentences of all documents.  The rules are written from the benchmark's items: its first words are
the cues, in their order the pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.operators import rules as R
from sluicegate.plans.base import query
from sluicegate.session import read

_CLAUSES = r"""c AS MATERIALIZED (SELECT doc_id, i - 1 AS stmt, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)))"""
_RULES = r"""w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark
), r AS MATERIALIZED (
    SELECT item_id AS rule, 'near' AS variant, 1 AS rank, [w[1], w[2]] AS cues, ' ' || w[1] || ' (.{0,40} )?' || w[2] || ' ' AS pattern, ' ' || w[3] || ' ' AS veto FROM w
    UNION ALL SELECT item_id, 'far', 2, [w[1], w[2]], ' ' || w[1] || ' (.* )?' || w[2] || ' ', NULL FROM w
    UNION ALL SELECT item_id, 'pair', 3, [w[3], w[4]], ' ' || w[4] || ' ', NULL FROM w
), x AS MATERIALIZED (SELECT doc_id, stmt, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM c
), f AS MATERIALIZED (SELECT rule, doc_id, stmt, rank, variant, pattern, veto, ' ' || array_to_string(ws, ' ') || ' ' AS said FROM x CROSS JOIN r WHERE list_has_all(ws, cues)
), h AS MATERIALIZED (SELECT * FROM f WHERE regexp_matches(said, pattern) AND (veto IS NULL OR NOT regexp_matches(said, veto)))"""


def _clauses(spark, sf_dir):
    """All sentences, as their words in lower case with a space around each."""
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    c = d.select("doc_id", F.posexplode_outer(F.split("text", r"(?<=[.!?])\s+", -1)).alias("stmt", "text"))
    said = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")
    return c.select("doc_id", "stmt", F.concat(F.lit(" "), said, F.lit(" ")).alias("text"), F.lit(None).cast("string").alias("head"))


def _rules(spark, sf_dir):
    w = read(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w"))
    at = lambda i: F.col("w")[i - 1]
    word = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    none = F.lit(None).cast("string")
    apart = lambda gap: F.concat(word(at(1)), F.lit(gap), at(2), F.lit(" "))
    rows = [("near", 1, (1, 2), apart("(.{0,40} )?"), word(at(3))), ("far", 2, (1, 2), apart("(.* )?"), none), ("pair", 3, (3, 4), word(at(4)), none)]
    made = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(n).alias("rank"), F.array(at(a), at(b)).alias("cues"), p.alias("pattern"), veto.alias("veto"), none.alias("also"), none.alias("head")) for v, n, (a, b), p, veto in rows))
    return w.select(F.col("item_id").alias("rule"), F.explode(made).alias("r")).select("rule", "r.*")


@query(f"WITH {_CLAUSES}, {_RULES} SELECT rule, doc_id, stmt::INT AS stmt, arg_min(variant, rank) AS variant FROM h GROUP BY rule, doc_id, stmt")
def clause_rules(spark, sf_dir):
    """The strictest variant of each rule that holds for a sentence, over all sentences and rules."""
    return R.matches(_rules(spark, sf_dir), _clauses(spark, sf_dir))


@query(f"""WITH {_CLAUSES}, {_RULES}, m AS (SELECT rule, doc_id, min(stmt) AS stmt FROM h GROUP BY rule, doc_id
), q AS (SELECT conv_id * 1000 + turn AS question_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws, conv_id AS doc_id FROM conversations WHERE text IS NOT NULL
), a AS (SELECT q.question_id, m.rule, m.doc_id, m.stmt, row_number() OVER (PARTITION BY q.question_id ORDER BY m.rule) AS n FROM q JOIN m ON m.doc_id = q.doc_id JOIN w ON w.item_id = m.rule AND list_contains(q.ws, w.w[2]) AND contains(q.text, w.w[2]))
SELECT question_id, rule, doc_id, stmt::INT AS stmt FROM a WHERE n = 1""")
def question_rules(spark, sf_dir):
    """Questions (turns) about documents, answered by the first rule that fits the question and holds for a clause."""
    cue = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))[1]
    w = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule"), cue.alias("question_cue"), cue.alias("question"))
    t = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    asked = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("conv_id").alias("doc_id"), "text")
    return R.answers(_rules(spark, sf_dir).join(w, "rule").withColumn("rank", F.lit(1)), asked, _clauses(spark, sf_dir))
