"""Rule tables over clauses: a pattern meets only the clauses that have all of its cue words.

A rule is (rule, variant, rank, cues, pattern, veto, also, head): it holds for a clause (doc_id, stmt, text, head) that has all
words of cues, whose text matches pattern and also (if there is one) and not veto, and whose head matches head (if there
is one).  Variants of a rule are graded by rank, the strictest first; a clause counts for the strictest that holds.

Words are runs of letters, digits and underscores in lower case.  Patterns are regular expressions that Spark evaluates
a row at a time; ``(?i)`` at their beginning ignores case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.operators.joined import DataContractError
from sluicegate.operators.sizes import cut, small

_WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)))


#: Words up to which a column of words is cut to them before it is exploded.
LISTED = 10_000


def among(sought: DataFrame) -> Callable[[Column], Column]:
    """A function that leaves of a column of words those of sought (word), if these are few; else all."""
    listed = [r["word"] for r in sought.limit(LISTED + 1).collect()]
    return (lambda c: F.filter(c, lambda x: x.isin(listed))) if len(listed) <= LISTED else lambda c: c


def probes(rules: DataFrame, index: DataFrame) -> DataFrame:
    """rules with probe: the cue that the fewest clauses have, which is where a rule meets the index (word, clause)."""
    cues = rules.select("rule", "variant", F.explode(F.transform("cues", F.lower)).alias("word"))
    seen = index.join(small(cues.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = cues.join(seen, "word", "left").groupBy("rule", "variant").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))["word"].alias("probe"))
    return rules.join(rarest, ["rule", "variant"])


def matches(rules: DataFrame, clauses: DataFrame) -> DataFrame:
    """(rule, doc_id, stmt, variant): the clauses that a rule holds for, with the strictest variant that does.

    The index of words is an exploded column of the clauses; it meets each variant's rarest cue in one equi-join, and what is
    left is tested for the other cues and then for the patterns.  A rule without cues would meet every clause and raises.
    Defined results: null texts match nothing; null veto, also and head ask for nothing; of equal ranks the variant with
    the lesser name counts; equal rules count once.
    """
    rules = cut(rules.select("rule", "variant", "rank", "cues", "pattern", "veto", "also", "head").distinct())
    bare = rules.where(F.coalesce(F.size("cues"), F.lit(0)) < 1).limit(1).collect()
    if bare:
        raise DataContractError(f"rule {bare[0]['rule']} ({bare[0]['variant']}) has no cue word and would meet every clause")
    graded = W.partitionBy("rule").orderBy("rank", "variant")
    rules = rules.withColumn("cues", F.transform("cues", F.lower)).withColumn("grade", F.row_number().over(graded))
    own = clauses.select("doc_id", "stmt", "text", F.col("head").alias("own_head")).withColumn("words", words(F.col("text")))
    cues = among(rules.select(F.explode("cues").alias("word")).where("word is not null").distinct())
    # explode_outer, and no test for nulls: Spark would test before them, and take each text apart once more for that
    own = own.withColumn("words", cues(F.col("words")))
    met = cut(probes(rules, own.select(F.explode_outer("words").alias("word"))))
    sought = among(met.select(F.col("probe").alias("word")).where("word is not null").distinct())
    found = own.withColumn("probe", F.explode_outer(sought(F.col("words")))).join(small(met), "probe")
    found = found.where(F.forall("cues", lambda x: F.array_contains("words", x)))
    asks = lambda c, on, absent: F.when(F.col(c).isNull(), absent).otherwise(F.regexp_like(F.coalesce(F.col(on), F.lit("")), F.col(c)))
    holds = F.regexp_like(F.coalesce("text", F.lit("")), F.col("pattern")) & asks("also", "text", True) & ~asks("veto", "text", False) & asks("head", "own_head", True)
    best = found.where(holds).groupBy("rule", "doc_id", "stmt").agg(F.min("grade").alias("grade"))
    return best.join(small(met.select("rule", "grade", "variant")), ["rule", "grade"]).select("rule", "doc_id", "stmt", "variant")


def answers(rules: DataFrame, questions: DataFrame, clauses: DataFrame) -> DataFrame:
    """(question_id, rule, doc_id, stmt): for each question about a document, the first rule (least rank) whose question
    pattern it matches and that holds for a clause of the document, with the first such clause.

    questions: question_id, doc_id, text; rules as for matches, with question (a pattern) and question_cue, a word that the
    question must have.  Questions meet rules on the cue, and what is left meets the matches of the rules.  Only clauses of
    documents that such a question is about can answer one: these are written down once, and tested.
    """
    asks = rules.select("rule", "rank", F.col("question").alias("asks"), F.lower("question_cue").alias("word")).distinct()
    asked = questions.select("question_id", "doc_id", "text", F.explode(words(F.col("text"))).alias("word")).join(small(asks), "word")
    asked = cut(asked.where(F.regexp_like("text", F.col("asks"))).select("question_id", "doc_id", "rule", "rank").distinct())
    about = small(asked.select("doc_id").distinct())
    own = cut(clauses.select("doc_id", "stmt", "text", "head").join(about, "doc_id", "left_semi"))
    first = matches(rules, own).groupBy("rule", "doc_id").agg(F.min("stmt").alias("stmt"))
    order = W.partitionBy("question_id").orderBy("rank", "rule")
    return asked.join(first, ["rule", "doc_id"]).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("question_id", "rule", "doc_id", "stmt")
