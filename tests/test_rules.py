"""Rule tables: cues, vetoes, variants, and a plan without a product of rules and clauses."""

import io
from contextlib import redirect_stdout

import pytest

from sluicegate.operators import rules as R

RULE = "rule string, variant string, rank int, cues array<string>, pattern string, veto string, also string, head string"


def frames(spark):
    rules = [
        ("law", "strict", 1, ["Governed", "laws"], r"(?i)governed\b.*\blaws?", None, None, "(?i)law"),
        ("law", "loose", 2, ["governed"], r"(?i)governed\b", r"(?i)conflict", None, None),
        ("law", "loose", 2, ["governed"], r"(?i)governed\b", r"(?i)conflict", None, None),
        ("cap", "only", 1, ["liability", "exceed"], "exceed", None, r"\$\d", None),
        ("none", "only", 1, ["unheard"], ".", None, None, None),
    ]
    clauses = [
        (1, 0, "This is governed by the laws of X.", "Governing Law"),
        (1, 1, "This is governed by the laws of X.", None),
        (1, 2, "Governed, but for conflict.", None),
        (2, 0, "Liability may exceed $5.", None),
        (2, 1, "Liability may exceed five.", None),
        (2, 2, None, None),
        (2, 3, "", None),
        (2, 4, "misgoverned", None),
    ]
    return spark.createDataFrame(rules, RULE), spark.createDataFrame(clauses, "doc_id long, stmt int, text string, head string").selectExpr("*", "1 AS rank", "'x' AS words")


def test_matches(spark):
    rules, clauses = frames(spark)
    got = {tuple(r) for r in R.matches(rules, clauses).collect()}
    assert got == {("law", 1, 0, "strict"), ("law", 1, 1, "loose"), ("cap", 2, 0, "only")}
    assert R.matches(rules.limit(0), clauses).count() == 0 and R.matches(rules, clauses.limit(0)).count() == 0


def test_no_product_in_the_plan(spark):
    rules, clauses = frames(spark)
    said = io.StringIO()
    with redirect_stdout(said):
        R.matches(rules, clauses).explain("formatted")
    assert "NestedLoop" not in said.getvalue() and "Cartesian" not in said.getvalue()


def test_rules_without_cues_raise(spark):
    _, clauses = frames(spark)
    with pytest.raises(ValueError, match="no cue"):
        R.matches(spark.createDataFrame([("a", "b", 1, [], ".", None, None, None)], RULE), clauses)


def test_answers(spark):
    rules, clauses = frames(spark)
    rules = rules.selectExpr("*", "'(?i)which law' AS question", "'law' AS question_cue")
    asked = spark.createDataFrame([(1, 1, "Which law is it?"), (2, 2, "Which law is it?"), (3, 1, "What law?"), (4, 1, None)], "question_id long, doc_id long, text string")
    assert {tuple(r) for r in R.answers(rules, asked, clauses).collect()} == {(1, "law", 1, 0), (2, "cap", 2, 0)}


def test_texts_are_taken_apart_once(spark, data):
    """Filters that Spark infers must not repeat the words' regular expression; few cues are sought before the explode."""
    from sluicegate.plans import q_rules

    plan = q_rules.clause_rules(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # the sentence's words, and the words of the clause


def test_words_beyond_a_list(spark, data, monkeypatch):
    from sluicegate.plans import q_rules

    found = lambda: sorted(map(tuple, q_rules.clause_rules(spark, data).collect()))
    want = found()
    monkeypatch.setattr(R, "LISTED", 0)
    assert want and found() == want


def test_only_clauses_asked_about_are_tested(spark, monkeypatch):
    rules, clauses = frames(spark)
    rules = rules.selectExpr("*", "'(?i)which law' AS question", "'law' AS question_cue")
    asked = spark.createDataFrame([(1, 1, "Which law is it?"), (2, 2, "What law?"), (3, None, "Which law is it?")], "question_id long, doc_id long, text string")
    tested, matches = [], R.matches
    monkeypatch.setattr(R, "matches", lambda r, c: matches(r, tested.append(c) or c))
    assert {tuple(r) for r in R.answers(rules, asked, clauses).collect()} == {(1, "law", 1, 0)}
    assert sorted(r["stmt"] for r in tested[0].where("doc_id = 1").collect()) == [0, 1, 2] and tested[0].count() == 3
