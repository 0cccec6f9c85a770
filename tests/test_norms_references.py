"""Priority of norms and expansion of terms against plain Python."""

import random

from pyspark.sql import functions as F

from sluicegate.operators import norms as N, references as R

NORM = "doc_id long, stmt string, actions array<long>, actors array<string>, things array<string>, polarity string, override boolean, defers array<long>, except_secs array<long>, inline_exception boolean, secs array<long>"


def norm(doc, stmt, actions, polarity, override=False, defers=(), except_secs=(), secs=()):
    return (doc, stmt, list(actions), None, None, polarity, override, list(defers), list(except_secs), None, list(secs))


def plain(rows):
    """Grounded labels, one document at a time."""
    side = lambda r: {"ban": 1, "permit": 2, "oblige": 2}.get(r[5], 0)
    beats = lambda x, y: x[6] and not y[6] or bool({*y[7]} & {*x[10]}) or bool({*y[8]} & {*x[10]})
    against = {r[1]: set() for r in rows}
    for x in rows:
        for y in rows:
            if x[0] == y[0] and side(x) * side(y) == 2 and {*x[2]} & {*y[2]} and (beats(x, y) or not beats(y, x)):
                against[y[1]].add(x[1])
    said = {}
    while True:
        new = {s: "holds" if all(said.get(a) == "defeated" for a in by) else "defeated" if any(said.get(a) == "holds" for a in by) else None for s, by in against.items()}
        new = {s: v for s, v in new.items() if v}
        if new == said:
            return {s: said.get(s, "unresolved") for s in against}
        said = new


def test_standing_of_a_long_chain(spark):
    # section n + 1 is what section n defers to: the last holds, every second one before is defeated
    rows = [norm(1, f"s{i}", [i // 2, (i + 1) // 2] if i % 2 else [i // 2], "ban" if i % 2 else "permit", defers=[i + 1], secs=[i]) for i in range(31)]
    got = {r["stmt"]: (r["status"], r["stratum"]) for r in N.standing(spark.createDataFrame(rows, NORM)).collect()}
    assert {s: v[0] for s, v in got.items()} == plain(rows)
    assert got["s30"] == ("holds", 0) and got["s0"] == ("holds", 15) and got["s1"] == ("defeated", 14)


def test_standing_against_plain_rounds(spark):
    rng = random.Random(4)
    pick = lambda n, k: rng.sample(range(n), rng.randrange(k))
    rows = [norm(d, f"{d}-{i}", pick(4, 3), rng.choice(["ban", "permit", "oblige", "", None]), rng.random() < 0.2, pick(6, 2), pick(6, 2), pick(6, 3)) for d in range(25) for i in range(rng.randrange(1, 12))]
    rows += [norm(99, "a", [1], "ban"), norm(99, "b", [1], "permit"), norm(98, "c", [1], "ban"), norm(98, "c2", [1], "ban")]
    frame = spark.createDataFrame(rows, NORM).withColumn("id", F.lit(1)).withColumn("status0", F.lit("x"))
    got = {r["stmt"]: r["status"] for r in N.standing(frame.drop("id")).collect()}
    assert got == plain(rows) and got["a"] == got["b"] == "unresolved" and got["c"] == "holds"
    assert {"holds", "defeated", "unresolved"} == set(got.values())
    assert N.standing(spark.createDataFrame([], NORM)).count() == 0


def test_answers_without_norms(spark):
    answers = [(1, 5, [1], None, None, "CAN", "yes", None), (2, 6, None, "ANY", [], None, None, "x")]
    got = N.answer_priority(spark.createDataFrame([norm(5, "n", [1], "ban")], NORM), spark.createDataFrame(answers, "answer_id long, doc_id long, actions array<long>, actor string, things array<string>, asks string, answer string, evidence string")).collect()
    got = {r["answer_id"]: r for r in got}
    assert got[1]["n_conflicts"] == 1 and got[1]["unresolved"] and got[1]["ban_unexcepted"] and not got[1]["evidence_found"]
    assert got[2]["n_conflicts"] == got[2]["n_ban"] == 0 and not got[2]["unresolved"]


STATEMENTS = "doc_id long, stmt long, text string"


def test_definitions(spark):
    rows = [(1, 1, '"Net Fee" means the Fee less tax; “Fee” shall mean all sums.'), (1, 2, 'Acme Inc. (the "Licensor") and Beta (collectively, the "Other Side") agree.'), (1, 3, "nothing"), (1, 4, None), (2, 1, '"Fee" includes a Net Fee and fee.')]
    d = R.definitions(spark.createDataFrame(rows, STATEMENTS))
    assert {(r["doc_id"], r["term"], r["stmt"]) for r in d.collect()} == {(1, "Net Fee", 1), (1, "Fee", 1), (1, "Licensor", 2), (1, "Other Side", 2), (2, "Fee", 1)}
    assert [r["body"] for r in d.where("term = 'Licensor'").collect()] == ["Acme Inc."]
    # Fee is named in the definition of Net Fee; Net Fee is no term of document 2
    assert {(r["doc_id"], r["term"], r["used"]) for r in R.term_references(d).collect()} == {(1, "Net Fee", "Fee"), (1, "Fee", "Net Fee")}


def chain(n):
    return [(7, i, f'"T{i}" means T{i + 1} and more') for i in range(n)] + [(7, n, f'"T{n}" means the end')]


def test_expansion_of_a_chain_of_thirty(spark):
    got = {r["term"]: r for r in R.expanded(R.definitions(spark.createDataFrame(chain(30), STATEMENTS)), limit=None).collect()}
    text = '"T30" means the end'
    for i in range(29, -1, -1):
        text = f'"T{i}" means T{i + 1} and more [T{i + 1}: {text}]'
        assert got[f"T{i}"]["text"] == text and got[f"T{i}"]["depth"] == got[f"T{i}"]["n_used"] == 30 - i
    short = {r["term"]: r["text"] for r in R.expanded(R.definitions(spark.createDataFrame(chain(3), STATEMENTS)), limit=10).collect()}
    assert short["T0"] == '"T0" means T1 and more [T1: "T1" means]'


def test_cycles_are_named(spark):
    rows = [(1, 1, '"A" means B or C'), (1, 2, '"B" means A'), (1, 3, '"C" means none'), (1, 4, '"D" means A and D'), (2, 1, '"A" means none')]
    got = {(r["doc_id"], r["term"]): r for r in R.expanded(R.definitions(spark.createDataFrame(rows, STATEMENTS))).collect()}
    assert got[1, "A"]["text"] == '"A" means B or C [B: see B] [C: "C" means none]' and got[1, "A"]["cyclic"] == ["B"]
    assert got[1, "D"]["text"] == f'"D" means A and D [A: {got[1, "A"]["text"]}]' and got[1, "D"]["cyclic"] == [] and got[1, "D"]["n_used"] == 3
    assert got[1, "B"]["cyclic"] == ["A"] and got[2, "A"]["text"] == '"A" means none'
    assert R.expanded(R.definitions(spark.createDataFrame([], STATEMENTS))).count() == 0


def test_references_to_sections(spark):
    rows = [(1, 1, "See Sections 4.2(b) and Section 9 of this Agreement, Article IV and Section 2 of the Credit Plan."), (1, 2, "Schedule B"), (1, 3, "As in Schedule B and Annex 1."), (1, 4, None)]
    sections = spark.createDataFrame([(1, "4"), (1, "4.2"), (2, "9")], "doc_id long, label string")
    got = {(r["stmt"], r["kind"], r["label"], r["target"]) for r in R.cross_references(spark.createDataFrame(rows, STATEMENTS), sections).collect()}
    assert got == {(1, "section", "4.2(b)", "4.2"), (1, "section", "9", None), (1, "section", "IV", None), (1, "document-section", "2 of Credit Plan", None), (2, "attachment", "Schedule B", "Schedule B"), (3, "attachment", "Schedule B", "Schedule B"), (3, "attachment", "Annex 1", None)}


def test_attachments_with_long_numbers(spark):
    rows = [(1, 1, "As in Schedule 1000 and Exhibit A; see Annex 12345-2000."), (1, 2, "SCHEDULE 1000")]
    sections = spark.createDataFrame([], "doc_id long, label string")
    got = {(r["stmt"], r["label"], r["target"]) for r in R.cross_references(spark.createDataFrame(rows, STATEMENTS), sections).collect()}
    assert got == {(1, "Schedule 1000", "Schedule 1000"), (1, "Exhibit A", None), (1, "Annex 12345-2000", None)}


def test_standing_in_tasks_and_by_exchanges(spark, monkeypatch):
    rng = random.Random(11)
    some = lambda k: rng.sample(range(5), rng.randint(0, k))
    rows = [norm(i % 90 if i % 97 else None, f"s{i}", some(3), rng.choice(["ban", "permit", "oblige", None]), rng.random() < 0.2, some(1), some(1), some(2)) for i in range(1500)]
    rows.append(norm(5, "null", [1, None], "ban"))
    df = spark.createDataFrame(rows, NORM)
    told = lambda d: sorted((r["stmt"], r["status"], r["stratum"]) for r in d.collect())
    want = told(N.exchanged(df))
    assert len(want) == len(rows) and told(N.standing(df)) == want
    monkeypatch.setattr(N, "AT_ONCE", 16)  # most documents are then larger
    assert told(N.standing(df)) == want
    monkeypatch.undo()
    cuts, cut = [], N.cut
    monkeypatch.setattr(N, "cut", lambda d: cuts.append(d.columns) or cut(d))
    assert N.standing(df.where("stmt <> 'null'")).count() == 1500
    assert cuts == [["doc_id"]]  # no table of edges is written


def test_terms_of_documents_of_any_size(spark, monkeypatch):
    """Documents that a task expands whole and those that are exchanged in rounds give the same rows; rounds make no jobs."""
    texts = [f'"T{i}" means T{i + 1}' + (f", T{i - 3}" if i % 7 == 0 and i > 3 else "") + (" or T20" if i % 5 == 0 else "") for i in range(40)]
    rows = [(doc, i, t) for doc in (1, 2) for i, t in enumerate(texts)] + [(3, 0, '"T1" means none'), (None, 1, '"T1" means T2'), (None, 2, '"T2" means none')]
    defined = R.definitions(spark.createDataFrame(rows, STATEMENTS))
    calls = []
    monkeypatch.setattr(R, "exchanged", lambda *a, f=R.exchanged: calls.append(1) or f(*a))
    for limit in (None, 40):
        whole = sorted(map(tuple, R.expanded(defined, limit).collect()))
        assert not calls and {r[0] for r in whole} == {1, 2, 3}
        monkeypatch.setattr(R, "AT_ONCE", 50)
        assert sorted(map(tuple, R.expanded(defined, limit).collect())) == whole and calls.pop()
        monkeypatch.undo()
        monkeypatch.setattr(R, "exchanged", lambda *a, f=R.exchanged: calls.append(1) or f(*a))


def test_norms_are_exchanged_once_by_document(spark, data):
    """The lines' exchange by document serves the grouping into norms and their join with the answers."""
    from sluicegate.plans import q_norms

    plan = q_norms.answer_priorities(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" not in plan and plan.count("RepartitionByExpression [doc_id") == 1


def test_terms_are_not_broadcast(spark, tmp_path):
    """Terms grow with the input, so they must not pass through the driver, however small their estimated size."""
    spark.createDataFrame(chain(30), STATEMENTS).write.parquet(f"{tmp_path}/statements")
    defined = R.definitions(spark.read.parquet(f"{tmp_path}/statements"))
    plan = R.term_references(defined)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
