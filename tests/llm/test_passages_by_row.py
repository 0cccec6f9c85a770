"""Passages: rows that share a doc_id, and fuzzy passages whose parts have other holders."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sluicegate.llm import passages


def words(rng, n):
    return [f"w{rng.randrange(1 << 30)}" for _ in range(n)]


def shared_rows(rng):
    passage, other = words(rng, 60), words(rng, 55)
    one, two, three = passage + words(rng, 20), passage + words(rng, 40), words(rng, 120)
    return [(1, one), (2, two), (2, three), (2, three), (3, other + words(rng, 9)), (5, three[:30] + other), (5, words(rng, 70)), (None, passage), (7, None), (8, passage[:10] + two[60:])]


def test_without_passages_keeps_other_rows_of_the_doc_id(spark):
    rows = shared_rows(random.Random(1))
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), 0) for i, w in rows], "doc_id long, text string, own int").repartition(3)
    left = sorted((r["doc_id"] or 0, r["text"].strip()) for r in passages.without_passages(docs).collect() if r["text"])
    text = {i: " ".join(w) for i, (_, w) in enumerate(rows) if w}
    cut = {1: " ".join(rows[1][1][60:]), 5: " ".join(rows[5][1][:30])}
    assert left == sorted((rows[i][0] or 0, cut.get(i, t)) for i, t in text.items())


def test_passages_name_the_text_of_a_shared_doc_id(spark):
    rows = shared_rows(random.Random(1))
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in rows], "doc_id long, text string")
    version = {r["text"]: r["v"] for r in docs.selectExpr("text", "xxhash64(text) AS v").collect()}
    found = {(r["doc_id"], r["version"], r["start"], r["end"], r["other_id"], r["other_version"]) for r in passages.passages(docs, versions=True).collect()}
    assert found == {(2, version[" ".join(rows[1][1])], 0, 60, 1, 0), (5, version[" ".join(rows[5][1])], 30, 85, 3, 0)}


def test_texts_of_one_doc_id_repeat_each_other(spark):
    rng = random.Random(2)
    passage = words(rng, 60)
    docs = spark.createDataFrame([(4, " ".join(passage + words(rng, 15))), (4, " ".join(words(rng, 15) + passage))], "doc_id long, text string")
    found = passages.passages(docs, versions=True).collect()
    assert [(r["doc_id"], r["other_id"], r["end"] - r["start"]) for r in found] == [(4, 4, 60)] and found[0]["version"] != found[0]["other_version"]
    assert sorted(len(r["text"].split()) for r in passages.without_passages(docs).collect()) == [15, 75]


def with_other_holders(rng, rate, count, n=64, part=16, holders=4):
    """Pairs (text, edited text) of a passage, each part of which other documents hold too: some before both, some between."""
    rows, plan = [], []
    for g in range(count):
        passage = words(rng, n)
        base = 100_000 * (g + 1)
        first, last = base + 50_000, base + 90_000
        edited = list(passage)
        for at in rng.sample(range(n), round(rate * n)):
            edited[at] = words(rng, 1)[0]
        rows += [(first, words(rng, 20) + passage + words(rng, 20)), (last, words(rng, 30) + edited + words(rng, 10))]
        plan.append((last, first, 30, 30 + n))
        for p in range(0, n, part):
            for h in range(holders):
                name = base + 100 * p + h if h % 2 else base + 60_000 + 100 * p + h
                rows.append((name, words(rng, 25) + passage[p : p + part] + words(rng, 25)))
    return [(i, " ".join(w)) for i, w in rows], plan


@pytest.mark.parametrize("rate,holders", [(0.05, 4), (0.1, 4), (0.15, 4), (0.1, 12)])
def test_recall_with_other_holders(spark, rate, holders):
    rows, plan = with_other_holders(random.Random(7), rate, 40, holders=holders)
    got = defaultdict(list)
    for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got[r["doc_id"], r["other_id"]].append((r["start"], r["end"]))
    hit = sum(any(min(e, b) - max(s, a) >= 0.8 * (e - s) for a, b in got[d, o]) for d, o, s, e in plan)
    print("found", rate, holders, hit, len(plan))
    assert hit >= 0.9 * len(plan)
    assert set(got) <= {(d, o) for d, o, _, _ in plan}


def test_entries_hold_each_row_once_and_parts_whole():
    rng = np.random.default_rng(3)
    rows = np.column_stack([rng.integers(-(1 << 63), (1 << 63) - 1, 900), rng.integers(0, 1 << 40, 900), rng.integers(0, 1 << 30, 900), rng.integers(0, 127, 900)])
    rows[300:600, 0] = rows[:300, 0]
    names = ("seed", "doc", "pos", "gap")
    sent = pa.Table.from_batches([passages.entries(r[:, 0], **dict(zip(names, r.T, strict=True))) for r in np.array_split(rows, 5)]).sort_by("part").combine_chunks()
    assert len(sent) < 900
    met = passages.entries(rows[:3, 0], doc=rows[:3, 1], pos=rows[:3, 2])
    got = list(passages._parts(iter([met, *sent.to_batches(max_chunksize=7), met.slice(0, 0)]), names, 50))
    assert got[0].num_rows == met.num_rows and all(len(x) >= 50 for x in got[1:-1])
    assert sorted(map(tuple, np.concatenate(got[1:]).tolist())) == sorted(map(tuple, rows.tolist()))
    seen = [set((x[:, 0].view(np.uint64) >> np.uint64(52)).tolist()) for x in got[1:]]
    assert sum(map(len, seen)) == len(set.union(*seen))  # no part lies in two groups
    again = passages._repeated(rows)
    assert len(again) == 600 and (np.diff(again[:, 0]) >= 0).all()


def test_seeds_are_exchanged_by_part(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(2000))) for i in range(40)], "doc_id long, text string").coalesce(1)
    rows, n = passages.seeds(docs).selectExpr("count(*)", "sum(octet_length(seed) div 8)").first()
    assert n > 2 * passages.PARTS >= 2 * rows  # a row for each part, not for each seed
