import pytest
from pyspark.sql import functions as F

from sluicegate.operators import corpus as O, deferral as D, documents as U, estimates as E, graph, joined as J, ledger as L, matching as M, ranking as R, registries, selection as S, signals as G, turns as V
from sluicegate.operators.ranks import global_rank, running
from sluicegate.plans.arms import arms, probabilities


def test_dial_ends(spark, data):
    points = {r["fraction"]: r for r in D.curve(arms(spark, data), (0.0, 0.5, 1.0)).collect()}
    both = D.summary(arms(spark, data).withColumn("escalated", F.lit(False))).first()
    assert points[0.0]["balanced"] == pytest.approx(both["free"]) and points[0.0]["share"] == 0
    assert points[1.0]["balanced"] == pytest.approx(both["expert"]) and points[1.0]["share"] == 1


def test_partitions_do_not_matter(spark, data):
    a = arms(spark, data)
    one, many = D.summary(D.class_gated(a.coalesce(1))).first(), D.summary(D.class_gated(a.repartition(13))).first()
    assert one["share"] == many["share"] and one["routed"] == pytest.approx(many["routed"])


def test_global_rank(spark):
    d = spark.createDataFrame([(i, float(i * 7 % 10)) for i in range(200)], "k int, s double")
    rows = global_rank(d, "s", "k", "r", parts=5).orderBy("r").collect()
    assert [r["r"] for r in rows] == list(range(1, 201)) and [(r["s"], r["k"]) for r in rows] == sorted((r["s"], r["k"]) for r in rows)


def test_paired_refuses_broken_files(spark):
    a = spark.createDataFrame([(r, i, 1, 1, True) for r in range(2) for i in range(5)], "repeat int, item_idx int, gold int, pred int, kept boolean")
    good = spark.createDataFrame([(i, 1, 0) for i in range(3)], "item_idx int, gold_b int, expert_pred int")
    assert J.paired(a, good).count() == 6
    for rows in ([(0, 1, 0), (0, 1, 0)], [(9, 1, 0)], [(0, 1, 0), (2, 1, 0)], [(0, 2, 0)]):
        with pytest.raises(J.DataContractError):
            J.paired(a, spark.createDataFrame(rows, "item_idx int, gold_b int, expert_pred int"))
    with pytest.raises(J.DataContractError):
        J.paired(a.where("not (repeat = 1 and item_idx = 4)"), good)


def test_pack_against_loop(spark):
    sizes = [5, 5, 9, 30, 2, 2, 2, 2, 8]
    d = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "g long, o long, s long")
    got = {r["o"]: r["pack"] for r in L.pack(d, "g", "o", "s", 10).collect()}
    want, pack, left = {}, 0, 10
    for i, s in enumerate(sizes):
        if s > left and i:
            pack, left = pack + 1, 10
        want[i], left = pack, max(0, left - s)
    assert got == want


def test_class_router_against_loop(spark, data):
    rows = arms(spark, data).collect()
    got = {r["item_idx"]: r["escalated"] for r in D.class_router(arms(spark, data), 0.5).collect()}
    for fold in range(5):
        train, test = [r for r in rows if r["fold"] != fold], [r for r in rows if r["fold"] == fold]
        support = {c: sum(r["gold"] == c for r in train) for c in {r["gold"] for r in train}}
        worth = {}
        for r in train:
            worth[r["free_pred"]] = worth.get(r["free_pred"], 0) + ((r["expert_pred"] == r["gold"]) - (r["free_pred"] == r["gold"])) / support[r["gold"]] / len(support)
        left = 0.5 * len(test)
        for c in sorted(worth, key=lambda c: (-worth[c], c)):
            n = sum(r["free_pred"] == c for r in test)
            take = worth[c] > 1e-12 and n <= left
            left -= n * take
            assert all(got[r["item_idx"]] == take for r in test if r["free_pred"] == c)


def test_documents(spark):
    text = "Title\n\n1. Scope\nText of it.\n  (a) Detail here\n"
    units = U.units(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).orderBy("i").collect()
    assert [u["kind"] for u in units] == ["paragraph", "heading", "paragraph", "heading"] and [u["path"] for u in units] == [None, "1", "1", "(a)"]
    assert [text[u["start"] : u["end"]] for u in units] == ["Title", "1. Scope", "Text of it.", "(a) Detail here"]
    prefixes = spark.createDataFrame([("3(a)(i)",), ("4.1.2",), ("7",), ("",)], "n string").select(U.section_prefixes(F.col("n")))
    assert [r[0] for r in prefixes.collect()] == [["3(a)(i)", "3(a)", "3"], ["4.1.2", "4.1", "4"], ["7"], []]
    kinds = {k for _, _, k in U.align_versions(["same", "the old red house stands", "gone entirely"], ["same", "the new red house stands", "brand fresh"])}
    assert {"equal", "changed", "removed", "added"} <= kinds
    assert U.parse('WHO(modal="may", actor=buyer)') == ("WHO", {"modal": "may", "actor": "buyer"})
    for bad in ("SELECT 1", "VALUE()", "HAS(a b)"):
        with pytest.raises(ValueError):
            U.parse(bad)


def test_resolve_sections(spark):
    s = spark.createDataFrame([(1, "3"), (1, "3(a)")], "doc_id int, label string")
    r = spark.createDataFrame([(1, "3(a)(i)"), (1, "3(b)"), (1, "9")], "doc_id int, ref string")
    assert {x["ref"]: x["section"] for x in U.resolve_sections(r, s).collect()} == {"3(a)(i)": "3(a)", "3(b)": "3", "9": None}


def test_context_has_no_future(spark):
    d = spark.createDataFrame([(1, t, f"v{t}") for t in range(6)], "conv_id int, turn int, v string")
    for r in V.context(d, 3, F.col("v")).collect():
        assert r["context"] == [f"v{t}" for t in range(max(0, r["turn"] - 3), r["turn"])]
    last = {r["turn"]: r["context"] for r in V.first_and_last(d, 2, 2, F.col("v")).collect()}
    assert last[5] == ["v0", "v1", "v3", "v4"] and last[3] == ["v0", "v1", "v2"]


def test_patch_merge_refuses_unknown(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        L.patch_merge(base, spark.createDataFrame([(2, "b")], "k int, v string"), "k", [1])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 300)] + [(5, 7), (7, 5), (9, 9), (None, 3)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(100, 301), 3, 5, 7, 9]], "id long")
    got = {r["id"]: r["cluster"] for r in graph.components(edges, nodes).collect()}
    assert got == {**{i: 100 for i in range(100, 301)}, 3: 3, 5: 5, 7: 5, 9: 9}


def test_descendants_of_a_deep_tree_and_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(0, 2), (120, 0), (50, None)], "parent long, child long")
    got = {r["node"]: r["depth"] for r in graph.descendants(edges, 0).collect()}
    assert got == {0: 0, 1: 1, **{i: i - 1 for i in range(2, 121)}}
    tree = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "parent long, child long")
    assert {r["node"]: r["height"] for r in graph.path_to_root(tree, 3).collect()} == {3: 0, 2: 1, 1: 2}


def test_contains_passage_of_any_length(spark):
    words = [f"w{i}" for i in range(30)]
    passages = [" ".join(words[5 : 5 + n]) for n in (1, 2, 3, 8, 9, 10, 15)] + ["", "nothing like it", "x" + words[3]]
    p = spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    texts = [" ".join(words), " ".join(words[:13]) + "goes on", "ab" + " ".join(words[5:8]) + "cd", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {tuple(r) for r in O.contains_passage(d, p).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, x in enumerate(passages) if t and x.strip() and x in t}


def test_gram_cosine_beside_all_pairs(spark):
    from collections import Counter
    from math import sqrt

    texts = ["abcdefgh", "abcdefgx", "abcdabcd", "zzzzzzzz", "aaaaabcd", "abcdefghij abcdefghij", "qqqqabcd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    bags = [Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in texts]
    norm = lambda x: sqrt(sum(c * c for c in x.values()))
    cosine = lambda x, y: sum(x[g] * y[g] for g in x) / norm(x) / norm(y)
    for least in (0.2, 0.5, 0.8):
        got = {(r["a_id"], r["b_id"]): r["cosine"] for r in O.gram_cosine(df, df, "text", 3, least).collect()}
        assert got == pytest.approx({(i, j): c for j in range(len(texts)) for i in range(j) if (c := cosine(bags[i], bags[j])) >= least})


def test_running(spark):
    rows = [(g, x, (x * 7) % 11) for g in range(3) for x in range(40)]
    d = spark.createDataFrame(rows, "g int, x int, v int").repartition(5)
    for how, f in (("sum", sum), ("max", max)):
        for descending in (False, True):
            got = {(r["g"], r["x"]): r["b"] for r in running(d, "x", "v", how, "b", parts=7, descending=descending, by=("g",)).collect()}
            earlier = lambda x: [(y * 7) % 11 for y in range(40) if (y > x if descending else y < x)]
            assert got == {(g, x): f(earlier(x)) if earlier(x) else None for g, x, _ in rows}


def test_under_budget_passes_over_what_does_not_fit(spark):
    d = spark.createDataFrame([(1, 0, 5, 90), (1, 1, 9, 80), (1, 2, 7, 50), (1, 3, 1, 20), (2, 0, 1, 500)], "g int, o int, s int, n int")
    assert sorted(map(tuple, E.under_budget(d, "g", "s", "n", "o", 100).collect())) == [(1, 1, 1), (1, 3, 2)]
    assert sorted(map(tuple, E.under_budget(d, "g", "s", "n", "o", 200, most=2).collect())) == [(1, 1, 1), (1, 2, 2)]


def test_novel_is_strictly_above(spark):
    n = spark.createDataFrame([(i, 0, 1.0 - i / 100, 1) for i in range(101)] + [(200, 0, 0.01, 1)], "query_id int, vec_id int, sim double, rank int")
    assert {r["query_id"] for r in O.novel(n, 0.99).where("novel").collect()} == {100}


def test_contract_queries_reads_words_as_its_sql(spark, tmp_path):
    """Edges of words beside accented letters, vertical tabs, old letters s and the character 1."""
    import duckdb

    import __spark_entry__ as entry

    texts = ["the café\u00e9no here. And the rest", "the \u00e9not", "\u00e9the one", "the\u00e9 one", "mu\u017ft the one", "x\u017fhall the one", "the end.\x0bthe no", "the a\x01the b. not the\x01no", "the knot.\tThe no! the\u00a0no? The", None, "", "the never\u00df", "th\u00ebthe noé no\u0301"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, entry.queries()["contract_queries"](spark, str(tmp_path)).collect()))
    assert got == sorted(sql.execute(entry.oracle_sql()["contract_queries"]).fetchall())


def test_novelty_asks_with_all_rows(spark, data):
    import __spark_entry__ as entry

    rows = entry.queries()["novelty"](spark, data).select("query_id").collect()
    assert sorted(r["query_id"] for r in rows) == sorted(r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect())


def test_joint_decode_ends(spark):
    import pandas as pd

    chain = [f"q{i}" for i in range(10)]
    rows = [(1, q, a, 1.0 if (a == "yes") == (i == 0) else 0.0) for i, q in enumerate(chain) for a in ("yes", "no")]
    links = pd.DataFrame([(a, "yes", b, "yes", 2.0) for b, a in zip(chain, chain[1:])][::-1] + [(a, "yes", b, "yes", 2.0) for a, b in zip(chain, chain[1:])], columns=["a", "la", "b", "lb", "weight"])
    got = {r["question"]: r["answer"] for r in S.joint_decode(spark.createDataFrame(rows, "doc_id long, question string, answer string, score double"), links).collect()}
    assert set(got.values()) == {"yes"}
    loop = pd.DataFrame([("a", "yes", "b", "yes", 2.0), ("b", "yes", "a", "no", 5.0), ("a", "no", "b", "no", 2.0), ("b", "no", "a", "yes", 5.0)], columns=["a", "la", "b", "lb", "weight"])
    d = spark.createDataFrame([(1, q, a, 0.0) for q in "ab" for a in ("yes", "no")], "doc_id long, question string, answer string, score double")
    assert S.joint_decode(d, loop).count() == 2


def test_threshold_walks(spark):
    d = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.5, True), (0.5, True)], "c double, ok boolean")
    assert R.threshold_descent(d, "c", "ok", 0.8).first()["threshold"] == 0.8
    found = R.found_at_precision(d, "c", "ok", 0.8).first()
    assert found["found"] == 6 and found["threshold"] == 0.5


def _balanced(rows, pred):
    by = {}
    for r, p in zip(rows, pred):
        by.setdefault(r["gold"], []).append(p == r["gold"])
    return sum(sum(v) / len(v) for v in by.values()) / len(by)


def test_headroom_beside_a_loop(spark, data):
    rows = [r.asDict() for r in arms(spark, data).orderBy("item_idx").collect()]
    fraction, step = 0.23, 0.07
    sent, plain = set(), set()
    for fold in range(5):
        test = sorted((r for r in rows if r["fold"] == fold), key=lambda r: (r["free_conf"], r["item_idx"]))
        room, chunk = int(fraction * len(test)), max(1, int(step * len(test)))
        plain |= {r["item_idx"] for r in test[:room]}
        total = {}
        for r in test:
            total[r["gold"]] = total.get(r["gold"], 0) + 1
        worth = lambda r: ((r["expert_pred"] == r["gold"]) - (r["free_pred"] == r["gold"])) / (len(total) * total[r["gold"]])
        queue = {c: [r for r in test if r["free_pred"] == c] for c in sorted({r["free_pred"] for r in test})}
        while room:
            offers = [(sum(map(worth, q[: min(chunk, room)])) / len(q[: min(chunk, room)]), -c) for c, q in queue.items() if q]
            value, c = max(offers, default=(0, 0))
            if value <= 0:
                break
            took = queue[-c][: min(chunk, room)]
            sent |= {r["item_idx"] for r in took}
            queue[-c] = queue[-c][len(took) :]
            room -= len(took)
    route = lambda chosen: [r["expert_pred"] if r["item_idx"] in chosen else r["free_pred"] for r in rows]
    got = G.headroom(arms(spark, data), fraction, 2, "t", step).first()
    assert got["oracle_per_class"] == pytest.approx(_balanced(rows, route(sent))) and got["oracle_global"] == pytest.approx(_balanced(rows, route(plain)))
    assert got["headroom"] == pytest.approx(got["oracle_per_class"] - got["oracle_global"]) and got["over_null"] == pytest.approx(got["headroom"] - got["null_headroom"])
    assert got["worth_it"] == (got["over_null"] >= got["half_width"])


def test_shuffled_classes_keep_their_sizes(spark, data):
    a = arms(spark, data)
    rows = G.shuffled_classes(a, "x").collect()
    count = lambda name: {c: sum(r[name] == c for r in rows) for c in range(10)}
    assert len(rows) == a.count() and count("group") == count("free_pred") and sum(r["group"] != r["free_pred"] for r in rows) > len(rows) / 2


def test_group_rungs_keep_groups_whole(spark):
    d = spark.createDataFrame([(g, i, (g + (i == 0)) % 3) for g in range(40) for i in range(1 + g % 5)], "g int, i int, y int")
    small, large = ({(r["g"], r["i"]) for r in G.group_rung(d, "g", "y", f, "s").collect()} for f in (0.25, 0.6))
    sizes = {g: 1 + g % 5 for g in range(40)}
    assert small < large and all(sum(x[0] == g for x in part) in (0, sizes[g]) for part in (small, large) for g in sizes)


def test_router_learns_who_is_right(spark):
    rows = [(i, i % 5, i % 2, (i % 2) if i % 3 else 1 - i % 2, (i % 2) if i % 3 == 0 else 1 - i % 2, float(i % 3 == 0)) for i in range(300)]
    d = spark.createDataFrame(rows, "item_idx int, fold int, gold int, free_pred int, expert_pred int, x double")
    for kind in ("logistic", "trees"):
        got = G.router_scores(d, ["x"], kind, 5).collect()
        assert len(got) == 300 and all((r["score"] < 0) == (r["x"] == 1.0) for r in got)
    always = d.withColumn("expert_pred", d["gold"])
    assert G.router_scores(always, ["x"]).where("score > 0").count() == 0


def test_quoted_sections(spark):
    text = "One two three four. Five six\nseven eight, nine ten."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    sections = spark.createDataFrame([(1, 0, 20), (1, 20, 60)], "doc_id int, start int, end int")
    asked = spark.createDataFrame([(1, "two, three four"), (1, "seven eight nine"), (1, "one two"), (1, "not in there"), (1, None), (2, "two three four")], "doc_id int, evidence string")
    assert {(r["evidence"], r["start"]) for r in G.quoted_section(asked, sections, docs).collect()} == {("two, three four", 0), ("seven eight nine", 20)}


def test_plain_text(spark):
    from sluicegate.functions.text import plain

    d = spark.createDataFrame([("\uff21\uff22c  D-e",), ("\u2460 x\u00b2",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(plain("t")).collect()] == ["abc d e", "1 x2", None, ""]


def test_occurrences_of_phrases(spark):
    import re

    texts = ["The thing, the other; in the end", "bathe THE\u00e9 the", "", None, "in the in the"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    forms = ["the", "in the", "th"]
    for prefix in (False, True):
        want = {(i, f, m.start()) for i, t in enumerate(texts) for f in forms for m in re.finditer(rf"(?<![^\W_]){f}" + ("" if prefix else r"(?![^\W_])"), (t or "").lower())}
        assert {tuple(r) for r in M.occurrences(d, forms, prefix).collect()} == want
    assert M.occurrences(d, []).count() == 0


def test_resume_refuses_changed_texts(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "item int, sha string")
    done = spark.createDataFrame([(1, "a", "ok"), (5, "c", "<error: x>")], "item int, sha string, raw string")
    failed = F.startswith("raw", F.lit("<error:"))
    assert {r["item"]: r["state"] for r in M.resume(asked, done, failed).collect()} == {1: "done", 2: "copy", 3: "call", 4: "wait", 5: "call"}
    with pytest.raises(J.DataContractError):
        M.resume(asked, spark.createDataFrame([(1, "z", "ok")], "item int, sha string, raw string"), failed)


def test_contracts_of_joins(spark):
    a, b = spark.range(4), spark.range(1, 5)
    for call in (lambda: M.answered(a, b, "id"), lambda: M.answered(a, a.unionByName(a), "id"), lambda: M.disjoint(a, b, "id")):
        with pytest.raises(J.DataContractError):
            call()
    assert M.answered(a, a.withColumn("x", F.lit(1)), "id").count() == 4 and M.disjoint(a, spark.range(9, 12), "id").count() == 4


def test_state_shows_no_future(spark):
    turns = spark.createDataFrame([(1, t) for t in range(3)], "conv_id long, turn long")
    facts = spark.createDataFrame([(1, 1, "name", "Ann"), (1, 2, "name", "Bob"), (1, 0, "zip", "1")], "conv_id long, turn long, field string, value string")
    done = spark.createDataFrame([(1, 1, "look", ["a", "b"]), (1, 0, "ask", None)], "conv_id long, turn long, action string, values array<string>")
    got = [r["state"] for r in V.state_line(turns, facts, done).orderBy("turn").collect()]
    assert got == ["disclosed: none || actions: none", "disclosed: zip=1 || actions: ask()", "disclosed: zip=1; name=Ann || actions: ask(); look(a, b)"]


def test_registries_refuse_unknown_names(spark, data):
    for call in (registries.scorer, registries.metric):
        with pytest.raises(KeyError):
            call("nothing")
    a = arms(spark, data)
    with pytest.raises(ValueError):
        registries.allocate(a, "nothing", 0.5)
    with pytest.raises(KeyError):
        registries.cross_validated(a, "nothing")
    for rule, options in (("router", {"features": ["free_conf"]}), ("class_aware", {}), ("per_class_conf", {}), ("margin", {"probs": probabilities(a)})):
        share = registries.allocate(a, rule, 0.3, **options).agg(F.avg(F.col("escalated").cast("double"))).first()[0]
        assert 0 < share < 0.45, rule
    assert registries.allocate(a, "precision_floor", 0.0).where("escalated").count() >= registries.allocate(a, "precision_floor", 1.0).where("escalated").count()
