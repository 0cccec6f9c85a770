"""Operators 11 to 13: brute force, planted shapes and edges."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicegate.llm import centroids, curve, divergence
from tests.conftest import DATA

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value long, row long, range int, tokens long, ids string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "x", 1, 2, 3, 4, 5, "y") for i, t, lang, s in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def audit(rows, least):
    """The contract, word for word, in Python integers."""
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        of = [d for d in docs if d[0] == lang]
        holds = Counter(t for _, _, ts in of for t in set(ts))
        kept = [t for t in holds if holds[t] >= least]
        whole, groups = Counter(), {s: Counter() for _, s, _ in of}
        for _, s, ts in of:
            groups[s].update(t for t in ts if t in set(kept))
            whole.update(t for t in ts if t in set(kept))

        def p(c, t, by, v=len(kept)):
            return 1 + 10**9 * (c[t] + 2) // (by + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        share = {s: {t: p(c, t, sum(c.values())) for t in kept} for s, c in groups.items()}
        base = {t: p(whole, t, sum(whole.values())) for t in kept}
        for s, c in groups.items():
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            best = sorted((-f(share[s][t], base[t]), t.encode(), t) for t in kept if c[t] and share[s][t] > base[t])[:10]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(best)}
    return out


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["Éa", "éa", "日本", "Z"]
    rows = []
    for i in range(400):
        s = int(rng.integers(0, 9))
        chosen = rng.choice(words, int(rng.integers(0, 40)), p=None)
        rows.append((i, " ".join(chosen) + " 12 it's", ["en", "DE", None][i % 3], None if s == 8 else f"s{s}"))
    return rows + [(400, None, "en", "bare"), (401, "", "xx", "a"), (402, "1 2", "xx", "b"), (403, "alone " * 9, "yy", None), (404, "alone", "yy", "")] + [(405, "same words here", "zz", f"k{i % 2}") for i in range(12)]


@pytest.mark.parametrize("terms,groups", [(4096, 64), (40, 64), (25, 2)])
def test_divergence_brute_force(spark, mixed, terms, groups):
    found = divergence.Audit(rows_of(spark, mixed).repartition(5), block_terms=terms, block_groups=groups).result().collect()
    assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == audit(mixed, 10)


def test_divergence_edges(spark):
    assert divergence.Audit(rows_of(spark, [])).result().count() == 0
    one = [(1, "x" * 3_000_000 + " long " * 5, None, None), (1, None, None, "b"), (None, "long", None, "b")]
    found = divergence.Audit(rows_of(spark, one), least_docs=1).result().collect()
    assert {tuple(r) for r in found} == audit(one, 1)


def test_share_is_exact_for_large_counts():
    rng = np.random.default_rng(0)
    for top in (10**3, 10**9, 9 * 10**13 // 2):
        count, extra, kept = rng.integers(0, top, 200), rng.integers(0, top, 200), rng.integers(1, 10**6, 200)
        total = count + extra
        assert divergence.share(count, total, kept).tolist() == [1 + 10**9 * (int(c) + 2) // (int(n) + 2 * int(v)) for c, n, v in zip(count, total, kept)]


def lloyd(x, k, rounds, ids):
    """(cluster, distance) by all distances, and the centroids."""
    import hashlib

    order = sorted(range(len(x)), key=lambda i: (ids[i] is None, "" if ids[i] is None else hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), x[i]))
    c = [list(x[i]) for i in order[:k]]
    for at in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for v in x]
        if at < rounds:
            own = defaultdict(list)
            for v, (_, j) in zip(x, best):
                own[j].append(v)
            c = [[sum(col) // len(own[j]) for col in zip(*own[j])] if own[j] else m for j, m in enumerate(c)]
    return [(j, d) for d, j in best], c


@pytest.mark.parametrize("spread,k", [(0.2, 6), (5.0, 40)])
def test_centroids_brute_force(spark, spread, k):
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 3, (6, 64))
    v = (middle[rng.integers(0, 6, 240)] + rng.normal(0, spread, (240, 64))).astype(np.float32)
    v[10:14] = v[9]  # ties and repeated rows
    rows = [(int(i), [float(y) for y in r]) for i, r in enumerate(v)]
    done = centroids.Clustering(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), k=k)
    expected, c = lloyd([[int(np.floor(256 * y)) for y in r] for _, r in rows], k, 5, [i for i, _ in rows])
    assert done.centroids.tolist() == c
    found = {r["vec_id"]: r for r in done.result().collect()}
    assert [(found[i]["cluster"], found[i]["distance"]) for i in range(240)] == expected
    assert {r["inertia"] for r in found.values()} == {sum(d for _, d in expected)}
    for r in found.values():
        assert r["cluster_inertia"] == sum(d for j, d in expected if j == r["cluster"])
    pairs, exact = done.pruning()
    assert pairs == 240 * k and exact < pairs
    if spread < 1:
        assert exact < pairs / 2  # most centroids of far clusters are screened


def test_centroids_edges(spark):
    nan, one = float("nan"), [1.0] * 64
    rows = [(1, one), (1, [0.5] * 64), (2, None), (3, [nan] + one[1:]), (4, one[:63]), (5, one + [1.0]), (6, [None] + one[1:]), (7, [float("inf")] + one[1:]), (None, [9.0] * 64), (8, []), (1, one)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("c")).withColumn("x", F.lit(1))
    found = centroids.Clustering(d).result().collect()
    # the repeated vector stands for two centroids of which the smaller number takes both rows
    assert sorted((r["vec_id"] or -1, r["distance"]) for r in found) == [(-1, 0), (1, 0), (1, 0), (1, 0)]
    assert len({r["cluster"] for r in found}) == 3 and {r["inertia"] for r in found} == {0}
    assert centroids.Clustering(d.where("vec_id = 2")).result().count() == 0
    with pytest.raises(Exception, match="not exact"):
        centroids.Clustering(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>"))


def check_packing(rows, pieces, width=2048):
    """Every id in one piece, crc of each, gapless sequences, no padding but in sequences of no power of two."""
    library = Tokenizer.from_file(BYTE)
    ids = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) + (i,) for i, t, *_ in rows)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for doc, texts in ((i, [k[:-1] for k, n in ids.items() for _ in range(n) if k[-1] == i]) for i in {r[0] for r in rows}):
        assert sum(p["length"] for p in by_doc[doc]) == sum(map(len, texts))
        if len(texts) == 1:
            own, at = sorted(by_doc[doc], key=lambda p: p["start"]), 0
            for p in own:
                assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(texts[0])
                assert p["ids_crc32"] == zlib.crc32(np.array(texts[0][at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(texts[0])
    used = defaultdict(list)
    for p in pieces:
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    pad = 0
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
        pad += 0 if at & (at - 1) == 0 else width - at
    assert pad == 0
    return used


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    line = curve.Line(docs, BYTE, ranges=7)
    pieces = line.pieces(with_ids=True).cache()
    used = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], pieces.collect())
    assert sorted(used) == list(range(len(used)))
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in curve.sequences(pieces).collect()}
    assert all(len(joined[s]) == 4 * sum(n for _, n in used[s]) for s in used)
    again = {tuple(r) for r in curve.Line(docs, BYTE, ranges=7).pieces().collect()}
    assert again == {tuple(r)[:-1] for r in pieces.collect()}
    # neighbours on the line are of one language more often than documents at large
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    order = list(dict.fromkeys(p["doc_id"] for p in sorted(pieces.collect(), key=lambda p: (p["sequence_id"], p["offset"]))))
    same = np.mean([lang[a] == lang[b] for a, b in zip(order, order[1:])])
    chance = sum((n / len(lang)) ** 2 for n in Counter(lang.values()).values())
    assert same > chance + 0.15, (same, chance)


def test_packing_edges(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None, None, None), (2, "", "a", "b"), (3, long, "a", "b"), (None, "no id", "a", "b"), (4, "<|endoftext|> é日", None, None)] + [(5, "same text", "a", "b")] * 300
    check_packing(rows, curve.Line(rows_of(spark, rows).repartition(3), BYTE, ranges=5).pieces().collect())
    assert curve.Line(rows_of(spark, []), BYTE).pieces().count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_is_a_curve(dims, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = curve.hilbert(cells, bits)
    assert sorted(index.tolist()) == list(range(side**dims))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1)
    assert (steps == 1).all()  # neighbours on the curve are neighbours in space
