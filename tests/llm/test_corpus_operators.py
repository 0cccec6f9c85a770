"""Each operator beside a brute-force version, the library it follows, or held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicegate.llm import bpe, counts, fingerprints, idtable, jaccard, lattice, mixing, packing, passages, quality, queries, topk, wordids
from tests.conftest import DATA

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP) if lower else text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.orderBy("doc_id").collect()


def brute_components(rows, k, num, den):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (2, 50, 100)])
def test_jaccard(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(jaccard, "COLUMN", 5)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(50)]
    rows = []
    for d in range(120):
        w = list(base)
        if d % 3 == 0:
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif d % 3 == 1:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(30))] + base[: rng.randrange(40)]
        else:
            w = [rng.choice(vocabulary[:3]) for _ in range(rng.randrange(8))]
        rows.append((d, " ".join(w).title() if d % 7 else " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, k, num, den).collect()}
    assert got == brute_components(rows, k, num, den)


def test_jaccard_documents(spark, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op1_jaccard(spark, DATA).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in rows], 4, 85, 100)


def test_fingerprints(spark, rows):
    got = {r["doc_id"]: r for r in queries.op2_fingerprints(spark, DATA).collect()}
    down = rows[::-1]
    assert len(got) == len(rows)
    ahead = 0
    for r, after in zip(down, [*down[1:], down[0]], strict=True):
        g, changed = got[r["doc_id"]], fingerprints.edited(r["text"], after["text"])
        n = len(r["text"]) // 3
        assert changed == r["text"][: len(r["text"]) - n] + after["text"][:n]
        assert g["n_chars"] == len(r["text"]) and g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert g["fingerprint"] == fingerprints.shown(fingerprints.fingerprints([r["text"].encode()]))[0]
        ahead += g["near_edited"] > g["near_next"]
    assert ahead >= 0.98 * len(rows)


def test_fingerprint_does_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randrange(3000))).encode() for _ in range(40)]
    together = fingerprints.fingerprints(texts)
    assert all((fingerprints.fingerprints([t])[0] == together[i]).all() for i, t in enumerate(texts))
    swapped = texts[5][:1000] + b"x" + texts[5][1000:]
    near, far = fingerprints.likeness(together[5:6], fingerprints.fingerprints([swapped])), fingerprints.likeness(together[5:6], together[6:7])
    assert near[0] > far[0]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b, most = "".join(rng.choice("abc") for _ in range(rng.randrange(12))), "".join(rng.choice("abc") for _ in range(rng.randrange(12))), rng.randrange(10)
        line = list(range(len(b) + 1))
        for i, x in enumerate(a):
            line = _next(line, i, x, b)
        assert fingerprints.distance(a, b, most) == (line[-1] if line[-1] <= most else None)


def _next(line, i, x, b):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(line[j + 1] + 1, out[j] + 1, line[j] + (x != y)))
    return out


def odd_texts(seed, n=400):
    rng = random.Random(seed)
    return ["", " ", "<|endoftext|>", "a <|endoftext|> b", "aaaaaaaaaaaa", "it's IT'S 'S", "\n\n a\t b \n", "x\xa0y z", "é́ 中文 ١٢ 😀"] + ["".join(rng.choice(" \n\t abAB'.,1éÉ中!<|Σİ́") for _ in range(rng.randrange(40))) for _ in range(n)]


def test_bpe(spark, rows):
    library = Tokenizer.from_file(BYTE)
    texts = odd_texts(3) + [r["text"] for r in rows[:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in bpe.digests(df, BYTE, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == ids
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts(spark):
    library, own = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE)
    rng = random.Random(5)
    for text in odd_texts(6, 150):
        tree = counts.TokenTree(text, own)
        for _ in range(4):
            tree.edit(rng.randrange(50), rng.randrange(10), "".join(rng.choice(" \nab'1é中") for _ in range(rng.randrange(7))))
            if rng.random() < 0.5:
                tree.settle()
        tree.settle()
        assert tree.n_tokens == len(library.encode(tree.text, add_special_tokens=False).ids)
    got = queries.op4_token_counts(spark, DATA)
    assert got.where("n_reencoded >= n_pretokens and n_pretokens > 100").count() == 0


def test_topk(spark):
    e = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], np.float64))) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in queries.op5_topk(spark, DATA).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q, x in e:
        if q % 50 == 0:
            assert got[q] == [(v, s) for s, v in sorted((-int(x @ y), v) for v, y in e if v != q)[:5] for s in [-s]]


def test_topk_bounds():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 30)), rng.normal(size=(25, 30))
    for s in topk.RESOLUTIONS:
        assert (topk.statistics(x, s) @ topk.statistics(y, s).T >= x @ y.T - 1e-9).all()
    best = topk.Best(np.arange(20), x, 3)
    clustered = np.repeat(x[:5], 50, axis=0) + rng.normal(size=(250, 30)) * 0.01
    for at in range(0, 250, 50):
        best.meet(np.arange(1000 + at, 1050 + at), clustered[at : at + 50])
    assert best.exact < best.pairs
    assert np.allclose(best.score, -np.sort(-(x @ clustered.T), axis=1)[:, :3])


def test_packing(spark, rows):
    library = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in queries.op6_token_files(spark, DATA).collect()}
    start = 0
    for r in rows:
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 2]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def _library_rows(own, texts):
    ids, at = own.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def test_library_ids(monkeypatch):
    texts = [*odd_texts(7, 2000), None, "<|ENDOFTEXT|> <|x|>.", "\xa0 \xa0", "H\u0331 h\u0331", "\u00d7\u00f7\u0250 \u0130x"]
    library = Tokenizer.from_file(WORD)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert _library_rows(wordids.LibraryIds(WORD), texts) == want
    monkeypatch.setattr(idtable, "KEPT", 500)  # the table drops parts again and again
    own = wordids.LibraryIds(WORD)
    assert own.by_words and [r for i in range(0, len(texts), 50) for r in _library_rows(own, texts[i : i + 50])] == want


def test_library_ids_of_another_kind_of_file():
    own, library, texts = wordids.LibraryIds(BYTE), Tokenizer.from_file(BYTE), odd_texts(8, 300)
    assert not own.by_words and _library_rows(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_bit_fields(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5001, dtype=np.uint64).astype(np.uint32)
    payload, offsets = packing.pack_blocks(ids, bits, 100)
    assert (packing.unpack_range(payload, offsets, bits, 100, len(ids), 0, len(ids)) == ids).all()
    assert (packing.unpack_range(payload, offsets, bits, 100, len(ids), 333, 1234) == ids[333:1234]).all()


def test_quality(spark):
    sf = DATA.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in queries.op7_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r["doc_id"]], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(g["held_out"] for g, _ in held) and len(held) > 50
    assert sum(g["predicted"] == q for g, q in held) >= 0.95 * len(held)


def test_trees_are_flat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, trees=30)
    p = model.score(x)
    assert ((p > 0.5) == y).mean() > 0.97
    row, margin = x[7], model.base
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
        margin += model.leaf[t, node - model.feature.shape[1]]
    assert p[7] == pytest.approx(1 / (1 + math.exp(-margin)))


def test_mixing(spark, rows):
    got = queries.op8_mixing(spark, DATA).collect()
    size = {r["doc_id"]: len(words(r["text"], False)) for r in rows}
    sources = sorted({r["source"] for r in rows})
    totals = [sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources]
    want = mixing.targets(totals)
    assert sum(want) == pytest.approx(1.5 * sum(totals)) and all(t <= 2 * n + 1e-9 for t, n in zip(want, totals, strict=True))
    of = {r["doc_id"]: sources.index(r["source"]) for r in rows}
    taken = Counter()
    for r in got:
        s = of[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in range(len(sources)))
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op8_mixing(spark, DATA).collect()))


def test_schedule():
    need = [5, 100, 0, 37, 1000, 1]
    plan = mixing.Schedule(need)
    source, rank = plan.slots(np.arange(plan.n_slots))
    for s, n in enumerate(need):
        own = rank[(source == s) & (rank >= 0)]
        assert own.tolist() == list(range(n))
    first = source[: plan.n_slots // 4]
    assert abs((first == 4).mean() - 1000 / 1143) < 0.02


def test_mixed_texts(spark, docs):
    mix = mixing.Mix(docs)
    taken = {r["doc_id"]: r["taken"] for r in mix.result().collect()}
    made = Counter()
    for r in mixing.mixed(docs).collect():
        made[r["doc_id"]] += len(words(r["text"], False))
        assert r["n_chars"] == len(r["text"])
    assert made == Counter({k: v for k, v in taken.items() if v})


def test_lattice_counts(spark, rows):
    got = {r["doc_id"]: r for r in queries.op9_lm_score(spark, DATA).collect()}
    train = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            train.update([*words(r["text"]), None])
    n, v = sum(train.values()), len(train)
    for r in rows:
        tokens, g = [*words(r["text"]), None], got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel=1e-9)
        assert g["score"] < 0


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces.load(PIECE)
    known = {}

    def brute(raw):
        data = b" " + raw
        total = [1.0] + [0.0] * len(data)
        for i in range(len(data)):
            weights = (pieces.start if i == 0 else pieces.inner)[0]
            if i:
                total[i + 1] += total[i] * math.exp(pieces.inner[0, pieces.byte[data[i]]])
            for j in range(i + 1, len(data) + 1):
                at = known.get(data[i:j])
                if at is not None and weights[at] > -np.inf:
                    total[j] += total[i] * math.exp(weights[at])
        return math.log(total[-1]) + pieces.stop[0]

    tried = [b"the", b"thing", "élan".encode(), b"xqzj", b"a", b"internationalization"]
    for raw in tried:
        data = np.frombuffer(b" " + raw, np.uint8)
        for length, at, piece in pieces.arcs(data, np.arange(len(data), 0, -1)):
            if piece is not None:
                known |= {data[p : p + length].tobytes(): int(i) for p, i in zip(at, piece, strict=True)}
    assert pieces.log_words(tried)[:, 0] == pytest.approx([brute(r) for r in tried])


def test_passages(spark, rows):
    got = defaultdict(set)
    tokens = {r["doc_id"]: words(r["text"]) for r in rows}
    for r in queries.op10_passages(spark, DATA).collect():
        a, b = tokens[r["doc_id"]][r["start"] : r["end"]], tokens[r["other_id"]][r["other_start"] : r["other_end"]]
        assert min(len(a), len(b)) >= 50 and r["equal"] >= 0.8 * max(len(a), len(b)) and r["other_id"] < r["doc_id"]
        got[r["doc_id"]].update(range(r["start"], r["end"]))
    first, want = defaultdict(set), defaultdict(set)
    for d, w in tokens.items():
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])].add(d)
    for d, w in tokens.items():
        for i in range(len(w) - 49):
            if min(first[tuple(w[i : i + 50])]) < d:
                want[d].update(range(i, i + 50))
    assert want and all(want[d] <= got[d] for d in want)


def test_planted_passage(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(55)]
    fuzzy = list(passage)
    fuzzy[20], fuzzy[40] = word(), word()
    texts = [" ".join([*(word() for _ in range(60)), *p, *(word() for _ in range(40))]) for p in (passage, passage, fuzzy, [])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in passages.passages(df).collect()}
    assert {(1, 0, 60, 115), (2, 0, 60, 115)} <= got and not any(3 in g[:2] for g in got)
    left = {r["doc_id"]: len(words(r["text"])) for r in passages.without_passages(df).collect()}
    assert left == {0: 155, 1: 100, 2: 100, 3: 100}


def test_components(spark):
    from sluicegate.llm.components import components

    edges = [(i, i + 1) for i in range(10, 40)] + [(3, 4), (4, 5), (1, 40)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [1, *range(10, 41)]}, 3: 3, 4: 3, 5: 3}


def test_pipeline(spark, docs):
    import corpus_pipeline as P

    at = docs
    for name, stage in P.STAGES[:-1]:
        before, at = at, stage(spark, at, DATA).cache()
        assert at.columns == docs.columns, name
        assert at.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_copies":
            want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80, 100)
            assert {r["doc_id"] for r in at.collect()} == {d for d, (_, c) in want.items() if c == d}
    library = Tokenizer.from_file(BYTE)
    coded = P.STAGES[-1][1](spark, at, DATA).collect()
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in at.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded) == want
    assert P.run(spark, DATA).agg(F.count(F.lit(1))).first()[0] == len(coded)


def test_passage_of_parts_with_other_holders(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = lambda *parts: " ".join([*(word() for _ in range(30)), *(w for p in parts for w in p), *(word() for _ in range(30))])
    one, two = ([word() for _ in range(30)] for _ in range(2))
    rows = [(i, text(one if i % 2 else two)) for i in range(20)] + [(500, text(one, two))]
    rows += [(600 + i, text(one if i % 2 else two)) for i in range(20)] + [(900, text(one, two))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(900, 500, 30, 90)} == {(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in passages.passages(df).collect() if r["end"] - r["start"] >= 60}
    left = {r["doc_id"]: len(words(r["text"])) for r in passages.without_passages(df).collect()}
    assert left[500] == 120 and left[900] == 60


def _lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        before, line = line, [0]
        for j, y in enumerate(b):
            line.append(before[j] + 1 if x == y else max(before[j + 1], line[j]))
    return line[-1]


def _is_alignment(a, b, pairs):
    return all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_gaps_beside_plain_subsequences():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))]) for _ in range(2))
        found = passages._common(a, b)
        assert _is_alignment(a, b, found) and len(found) == _lcs(a.tolist(), b.tolist())
        assert _is_alignment(a, b, passages._common(a, b, 3)) and _is_alignment(a, b, passages._gap(a, b, 10))
    a = np.array([rng.randrange(10**6) for _ in range(3000)])
    b = np.concatenate([a[:1000], a[1100:2000], a[:30], a[2000:]])
    assert len(passages._gap(a, b)) >= 2890 and len(passages._common(a, b, 200)) >= 2890  # beyond CELLS, by anchors; in a band


def test_stretches_beside_every_pair_of_ends():
    rng = random.Random(2)
    for _ in range(300):
        at, partner = np.zeros((2, rng.randrange(5, 60)), int)
        x = y = 0
        for i in range(len(at)):
            x, y = x + 1 + (rng.random() < 0.2) * rng.randrange(6), y + 1 + (rng.random() < 0.2) * rng.randrange(6)
            at[i], partner[i] = x, y
        columns = np.concatenate([[0], np.cumsum(np.maximum(np.diff(at), np.diff(partner)))])
        good = lambda i, j: j - i + 1 >= 0.8 * (columns[j] - columns[i] + 1) - 1e-9 and min(at[j] - at[i], partner[j] - partner[i]) + 1 >= 10
        want = [(i, j) for i in range(len(at)) for j in range(i, len(at)) if good(i, j)]
        want = [p for p in want if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in want)]
        got = passages.stretches(at, partner, 10, 0.8)
        assert all(good(*g) for g in got)
        assert len(got) <= len(want) and all(any(w[0] <= g[0] and g[1] <= w[1] for w in want) for g in got)
        assert all(any(w[0] <= g[0] and g[1] <= w[1] and columns[g[1]] - columns[g[0]] >= (columns[w[1]] - columns[w[0]]) / 2 for g in got) for w in want)


def test_chains_beside_a_quadratic_recursion():
    rng = random.Random(3)
    for _ in range(200):
        runs = sorted({(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9)) for _ in range(rng.randrange(1, 12))})
        best = []
        for i, (p, q, n) in enumerate(runs):
            before = [best[j] - passages.GAP_COST * ((p - x - m) + (q - y - m)) for j, (x, y, m) in enumerate(runs[:i]) if x < p and y < q]
            best.append(n + max(0.0, *before, 0.0) if before else float(n))
        top = passages.chains(runs)[0]
        score = sum(n for *_, n in top) - passages.GAP_COST * sum((p - x - m) + (q - y - m) for (x, y, m), (p, q, _) in zip(top, top[1:]))
        assert score == pytest.approx(max(best))


def test_cover():
    rng = random.Random(4)
    for _ in range(500):
        spans = sorted((s, s + rng.randrange(1, 9)) for s in (rng.randrange(40) for _ in range(rng.randrange(1, 12))))
        start, end = np.array(spans).T
        kept = passages.cover(start, end)
        assert {v for i in kept for v in range(start[i], end[i])} == {v for s, e in spans for v in range(s, e)}


def _fuzzy_rows(rng, rate, n):
    """Documents 2 i and 2 i + 1 that share a passage of 60 words, in the second with edits, and where it lies there."""
    common = [f"c{i}" for i in range(60)]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else f"x{rng.randrange(1 << 30)}"
    rows, plan = [], []
    while len(plan) < n:
        passage = [word() for _ in range(60)]
        edited = []
        for w in passage:
            r = rng.random()
            edited += [word()] if r < 0.7 * rate else [] if r < 0.85 * rate else [w, word()] if r < rate else [w]
        if _lcs(passage, edited) < 0.8 * max(60, len(edited)) or len(edited) < 50:
            continue
        d = 2 * len(plan)
        rows += [(d, " ".join([*(word() for _ in range(80)), *passage, *(word() for _ in range(90))])), (d + 1, " ".join([*(word() for _ in range(70)), *edited, *(word() for _ in range(50))]))]
        plan.append((d + 1, d, 70, 70 + len(edited)))
    return rows, plan


@pytest.mark.parametrize("rate,least", [(0.05, 0.95), (0.1, 0.95), (0.15, 0.9)])
def test_recall_of_edited_passages(spark, rate, least):
    rows, plan = _fuzzy_rows(random.Random(5), rate, 60)
    got = defaultdict(list)
    for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got[r["doc_id"], r["other_id"]].append((r["start"], r["end"]))
    assert sum(any(min(e, b) - max(s, a) >= 0.8 * (e - s) for a, b in got[d, o]) for d, o, s, e in plan) >= least * len(plan)


def test_seeds_met_in_their_step(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"x{rng.randrange(1 << 30)}"
    passage = [word() for _ in range(55)]
    rows = [(d, " ".join([*(word() for _ in range(d % 7)), *(passage if d % 3 else []), *(word() for _ in range(30))])) for d in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = []
    for often in (2, 8, 10**6):
        monkeypatch.setattr(passages, "OFTEN", often)
        found.append(sorted(map(tuple, passages.spans(passages.passages(df)).collect())))
    assert found[0] == found[1] == found[2] == [(d, d % 7, d % 7 + 55) for d in range(2, 120) if d % 3]


def _scalar_fingerprint(text):
    """A walk at a time, in plain Python, from the rules of the module's docstring and its tables."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 31
        x = x * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        x = x * 0xD6E8FEB86659FD93 & mask
        return x ^ x >> 32

    cuts, start = [], 0
    for i in range(len(text)):
        h = 0
        for back, m in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)):
            h = (h + text[i - back] * m) & 0xFFFFFFFF if i >= back else h
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        if i == len(text) - 1 or (i >= 6 and h >> (32 - fingerprints.CUT_BITS) == 0):
            cuts += [(a, min(a + fingerprints.LONGEST, i + 1)) for a in range(start, i + 1, fingerprints.LONGEST)]
            start = i + 1
    best = {}
    for a, z in cuts:
        values, at = [0] * len(fingerprints._SAMPLED), a
        for step in range(2 * fingerprints.LONGEST):
            if at >= z:
                break
            for band, chosen in enumerate(fingerprints._SAMPLED.tolist()):
                for _ in range(chosen.count(step)):
                    values[band] = (values[band] * 0x9FB21C651E98DF25 + text[at] + 1 + (band << 16) + (step << 24)) & mask
            at += mix(step * 256 + text[at] + 77) & 1
        for v in values:
            if v:
                cell = mix(v) & (fingerprints.REGISTERS - 1)
                best[cell] = min(best.get(cell, mask), mix(v))
    return "".join(f"{best[i] >> 20 & 255:02x}" if i in best else "--" for i in range(fingerprints.REGISTERS))


def test_fingerprints_beside_scalar_walks(rows):
    texts = [b"", b"a", b"abcdefgh" * 3, b"\n" * 1500, "\u00e9\u4e2d".encode() * 90] + [r["text"].encode()[:3000] for r in rows[:25]]
    assert fingerprints.shown(fingerprints.fingerprints(texts)) == [_scalar_fingerprint(t) for t in texts]


def _edit_share(a, b):
    d = fingerprints.distance(a, b, max(len(a), len(b)))
    return 1 - d / max(len(a), len(b), 1)


def test_near_copies_beside_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    texts = []
    for rate in (0, 0.01, 0.03, 0.05):
        for _ in range(12):
            t = " ".join(word() for _ in range(250))
            texts += [t, "".join(rng.choice("xyz ") if rng.random() < rate else c for c in t)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_copies(df).collect()}
    linked = [(i, j) for j in range(len(texts)) for i in range(max(0, j - 1), j) if _edit_share(texts[i], texts[j]) >= 0.8]
    assert len(linked) == 48 and all(got[j] == got[i] for i, j in linked if i < 48)  # up to 1 % of characters: all
    assert sum(got[j] == got[i] for i, j in linked) >= 0.9 * len(linked)
    assert all(_edit_share(texts[c], texts[d]) >= 0.8 for d, c in got.items())


def test_statistics_beside_plain_python():
    rng = random.Random(12)
    texts = ["", "   ", "One two.", "a\nb\na\nb c", "AAA AAA aaa!!", "\u00e9t\u00e9 \u4e2d\u6587 | x"] + ["".join(rng.choice("aB1 .\n!|\u00e9$") for _ in range(rng.randrange(200))) for _ in range(40)]
    got = quality.statistics(pa.array(texts))
    at = {name: i for i, name in enumerate(quality.FEATURES)}
    for t, x in zip(texts, got, strict=True):
        raw, w = t.encode(), re.findall(r"[^\x20\x09-\x0D]+", t)
        low = [v.translate(UP) for v in w]
        n, b, lines = max(len(w), 1), max(len(raw), 1), [v for v in (re.findall(r"[^\x20\x09-\x0D]+", li.translate(UP)) for li in t.split("\n")) if v]
        marks = [c for c in raw if 33 <= c < 127 and not chr(c).isalnum()]
        pairs = list(zip(low, low[1:]))
        letters = lambda v: sum(c > 127 or chr(c).isalpha() for c in v.encode())
        want = {
            "chars": len(t), "words": len(w), "lines": len(lines), "longest_word": max((len(v.encode()) for v in w), default=0), "word_length": sum(len(v.encode()) for v in w) / n,
            "letter_share": sum(c > 127 or chr(c).isalpha() for c in raw) / b, "digit_share": sum(48 <= c < 58 for c in raw) / b, "mark_share": len(marks) / b, "upper_share": sum(65 <= c < 91 for c in raw) / b,
            "exclamation_share": raw.count(b"!") / b, "bar_share": raw.count(b"|") / b, "line_words": len(w) / max(len(lines), 1), "type_share": len(set(low)) / n, "top_word_share": max(Counter(low).values(), default=0) / n,
            "repeated_line_share": 1 - len({tuple(v) for v in lines}) / max(len(lines), 1), "worded_share": sum(letters(v) > 0 for v in w) / n, "marked_word_share": sum(letters(v) < len(v.encode()) for v in w) / n,
            "short_word_share": sum(len(v.encode()) <= 3 for v in w) / n, "repeated_pair_share": 1 - len(set(pairs)) / max(len(pairs), 1), "distinct_bytes": len(set(raw)),
        }
        assert {k: x[at[k]] for k in want} == pytest.approx(want), t


def test_first_split_beside_every_threshold():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (300, 3)).astype(float)
    y = (rng.random(300) < 0.2 + 0.6 * (x[:, 1] > 11)).astype(float)
    model = quality.fit(x, y, trees=1, depth=1, bins=64, penalty=1.0, least=2.0)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    best = {}
    for f in range(3):
        for t in range(20):
            left = x[:, f] <= t
            if h[left].sum() >= 2 and h[~left].sum() >= 2:
                best[f, t] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
    assert (int(model.feature[0, 0]), model.threshold[0, 0]) in [k for k, v in best.items() if v >= max(best.values()) - 1e-9]
    left = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
    assert model.leaf[0] == pytest.approx([-0.15 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def _lattice_words(pieces):
    """P(word) in a component by a plain recursion over all segmentations."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    number, names = {}, 0
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            names += 1
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            raw = m.id_to_piece(i).replace("\u2581", " ").encode()
            if b" " not in raw[1:]:
                number[raw] = names
                names += 1

    def of(word, z):
        data = b" " + word.encode()
        total = [1.0] + [0.0] * len(data)
        for i in range(len(data)):
            weights = (pieces.start if i == 0 else pieces.inner)[z]
            if i:
                total[i + 1] += total[i] * math.exp(weights[pieces.byte[data[i]]])
            for j in range(i + 1, min(len(data), i + pieces.longest) + 1):
                if (at := number.get(data[i:j])) is not None:
                    total[j] += total[i] * math.exp(weights[at])
        return total[-1] * math.exp(pieces.stop[z])

    return of


def test_scores_beside_a_plain_model(spark):
    rng = random.Random(13)
    vocabulary = {"en": ["the", "house", "of", "green", "xqz", "walking"], "de": ["das", "haus", "von", "gr\u00fcn", "the"]}
    rows = [(d, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(12))) + " " * (d % 2) + f"rare{d}", lang) for d in range(40) for lang in [rng.choice(["en", "de"])]] + [(90, "", "en"), (91, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    model = lattice.Model(docs.where(~lattice.held_out()), PIECE)
    for start, inner, stop in zip(model.pieces.start, model.pieces.inner, model.pieces.stop, strict=True):
        assert np.exp(start).sum() == pytest.approx(1) and np.exp(inner).sum() + math.exp(stop) == pytest.approx(1)
    word = _lattice_words(model.pieces)
    names = [None, *model.names]
    assert set(model.names) == {"en", "de"}
    count = [Counter() for _ in names]
    for d, t, lang in rows:
        if not held(d):
            count[names.index(lang)].update([*words(t), None])
    ends = [c.pop(None, 0) for c in count]
    n = [sum(c.values()) + e for c, e in zip(count, ends, strict=True)]
    discount = [min(max((o := sum(v == 1 for v in c.values())) / max(o + 2 * sum(v == 2 for v in c.values()), 1), 0.1), 0.95) for c in count]
    end = [e / m if c else 0.5 for e, m, c in zip(ends, n, count, strict=True)]
    share = [(e + 0.5) / (sum(ends) + 0.5 * len(ends)) for e in ends]

    def of(w, z):
        if not count[z]:
            return 0.5 * word(w, z)
        return max(count[z][w] - discount[z], 0) / n[z] + discount[z] * len(count[z]) / n[z] * word(w, z)

    def document(t, z):
        return math.prod([end[z], *(of(w, z) for w in words(t))])

    assert all(sum(of(w, z) for w in {v for c in count for v in c}) + end[z] <= 1 + 1e-9 for z in range(len(names)))
    got = {r["doc_id"]: r["score"] for r in lattice.score(docs, model, lattice.held_out()).collect()}
    assert got == pytest.approx({d: math.log10(sum(share[z] * document(t, z) for z in range(len(names)))) for d, t, _ in rows})


def test_expected_counts_beside_all_segmentations():
    pieces = lattice.Pieces.load(PIECE)
    start, inner = pieces.lattices([b"the", b"thing"]).expected(np.zeros(2, int))
    assert start.sum() == pytest.approx(2)  # each word begins with one piece
    before = pieces.log_words([b"the", b"thing"]).sum()
    pieces.weigh(start, inner, np.array([2.0]))
    assert pieces.log_words([b"the", b"thing"]).sum() > before
