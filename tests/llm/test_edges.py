"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: each operator has a defined result."""

import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sluicegate.llm import bpe, common, counts, fingerprints, jaccard, lattice, mixing, packing, passages, quality, topk
from sluicegate.llm.components import components
from tests.conftest import DATA

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, row long, component_id long, n long, start long"
LONG = " ".join(f"w{i}" for i in range(30_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 0.1, 7, 8, 9, 10, 11) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    same = " ".join(f"s{i}" for i in range(80))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, same, "en", "a"), (5, same, "de", None), (5, same, "de", None), (6, LONG, "en", "b"), (None, same, "en", "b"), (7, "one", "en", "c")]
    return table(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(1, None, 0), (None, 1, 0), (2, 5, 1)], "doc_id long, quality int, toxic int")


def test_jaccard(odd, empty):
    rows = [tuple(r) for r in jaccard.join(odd, 4, 85, 100).collect()]
    assert sorted(rows, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 77, 4), (5, 77, 4), (5, 77, 4), (6, 29_997, 6), (None, 77, None), (7, 1, 7)], key=str)
    assert jaccard.join(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, None], key=str)
    assert jaccard.keep_one(odd.where("doc_id = 5")).count() == 1
    assert jaccard.keep_one(empty).count() == 0


def test_fingerprints(odd, empty):
    rows = fingerprints.described(odd).collect()
    assert len(rows) == 9 and fingerprints.described(empty).count() == 0
    prints = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for n, v in prints.items() if n != 3)  # texts of one length are equal here, but for 3
    assert {r["near_edited"] for r in rows if r["n_chars"] == 0} == {1.0}
    classes = {r["doc_id"]: r["class_id"] for r in fingerprints.near_copies(odd).collect()}
    assert classes[5] == 4 and classes[6] == 6 and classes[1] == 1


def test_bpe(odd, empty):
    coded = bpe.encode(odd, BYTE, ["doc_id", "score"])
    back = bpe.decode(coded, BYTE, ["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in back.collect()}
    assert texts[1] == texts[2] == "" and texts[3] == " \n\t" and texts[6] == LONG
    assert bpe.encode(empty, BYTE).count() == 0 and bpe.digests(empty, BYTE).count() == 0


def test_counts(odd, empty):
    with_edits = odd.withColumn("edits", counts.three_edits())
    assert counts.recount(with_edits, BYTE).count() == 9
    assert counts.recount(odd.withColumn("edits", F.lit(None).cast("array<struct<at:int,removed:int,inserted:string>>")), BYTE).where("n_tokens <> edited_n_tokens").count() == 0
    assert counts.recount(empty.withColumn("edits", counts.three_edits()), BYTE).count() == 0


def test_topk(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0, 0.0]), (7, [-1.0, 0.5]), (None, [1.0, 1.0]), (50, [0.5, 0.5]), (100, [None, 1.0]), (100, [nan, 1.0]), (100, []), (100, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(3))
    got = [tuple(r) for r in topk.search(d.where("vec_id % 50 = 0"), d).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536), (0, 4, 100, 65536), (0, 5, 50, 32768)]
    assert [g for g in got if g[0] == 100] == [(100, 1, 0, 65536), (100, 2, 1, 65536), (100, 3, 2, 65536), (100, 4, 2, 65536), (100, 5, 50, 32768)]
    wide = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="not exact"):
        topk.search(wide.where("vec_id = 0"), wide).collect()
    assert len([g for g in got if g[0] == 50]) == 5
    assert topk.search(d.where("vec_id is null"), d).count() == 0


def test_packing(spark, odd, empty, tmp_path):
    rows = packing.written(odd, WORD).collect()
    assert len(rows) == 9
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    assert packing.written(empty, WORD).count() == 0
    packing.write(odd, str(tmp_path / "f"), WORD, block=64, segment_ids=300, parts=2)
    assert [len(x) for x in packing.fetch(spark, str(tmp_path / "f"), 5)] == [r["n_tokens"] for r in rows if r["doc_id"] == 5]
    assert packing.fetch(spark, str(tmp_path / "f"), 99) == []


def test_quality(odd, empty, labels, spark):
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert quality.accepted(odd, model, 0.0).columns == odd.columns
    none = quality.train(odd, labels.where("doc_id > 99"))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_mixing(odd, empty):
    rows = mixing.Mix(odd, block_words=4).result().collect()
    assert len(rows) == 9 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.Mix(empty).result().count() == 0
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixing.mixed(empty).count() == 0


def test_lattice(odd, empty):
    rows = lattice.learn_and_score(odd, PIECE).collect()
    assert len(rows) == 9 and all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert lattice.learn_and_score(empty, PIECE).count() == 0
    untrained = lattice.score(odd, lattice.Model(empty, PIECE), F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["score"] < 0 for r in untrained)


def test_passages(odd, empty):
    rows = [tuple(r) for r in passages.passages(odd).collect()]
    assert rows == [(5, 0, 80, 4, 0, 80, 80)]
    assert passages.passages(empty).count() == 0
    left = passages.without_passages(odd)
    assert left.columns == odd.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([1, 2, 3, 4, 6, 7, None], key=str)
    assert passages.without_passages(empty).count() == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, row_id int, first_id int, row_nth int, cuts int, cut_id int, mix_row int, mix_taken int, mix_n int, mix_uid int, mix_part int, mix_nth int, mix_base int, Row_ID0 int, id int, roles int, taken int, n int"


@pytest.fixture(scope="module")
def clash(spark, odd):
    numbers = [f.split(" ")[0] for f in CLASH.split(", ")[5:]]
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    return plain.select("*", *(F.lit(i).alias(n) for i, n in enumerate(numbers)))


@pytest.mark.parametrize("stage", [jaccard.keep_one, passages.without_passages, mixing.mixed])
def test_columns_with_the_names_of_helpers(clash, stage):
    out = stage(clash)
    assert out.columns == clash.columns
    rows = out.collect()
    assert rows and all(list(r)[5:] == list(range(len(clash.columns) - 5)) for r in rows)


def test_rows_that_share_a_doc_id_with_other_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    docs = table(spark, [(1, one, "en", "a"), (9, one, "en", "a"), (9, two, "en", "a"), (9, two, "en", "a"), (9, three, "en", "a"), (12, three, "en", "a")])
    kept = sorted((r["doc_id"], r["text"][0]) for r in jaccard.keep_one(docs).collect())
    assert kept == [(1, "x"), (9, "y"), (9, "z")]


def test_equal_rows_share_all_that_a_mix_takes(spark):
    rows = [(None, "a b c d e", "en", "s")] * 7 + [(3, "f g h", "en", "t"), (4, "i j", "en", "u"), (None, "", "en", "s"), (None, "", "en", "s")]
    docs = table(spark, rows).repartition(4)
    taken = mixing.Mix(docs, block_words=4).result().agg(F.sum("taken")).first()[0]
    result = mixing.Mix(docs, block_words=4).result().where("doc_id is null and size > 0").collect()
    assert len(result) == 7 and max(r["taken"] for r in result) - min(r["taken"] for r in result) <= 1
    assert taken == sum(len(r["text"].split()) for r in mixing.mixed(docs, block_words=4).collect())


def test_digests(spark, odd, empty):
    got = bpe.digests(odd.where("doc_id is null or doc_id < 4"), BYTE, with_ids=True).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got if r["doc_id"] in (1, 2)} == {(0, none, none, ())}
    assert bpe.digests(empty, BYTE, with_ids=True).count() == 0


def test_components_without_ends(spark):
    edges = spark.createDataFrame([(1, None), (None, 2), (None, None), (3, 3), (5, 4), (5, 4)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(4, 4), (5, 4)}


def test_near_copies_ties(spark, empty):
    same = "some words that occur again and again in this text"
    docs = table(spark, [(2, same, "en", "a"), (1, same, "en", "a"), (1, same, "en", "a"), (3, same + "!", "en", "a"), (4, "other", "en", "a"), (None, same, "en", "a")])
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.near_copies(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert fingerprints.near_copies(empty).count() == 0


@pytest.mark.parametrize("rows", ["odd", "empty", "clash"])
def test_pipeline_stages(spark, request, labels, rows, tmp_path):
    import corpus_pipeline as P

    docs = request.getfixturevalue(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        assert at.columns == docs.columns and at.count() <= 2 * docs.count()
    assert P.run(spark, str(tmp_path)).count() == at.count()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_beyond_a_broadcast_are_picked_by_a_bitmap(spark, monkeypatch, how):
    docs = spark.range(5000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("text"))
    side = spark.range(300).select((F.col("id") * 3 - 2).alias("k"), F.array("id").alias("v"))
    monkeypatch.setattr(common, "PICKED_ROWS", 10)
    got, want = common.picked(docs, side, 300, "k", how), docs.join(side, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_near_copies_beyond_broadcasts(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want, left = (sorted(map(str, f(docs).collect())) for f in (jaccard.join, jaccard.keep_one))
    monkeypatch.setattr(common, "PICKED_ROWS", 0)
    monkeypatch.setattr(jaccard, "CLASSES", 0)
    assert sorted(map(str, jaccard.join(docs).collect())) == want
    assert sorted(map(str, jaccard.keep_one(docs).collect())) == left


def test_tables_free_what_they_exchanged(spark):
    storage = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def exchanged():
        blocks = storage.getAllBlocks()
        return {n for i in range(blocks.size()) if (n := blocks.apply(i).toString()).startswith("shuffle")}

    before, df = exchanged(), spark.range(1000).repartition(3, "id")
    out = common.table(df, "freed")
    until = time.time() + 20
    while exchanged() - before and time.time() < until:
        time.sleep(0.2)
    assert not exchanged() - before and spark.conf.get(common.FREED, "false") == "false"
    assert out.count() == common.table(df, "again").count() == 1000


def test_packed_entries_come_back():
    rows = np.array([[2**40 - 1, -1, 5, 7, 0], [0, -(2**63), 2**63 - 1, 2**31, 2**31], [3, 4, 4, 1, 9]], np.int64)
    assert (jaccard._unpacked(jaccard._packed(rows)) == rows).all()


def test_near_copies_in_small_portions(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(table(spark, [(10_000 + i, " ".join([*(f"w{j}" for j in range(90)), *(f"own{i}x{j}" for j in range(12 + i % 9))]), "en", "a") for i in range(150)]).select("doc_id", "text", "lang", "source", "n_chars"))
    want = sorted(map(str, jaccard.join(docs).collect()))
    for name, value in (("GATHERED", 300), ("BUCKET", 200), ("BUCKETS", 1), ("COLUMN", 4), ("CLASSES", 0)):
        monkeypatch.setattr(jaccard, name, value)
    assert sorted(map(str, jaccard.join(docs).collect())) == want


def test_cells_tell_shingles_apart():
    """A million shingles hardly share cells, so that a cell's count says how common its shingle is."""
    import numpy as np

    from sluicegate.llm import jaccard

    grams = np.random.default_rng(0).integers(0, 2**64, 1_000_000, np.uint64)
    assert len(np.unique(jaccard._cell(grams))) > 900_000 and jaccard._cell(grams).max() < jaccard.CELLS
