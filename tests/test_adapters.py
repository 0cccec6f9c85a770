"""The labelled-lines data source: ranges, streams over several triggers, and the writer's attempts."""

import json

import pytest
from pyspark.sql import functions as F

from sluicegate.sources import adapters
from sluicegate.sources.adapters import Folder, Range, StreamReader, Writer, lines


@pytest.fixture
def source(spark):
    adapters.register(spark)
    return spark.read.format("labelled_lines")


def put(path, split, name, rows, end="\n"):
    (path / split).mkdir(parents=True, exist_ok=True)
    with open(path / split / name, "a", encoding="utf-8") as f:
        f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows[:-1]) + json.dumps(rows[-1], ensure_ascii=False) + end)


def test_ranges_read_each_line_once(tmp_path):
    put(tmp_path, "train", "a.jsonl", [{"text": "é" * (i % 7), "label": str(i)} for i in range(50)], end="")
    size = (tmp_path / "train" / "a.jsonl").stat().st_size
    whole = list(lines(Folder(str(tmp_path)), Range("train/a.jsonl", 0, size)))
    for width in (1, 7, 31, 1000, size):
        parts = [x for a in range(0, size, width) for x in lines(Folder(str(tmp_path)), Range("train/a.jsonl", a, min(a + width, size)))]
        assert parts == whole and len(whole) == 50


def test_options_and_pruning(spark, source, tmp_path):
    put(tmp_path, "train", "a.jsonl", [{"query": "one", "intent": "card_lost"}, {"query": "two", "intent": "oos"}, {"sentence": "x", "text": "three", "class": 3}])
    put(tmp_path, "test", "a.jsonl", [{"text": None, "label": None}, {"text": "four", "label": "card_lost"}])
    put(tmp_path, "_temporary", "a.jsonl", [{"text": "no", "label": "no"}])
    rows = source.option("drop", "oos").option("underscores", "true").option("partition_bytes", 9).load(str(tmp_path))
    got = sorted((r["split"], r["text"], r["label"]) for r in rows.collect() if r["text"])
    assert got == [("test", "four", "card lost"), ("train", "one", "card lost"), ("train", "three", "3")]
    assert rows.select("file", "at").distinct().count() == rows.count() == 4
    assert sorted((r["text"], r["class"]) for r in adapters.numbered(rows).collect()) == [("four", 1), ("one", 1), ("three", 0)]
    some = rows.where("split = 'test'")
    assert some.count() == 2 and some.where("label IS NULL").count() == 1
    reader = adapters.Reader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("split",), "test"), EqualTo(("text",), "four")])) == [EqualTo(("text",), "four")]
    assert {p.file for p in reader.partitions()} == {"test/a.jsonl"}


@pytest.mark.parametrize("line,says", [("not json", "at byte"), ("[1]", "no JSON object"), ('{"text": "a"}', "none of the fields")])
def test_bad_lines_raise_with_their_place(source, tmp_path, line, says):
    put(tmp_path, "train", "a.jsonl", [{"text": "a", "label": "b"}])
    (tmp_path / "train" / "b.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match=says):
        source.load(str(tmp_path)).collect()


def test_empty_folder(source, tmp_path):
    assert source.load(str(tmp_path)).count() == 0
    assert source.load(str(tmp_path / "none")).count() == 0


def test_round_trip_equals_parquet(spark, source, tmp_path, data):
    d = spark.read.parquet(f"{data}/documents.parquet").select("text", F.col("source").alias("label"), F.col("lang").alias("split")).repartition(5)
    for _ in range(2):  # appends add up
        d.write.format("labelled_lines").mode("append").save(str(tmp_path / "d"))
    got = source.option("partition_bytes", 10_000).load(str(tmp_path / "d"))
    assert sorted(map(tuple, got.select("text", "label", "split").collect())) == sorted([*map(tuple, d.collect())] * 2)
    assert got.select("file", "at").distinct().count() == 2 * d.count()
    with pytest.raises(Exception, match="appends only"):
        d.write.format("labelled_lines").mode("overwrite").save(str(tmp_path / "d"))


def test_files_of_lost_attempts_go(spark, tmp_path):
    from pyspark.sql import Row

    w = Writer({"path": str(tmp_path)})
    lost = w.write(iter([Row(text="a", label="b")]))
    won = w.write(iter([Row(text="a", label="b")]))
    assert len(lost.files) == len(won.files) == 1
    assert Folder(str(tmp_path)).files() == []  # nothing shows before the commit
    w.commit([won])
    adapters.register(spark)
    assert spark.read.format("labelled_lines").load(str(tmp_path)).count() == 1
    v = Writer({"path": str(tmp_path)})
    v.abort([v.write(iter([Row(text="c", label="d")]))])
    assert spark.read.format("labelled_lines").load(str(tmp_path)).count() == 1


def test_offsets(tmp_path):
    put(tmp_path, "train", "a.jsonl", [{"text": "a", "label": "b"}])
    r = StreamReader({"path": str(tmp_path)})
    one = r.latestOffset()
    put(tmp_path, "train", "b.jsonl", [{"text": "c", "label": "d"}, {"text": "half", "label": "d"}], end="")
    two = r.latestOffset()  # a line without its end doesn't count
    (tmp_path / "train" / "b.jsonl").open("a").write("\n")
    three = r.latestOffset()
    texts = lambda a, b: [t for p in r.partitions(a, b) for x in r.read(p) for t in x.column("text").to_pylist()]
    assert texts(r.initialOffset(), one) == ["a"] and texts(one, two) == ["c"] and texts(two, three) == ["half"]
    assert texts(r.initialOffset(), three) == ["a", "c", "half"] and texts(three, three) == []
    assert StreamReader({"path": str(tmp_path / "none")}).latestOffset() == r.initialOffset()


def test_stream_over_triggers_and_a_restart(spark, tmp_path):
    adapters.register(spark)
    path, out = tmp_path / "in", str(tmp_path / "out")
    path.mkdir()

    def run():
        s = spark.readStream.format("labelled_lines").option("partition_bytes", 20).load(str(path))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-at").trigger(availableNow=True).start().awaitTermination()
        return sorted(r["text"] for r in spark.read.parquet(out).collect())

    put(path, "train", "1.jsonl", [{"text": "a", "label": "x"}])
    assert run() == ["a"]
    put(path, "train", "1.jsonl", [{"text": "b", "label": "x"}])
    put(path, "test", "2.jsonl", [{"text": "c", "label": "x"}])
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    put(path, "train", "3.jsonl", [{"text": t, "label": "x"} for t in "defg"])
    assert run() == list("abcdefg")
