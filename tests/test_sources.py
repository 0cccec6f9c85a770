import pytest
from pyspark.sql import functions as F

from sluicegate.operators.joined import DataContractError
from sluicegate.sources import readers, writers


def _file_a(path, rows, header=readers.FILE_A):
    path.write_text("\n".join([",".join(header), *(",".join(map(str, r)) for r in rows)]) + "\n")
    return str(path)


def test_file_a(spark, tmp_path):
    rows = [("t", "c", r, 0, i, "x", " Yes", "no", 0.5, 1, 1) for r in range(2) for i in range(3)]
    df = readers.file_a(spark, _file_a(tmp_path / "a.csv", rows))
    assert df.count() == 6 and {r["gold"] for r in df.collect()} == {"yes"}
    for broken, header in ((rows[:-1], readers.FILE_A), (rows + rows[:1], readers.FILE_A), (rows, readers.FILE_A[::-1])):
        with pytest.raises(DataContractError):
            readers.file_a(spark, _file_a(tmp_path / f"b{len(broken)}{header[0]}.csv", broken, header))


def test_file_b(spark, tmp_path):
    row = lambda i: ("t", "m", i, "x", "yes", "<error: Timeout>" if i == 1 else "ok", "no", 1, 5, 5, 0, 0.1, 0.2, "2024-01-01T00:00:00")
    df = readers.file_b(spark, _file_a(tmp_path / "b.csv", [row(i) for i in range(3)], readers.FILE_B))
    assert df.where(readers.is_error_row()).count() == 1
    with pytest.raises(DataContractError):
        readers.file_b(spark, _file_a(tmp_path / "g.csv", [row(0), row(2)], readers.FILE_B))


def test_upload(spark, tmp_path):
    p = tmp_path / "u.jsonl"
    p.write_text('{"sentence": "a", "intent": "x"}\n{"text": "b", "class": "y"}\n\n')
    assert {(r["text"], r["label"]) for r in readers.upload(spark, str(p)).collect()} == {("a", "x"), ("b", "y")}
    p2 = tmp_path / "v.jsonl"
    p2.write_text('{"text": "a", "label": "x"}\nnot json\n')
    with pytest.raises(DataContractError):
        readers.upload(spark, str(p2))


def test_lines_registry_and_usage(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("a\nb\nc\n")
    assert {(r["line"], r["value"]) for r in readers.aligned_lines(spark, str(p)).collect()} == {(0, "a"), (1, "b"), (2, "c")}
    readers.register("one")(lambda s: s.range(1))
    assert readers.load(spark, "one").count() == 1 and "one" in readers.available()
    with pytest.raises(KeyError):
        readers.load(spark, "none")
    u = tmp_path / "u.jsonl"
    u.write_text('{"model": "m", "prompt_tokens": 3, "usd": 1.5}\n{"engine": "n", "input_tokens": 4, "task": "j"}\n')
    assert {(r["model"], r["tokens_in"], r["cost"], r["job"]) for r in readers.usage_log(spark, str(u)).collect()} == {("m", 3, 1.5, None), ("n", 4, None, "j")}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("1", "ok", 0.5), ("2", "<error: X>", 0.25)], "item_idx string, raw_output string, cost_usd double")
    writers.append_csv(d, str(tmp_path / "o"))
    writers.append_csv(d.where("item_idx = '1'"), str(tmp_path / "o"))
    writers.compact(spark, str(tmp_path / "o"), str(tmp_path / "c"), d.columns, readers.is_error_row())
    kept = spark.read.option("header", True).csv(str(tmp_path / "c")).collect()
    assert [r["cost_usd"] for r in kept] == ["0.5000000000"] * 2
    calls = []
    double = lambda df: calls.append(1) or df.withColumn("v", F.length("raw_output"))
    for _ in range(2):
        assert writers.cached(d, "item_idx", ["raw_output"], str(tmp_path / "cache"), double).count() == 2
    assert len(calls) == 1
    writers.manifest(spark, str(tmp_path / "m"), {"a": 1})
    assert writers.read_manifest(spark, str(tmp_path / "m")) == {"a": 1}
    with pytest.raises(ValueError):
        writers.audit(spark.range(1), {"id": 1}, str(tmp_path / "audit"))
    p = writers.pivot_scores(spark.createDataFrame([("t", "m", 0.5)], "task string, model string, score double"), ["m", "n"]).first()
    assert p["published__m"] == 0.5 and p["published__n"] is None


def test_ontology(spark, tmp_path):
    p = tmp_path / "o.owl"
    p.write_text('<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:skos="k"><owl:Class rdf:about="#b"><rdfs:label>B</rdfs:label><rdfs:subClassOf rdf:resource="#a"/><rdfs:subClassOf rdf:resource="#c"/></owl:Class></rdf:RDF>')
    r = readers.ontology(spark, str(p)).first()
    assert (r["id"], r["label"], r["parents"]) == ("#b", "B", ["#a", "#c"])
