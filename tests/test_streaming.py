"""Batch and stream give the same rows."""

from sluicegate.plans.registry import QUERIES
from sluicegate.streaming import usage


def test_tumbling(spark, data):
    a = {(str(r["start"]), r["event_type"], r["n"]) for r in QUERIES["tumbling_batch"](spark, data).collect()}
    assert a == {(str(r["start"]), r["event_type"], r["n"]) for r in QUERIES["tumbling_stream"](spark, data).collect()}


def test_merge_last_seen(spark, tmp_path):
    at = lambda u, t: (u, t)
    batches = [[at(1, 5), at(1, 7)], [at(2, 1)], [at(1, 2)], [at(2, 9), at(3, 3)], [at(1, 8)]]
    path = str(tmp_path / "t")
    merge = usage.merge_last_seen(path, every=2)
    frames = [spark.createDataFrame(b, "user_id int, s int").selectExpr("user_id", "timestamp_seconds(s) ts") for b in batches]
    for n, d in enumerate(frames):
        merge(d, n)
        if n == 3:
            merge(d, n)  # a retried trigger
        got = {(r["user_id"], r["a"], r["b"]) for r in usage.seen_users(spark, path).selectExpr("user_id", "unix_seconds(first_seen) a", "unix_seconds(last_seen) b").collect()}
        seen = [x for b in batches[: n + 1] for x in b]
        assert got == {(u, min(t for v, t in seen if v == u), max(t for v, t in seen if v == u)) for u, _ in seen}


def test_parts_by_time_repeat_their_end(spark):
    d = spark.range(100).selectExpr("id", "timestamp_seconds(id * 3600) AS ts")
    plain = [{r["id"] for r in p.collect()} for p in usage.by_time(d, 4)]
    assert sum(map(len, plain)) == 100 and set.union(*plain) == set(range(100))
    again = [{r["id"] for r in p.collect()} for p in usage.by_time(d, 4, "6 HOURS")]
    assert [len(a - b) for a, b in zip(again, plain)] == [0, 6, 6, 6]


def test_streams_of_tables_that_are_folders(spark, data, tmp_path):
    from sluicegate.session import read

    for name in ("events", "conversations"):
        read(spark, data, name).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("decision_stream", "quota_stream", "last_seen_stream"):
        one, many = (sorted(map(str, QUERIES[name](spark, d).collect())) for d in (data, str(tmp_path)))
        assert one and one == many


def test_quota_calls_follow_days_not_users(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(usage, "BUCKETS", 4)
    rows = spark.range(6000).selectExpr("id AS event_id", "nullif(id % 1500, 7) AS user_id", "timestamp_seconds(1700000000 + id * 40) AS ts")
    parts = usage.by_time(rows, 2)
    got = usage.fed(parts, lambda s: usage.quota_stream(s, 2), str(tmp_path / "q"))
    want = rows.selectExpr("user_id", "event_id", "row_number() OVER (PARTITION BY user_id, to_date(ts) ORDER BY ts, event_id) <= 2 AS allowed")
    assert got.count() == 6000 and got.select("user_id", "event_id", "allowed").exceptAll(want).count() == 0
    state = spark.read.format("statestore").load(str(tmp_path / "q" / "checkpoint"))
    assert state.count() <= 3 * 4  # a state for each day and part, not for each user
