"""Queries over events, orders and the other tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from sluicegate import ident
from sluicegate.operators import graph, joined as J, ledger as L, ranking as R
from sluicegate.operators.sizes import shared_folder
from sluicegate.plans.arms import _b
from sluicegate.plans.base import query, rounded
from sluicegate.session import read, stream
from sluicegate.streaming import usage


@query("""SELECT l_shipmode_ AS mode, l_returnflag, count(*) AS calls, round(sum(cost), 2) AS cost FROM (SELECT l_linenumber % 3 AS l_shipmode_, l_returnflag,
    (greatest(0, l_quantity * 100 - least(l_quantity * 40, l_quantity * 100)) * 3.0::DOUBLE + least(l_quantity * 40, l_quantity * 100) * 0.3::DOUBLE + l_quantity * 15.0::DOUBLE) / 1e6 AS cost FROM lineitem) GROUP BY ROLLUP (l_shipmode_, l_returnflag)""")
def cost_ledger(spark, sf_dir):
    """Token cost of each line, rolled up with subtotals and a grand total."""
    x = read(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("mode"), "l_returnflag", L.token_cost(F.col("l_quantity") * 100, F.col("l_quantity") * 40, F.col("l_quantity"), 3.0, 0.3, 15.0).alias("cost"))
    return rounded(L.ledger(x, "cost", "mode", "l_returnflag"), 2)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), 2)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", lineitem=read(spark, sf_dir, "lineitem"))


@query("""WITH b AS (SELECT p_retailprice, max(p_size) AS p_size FROM part GROUP BY 1), f AS (SELECT *, max(p_size) OVER (ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b)
SELECT p_partkey, p_retailprice, p_size FROM part SEMI JOIN (SELECT * FROM f WHERE m IS NULL OR p_size > m) f2 USING (p_retailprice, p_size)""")
def pareto_frontier(spark, sf_dir):
    return L.pareto(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size").select("p_partkey", "p_retailprice", "p_size")


@query("""SELECT count(*) AS requests, count(DISTINCT user_id) AS users, sum((event_type = 'error')::INT)::BIGINT AS errors, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS mean_purchase FROM events""")
def usage_tiles(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    out = e.agg(F.count(F.lit(1)).alias("requests"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("mean_purchase"))
    return rounded(out)


@query("""WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(ts::DATE) + 5 AS last FROM events)
SELECT c.day::DATE AS day, coalesce(n, 0) AS requests FROM (SELECT unnest(generate_series(last - 29, last, INTERVAL 1 DAY)) AS day FROM m) c LEFT JOIN d ON d.day = c.day::DATE""")
def daily_series(spark, sf_dir):
    """The last 30 days up to five days past the last event, zero-filled."""
    e = read(spark, sf_dir, "events")
    last = e.agg(F.date_add(F.max(F.to_date("ts")), 5).alias("d")).first()["d"]
    return L.daily_series(e, "ts", 30, F.lit(last))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, max(value) FILTER (r = least(n, floor(n * 0.5)::BIGINT + 1)) AS p50, max(value) FILTER (r = least(n, floor(n * 0.9)::BIGINT + 1)) AS p90 FROM r GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    return L.index_percentiles(read(spark, sf_dir, "events"), "value", {"p50": 0.5, "p90": 0.9}, "event_type")


@query("""WITH q AS (SELECT ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3 AS ok FROM events) SELECT day, count(*) AS asked, sum(ok::INT)::BIGINT AS allowed FROM q GROUP BY day""")
def daily_quota(spark, sf_dir):
    q = L.quota(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3)
    return q.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("asked"), F.count_if("allowed").alias("allowed"))


@query("""WITH s AS (SELECT user_id, sum(1.25::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) SELECT user_id, count(*) FILTER (spent <= 20) AS allowed, count(*) AS asked FROM s GROUP BY 1""")
def budget_stop(spark, sf_dir):
    b = L.budget_stop(read(spark, sf_dir, "events").withColumn("cost", F.lit(1.25)), "user_id", ["ts", "event_id"], "cost", 20.0)
    return b.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count(F.lit(1)).alias("asked"))


@query("""WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, ts, event_id FROM events), w AS (SELECT *, k <= 5 OR event_type = 'purchase' AS want FROM n),
c AS (SELECT user_id, want AND sum(want::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 8 AS called FROM w) SELECT user_id, sum(called::INT)::BIGINT AS calls, count(*) AS seen FROM c GROUP BY 1""")
def stream_replay(spark, sf_dir):
    r = L.replay(read(spark, sf_dir, "events"), ["ts", "event_id"], "user_id", 5, 8, F.col("event_type") == "purchase")
    return r.groupBy("user_id").agg(F.count_if("called").alias("calls"), F.count(F.lit(1)).alias("seen"))


_INTERVALS = """i AS (SELECT o_custkey AS k, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 30 + o_orderkey % 60 AS e FROM orders)"""


def _intervals(spark, sf_dir):
    day = F.expr("unix_timestamp(o_orderdate) div 86400")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), day.alias("s"), (day + 30 + F.col("o_orderkey") % 60).alias("e"))


@query(f"""WITH {_INTERVALS}, m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM i),
g AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM m), u AS (SELECT k, isl, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)
SELECT k, count(*) AS islands, sum(e - s)::BIGINT AS busy FROM u GROUP BY k""")
def busy_intervals(spark, sf_dir):
    """Union of overlapping order intervals, and busy days of each customer."""
    m = L.merge_intervals(_intervals(spark, sf_dir), "s", "e", "k")
    return m.groupBy("k").agg(F.count(F.lit(1)).alias("islands"), F.sum(F.col("e") - F.col("s")).alias("busy"))


@query(f"WITH {_INTERVALS} SELECT a.k, count(*) AS pairs FROM i a JOIN i b ON a.k = b.k AND a.s < b.e AND b.s < a.e WHERE a.s < b.s GROUP BY a.k")
def interval_overlap_join(spark, sf_dir):
    a = _intervals(spark, sf_dir)
    return L.overlapping(a, a.select("k", F.col("s").alias("t"), F.col("e").alias("u")), "k", 64).where("s < t").groupBy("k").agg(F.count(F.lit(1)).alias("pairs"))


@query("""WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
m AS (SELECT event_id, (SELECT arg_max(value, ts) FROM p WHERE p.user_id = c.user_id AND p.ts <= c.ts) AS value FROM c) SELECT event_id, value FROM m""")
def as_of_purchase(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return L.as_of(clicks, e.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "value")


@query("""WITH ends AS (SELECT user_id, event_id AS e FROM events WHERE event_type = 'purchase') SELECT c.event_id, (SELECT min(e) FROM ends WHERE ends.user_id = c.user_id AND e >= c.event_id) AS next_purchase FROM events c WHERE c.event_type = 'view'""")
def next_boundary(spark, sf_dir):
    """Forward containment: the first later boundary of a position."""
    e = read(spark, sf_dir, "events")
    ends = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("next_purchase"))
    return L.forward(e.where("event_type = 'view'").select("event_id", "user_id"), ends, "user_id", "event_id", "next_purchase").select("event_id", "next_purchase")


@query("""WITH RECURSIVE e AS (SELECT (c_custkey // 3)::BIGINT AS parent, c_custkey::BIGINT AS child FROM customer WHERE c_custkey > 0 UNION ALL SELECT (c_custkey // 5)::BIGINT, c_custkey::BIGINT FROM customer WHERE c_custkey > 0),
d(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.child, d.depth + 1 FROM d JOIN e ON e.parent = d.node ) SELECT node, min(depth)::INT AS depth FROM d GROUP BY node""")
def descendants(spark, sf_dir):
    """A graph with several parents: nodes below one, with their least depth."""
    c = read(spark, sf_dir, "customer").where("c_custkey > 0").select(F.col("c_custkey").cast("long").alias("child"))
    return graph.descendants(c.select(F.expr("child div 3").alias("parent"), "child").unionByName(c.select(F.expr("child div 5").alias("parent"), "child")), 1)


@query("SELECT c.c_custkey, coalesce(n.k, 0) AS orders, coalesce(o2.m, 0) AS large FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) n ON n.o_custkey = c.c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS m FROM orders WHERE o_totalprice > 200000 GROUP BY 1) o2 ON o2.o_custkey = c.c_custkey")
def users_with_limits(spark, sf_dir):
    """Left join with correlated scalar subqueries, in SQL."""
    sql = "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS large FROM {customer}"
    return spark.sql(sql, customer=read(spark, sf_dir, "customer"), orders=read(spark, sf_dir, "orders"))


_DAYS = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL"


@query(_DAYS)
def tumbling_batch(spark, sf_dir):
    return usage.tumbling(read(spark, sf_dir, "events"))


@query("WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 6 DAY, time_bucket(INTERVAL 1 DAY, ts), INTERVAL 1 DAY)) AS start FROM events) SELECT start, count(*) AS n FROM w GROUP BY 1")
def sliding_batch(spark, sf_dir):
    return usage.sliding(read(spark, sf_dir, "events"))


_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""


@query(_SESSIONS)
def session_batch(spark, sf_dir):
    return usage.sessions(read(spark, sf_dir, "events"))


def _stream(spark, sf_dir):
    return stream(spark, sf_dir, "events")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


@query(_DAYS)
def tumbling_stream(spark, sf_dir):
    return usage.run_once(usage.tumbling(_stream(spark, sf_dir)), "complete", _folder(spark))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def last_seen_stream(spark, sf_dir):
    return usage.run_once(usage.last_seen(_stream(spark, sf_dir)), "complete", _folder(spark))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def once_stream(spark, sf_dir):
    out = usage.run_once(usage.once(_stream(spark, sf_dir)), "append", _folder(spark))
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("WITH q AS (SELECT user_id, ts::DATE::VARCHAR AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3 AS ok FROM events) SELECT day, count(*) AS asked, sum(ok::INT)::BIGINT AS allowed FROM q GROUP BY day")
def quota_stream(spark, sf_dir):
    out = usage.run_once(usage.quota_stream(_stream(spark, sf_dir), 3), "append", _folder(spark))
    return out.groupBy("day").agg(F.count(F.lit(1)).alias("asked"), F.count_if("allowed").alias("allowed"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def quota_triggers(spark, sf_dir):
    """A quota's rows when the events come in three parts that cut days, each met after a restart."""
    parts = usage.by_time(read(spark, sf_dir, "events"), 3)
    return usage.fed(parts, lambda s: usage.quota_stream(s, 3), _folder(spark)).select("user_id", "event_id", "allowed")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS n FROM events) WHERE n = 1")
def once_triggers(spark, sf_dir):
    """Each event once, when a source delivers the last six hours of a part again with the next one."""
    parts = usage.by_time(read(spark, sf_dir, "events"), 4, "6 HOURS")
    return usage.fed(parts, usage.once, _folder(spark)).select("event_id", "user_id", "event_type")


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def last_seen_triggers(spark, sf_dir):
    """A table of users that triggers add their changes to, merged every other one."""
    folder = _folder(spark)
    usage.fed(usage.by_time(read(spark, sf_dir, "events"), 5), lambda s: s, folder, usage.merge_last_seen(f"{folder}/users", 2))
    return usage.seen_users(spark, f"{folder}/users")


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context, coalesce((SELECT string_agg(role, ',' ORDER BY role) FROM f WHERE f.conv_id = c.conv_id AND t < c.turn), '') AS known FROM conversations c""")
def decision_triggers(spark, sf_dir):
    """The decision log when conversations go on over three parts, each met after a restart."""
    c = read(spark, sf_dir, "conversations")
    return usage.fed([c.where("turn < 2"), c.where("turn BETWEEN 2 AND 3"), c.where("turn > 3")], lambda s: usage.decision_log(s, 3), _folder(spark))


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS item, CASE WHEN turn % 2 = 0 THEN 'role ' || role || conv_id % 7 ELSE text END AS said, (turn > 1)::INT + (turn > 3)::INT AS part FROM conversations WHERE text IS NOT NULL), a AS (SELECT item, (first_value(item) OVER (PARTITION BY said ORDER BY part, item))::BIGINT AS answered_by FROM t)
SELECT item, item = answered_by AS asks, answered_by FROM a""")
def asked_once_triggers(spark, sf_dir):
    """Which turns ask and which take an answer that is kept, over three parts with a restart before each."""
    c = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("role "), "role", F.col("conv_id") % 7)).otherwise(F.col("text"))
    t = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), F.md5(said).alias("sha"), "turn")
    return usage.fed([t.where("turn < 2"), t.where("turn BETWEEN 2 AND 3"), t.where("turn > 3")], usage.asked_once, _folder(spark))


@query("""WITH j AS (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events) SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM j GROUP BY 1""")
def json_path(spark, sf_dir):
    j = read(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return j.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("""WITH tr AS (SELECT user_id % 7 AS g, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), r AS (SELECT g, event_type, row_number() OVER (PARTITION BY g ORDER BY n DESC, event_type) AS rk FROM tr)
SELECT count(*) AS n, round(avg((coalesce(rk, 99) <= 1)::INT), 6) AS recall_at_1, round(avg((coalesce(rk, 99) <= 3)::INT), 6) AS recall_at_3 FROM events e LEFT JOIN r ON r.g = e.user_id % 7 AND r.event_type = e.event_type WHERE event_id % 2 = 1""")
def recall_at_k(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("g"), "event_type")
    return rounded(R.recall_at_k(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_type", (1, 3), "g"))


@query("WITH t AS (SELECT l_orderkey, bool_and(l_quantity < 40) AS a, count(*) AS n, sum((l_quantity < 40)::INT) AS h FROM lineitem GROUP BY 1) SELECT count(*) AS turns, round(avg(a::INT), 6) AS compose_at_1, round(sum(h) / sum(n), 6) AS position_accuracy FROM t")
def compose_at_1(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") < 40).alias("right"))
    return rounded(R.compose_at_1(x, "right", "l_orderkey"))


@query(f"WITH f AS (SELECT o_custkey % 4 AS label, ((row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY md5(o_orderkey::VARCHAR || 's'), o_orderkey) - 1) % 5)::INT AS fold FROM orders) SELECT label, fold, count(*) AS n FROM f GROUP BY ALL")
def stratified_folds(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("label"))
    return ident.stratified_folds(o, "o_orderkey", "label", 5, "s").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_b('g', 5, 'o_custkey')} AS fold, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY 1")
def grouped_folds(spark, sf_dir):
    return ident.grouped_folds(read(spark, sf_dir, "orders"), "o_custkey", 5, "g").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("groups"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || 'n'), o_orderkey) AS rn, count(*) OVER () AS c FROM orders) SELECT o_orderkey FROM r WHERE rn <= round_even(c * 0.05::DOUBLE, 0)")
def nested_sample(spark, sf_dir):
    return ident.nested_sample(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.05, "n")


@query("""WITH s AS (SELECT o_orderstatus AS c, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT c, n * 100.0::DOUBLE / sum(n) OVER () AS q FROM s), t AS (SELECT c, floor(q) + (row_number() OVER (ORDER BY q - floor(q) DESC, c) <= 100 - sum(floor(q)) OVER ())::INT AS take FROM q) SELECT c AS o_orderstatus, take::BIGINT AS n FROM t""")
def stratified_take(spark, sf_dir):
    return ident.stratified_take(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", 100, "t").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, sha256(string_agg(o_orderkey::VARCHAR || chr(0) || o_custkey::VARCHAR, chr(30) ORDER BY o_orderkey)) AS fingerprint, count(*) AS n FROM orders GROUP BY 1")
def split_fingerprint(spark, sf_dir):
    return ident.fingerprint(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "o_custkey", by="o_orderstatus")


@query("SELECT n_name FROM nation WHERE n_nationkey < 15 AND n_nationkey >= 5 UNION ALL SELECT n_name || '*' FROM nation WHERE n_nationkey < 5")
def patch_merge(spark, sf_dir):
    n = read(spark, sf_dir, "nation").where("n_nationkey < 15").select("n_nationkey", "n_name")
    patch = read(spark, sf_dir, "nation").where("n_nationkey < 5").select("n_nationkey", F.concat("n_name", F.lit("*")).alias("n_name"))
    return L.patch_merge(n, patch, "n_nationkey", list(range(25))).select("n_name")


@query("WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 1) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_sides, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def set_differences(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a, b = o.where("o_orderkey % 2 = 0").select("o_custkey"), o.where("o_orderkey % 2 = 1").select("o_custkey")
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    return count(a.intersect(b), "both_sides").crossJoin(count(a.subtract(b), "only_a")).crossJoin(count(b.subtract(a), "only_b"))


@query("WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR i IN (0, n // 4, 2 * n // 4, 3 * n // 4)")
def even_stride(spark, sf_dir):
    return L.even_stride(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4)


@query("SELECT event_type, round(sum(w * x) / sum(w), 6) AS share, round(sum(w) ** 2 / sum(w * w), 6) AS effective_n FROM (SELECT event_type, (1 + event_id % 5)::DOUBLE AS w, (value > 50)::INT::DOUBLE AS x FROM events) GROUP BY 1")
def weighted_shares(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return rounded(R.weighted_shares(e, (1 + F.col("event_id") % 5).cast("double"), F.coalesce((F.col("value") > 50).cast("double"), F.lit(0.0)), "event_type"))


@query("WITH d AS (SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT n_name, orders, total, row_number() OVER (ORDER BY total DESC, n_name)::INT AS rank, round(total / sum(total) OVER (), 6) AS share FROM d")
def spend_by_nation(spark, sf_dir):
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    every = W.partitionBy(F.lit(0))  # 25 rows
    return d.select("n_name", "orders", "total", F.row_number().over(every.orderBy(F.desc("total"), "n_name")).alias("rank"), F.round(F.col("total") / F.sum("total").over(every), 6).alias("share"))
