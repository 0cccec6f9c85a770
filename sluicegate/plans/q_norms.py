"""Priority of norms.  The norms are the order lines: eight orders make a document, their parts and suppliers the actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.operators import norms as N
from sluicegate.plans.base import query
from sluicegate.session import read

_NORMS = """n AS MATERIALIZED (
    SELECT DISTINCT (l_orderkey // 8)::BIGINT AS doc_id, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS stmt,
        list_sort(list_distinct([l_partkey % 5, l_suppkey % 5])) AS actions, CASE l_returnflag WHEN 'N' THEN 'ban' WHEN 'A' THEN 'permit' ELSE 'oblige' END AS polarity,
        max(l_quantity) OVER w >= 40 AS override, CASE WHEN max(l_discount) OVER w >= 0.07 THEN [l_partkey % 7 + 1] ELSE [] END AS defers,
        CASE WHEN max(l_tax) OVER w >= 0.06 THEN [l_suppkey % 7 + 1] ELSE [] END AS except_secs, l_linestatus = 'O' AND max(l_quantity) OVER w < 10 AS inline_exception,
        [l_linenumber::BIGINT] AS secs, ['actor ' || l_suppkey % 3] AS actors, [l_linestatus] AS things
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber)
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY l_returnflag, l_linestatus) = 1
)"""


def _norms(spark, sf_dir):
    """One norm for each (order, part, supplier, line).  Lines are exchanged by document, which serves the grouping and what
    joins the norms of a document."""
    one = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    l = read(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", *one, F.floor(F.col("l_orderkey") / 8).alias("doc_id")).repartition("doc_id")
    l = l.groupBy("doc_id", *one).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"), F.min(F.struct("l_returnflag", "l_linestatus")).alias("f"))
    at = lambda c, holds: F.when(holds, F.array(F.col(c) % 7 + 1)).otherwise(F.array().cast("array<bigint>"))
    return l.select(
        "doc_id",
        F.concat_ws("-", *one).alias("stmt"),
        F.array(F.col("l_partkey") % 5, F.col("l_suppkey") % 5).alias("actions"),
        F.when(F.col("f.l_returnflag") == "N", "ban").when(F.col("f.l_returnflag") == "A", "permit").otherwise("oblige").alias("polarity"),
        (F.col("q") >= 40).alias("override"),
        at("l_partkey", F.col("d") >= 0.07).alias("defers"),
        at("l_suppkey", F.col("t") >= 0.06).alias("except_secs"),
        ((F.col("f.l_linestatus") == "O") & (F.col("q") < 10)).alias("inline_exception"),
        F.array(F.col("l_linenumber").cast("long")).alias("secs"),
        F.array(F.concat(F.lit("actor "), F.col("l_suppkey") % 3)).alias("actors"),
        F.array("f.l_linestatus").alias("things"),
    )


@query(f"""WITH RECURSIVE {_NORMS}, c AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM (SELECT DISTINCT doc_id, actions, polarity, override, defers, except_secs, secs FROM n)
), e AS MATERIALIZED (
    SELECT DISTINCT x.id AS winner, y.id AS loser FROM c x JOIN c y ON x.doc_id = y.doc_id AND (x.polarity = 'ban') <> (y.polarity = 'ban') AND list_has_any(x.actions, y.actions)
    WHERE (x.override AND NOT y.override) OR list_has_any(y.defers, x.secs) OR list_has_any(y.except_secs, x.secs)
        OR NOT ((y.override AND NOT x.override) OR list_has_any(x.defers, y.secs) OR list_has_any(x.except_secs, y.secs))
), s AS (
    SELECT id, 'open' AS status, 0 AS round FROM c
    UNION ALL
    SELECT x.id, CASE WHEN x.status <> 'open' THEN x.status WHEN bool_or(a.status = 'holds') THEN 'defeated' WHEN bool_and(coalesce(a.status, 'defeated') = 'defeated') THEN 'holds' ELSE 'open' END, x.round + 1
    FROM s x LEFT JOIN e ON e.loser = x.id LEFT JOIN s a ON a.id = e.winner WHERE x.round < 40 GROUP BY x.id, x.status, x.round
)
SELECT n.stmt, CASE s.status WHEN 'open' THEN 'unresolved' ELSE s.status END AS status
FROM s JOIN c USING (id) JOIN n ON n.doc_id = c.doc_id AND n.actions = c.actions AND n.polarity = c.polarity AND n.override = c.override AND n.defers = c.defers AND n.except_secs = c.except_secs AND n.secs = c.secs
WHERE s.round = 40""")
def norm_standing(spark, sf_dir):
    """Which norms hold, are defeated or stay unresolved."""
    return N.standing(_norms(spark, sf_dir)).select("stmt", "status")


@query(f"""WITH {_NORMS}, q AS (
    SELECT o_orderkey AS answer_id, o_orderkey // 8 AS doc_id, o_custkey % 5 AS action, CASE o_custkey % 4 WHEN 3 THEN 'ANY' ELSE 'actor ' || o_custkey % 4 END AS actor,
        CASE WHEN o_custkey % 7 < 3 THEN [o_orderstatus] ELSE [] END AS things, ['CAN', 'PROHIBITED', 'MUST'][o_orderkey % 3 + 1] AS asks, CASE WHEN o_totalprice < 60000 THEN 'yes' ELSE 'no' END AS answer
    FROM orders
), v AS (SELECT l_orderkey AS answer_id, min(concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS evidence FROM lineitem GROUP BY 1
), a AS (
    SELECT q.*, v.evidence, e.stmt IS NOT NULL AS found, coalesce(e.override, false) AS eo, coalesce(e.defers, []) AS ed, coalesce(e.except_secs, []) AS ex, coalesce(e.inline_exception, false) AS ei, coalesce(e.secs, []) AS es,
        CASE WHEN asks = 'PROHIBITED' AND answer = 'yes' OR asks = 'CAN' AND answer = 'no' THEN 'permit' WHEN asks = 'MUST' AND answer = 'no' THEN NULL ELSE 'ban' END AS against
    FROM q LEFT JOIN v USING (answer_id) LEFT JOIN n e ON e.doc_id = q.doc_id AND e.stmt = v.evidence
), m AS (
    SELECT a.*, n.polarity, n.inline_exception, n.except_secs, CASE WHEN n.polarity = a.against AND (NOT found OR n.stmt <> evidence) THEN
        CASE WHEN n.override AND NOT eo THEN 'overridden' WHEN eo THEN 'evidence_overrides' WHEN list_has_any(n.secs, ed) THEN 'defers'
            WHEN list_has_any(n.secs, ex) OR n.inline_exception AND list_has_any(n.secs, es) THEN 'is_exception' WHEN ei OR len(ex) > 0 THEN 'specific' ELSE 'unresolved' END END AS why
    FROM a JOIN n ON n.doc_id = a.doc_id AND list_contains(n.actions, a.action) AND (a.actor = 'ANY' OR list_contains(n.actors, a.actor)) AND (len(a.things) = 0 OR list_has_any(a.things, n.things))
)
SELECT a.answer_id, a.found AS evidence_found, count(*) FILTER (m.polarity = 'ban') AS n_ban, count(*) FILTER (m.polarity = 'permit') AS n_permit,
    coalesce(bool_or(m.polarity = 'ban') AND NOT bool_or(m.polarity = 'permit') AND NOT bool_or(m.polarity = 'ban' AND (m.inline_exception OR len(m.except_secs) > 0)), false) AS ban_unexcepted,
    count(m.why) AS n_conflicts, coalesce(bool_or(m.why = 'overridden'), false) AS overridden, coalesce(bool_or(m.why = 'evidence_overrides'), false) AS evidence_overrides,
    coalesce(bool_or(m.why = 'defers'), false) AS defers, coalesce(bool_or(m.why = 'is_exception'), false) AS is_exception, coalesce(bool_or(m.why = 'unresolved'), false) AS unresolved
FROM a LEFT JOIN m ON m.answer_id = a.answer_id GROUP BY a.answer_id, a.found""")
def answer_priorities(spark, sf_dir):
    """What a document's other norms say about an answer; an order asks, and its first line is the evidence."""
    o = read(spark, sf_dir, "orders")
    first = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")).alias("evidence"))
    c = F.col("o_custkey")
    asks = F.array(*map(F.lit, ("CAN", "PROHIBITED", "MUST")))[(F.col("o_orderkey") % 3).cast("int")]
    a = o.join(first, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("answer_id"), F.floor(F.col("o_orderkey") / 8).alias("doc_id"), F.array(c % 5).alias("actions"), F.when(c % 4 == 3, "ANY").otherwise(F.concat(F.lit("actor "), c % 4)).alias("actor"),
        F.when(c % 7 < 3, F.array("o_orderstatus")).alias("things"), asks.alias("asks"), F.when(F.col("o_totalprice") < 60000, "yes").otherwise("no").alias("answer"), "evidence",
    )
    return N.answer_priority(_norms(spark, sf_dir), a)
