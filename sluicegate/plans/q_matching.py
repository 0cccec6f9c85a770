"""Queries over phrases, label names, stage settings, verdicts, resumed calls and reports on labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sluicegate.functions import stats, text as T
from sluicegate.operators import matching as M, turns as V
from sluicegate.operators.sizes import shared_folder
from sluicegate.plans.arms import ARMS, LONG, arms, long_preds
from sluicegate.plans.base import query, rounded
from sluicegate.session import read, stream
from sluicegate.streaming import usage

_FORMS = ["th", "the", "of", "in", "and"]


@query(r"""WITH f AS (SELECT unnest(['th', 'the', 'of', 'in', 'and']) AS form), d AS (SELECT item_id, ' ' || regexp_replace(lower(text), '[^a-z0-9]', '  ', 'g') || ' ' AS t FROM benchmark WHERE strlen(text) = length(text)),
w AS (SELECT item_id, form, len(regexp_extract_all(t, ' ' || form || ' ')) AS n FROM d, f) SELECT item_id, form, n FROM w WHERE n > 0""")
def phrase_counts(spark, sf_dir):
    """Whole-word occurrences of several words in one pass, in the ASCII texts."""
    b = read(spark, sf_dir, "benchmark").where(F.length("text") == F.octet_length("text")).select(F.col("item_id").alias("doc_id"), "text")
    return M.occurrences(b, _FORMS).groupBy(F.col("doc_id").alias("item_id"), "form").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH n AS (SELECT DISTINCT 'part_kind:' || p_type || '_' || replace(p_name, ' ', 's_') || ' of the parties' AS name FROM part), w AS (SELECT name, list_transform(regexp_extract_all(replace(regexp_replace(lower(name), '^[a-z_]+:', ''), '_', ' '), '[a-z]+'), lambda t: regexp_replace(regexp_replace(t, '([a-z]{3})s$', '\1'), 'ies$', 'y')) AS w FROM n)
SELECT name, array_to_string(list_sort(list_distinct(list_filter(w, lambda t: t NOT IN ('of', 'the', 'and', 'to', 'a', 'on', 'for', 'in', 'by', 'clause', 'clauses', 'provision', 'provisions', 'agreement', 'u', 'no')))), ' ') AS tokens FROM w""")
def label_tokens(spark, sf_dir):
    """Content words of class names, made from the parts' kinds and names."""
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("part_kind:"), "p_type", F.lit("_"), F.regexp_replace("p_name", " ", "s_"), F.lit(" of the parties")).alias("name")).distinct()
    return p.select("name", F.array_join(M.label_tokens(F.col("name")), " ").alias("tokens"))


_BITS = "o_orderkey % 2 = 0 AS pretier0, o_orderkey // 2 % 2 = 0 AS tier0, o_orderkey // 4 % 2 = 0 AS tier0net, o_orderkey // 8 % 2 = 0 AS tier1, o_orderkey // 16 % 2 = 0 AS classifiers, o_orderkey // 32 % 2 = 0 AS contractmap, CASE WHEN o_orderkey % 3 = 0 THEN 'off' ELSE 'large' END AS reader"


@query(f"""WITH o AS (SELECT {_BITS} FROM orders) SELECT 'p' || pretier0::INT || ' t' || tier0::INT || CASE WHEN tier0net THEN ' n1' ELSE '' END || ' j' || tier1::INT || ' c' || classifiers::INT || CASE WHEN contractmap THEN ' m1' ELSE '' END || ' r:' || reader AS mask,
CASE WHEN NOT tier1 AND reader = 'off' THEN 'nothing_answers' WHEN classifiers AND NOT tier1 THEN 'classifiers_need_tier1' END AS problem, count(*) AS n FROM o GROUP BY ALL""")
def stage_masks(spark, sf_dir):
    """Stage settings as strings, with what is wrong with them."""
    o = read(spark, sf_dir, "orders").selectExpr(*(x.strip() for x in _BITS.replace("//", "div").split(", ")))
    reader = F.col("reader")
    return o.groupBy(M.stage_mask(reader).alias("mask"), M.stage_problem(reader).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ARMS}, c AS (SELECT gold AS class, avg((free_pred = gold)::INT) AS m, avg((free_pred = gold)::INT) - 0.02 AS low, CASE WHEN gold % 4 <> 3 THEN 0.6 + gold / 40 END AS published FROM arms GROUP BY 1)
SELECT class, CASE WHEN published IS NULL THEN 'no_reference' WHEN low >= published - 0.01 THEN 'match' WHEN (published - m) * 100 > 3 THEN 'short' ELSE 'close' END AS verdict, round((published - m) * 100, 6) AS gap FROM c""")
def score_verdicts(spark, sf_dir):
    """Each class's score against a published one."""
    c = arms(spark, sf_dir).groupBy(F.col("gold").alias("class")).agg(F.avg((F.col("free_pred") == F.col("gold")).cast("double")).alias("m"))
    c = c.withColumn("published", F.when(F.col("class") % 4 != 3, 0.6 + F.col("class") / 40))
    return rounded(c.select("class", M.verdict(F.col("m"), F.col("m") - 0.02, F.col("published")).alias("verdict"), ((F.col("published") - F.col("m")) * 100).alias("gap")))


@query("SELECT p_partkey, p_retailprice, p_size FROM part a WHERE p_partkey % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 10 <> 0 AND b.p_retailprice <= a.p_retailprice AND b.p_size > a.p_size)")
def priced_frontier(spark, sf_dir):
    """The frontier among priced rows; a tenth of the parts cost nothing here and stay out."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size").withColumn("cost", F.when(F.col("p_partkey") % 10 == 0, 0.0).otherwise(F.col("p_retailprice")))
    return M.priced_frontier(p, "cost", "p_size").select("p_partkey", "p_retailprice", "p_size")


_RUNS = f"{ARMS}, r AS (SELECT t.t AS setting, (item_idx % 7)::INT AS seed, avg((CASE WHEN free_conf < t.t THEN expert_pred ELSE free_pred END = gold)::INT) AS score FROM arms, (SELECT unnest([0.1, 0.3, 0.5]::DOUBLE[]) AS t) t GROUP BY ALL)"


@query(f"""WITH {_RUNS}, m AS (SELECT setting, avg(score) AS m FROM r WHERE seed < 3 GROUP BY 1), p AS (SELECT arg_min(setting, (-round(m, 12), setting)) AS chosen FROM m), o AS (SELECT avg(t) AS optimistic FROM (SELECT seed, max(score) AS t FROM r WHERE seed >= 3 GROUP BY 1))
SELECT chosen, round(avg(score), 6) AS score, round(stddev_samp(score), 6) AS sd, round(any_value(optimistic), 6) AS optimistic, round(any_value(optimistic) - avg(score), 6) AS bias FROM r JOIN p ON setting = chosen, o WHERE seed >= 3 GROUP BY chosen""")
def warmup_choice(spark, sf_dir):
    """A threshold chosen on half of the seeds and reported on the rest."""
    a = arms(spark, sf_dir).withColumn("setting", F.explode(F.array(F.lit(0.1), F.lit(0.3), F.lit(0.5))))
    right = F.when(F.col("free_conf") < F.col("setting"), F.col("expert_pred")).otherwise(F.col("free_pred")) == F.col("gold")
    r = a.groupBy("setting", (F.col("item_idx") % 7).cast("int").alias("seed")).agg(F.avg(right.cast("double")).alias("score"))
    return rounded(M.chosen_on_half(r, "setting", "seed", "score"))


@query("""WITH a AS (SELECT doc_id AS item, md5(trim(text)) AS sha FROM documents), d AS (SELECT * FROM a WHERE item % 3 = 0 AND item % 5 <> 0), f AS (SELECT sha, min(item) AS f FROM a WHERE sha NOT IN (SELECT sha FROM d) GROUP BY 1)
SELECT CASE WHEN item IN (SELECT item FROM d) THEN 'done' WHEN sha IN (SELECT sha FROM d) THEN 'copy' WHEN item = f THEN 'call' ELSE 'wait' END AS state, count(*) AS n, sum(item)::BIGINT AS items FROM a LEFT JOIN f USING (sha) GROUP BY 1""")
def resumed_calls(spark, sf_dir):
    """What is left to ask after a third of the documents, a fifth of those with errors: one call a text."""
    a = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.md5(F.trim("text")).alias("sha"))
    done = a.where("item % 3 = 0").withColumn("raw_output", F.when(F.col("item") % 5 == 0, "<error: Timeout>").otherwise("ok"))
    return M.resume(a, done, F.startswith("raw_output", F.lit("<error:"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("item").alias("items"))


_SETS = """t AS (SELECT list_distinct([lang, source]) AS g, list_distinct([CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END, source, CASE WHEN doc_id % 4 = 0 THEN 'extra' ELSE source END]) AS p FROM documents)"""


@query(f"""WITH {_SETS}, l AS (SELECT unnest(list_distinct(list_concat(g, p))) AS label, g, p FROM t), c AS (SELECT label, count(*) FILTER (list_contains(g, label) AND list_contains(p, label)) AS tp, count(*) FILTER (NOT list_contains(g, label)) AS fp, count(*) FILTER (NOT list_contains(p, label)) AS fn FROM l GROUP BY 1)
SELECT label, tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def label_scores(spark, sf_dir):
    """F1 of each label of a multi-label table; their mean is the macro F1, the smallest the weakest label."""
    d = read(spark, sf_dir, "documents")
    p = F.array(F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")), F.col("source"), F.when(F.col("doc_id") % 4 == 0, "extra").otherwise(F.col("source")))
    return rounded(M.label_f1(d.select(F.array_distinct(F.array("lang", "source")).alias("g"), F.array_distinct(p).alias("p")), "g", "p"))


@query("""WITH p AS (SELECT conv_id, conv_id % 4 <> 0 AS whole, CASE WHEN length(text) % 7 <> 0 THEN length(text) > 40 END AS part FROM conversations), t AS (SELECT conv_id, bool_and(whole) AS w, count(*) = count(part) AS c, bool_and(coalesce(part, false)) AS p FROM p GROUP BY 1)
SELECT count(*) FILTER (c) AS covered, round(avg((w AND p)::INT) FILTER (c), 6) AS conditional, count(*) AS turns, round(avg((w AND p)::INT), 6) AS unconditional FROM t""")
def composed_turns(spark, sf_dir):
    """Whole-and-parts accuracy with both denominators."""
    c = read(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 4 != 0).alias("whole"), F.when(F.length("text") % 7 != 0, F.length("text") > 40).alias("part"))
    return rounded(M.composed(c, "whole", "part", "conv_id"))


@query(f"WITH {ARMS}, p AS (SELECT free_pred, count(*) AS n, avg((expert_pred = gold)::INT - (free_pred = gold)::INT) AS adv FROM arms GROUP BY 1 HAVING count(*) >= 10) SELECT count(*) AS classes, round(CASE WHEN count(*) > 1 THEN max(adv) - min(adv) ELSE 0 END, 6) AS spread, count(*) FILTER (adv < 0) AS free_wins FROM p")
def advantage_spread(spark, sf_dir):
    return rounded(M.advantage_spread(arms(spark, sf_dir)))


@query("WITH s AS (SELECT lang AS label, (row_number() OVER (ORDER BY lang) - 1)::INT AS index FROM (SELECT DISTINCT lang FROM documents WHERE doc_id % 2 = 0 AND lang <> 'fr')) SELECT lang, coalesce(index, -1)::INT AS index, count(*) AS n FROM documents LEFT JOIN s ON label = lang GROUP BY ALL")
def label_indices(spark, sf_dir):
    """Labels as places in a label space; one that the space lacks is -1."""
    from pyspark.sql import Window as W

    d = read(spark, sf_dir, "documents")
    space = d.where("doc_id % 2 = 0 and lang <> 'fr'").select(F.col("lang").alias("label")).distinct()
    space = space.withColumn("index", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("label")) - 1)  # a row for each label
    return M.in_label_space(d, space, "lang").groupBy("lang", "index").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, sum(l)::BIGINT AS lines FROM orders JOIN (SELECT l_orderkey, count(*) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def matched_responses(spark, sf_dir):
    """Requests beside their responses by key, on keys that both sides have once."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("l"))
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus").join(lines.select("key"), "key", "left_semi")
    return M.answered(o, lines.join(o.select("key"), "key", "left_semi"), "key").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l").alias("lines"))


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1")
def disjoint_splits(spark, sf_dir):
    """Training rows, after the check that no test row shares their id."""
    d = read(spark, sf_dir, "documents")
    return M.disjoint(d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LONG}, x AS (SELECT model, count(*) FILTER (gold = pred) AS h, count(*) AS n FROM preds GROUP BY 1), w AS (SELECT model, h / n AS p, n, 1.959963984540054 AS z FROM x)
SELECT model, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM w""")
def stratum_limits(spark, sf_dir):
    """Wilson limits of each stratum of an audit; here the strata are the arms."""
    s = long_preds(arms(spark, sf_dir)).groupBy("model").agg(F.count_if(F.col("gold") == F.col("pred")).alias("h"), F.count(F.lit(1)).alias("n"))
    low, high = stats.wilson(F.col("h"), F.col("n"))
    return rounded(s.select("model", low.alias("low"), high.alias("high")))


@query("""WITH f AS (SELECT conv_id, role AS field, min(turn) AS t FROM conversations GROUP BY ALL), v AS (SELECT f.*, length(text)::VARCHAR AS v FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.t AND c.role = f.field),
s AS (SELECT c.conv_id, c.turn, (SELECT string_agg(field || '=' || v, '; ' ORDER BY t, field) FROM v WHERE v.conv_id = c.conv_id AND t < c.turn) AS facts, (SELECT string_agg(a.role || '(' || a.turn || ', ' || length(a.text) || ')', '; ' ORDER BY a.turn) FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn < c.turn AND length(a.text) > 100) AS acts FROM conversations c)
SELECT 'all:' || conv_id || ':' || turn AS id, 'disclosed: ' || coalesce(facts, 'none') || ' || actions: ' || coalesce(acts, 'none') AS state FROM s""")
def state_lines(spark, sf_dir):
    """What each conversation has disclosed and done before each turn."""
    c = read(spark, sf_dir, "conversations")
    facts = c.select("conv_id", "turn", F.col("role").alias("field"), F.length("text").cast("string").alias("value"))
    done = c.where(F.length("text") > 100).select("conv_id", "turn", F.col("role").alias("action"), F.array(F.col("turn").cast("string"), F.length("text").cast("string")).alias("values"))
    s = V.state_line(c.select("conv_id", "turn"), facts, done)
    return s.select(V.turn_key(F.lit("all"), F.col("conv_id"), F.col("turn")).alias("id"), "state")


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL) SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context, coalesce((SELECT string_agg(role, ',' ORDER BY role) FROM f WHERE f.conv_id = c.conv_id AND t < c.turn), '') AS known FROM conversations c""")
def decision_stream(spark, sf_dir):
    """The decision log of a stream of turns, appended to as they come."""
    turns = stream(spark, sf_dir, "conversations")
    return usage.run_once(usage.decision_log(turns, 3), "append", f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}")
