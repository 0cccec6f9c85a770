"""Defined terms and cross references of contracts that are written from the parts: a contract for each size of part, with
a section and a definition for each part of that size."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from sluicegate.operators import references as R
from sluicegate.plans.base import query
from sluicegate.session import read

_PARTS = "p AS MATERIALIZED (SELECT p_size::BIGINT AS doc_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_size) AS m FROM part)"
#: Item r names the next one, but for every tenth; every seventh names the one two before, every fifth the last.
_LINKS = "l AS (SELECT doc_id, r, r + 1 AS u FROM p WHERE r % 10 <> 9 AND r < m UNION SELECT doc_id, r, r - 2 FROM p WHERE r % 7 = 0 AND r > 2 UNION SELECT doc_id, r, m FROM p WHERE r % 5 = 0 AND r < m)"


def _statements(spark, sf_dir):
    """(doc_id, stmt, text): for each item a heading and a definition that names other items and sections."""
    doc = W.partitionBy("p_size")
    p = read(spark, sf_dir, "part").withColumn("r", F.row_number().over(doc.orderBy("p_partkey"))).withColumn("m", F.count(F.lit(1)).over(doc))
    r, m = F.col("r"), F.col("m")
    item = lambda n: F.concat(F.lit("Item "), n.cast("string"))
    named = F.array_compact(F.array(F.when((r % 10 != 9) & (r < m), r + 1), F.when((r % 7 == 0) & (r > 2), r - 2), F.when((r % 5 == 0) & (r < m), m.cast("int"))))
    said = F.concat(F.lit('"'), item(r), F.lit('" means the '), "p_name", F.array_join(F.transform(named, lambda n: F.concat(F.lit(" with "), item(n))), ","))
    refs = F.concat(F.lit(", subject to Section "), r * 2, F.lit("(a)(ii) and Section 3.1 of the Supply Plan; see Exhibit A and Schedule "), r, F.lit("."))
    text = F.when(F.col("k") == 0, F.concat(r.cast("string"), F.lit(". "), F.initcap("p_name"))).when(F.col("k") == 1, F.concat(said, refs)).otherwise(F.concat(F.lit("EXHIBIT A to item "), r))
    rows = p.select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k")).where((F.col("k") < 2) | (r == 3))
    return rows.select(F.col("p_size").cast("long").alias("doc_id"), (r * 3 + F.col("k")).cast("long").alias("stmt"), text.alias("text"))


@query(f"""WITH RECURSIVE {_PARTS}, {_LINKS}, c AS (SELECT doc_id, r, u FROM l UNION SELECT c.doc_id, c.r, l.u FROM c JOIN l ON l.doc_id = c.doc_id AND l.r = c.u
), b AS MATERIALIZED (SELECT l.*, EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND c.r = l.u AND c.u = l.r) AS back FROM l
), d AS (SELECT doc_id, r, 0 AS depth FROM p UNION SELECT b.doc_id, b.r, d.depth + 1 FROM d JOIN b ON b.doc_id = d.doc_id AND b.u = d.r AND NOT back)
SELECT p.doc_id, 'Item ' || p.r AS term, max(depth)::INT AS depth, (SELECT count(*) FROM c WHERE c.doc_id = p.doc_id AND c.r = p.r AND c.u <> p.r) AS n_used,
    (SELECT coalesce(string_agg('Item ' || u, ',' ORDER BY 'Item ' || u), '') FROM b WHERE b.doc_id = p.doc_id AND b.r = p.r AND back) AS cyclic
FROM p JOIN d ON d.doc_id = p.doc_id AND d.r = p.r GROUP BY p.doc_id, p.r""")
def defined_terms(spark, sf_dir):
    """Terms with the depth of their expansion, all that they rest on, and the links that lead back to them."""
    e = R.expanded(R.definitions(_statements(spark, sf_dir)))
    return e.select("doc_id", "term", "depth", "n_used", F.array_join("cyclic", ",").alias("cyclic"))


@query(f"""WITH {_PARTS}, s AS (SELECT doc_id, r, m, r * 3 + 1 AS stmt FROM p)
SELECT doc_id, stmt, 0 AS n, 'section' AS kind, r * 2 || '(a)(ii)' AS label, CASE WHEN r * 2 <= m THEN (r * 2)::VARCHAR END AS target FROM s
UNION ALL SELECT doc_id, stmt, 1, 'document-section', '3.1 of Supply Plan', NULL FROM s
UNION ALL SELECT doc_id, stmt, 0, 'attachment', 'Exhibit A', CASE WHEN m >= 3 THEN 'Exhibit A' END FROM s
UNION ALL SELECT doc_id, stmt, 1, 'attachment', 'Schedule ' || r, NULL FROM s""")
def cross_references(spark, sf_dir):
    """References to sections, attachments and other documents, resolved where the document has them."""
    s = _statements(spark, sf_dir)
    sections = s.select("doc_id", F.regexp_extract("text", r"^(\d+)\. ", 1).alias("label")).where("label <> ''")
    return R.cross_references(s, sections)
