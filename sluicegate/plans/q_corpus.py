"""Queries over documents, pages, conversations, benchmarks and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluicegate.functions import text as T
from sluicegate.ident import bucket
from sluicegate.operators import dense, classification as C, corpus as O, documents as U, turns as V
from sluicegate.operators.graph import components
from sluicegate.plans.arms import _b
from sluicegate.plans.base import query, rounded
from sluicegate.session import read


@query(r"""SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')) AS normalized FROM documents""")
def squad_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.squad_normalize("text")).alias("normalized"))


@query(r"""SELECT item_id, len(w) AS words, len(list_distinct(list_transform(w, lambda x: x[1:7]))) AS stems, w[1] AS first FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark)""")
def word_tokens(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.size(T.words("text")).cast("long").alias("words"), F.size(F.array_distinct(T.stems("text"))).cast("long").alias("stems"), F.get(T.words("text"), F.lit(0)).alias("first"))


@query(r"""WITH t AS (SELECT item_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark), g AS (SELECT item_id, substr(t, i, 4) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 2)) AS i FROM t WHERE length(t) >= 4)) SELECT item_id, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM g GROUP BY 1""")
def char_grams(spark, sf_dir):
    g = read(spark, sf_dir, "benchmark").select("item_id", F.explode(T.char_grams("text", 4)).alias("g"))
    return g.groupBy("item_id").agg(F.count(F.lit(1)).alias("grams"), F.countDistinct("g").alias("distinct_grams"))


@query(r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark), g AS (SELECT w[i] || ' ' || w[i + 1] AS g FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) SELECT g AS gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 3""")
def word_grams(spark, sf_dir):
    g = read(spark, sf_dir, "benchmark").select(F.explode(T.word_grams(T.words("text"), 2)).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(text, '\b(Mr|Mrs|Dr|No|Inc|Ltd|vs|Sec|Art)\.(\s)', '\1' || chr(2) || '\2', 'g') AS t FROM documents), d AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM p)
SELECT doc_id, len(s)::INT AS sentences, (1 + len(list_filter(s[2:], lambda x: length(x) >= 20)))::INT AS merged FROM d""")
def sentence_counts(spark, sf_dir):
    """Sentences, and sentences with short ones joined to the one before."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.sentences("text")).alias("sentences"), F.size(T.sentences("text", 20)).alias("merged"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS plain FROM pages""")
def strip_markup(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_markup("html")).alias("plain"))


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), 'https?://[^\s]+', '<url>', 'g'), '\+?\d[\d -]{7,}\d', '<phone>', 'g'), '\d+(?:[.,]\d+)*', '<number>', 'g') AS t, text FROM documents)
SELECT doc_id, md5(t) AS masked, (length(t) - length(replace(t, '<email>', ''))) // 7 AS emails, (length(t) - length(replace(t, '<phone>', ''))) // 7 AS phones FROM m WHERE t <> text""")
def mask_values(spark, sf_dir):
    """Delexicalization of e-mail addresses, links, phone numbers and numbers."""
    m = read(spark, sf_dir, "documents").withColumn("t", T.delexicalize("text")).where("t <> text")
    count = lambda s: F.expr(f"(length(t) - length(replace(t, '{s}', ''))) div {len(s)}").cast("long")
    return m.select("doc_id", F.md5("t").alias("masked"), count("<email>").alias("emails"), count("<phone>").alias("phones"))


_ANSWER = """CASE doc_id % 8 WHEN 0 THEN 'Label: ' || upper(lang) || '.' WHEN 1 THEN lang WHEN 2 THEN 'it is not ' || lang || ' but fr' WHEN 3 THEN '**' || upper(lang) || '**' WHEN 4 THEN 'none' WHEN 5 THEN lang || ' or xx' WHEN 6 THEN (doc_id % 5)::VARCHAR ELSE '' END"""


@query(rf"""WITH a AS (SELECT doc_id, {_ANSWER} AS answer FROM documents), k AS (SELECT doc_id, answer, lower(answer) AS t, ['de', 'en', 'es', 'fr'] AS labels FROM a),
h AS (SELECT *, list_filter(labels, lambda x: regexp_matches(t, '\b' || x || '\b') AND NOT regexp_matches(t, '\b(not|isn''t|no)\s+(a |an |the )?' || x || '\b')) AS hits, list_filter(list_transform(labels, lambda x: {{'at': instr(' ' || regexp_replace(t, '[^a-z0-9]', ' ', 'g') || ' ', ' ' || x || ' '), 'x': x}}), lambda z: z['at'] > 0) AS places FROM k)
SELECT doc_id, CASE WHEN len(hits) = 1 THEN hits[1] END AS resolved, list_sort(places)[1]['x'] AS first, coalesce(CASE WHEN TRY_CAST(answer AS INT) BETWEEN 0 AND 3 THEN TRY_CAST(answer AS INT) END, CASE WHEN contains(t, 'de') THEN 0 WHEN contains(t, 'en') THEN 1 WHEN contains(t, 'es') THEN 2 WHEN contains(t, 'fr') THEN 3 END, -1)::INT AS indexed FROM h""")
def label_parsing(spark, sf_dir):
    """Strict, lenient and indexed label parsing of answers made from each document's language."""
    labels = ["de", "en", "es", "fr"]
    a = read(spark, sf_dir, "documents").select("doc_id", F.expr(_ANSWER.replace("(doc_id % 5)::VARCHAR", "cast(doc_id % 5 as string)")).alias("answer"))
    return a.select("doc_id", T.resolve_label("answer", labels).alias("resolved"), T.first_label("answer", labels).alias("first"), T.index_label("answer", labels).alias("indexed"))


@query(r"""WITH p AS (SELECT a.item_id AS a, b.item_id AS b, regexp_extract_all(lower(a.text), '[a-z0-9'']+') AS x, regexp_extract_all(lower(b.text), '[a-z0-9'']+') AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
c AS (SELECT a, b, x, y, list_sum(list_transform(list_intersect(x, y), lambda k: least(len(list_filter(x, lambda v: v = k)), len(list_filter(y, lambda v: v = k))))) AS s FROM p) SELECT a, b, round(2 * coalesce(s, 0) / (len(x) + len(y)), 6) AS f1, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM c""")
def token_overlap(spark, sf_dir):
    """Token F1 as multisets and Jaccard of sets, of each benchmark item and the next."""
    b = read(spark, sf_dir, "benchmark").select("item_id", T.words("text").alias("w"))
    p = b.select(F.col("item_id").alias("a"), F.col("w").alias("x")).join(b.select(F.col("item_id").alias("b"), F.col("w").alias("y")), F.col("b") == F.col("a") + 1)
    return rounded(p.select("a", "b", T.token_f1(F.col("x"), F.col("y")).alias("f1"), (F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard")))


@query("""SELECT count(*) AS n, count(b.text) AS overlapping, round(count(b.text) / count(*), 6) AS share FROM (SELECT text FROM documents WHERE doc_id % 2 = 1) a LEFT JOIN (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0) b USING (text)""")
def exact_overlap(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return rounded(O.exact_overlap(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "text"))


@query("""WITH t AS (SELECT text, arg_max(lang || source, doc_id) AS l FROM documents WHERE doc_id % 2 = 0 GROUP BY text) SELECT count(*) AS overlapping, count(*) FILTER (l = lang || source) AS agreeing FROM documents JOIN t USING (text) WHERE doc_id % 2 = 1""")
def overlap_agreement(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("label", F.concat("lang", "source"))
    return O.overlap_agreement(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), "text", "label", "doc_id")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_contamination(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return O.contains_passage(read(spark, sf_dir, "documents"), b)


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) AS r FROM documents WHERE trim(text) <> '') WHERE r = 1")
def deduplicate(spark, sf_dir):
    return O.deduplicate(read(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "lang")


@query("""WITH c AS (SELECT text, source, count(*) AS c FROM documents GROUP BY ALL), g AS (SELECT sum(c) AS n, max(c) AS most, count(*) AS kinds FROM c GROUP BY text HAVING sum(c) > 1)
SELECT count(*) AS groups, sum(n)::BIGINT AS rows, count(*) FILTER (kinds = 1) AS agreeing, round(sum(most) / sum(n), 6) AS ceiling FROM g""")
def duplicate_agreement(spark, sf_dir):
    return rounded(O.duplicate_agreement(read(spark, sf_dir, "documents"), "text", "source"))


@query("SELECT copies, count(*) AS groups FROM (SELECT count(*) AS copies FROM documents GROUP BY text) GROUP BY 1")
def copies_histogram(spark, sf_dir):
    return O.copies_histogram(read(spark, sf_dir, "documents"), "text")


_BM25 = r"""t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS term FROM benchmark WHERE item_id % 50 = 0),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
s AS (SELECT item_id AS query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _bm25(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
    return O.bm25(read(spark, sf_dir, "documents"), q, T.words("text"), T.words("text"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 5) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def bm25(spark, sf_dir):
    return O.top(_bm25(spark, sf_dir).withColumn("score", F.round("score", 5)), 10, "query_id", order=[F.desc("score"), F.asc("doc_id")])


@query(f"""WITH {_BM25}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS r FROM s), l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, doc_id) AS r FROM s JOIN documents USING (doc_id)),
f AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + r - 1)) AS rrf FROM (SELECT * FROM a WHERE r <= 20 UNION ALL SELECT * FROM l WHERE r <= 20) GROUP BY ALL) SELECT query_id, doc_id, round(rrf, 8) AS rrf FROM f""")
def rank_fusion(spark, sf_dir):
    """Reciprocal rank fusion of BM25 with a second ranking."""
    s = _bm25(spark, sf_dir)
    a = O.top(s.withColumn("score", F.round("score", 5)), 20, "query_id", order=[F.desc("score"), F.asc("doc_id")])
    length = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    b = O.top(s.join(length, "doc_id"), 20, "query_id", order=[F.asc("n_chars"), F.asc("doc_id")])
    return rounded(O.reciprocal_rank_fusion([a, b], ["query_id", "doc_id"]), 8)


_SIM = "round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6)"


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_SIM} AS sim FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def nearest_neighbours(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return O.nearest(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 5)


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, round(1 - max({_SIM}), 6) AS distance FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id GROUP BY 1), t AS (SELECT quantile_cont(distance, 0.99) AS t FROM s) SELECT query_id, distance, distance > t AS novel FROM s, t""")
def novelty(spark, sf_dir):
    """Distance to the nearest other row, and whether it is strictly above the 99th percentile of such distances."""
    e = read(spark, sf_dir, "embeddings")
    n = O.nearest(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select("vec_id", F.col("embedding").alias("v")), 1)
    return O.novel(n, 0.99)


@query("SELECT label, i::INT AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def class_centroids(spark, sf_dir):
    return rounded(O.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding"))


_GRAMS = r"""g AS (SELECT id, g, count(*) AS c FROM (SELECT item_id AS id, t, unnest(range(1, length(t) - 2)) AS i, substr(t, i, 4) AS g FROM (SELECT item_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM benchmark)) GROUP BY ALL),
n AS (SELECT id, sqrt(sum(c * c)) AS n FROM g GROUP BY 1), cos AS (SELECT x.id AS a_id, y.id AS b_id, sum(x.c * y.c) / (any_value(nx.n) * any_value(ny.n)) AS cosine FROM g x JOIN g y ON x.g = y.g AND x.id < y.id JOIN n nx ON nx.id = x.id JOIN n ny ON ny.id = y.id GROUP BY ALL)"""


def _gram_edges(spark, sf_dir, least):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return b, O.gram_cosine(b, b, "text", 4, least)


@query(f"WITH {_GRAMS} SELECT a_id, b_id, round(cosine, 6) AS cosine FROM cos WHERE cosine >= 0.3")
def gram_similarity(spark, sf_dir):
    return rounded(_gram_edges(spark, sf_dir, 0.3)[1])


@query(f"""WITH RECURSIVE {_GRAMS}, e AS (SELECT a_id AS a, b_id AS b FROM cos WHERE cosine >= 0.42 UNION ALL SELECT b_id, a_id FROM cos WHERE cosine >= 0.42), r(id, c) AS (SELECT item_id, item_id FROM benchmark UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id) SELECT id, min(c) AS cluster FROM r GROUP BY id""")
def single_linkage(spark, sf_dir):
    b, edges = _gram_edges(spark, sf_dir, 0.42)
    return components(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), b)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6) >= 0.3
), r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT r.id AS vec_id, any_value(v.label) AS label, min(c) AS cluster FROM r JOIN embeddings v ON v.vec_id = r.id GROUP BY r.id""")
def dense_linkage(spark, sf_dir):
    """Clusters of the vectors of each label that are alike, by blocked products."""
    return dense.clusters(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 0.3)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT line, count(DISTINCT doc_id) AS docs, count(*) AS times FROM l WHERE trim(line) <> '' GROUP BY 1) SELECT line, docs, times FROM c WHERE docs >= 5""")
def repeated_lines(spark, sf_dir):
    return O.repeated_lines(read(spark, sf_dir, "documents"), "text", 5)


@query("""WITH r AS (SELECT DISTINCT user_id, event_type || (event_id % 3) AS item FROM events), b AS (SELECT item, count(*) AS c FROM r GROUP BY 1), t AS (SELECT count(DISTINCT user_id) AS t FROM r),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM r x JOIN r y ON x.user_id = y.user_id AND x.item <> y.item GROUP BY ALL HAVING count(*) >= 20) SELECT p.a, p.b, n, round(n / ca.c, 6) AS confidence, round(n / ca.c * t / cb.c, 6) AS lift FROM p JOIN b ca ON ca.item = p.a JOIN b cb ON cb.item = p.b, t WHERE n / ca.c >= 0.5 AND n / ca.c * t / cb.c >= 1.0""")
def association_rules(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("item"))
    return rounded(O.association_rules(e, "item", "user_id", 20, 0.5, 1.0))


@query("""WITH d AS (SELECT form, lower(form) AS k, count(*) AS c FROM (SELECT CASE WHEN conv_id % 3 = 0 THEN replace(w, 'e', 'E') ELSE w END AS form FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> '') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, form) AS r FROM d) SELECT k AS "group", max(form) FILTER (r = 1) AS canonical, count(*)::INT AS forms, sum(c)::BIGINT AS count FROM r GROUP BY k""")
def merge_groups(spark, sf_dir):
    """Words that are equal but for their case, a third of the conversations writing E for e: the most frequent form stands for all."""
    w = read(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split("text", " ")).alias("w")).where("w <> ''")
    d = w.select(F.when(F.col("conv_id") % 3 == 0, F.regexp_replace("w", "e", "E")).otherwise(F.col("w")).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("c")).withColumn("group", F.lower("form"))
    return O.merge_groups(d, "group", "form", "c").select("group", "canonical", F.size("forms").alias("forms"), "count")


@query("SELECT conv_id, turn, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM conversations".replace("list(role)", "string_agg(role, '>')").replace(" AS c ", " AS context "))
def context_window(spark, sf_dir):
    c = V.context(read(spark, sf_dir, "conversations"), 3, F.col("role"))
    return c.select("conv_id", "turn", F.when(F.size("context") > 0, F.array_join("context", ">")).alias("context"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT a.conv_id, a.turn, string_agg(b.turn::VARCHAR, '>' ORDER BY b.n) AS context FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.n < a.n AND (b.n <= 1 OR b.n >= a.n - 2) GROUP BY ALL""")
def first_and_last_turns(spark, sf_dir):
    c = V.first_and_last(read(spark, sf_dir, "conversations"), 1, 2, F.col("turn").cast("string"))
    return c.where(F.size("context") > 0).select("conv_id", "turn", F.array_join("context", ">").alias("context"))


@query("SELECT recency, count(*) AS n FROM (SELECT least(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1, 4)::INT AS recency FROM conversations) GROUP BY 1")
def recency_buckets(spark, sf_dir):
    return V.recency(read(spark, sf_dir, "conversations"), 4).groupBy("recency").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT conv_id, role AS field, min(turn) AS at FROM conversations GROUP BY ALL) SELECT c.conv_id, c.turn, string_agg(field, ',' ORDER BY field) AS known FROM conversations c JOIN f ON f.conv_id = c.conv_id AND f.at < c.turn GROUP BY ALL""")
def disclosure(spark, sf_dir):
    """Fields that earlier turns have disclosed."""
    c = read(spark, sf_dir, "conversations")
    d = V.disclosed(c, c.select("conv_id", "turn", F.col("role").alias("field")))
    return d.where(F.size("known") > 0).select("conv_id", "turn", F.array_join("known", ",").alias("known"))


@query("SELECT conv_id, turn, string_agg(CASE WHEN length(text) > 100 THEN role END, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS actions FROM conversations")
def actions_so_far(spark, sf_dir):
    c = V.actions_so_far(read(spark, sf_dir, "conversations"), F.when(F.length("text") > 100, F.col("role")))
    return c.select("conv_id", "turn", F.when(F.size("actions") > 0, F.array_join("actions", ",")).alias("actions"))


_TRANS = """s AS (SELECT conv_id, turn, CASE WHEN length(text) > 120 THEN 'long' WHEN length(text) > 60 THEN 'mid' ELSE 'short' END AS v FROM conversations),
l AS (SELECT v AS next, lag(v, 1) OVER w AS a, lag(v, 2) OVER w AS b, lag(v, 3) OVER w AS c, lag(v, 4) OVER w AS d, conv_id, turn FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
tr AS (SELECT 0 AS n, '' AS context, next, count(*) AS count FROM l GROUP BY ALL UNION ALL SELECT 1, a, next, count(*) FROM l WHERE a IS NOT NULL GROUP BY ALL UNION ALL SELECT 2, b || ' ' || a, next, count(*) FROM l WHERE b IS NOT NULL GROUP BY ALL
UNION ALL SELECT 3, c || ' ' || b || ' ' || a, next, count(*) FROM l WHERE c IS NOT NULL GROUP BY ALL UNION ALL SELECT 4, d || ' ' || c || ' ' || b || ' ' || a, next, count(*) FROM l WHERE d IS NOT NULL GROUP BY ALL)"""


def _steps(spark, sf_dir):
    n = F.length("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(n > 120, "long").when(n > 60, "mid").otherwise("short").alias("v"))


@query(f"WITH {_TRANS} SELECT n, context, next, count FROM tr")
def ngram_transitions(spark, sf_dir):
    return V.transitions(_steps(spark, sf_dir), "v", 4)


@query(f"""WITH {_TRANS}, best AS (SELECT n, context, next FROM (SELECT *, row_number() OVER (PARTITION BY n, context ORDER BY count DESC, next) AS r FROM tr) WHERE r = 1)
SELECT conv_id, turn, l.next AS v, coalesce(g2.next, g1.next, g0.next) AS predicted, CASE WHEN g2.next IS NOT NULL THEN 2 WHEN g1.next IS NOT NULL THEN 1 ELSE 0 END AS used FROM l LEFT JOIN best g2 ON g2.n = 2 AND g2.context = b || ' ' || a LEFT JOIN best g1 ON g1.n = 1 AND g1.context = a LEFT JOIN best g0 ON g0.n = 0""")
def ngram_backoff(spark, sf_dir):
    s = _steps(spark, sf_dir)
    return V.backoff(s, V.transitions(s, "v", 2), "v", 2)


@query(r"""WITH t AS (SELECT conv_id, regexp_replace(text, '\d+(?:[.,]\d+)*', '<number>', 'g') AS template FROM conversations) SELECT template, count(*) AS count FROM t GROUP BY 1""")
def text_templates(spark, sf_dir):
    return V.templates(read(spark, sf_dir, "conversations"), F.regexp_replace("text", r"\d+(?:[.,]\d+)*", "<number>"), 3).select("template", "count")


@query("""WITH c AS (SELECT conv_id, count(*) OVER (PARTITION BY role, length(text) // 40) AS c FROM conversations), g AS (SELECT least_::INT AS least, conv_id, c >= least_ AS ok FROM c, (SELECT unnest([2, 10, 50]) AS least_)),
p AS (SELECT least, conv_id, bool_and(ok) AS a, count(*) AS n, sum(ok::INT) AS k FROM g GROUP BY ALL) SELECT least, round(sum(k) / sum(n), 6) AS rows, round(avg(a::INT), 6) AS conversations FROM p GROUP BY 1""")
def coverage_by_count(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("template", F.concat("role", F.expr("cast(length(text) div 40 as string)")))
    return rounded(V.coverage_by_count(c, "template", (2, 10, 50)))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(['en', 'de', 'fr'], lambda x: (doc_id + length(x || lang)) % 2 = 0 OR x = lang)) AS g, [lang] AS p FROM documents),
c AS (SELECT len(list_intersect(g, p)) AS t, len(g) AS g, len(p) AS p FROM t) SELECT round(sum(t) / sum(p), 6) AS micro_p, round(sum(t) / sum(g), 6) AS micro_r, round(2 * sum(t) / (sum(p) + sum(g)), 6) AS micro_f1, round(avg((t = g AND t = p)::INT), 6) AS exact, round(avg((p = 0)::INT), 6) AS empty FROM c""")
def multilabel(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    g = F.filter(F.lit(["en", "de", "fr"]), lambda x: ((F.col("doc_id") + F.length(F.concat(x, F.col("lang")))) % 2 == 0) | (x == F.col("lang")))
    return rounded(C.multilabel(d.select(F.array_distinct(g).alias("g"), F.array("lang").alias("p")), "g", "p"))


@query("""WITH c AS (SELECT quality, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL), m AS (SELECT lang, arg_max(quality, n * 10 - quality) AS mode FROM c GROUP BY 1) SELECT lang, mode FROM m""")
def majority_by_language(spark, sf_dir):
    t = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return C.mode(t, "quality", "lang").select("lang", "mode")


@query("WITH p AS (SELECT conv_id, turn, length(text) AS size FROM conversations) SELECT conv_id, turn FROM p WHERE size > 400")
def oversized_turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where(F.length("text") > 400).select("conv_id", "turn")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
f AS (SELECT conv_id, turn, r, 0 AS pack, greatest(0, 300 - n) AS left_ FROM s WHERE r = 1 UNION ALL SELECT s.conv_id, s.turn, s.r, CASE WHEN f.left_ < s.n THEN f.pack + 1 ELSE f.pack END, CASE WHEN f.left_ < s.n THEN greatest(0, 300 - s.n) ELSE f.left_ - s.n END FROM f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1)
SELECT conv_id, turn, pack FROM f""")
def packed_turns(spark, sf_dir):
    """Packs of whole turns within a budget of characters; a turn over the budget is a pack of its own."""
    from sluicegate.operators import ledger as L

    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return L.pack(c, "conv_id", "turn", "size", 300)


_UNITS = r"""WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), p AS (SELECT doc_id, n, ls[n] AS line FROM l),
s AS (SELECT doc_id, n, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) - length(regexp_replace(line, '^\s+', '')) AS start, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS body FROM p),
h AS (SELECT *, CASE WHEN length(body) <= 80 AND regexp_matches(body, '^(?:(?:Section|Article)\s+)?(\d+(?:\.\d+)*|\([a-z]\))[.)]?\s+(\S.*)$') THEN regexp_extract(body, '^(?:(?:Section|Article)\s+)?(\d+(?:\.\d+)*|\([a-z]\))[.)]?\s+(\S.*)$', 1) END AS label FROM s WHERE body <> '')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS i, start::INT AS start, (start + length(body))::INT AS "end", CASE WHEN label IS NULL THEN 'paragraph' ELSE 'heading' END AS kind, label, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM h"""


@query(_UNITS)
def document_units(spark, sf_dir):
    """Non-blank lines with the headings they stand under."""
    return U.units(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def version_alignment(spark, sf_dir):
    """Aligned paragraphs of neighbouring documents; sequence matching, held against examples by tests."""
    d = read(spark, sf_dir, "documents")
    pairs = d.select("doc_id", F.col("text").alias("old")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("new")), "doc_id")
    return U.aligned(pairs)


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') AS t FROM documents), s AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS s FROM d)
SELECT doc_id, count(*) AS n FROM s WHERE lower(regexp_extract(s, '(?i)\b(may|shall|must|the)\b', 1)) = 'the' AND NOT regexp_matches(lower(s), '\b(not|never|no)\b') GROUP BY 1""")
def contract_queries(spark, sf_dir):
    """The contract query language over a table of norms taken from document sentences with modal words."""
    n = U.norms(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return U.ask(n, "HAS(modal=the, polarity=plus)").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_b('split', 10, 'doc_id')} AS part, count(*) AS n FROM documents GROUP BY 1")
def document_split(spark, sf_dir):
    """Group-wise hash split of documents."""
    return read(spark, sf_dir, "documents").groupBy(bucket("doc_id", 10, "split").alias("part")).agg(F.count(F.lit(1)).alias("n"))
