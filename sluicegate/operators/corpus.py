"""Overlap, duplicates, retrieval and clustering over texts and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.functions.text import char_grams, dot
from sluicegate.operators.neighbours import nearest_pairs, sound
from sluicegate.operators.sizes import cut, small


def exact_overlap(test: DataFrame, train: DataFrame, *keys: str) -> DataFrame:
    """Test rows, and how many have a training row with equal keys."""
    hit = test.join(train.select(*keys).distinct().withColumn("_hit", F.lit(1)), list(keys), "left")
    return hit.agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("overlapping"), (F.count("_hit") / F.count(F.lit(1))).alias("share"))


def overlap_agreement(test: DataFrame, train: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """Overlapping test rows whose label equals that of the last training row of the key."""
    last = train.groupBy(key).agg(F.max(F.struct(order, label)).alias("_t")).select(key, F.col(f"_t.{label}").alias("_label"))
    met = test.join(last, key)
    return met.agg(F.count(F.lit(1)).alias("overlapping"), F.count_if(F.col(label) == F.col("_label")).alias("agreeing"))


def contains_passage(docs: DataFrame, passages: DataFrame, text: str = "text", words: int = 8) -> DataFrame:
    """(doc_id, item_id): documents that hold a whole passage as a part of their text.

    passages: item_id, passage.  A passage's first and last word may be parts of the document's words; a run of up to
    words words between them is looked up by hash, and documents that have it are verified.  Passages of one or two words
    have no such run and are looked for in every text.  Only (doc_id, hash) is exploded; texts come in for verification.
    Passages without words hold nowhere.
    """
    split = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    asked = passages.select("item_id", "passage", split(F.col("passage")).alias("_w")).where("trim(passage) <> ''")
    asked = asked.withColumn("_n", F.least(F.lit(words), F.size("_w") - 2))
    sizes = sorted(r["_n"] for r in asked.where("_n > 0").select("_n").distinct().collect())  # words numbers at most
    run = lambda at, n: F.xxhash64(F.slice("_w", at, n))
    found = None
    if sizes:
        first = asked.where("_n > 0").select("item_id", "passage", run(F.lit(2), F.col("_n")).alias("_h"))
        places = lambda n: F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        of = lambda n: F.transform(places(n), lambda i: run(i, F.lit(n)))
        runs = F.array_distinct(F.flatten(F.array(*map(of, sizes))))
        hits = docs.select("doc_id", split(F.col(text)).alias("_w")).select("doc_id", F.explode(runs).alias("_h")).join(small(first.select("_h", "item_id")), "_h")
        hits = hits.select("doc_id", "item_id").distinct().join(small(first.select("item_id", "passage")), "item_id")
        found = docs.select("doc_id", text).join(hits, "doc_id").where(F.contains(F.col(text), F.col("passage"))).select("doc_id", "item_id")
    short = asked.where("_n <= 0").select("item_id", "passage")
    if not short.isEmpty():
        met = docs.select("doc_id", text).join(small(short), F.contains(F.col(text), F.col("passage"))).select("doc_id", "item_id")
        found = met if found is None else found.unionByName(met)
    return docs.join(asked, F.lit(False)).select("doc_id", "item_id") if found is None else found.distinct()


def deduplicate(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each trimmed text; blank texts go."""
    rows = df.where(F.trim(F.col(text)) != "")
    first = rows.groupBy(F.trim(F.col(text)).alias("_t")).agg(F.min(order).alias("_first"))
    return rows.join(first, (F.trim(F.col(text)) == F.col("_t")) & (F.col(order) == F.col("_first"))).select(df.columns)


def duplicate_agreement(df: DataFrame, text: str, label: str) -> DataFrame:
    """Groups of equal texts with several rows: how many agree on the label, and the ceiling of a majority vote."""
    c = df.groupBy(text, label).agg(F.count(F.lit(1)).alias("c"))
    g = c.groupBy(text).agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.count(F.lit(1)).alias("kinds")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.count_if(F.col("kinds") == 1).alias("agreeing"), (F.sum("most") / F.sum("n")).alias("ceiling"))


def copies_histogram(df: DataFrame, text: str) -> DataFrame:
    return df.groupBy(text).agg(F.count(F.lit(1)).alias("copies")).groupBy("copies").agg(F.count(F.lit(1)).alias("groups"))


def bm25(docs: DataFrame, queries: DataFrame, tokens: Column, query_tokens: Column, k1: float = 1.2, b: float = 0.75, in_line: int = 10_000) -> DataFrame:
    """(query_id, doc_id, score) of every pair with a shared term; query terms as a set, idf = ln(1 + (N - df + .5) / (df + .5)).

    Texts are cut into terms once: a document keeps its length and its query terms.  Up to in_line query terms are looked up
    as a set where the terms arise; more meet the documents' terms in a join.
    """
    terms = cut(queries.select("query_id", F.explode(F.array_distinct(query_tokens)).alias("term")))
    wanted = terms.select("term").distinct()
    toks = docs.select("doc_id", tokens.alias("_t"))
    asked = [r["term"] for r in wanted.limit(in_line + 1).collect()]
    if len(asked) <= in_line:
        kept = cut(toks.select("doc_id", F.size("_t").alias("dl"), F.filter("_t", lambda t: t.isin(asked)).alias("_t")))
        size, posts = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")), kept.select("doc_id", "dl", F.explode("_t").alias("term"))
    else:
        size = toks.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t")).alias("avgdl"))
        posts = toks.select("doc_id", F.size("_t").alias("dl"), F.explode("_t").alias("term")).join(wanted, "term", "left_semi")
    tf = posts.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    post = tf.join(df, "term").crossJoin(F.broadcast(size))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return post.withColumn("part", part).join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def top(df: DataFrame, k: int, *by: str, order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: list[DataFrame], keys: list[str], base: float = 60.0) -> DataFrame:
    """Sum over rankings of 1 / (base + rank), rank from 0.  Each ranking: keys, rank from 1."""
    rows = None
    for r in rankings:
        part = r.select(*keys, (1 / (base + F.col("rank") - 1)).alias("_s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*keys).agg(F.sum("_s").alias("rrf"))


def nearest(queries: DataFrame, base: DataFrame, k: int, digits: int = 6, block: int = 256, apart: str | None = None) -> DataFrame:
    """(query_id, vec_id, sim, rank): k nearest by inner product, rounded; lowest id on ties; with apart, a column of both
    sides, of those with another value of it only.

    A stated set of queries against all rows, by products of blocks (``neighbours``), so pairs stay within tasks and about k
    rows a query and block leave them.  Rows that cannot be multiplied so (null vectors or components, other lengths,
    non-finite numbers) are met pair by pair.  queries: query_id, q; base: vec_id, v; ids are whole numbers.
    """
    asked = queries.select("query_id", "q", *([F.col(apart).alias("_group")] if apart else []))
    held = base.select("vec_id", "v", *([F.col(apart).alias("_own")] if apart else []))
    dim = base.agg(F.mode(F.nullif(F.size("v"), F.lit(-1)), True).alias("d")).first()["d"] or 1
    fits = {x: F.col(key).isNotNull() & sound(x, dim) & (F.col(group).isNotNull() if apart else F.lit(True)) for x, key, group in (("q", "query_id", "_group"), ("v", "vec_id", "_own"))}
    count = lambda df, x: df.agg(F.count_if(fits[x]).alias("n"), F.count_if(~fits[x]).alias("odd")).first()
    n, m = count(asked, "q"), count(held, "v")
    pairs = nearest_pairs(asked.where(fits["q"]), held.where(fits["v"]), k, digits, dim, apart is not None, n["n"], m["n"])
    kinds = {"query_id": queries.schema["query_id"].dataType, "vec_id": base.schema["vec_id"].dataType}
    sims = pairs.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), F.round("product", digits).alias("sim"))

    def plain(some: DataFrame, others: DataFrame, asks: int) -> DataFrame:
        blocks = max(1, -(-asks // block))
        packed = some.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).groupBy("_b").agg(F.collect_list(F.struct(*some.columns)).alias("_qs"))
        spread = others.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        met = spread.join(packed, "_b").select(*others.columns, F.inline("_qs")).where("query_id <> vec_id")
        met = met.where("_group <> _own") if apart else met
        return met.select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("v")), digits).alias("sim"))

    if n["odd"]:
        sims = sims.unionByName(plain(asked.where(~fits["q"]), held, n["odd"]))
    if m["odd"]:
        sims = sims.unionByName(plain(asked.where(fits["q"]), held.where(~fits["v"]), n["n"]))
    return top(sims, k, "query_id", order=[F.desc("sim"), F.asc("vec_id")])


def novel(neighbours: DataFrame, share: float, eps: float = 0.0) -> DataFrame:
    """(query_id, distance, novel): 1 - similarity of the first neighbour, novel where it lies strictly above the share's
    percentile of such distances (linear) plus eps.  Neighbours are found once, for the percentile and the rows."""
    near = cut(neighbours.where("rank = 1").select("query_id", F.round(1 - F.col("sim"), 6).alias("distance")))
    bar = near.agg(F.percentile("distance", F.lit(share)).alias("_t"))
    return near.crossJoin(F.broadcast(bar)).select("query_id", "distance", (F.col("distance") > F.col("_t") + eps).alias("novel"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, i, mean): mean of each dimension."""
    return df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def gram_cosine(a: DataFrame, b: DataFrame, text: str, n: int, least: float) -> DataFrame:
    """(a_id, b_id, cosine) of pairs a_id < b_id with character n-gram cosine at least least.

    Grams are ordered by the texts that have them, rare ones first.  The grams that come last in a text, as long as their
    share of its norm stays below least, cannot reach least on their own; so a pair's rarest common gram is among the
    others of both, and only those make candidates.  Frequent grams thus count in the score but bring no pairs together.
    """
    def bag(df: DataFrame) -> DataFrame:
        return df.select("id", F.explode(char_grams(text, n)).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("c"))

    x, y = bag(a), bag(b)
    often = x.unionByName(y).groupBy("g").agg(F.count(F.lit(1)).alias("f"))

    def weighed(bags: DataFrame) -> DataFrame:
        per = W.partitionBy("id")
        late = F.sum(F.col("c") * F.col("c")).over(per.orderBy(F.desc("f"), F.desc("g")).rowsBetween(W.unboundedPreceding, 0))
        rows = bags.join(often, "g").withColumn("late", late).withColumn("square", F.sum(F.col("c") * F.col("c")).over(per))
        return cut(rows.select("id", "g", "c", F.sqrt(F.col("square").cast("double")).alias("norm"), (F.col("late") >= (least - 1e-9) ** 2 * F.col("square")).alias("lead")))

    x, y = weighed(x), weighed(y)
    of = lambda rows, name: rows.select(F.col("id").alias(f"{name}_id"), "g", F.col("c").alias(name), F.col("norm").alias(f"{name}_norm"), "lead")
    x, y = of(x, "a"), of(y, "b")
    pairs = x.where("lead").select("a_id", "g").join(y.where("lead").select("b_id", "g"), "g").where("a_id < b_id").select("a_id", "b_id").distinct()
    met = pairs.join(x.drop("lead"), "a_id").join(y.drop("lead"), ["b_id", "g"])
    out = met.groupBy("a_id", "b_id").agg((F.sum(F.col("a") * F.col("b")) / (F.first("a_norm") * F.first("b_norm"))).alias("cosine"))
    return out.where(F.col("cosine") >= least)


def merge_groups(df: DataFrame, group: str, text: str, count: str) -> DataFrame:
    """Per group: the most frequent text (alphabetical on ties), all forms and the summed count."""
    best = F.min(F.struct((-F.col(count)).alias("c"), F.col(text).alias("t")))
    return df.groupBy(group).agg(best["t"].alias("canonical"), F.array_sort(F.collect_set(text)).alias("forms"), F.sum(count).alias("count"))


def repeated_lines(df: DataFrame, text: str, least: int) -> DataFrame:
    """(line, docs, times): lines that least documents share."""
    lines = df.select("doc_id", F.explode(F.split(text, "\n")).alias("line")).where("trim(line) <> ''")
    per = lines.groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("line").agg(F.count(F.lit(1)).alias("docs"), F.sum("c").alias("times")).where(F.col("docs") >= least)


def association_rules(df: DataFrame, item: str, key: str, support: int, confidence: float, lift: float) -> DataFrame:
    """(a, b, n, confidence, lift): b holds for at least confidence of the keys with a; pairs meet per key.

    Items of fewer than support keys cannot be part of a rule and make no pairs.
    """
    rows = df.select(key, item).distinct()
    total = rows.agg(F.countDistinct(key).alias("_t"))
    base = rows.groupBy(item).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= support)
    kept = rows.join(small(base.select(item)), item, "left_semi")
    pairs = kept.select(key, F.col(item).alias("a")).join(kept.select(key, F.col(item).alias("b")), key).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    out = pairs.join(small(base.select(F.col(item).alias("a"), F.col("c").alias("ca"))), "a").join(small(base.select(F.col(item).alias("b"), F.col("c").alias("cb"))), "b").crossJoin(F.broadcast(total))
    conf = F.col("n") / F.col("ca")
    return out.select("a", "b", "n", conf.alias("confidence"), (conf * F.col("_t") / F.col("cb")).alias("lift")).where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
