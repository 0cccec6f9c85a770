"""Gates, tiers and aggregates over decisions, units and judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sluicegate.operators.sizes import cut, small


def first_reason(**tests: Column) -> Column:
    """The name of the first true test, in the order given; null where none is."""
    return F.coalesce(*(F.when(t, F.lit(name)) for name, t in tests.items()))


def tiered(*tiers: Column) -> Column:
    """The first tier that answers."""
    return F.coalesce(*tiers)


def all_readings(df: DataFrame, answer: str, *by: str) -> DataFrame:
    """answer only where two readings at least agree and none differs (supervaluation)."""
    a = df.groupBy(*by).agg(F.countDistinct(answer).alias("_k"), F.count(answer).alias("_n"), F.min(answer).alias("_a"), F.count(F.lit(1)).alias("_all"))
    return a.select(*by, F.when((F.col("_k") == 1) & (F.col("_n") >= 2) & (F.col("_n") == F.col("_all")), F.col("_a")).alias(answer))


def three_valued(df: DataFrame, answer: str, *by: str) -> DataFrame:
    """any_yes and all_yes of yes, no or null answers: null where an unknown one decides."""
    yes, no = F.bool_or(F.col(answer) == "yes"), F.bool_or(F.col(answer) == "no")
    unknown = F.count(F.lit(1)) > F.count(answer)
    any_yes = F.when(F.coalesce(yes, F.lit(False)), "yes").when(unknown, None).otherwise("no")
    all_yes = F.when(F.coalesce(no, F.lit(False)), "no").when(unknown, None).otherwise("yes")
    return df.groupBy(*by).agg(any_yes.alias("any_yes"), all_yes.alias("all_yes"))


def routing_metrics(df: DataFrame, fast: str, conversation: str) -> DataFrame:
    """Share of fast decisions, and of conversations handled without an escalation."""
    per = df.groupBy(conversation).agg(F.bool_and(fast).alias("_all"), F.count(F.lit(1)).alias("_n"), F.sum(F.col(fast).cast("int")).alias("_f"))
    return per.agg((F.sum("_f") / F.sum("_n")).alias("fast_rate"), F.avg(F.col("_all").cast("double")).alias("containment"))


def reason_shares(df: DataFrame, reason: str) -> DataFrame:
    """Share of each reason among rows that have one."""
    c = df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def component_errors(df: DataFrame, rights: list[str]) -> DataFrame:
    """Per component: rows that have a verdict, and the share of wrong ones among them."""
    flat = df.select(F.inline(F.array(*(F.struct(F.lit(r).alias("component"), F.col(r).alias("_ok")) for r in rights)))).where("_ok is not null")
    return flat.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("_ok")).cast("double")).alias("error"))


def latency_by_route(df: DataFrame, route: str, latency: str, cost: str, cache_hit: str) -> DataFrame:
    """Cost without cache hits, and latency p50 and p95 (linear), for each route."""
    return df.groupBy(route).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col(cache_hit), F.col(cost)).otherwise(0.0)).alias("cost"), F.percentile(latency, F.lit(0.5)).alias("p50"), F.percentile(latency, F.lit(0.95)).alias("p95"))


def expand(df: DataFrame, gold: str, pred: str, *keep: str) -> DataFrame:
    """max(1, values) rows for each record: (position, gold, pred), -1 where a side has no value there."""
    n = F.greatest(F.lit(1), F.size(gold), F.size(pred))
    at = lambda c: F.coalesce(F.get(F.col(c), F.col("position")), F.lit(-1))
    rows = df.withColumn("position", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(*keep, "position", at(gold).alias("gold_value"), at(pred).alias("pred_value"))


def judge_agreement(df: DataFrame, item: str, judge: str, verdict: str) -> DataFrame:
    """(judge_a, judge_b, n, agreement) for each pair of judges over their common items."""
    a = df.select(item, F.col(judge).alias("judge_a"), F.col(verdict).alias("_a"))
    b = df.select(item, F.col(judge).alias("judge_b"), F.col(verdict).alias("_b"))
    return a.join(b, item).where("judge_a < judge_b").groupBy("judge_a", "judge_b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))


def unanimous(df: DataFrame, item: str, verdict: str) -> DataFrame:
    per = df.groupBy(item).agg((F.countDistinct(verdict) == 1).alias("_u"))
    return per.agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("_u").cast("double")).alias("unanimous"))


def blended(tiers: DataFrame, baseline: str = "large") -> DataFrame:
    """Accuracy and cost weighted by class counts, and savings against sending all to the baseline.

    tiers: class, n, tier, accuracy, cost, baseline_cost.
    """
    n = F.sum("n")
    return tiers.agg((F.sum(F.col("n") * F.col("accuracy")) / n).alias("accuracy"), (F.sum(F.col("n") * F.col("cost")) / n).alias("cost"), (1 - F.sum(F.col("n") * F.col("cost")) / F.sum(F.col("n") * F.col("baseline_cost"))).alias("savings"), (F.sum(F.when(F.col("tier") == baseline, F.col("n")).otherwise(0)) / n).alias("baseline_share"))


def assign_tier(accuracy: Column, bar: float, margin: float) -> Column:
    """free at the bar or above, review within a margin below it, else large."""
    return F.when(accuracy >= bar, "free").when(accuracy >= bar - margin, "review").otherwise("large")


def document_scores(df: DataFrame, doc: str, label: str, score: str, other: str, evidence: int = 3) -> DataFrame:
    """Per document: the best label that isn't other (smallest on ties), its score, and the units of the best scores.

    df: doc, unit, label, score.
    """
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(doc).orderBy(F.desc(score), "unit")))
    top = ranked.where(F.col("_r") <= evidence).groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "unit"))), lambda x: x["unit"]).alias("evidence"))
    best = df.where(F.col(label) != other).groupBy(doc).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(label).alias("l"))).alias("b"))
    return top.join(best, doc, "left").select(doc, F.col("b.l").alias("label"), (-F.col("b.s")).alias("score"), "evidence")


def route_gate(df: DataFrame, item: str, family: str, p: str, none: str, p_none: float = 0.10, margin: float = 0.30) -> DataFrame:
    """routed: the best family where the none family has less than p_none and the margin to the second is reached."""
    fam = df.groupBy(item, family).agg(F.sum(p).alias("_p"))
    rest = fam.where(F.col(family) != none)
    ranked = rest.withColumn("_r", F.row_number().over(W.partitionBy(item).orderBy(F.desc("_p"), family)))
    two = ranked.groupBy(item).agg(F.max(F.when(F.col("_r") == 1, F.col(family))).alias("_best"), F.max(F.when(F.col("_r") == 1, F.col("_p"))).alias("_1"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col("_p"))), F.lit(0.0)).alias("_2"))
    nothing = fam.where(F.col(family) == none).select(item, F.col("_p").alias("_none"))
    ok = (F.coalesce("_none", F.lit(0.0)) < p_none) & (F.col("_1") - F.col("_2") >= margin)
    return two.join(nothing, item, "left").select(item, F.when(ok, F.col("_best")).alias("routed"))


def available(required: Column, known: Column) -> Column:
    """Whether all required slots are known."""
    return F.size(F.array_except(required, known)) == 0


def audit_estimate(df: DataFrame, stratum: str, weight: str, right: str) -> DataFrame:
    """Weight-combined share of right rows over strata; ambiguous (null) rows give the lower and the upper bound."""
    s = df.groupBy(stratum).agg(F.first(weight).alias("w"), F.avg(F.coalesce(F.col(right).cast("double"), F.lit(0.0))).alias("lo"), F.avg(F.coalesce(F.col(right).cast("double"), F.lit(1.0))).alias("hi"))
    return s.agg((F.sum(F.col("w") * F.col("lo")) / F.sum("w")).alias("lower"), (F.sum(F.col("w") * F.col("hi")) / F.sum("w")).alias("upper"))


def fuzzy(df: DataFrame, p: str, *by: str) -> DataFrame:
    """Any and all over probabilities: greatest, least, and the product of complements' complement."""
    return df.groupBy(*by).agg(F.max(p).alias("any_max"), F.min(p).alias("all_min"), (1 - F.exp(F.sum(F.log(1 - F.col(p))))).alias("any_product"))


def at_most(df: DataFrame, k: int, group: list[str], order: list[Column], total: int, by: list[str]) -> DataFrame:
    """Best first, at most k rows of each group, then the first total rows of each by."""
    capped = df.withColumn("_g", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_g") <= k).drop("_g")
    return capped.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= total)


def best_window(df: DataFrame, by: str, order: str, hit: str, width: int) -> DataFrame:
    """The first run of width rows with the most hits: (by, start, hits)."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(0, width - 1)
    runs = df.withColumn("_h", F.sum(hit).over(w))
    return runs.groupBy(by).agg(F.min(F.struct((-F.col("_h")).alias("h"), F.col(order).alias("s"))).alias("b")).select(by, F.col("b.s").alias("start"), (-F.col("b.h")).alias("hits"))


def scorable_in_all(df: DataFrame, item: str, arm: str, arms: int) -> DataFrame:
    """Items that every arm scored, and what each arm loses by that."""
    full = df.groupBy(item).agg(F.countDistinct(arm).alias("_a")).where(F.col("_a") == arms).select(item, F.lit(1).alias("_in"))
    return df.join(full, item, "left").groupBy(arm).agg(F.count(F.lit(1)).alias("rows"), F.count("_in").alias("kept"))


def fan_out(df: DataFrame, key: str, compute) -> DataFrame:
    """compute once for each distinct key, and its columns for every row."""
    return df.join(compute(df.select(key).distinct()), key)


def tag(tokens: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """(doc_id, at, size, tag): leftmost-longest lexicon phrases; tokens: doc_id, tokens array; lexicon: phrase, tag.

    Phrases of every length are looked up; overlaps are then resolved within a document by a fold over its hits.
    """

    def runs(n: int) -> Column:
        places = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct((i - 1).alias("at"), F.lit(n).alias("size"), F.array_join(F.slice("tokens", i, F.lit(n)), " ").alias("phrase")))

    grams = F.flatten(F.array(*map(runs, range(1, longest + 1))))
    hits = tokens.select("doc_id", F.inline(grams)).join(small(lexicon), "phrase").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("neg"), "tag"))).alias("h"))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,size:int,tag:string>>").alias("out"))
    take = lambda s, x: F.when(x["at"] >= s["end"], F.struct((x["at"] - x["neg"]).alias("end"), F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), (-x["neg"]).alias("size"), x["tag"].alias("tag")))).alias("out"))).otherwise(s)
    return hits.select("doc_id", F.inline(F.aggregate("h", zero, take)["out"]))


def resolve_name(asked: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """(asked, name): exact, then equal without folder and ending, then the closest by edit distance of at least least.

    Each step takes what the steps before have left: two equi-joins, then one on the length of the names, which for a
    likeness of least lies within l * least and l / least; distances are counted up to what least allows.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"^.*/", ""), r"\.[a-z0-9]+$", "")
    known = cut(names.select("name").where("name IS NOT NULL").distinct().withColumn("base", bare(F.col("name"))).withColumn("size", F.length("base")))
    open_ = cut(asked.select("asked").where("asked IS NOT NULL").distinct().withColumn("base", bare(F.col("asked"))).withColumn("size", F.length("base")))
    exact = cut(open_.join(known.select(F.col("name").alias("asked")), "asked").select("asked", F.col("asked").alias("name")))
    open_ = open_.join(exact, "asked", "left_anti")
    same = cut(open_.join(known.select("base", "name"), "base").groupBy("asked").agg(F.min("name").alias("name")))
    open_ = cut(open_.join(same, "asked", "left_anti"))
    sizes = F.explode(F.sequence(F.ceil(F.col("size") * least - 1e-9).cast("int"), F.floor(F.col("size") / least + 1e-9).cast("int")))
    met = open_.select("asked", F.col("base").alias("own"), F.col("size").alias("own_size"), sizes.alias("size")).join(known, "size")
    longest = F.greatest("own_size", "size", F.lit(1))
    far = F.expr(f"levenshtein(own, base, int(floor((1 - {least}) * greatest(own_size, size, 1) + 1e-9)))")
    close = met.withColumn("far", far).where("far >= 0").select("asked", (1 - F.col("far") / longest).alias("close"), "name").where(F.col("close") >= least)
    near = close.groupBy("asked").agg(F.min(F.struct((-F.col("close")).alias("c"), "name"))["name"].alias("name"))
    return asked.select("asked").join(exact.unionByName(same).unionByName(near), "asked", "left")


def nested_choice(points: DataFrame) -> DataFrame:
    """Per outer fold the setting with the best inner score (least share, then smallest setting on ties).

    points: outer, setting, score, share.
    """
    best = F.min(F.struct((-F.col("score")).alias("s"), "share", "setting"))
    return points.groupBy("outer").agg(best["setting"].alias("setting"), (-best["s"]).alias("score"))
