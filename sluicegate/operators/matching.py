"""Phrases, label tokens, stage settings, verdicts, resumed calls, and reports on classes and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.operators.joined import DataContractError
from sluicegate.operators.ranks import running
from sluicegate.operators.sizes import cut, small

#: Words that a class name's tokens leave out.
LABEL_STOP = ("of", "the", "and", "to", "a", "on", "for", "in", "by", "clause", "clauses", "provision", "provisions", "agreement", "u", "no")
#: The switches of the answering stages, in order, with the letters of their mask.
STAGES = (("contractmap", "m"), ("pretier0", "p"), ("tier0", "t"), ("tier0net", "n"), ("tier1", "j"), ("classifiers", "c"))


def occurrences(docs: DataFrame, forms: list[str], prefix: bool = False, text: str = "text") -> DataFrame:
    """(doc_id, form, at): every place where a form stands in the lower-cased text as whole words, or with prefix where a
    word begins with it; a neighbour that is a letter or digit is part of a word.  One pass of an automaton over a text
    finds all forms; forms is a bounded list.  Null texts have none."""
    known = sorted({f.lower() for f in forms if f})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for f in known:
            machine.add_word(f, f)
        machine.make_automaton()
        for b in batches:
            out = []
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column(text).to_pylist(), strict=True):
                low = (t or "").lower()
                for last, form in machine.iter(low) if known else ():
                    at = last - len(form) + 1
                    if (not at or not low[at - 1].isalnum()) and (prefix or last + 1 == len(low) or not low[last + 1].isalnum()):
                        out.append((doc, form, at))
            if out:
                doc, form, at = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, b.column("doc_id").type), pa.array(form), pa.array(at, pa.int32())], ["doc_id", "form", "at"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, form string, at int")


def label_tokens(name: Column) -> Column:
    """The content words of a class name, in the singular, sorted: without a prefix up to a colon, plural s after three
    letters goes, a last ies is y."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "^[a-z_]+:", ""), "_", " ")
    one = lambda t: F.regexp_replace(F.regexp_replace(t, "(?<=[a-z]{3})s$", ""), "ies$", "y")
    words = F.transform(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0)), one)
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*LABEL_STOP))))


def stage_mask(reader: Column) -> Column:
    """A short string of the stage switches (boolean columns of their names); the two newer stages show only when on."""
    on = lambda c: F.col(c).cast("int").cast("string")
    late = lambda c, letter: F.when(F.col(c), f" {letter}1").otherwise("")
    return F.concat(F.lit("p"), on("pretier0"), F.lit(" t"), on("tier0"), late("tier0net", "n"), F.lit(" j"), on("tier1"), F.lit(" c"), on("classifiers"), late("contractmap", "m"), F.lit(" r:"), reader)


def stage_problem(reader: Column) -> Column:
    """Why a combination of switches cannot be used: nothing_answers, classifiers_need_tier1, or null."""
    return F.when(~F.col("tier1") & (reader == "off"), "nothing_answers").when(F.col("classifiers") & ~F.col("tier1"), "classifiers_need_tier1")


def verdict(mean: Column, low: Column, published: Column, delta: float = 1.0, short: float = 3.0) -> Column:
    """match where the interval's lower end is within delta points of the published score, short where the mean lies over
    short points below it, else close; no_reference without a published score."""
    return F.when(published.isNull(), "no_reference").when(low >= published - delta / 100, "match").when((published - mean) * 100 > short, "short").otherwise("close")


def priced_frontier(df: DataFrame, cost: str, gain: str) -> DataFrame:
    """The rows of positive cost that no other one of at most their cost beats in gain; equal gains stay."""
    priced = df.where(F.col(cost) > 1e-9)
    best = running(cut(priced.groupBy(cost).agg(F.max(gain).alias("_g"))), cost, "_g", "max", "_before")
    return priced.join(small(best.select(cost, F.greatest("_g", "_before").alias("_most"))), cost).where(F.col(gain) >= F.col("_most")).select(df.columns)


def chosen_on_half(runs: DataFrame, setting: str, seed: str, score: str) -> DataFrame:
    """One row: the setting with the best mean score over the first half of the seeds (the smallest setting on ties), its
    mean and deviation over the others, and the mean of each of those seeds' best, which is optimistic."""
    half = runs.agg(F.floor((F.max(seed) + 1) / 2).alias("_half"))
    rows = runs.crossJoin(F.broadcast(half))
    early = rows.where(F.col(seed) < F.greatest(F.lit(1), F.col("_half")))
    late = rows.where(F.col(seed) >= F.greatest(F.lit(1), F.col("_half")))
    means = early.groupBy(setting).agg(F.avg(score).alias("_m"))
    pick = means.agg(F.min(F.struct((-F.round("_m", 12)).alias("m"), F.col(setting).alias("s")))["s"].alias("chosen"))
    ours = late.join(F.broadcast(pick), F.col(setting) == F.col("chosen")).groupBy("chosen").agg(F.avg(score).alias("score"), F.stddev_samp(score).alias("sd"))
    top = late.groupBy(seed).agg(F.max(score).alias("_top")).agg(F.avg("_top").alias("optimistic"))
    return ours.crossJoin(top).withColumn("bias", F.col("optimistic") - F.col("score"))


def resume(asked: DataFrame, done: DataFrame, failed: Column) -> DataFrame:
    """(item, sha, state): done items, those that share a text with a done one (copy), one call for each other text (call),
    and items that wait for that call (wait).  Failed rows are asked again; raises where a done item's text has changed.

    asked: item, sha; done: item, sha and what failed reads.
    """
    kept = cut(done.where(~failed).select("item", F.col("sha").alias("_sha")).distinct())
    if not asked.join(kept, "item").where(F.col("sha") != F.col("_sha")).isEmpty():
        raise DataContractError("the text of a done item has changed; refusing to resume")
    here = asked.join(kept.select("item", F.lit(True).alias("_done")), "item", "left")
    here = here.join(kept.select(F.col("_sha").alias("sha"), F.lit(True).alias("_known")).distinct(), "sha", "left")
    first = here.where("_done is null and _known is null").groupBy("sha").agg(F.min("item").alias("_first"))
    here = here.join(first, "sha", "left")
    state = F.when(F.col("_done"), "done").when(F.col("_known"), "copy").when(F.col("item") == F.col("_first"), "call").otherwise("wait")
    return here.select("item", "sha", state.alias("state"))


def label_f1(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(label, tp, fp, fn, f1) over rows of label sets; f1 is 0 where a label is never right."""
    one = lambda c, name: F.transform(c, lambda x: F.struct(x.alias("label"), F.lit(name).alias("k")))
    both = F.concat(one(F.array_intersect(gold, pred), "tp"), one(F.array_except(pred, gold), "fp"), one(F.array_except(gold, pred), "fn"))
    rows = df.select(F.inline(both)).groupBy("label").agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")))
    return rows.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def composed(df: DataFrame, whole: str, part: str, turn: str) -> DataFrame:
    """Share of turns that are right as a whole and in every part: over turns all of whose parts were scored (conditional),
    and over all turns, where an unscored part is wrong (unconditional)."""
    t = df.groupBy(turn).agg(F.bool_and(whole).alias("_w"), F.bool_and(F.col(part).isNotNull()).alias("_c"), F.bool_and(F.coalesce(F.col(part), F.lit(False))).alias("_p"))
    right = (F.col("_w") & F.col("_p")).cast("double")
    return t.agg(F.count_if("_c").alias("covered"), F.avg(F.when(F.col("_c"), right)).alias("conditional"), F.count(F.lit(1)).alias("turns"), F.avg(right).alias("unconditional"))


def advantage_spread(df: DataFrame, least: int = 10) -> DataFrame:
    """(classes, spread, free_wins): the range of expert less free accuracy over predicted classes of at least least rows,
    and how many of them the free arm wins."""
    a = F.avg(F.expr("int(expert_pred = gold) - int(free_pred = gold)"))
    per = df.groupBy("free_pred").agg(F.count(F.lit(1)).alias("n"), a.alias("adv")).where(F.col("n") >= least)
    return per.agg(F.count(F.lit(1)).alias("classes"), F.when(F.count(F.lit(1)) > 1, F.max("adv") - F.min("adv")).otherwise(0.0).alias("spread"), F.count_if(F.col("adv") < 0).alias("free_wins"))


def in_label_space(df: DataFrame, space: DataFrame, label: str, unknown: int = -1) -> DataFrame:
    """index: the label's place in the space (label, index), or unknown."""
    return df.join(small(space.select(F.col("label").alias(label), "index")), label, "left").withColumn("index", F.coalesce("index", F.lit(unknown)))


def answered(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Requests beside their responses; raises unless both have the same keys, each once."""
    for side, name in ((requests, "requests"), (responses, "responses")):
        if not side.groupBy(key).count().where("count > 1").isEmpty():
            raise DataContractError(f"{name} have a {key} twice")
    if not requests.select(key).exceptAll(responses.select(key)).isEmpty() or not responses.select(key).exceptAll(requests.select(key)).isEmpty():
        raise DataContractError(f"requests and responses differ in {key}")
    return requests.join(responses, key)


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, where no row shares its key with b; else raises."""
    if not a.select(key).intersect(b.select(key)).isEmpty():
        raise DataContractError(f"both sides have a {key}")
    return a
