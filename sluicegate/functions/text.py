"""Text functions as columns: normalization, labels, tokens, masking, markup, JSON answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

#: Characters that decorate a label, and prefixes before it.
_DECORATION = "*`\"'.:"
_PREFIXES = "label|sentiment|answer|category|class|intent"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squad_normalize(x: Column | str) -> Column:
    """Lower case, without ASCII punctuation and the articles a, an, the; single spaces."""
    y = F.regexp_replace(F.lower(_c(x)), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(y, r"\s+"), lambda w: ~w.isin("a", "an", "the", "")), " ")


def undecorate(x: Column | str) -> Column:
    """Trim white space and decoration characters from both ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"^[\s*`\"'.:]+", ""), r"[\s*`\"'.:]+$", "")


def normalize_label(x: Column | str) -> Column:
    """Lower case without decoration and a leading 'label:' or the like; words joined by one space."""
    y = F.regexp_replace(F.lower(undecorate(x)), rf"^({_PREFIXES})\s*[:=]\s*", "")
    return F.trim(F.regexp_replace(undecorate(y), r"[\s_-]+", " "))


def resolve_label(answer: Column | str, labels: list[str]) -> Column:
    """The label an answer names: exact, then without case, then undecorated, then normalized, then the only label that
    occurs as a whole word and is not negated; else null."""
    a = _c(answer)

    def only(test) -> Column:
        hits = F.array_compact(F.array(*(F.when(test(x), F.lit(x)) for x in labels)))
        return F.when(F.size(hits) == 1, hits[0])

    def word(x: str) -> Column:
        w = x.lower().replace(".", "[.]")
        return F.lower(a).rlike(rf"\b{w}\b") & ~F.lower(a).rlike(rf"\b(not|isn't|no)\s+(a |an |the )?{w}\b")

    steps = [lambda x: a == x, lambda x: F.lower(a) == x.lower(), lambda x: undecorate(F.lower(a)) == x.lower(), lambda x: normalize_label(a) == normalize_label(F.lit(x)), word]
    return F.coalesce(*(only(t) for t in steps))


def first_label(answer: Column | str, labels: list[str]) -> Column:
    """The whole-word label that occurs first, the longest on ties; null without any."""
    a = F.lower(_c(answer))
    found = F.array(*(F.struct(F.regexp_instr(a, F.lit(rf"\b{x.lower()}\b")).alias("at"), F.lit(-len(x)).alias("size"), F.lit(x).alias("label")) for x in labels))
    return F.array_min(F.filter(found, lambda f: f["at"] > 0))["label"]


def index_label(answer: Column | str, names: list[str]) -> Column:
    """A number as it is; else the index of the first name that the answer contains; -1 otherwise."""
    a = _c(answer)
    number = a.try_cast("int")
    steps = [F.when(F.contains(F.lower(a), F.lit(n.lower())), i) for i, n in enumerate(names)]
    return F.coalesce(F.when((number >= 0) & (number < len(names)), number), *steps, F.lit(-1))


def words(x: Column | str) -> Column:
    """Runs of a-z, 0-9 and the apostrophe, lower-cased."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(r"[a-z0-9']+"), F.lit(0))


def stems(x: Column | str, size: int = 7) -> Column:
    """Words cut after size characters."""
    return F.transform(words(x), lambda w: F.substring(w, 1, size))


def char_grams(x: Column | str, n: int) -> Column:
    """Character n-grams of the lower-cased text with single spaces, in order."""
    t = F.regexp_replace(F.lower(_c(x)), r"\s+", " ")
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def word_grams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def sentences(x: Column | str, least: int = 0) -> Column:
    """Split after . ! ? before white space, but not after common abbreviations; pieces under least characters join the
    one before."""
    parts = F.split(_c(x), r"(?<!\b(?:Mr|Mrs|Dr|No|Inc|Ltd|vs|Sec|Art)\.)(?<=[.!?])\s+")
    if not least:
        return parts

    def fold(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (F.length(p) < least), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, p)))).otherwise(F.concat(done, F.array(p)))

    return F.aggregate(parts, F.array().cast("array<string>"), fold)


def strip_markup(x: Column | str) -> Column:
    """Without scripts, styles and tags; the five common entities unescaped; single spaces."""
    y = F.regexp_replace(_c(x), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    y = F.regexp_replace(y, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        y = F.replace(y, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(y, r"\s+", " "))


#: Shapes of values that delexicalization replaces, with their slots.
SHAPES = (
    ("<email>", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("<url>", r"https?://[^\s]+"),
    ("<phone>", r"\+?\d[\d -]{7,}\d"),
    ("<number>", r"\d+(?:[.,]\d+)*"),
)


def delexicalize(x: Column | str) -> Column:
    """Values of known shapes become slots, longer shapes first."""
    y = _c(x)
    for slot, shape in SHAPES:
        y = F.regexp_replace(y, shape, slot)
    return y


def fill_slots(template: Column | str, values: Column) -> Column:
    """Replace {key} by the map's value; unknown slots stay."""
    return F.aggregate(F.map_entries(values), _c(template), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def numbers(x: Column | str) -> Column:
    """Numbers and money amounts as doubles."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda v: v.cast("double"))


def json_answer(x: Column | str) -> Column:
    """The first {...} of a text as map<string, string>; null where there is none or it isn't JSON."""
    return F.from_json(F.nullif(F.regexp_extract(_c(x), r"(?s)\{.*\}", 0), F.lit("")), "map<string,string>")


def field_equal(a: Column, b: Column) -> Column:
    """Typed equality of field texts: numbers by value, dates by their digits (6 or more), else normalized text."""
    na, nb = a.try_cast("double"), b.try_cast("double")
    da, db = F.regexp_replace(a, r"\D", ""), F.regexp_replace(b, r"\D", "")
    dates = (F.length(da) >= 6) & (F.length(db) >= 6) & a.rlike(r"^[\d/.\s-]+$") & b.rlike(r"^[\d/.\s-]+$")
    return F.when(na.isNotNull() & nb.isNotNull(), na == nb).when(dates, da == db).otherwise(squad_normalize(a) == squad_normalize(b))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets."""
    kinds = F.array_intersect(a, b)
    count = lambda xs, k: F.size(F.filter(xs, lambda x: x == k))
    same = F.aggregate(kinds, F.lit(0), lambda s, k: s + F.least(count(a, k), count(b, k)))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2 * same / total)


def grounded(clause: Column | str, answer: Column | str) -> Column:
    """Whether the normalized answer is a span of the normalized clause."""
    return F.instr(squad_normalize(clause), squad_normalize(answer)) > 0 if isinstance(answer, str) else F.contains(squad_normalize(clause), squad_normalize(answer))


def softmax(scores: Column, mask: Column) -> Column:
    """Softmax of an array where mask is true, 0 elsewhere; uniform where nothing is."""
    top = F.array_max(F.zip_with(scores, mask, lambda s, m: F.when(m, s)))
    raw = F.zip_with(scores, mask, lambda s, m: F.when(m, F.exp(s - top)).otherwise(0.0))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(F.transform(scores, lambda x: F.lit(1.0) / F.size(scores)))


def argmax(xs: Column) -> Column:
    """0-based index of the greatest element, the lowest on ties."""
    return F.array_position(xs, F.array_max(xs)).cast("int") - 1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2_normalize(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def entropy(counts: Column) -> Column:
    """Bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log2(x / total)).otherwise(0.0))


def plain(x: Column | str) -> Column:
    """The compatibility form (NFKC) in lower case, with anything but a-z, 0-9 and space as a space, spaces joined."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    x = _c(x)
    # the form leaves ASCII as it is, so only other texts go through Python
    text = F.when(F.length(x) == F.octet_length(x), x).otherwise(form(x))
    text = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))
