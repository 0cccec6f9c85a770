"""Defined terms, what their definitions rest on, their expansion, and cross references of documents.

Statements are (doc_id, stmt, text).  Null texts have no terms and no references.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluicegate.operators.documents import resolve_sections
from sluicegate.operators.sizes import cut

_QUOTE = "[\"“”]"
_TERM = r"[A-Z][\w&’' -]{0,60}?"
#: The words that define, and those that stand before a term in brackets.
_MEANS = rf"{_QUOTE}({_TERM}){_QUOTE},?\s+(?:(?:shall|will)\s+)?(?:means?|refers?\s+to|includes?|is\s+defined\s+as|has\s+the\s+meaning|consists?\s+of)\b"
_BRACKET = rf"([^()]*)\((?:(?:the|collectively,?|each,?\s+an?|hereinafter|referred\s+to\s+as|called)\s+)*{_QUOTE}({_TERM}){_QUOTE}\)"
#: Characters before a bracket that count as the definition.
BEFORE = 300
#: Terms and links of a document that one task expands; those of larger documents are exchanged in rounds.
AT_ONCE = 500_000

_NUMBER = r"\d+(?:\.\d+)*(?:\s*\([a-zA-Z0-9]{1,4}\))*|[IVXLC]+\b"
_SECTION = rf"\b(?:Sections?|Articles?|Clauses?|Paragraphs?)\s+({_NUMBER})(?:\s+of\s+(?!this\b)(?:the\s+|that\s+certain\s+)?((?:[A-Z][\w&.-]*\s*)+))?"
_LABEL = r"(?:\d+|[A-Z0-9]{1,3})"  # numbers of any length
_ATTACHED = rf"\b(Exhibit|Schedule|Annex|Appendix|Attachment|Addendum)\s+({_LABEL}(?:[.-]{_LABEL})?)\b"


def definitions(statements: DataFrame) -> DataFrame:
    """(doc_id, term, stmt, body): terms that a statement defines by a verb (body: the statement), or names in brackets
    (body: up to 300 characters before them).  A term may have several bodies."""
    said = F.transform(F.regexp_extract_all("text", F.lit(_MEANS), F.lit(1)), lambda t: F.struct(t.alias("term"), F.col("text").alias("body")))
    names, before = (F.regexp_extract_all("text", F.lit(_BRACKET), F.lit(i)) for i in (2, 1))
    named = F.zip_with(names, before, lambda t, b: F.struct(t.alias("term"), F.trim(F.right(b, F.lit(BEFORE))).alias("body")))
    rows = statements.select("doc_id", "stmt", F.explode(F.array_distinct(F.concat(said, named))).alias("d"))
    return rows.select("doc_id", F.trim("d.term").alias("term"), "stmt", "d.body")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\w&’']+(?:-[\w&’']+)*"), F.lit(0))


def term_references(defined: DataFrame) -> DataFrame:
    """(doc_id, term, used): the other defined terms of the document that a term's definitions name, as whole words.

    Definitions are cut into runs of as many words as the longest term has, at capitals only, and those meet the terms in
    one equi-join; no term is looked for in every definition.  Both sides are exchanged: terms grow with the input, and a
    broadcast, which their estimated size may ask for, would pass them through the driver.
    """
    terms = defined.select("doc_id", "term").distinct().withColumn("words", _words(F.col("term")))
    longest = terms.agg(F.max(F.size("words"))).first()[0] or 0
    if not longest:
        return defined.select("doc_id", "term", F.col("term").alias("used")).limit(0)
    w = _words(F.col("body"))
    runs = defined.select("doc_id", "term", w.alias("w")).select("doc_id", "term", "w", F.posexplode("w").alias("at", "first")).where(F.col("first").rlike("^[A-Z]"))
    run = F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ")
    runs = runs.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - F.col("at")))))
    runs = runs.select("doc_id", "term", run.alias("run")).distinct()
    keys = terms.select("doc_id", F.array_join("words", " ").alias("run"), F.col("term").alias("used"))
    return runs.join(keys.hint("merge"), ["doc_id", "run"]).where("term <> used").select("doc_id", "term", "used").distinct()


def closure(links: DataFrame) -> DataFrame:
    """(doc_id, term, used, depth): all that a term rests on, over any number of links, with the least number of them.

    A round goes on from the pairs first met in the round before, until none is new, so cycles end.
    """
    links = cut(links.select("doc_id", "term", "used").distinct())
    front = seen = cut(links.withColumn("depth", F.lit(1)))
    step = links.select("doc_id", F.col("term").alias("used"), F.col("used").alias("next"))
    depth = 1
    while True:
        depth += 1
        met = front.join(step, ["doc_id", "used"]).select("doc_id", "term", F.col("next").alias("used")).distinct()
        front = cut(met.join(seen, ["doc_id", "term", "used"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)


def _groups(links: list[list[int]]) -> Iterator[list[int]]:
    """Nodes that reach each other, group by group; a group comes after all those that it leads to."""
    seen, low, held, path = [0] * len(links), [0] * len(links), [False] * len(links), []
    count = 0
    for root in range(len(links)):
        work = [] if seen[root] else [(root, 0)]
        while work:
            x, at = work.pop()
            if not at:
                count += 1
                seen[x] = low[x] = count
                path.append(x)
                held[x] = True
            elif held[y := links[x][at - 1]]:
                low[x] = min(low[x], low[y])
            while at < len(links[x]) and seen[y := links[x][at]]:
                if held[y]:
                    low[x] = min(low[x], seen[y])
                at += 1
            if at < len(links[x]):
                work += [(x, at + 1), (links[x][at], 0)]
            elif low[x] == seen[x]:
                group = []
                while not group or group[-1] != x:
                    group.append(path.pop())
                    held[group[-1]] = False
                yield group


def _by_document(limit: int | None):
    """Rows (doc_id, term, body, used), sorted by document, to the expansions of each document's terms.  A row has a term's
    body or a link of it."""
    names = ["doc_id", "term", "text", "depth", "n_used", "cyclic"]

    def settled(doc, body: dict[str, str], uses: dict[str, list[str]]) -> Iterator[tuple]:
        terms = sorted(body)
        place = {t: i for i, t in enumerate(terms)}
        links = [sorted((place[u] for u in uses.get(t, ())), key=lambda i: terms[i].encode()) for t in terms]
        said, depth, group_of = [""] * len(terms), [0] * len(terms), [-1] * len(terms)
        for n, group in enumerate(_groups(links)):
            reach, front = set(), group
            while front:
                front = {y for x in front for y in links[x]} - reach
                reach |= front
            for x in group:
                group_of[x] = n
            for x in group:
                back = [y for y in links[x] if group_of[y] == n]
                depth[x] = max((depth[y] + 1 for y in links[x] if group_of[y] != n), default=0)
                parts = ((y, f"see {terms[y]}" if group_of[y] == n else said[y]) for y in links[x])
                text = body[terms[x]] + "".join(f" [{terms[y]}: {t[:limit]}]" for y, t in parts)
                said[x] = text[:limit]
                yield doc, terms[x], text, depth[x], len(reach - {x}), [terms[y] for y in back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            at, body, uses = None, {}, {}
            for b in batches:
                for doc, term, own, used in zip(*(b.column(c).to_pylist() for c in ("doc_id", "term", "body", "used")), strict=True):
                    if doc != at:
                        yield from settled(at, body, uses)
                        at, body, uses = doc, {}, {}
                    if used is None:
                        body[term] = own
                    else:
                        uses.setdefault(term, []).append(used)
            yield from settled(at, body, uses)

        out = []

        def batch(kind: pa.DataType) -> pa.RecordBatch:
            kinds = [kind, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("doc_id").type
        for row in rows(itertools.chain([first], batches)):
            out.append(row)
            if len(out) == 4096:
                yield batch(kind)
                out = []
        if out:
            yield batch(kind)

    return run


def expanded(defined: DataFrame, limit: int | None = 600, bodies: int = 2) -> DataFrame:
    """(doc_id, term, text, depth, n_used, cyclic): each term's definition (its first bodies, joined) with " [Used: ...]"
    behind it for each term that it names, in the order of their names; what stands there is that term's own expansion,
    cut to limit characters.

    A term whose link leads back to it is not expanded there but named: " [Used: see Used]"; cyclic lists such terms.
    depth is the longest chain of links that were followed, n_used all terms that it rests on.  Terms and links are exchanged
    once, by document, and a task expands one whole document at a time, each term after those that it names; documents of
    more than AT_ONCE terms and links are expanded by ``exchanged``.
    """
    order = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("stmt", "body"))), 1, bodies), lambda x: x["body"])
    defined = cut(defined.where("doc_id IS NOT NULL"))
    base = defined.groupBy("doc_id", "term").agg(F.array_join(order, " ").alias("body"))
    links = term_references(defined)
    rows = cut(base.withColumn("used", F.lit(None).cast("string")).unionByName(links, allowMissingColumns=True))
    apart = cut(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > AT_ONCE).select("doc_id"))
    large = not apart.isEmpty()
    most = rows.join(apart, "doc_id", "left_anti") if large else rows
    kind = defined.schema["doc_id"].dataType.simpleString()
    out = most.repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", "term", "body", "used").mapInArrow(_by_document(limit), f"doc_id {kind}, term string, text string, depth int, n_used long, cyclic array<string>")
    if not large:
        return out
    rest = rows.join(apart, "doc_id", "left_semi")
    return out.unionByName(exchanged(rest.where("used IS NULL").drop("used"), rest.where("used IS NOT NULL").drop("body"), limit))


def exchanged(base: DataFrame, links: DataFrame, limit: int | None) -> DataFrame:
    """``expanded`` from (doc_id, term, body) and (doc_id, term, used) in rounds, each with all its terms' expansions at hand,
    until all are done; rounds follow the longest chain."""
    base, links = cut(base), cut(links)
    reach = cut(closure(links))
    back = reach.select("doc_id", F.col("term").alias("used"), F.col("used").alias("term")).withColumn("back", F.lit(True))
    links = cut(links.join(back, ["doc_id", "term", "used"], "left").na.fill(False, ["back"]))
    follow = links.where("NOT back").select("doc_id", "term", "used")
    open_ = cut(base.join(follow.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_semi").select("doc_id", "term"))
    part = F.struct("used", F.col("said").substr(F.lit(1), F.lit(limit if limit is not None else 2**31 - 1)).alias("said"))

    def told(ready: DataFrame, done: DataFrame | None, depth: int) -> DataFrame:
        """The expansions of ready terms from those that are done."""
        own = links.join(ready, ["doc_id", "term"])
        named = own.where("back").select("doc_id", "term", "used", F.concat(F.lit("see "), "used").alias("said"), F.lit(True).alias("back"))
        if done is not None:
            named = named.unionByName(own.where("NOT back").select("doc_id", "term", "used").join(done.select("doc_id", F.col("term").alias("used"), F.col("text").alias("said")), ["doc_id", "used"]).select("doc_id", "term", "used", "said", F.lit(False).alias("back")))
        parts = named.groupBy("doc_id", "term").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.array_sort(F.collect_list(F.when(F.col("back"), F.col("used")))).alias("cyclic"))
        text = F.concat("body", F.coalesce(F.array_join(F.transform("parts", lambda p: F.concat(F.lit(" ["), p["used"], F.lit(": "), p["said"], F.lit("]"))), ""), F.lit("")))
        rows = base.join(ready, ["doc_id", "term"]).join(parts, ["doc_id", "term"], "left")
        return cut(rows.select("doc_id", "term", text.alias("text"), F.lit(depth).alias("depth"), F.coalesce("cyclic", F.array().cast("array<string>")).alias("cyclic")))

    done = told(base.select("doc_id", "term").join(open_, ["doc_id", "term"], "left_anti"), None, 0)
    depth = 0
    while not open_.isEmpty():  # links that lead back are not followed, so what is left always has a term that is ready
        depth += 1
        waits = follow.join(open_.withColumnRenamed("term", "used"), ["doc_id", "used"], "left_semi").select("doc_id", "term").distinct()
        ready = cut(open_.join(waits, ["doc_id", "term"], "left_anti"))
        done = done.unionByName(told(ready, done, depth))
        done = cut(done) if depth % 8 == 0 else done
        open_ = cut(open_.join(ready, ["doc_id", "term"], "left_anti"))
    n = reach.where("term <> used").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n_used"))
    return done.join(n, ["doc_id", "term"], "left").na.fill(0, ["n_used"]).select("doc_id", "term", "text", "depth", "n_used", "cyclic")


def cross_references(statements: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, stmt, n, kind, label, target): references in the order of the text within each kind.

    kind section: target is the longest prefix of the number that is a section (doc_id, label) of the document, null without
    one; kind document-section: a section of a document that is named; kind attachment: target is the label if a statement
    begins with it.  Statements with equal text and place are told apart by stmt.
    """
    numbers, of = (F.regexp_extract_all("text", F.lit(_SECTION), F.lit(i)) for i in (1, 2))
    found = statements.select("doc_id", "stmt", F.posexplode(F.arrays_zip(numbers.alias("number"), of.alias("of"))).alias("n", "r"))
    label, name = F.regexp_replace("r.number", r"\s+", ""), F.regexp_replace("r.of", r"[\s.]+$", "")
    found = found.select("doc_id", "stmt", "n", F.when(name != "", F.concat(label, F.lit(" of "), name)).otherwise(label).alias("label"), F.when(name != "", "document-section").otherwise("section").alias("kind"))
    asked = found.where("kind = 'section'").select("doc_id", F.col("label").alias("ref")).distinct()
    known = resolve_sections(asked, sections).select("doc_id", F.col("ref").alias("label"), F.col("section").alias("target")).withColumn("kind", F.lit("section"))
    found = found.join(known, ["doc_id", "label", "kind"], "left")
    what, which = (F.regexp_extract_all("text", F.lit(_ATTACHED), F.lit(i)) for i in (1, 2))
    attached = statements.select("doc_id", "stmt", F.posexplode(F.zip_with(what, which, lambda a, b: F.concat(a, F.lit(" "), b))).alias("n", "label"))
    heads = statements.select("doc_id", F.initcap(F.regexp_extract("text", rf"(?i)^\s*{_ATTACHED[2:]}", 1)).alias("a"), F.regexp_extract("text", rf"(?i)^\s*{_ATTACHED[2:]}", 2).alias("b")).where("a <> ''")
    heads = heads.select("doc_id", F.concat("a", F.lit(" "), F.upper("b")).alias("label")).distinct().withColumn("target", F.col("label"))
    attached = attached.join(heads, ["doc_id", "label"], "left").withColumn("kind", F.lit("attachment"))
    return found.select("doc_id", "stmt", "n", "kind", "label", "target").unionByName(attached.select("doc_id", "stmt", "n", "kind", "label", "target"))
