"""Operator 4, token counts that follow edits: a segment tree over the pre-tokens of each document.

A leaf is a pre-token with its characters and token count; inner nodes hold sums.  An edit re-encodes only the
pre-tokens that it touches, with the context that their boundaries can depend on: a pre-token stays if it and the next
two characters lie before the edit, and scanning stops at the first new boundary after the edit that is an old boundary
too, as matching onwards depends on nothing before it.  The new counts go into the first leaf touched, the others
become empty, and the sums above are renewed.

Defined results: a null text counts as empty; null edits mean none; positions are clipped to the text, null parts of an
edit count as 0 or empty; a text that holds a literal added token, before or after an edit, is counted anew as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicegate.llm.bpe import Encoder, encoder, texts_of
from sluicegate.llm.common import steps


class TokenTree:
    """A document, its pre-token leaves and sums over them.

    Edits change characters at once and note the pre-tokens to encode; settle() encodes them and renews the counts, so
    that the new pre-tokens of many documents can be encoded together.
    """

    def __init__(self, text: str, own: Encoder, tokens: list[str] | None = None):
        self.own, self.text, self.encoded = own, text, 0
        self._build(own.pretokens(text) if tokens is None else tokens)
        if tokens is None:
            self.settle()

    def _build(self, tokens: list[str]) -> None:
        """Leaves of the tokens; their counts come with settle()."""
        self.n = n = 1 << max(0, (len(tokens) - 1)).bit_length()
        self.chars = np.zeros(2 * n, np.int64)
        self.chars[n : n + len(tokens)] = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.counts, self.tokens, self.slots = None, tokens, {}
        self._sum(self.chars)

    def _sum(self, a: np.ndarray) -> None:
        at = self.n
        while at > 1:
            a[at // 2 : at] = a[at : 2 * at : 2] + a[at + 1 : 2 * at : 2]
            at //= 2

    def wanted(self) -> set[str]:
        """Pre-tokens whose counts settle() needs."""
        return set(self.tokens or ()).union(*(tokens for tokens, _ in self.slots.values()))

    def settle(self, known: dict[str, bytes] | None = None) -> None:
        """Renew the counts; known: the ids of all pre-tokens wanted, where the caller has them."""
        known = self.own.known(self.wanted()) if known is None else known
        if self.tokens is not None:
            self.counts = np.zeros(2 * self.n, np.int64)
            lengths = np.fromiter(map(len, map(known.__getitem__, self.tokens)), np.int64, len(self.tokens))
            self.counts[self.n : self.n + len(self.tokens)] = lengths >> 2
            self._sum(self.counts)
            self.tokens = None
        for leaf, (tokens, kept) in self.slots.items():
            count = sum(len(known[t]) >> 2 for t in tokens)
            for old in kept:
                count += int(self.counts[old + self.n])
            self._add(self.counts, leaf, count - int(self.counts[leaf + self.n]))
        self.slots = {}

    def _add(self, a: np.ndarray, leaf: int, change: int) -> None:
        node = leaf + self.n
        while node and change:
            a[node] += change
            node //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.counts[1])

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and the leaf's first position."""
        node, start = 1, 0
        while node < self.n:
            node *= 2
            here = int(self.chars[node])
            if position >= start + here:
                start += here
                node += 1
        return node - self.n, start

    def _has_added(self, text: str) -> bool:
        return any(a in text for a in self.own.added)

    def edit(self, position: int, removed: int, inserted: str) -> None:
        """Replace removed characters at position by inserted; counts follow."""
        old = self.text
        position = min(max(position, 0), len(old))
        removed = min(max(removed, 0), len(old) - position)
        self.text = new = old[:position] + inserted + old[position + removed :]
        if self._has_added(old) or self._has_added(new):
            self._anew()
            return
        if not old:
            tokens = self.own.pretokens(new)
            self._build(tokens)
            self.encoded += len(tokens)
            return
        # the first leaf whose end, with two characters more, reaches the edit; find() passes over empty leaves
        first, start = self.find(max(0, position - 2))
        while start and start + int(self.chars[first + self.n]) + 2 > position:
            before, at = self.find(start - 1)
            if at + int(self.chars[before + self.n]) + 2 <= position:
                break
            first, start = before, at
        shift = len(inserted) - removed
        until, found, stop = position + len(inserted), [], None
        for m in self.own.pattern.finditer(new, start):
            if m.start() >= until and m.start() - shift >= position + removed:
                leaf, at = self.find(m.start() - shift)
                if at == m.start() - shift:
                    stop = leaf
                    break
            found.append(m.group())
        last = self.n if stop is None else stop
        self.encoded += len(found)
        for leaf in np.flatnonzero(self.chars[self.n + first + 1 : self.n + last]).tolist():
            self._put(first + 1 + leaf, 0, [], [])
        if first == stop:  # new pre-tokens go before this leaf, which stays
            tokens, kept = self.slots.get(first, ([], [first]))
            self._put(first, sum(map(len, found)) + int(self.chars[first + self.n]), found + tokens, kept)
        else:
            self._put(first, sum(map(len, found)), found, [])

    def _put(self, leaf: int, chars: int, tokens: list[str], kept: list[int]) -> None:
        self._add(self.chars, leaf, chars - int(self.chars[leaf + self.n]))
        self.slots[leaf] = tokens, kept

    def _anew(self) -> None:
        tokens = self.own.pretokens(self.text)
        self.encoded += len(tokens)
        if self._has_added(self.text):
            self.n, self.chars, self.tokens, self.slots = 1, np.array([0, len(self.text)]), None, {}
            self.counts = np.array([0, len(self.own.encode([self.text])[0]) >> 2])
        else:
            self._build(tokens)


def recount(docs: DataFrame, vocab_path: str, edits: str = "edits", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Token counts of each whole text before and after its edits.

    edits: array<struct<at: int, removed: int, inserted: string>>, applied in order to the text as it then is.
    Returns keep, n_tokens, edited_n_tokens, n_pretokens and n_reencoded (pre-tokens encoded for the edits).
    """
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long, edited_n_tokens long, n_pretokens long, n_reencoded long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab_path)
        for b in steps(batches, text):
            texts = texts_of(b.column(text))
            tokens = [own.pretokens(t) for t in texts]
            known = own.known(set().union(*tokens))
            trees, before = [], []
            for t, found in zip(texts, tokens, strict=True):
                tree = TokenTree(t, own, found)
                if tree._has_added(t):
                    tree._anew()
                    tree.encoded = 0
                tree.settle(known)
                trees.append(tree)
                before.append(tree.n_tokens)
            for tree, changes in zip(trees, b.column(edits).to_pylist(), strict=True):
                for e in changes or []:
                    if e is not None:
                        tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
            known = own.known(set().union(*(tree.wanted() for tree in trees)))
            rows = []
            for tree, n, found in zip(trees, before, tokens, strict=True):
                tree.settle(known)
                rows.append((n, tree.n_tokens, len(found), tree.encoded))
            out = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], [*keep, "n_tokens", "edited_n_tokens", "n_pretokens", "n_reencoded"])

    return docs.select(*keep, text, edits).mapInArrow(run, schema)


def three_edits(text: str = "text"):
    """Edits drawn from the text itself: at a quarter 32 characters go, at half the first 24 come in again, at three
    quarters 16 are reversed (positions as the text is before the first edit)."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    one = lambda at, removed, inserted: F.struct(at.cast("int").alias("at"), F.lit(removed).alias("removed"), inserted.alias("inserted"))
    q = F.floor(n * 3 / 4)
    return F.array(one(q, 16, F.reverse(F.substring(t, q.cast("int") + 1, F.lit(16)))), one(F.floor(n / 2), 0, F.substring(t, 1, 24)), one(F.floor(n / 4), 32, F.lit("")))
