"""Operator 7, quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text (characters, words, lines, repetition) are binned; trees of fixed depth grow level by
level from gradient histograms and are stored as flat arrays (feature, threshold, leaf), which numpy walks for all
documents and trees at once.  Training rows are a sample of at most ``sample_rows`` labelled documents, those with the
smallest hash of doc_id, each with one text; that bound is a parameter.  Scoring covers every document.

Defined results: a null text counts as empty and gets the score of an empty one; labels that are null or not 0/1 don't
count; several labels of one document count as their smallest; without labels of both kinds the score is the share of
label 1, or 0.5 without any label; rows with null doc_id are scored and are not held out; repeated rows are scored as
often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicegate.llm.common import Words, crc_mod, steps

FEATURES = (
    "chars", "words", "lines", "word_length", "longest_word", "letter_share", "digit_share", "mark_share", "upper_share",
    "symbol_share", "exclamation_share", "bar_share", "line_words", "type_share", "top_word_share", "repeated_line_share",
    "worded_share", "marked_word_share", "upper_word_share", "short_word_share", "repeated_pair_share", "distinct_bytes",
)

_CLASS = {
    "continued": [*range(128, 192)],
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "digit": [*range(48, 58)],
    "upper": [*range(65, 91)],
    "mark": [c for c in range(33, 127) if not chr(c).isalnum()],
    "symbol": [ord(c) for c in "#$%&*@^~=+<>{}[]\\_"],
    "exclamation": [ord("!")],
    "bar": [ord("|")],
    "line": [10],
}
_TABLE = {k: np.isin(np.arange(256), v) for k, v in _CLASS.items()}


def _repeats(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the most frequent value's count."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))  # a step has under 2**24 rows
    r = (key >> np.uint64(40)).astype(np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(r)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[at], counts)
    return np.bincount(r[at], minlength=n), top


def statistics(column: pa.Array) -> np.ndarray:
    """FEATURES of each text, a row each."""
    w = Words(column)
    n = len(w.offsets) - 1
    size = np.diff(w.offsets)

    def total(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[w.offsets]).astype(np.float64)

    have = {k: total(t[w.data]) for k, t in _TABLE.items()}
    chars = size - have["continued"]
    words = np.diff(w.first).astype(np.float64)
    per = np.maximum(size, 1)
    each = np.maximum(words, 1)
    length = (w.end - w.start).astype(np.float64)
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    by_word = lambda flags: np.bincount(w.doc, flags, n) / each
    letters = np.concatenate([[0], np.cumsum(_TABLE["letter"][w.data], dtype=np.int32)])
    uppers = np.concatenate([[0], np.cumsum(_TABLE["upper"][w.data], dtype=np.int32)])
    in_word = letters[w.end] - letters[w.start]
    hashes = w.hashes()
    types, top = _repeats(w.doc, hashes, n)
    pair = (hashes[:-1] * np.uint64(3) + hashes[1:])[w.doc[:-1] == w.doc[1:]] if len(hashes) else hashes
    pair_row = w.doc[:-1][w.doc[:-1] == w.doc[1:]]
    pair_types, _ = _repeats(pair_row, pair, n)
    pairs = np.bincount(pair_row, minlength=n)
    # a line is the run of words up to the next line feed: its number grows with the line feeds before the word
    feeds = np.cumsum(_TABLE["line"][w.data], dtype=np.int64)[w.start] if len(w) else np.zeros(0, np.int64)
    line_start = np.ones(len(w), bool)
    line_start[1:] = (feeds[1:] != feeds[:-1]) | (w.doc[1:] != w.doc[:-1])
    at = np.flatnonzero(line_start)
    line_hash = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, len(hashes)))).astype(np.uint64) + np.uint64(1)), at) if len(at) else np.zeros(0, np.uint64)
    lines = np.bincount(w.doc[at], minlength=n).astype(np.float64)
    line_types, _ = _repeats(w.doc[at], line_hash, n)
    seen = np.zeros((n, 256), bool)
    seen[np.repeat(np.arange(n), size), w.data] = True
    return np.column_stack([
        chars, words, lines, length_mean(w, length, n, each), longest, have["letter"] / per, have["digit"] / per, have["mark"] / per,
        have["upper"] / per, have["symbol"] / per, have["exclamation"] / per, have["bar"] / per, words / np.maximum(lines, 1), types / each,
        top / each, 1 - line_types / np.maximum(lines, 1), by_word(in_word > 0), by_word(in_word < length), by_word((in_word > 0) & (uppers[w.end] - uppers[w.start] == in_word)),
        by_word(length <= 3), 1 - pair_types / np.maximum(pairs, 1), seen.sum(1),
    ])


def length_mean(w: Words, length: np.ndarray, n: int, each: np.ndarray) -> np.ndarray:
    return np.bincount(w.doc, length, n) / each


@dataclass
class Trees:
    """Trees of one depth as flat arrays: feature and threshold [tree, inner node], leaf [tree, leaf]."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of each row of x."""
        margin = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if trees and len(x):
            t = np.arange(trees)
            for at in range(0, len(x), 4096):
                rows = x[at : at + 4096]
                node = np.zeros((len(rows), trees), np.int64)
                r = np.arange(len(rows))[:, None]
                while node[0, 0] < inner:
                    node = 2 * node + 1 + (rows[r, self.feature[t, node]] > self.threshold[t, node])
                margin[at : at + 4096] += self.leaf[t, node - inner].sum(1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0, least: float = 2.0) -> Trees:
    """Boost trees on the logistic loss; splits come from histograms of gradients over quantile bins."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(float(np.log(share / (1 - share))), np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    k = x.shape[1]
    flat = binned + np.arange(k) * bins
    inner = (1 << depth) - 1
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            cell = ((node - first)[:, None] * (k * bins) + flat).reshape(-1)
            hist = lambda v, cell=cell, width=width: np.cumsum(np.bincount(cell, np.repeat(v, k), width * k * bins).reshape(width, k, bins), 2)
            gl, hl = hist(g), hist(h)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            won = gain.reshape(width, -1).max(1) > 1e-9
            f, b = best // bins, best % bins
            cut = np.array([edges[i][j] if w and j < len(edges[i]) else np.inf for i, j, w in zip(f, b, won, strict=True)])
            feature[t, first : first + width], threshold[t, first : first + width] = f, cut
            here = node - first
            node = 2 * node + 1 + (x[np.arange(len(y)), f[here]] > cut[here])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + penalty)
        margin += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 30_000, folds: int = 5, held: int = 0, **options) -> Trees:
    """Fit on at most sample_rows labelled documents outside the held-out fold."""
    ids = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
    ids = ids.groupBy("doc_id").agg(F.min("quality").cast("double").alias("_y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    schema = "doc_id long, y double, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            x = statistics(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_y"), lists], ["doc_id", "y", "x"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    # of rows that share a doc_id, the text with the least hash
    found = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_y").alias("_y"))
    got = found.mapInArrow(run, schema).toPandas()  # sample_rows at most
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    order = np.lexsort((x[:, 0], got["doc_id"].to_numpy()))
    return fit(x[order], got["y"].to_numpy()[order], **options)


def score(docs: DataFrame, model: Trees, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns keep, score (P of label 1) and predicted (1 if score >= threshold)."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double, predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            s = model.score(statistics(b.column(text)))
            out = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], [*keep, "score", "predicted"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Trees, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that the classifier predicts as 1, with all their columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text):
            yield b.filter(pa.array(model.score(statistics(b.column(text))) >= threshold))

    return docs.mapInArrow(run, schema)
