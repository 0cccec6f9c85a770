"""Operator 9, LM scoring: subword lattice likelihood.

The pieces of an existing subword vocabulary weight all segmentations of a word; a forward recursion in log space over
the word's bytes returns its marginal probability.  No piece crosses white space, so the lattice of a document falls
apart into those of its words and the document's log probability is the sum over them.

Weights: pieces that begin a word ("start") and pieces within it, the byte pieces and a stop ("inner") each form a
distribution.  They begin from the vocabulary's own scores (as 1 / (1 - score)) and are fitted to the training words, one
vote for each distinct word, by forward-backward expectation on the executors.  Words of the training documents extend
the vocabulary: P(word) = max(c - d, 0) / N + d V / N * lattice(word), with c, V, N words, distinct words and tokens of
training and d from the counts of counts; the end token has c / N.

A document is a mixture over the languages of the training documents (the ``languages`` most frequent values of lang and
one rest; a single one without such a column): each has counts and weights of its own, and the score is the log of the
weighted sum.  lang is read in training only, never of a document that is scored.  All these sum to at most 1.

Counts cover all training documents.  The most frequent words (``top_words``, a documented bound) are broadcast to
shorten the exchange; every other word occurrence meets its scores in a join on the word's hash.

Defined results: a null or empty text is the end token alone; without training documents the scores are those of the
lattice with the vocabulary's own weights, words and the end having 1/2 each; rows with null doc_id are training rows;
repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluicegate.llm.common import Words, crc_mod, mix, steps, table

#: Most frequent words that every executor holds.
TOP_WORDS = 200_000
#: Bytes of text in a step: a word is counted once for each step, so larger steps than usual send fewer rows.
STEP = 4 << 20
#: Words in one lattice step, and bytes of them.
LATTICE_WORDS, LATTICE_BYTES = 20_000, 200_000

_U = np.uint64
_BUCKET_BITS = 18
_MARK = ord(" ")  # stands for the vocabulary's word mark; no word holds it
_MULTIPLY = _U(0x2545F4914F6CDD1D)


@dataclass
class Pieces:
    """Pieces as sorted hashes of their bytes and of their prefixes.  Logs are natural."""

    key: np.ndarray
    piece: np.ndarray  # index into the weights, -1: a prefix only
    longest: int
    first: np.ndarray  # piece begins with the word mark
    byte: np.ndarray  # weights' index of each byte piece
    start: np.ndarray  # log weights [component, piece]; -inf where the piece can't stand
    inner: np.ndarray
    stop: np.ndarray  # [component]
    bucket: np.ndarray = None  # first key of each value of the leading bits

    @classmethod
    def load(cls, path: str, components: int = 1) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names, scores, byte = [], [], np.full(256, -1, np.int64)
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte[int(model.id_to_piece(i)[1:-1], 16)] = len(names)
                names.append(None)
                scores.append(model.get_score(i))
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = model.id_to_piece(i).replace("▁", " ").encode()
                if b" " not in raw[1:]:
                    names.append(raw)
                    scores.append(model.get_score(i))
        for b in np.flatnonzero(byte < 0):
            byte[b] = len(names)
            names.append(None)
            scores.append(min(scores))
        table_: dict[int, int] = {}
        for i, raw in enumerate(names):
            if raw is None:
                continue
            h = _U(0)
            with np.errstate(over="ignore"):
                for at, b in enumerate(raw):
                    h = h * _MULTIPLY + _U(b + 1)
                    k = int(mix(np.array([h]))[0])
                    table_[k] = i if at == len(raw) - 1 else table_.get(k, -1)
        key = np.array(sorted(table_), np.uint64)
        first = np.array([raw is not None and raw[0] == _MARK for raw in names])
        weight = 1 / (1 - np.array(scores, float))
        none = np.zeros((components, len(names)))
        out = cls(key, np.array([table_[int(k)] for k in key]), max(len(r) for r in names if r), first, byte, none, none, none[:, 0])
        out.bucket = np.searchsorted(key, np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << _U(64 - _BUCKET_BITS))
        out.bucket = np.append(out.bucket, len(key))
        out.weigh(none + np.where(first, weight, 0), none + np.where(first, 0, weight), none[:, 0] + weight[~first].sum() / 4)
        return out

    def weigh(self, start: np.ndarray, inner: np.ndarray, stop: np.ndarray, floor: float = 0.01) -> None:
        """Weights from counts; every piece keeps a small share where it can stand."""
        start, inner, stop = np.where(self.first, start + floor, 0), np.where(self.first, 0, inner + floor), stop + floor
        total = inner.sum(1) + stop
        with np.errstate(divide="ignore"):
            self.start, self.inner = np.log(start / start.sum(1)[:, None]), np.log(inner / total[:, None])
        self.stop = np.log(stop / total)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1: the keys with the same leading bits follow each other."""
        bucket = (k >> _U(64 - _BUCKET_BITS)).astype(np.int64)
        out = np.full(len(k), -1)
        i, end, open_ = self.bucket[bucket], self.bucket[bucket + 1], np.arange(len(k))
        while True:
            more = i < end
            i, end, open_ = i[more], end[more], open_[more]
            if not len(i):
                return out
            hit = self.key[i] == k[open_]
            out[open_[hit]] = i[hit]
            i, end, open_ = i[~hit] + 1, end[~hit], open_[~hit]

    def arcs(self, data: np.ndarray, left: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, pieces) of all pieces in data; left: bytes to the end of the word at each position."""
        at = np.arange(len(data))
        h = np.zeros(len(data), np.uint64)
        out = [(1, np.flatnonzero(data != _MARK), None)]
        for length in range(1, self.longest + 1):
            fits = left[at] >= length
            at, h = at[fits], h[fits]
            if not len(at):
                break
            h = h * _MULTIPLY + (data[at + length - 1] + 1).astype(np.uint64)
            k = mix(h)
            i = self.find(k)
            known = i >= 0
            at, h, i = at[known], h[known], i[known]
            whole = self.piece[i] >= 0
            out.append((length, at[whole], self.piece[i[whole]]))
        return out

    def lattices(self, words: list[bytes]) -> Lattices:
        return Lattices(self, words)

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """ln P of words in each component [word, component], in steps of bounded size."""
        out = [np.zeros((0, len(self.stop)))]
        for some in groups(words):
            own = Lattices(self, some)
            out.append(np.column_stack([own.forward(np.full(len(some), z)) for z in range(len(self.stop))]))
        return np.concatenate(out)


class Lattices:
    """The lattices of some words.  Nodes of a word of m bytes (with its mark) are 0..m; an arc is a piece."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.pieces, self.n = pieces, len(words)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        data = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(self.n), lengths)
        depth = np.arange(len(data)) - begin[word]
        self.begin = begin + np.arange(self.n)
        self.last = self.begin + lengths
        self.nodes, self.deepest = len(data) + self.n, int(lengths.max())
        # arcs in the order of (depth, group); a group has one arc from each position at most, so no two share an end
        at, size, piece, group = [], [], [], []
        for g, (length, p, i) in enumerate(pieces.arcs(data, lengths[word] - depth)):
            at.append(p)
            size.append(np.full(len(p), length))
            piece.append(pieces.byte[data[p]] if i is None else i)
            group.append(np.full(len(p), g))
        at, size, piece, group = map(np.concatenate, (at, size, piece, group))
        order = np.argsort(depth[at] * (pieces.longest + 2) + group, kind="stable")
        at, size, piece, group = at[order], size[order], piece[order], group[order]
        self.word, self.piece, self.begins = word[at], piece, depth[at] == 0
        self.source = at + word[at]
        self.target = self.source + size
        cut = np.flatnonzero(np.diff(depth[at] * (pieces.longest + 2) + group)) + 1
        self.runs = list(zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True))

    def _values(self, z: np.ndarray) -> np.ndarray:
        z = z[self.word]
        return np.where(self.begins, self.pieces.start[z, self.piece], self.pieces.inner[z, self.piece])

    def _alpha(self, value: np.ndarray) -> np.ndarray:
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.begin] = 0
        for a, b in self.runs:
            t = self.target[a:b]
            alpha[t] = np.logaddexp(alpha[t], alpha[self.source[a:b]] + value[a:b])
        return alpha

    def forward(self, z: np.ndarray) -> np.ndarray:
        """ln P of each word in its component z."""
        return self._alpha(self._values(z))[self.last] + self.pieces.stop[z]

    def expected(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of start and inner pieces [component, piece] over the words, each in its component z."""
        value = self._values(z)
        alpha, beta = self._alpha(value), np.full(self.nodes, -np.inf)
        beta[self.last] = 0
        for a, b in reversed(self.runs):
            f = self.source[a:b]
            beta[f] = np.logaddexp(beta[f], beta[self.target[a:b]] + value[a:b])
        share = np.exp(alpha[self.source] + value + beta[self.target] - alpha[self.last][self.word])
        shape = self.pieces.start.shape
        cell = z[self.word] * shape[1] + self.piece
        count = lambda own: np.bincount(cell[own], share[own], shape[0] * shape[1]).reshape(shape)
        return count(self.begins), count(~self.begins)


def groups(words: list[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for w in words:
        if some and (len(some) >= LATTICE_WORDS or size + len(w) > LATTICE_BYTES):
            yield some
            some, size = [], 0
        some.append(w)
        size += len(w) + 1
    if some:
        yield some


def held_out(folds: int = 5, held: int = 1, key: str = "doc_id"):
    return F.coalesce(crc_mod(key, folds) == held, F.lit(False))


def word_counts(docs: DataFrame, components: int = 1, text: str = "text", component: str = "_z") -> DataFrame:
    """(word, c0, c1, ...): counts of the distinct words of docs in each component; the end token is the null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text, STEP):
            w = Words(b.column(text))
            z = b.column(component).to_numpy()
            one = w.hashes() ^ (z[w.doc].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
            _, at, n = np.unique(one, return_index=True, return_counts=True)
            words = [w.text(i).decode("utf-8", "replace") for i in at.tolist()]
            ends = np.bincount(z, minlength=components)
            columns = [pa.array([*words, *[None] * components], pa.string()), pa.array([*z[w.doc[at]].tolist(), *range(components)], pa.int32()), pa.array([*n.tolist(), *ends.tolist()], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "z", "c"])

    own = [F.sum(F.when(F.col("z") == z, F.col("c")).otherwise(0)).alias(f"c{z}") for z in range(components)]
    return docs.select(text, component).mapInArrow(run, "word string, z int, c long").groupBy("word").agg(*own)


def _gathered(numbers: DataFrame) -> np.ndarray:
    """Rows of a frame of numbers as one array of doubles (longs keep their bits), sent to the driver as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array([np.column_stack([c.view(np.float64) if c.dtype == np.int64 else c for c in columns]).tobytes()])], ["raw"])

    rows = numbers.mapInArrow(run, "raw binary").collect()
    return np.frombuffer(b"".join(bytes(r["raw"]) for r in rows), np.float64).reshape(-1, len(numbers.columns))


def word_hash(words: list[str | None]) -> np.ndarray:
    """Words.hashes() of single words."""
    return Words(pa.array([*words, "x"], pa.string())).hashes(lower=False)[:-1]


class Model:
    """Counts, discounts and piece weights of each component, learned from the training documents."""

    def __init__(self, training: DataFrame, piece_path: str, rounds: int = 3, top_words: int = TOP_WORDS, languages: int = 7, by: str | None = "lang", text: str = "text"):
        self.names: list[str] = []
        z = F.lit(0)
        if by in training.columns:
            many = training.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("l")).count().orderBy(F.desc("count"), "l").limit(languages)
            self.names = [r["l"] for r in many.collect()]
            z = F.coalesce(F.array_position(F.lit(self.names), F.col(by).cast("string")), F.lit(0)) if self.names else z  # 0: the rest
        self.k = k = len(self.names) + 1
        self.pieces = Pieces.load(piece_path, k)
        counts = table(word_counts(training.select(F.col(text).alias("text"), z.cast("int").alias("_z")), k), "lm-counts")
        word = F.col("word").isNotNull()
        sums = [F.sum("c" + str(i)).alias(f"n{i}") for i in range(k)]
        for i in range(k):
            c = F.col(f"c{i}")
            sums += [F.sum(F.when(~word, c)).alias(f"e{i}"), F.count_if(word & (c > 0)).alias(f"v{i}"), F.count_if(word & (c == 1)).alias(f"one{i}"), F.count_if(word & (c == 2)).alias(f"two{i}")]
        t = counts.agg(F.count_if(sum(F.col(f"c{i}") for i in range(k)) > 0).alias("v"), *sums).first()
        get = lambda name: np.array([t[f"{name}{i}"] or 0 for i in range(k)], float)
        self.tokens, self.ends, self.types = get("n"), get("e"), get("v")
        one, two = get("one"), get("two")
        self.discount = np.clip(one / np.maximum(one + 2 * two, 1), 0.1, 0.95)
        self.n, self.v = int(self.tokens.sum()), t["v"]
        # a document's language: its share of the training documents; without any, the rest has all
        self.share = (self.ends + 0.5) / (self.ends.sum() + 0.5 * k)
        words = counts.where(word)
        for _ in range(rounds if self.types.any() else 0):
            self._fit(words)
        self.words = table(self._weighted(words), "lm-words")
        # words above the least count that leaves top_words at most, by a histogram of counts in steps of 2 ** (1 / 16)
        step = F.floor(16 * F.log2("c")).alias("step")
        levels = sorted(map(tuple, self.words.where("c > 0").groupBy(step).count().collect()), reverse=True)  # 1,008 at most
        n, least = 0, None
        for level, m in levels:
            if (n := n + m) > top_words:
                break
            least = level
        often = F.lit(False) if least is None else F.floor(16 * F.log2("c")) >= least
        top = _gathered(self.words.where(often).select("h", "b", *(F.col("s")[z] for z in range(k))))  # top_words at most
        h = top[:, 0].copy().view(np.uint64)
        order = np.argsort(h)
        self.top_h, self.top_base, self.top_score = h[order], top[order, 1], top[order, 2:]

    def _fit(self, words: DataFrame) -> None:
        pieces, k = self.pieces, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, inner, n = np.zeros(pieces.start.shape), np.zeros(pieces.start.shape), np.zeros(k)
            for batch in batches:
                for at in range(0, batch.num_rows, LATTICE_WORDS):
                    b = batch.slice(at, LATTICE_WORDS)
                    counts = np.column_stack([b.column(f"c{z}").to_numpy() for z in range(k)])
                    row, z = np.nonzero(counts)
                    found = [w.encode() for w in b.column("word").to_pylist()]
                    done = 0
                    for some in groups([found[i] for i in row.tolist()]):
                        own = z[done : done + len(some)]
                        s, i = pieces.lattices(some).expected(own)
                        start, inner, n, done = start + s, inner + i, n + np.bincount(own, minlength=k), done + len(some)
            if n.any():
                z, at = np.nonzero(start + inner)
                columns = [[*range(k), *z.tolist()], [*[-1] * k, *at.tolist()], [*[0.0] * k, *start[z, at].tolist()], [*n.tolist(), *inner[z, at].tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["z", "piece", "start", "inner"])

        sums = words.mapInArrow(run, "z long, piece long, start double, inner double").groupBy("z", "piece").agg(F.sum("start"), F.sum("inner"))
        got = _gathered(sums.select(F.col("z").cast("double"), F.col("piece").cast("double"), "sum(start)", "sum(inner)"))  # a row for each piece and component
        shape = pieces.start.shape
        start, inner, stop = np.zeros(shape), np.zeros(shape), np.zeros(k)
        ends = got[got[:, 1] < 0]
        stop[ends[:, 0].astype(int)] = ends[:, 3]
        got = got[got[:, 1] >= 0]
        start[got[:, 0].astype(int), got[:, 1].astype(int)] = got[:, 2]
        inner[got[:, 0].astype(int), got[:, 1].astype(int)] = got[:, 3]
        pieces.weigh(start, inner, stop)

    def scores(self, c: np.ndarray, ln: np.ndarray) -> np.ndarray:
        """log10 P of words [word, component] from their counts and ln lattice."""
        back = ln + np.log(np.maximum(self.discount * self.types, 1e-300) / np.maximum(self.tokens, 1))
        back = np.where(self.types > 0, back, ln + math.log(0.5))  # a component without words: the bare lattice, and an end as likely as a word
        with np.errstate(divide="ignore"):
            seen = np.log(np.maximum(c - self.discount, 0) / np.maximum(self.tokens, 1))
        return np.logaddexp(seen, back) / math.log(10)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def end_scores(self) -> np.ndarray:
        return np.log10(np.where(self.types > 0, self.ends, 0.5 * np.maximum(self.tokens, 1)) / np.maximum(self.tokens, 1))

    def _weighted(self, words: DataFrame) -> DataFrame:
        """(h, c, b, s): hash, count, base score and scores of each training word."""
        pieces, k = self.pieces, self.k
        numbers = Numbers(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, LATTICE_WORDS):
                    b = batch.slice(at, LATTICE_WORDS)
                    found = b.column("word").to_pylist()
                    c = np.column_stack([b.column(f"c{z}").to_numpy() for z in range(k)]).astype(float)
                    s = numbers.scores(c, pieces.log_words([w.encode() for w in found]))
                    total = c.sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(word_hash(found).view(np.int64)), pa.array(total.astype(np.int64)), pa.array(numbers.base(total)), lists(s)], ["h", "c", "b", "s"])

        return words.mapInArrow(run, "h long, c long, b double, s array<double>")


class Numbers:
    """The scalars of a model, without its tables."""

    def __init__(self, model: Model):
        self.discount, self.types, self.tokens, self.n, self.v = model.discount, model.types, model.tokens, model.n, model.v

    scores, base = Model.scores, Model.base


def lists(x: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """Rows of x as array<double>; null where mask."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    ends = pa.array(ends) if mask is None else pa.array(ends, mask=np.append(mask, False))
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x).reshape(-1)))


def score(docs: DataFrame, model: Model, held, text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    held: a boolean column, true where words may be missing from the training counts.
    """
    k, numbers = model.k, Numbers(model)
    end, base_end, ends = model.end_scores(), float(model.base(np.array([model.ends.sum()]))[0]) if model.n else 0.0, int(model.ends.sum() > 0)
    shared = docs.sparkSession.sparkContext.broadcast((model.top_h, model.top_score, model.top_base, model.pieces))
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, h long, k long, mine array<double>"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_h, top_score, top_base, pieces = shared.value
        for b in steps(batches, text, STEP):
            w = Words(b.column(text))
            n = b.num_rows
            h = w.hashes()
            at = np.minimum(np.searchsorted(top_h, h), max(len(top_h) - 1, 0))
            common = top_h[at] == h if len(top_h) else np.zeros(len(h), bool)
            row, at = w.doc[common], at[common]
            known = np.bincount(row, minlength=n)
            base = np.bincount(row, top_base[at], n)
            sums = np.column_stack([np.bincount(row, top_score[at, z], n) for z in range(k)])
            uid = b.column("_uid").to_numpy()
            flags = b.column("_held").to_numpy(zero_copy_only=False)
            none = lambda kind, m: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([pa.array(uid), b.column("doc_id"), pa.array(flags), pa.array(np.diff(w.first) + 1), pa.array(known + ends), pa.array(base + base_end), none(pa.int64(), n), pa.array(np.ones(n, np.int64)), lists(sums + end)], names)
            rare = np.flatnonzero(~common)
            if not len(rare):
                continue
            rare = rare[np.lexsort((h[rare], w.doc[rare]))]
            new = np.ones(len(rare), bool)
            new[1:] = (h[rare][1:] != h[rare][:-1]) | (w.doc[rare][1:] != w.doc[rare][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(rare)))
            rare = rare[first]
            m = len(rare)
            mine = np.zeros((m, k))
            own = np.flatnonzero(flags[w.doc[rare]])
            if len(own):
                _, one, back = np.unique(h[rare[own]], return_index=True, return_inverse=True)
                ln = pieces.log_words([w.text(i) for i in rare[own[one]].tolist()])
                mine[own] = numbers.scores(np.zeros_like(ln), ln)[back]
            lacks = np.ones(m, bool)
            lacks[own] = False
            yield pa.RecordBatch.from_arrays([pa.array(uid[w.doc[rare]]), none(pa.int64(), m), none(pa.bool_(), m), none(pa.int64(), m), none(pa.int64(), m), none(pa.float64(), m), pa.array(h[rare].view(np.int64)), pa.array(times), lists(mine, lacks)], names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("_held"), F.monotonically_increasing_id().alias("_uid"))
    # rows of documents get a join key of their own, so that no task holds them all
    parts = source.mapInArrow(run, schema).withColumn("kind", F.col("h").isNotNull()).withColumn("h", F.coalesce("h", "uid"))
    met = parts.join(model.words.select("h", "b", "s", F.lit(True).alias("kind")), ["kind", "h"], "left")
    seen, times = F.col("b").isNotNull(), F.col("k")
    unknown = float(model.base(np.array([0.0]))[0])
    sums = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(seen, times).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base", times * F.coalesce("b", F.lit(unknown)))).alias("base_score"),
        *(F.sum(times * F.coalesce("s", "mine")[z]).alias(f"s{z}") for z in range(k)),
    )
    best = [F.col(f"s{z}") + math.log10(model.share[z]) for z in range(k)]
    top = F.greatest(*best) if k > 1 else best[0]
    total = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in best), F.lit(0.0)))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", total.alias("score"))


def learn_and_score(docs: DataFrame, piece_path: str, folds: int = 5, held: int = 1) -> DataFrame:
    """Learn from the rows outside a fold of doc_id's crc32 and score all."""
    model = Model(docs.where(~held_out(folds, held)), piece_path)
    return score(docs, model, held_out(folds, held))
