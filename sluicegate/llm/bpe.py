"""Operator 3, BPE encoding and decoding: batched numpy merge rounds.

The symbols of many pre-tokens lie in one flat array.  Each round takes the lowest rank of each pre-token's adjacent
pairs, merges all its occurrences from left to right, drops pre-tokens without a known pair and looks up the new pairs by
binary search in the sorted pair keys.  Texts are cut at single spaces between visible characters and before a word's
closing marks, where a pre-token always begins, so that parts repeat; each distinct part is merged once, and a bounded
table keeps its ids under a 64-bit hash.

Defined results: a null text counts as empty; an empty text has no ids; a literal added token in a text becomes its id;
repeated rows are encoded as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from sluicegate.llm.common import STEP_BYTES, span_hashes, steps, trimmed, utf8
from sluicegate.llm.idtable import CLOSING, LETTER, Table, spans, stems

#: Fixed value: the byte-level pre-token pattern of the vocabulary file's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that one Python worker keeps between steps.
CACHE_PIECES = 200_000

_NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    out = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


class Merger:
    """Merge tables of a byte-level BPE file as sorted arrays, and its token bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbols = byte_symbols()
        self.of_byte = np.array([vocab[s] for s in symbols], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = (left << 32) | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *self.added.values()]) + 1
        back = {s: b for b, s in enumerate(symbols)}
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            raw[i] = token.encode()
        self.size = size
        self.token_len = np.array([len(r) for r in raw], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and the number of ids of each word.  data: the words' bytes, joined.

        A round merges the lowest-ranked pairs of every word at once; then only pairs with a new symbol are looked up.
        """
        symbol = self.of_byte[data]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.full(len(symbol), -1)  # the place of each symbol's pair with the next among the keys

        def look(i: np.ndarray) -> None:
            i = i[i < len(symbol) - 1]
            key = (symbol[i] << 32) | symbol[i + 1]
            found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            at[i] = np.where((self.key[found] == key) & (word[i + 1] == word[i]), found, -1)

        look(np.arange(len(symbol)))
        while len(symbol):
            rank = np.where(at >= 0, self.rank[at], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbol))))
            live = least < _NONE
            if not live.all():
                done.append((word[~live], symbol[~live]))
            hit = np.flatnonzero(live & (rank == least))
            if not len(hit):
                break
            # of overlapping occurrences (aaa) the first, third, ... of a run are merged
            run = np.concatenate([[True], np.diff(hit) != 1])
            begin = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            hit = hit[(hit - begin) % 2 == 0]
            symbol[hit] = self.made[at[hit]]
            new = np.zeros(len(symbol), bool)
            new[hit] = True
            live[hit + 1] = False
            symbol, word, at, new = symbol[live], word[live], at[live], new[live]
            new = np.flatnonzero(new)
            # pairs with a new symbol, on its right or on its left
            changed = np.zeros(len(symbol), bool)
            changed[new] = True
            changed[new[(new > 0) & (word[new - 1] == word[new])] - 1] = True
            at[changed] = -1
            look(np.flatnonzero(changed))
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
        word = np.concatenate([w for w, _ in done])
        symbol = np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(lengths))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, as one array."""
        lengths = self.token_len[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.token_at[ids] - (ends - lengths), lengths)
        return self.token_bytes[shift + np.arange(len(shift))]


def _blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character begins at each place; any byte up to 32 counts as one."""
    text = np.append(data, np.zeros(2, np.uint8))
    a, b, c = text[at], text[at + 1], text[at + 2]
    wide = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | np.isin(c, (0xA8, 0xA9, 0xAF)))) | ((b == 0x81) & (c == 0x9F)))
    wide |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return (a <= 32) | ((a == 0xC2) & np.isin(b, (0x85, 0xA0))) | wide


class Encoder:
    """Texts to ids.  Texts are cut into parts at single spaces between visible characters, and before a word's closing
    marks; a bounded table keeps the ids of parts."""

    def __init__(self, path: str):
        self.merger = Merger(path)
        self.pattern = regex.compile(PATTERN)
        added = sorted(self.merger.added, key=len, reverse=True)
        self.added = added
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.table = Table()
        self.tokens: dict[str, bytes] = {}  # ids of pre-tokens, for known()

    def pretokens(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def merged(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after the other, and how many each has."""
        return self.merger.merge(np.frombuffer(b"".join(tokens), np.uint8), np.fromiter(map(len, tokens), np.int64, len(tokens)))

    def known(self, tokens: set[str]) -> dict[str, bytes]:
        """A bounded cache of pre-tokens' ids (little-endian uint32 bytes), with all of tokens in it."""
        new = tokens.difference(self.tokens)
        if len(self.tokens) + len(new) > CACHE_PIECES:
            self.tokens = {k: self.tokens[k] for k in tokens - new} if len(tokens) <= CACHE_PIECES else {}
            new = tokens.difference(self.tokens)
        if new:
            ids, n = self.merged([t.encode() for t in new])
            raw, ends = ids.astype("<u4").tobytes(), [0, *(4 * np.cumsum(n)).tolist()]
            self.tokens.update(zip(new, [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))
        return self.tokens

    def _odd(self, text: str) -> np.ndarray:
        """Any text, cut at added tokens first."""
        out = [np.zeros(0, np.int64)]
        for part in self.cut.split(text):
            out.append(np.array([self.merger.added[part]]) if part in self.merger.added else self.merged([t.encode() for t in self.pretokens(part)])[0])
        return np.concatenate(out)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (uint32) of all texts (null: empty), one after the other, and where each text begins (with the end)."""
        data, offsets = utf8(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # a pre-token begins at a single space between visible characters
        space = np.flatnonzero(data[1:-1] == 32) + 1
        space = space[~_blank(data, space + 1) & (data[space - 1] > 32)]
        wide = space[data[space - 1] >= 128]
        ends_blank = _blank(data, np.maximum(wide - 2, 0)) & (data[np.maximum(wide - 2, 0)] == 0xC2)
        ends_blank |= _blank(data, np.maximum(wide - 3, 0)) & (data[np.maximum(wide - 3, 0)] >= 0xE1)
        begins = np.zeros(len(data), bool)
        begins[space] = True
        begins[wide[ends_blank]] = False
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        stem = stems(data, start, end, np.ones(len(start), bool))
        begins[stem[stem < end]] = True
        start = np.flatnonzero(begins)
        ids, ends = self.table.ids(span_hashes(data, start), lambda at: self._learn(data, start[at], np.append(start[1:], len(data))[at]))
        ends = ends[np.searchsorted(start, offsets)]
        raw = data.tobytes()
        if any(a.encode() in raw for a in self.added):  # rare: such texts are encoded anew
            texts = texts_of(column)
            found = [self._odd(t) if any(a in t for a in self.added) else ids[i:j] for t, i, j in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            return np.concatenate(found).astype(np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return ids, ends

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts of data, one after the other, and how many each has.

        A part of ASCII letters, with a space before them or not, is one pre-token, and so is one of closing marks; others
        are cut by the pattern.
        """
        flat, ends = spans(data, start, end - start)
        lead = flat[ends[:-1]] == 32
        other = np.concatenate([[0], np.cumsum(~LETTER[flat])])
        marks = np.concatenate([[0], np.cumsum(~CLOSING[flat])])
        count = other[ends[1:]] - other[ends[:-1]]
        plain = ((count == 0) | (lead & (count == 1) & (np.diff(ends) > 1))) | (marks[ends[1:]] == marks[ends[:-1]])
        rest = np.flatnonzero(~plain)
        raw = flat.tobytes()
        found = [[t.encode() for t in self.pretokens(raw[i:j].decode())] for i, j in zip(ends[rest].tolist(), ends[rest + 1].tolist(), strict=True)]
        number = {t: i for i, t in enumerate(dict.fromkeys(itertools.chain.from_iterable(found)))}
        own, _ = spans(flat, ends[:-1][plain], np.diff(ends)[plain])
        tokens = list(number)
        lengths = np.concatenate([np.diff(ends)[plain], np.fromiter(map(len, tokens), np.int64, len(tokens))])
        ids, n = self.merger.merge(np.concatenate([own, np.frombuffer(b"".join(tokens), np.uint8)]), lengths)
        # each part's pre-tokens: itself, or those found
        many = np.ones(len(start), np.int64)
        many[rest] = [len(f) for f in found]
        which = np.zeros(int(many.sum()), np.int64)
        place = np.cumsum(many) - many
        which[place[plain]] = np.arange(int(plain.sum()))
        at = np.repeat(~plain, many)
        which[at] = int(plain.sum()) + np.array([number[t] for f in found for t in f], np.int64)
        out, cuts = spans(ids, (np.cumsum(n) - n)[which], n[which])
        cuts = cuts[np.append(place, len(which))]
        return out, np.diff(cuts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def decoded(merger: Merger, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """UTF-8 of each decoded text; bytes that are not UTF-8 become the replacement character."""
    raw = merger.decode(ids).tobytes()
    at = np.concatenate([[0], np.cumsum(merger.token_len[ids])])[ends].tolist()
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        piece = raw[a:b]
        try:
            piece.decode()
        except UnicodeDecodeError:
            piece = piece.decode("utf-8", "replace").encode()
        out.append(piece)
    return out


def encode(docs: DataFrame, vocab_path: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns keep of docs, and ids: array<int> of each whole text.  Rows stay where they are; nothing shuffles."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab_path)
        for b in steps(batches, text):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), id_lists(*own.encode_column(b.column(text)))], [*keep, "ids"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(coded: DataFrame, vocab_path: str, keep: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """The columns keep of coded, and text: the decoded ids (null ids: empty)."""
    keep = [c for c in coded.columns if c != ids] if keep is None else keep
    schema = ", ".join([*(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in keep), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab_path).merger
        for batch in batches:
            rows = max(1, STEP_BYTES // 4096)
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                lists = b.column(ids).fill_null([])
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
                texts = decoded(own, lists.flatten().to_numpy().astype(np.int64), ends)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([t.decode() for t in texts])], [*keep, "text"])

    return coded.select(*keep, ids).mapInArrow(run, schema)


def digests(docs: DataFrame, vocab_path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text in one pass: n_tokens, ids_sha256 and decoded_sha256 beside the columns keep, and
    ids (array<int>) if asked for."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocab_path)
        for b in steps(batches, text, STEP_BYTES // 2):  # ids, decoded bytes and texts of a step are held at once
            ids, ends = own.encode_column(b.column(text))
            raw, at = ids.astype("<u4").tobytes(), (4 * ends).tolist()
            out = [
                pa.array(np.diff(ends)),
                pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded(own.merger, ids, ends)], pa.string()),
            ]
            out += [id_lists(ids, ends)] * with_ids
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(*keep, text).mapInArrow(trimmed(run), schema)
