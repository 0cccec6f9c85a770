"""Ids of whole texts by the tokenizers library, asked once for each distinct part of a word.

A vocabulary file whose normalizer works character by character and whose pre-tokenizer drops white space lets no token
cross the white space between words, so the ids of a text are those of its words, joined.  Words are found, cut and
hashed in numpy; a table of sorted hashes holds the ids of the parts met so far, within a bound; only new parts reach
the library, many to a call.  Files of any other kind (see ``splits_at_space``) are encoded plainly, text by text.

Parts are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from sluicegate.llm.common import LOWER, Words
from sluicegate.llm.idtable import LETTER, Table, spans, stems

#: Parts in one text for the library, texts in one call.
GROUP, CALL = 200, 100

#: The normalizer and the pattern of the pre-tokenizer for which the rules below hold.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Leading bytes of U+00C0 to U+024F, and the bytes that follow them.
_LATIN = np.zeros(256, bool)
_LATIN[0xC3:0xCA] = True


def splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer file has the normalizer and pre-tokenizer that the rules of this module were made for."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    normal = spec.get("normalizer") or {}
    return (
        normal.get("normalizers") == NORMALIZER
        and parts[0].get("pattern") == {"Regex": PATTERN}
        and parts[0].get("invert") is True
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[1].get("add_prefix_space") is False
        and parts[1].get("use_regex") is False
        and (spec.get("model") or {}).get("end_of_word_suffix") == "</w>"
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens") or [])
        and all("<|" in t["content"] for t in spec.get("added_tokens") or [])
    )


class LibraryIds:
    """Encodes texts with a tokenizer file as the library does, without special tokens, padding or truncation."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = splits_at_space(spec)
        self.table = Table()
        self.closes = np.zeros(self.size, bool)  # tokens that close a pre-token
        for token, i in spec["model"]["vocab"].items():
            self.closes[i] = token.endswith("</w>")
        added = sorted((t["content"], t["id"]) for t in spec.get("added_tokens") or [])
        self.parting = added[0] if added else None  # parts two words; texts between added tokens are encoded on their own

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), CALL):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after the other, and where each text begins (with the end)."""
        if not self.by_words:
            found = self._ids([t or "" for t in column.to_pylist()])
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        w = Words(column)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(w.offsets), np.int64)
        odd = self._parts(w)
        ids, ends = self.table.ids(w.hashes(lower=False), lambda at: self._learn(w, at, odd[at]))
        return ids, ends[w.first]

    def _parts(self, w: Words) -> np.ndarray:
        """Cut w into parts and lower the case of ASCII words, in place; returns which parts hold "<|".

        A word's ids are those of its stem and of its closing marks where an ASCII letter or digit parts the two, and
        case doesn't count in ASCII words.  Words with "<|", which may begin an added token, are left as they are.
        """
        data, start, end = w.data, w.start, w.end
        bars = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        odd = np.zeros(len(start), bool)
        odd[np.searchsorted(start, bars, side="right") - 1] = True
        stem = stems(data, start, end, ~odd)
        gaps = np.diff(np.append(start, len(data)))
        high = np.add.reduceat((data >= 128).astype(np.int32), start) > 0
        lowered = LOWER[data]
        lowered[: start[0]] = data[: start[0]]
        w.data = np.where(np.append(np.zeros(start[0], bool), np.repeat(high | odd, gaps)), data, lowered)
        two = stem < end
        count = 1 + two
        first = np.cumsum(count) - count
        place = first[two] + 1
        w.start, w.end, w.doc = np.repeat(start, count), np.repeat(end, count), np.repeat(w.doc, count)
        w.end[first] = stem
        w.start[place] = stem[two]
        w.first = np.append(first, len(w.start))[w.first]
        out = np.zeros(len(w.start), bool)
        out[first] = odd
        return out

    def _learn(self, w: Words, at: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts at of w, one part after the other, and how many each has."""
        start, n = w.start[at], w.end[at] - w.start[at]
        flat, ends = spans(w.data, start, n)
        plain = ~odd & self._plain(flat, ends)
        rows, ids, counts = [], [], []

        def joined(group: np.ndarray, between: bytes) -> str:
            return between.join(flat[a:b].tobytes() for a, b in zip(ends[group].tolist(), ends[group + 1].tolist(), strict=True)).decode("utf-8", "replace")

        def put(group: np.ndarray, got: np.ndarray, cuts: np.ndarray) -> None:
            rows.append(group)
            ids.append(got)
            counts.append(np.diff(np.append(0, cuts)))

        def ask(own: np.ndarray, between: bytes, size: int = GROUP):
            groups = [own[i : i + size] for i in range(0, len(own), size)]
            return zip(groups, self._ids([joined(g, between) for g in groups]), strict=True)

        other = [np.flatnonzero(~plain & ~odd)]
        for group, got in ask(np.flatnonzero(plain), b" "):
            cuts = np.flatnonzero(self.closes[got]) + 1  # such a part is one pre-token, and its last token closes it
            if len(cuts) == len(group) and cuts[-1] == len(got):
                put(group, got, cuts)
            else:
                other.append(group)
        single, other = [np.flatnonzero(odd)], np.concatenate(other)
        if self.parting is None:
            single.append(other)
        else:
            text, number = self.parting
            for group, got in ask(other, text.encode()):
                cuts = np.flatnonzero(got == number)
                if len(cuts) == len(group) - 1:
                    put(group, got[got != number], np.append(cuts, len(got)) - np.arange(len(group)))
                else:
                    single.append(group)
        for group, got in ask(np.concatenate(single), b"", 1):
            put(group, got, np.array([len(got)]))
        n = np.concatenate(counts)
        order = np.argsort(np.concatenate(rows))
        flat, _ = spans(np.concatenate(ids), (np.cumsum(n) - n)[order], n[order])
        return flat, n[order]

    def _plain(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Parts of Latin letters up to U+024F alone, without U+0130, whose lower case is two characters."""
        lead = _LATIN[flat]
        good = LETTER[flat] | lead | ((flat >= 128) & (flat < 192))
        after = np.append(flat[1:], np.uint8(0))
        good &= ~((flat == 0xC3) & ((after == 0x97) | (after == 0xB7)))
        good &= ~((flat == 0xC4) & (after == 0xB0)) & ~((flat == 0xC9) & (after > 0x8F))
        bad = np.concatenate([[0], np.cumsum(~good)])
        return bad[ends[1:]] == bad[ends[:-1]]


_LIBRARY: dict[str, LibraryIds] = {}


def library(path: str) -> LibraryIds:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryIds(path)
    return _LIBRARY[path]
