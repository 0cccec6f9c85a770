"""Ids of parts of texts, kept by sorted 64-bit hashes of their bytes within a bound, and the cutting of closing marks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Parts that one Python worker keeps between steps: about 40 bytes each.
KEPT = 1_500_000

#: Marks that can close a word as a token run of their own; the apostrophe may belong to a contraction.
CLOSING = np.zeros(256, bool)
CLOSING[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
LETTER = np.zeros(256, bool)
LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True


def spans(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[at : at + n] of each place, joined, and where each begins (with the end)."""
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    return values[np.arange(ends[-1]) + np.repeat(at - ends[:-1], n)], ends


def stems(data: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The end of each span's stem: before its closing marks, where an ASCII letter or digit parts the two, else its end.
    Spans outside own are left whole."""
    stem = end.copy()
    open_ = np.flatnonzero(own)
    while len(open_):
        open_ = open_[CLOSING[data[stem[open_] - 1]]]
        stem[open_] -= 1
        open_ = open_[stem[open_] > start[open_]]
    whole = ~own | (stem == start) | ~_ALNUM[data[np.maximum(stem, 1) - 1]]
    return np.where(whole, end, stem)


class Table:
    """Ids of parts, found by sorted 64-bit hashes."""

    def __init__(self):
        self.key, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.steps = np.zeros(0, np.uint8)  # how many steps have met a part, up to 2
        self.pool = np.zeros(0, np.uint32)

    def __len__(self) -> int:
        return len(self.key)

    def lacks(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.ones(len(keys), bool)
        return self.key[np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)] != keys

    def keep(self, own: np.ndarray) -> None:
        """Only the parts marked in own stay."""
        n = self.n[own]
        self.pool, _ = spans(self.pool, self.at[own], n)
        self.key, self.n, self.steps = self.key[own], n, self.steps[own]
        self.at = np.cumsum(n, dtype=np.int64) - n

    def room(self, keys: np.ndarray, new: int) -> None:
        """Make room for new parts: parts that one step only has met go, and all but this step's if those are many."""
        if len(self) + new <= KEPT:
            return
        own = self.steps > 1
        if own.sum() + new > KEPT // 2:
            own = keys[np.minimum(np.searchsorted(keys, self.key), len(keys) - 1)] == self.key
        self.keep(own)

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Sorted new keys and their ids, one part after the other."""
        place = np.searchsorted(self.key, keys)
        at = len(self.pool) + np.cumsum(n, dtype=np.int64) - n
        self.key, self.at = np.insert(self.key, place, keys), np.insert(self.at, place, at)
        self.n, self.steps = np.insert(self.n, place, n), np.insert(self.steps, place, 0)
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])

    def met(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, all of which are there."""
        place = np.searchsorted(self.key, keys)
        self.steps[place] = np.minimum(self.steps[place] + 1, 2)
        return place

    def ids(self, hashes: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one after the other, and where each begins (with the end).

        learn: the places of new parts to their ids, one part after the other, and how many each has.
        """
        keys, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.room(keys, int(self.lacks(keys).sum()))
        new = self.lacks(keys)
        if new.any():
            self.add(keys[new], *learn(at[new]))
        place = self.met(keys)[back]
        return spans(self.pool, self.at[place], self.n[place])
