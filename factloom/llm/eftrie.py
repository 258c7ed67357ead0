"""An Elias-Fano n-gram trie in memory-mapped levels.

Level one holds contexts; monotone pointers say where the successors of each begin. Level two holds successor ids made monotone by adding the
last value of the range before, so a lookup is a successor search relative to its context's base. Pointers and successors are Elias-Fano
sequences; every successor has a quantised smoothed probability. All queries are vectors.
"""

from __future__ import annotations

import os

import numpy as np

ONE = np.uint64(1)


def _select(word: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The place of bit number ``left`` (from 0) of each word, by halving the word six times."""
    at = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(word & np.uint64((1 << width) - 1))
        above = left >= count
        left = left - count * above
        step = above * np.int64(width)
        word = word >> step.astype(np.uint64)
        at += step
    return at


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits unary with a popcount directory."""

    PARTS = ("head", "low", "high", "rank")

    def __init__(self, head, low, high, rank):
        self.head, self.low, self.high, self.rank = head, low, high, rank
        self.n, self.bits = int(head[0]), int(head[1])

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        bits = max(0, int(np.log2(max(float(values[-1]) / n, 1.0)))) if n else 0
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) >> 6) + 1 if n else 1, np.uint64)
        np.bitwise_or.at(high, place >> 6, ONE << (place & 63).astype(np.uint64))
        count = np.bitwise_count(high).astype(np.int64)
        return cls(np.array([n, bits], np.int64), low, high, np.cumsum(count) - count)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions ``i``."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.rank, i, side="right") - 1
        left = i - self.rank[word]
        place = word * 64 + _select(np.asarray(self.high)[word], left)
        value = (place - i).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            at = i.astype(np.uint64) * np.uint64(self.bits)
            w, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            low = np.asarray(self.low)
            part = low[w] >> off
            # A shift by 64 is undefined, so the second word is shifted in two steps.
            part |= (low[w + 1] << (np.uint64(63) - off)) << ONE
            value |= part & np.uint64((1 << self.bits) - 1)
        return value.astype(np.int64)


class Trie:
    """Contexts 0 to n - 1, their successors (ids from 0), and a code for each successor."""

    def __init__(self, pointers: EliasFano, successors: EliasFano, codes: np.ndarray):
        self.pointers, self.successors, self.codes = pointers, successors, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray, n_contexts: int) -> Trie:
        """Pairs must be sorted by context, then word, without repeats."""
        ends = np.cumsum(np.bincount(context, minlength=n_contexts))
        pointers = np.concatenate([[0], ends])
        starts = pointers[:-1]
        last = np.where(ends > starts, word[np.maximum(ends - 1, 0)] + 1, 0) if len(word) else np.zeros(n_contexts, np.int64)
        base = np.cumsum(last) - last
        return cls(EliasFano.build(pointers), EliasFano.build(word + 1 + base[context]) if len(word) else EliasFano.build(np.zeros(0)), codes)

    def save(self, folder: str) -> None:
        for name, level in (("pointers", self.pointers), ("successors", self.successors)):
            for part in EliasFano.PARTS:
                np.save(os.path.join(folder, f"{name}.{part}.npy"), getattr(level, part))
        np.save(os.path.join(folder, "codes.npy"), self.codes)

    @classmethod
    def load(cls, folder: str) -> Trie:
        """The trie with every level memory-mapped."""
        level = lambda name: EliasFano(*[np.load(os.path.join(folder, f"{name}.{part}.npy"), mmap_mode="r") for part in EliasFano.PARTS])
        return cls(level("pointers"), level("successors"), np.load(os.path.join(folder, "codes.npy"), mmap_mode="r"))

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each (context, word), 0 for those that are not there."""
        out = np.zeros(len(context), self.codes.dtype)
        if not self.successors.n or not len(context):
            return out
        lo, end = self.pointers[context], self.pointers[np.asarray(context) + 1]
        base = np.where(lo > 0, self.successors[np.maximum(lo - 1, 0)], 0)
        want = base + word + 1
        hi, stop = end.copy(), end
        lo = lo.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.successors[mid] < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        inside = np.flatnonzero(lo < stop)
        hit = inside[self.successors[lo[inside]] == want[inside]]
        out[hit] = self.codes[lo[hit]]
        return out
