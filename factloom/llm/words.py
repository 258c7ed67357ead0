"""Words of whole texts, and 64-bit hashes of words and shingles, in Arrow and numpy."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of words of each text, code of each word, the words by code); A-Z are lowered, null is empty.

    White space is \\x20 and \\x09-\\x0D, which is Arrow's ASCII white space.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    coded = flat.dictionary_encode()
    return np.bincount(row[full], minlength=len(texts)), coded.indices.to_numpy()[full].astype(np.int64), coded.dictionary.to_pylist()


def _libc():
    import ctypes

    return ctypes.CDLL("libc.so.6")


with contextlib.suppress(OSError, AttributeError):
    # Arrays from half a megabyte on (M_MMAP_THRESHOLD is -3) go back to the system when they are freed, not only when what lies above them is.
    _libc().mallopt(-3, 1 << 19)


def trim() -> None:
    """Gives memory that a finished block held back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        _libc().malloc_trim(0)


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _B
        x = (x ^ (x >> np.uint64(32))) * _B
        return x ^ (x >> np.uint64(32))


def shingles(counts: np.ndarray, word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each text, their hashes): ``width`` words in order; a text with fewer is one shingle; without words, none.

    ``word`` holds the hashes of all words of all texts, one text after the other.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    stop = np.repeat(ends, n)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = at + k < stop
            h = np.where(inside, mix(h + _A) + word[np.minimum(at + k, max(len(word) - 1, 0))], h)
    return n, mix(h)
