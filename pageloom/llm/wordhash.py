"""64-bit hashes of all words of a column of texts, by numpy over the column's bytes.

The hash of a word is a polynomial in its bytes (each first sent through a fixed
random table), taken from prefix sums; no word becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240607)
#: A-Z count as a-z.
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
TABLE[65:91] = TABLE[97:123]
#: Bytes that stand in a word when words end at ASCII white space.
BETWEEN_SPACES = np.ones(256, bool)
BETWEEN_SPACES[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes that stand in a word when words are letters and digits; all bytes of non-ASCII characters do.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 20)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(m, b)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def hash_words(column: pa.Array, inside: np.ndarray = BETWEEN_SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the bounds of each row's words in that array (rows + 1 numbers). Nulls have no words."""
    b, o = column_bytes(pc.fill_null(column, ""))
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(o), np.int64)
    word = inside[b]
    edge = np.zeros(n + 1, bool)
    edge[o] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    ends = word
    ends[:-1] &= ~word[1:] | edge[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _grown(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLE[b] * power[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverse[starts]), np.searchsorted(starts, o)


_MULT = [np.uint64(x) for x in _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i : i + n] * _MULT[i]
    return mix(out)


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each row; a shorter row is one shingle, a row without words has none."""
    words, bounds = hash_words(column)
    every = grams(words, k)
    out = []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - s >= k:
            out.append(np.unique(every[s : e - k + 1]))
        elif e > s:
            out.append(mix(np.array([(words[s:e] * np.array(_MULT[: e - s])).sum(dtype=np.uint64) + np.uint64(e - s)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
