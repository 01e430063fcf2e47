"""Patched frame-of-reference coding of token ids, in numpy.

Ids go in blocks of 128. A block stores its minimum, then each difference in the
number of bits that covers a percentile of them; larger ones keep their low bits
there and put the rest in the exception list. The index has every block's start.

Layout (little endian): magic, ids, blocks, words, exceptions as 5 uint32; minima
uint32, widths uint8 (padded to 4), starts uint32 per block; packed uint64 words;
exception positions uint32; exception high parts uint32.
"""

from __future__ import annotations

import numpy as np

MAGIC, BLOCK, PERCENTILE = 0x314F4650, 128, 90


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.array([MAGIC, 0, 0, 0, 0], "<u4").tobytes()
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n], full[n:] = ids, ids[-1]
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    delta = full - low[:, None]
    need = _bits(delta)
    k = min(BLOCK - 1, BLOCK * percentile // 100)
    width = np.partition(need, k, axis=1)[:, k]
    over = np.flatnonzero((need > width[:, None]).reshape(-1))
    high = (delta.reshape(-1)[over].astype(np.uint64) >> width[over // BLOCK].astype(np.uint64)).astype(np.uint32)
    starts = np.zeros(blocks + 1, np.uint32)
    np.cumsum(width.astype(np.uint32) * 2, out=starts[1:])
    words = np.zeros(int(starts[-1]) + 1, np.uint64)
    for w in np.unique(width):
        w = int(w)
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        cols = (delta[rows].T & np.uint32((1 << w) - 1)).astype(np.uint64)
        packed = np.zeros((2 * w + 1, len(rows)), np.uint64)
        for i in range(BLOCK):
            q, r = divmod(i * w, 64)
            packed[q] |= cols[i] << np.uint64(r)
            if r + w > 64:
                packed[q + 1] |= cols[i] >> np.uint64(64 - r)
        at = starts[:-1][rows].astype(np.int64)
        for j in range(2 * w):
            words[at + j] = packed[j]
    pad = bytes(-blocks % 4)
    head = np.array([MAGIC, n, blocks, len(words), len(over)], "<u4")
    return b"".join([head.tobytes(), low.astype("<u4").tobytes(), width.tobytes(), pad, starts[:-1].astype("<u4").tobytes(), words.astype("<u8").tobytes(), over.astype("<u4").tobytes(), high.astype("<u4").tobytes()])


def decode(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first up to last (all by default); the index finds them without the blocks before."""
    magic, n, blocks, n_words, n_over = np.frombuffer(data, "<u4", 5)
    if magic != MAGIC:
        raise ValueError("not a packed id chunk")
    n, blocks, n_words, n_over = int(n), int(blocks), int(n_words), int(n_over)
    last = blocks if last is None else min(last, blocks)
    if first >= last:
        return np.zeros(0, np.uint32)
    at = 20
    low = np.frombuffer(data, "<u4", blocks, at)[first:last]
    at += 4 * blocks
    width = np.frombuffer(data, np.uint8, blocks, at)[first:last]
    at += blocks + -blocks % 4
    starts = np.frombuffer(data, "<u4", blocks, at)[first:last].astype(np.int64)
    at += 4 * blocks
    words = np.frombuffer(data, "<u8", n_words, at)
    at += 8 * n_words
    over, high = np.frombuffer(data, "<u4", n_over, at), np.frombuffer(data, "<u4", n_over, at + 4 * n_over)
    delta = np.zeros((last - first, BLOCK), np.uint64)
    for w in np.unique(width):
        w = int(w)
        if not w:
            continue
        rows = np.flatnonzero(width == w)
        packed = np.stack([words[starts[rows] + j] for j in range(2 * w)] + [np.zeros(len(rows), np.uint64)])
        cols = np.empty((BLOCK, len(rows)), np.uint64)
        for i in range(BLOCK):
            q, r = divmod(i * w, 64)
            cols[i] = packed[q] >> np.uint64(r)
            if r + w > 64:
                cols[i] |= packed[q + 1] << np.uint64(64 - r)
        delta[rows] = (cols & np.uint64((1 << w) - 1)).T
    s, e = np.searchsorted(over, [first * BLOCK, last * BLOCK])
    here = over[s:e].astype(np.int64) - first * BLOCK
    flat = delta.reshape(-1)
    flat[here] |= high[s:e].astype(np.uint64) << width[here // BLOCK].astype(np.uint64)
    out = (delta + low[:, None]).reshape(-1).astype(np.uint32)
    return out[: min(n, last * BLOCK) - first * BLOCK]
