"""Benchmark decontamination by greedy string tiling.

Runs of K words that a document shares with a benchmark item are seeds. Where an
item's seeds could cover enough of it, item and document are tiled: the longest
common run of unmarked words is marked, again and again, found by Karp-Rabin
hashes of falling window length. An item is leaked if its tiles cover the
threshold share of its words, in whatever order the document has them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import slices, text_or_empty, tidy, to_batch
from pageloom.llm.wordhash import LETTERS, grams, hash_words

MIN_RUN, COVERAGE, BLOCK_BYTES = 5, 0.5, 16 << 20
_R = 0xD1342543DE82EF95
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)
_OUT = "doc_id long, item_id long, item_words int, covered_words int, n_tiles int, longest_tile int, coverage double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("covered_words", pa.int32()), ("n_tiles", pa.int32()), ("longest_tile", pa.int32()), ("coverage", pa.float64())])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words of letters and digits, and each row's bounds."""
    return hash_words(pc.utf8_lower(pc.fill_null(column, "")), LETTERS)


def _powers(n: int):
    global _POWERS
    if len(_POWERS[0]) < n:
        out = []
        for b in (_R, pow(_R, -1, 1 << 64)):
            steps = np.full(2 * n, np.uint64(b))
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _POWERS = tuple(out)
    return _POWERS


def _windows(words: np.ndarray, marked: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of s unmarked words and their Karp-Rabin hashes."""
    n = len(words) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
    taken = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(taken[s:] == taken[:-s])
    return at, (sums[at + s] - sums[at]) * down[at]


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_RUN) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, words) of at least that many words, longest first."""
    in_item, in_doc, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    s = len(item)
    while s >= least:
        i_at, i_hash = _windows(item, in_item, s)
        d_at, d_hash = _windows(doc, in_doc, s)
        hits = np.isin(d_hash, i_hash)
        if not hits.any():
            s = s - 1 if s <= 2 * least else max(2 * least, s // 2)
            continue
        order = np.argsort(i_hash, kind="stable")
        lo, hi = np.searchsorted(i_hash[order], d_hash[hits], "left"), np.searchsorted(i_hash[order], d_hash[hits], "right")
        best = []
        for d, p, q in zip(d_at[hits].tolist(), lo.tolist(), hi.tolist(), strict=True):
            for i in i_at[order[p:q]].tolist():
                if i and d and item[i - 1] == doc[d - 1] and not in_item[i - 1] and not in_doc[d - 1]:
                    continue  # the window before it starts this run
                n = s
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not in_item[i + n] and not in_doc[d + n]:
                    n += 1
                best.append((-n, i, d))
        for n, i, d in sorted(best):
            n = -n
            if not in_item[i : i + n].any() and not in_doc[d : d + n].any():
                in_item[i : i + n] = in_doc[d : d + n] = True
                tiles.append((i, d, n))
    return tiles


class Seeds:
    """Hashes of all runs of k words of a block of items, with the items that have them."""

    def __init__(self, rows: list[tuple[int, str | None]], k: int):
        self.k, self.ids = k, [r[0] for r in rows]
        words, bounds = word_hashes(pa.array([r[1] for r in rows], pa.string()))
        self.items = [words[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        parts = [grams(w, k) for w in self.items]
        every = np.concatenate([np.zeros(0, np.uint64), *parts])
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in parts)])[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.hash & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray, bounds: np.ndarray, coverage: float):
        """(row, item) pairs whose seeds could cover the share of the item."""
        every = grams(words, self.k)
        at = np.flatnonzero(self.filter[(every & np.uint64((1 << 20) - 1)).astype(np.int64)])
        row = np.searchsorted(bounds, at, side="right") - 1
        inside = at + self.k <= bounds[row + 1]
        at, row = at[inside], row[inside]
        lo, hi = np.searchsorted(self.hash, every[at], "left"), np.searchsorted(self.hash, every[at], "right")
        covered: dict[tuple[int, int], set[int]] = {}
        for r, p, q in zip(row[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            for x in range(p, q):
                covered.setdefault((r, int(self.item[x])), set()).update(range(self.place[x], self.place[x] + self.k))
        return [(r, i) for (r, i), c in covered.items() if len(c) >= coverage * len(self.items[i])]


def _scan(seeds, k: int, coverage: float):
    def run(batches):
        block = seeds.value
        for b in batches:
            for s, e in slices(b.column(1)):
                ids, text = b.column(0).slice(s, e - s), b.column(1).slice(s, e - s)
                words, bounds = word_hashes(text)
                rows = []
                for r, i in block.candidates(words, bounds, coverage):
                    item = block.items[i]
                    tiles = tile(item, words[bounds[r] : bounds[r + 1]], k)
                    n = sum(t[2] for t in tiles)
                    if tiles and n >= coverage * len(item):
                        rows.append((ids[r].as_py(), block.ids[i], len(item), n, len(tiles), max(t[2] for t in tiles), n / len(item)))
                if rows:
                    yield to_batch(_SCHEMA, [list(x) for x in zip(*rows, strict=True)])

    return run


def leaks(docs: DataFrame, items: DataFrame, k: int = MIN_RUN, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item that it gives away, with the tiles' share of the item's words.

    docs: doc_id, text; items: item_id, text. Items of fewer than k words, null and empty texts match nothing; repeated
    rows give repeated pairs. Items are sent to the tasks in blocks of about block_bytes, however many there are, and the
    documents are read once per block and never shuffled.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = None
    for n in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        seeds = spark.sparkContext.broadcast(Seeds([tuple(r) for r in part.collect()], k))
        found = docs.mapInArrow(tidy(_scan(seeds, k, coverage)), _OUT)
        out = found if out is None else out.unionByName(found)
    return out
