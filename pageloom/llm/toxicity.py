"""Toxicity by classifier chains over word and word-start features.

Each category has a logistic model; a later one also sees the earlier ones'
probabilities, which in training are out-of-fold predictions. Fitting uses a
bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import slices, text_or_empty, tidy, to_batch
from pageloom.llm.wordhash import LETTERS, TABLE, _grown, column_bytes, hash_words, mix

#: Labelled rows used for fitting (by hash of doc_id), features kept per category, folds.
MAX_LABELLED, PER_CATEGORY, FOLDS, STARTS = 4000, 100, 5, (4, 5, 6, 7, 8)
_SLOTS = 1 << 20


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of each word and of its first 4 to 8 bytes, the row of each, and the number of words by row."""
    low = pc.utf8_lower(pc.fill_null(column, ""))
    words, bounds = hash_words(low, LETTERS)
    b, o = column_bytes(low)
    n_words = np.diff(bounds)
    row = np.repeat(np.arange(len(column)), n_words)
    if not len(words):
        return words.astype(np.uint32), row, n_words
    inside = LETTERS[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[o] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1 : len(b)]
    ends[:-1] &= ~inside[1:] | edge[1 : len(b)]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _grown(len(b))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[b] * power[: len(b)])])
    keys, rows = [words], [row]
    for k in STARTS:
        long = e - s > k
        at = s[long]
        keys.append(mix((sums[at + k] - sums[at]) * inverse[at] + np.uint64(k)))
        rows.append(row[long])
    return np.concatenate(keys).astype(np.uint32), np.concatenate(rows), n_words


def _distinct(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("keys", pa.binary()), ("n_words", pa.int64())])
    for b in batches:
        for s, e in slices(b.column(1)):
            keys, rows, n_words = features(b.column(1).slice(s, e - s))
            order = np.argsort(rows, kind="stable")
            cut = np.searchsorted(rows[order], np.arange(e - s + 1))
            yield to_batch(schema, [b.column(0).slice(s, e - s), pa.array([np.unique(keys[order][p:q]).tobytes() for p, q in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), n_words])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 25) -> np.ndarray:
    """Weights by Newton's method, the bias last and unpenalised. One class only gives the bias of its share."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 6.0 if len(y) and y[0] else -6.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


class Chain:
    """vocabulary (sorted feature hashes) and one weight vector per category, in chain order."""

    def __init__(self, vocabulary: np.ndarray, categories: list[str], weights: list[np.ndarray]):
        self.vocabulary, self.categories, self.weights = vocabulary, categories, weights
        self.filter = np.zeros(_SLOTS, bool)
        self.filter[(vocabulary & np.uint32(_SLOTS - 1)).astype(np.int64)] = True

    def matrix(self, keys: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Presence of each vocabulary feature by row."""
        near = self.filter[(keys & np.uint32(_SLOTS - 1)).astype(np.int64)]
        keys, rows = keys[near], rows[near]
        at = np.searchsorted(self.vocabulary, keys)
        ok = at < len(self.vocabulary)
        ok[ok] = self.vocabulary[at[ok]] == keys[ok]
        x = np.zeros((n_rows, len(self.vocabulary)))
        x[rows[ok], at[ok]] = 1
        return x

    def predict(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for w in self.weights:
            out.append(_sigmoid(np.column_stack([x, *out]) @ w[:-1] + w[-1]))
        return out


def fit(labelled: list[tuple[int, bytes, list[int]]], categories: list[str], per_category: int = PER_CATEGORY, folds: int = FOLDS) -> Chain:
    """A chain from rows of id, distinct feature hashes and 0/1 labels. No rows give a chain that says no to all."""
    labelled = sorted(labelled, key=lambda r: r[0])
    y = np.array([r[2] for r in labelled], float).reshape(len(labelled), len(categories))
    sets = [np.frombuffer(r[1], np.uint32) for r in labelled]
    keys = np.concatenate([np.zeros(0, np.uint32), *sets])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    vocabulary, at = np.unique(keys, return_inverse=True)
    n = len(labelled)
    total = np.bincount(at, minlength=len(vocabulary)).astype(float)
    chosen: set[int] = set()
    for c in range(len(categories)):
        n1 = y[:, c].sum()
        if not 0 < n1 < n:
            continue
        with_1 = np.bincount(at, weights=y[rows, c], minlength=len(vocabulary))
        p1, p0 = (with_1 + 0.5) / (n1 + 1), (total - with_1 + 0.5) / (n - n1 + 1)
        share = total / n
        z = np.abs(p1 - p0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1)) + 1e-9)
        z[total < 5] = 0
        chosen.update(np.argsort(-z, kind="stable")[:per_category][np.sort(-z)[:per_category] < -4].tolist())
    chain = Chain(vocabulary[sorted(chosen)], categories, [])
    x = chain.matrix(keys, rows, n)
    fold = np.arange(n) % folds
    earlier = np.zeros((n, 0))
    for c in range(len(categories)):
        seen, p = np.hstack([x, earlier]), np.zeros(n)
        for f in range(folds):
            w = logistic(seen[fold != f], y[fold != f, c])
            p[fold == f] = _sigmoid(seen[fold == f] @ w[:-1] + w[-1])
        chain.weights.append(logistic(seen, y[:, c]))
        earlier = np.column_stack([earlier, p])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: list[str], max_labelled: int = MAX_LABELLED) -> Chain:
    """Fit on at most max_labelled labelled documents, the first by hash of doc_id; rows with a null label are left out.

    A document that has several rows counts once, by the first of its texts; one that has several labels by the largest.
    """
    known = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*(F.max(c).alias(c) for c in categories))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")  # max_labelled rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = rows.select("doc_id", "text").mapInArrow(tidy(_distinct), "doc_id long, keys binary, n_words long").collect()
    targets = {r.doc_id: [int(r[c]) for c in categories] for r in few.collect()}
    return fit([(r.doc_id, bytes(r["keys"]), targets[r.doc_id]) for r in found], categories)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> for every row of docs. Null and empty texts have no features and get the bias; an empty table
    gives no rows, repeated rows the same answer, and other columns of docs don't matter."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # a few hundred weights
    names = [f"p_{c}" for c in chain.categories]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.float64()) for n in names)])

    def run(batches):
        model = shared.value
        for b in batches:
            for s, e in slices(b.column(1)):
                keys, rows, _ = features(b.column(1).slice(s, e - s))
                yield to_batch(schema, [b.column(0).slice(s, e - s), *model.predict(model.matrix(keys, rows, e - s))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{n} double" for n in names))


def without(docs: DataFrame, chain: Chain, category: str, threshold: float = 0.5) -> DataFrame:
    """Rows of docs, all columns, whose probability of the category is under the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at, text = chain.categories.index(category), docs.columns.index("text")

    def run(batches):
        model = shared.value
        for b in batches:
            for s, e in slices(b.column(text)):
                keys, rows, _ = features(b.column(text).slice(s, e - s))
                p = model.predict(model.matrix(keys, rows, e - s))[at]
                yield b.slice(s, e - s).filter(pa.array(p < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
