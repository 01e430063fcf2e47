"""N-gram Jaccard join: exact links between shingle sets, with a count-vector R-tree.

1. Every text becomes its set of word shingles, hashed to 64 bits, and a vector of
   counts over groups of hashes, one group for one to two shingles. Equal sets are
   one node from here on.
2. Shingles are put in one order for all texts, rare ones first (a count sketch of
   fixed size says which are common). Sets a, b that must share o shingles share l
   of their first |a| - o + l and |b| - o + l ones, for l = 1 + o // SLACK. Rows of such
   prefixes meet at a shingle; a row without a partner of fitting size and position
   goes, and so does a set that has fewer than l rows left.
3. Sets that meet at a shingle are first compared with a few pivots of their size
   there, if they meet those often. Verified links give clusters.
4. What is left are shingles at which different clusters meet. There the count
   vectors go in an R-tree, at first, where many sets meet, to link each with its
   nearest partner of another cluster, then for all pairs that are left; pairs of
   nodes whose summed coordinate minima can't reach the overlap are cut, and so are
   pairs of points. The pairs that survive are verified on their whole texts.

Shingles that more than HOT sets share are left out by every set that has fewer than l
of them, as it meets its partners at others; sets that remain there are dealt out by
pairs of blocks of about HOT rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import discard, narrowed, slices, small_batches, stored, text_or_empty, tidy, to_batch
from pageloom.llm.components import components
from pageloom.llm.wordhash import mix, shingle_sets

SKETCH, SEGMENT, SLACK, HOT = 1 << 18, 1 << 12, 32, 1 << 14
#: Points in a leaf, leaves or nodes in a node, points that are a leaf however far apart, and points that are one node without boxes.
LEAF, FAN, FEW, ONE_NODE = 32, 8, 4, 128
#: Label of a node that holds several clusters.
MIXED = -(1 << 63)
#: Bytes of unpacked count vectors that are compared at once.
BLOCK_BYTES = 16 << 20
_NODES = "doc_id long, n int, s1 long, s2 long, vec binary, prefix array<long>"
_NODE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("vec", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def signature(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that equal sets share."""
    m = mix(s + np.uint64(0x632BE59BD9B4E019))
    return m.sum(dtype=np.uint64), mix(m).sum(dtype=np.uint64)


def octave(n) -> np.ndarray:
    """Bits of a hash that name its group in a set of n: 2**octave groups, 64 at least and as many as half of n."""
    return np.maximum(6, np.frexp(np.asarray(n, float))[1] - 1)


def group_counts(s: np.ndarray) -> bytes:
    """Counts by group, two to a byte where none is over 15, else each in as few bytes as the largest needs."""
    bits = int(octave(len(s)))
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    if counts.max() < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def unpacked(column: list[bytes], bits: int) -> np.ndarray:
    """Count vectors of 2**bits groups as rows, in the widest type among them."""
    groups = 1 << bits
    width = max(1, max(map(len, column)) // groups)
    out = np.zeros((len(column), groups), f"u{width}")
    for packed in {len(v) for v in column}:
        at = [i for i, v in enumerate(column) if len(v) == packed]
        data = b"".join(column[i] for i in at)
        if packed < groups:
            x = np.frombuffer(data, np.uint8).reshape(len(at), -1)
            out[at, ::2], out[at, 1::2] = x & 15, x >> 4
        else:
            out[at] = np.frombuffer(data, f"u{packed // groups}").reshape(len(at), -1)
    return out


def folded(v: np.ndarray) -> np.ndarray:
    """Count vectors over half as many groups."""
    return v[:, ::2].astype(np.min_scalar_type(int(v.max(initial=0)) * 2)) + v[:, 1::2]


def overlap(n_a, n_b, pct: int):
    """Shingles that sets of these sizes share at least if they link."""
    return -(-(n_a + n_b) * pct // (100 + pct))


def n_prefix(n: int, pct: int) -> int:
    """Rows of a set: its share of the prefix with the smallest partner that it can have."""
    o = -(-n * pct // 100)
    return n - o + 1 + o // SLACK


def fit(n_a, p_a, n_b, p_b, pct: int, slack: bool = False):
    """Whether sets of these sizes can link, and a shingle at these positions can be the first that they share; with slack, one of the first 1 + o // SLACK."""
    o = overlap(n_a, n_b, pct)
    slack = 1 - o + (o // SLACK if slack else 0)
    return (n_a * 100 >= n_b * pct) & (n_b * 100 >= n_a * pct) & (p_a < n_a + slack) & (p_b < n_b + slack)


def _sketch(k: int):
    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for s, e in slices(b.column(0)):
                sets = shingle_sets(b.column(0).slice(s, e - s), k)
                cells = (np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64)
                total += np.bincount(cells, minlength=SKETCH)
        schema = pa.schema([("seg", pa.int32()), ("counts", pa.binary())])
        parts = total.astype("<i8").reshape(-1, SEGMENT)
        yield to_batch(schema, [list(range(len(parts))), [p.tobytes() for p in parts]])

    return run


def _add(_key, pdf):
    import pandas as pd

    total = sum(np.frombuffer(c, "<i8") for c in pdf["counts"])
    return pd.DataFrame({"seg": [int(pdf["seg"].iloc[0])], "counts": [np.asarray(total, "<i8").tobytes()]})


def common_levels(texts: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each sketch cell are, as bits of their count, over all texts. Fixed size."""
    cells = texts.mapInArrow(tidy(_sketch(k)), "seg int, counts binary").groupBy("seg").applyInPandas(_add, "seg int, counts binary")
    rows = sorted((r.seg, r.counts) for r in cells.collect())
    if not rows:
        return np.zeros(SKETCH, np.uint8)
    return np.frexp(np.frombuffer(b"".join(bytes(c) for _, c in rows), "<i8").astype(float))[1].astype(np.uint8)


def _index(k: int, pct: int, levels: np.ndarray):
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for s, e in slices(b.column(1)):
                ids = b.column(0).slice(s, e - s)
                n, s1, s2, vec, prefix = [], [], [], [], []
                for x, known in zip(shingle_sets(b.column(1).slice(s, e - s), k), ids.is_valid().to_pylist(), strict=True):
                    one, two = signature(x)
                    n.append(len(x))
                    s1.append(one)
                    s2.append(two)
                    if not known or not len(x) or int(one) in seen:  # links with nothing, or a copy's prefix is here already
                        vec.append(None)
                        prefix.append(None)
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(int(one))
                    vec.append(group_counts(x))
                    m = n_prefix(len(x), pct)
                    level = levels[(x & np.uint64(SKETCH - 1)).astype(np.int64)]
                    order = np.argsort(level, kind="stable")[:m]
                    prefix.append(x[order].view(np.int64))
                u = lambda v: np.array(v, np.uint64).view(np.int64)
                yield to_batch(_NODE_SCHEMA, [ids, np.array(n, np.int32), u(s1), u(s2), pa.array(vec, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))])

    return run


_MEET = "a long, b long, n int, p int, kind int"
_MEET_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("p", pa.int32()), ("kind", pa.int32())])


#: Odd multipliers, each an order of set ids, and their inverses.
_ORDERS = [(np.uint64(x), np.uint64(pow(x, -1, 1 << 64))) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _pivot_pairs(h, n, s, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (h, n) with the pivots of their runs, the smaller id of each pair first."""
    size = np.floor(np.log(n) / np.log(100 / pct))
    begins = np.ones(len(h), bool)
    begins[1:] = (h[1:] != h[:-1]) | (size[1:] != size[:-1])
    run_of, at = np.cumsum(begins) - 1, np.flatnonzero(begins)
    pivots = [(np.minimum.reduceat(s.view(np.uint64) * m, at) * inv).view(np.int64)[run_of] for m, inv in _ORDERS]
    lead, member = np.concatenate(pivots), np.tile(s, len(pivots))
    return np.minimum(lead, member), np.maximum(lead, member)


def _counted(pairs: dict) -> pa.RecordBatch:
    a, b = np.array(list(pairs), np.int64).reshape(-1, 2).T
    zeros = np.zeros(len(a), np.int32)
    return to_batch(_MEET_SCHEMA, [a, b, np.array(list(pairs.values()), np.int32), zeros, zeros])


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(h)))


def partnered(h, n, p, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (h, n) that have a partner of fitting size; where few meet, of fitting position too, with slack and without."""
    out = np.zeros(len(h), bool)
    near = (h[1:] == h[:-1]) & (n[:-1] * 100 >= n[1:] * pct)
    out[1:] |= near
    out[:-1] |= near
    starts, sizes = _runs(h)
    out[np.repeat(sizes <= LEAF, sizes)] = False
    first = out.copy()
    for m in np.unique(sizes[(sizes > 1) & (sizes <= LEAF)]):
        left, right = np.triu_indices(m, 1)
        at = starts[sizes == m]
        for k in range(0, len(at), max(1, (1 << 18) // len(left))):
            run = at[k : k + max(1, (1 << 18) // len(left)), None]
            i, j = (run + left).reshape(-1), (run + right).reshape(-1)
            for slack, rows in ((True, out), (False, first)):
                ok = fit(n[i], p[i], n[j], p[j], pct, slack)
                rows[i[ok]] = rows[j[ok]] = True
    return out, first


def _meet(pct: int, hot: int, most: int = 1 << 20):
    """From rows (h, n << 32 | position, s1) sorted so: sets and the pivots of their size class at a shingle (kind 0: a, b, times), and rows with a partner (kind 1: h, s1, n, p; kind 2: those with one only because of the slack)
    and shingles with over hot rows (kind 3: h, rows).

    A class has one pivot for each of four fixed orders of set ids, so sets of one group of near copies meet the same few
    pivots at shingle after shingle. A shingle with over most rows goes on in pieces, all of whose rows stay.
    """

    def run(batches):
        pairs, rest, torn = {}, None, None

        def ended(h, x, s, whole):
            nonlocal pairs
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])  # the same set came from two tasks
            h, x, s = h[fresh], x[fresh], s[fresh]
            n, p = x >> 32, x & 0xFFFFFFFF
            out, first = partnered(h, n, p, pct)
            if whole is not None:
                out, first = out | (h == whole), first | (h == whole)
            h, n, p, s, first = h[out], n[out], p[out], s[out], first[out]
            if not len(h):
                return
            at, sizes = _runs(h)
            many = (sizes > hot) | (False if whole is None else h[at] == whole)
            if many.any():
                zeros = np.zeros(int(many.sum()), np.int32)
                yield to_batch(_MEET_SCHEMA, [h[at[many]], sizes[many], zeros, zeros, zeros + 3])
            a, b = _pivot_pairs(h, n, s, pct)
            for q in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
                pairs[q] = pairs.get(q, 0) + 1
            yield to_batch(_MEET_SCHEMA, [h, s, n.astype(np.int32), p.astype(np.int32), np.where(first, 1, 2).astype(np.int32)])
            if len(pairs) > 500_000:
                yield _counted(pairs)
                pairs = {}

        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows = rows if rest is None else [np.concatenate([p, q]) for p, q in zip(rest, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last shingle may go on in the next batch
            if cut:
                yield from ended(*(r[:cut] for r in rows), torn)
            rest = [r[cut:] for r in rows]
            if len(rest[0]) > most:
                torn = rest[0][0]
                yield from ended(*(r[:-1] for r in rest), torn)
                rest = [r[-1:] for r in rest]  # a copy of it may come first in the next batch
        if rest is not None:
            yield from ended(*rest, torn)
        if pairs:
            yield _counted(pairs)

    return run


def _bounded(i, j, n, p, v, pct: int, slack: bool = False):
    """The index pairs whose sizes, positions and summed minima allow the overlap, and those sums."""
    ok = fit(n[i], p[i], n[j], p[j], pct, slack)
    i, j = i[ok], j[ok]
    step = max(1, BLOCK_BYTES // (2 * v.shape[1] * v.itemsize))
    bound = np.concatenate([np.zeros(0, np.int64), *(np.minimum(v[i[s : s + step]], v[j[s : s + step]]).sum(axis=1, dtype=np.int64) for s in range(0, len(i), step))])
    ok = bound >= overlap(n[i], n[j], pct)
    return i[ok], j[ok], bound[ok]


def packed_leaves(v: np.ndarray, n: np.ndarray, at: np.ndarray):
    """Rows at, cut in two at the mean of the group of greatest spread until a leaf is small and its corner fits its points, or few are left."""
    todo = [at]
    while todo:
        at = todo.pop()
        x = v[at]
        if len(at) <= FEW or (len(at) <= LEAF and x.max(axis=0).sum(dtype=np.int64) <= 1.4 * n[at].max()):
            yield at
            continue
        spread = x.var(axis=0, dtype=np.float32)
        widest = int(np.argmax(spread))
        if spread[widest] == 0:  # equal points
            yield from (at[k : k + LEAF] for k in range(0, len(at), LEAF))
            continue
        low = x[:, widest] <= x[:, widest].mean()
        todo += [at[~low], at[low]]


class RTree:
    """Packed R-tree over count vectors: leaves of up to LEAF points that are close, nodes of FAN; boxes by their upper corner.

    Points of one large cluster have leaves of their own. seen counts the pairs of boxes, and of points, that were bounded.
    """

    def __init__(self, vec: np.ndarray, n: np.ndarray, p: np.ndarray, label: np.ndarray):
        _, of, sizes = np.unique(label, return_inverse=True, return_counts=True)
        large = np.flatnonzero(sizes > LEAF)
        own = [np.flatnonzero(of == k) for k in large]
        rest = np.flatnonzero(sizes[of] <= LEAF)
        leaves = [leaf for at in [*own, rest] if len(at) for leaf in packed_leaves(vec, n, at)]
        self.order = np.concatenate(leaves)
        self.vec, self.n, self.p, self.label = vec[self.order], n[self.order], p[self.order], label[self.order]
        self.levels, self.seen = [], [0, 0]
        top, low, high, cluster = self.vec, self.n, self.n, self.label
        cut = np.cumsum([0, *map(len, leaves)])[:-1]
        while True:
            ends = np.append(cut[1:], len(top))
            least, most = np.minimum.reduceat(cluster, cut), np.maximum.reduceat(cluster, cut)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            cluster = np.where(least == most, least, MIXED)
            self.levels.append((top, low, high, cluster, cut, ends))
            if len(top) == 1:
                break
            cut = np.arange(0, len(top), FAN)

    def _may_link(self, level, i, j, pct):
        """Pairs of boxes that can hold a pair: not of one cluster, sizes within the ratio, summed minima of the corners up to the overlap."""
        top, low, high, cluster = self.levels[level][:4]
        ok = (high[i] * 100 >= low[j] * pct) & (high[j] * 100 >= low[i] * pct) & ((cluster[i] != cluster[j]) | (cluster[i] == MIXED))
        at = np.flatnonzero(ok)
        step = max(1, BLOCK_BYTES // (2 * top.shape[1] * top.itemsize))
        for s in range(0, len(at), step):
            part = at[s : s + step]
            a, b = i[part], j[part]
            ok[part] = np.minimum(top[a], top[b]).sum(axis=1, dtype=np.int64) >= overlap(low[a], low[b], pct)
        self.seen[0] += len(at)
        return ok

    def pairs(self, pct: int, some: np.ndarray | None = None, slack: bool = False):
        """Index pairs with different labels whose vectors allow the overlap, and their bounds, in blocks. some: one of a pair at least is marked there."""
        mark = np.ones(len(self.n), bool) if some is None else some[self.order]

        def below(level, i, j):
            ok = self._may_link(level, i, j, pct)
            i, j = i[ok], j[ok]
            cut, ends = self.levels[level][4:]
            for s in range(0, len(i), 256):
                a, b = _crossed(cut, ends, i[s : s + 256], j[s : s + 256])
                if level:
                    yield from below(level - 1, a, b)
                    continue
                live = (a != b) & (self.label[a] != self.label[b]) & (mark[a] | mark[b])
                self.seen[1] += int(live.sum())
                a, b, bound = _bounded(a[live], b[live], self.n, self.p, self.vec, pct, slack)
                yield self.order[a], self.order[b], bound

        root = np.zeros(1, np.int64)
        yield from below(len(self.levels) - 1, root, root)


def _crossed(cut, ends, i, j):
    """Pairs a <= b of each child of node i with each child of node j, for pairs of nodes i <= j."""
    m_i, m_j = ends[i] - cut[i], ends[j] - cut[j]
    total = m_i * m_j
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    m = np.repeat(m_j, total)
    a, b = np.repeat(cut[i], total) + k // m, np.repeat(cut[j], total) + k % m
    return a[a <= b], b[a <= b]


def _tree_pairs(pct: int, pick, slack: bool = False):
    """(a, b, n_a, n_b, times) from rows (h, n, p, s1, c, vec) sorted by h: pairs of different clusters that pick lets through, and at how many shingles they met."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("times", pa.int32())])

    def run(batches):
        found, size, rest = [], 0, None

        def summed():
            pairs, times = np.unique(np.concatenate(found), return_counts=True)
            return to_batch(schema, [pairs["a"], pairs["b"], pairs["n_a"].astype(np.int32), pairs["n_b"].astype(np.int32), times.astype(np.int32)])

        def ended(h, n, p, s, c, v):
            nonlocal found, size
            for i, j, _ in pick(h, n, p, c, v, pct, slack):
                i, j = np.where(s[i] < s[j], i, j), np.where(s[i] < s[j], j, i)
                found.append(np.rec.fromarrays([s[i], s[j], n[i], n[j]], names="a,b,n_a,n_b"))
                size += len(i)
                if size > 500_000:
                    yield summed()
                    found, size = [], 0

        for x in batches:
            if not x.num_rows:
                continue
            rows = [x.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            rows = [rows[0], rows[1].astype(np.int64), rows[2].astype(np.int64), *rows[3:], np.array([*x.column(5).to_pylist(), None], object)[:-1]]
            rows = rows if rest is None else [np.concatenate([p, q]) for p, q in zip(rest, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last shingle may go on in the next batch
            rest = [r[cut:] for r in rows]
            if cut:
                yield from ended(*(r[:cut] for r in rows))
        if rest is not None:
            yield from ended(*rest)
        if found:
            yield summed()

    return run


def _pairs_by_shingle(h, n, p, c, v, pct, slack):
    """Index pairs of each shingle's rows, compared over as many groups as the smaller set's octave has."""
    level = octave(n)
    for bits in np.unique(level):
        own = level == bits
        near = own | ((level == bits + 1) & (n * pct < 100 << (bits + 1)))  # others are too large for any of these
        at = np.flatnonzero(near)
        starts, sizes = _runs(h[at])
        keep = np.repeat((np.add.reduceat(own[at], starts) > 0) & (sizes > 1), sizes)
        at = at[keep]
        starts, sizes = _runs(h[at])
        if not len(at):
            continue
        ends = starts + sizes
        most, begin = max(1, BLOCK_BYTES >> (bits + 1)), 0  # rows at once
        while begin < len(starts):
            end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + most, side="right")))
            part = at[starts[begin] : ends[end - 1]]
            vec = _common(v[part], level[part], int(bits))
            for i, j, bound in _pairs_of_runs(sizes[begin:end], n[part], p[part], c[part], vec, own[part], pct, slack):
                yield part[i], part[j], bound
            begin = end


def _common(v, level, bits: int) -> np.ndarray:
    fine = level > bits
    coarse = unpacked(v[~fine].tolist(), bits) if not fine.all() else np.zeros((0, 1 << bits), np.uint8)
    extra = folded(unpacked(v[fine].tolist(), bits + 1)) if fine.any() else np.zeros((0, 1 << bits), np.uint8)
    out = np.zeros((len(v), 1 << bits), np.promote_types(coarse.dtype, extra.dtype))
    out[~fine], out[fine] = coarse, extra
    return out


def _pairs_of_runs(sizes, n, p, c, v, own, pct, slack):
    """Index pairs in runs of rows: runs that are one node many at once, larger ones by a tree."""
    starts = np.cumsum(sizes) - sizes
    for m in np.unique(sizes[sizes > 1]):
        at = starts[sizes == m]
        if m > ONE_NODE:
            for s in at:
                label = c[s : s + m]
                if (label != label[0]).any():
                    for i, j, bound in RTree(v[s : s + m], n[s : s + m], p[s : s + m], label).pairs(pct, own[s : s + m], slack):
                        yield i + s, j + s, bound
            continue
        left, right = np.triu_indices(m, 1)
        for k in range(0, len(at), max(1, (1 << 16) // len(left))):
            first = at[k : k + max(1, (1 << 16) // len(left)), None]
            i, j = (first + left).reshape(-1), (first + right).reshape(-1)
            live = (c[i] != c[j]) & (own[i] | own[j])
            yield _bounded(i[live], j[live], n, p, v, pct, slack)


def _nearest(h, n, p, c, v, pct, slack):
    """For each row the partner of another cluster with the largest bound at that shingle, once per pair."""
    best, partner = np.zeros(len(h), np.int64), np.full(len(h), -1)
    for i, j, bound in _pairs_by_shingle(h, n, p, c, v, pct, slack):
        i, j, bound = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(bound, 2)
        order = np.argsort(bound, kind="stable")
        order = order[bound[order] > best[i[order]]]
        best[i[order]], partner[i[order]] = bound[order], j[order]
    i = np.flatnonzero(partner >= 0)
    yield i, partner[i], best[i]


def _verified(k: int, pct: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for x in batches:
            ids = [x.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            for s, e in slices(x.column(2), 1 << 20):
                left, right = (shingle_sets(x.column(i).slice(s, e - s), k) for i in (2, 3))
                ok = np.zeros(e - s, bool)
                for r, (p, q) in enumerate(zip(left, right, strict=True)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok[r] = both > 0 and 100 * both >= pct * (len(p) + len(q) - both)
                yield to_batch(schema, [ids[0][s:e][ok], ids[1][s:e][ok]])

    return run


def verified(pairs: DataFrame, docs: DataFrame, k: int, pct: int) -> DataFrame:
    """The pairs (a, b: doc ids) whose whole texts link."""
    few = narrowed(docs, "doc_id", pairs.select("a").union(pairs.select("b")), 2 * pairs.count())
    text = lambda to, name: few.select(F.col("doc_id").alias(to), text_or_empty().alias(name))
    both = pairs.join(text("a", "ta"), "a").join(text("b", "tb"), "b")
    with small_batches(docs.sparkSession, 256):
        return stored(both.select("a", "b", "ta", "tb").mapInArrow(tidy(_verified(k, pct)), "a long, b long"), "ngram-verified")


def in_cells(rows: DataFrame, pct: int, hot: int) -> DataFrame:
    """rows (h, n, p, s1, c, m: rows of h) with a cell: 0, but for shingles of over hot rows a pair of blocks of about hot rows.

    Blocks hold one size class; the row comes in each cell whose other block's sizes can link with its own.
    """
    size = F.floor(F.log(F.col("n") + 0.5) / F.log(F.lit(100 / pct))).cast("int")  # partners lie in the same class or the next
    block = F.pmod(F.xxhash64("s1"), F.ceil(F.col("m") / hot)).cast("int")
    dealt = rows.filter(F.col("m") > hot).withColumns({"size": size, "block": block})
    others = f"flatten(transform(array(-1, 0, 1), d -> transform(sequence(0, cast(ceil(m / {hot}) as int) - 1), b -> struct(size + d as size, b as block))))"
    dealt = dealt.withColumn("other", F.explode(F.expr(others)))
    me = F.struct("size", "block")
    cell = F.xxhash64(F.least(me, F.col("other")), F.greatest(me, F.col("other")))
    whole = rows.filter(F.col("m") <= hot).withColumn("cell", F.lit(0).cast("long")).drop("m")
    return whole.unionByName(dealt.withColumn("cell", F.when(cell == 0, 1).otherwise(cell)).select(*whole.columns))


def ngram_groups(docs: DataFrame, k: int = 5, pct: int = 75, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles (size of the set of k-word shingles) and component_id of every row of docs.

    Two texts link at Jaccard >= pct/100, or with the same non-empty set. component_id is the smallest doc_id reachable
    by links, itself included. Null and empty texts have no shingles and link with nothing. Rows without doc_id have no
    component. Rows that share a doc_id should be the same text; if not, each is linked by its own.
    """
    if not 50 <= pct <= 100:
        raise ValueError("pct is 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(docs.sparkSession):
        levels = docs.sparkSession.sparkContext.broadcast(common_levels(docs.select("text"), k))  # SKETCH bytes
        nodes = stored(docs.mapInArrow(tidy(lambda it: _index(k, pct, levels.value)(it)), _NODES), "ngram-nodes")
    sets = nodes.filter("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("vec").alias("vec"), F.max("n").alias("n"))
    sets = stored(sets, "ngram-sets")
    rows = nodes.filter("doc_id is not null").select(F.posexplode("prefix").alias("p", "h"), "n", "s1")
    rows = rows.select("h", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("p").cast("long")).alias("x"), "s1")
    met = stored(rows.repartition("h").sortWithinPartitions("h", "x", "s1").mapInArrow(tidy(_meet(pct, hot)), _MEET), "ngram-met")

    rep = lambda c: sets.select(F.col("s1").alias(f"s_{c}"), F.col("rep").alias(c))
    named = lambda q: q.select(F.col("a").alias("s_a"), F.col("b").alias("s_b")).join(rep("a"), "s_a").join(rep("b"), "s_b").select("a", "b")
    least = F.expr(f"1 + floor(ceil(n * {pct} / 100) / {SLACK})")  # prefix rows that any partner shares

    def often(met_pairs):  # partners that met at few shingles wait for the tree
        times = met_pairs.groupBy("a", "b").agg(F.sum("n").alias("times"))
        return named(times.join(sets.select(F.col("s1").alias("b"), "n"), "b").filter(F.col("times") * 20 >= F.col("n")))

    pairs = stored(often(met.filter("kind = 0")), "ngram-pivots")
    links = verified(pairs, docs, k, pct)
    crowded = met.filter("kind = 3").groupBy(F.col("a").alias("h")).agg(F.sum("b").alias("m"))
    slack = crowded.limit(1).count() > 0
    rows = met.filter("kind in (1, 2)").select(F.col("a").alias("h"), F.col("b").alias("s1"), "n", "p", "kind")
    mine = Window.partitionBy("s1")
    if slack:  # a set with fewer than least rows of crowded shingles shares a row of another with every partner
        rows = rows.join(crowded, "h", "left").withColumns({"met": F.count("*").over(mine), "hot": F.count("m").over(mine)})
        rows = rows.filter((F.col("met") >= least) & (F.col("m").isNull() | (F.col("hot") >= least)))
    else:
        rows = rows.withColumn("met", F.count("*").over(mine)).filter((F.col("met") >= least) & (F.col("kind") == 1))
    rows = stored(rows.select("h", "s1", "n", "p"), "ngram-rows")
    discard(met, pairs)

    def by_tree(pick, least_rows: int, name: str):
        """Pairs of different clusters from the trees at the shingles where at least so many sets of several clusters meet."""
        cluster = components(links)
        labels = sets.join(cluster.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "vec", F.coalesce("component", "rep").alias("c"))
        labels = stored(labels, "ngram-labels")
        here = stored(rows.join(labels.select("s1", "c"), "s1").select("h", "n", "p", "s1", "c"), "ngram-open")
        split = stored(here.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).filter(F.expr("lo < hi") & (F.col("m") >= least_rows)).select("h", "m"), "ngram-split")
        if split.filter(F.col("m") > hot).limit(1).count():
            shared = in_cells(here.join(split, "h"), pct, hot)
        else:
            shared = here.join(split.select("h"), "h", "left_semi").withColumn("cell", F.lit(0).cast("long"))
        # a cell of a hot shingle is a shingle of its own from here on
        dealt = shared.join(labels.select("s1", "vec"), "s1").withColumn("h", F.when(F.col("cell") == 0, F.col("h")).otherwise(F.xxhash64("h", "cell"))).drop("cell")
        dealt = dealt.select("h", "n", "p", "s1", "c", "vec").repartition("h").sortWithinPartitions("h", "n", "s1")
        pairs = dealt.mapInArrow(tidy(_tree_pairs(pct, pick, slack)), "a long, b long, n_a int, n_b int, times int")
        out = stored(pairs.groupBy("a", "b").agg(F.sum("times").alias("times")), name)
        discard(here, split, labels)
        return out

    # nearest partners first where many meet, the one that a set met most: large groups of near copies are one cluster before all their
    # pairs are asked for
    met_most = by_tree(_nearest, LEAF + 1, "ngram-nearest").select(F.explode(F.expr("array(struct(a as s, a, b, times), struct(b as s, a, b, times))")).alias("x")).groupBy("x.s")
    nearest = met_most.agg(F.max_by(F.struct("x.a", "x.b"), F.struct("x.times", "x.a", "x.b")).alias("y")).select("y.*").distinct()
    links = links.unionByName(verified(stored(named(nearest), "ngram-near"), docs, k, pct))
    left = by_tree(_pairs_by_shingle, 2, "ngram-left")
    linked = components(links.unionByName(verified(stored(named(left), "ngram-rest"), docs, k, pct)))

    final = sets.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    final = stored(final, "ngram-final")
    known = nodes.filter("n > 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "s1", "s2").join(final, ["s1", "s2"], "left")
    known = known.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return known.unionByName(nodes.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
