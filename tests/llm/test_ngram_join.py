"""The n-gram join against brute force on groups that meet at crowded shingles, and its R-tree."""

import numpy as np
import pytest

from pageloom.llm import ngram_join as nj


def by_force(sets, pct=75):
    low = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]) and sets[i] and sets[j]]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return low


def family(r, size, n, edits, tag):
    """Texts of n words of which some are replaced, so that a word stands for five shingles."""
    base = [f"{tag}{i}" for i in range(n)]
    for _ in range(size):
        words = list(base)
        for at in r.integers(0, n, r.integers(0, edits + 1)):
            words[at] = f"x{r.integers(0, 1 << 30)}"
        yield words[: n - r.integers(0, n // 8)]


@pytest.mark.parametrize("hot", [nj.HOT, 6])
def test_groups_against_force(spark, hot):
    r = np.random.default_rng(11)
    common = [f"c{i}" for i in range(60)]
    texts = [w for t, (size, n, e) in enumerate([(60, 150, 6), (40, 70, 3), (30, 400, 12), (25, 130, 8)]) for w in family(r, size, n, e, "abcd"[t])]
    texts += [common + [f"own{i}-{k}" for k in range(r.integers(3, 60))] for i in range(60)]  # one passage in all of them
    texts += [[f"s{i % 7}"] * 3 for i in range(20)] + [[], common, common[:50]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in texts]
    want = by_force(sets)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in nj.ngram_groups(df, hot=hot).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def vectors(r, kinds, each, n, change):
    """Sets of n hashes in kinds; those of a kind share all but a few."""
    out = []
    for _ in range(kinds):
        base = r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
        for _ in range(each):
            s = base.copy()
            s[r.choice(n, change, replace=False)] = r.integers(0, 1 << 63, change, dtype=np.uint64) << np.uint64(1)
            out.append(np.unique(s))
    return out


def test_tree_prunes_and_misses_nothing():
    r = np.random.default_rng(4)
    sets = vectors(r, 60, 40, 300, 20)
    r.shuffle(sets)
    n = np.array([len(s) for s in sets])
    bits = int(nj.octave(n).min())
    v = nj.unpacked([nj.group_counts(s) for s in sets], bits)
    p, label = np.zeros(len(n), np.int64), np.arange(len(n))
    tree = nj.RTree(v, n, p, label)
    got = {(min(a, b), max(a, b)) for i, j, _ in tree.pairs(75) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = set()
    for i in range(len(n)):
        bound = np.minimum(v[i], v[:i]).sum(axis=1, dtype=np.int64)
        want |= {(int(j), i) for j in np.flatnonzero(bound >= nj.overlap(n[i], n[:i], 75))}
    assert got == want and len(want) >= 60 * 40 * 39 // 2
    points = len(n) * (len(n) - 1) // 2
    assert sum(tree.seen) < 0.2 * points  # boxes save four fifths of the bounds, their own included


@pytest.mark.parametrize("n", [1, 63, 64, 200, 5000])
def test_vectors_pack_and_fold(n):
    r = np.random.default_rng(n)
    s = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
    skewed = np.unique(np.concatenate([s, np.arange(40, dtype=np.uint64)]))
    for x in (s, skewed):
        bits = int(nj.octave(len(x)))
        v = nj.unpacked([nj.group_counts(x)], bits)
        assert v.sum() == len(x) and (v[0] == np.bincount((x >> np.uint64(64 - bits)).astype(int), minlength=1 << bits)).all()
        assert (nj.folded(v)[0] == np.bincount((x >> np.uint64(65 - bits)).astype(int), minlength=1 << bits - 1)).all()
