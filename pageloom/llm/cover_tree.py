"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Unit vectors within a label are held in nested levels of nodes, a centre and the
radius that covers its members, radii halving from level to level. Two nodes can
hold a pair only if their centres are no further apart than both radii and the
threshold distance. The upper levels are DataFrames: nodes over LEAF vectors are
split, surviving node pairs are followed to their children. Pairs of nodes that
fit in a task are traversed there, down to single vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import stored, tidy, to_batch
from pageloom.llm.components import components, forest

#: Vectors of a task's node, most children of a node that is split, rows of a leaf, centres tried at once, leaf pairs that go alone.
LEAF, PIVOTS, SMALL, BLOCK, WIDE, SLACK = 4096, 32, 32, 256, 512, 1e-7


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link: with label, vector and vec_id, finite components, and a length."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    long = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0
    return vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & e.isNotNull() & fine & long)


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, np.float64) for r in rows])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def reach(threshold: float) -> float:
    """Distance of unit vectors at that cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * dot))


class Node:
    """Rows within radius of a centre; children are a net of at most half that radius, leaves hold SMALL rows or equal ones."""

    __slots__ = ("centre", "radius", "rows", "children", "centres", "radii")

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: int, radius: float):
        self.centre, self.rows, self.children = centre, rows, []
        self.radius = float(_distance(x[rows] @ x[centre]).max())
        if len(rows) <= SMALL or self.radius <= SLACK:
            return
        half = min(radius, self.radius) / 2
        left = np.concatenate([[centre], rows[rows != centre]])
        while len(left):  # a block of candidates at a time: each that no earlier centre covers is one, and takes what it covers
            block = left[:BLOCK]
            to = _distance(x[left] @ x[block].T)
            near, centres = to <= half, []
            for k in range(len(block)):
                if not near[k, centres].any():
                    near[k, k] = True
                    centres.append(k)
            own = np.argmin(np.where(near[:, centres], to[:, centres], np.inf), axis=1)
            taken = near[:, centres].any(axis=1)
            own[centres] = np.arange(len(centres))
            order = np.flatnonzero(taken)[np.argsort(own[taken], kind="stable")]
            for k, part in zip(centres, np.split(left[order], np.cumsum(np.bincount(own[taken], minlength=len(centres)))[:-1]), strict=True):
                self.children.append(Node(x, part, int(block[k]), half))
            left = left[~taken]
        self.centres = np.array([c.centre for c in self.children])
        self.radii = np.array([c.radius for c in self.children])


def _leaf_pairs(x: np.ndarray, pairs: list, threshold: float):
    """Index pairs with cosine >= threshold between pairs of leaves: small ones many at once, large ones as a product each."""
    some, size = [], 0
    for p, q in [*pairs, (None, None)]:
        n = len(p.rows) * len(q.rows) if p else 0
        if n >= WIDE:
            i, j = np.nonzero(x[p.rows] @ x[q.rows].T >= threshold)
            i, j = p.rows[i], q.rows[j]
            keep = i < j if p is q else np.ones(len(i), bool)
            yield i[keep], j[keep]
            continue
        if p:
            some.append((p, q))
            size += n
        if some and (not p or size > 1 << 15):
            i = np.concatenate([np.repeat(a.rows, len(b.rows)) for a, b in some])
            j = np.concatenate([np.tile(b.rows, len(a.rows)) for a, b in some])
            once = np.concatenate([np.full(len(a.rows) * len(b.rows), a is b) for a, b in some])
            keep = ~once | (i < j)
            i, j = i[keep], j[keep]
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            yield i[ok], j[ok]
            some, size = [], 0


def dual(x: np.ndarray, a: Node, b: Node, eps: float, threshold: float):
    """Index pairs with cosine >= threshold between the nodes, in blocks (each once; i < j if a is b)."""
    stack, leaves, held = [(a, b)], [], 0
    while stack:
        p, q = stack.pop()
        if not p.children and not q.children:
            leaves.append((p, q))
            held += len(p.rows) * len(q.rows)
            if held > 1 << 20:
                yield from _leaf_pairs(x, leaves, threshold)
                leaves, held = [], 0
            continue
        down = lambda n, other: n.children and (not other.children or n.radius >= other.radius or other.radius > n.radius / 2)
        p_kids, q_kids = (p.children, q.children) if p is q else (p.children if down(p, q) else [p], q.children if down(q, p) else [q])
        centres = lambda n, kids: (n.centres, n.radii) if kids is n.children else (np.array([n.centre]), np.array([n.radius]))
        (pc, pr), (qc, qr) = centres(p, p_kids), centres(q, q_kids)
        for s in range(0, len(pc), BLOCK):
            far = _distance(x[pc[s : s + BLOCK]] @ x[qc].T)
            i, j = np.nonzero(far <= pr[s : s + BLOCK, None] + qr + (eps + SLACK))
            i += s
            if p is q:
                i, j = i[i <= j], j[i <= j]
            stack += [(p_kids[u], q_kids[v]) for u, v in zip(i.tolist(), j.tolist(), strict=True)]
    yield from _leaf_pairs(x, leaves, threshold)


def _split(eps: float):
    """Children of one level: pivots of a node and the nearest of them for each vector."""

    def run(batches):
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("node", pa.string()), ("n", pa.int64()), ("embedding", pa.list_(pa.float32())), ("radius", pa.float64()), ("centre", pa.list_(pa.float64()))])
        for b in batches:
            pdf = b.to_pandas()
            nodes, radii, centres = [], [], []
            x = unit(pdf["embedding"])
            for k, (node, piv) in enumerate(zip(pdf["node"], pdf["pivots"], strict=True)):
                if piv is None:
                    nodes.append(node)
                    radii.append(None)
                    centres.append(None)
                    continue
                p = np.frombuffer(piv, "<f8").reshape(-1, x.shape[1])
                d = np.sqrt(np.maximum(0, 2 - 2 * (p @ x[k])))
                at = int(np.argmin(d))
                nodes.append(f"{node}.{at}")
                radii.append(float(d[at]))
                centres.append(p[at].tolist())
            yield to_batch(schema, [b.column("vec_id"), b.column("label"), nodes, b.column("n"), b.column("embedding").cast(pa.list_(pa.float32())), radii, pa.array(centres, pa.list_(pa.float64()))])

    return run


def _pick_pivots(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy net over a node's bounded sample: farthest first, so that radii fall as fast as they can.

    As many as give nodes of about half a leaf: a vector is sent once for each node that its own can link with.
    """
    x = unit(pdf.sort_values("vec_id")["embedding"])
    want = min(PIVOTS, int(pdf["want"].iloc[0]), len(x))
    chosen, dist = [0], np.full(len(x), np.inf)
    while len(chosen) < want:
        dist = np.minimum(dist, 2 - 2 * (x @ x[chosen[-1]]))
        at = int(np.argmax(dist))
        if dist[at] <= SLACK:
            break
        chosen.append(at)
    return pd.DataFrame({"node": [key[0]], "pivots": [x[chosen].astype("<f8").tobytes()]})


def tree_nodes(points: DataFrame, leaf: int, eps: float) -> tuple[DataFrame, list[DataFrame]]:
    """points with their leaf node, and the table of nodes of each level (node, parent, radius, centre)."""
    points = points.withColumn("node", F.col("label").cast("string"))
    levels = []
    for _ in range(24):
        sizes = stored(points.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > leaf), "cover-large")
        if sizes.isEmpty():
            break
        # at most a few hundred vectors a node, by hash, as candidates for its centres
        share = F.least(F.lit(1.0), F.lit(256.0) / F.col("size"))
        sample = points.join(sizes, "node").filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("node", "vec_id", "embedding", F.ceil(F.col("size") * 2 / leaf).alias("want"))
        pivots = stored(sample.groupBy("node").applyInPandas(_pick_pivots, "node string, pivots binary"), "cover-pivots")
        # vectors of a node are many and its pivots one row: salt both sides
        salts = 16
        spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = points.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
        split = salted.join(spread, ["node", "salt"], "left").select("vec_id", "label", "node", "n", "embedding", "pivots")
        split = stored(split.mapInArrow(tidy(_split(eps)), "vec_id long, label long, node string, n long, embedding array<float>, radius double, centre array<double>"), "cover-level")
        kids = split.filter("radius is not null").groupBy("node").agg(F.max("radius").alias("radius"), F.first("centre").alias("centre"))
        levels.append(stored(kids.withColumn("parent", F.regexp_replace("node", r"\.[0-9]+$", "")), "cover-nodes"))
        points = split.drop("radius", "centre")
    # what no centre splits is cut by hash, so that a task stays bounded
    sizes = stored(points.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > leaf), "cover-rest")
    points = points.join(sizes, "node", "left").withColumn("part", F.when(F.col("size").isNotNull(), F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("size") / leaf))).otherwise(0).cast("long"))
    return stored(points.drop("size"), "cover-points"), levels


def node_pairs(points: DataFrame, levels: list[DataFrame], eps: float) -> DataFrame:
    """Pairs (a, b) of leaf nodes that the bounds let through, from the roots down."""
    pairs = points.select(F.col("label").cast("string").alias("a")).distinct().withColumn("b", F.col("a"))
    far = F.sqrt(F.aggregate(F.zip_with("ca", "cb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    for kids in levels:
        side = lambda c: kids.select(F.col("parent").alias(c), F.col("node").alias(f"{c}_kid"), F.col("radius").alias(f"r{c}"), F.col("centre").alias(f"c{c}"))  # noqa: E731, B023
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        known = F.col("ra").isNotNull() & F.col("rb").isNotNull()
        both = both.filter(~known | (far <= F.col("ra") + F.col("rb") + eps + SLACK))
        a, b = F.coalesce("a_kid", "a"), F.coalesce("b_kid", "b")
        pairs = stored(both.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "cover-pairs")
    return pairs


_LINKS = "vec_id long, n_links long, root long"


def _traverse(threshold: float):
    eps = reach(threshold)

    def run(_key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["vec_id", "side"]).sort_values(["vec_id", "side"]).reset_index(drop=True)
        x, ids, n, side = unit(pdf["embedding"]), pdf["vec_id"].to_numpy(), pdf["n"].to_numpy(), pdf["side"].to_numpy()
        rows = [np.flatnonzero(side == s) for s in (0, 1)]
        rows = [r for r in rows if len(r)]
        trees = [Node(x, r, int(r[0]), 2.0) for r in rows]
        links, a, b = np.zeros(len(x), np.int64), [], []
        ends = (trees[0], trees[-1]) if pdf["pair"].iloc[0] else (trees[0], trees[0])
        if pdf["pair"].iloc[0] and len(trees) < 2:
            ends = None
        for i, j in dual(x, *ends, eps, threshold) if ends else ():
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            if len(i):
                nodes, root = forest(ids[i], ids[j])
                a.append(nodes)
                b.append(root)
        out = pd.DataFrame({"vec_id": ids, "n_links": links, "root": ids})
        if a:
            nodes, root = forest(np.concatenate(a), np.concatenate(b))
            out["root"] = out["vec_id"].map(dict(zip(nodes.tolist(), root.tolist(), strict=True))).fillna(out["vec_id"]).astype("int64")
        return out[(out["n_links"] > 0) | (out["root"] != out["vec_id"])]

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, label, embedding).

    Vectors link at a cosine of threshold or more, within a label. Equal vectors are one point of the tree and count each
    other; an unusable row (no label or vector, a null, infinite or NaN component, length zero) links with nothing.
    Vectors of different length in one label never meet. Rows without vec_id have no component and are not kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    good = usable(rows)
    points = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    points = stored(points.withColumn("dim", F.size("embedding")), "cover-distinct")
    dims = [r.dim for r in points.select("dim").distinct().collect()]
    found = None
    for dim in dims:
        leaves, levels = tree_nodes(points.filter(F.col("dim") == dim).select("vec_id", "label", "embedding", "n"), leaf, reach(threshold))
        pairs = node_pairs(leaves, levels, reach(threshold))
        parts = stored(leaves.select("node", "part").distinct(), "cover-parts")
        side = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))  # noqa: E731, B023
        units = pairs.join(side("a"), "a").join(side("b"), "b").filter("a <> b or pa <= pb")
        units = stored(units.withColumn("unit", F.concat_ws("|", "a", "pa", "b", "pb")), "cover-units")
        single = (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb"))
        ends = units.select("unit", F.col("a").alias("node"), F.col("pa").alias("part"), F.lit(0).alias("side"), (~single).alias("pair"))
        ends = ends.unionByName(units.filter(~single).select("unit", F.col("b").alias("node"), F.col("pb").alias("part"), F.lit(1).alias("side"), F.lit(True).alias("pair")))
        members = leaves.join(ends, ["node", "part"]).select("unit", "side", "pair", "vec_id", "n", "embedding")
        some = members.groupBy("unit").applyInPandas(_traverse(threshold), _LINKS)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], _LINKS)
    found = stored(found, "cover-links")
    linked = components(found.filter("vec_id <> root").select("vec_id", "root"))
    totals = found.groupBy("vec_id").agg(F.sum("n_links").alias("links"))
    per_point = points.join(totals, "vec_id", "left").join(linked.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    per_point = stored(per_point.select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")), "cover-final")
    linked_rows = good.join(per_point, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.join(good.select(F.col("vec_id").alias("_v")).distinct(), F.col("vec_id") == F.col("_v"), "left_anti")
    out = linked_rows.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
