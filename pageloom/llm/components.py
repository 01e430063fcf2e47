"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import stored, tidy, to_batch

#: Links that one task may hold.
LOCAL_LINKS = 250_000
_SCHEMA = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links and the smallest node that it is linked with, over one or more links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            return nodes, nodes[root]


def _local(batches):
    a, b = [], []
    for x in batches:
        a.append(x.column(0).to_numpy(zero_copy_only=False))
        b.append(x.column(1).to_numpy(zero_copy_only=False))
    if a:
        yield to_batch(_SCHEMA, list(forest(np.concatenate(a), np.concatenate(b))))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over links (a < b): neighbours move to their smallest common neighbour."""
    both = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-low")
    moved = both.join(low, "u").filter(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        moved = moved.unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return stored(moved.filter("a < b").distinct(), "star")


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """node, component (smallest node reachable, itself included) for every node of links (two long columns).

    Tasks of bounded size first cut their links down to trees; if more than one task's worth is left, large-star and
    small-star steps follow until nothing moves. Nothing is collected. Self links and repeats don't matter.
    """
    x, y = links.columns[:2]
    links = links.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    links = stored(links, "links")
    n = links.count()
    parts = -(-n // local_links)
    if parts <= 1:
        return stored(links.repartition(1).mapInArrow(tidy(_local), "node long, component long"), "components")
    trees = links.repartition(parts).mapInArrow(tidy(_local), "node long, component long").select(F.col("component").alias("a"), F.col("node").alias("b"))
    links, before = stored(trees.filter("a < b").distinct(), "trees"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] <= local_links:
            found = stored(links.repartition(1).mapInArrow(tidy(_local), "node long, component long"), "components")
            break
        if now == before:
            found = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
            found = found.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
            break
        before = now
        links = _star(_star(links, True), False)
    return found
