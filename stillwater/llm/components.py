"""Connected components of a link table: forests within partitions, then alternating large and small stars, on DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm.common import cut

#: Links that a task joins up by itself.
FOREST = 500_000
#: Nodes, two numbers each, that are broadcast to a join; beyond, rows are joined by shuffling.
BROADCAST_NODES = 250_000


def least_nodes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and the least node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low != high
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[apart], low[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links, replaced by one from each node to the least that it reaches within the partition."""
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if rows:
        node, root = least_nodes(*(np.concatenate(c) for c in zip(*rows, strict=True)))
        moved = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's links moved to its least neighbour: the larger ones (large star) or the smaller ones and the node (small star)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def roots(edges: DataFrame, most: int = 60, forest: int = FOREST) -> DataFrame:
    """node, root: the least node reachable, for every node of ``edges`` (a, b: long) that is not its own root.

    Links lie in as many partitions as there are ``forest`` of them; each is first joined up within its task, so that what
    the stars shuffle is a row a node and partition. Where one partition holds all links, that is the answer.
    """
    now = cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    parts = max(1, math.ceil(now.count() / forest))
    now = cut(now.coalesce(parts).mapInArrow(_forest, "a long, b long"))
    sign = None
    for _ in range(most if parts > 1 else 0):
        now = cut(_star(_star(now, True), False))
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == sign:
            break
        sign = new
    else:
        if parts > 1:
            raise RuntimeError(f"components did not settle in {most} rounds")
    root = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return F.broadcast(root) if root.count() <= BROADCAST_NODES else root
