"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def absorb(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i] in parent, where each node points at the smallest of its component."""
    while True:
        pa, pb = parent[a], parent[b]
        live = pa != pb
        if not live.any():
            return
        a, b, pa, pb = a[live], b[live], pa[live], pb[live]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the edges but those smallest ones."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    absorb(parent, inverse[: len(u)], inverse[len(u) :])
    own = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[own], nodes[parent[own]]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of edges (u, v) but the roots themselves.

    Nodes are longs. A node with very many edges does no harm: minima are aggregated before the shuffle and the
    join back is one that Spark splits. Every round is written to the scratch folder and the one before deleted.
    Edges from a node to itself and repeated edges count for nothing; null nodes are not allowed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b"))
        if large:
            both = both.union(e.select("v", "u"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if large:  # every larger neighbour now hangs on the smallest
            return joined.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        return joined.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select("a", "m")).where("u > v").distinct()

    now = scratch.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        after = scratch.keep(star(star(now, True), False), "edges")
        got = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if tuple(got) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(got)
