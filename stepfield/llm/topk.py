"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are turned into integers. The top of the tree is spread over the cluster: up to `cells` centres, rows of a
bounded sample, and every row belongs to the nearest one. Below it trees are built in tasks: a task has a block of the
rows of one cell and a group of queries, builds a cover tree over both and searches them together. A pair of nodes
with centres a, b, covering radii ra, rb and largest norms ma, mb holds no score above the least of a.b + ra mb + rb |a|,
a.b + rb ma + ra |b| and ma mb; it is pruned where that is below the worst kth score of the node's queries.

Queries meet their own cell first. The kth scores that they find there prune pairs of cells, before any row is copied
for them, and are where the search in the other cells starts. What remains is compared exactly, and the winners meet
by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, ship

#: No vector's id: comes after all others.
NONE = np.iinfo(np.int64).max
#: Bytes of vectors, as 64-bit numbers, that a task holds of either side.
TASK_BYTES = 64 << 20


class Node:
    __slots__ = ("centre", "radius", "norm", "most", "children", "rows", "centres", "radii", "norms", "mosts", "worst")

    def __init__(self, points: np.ndarray, rows: np.ndarray, centre: np.ndarray, far: np.ndarray):
        self.centre, self.rows, self.radius = centre, rows, float(far.max(initial=0))
        self.norm = float(np.sqrt(centre @ centre))
        self.most = float(np.sqrt((points[rows] ** 2).sum(1).max(initial=0)))
        self.children: list[Node] = []
        self.worst = -np.inf

    def adopt(self, children: list[Node]) -> Node:
        self.children = children
        self.centres = np.stack([c.centre for c in children])
        self.radii, self.norms, self.mosts = (np.array([getattr(c, x) for c in children]) for x in ("radius", "norm", "most"))
        return self


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(1))


def cover_tree(points: np.ndarray, leaf: int, fan: int = 32) -> Node:
    """A cover tree, built from the top: children lie further apart than the radius that covers their points.

    A node's centres are taken farthest first until they cover its points within half its radius or there are `fan`.
    """

    def node(rows: np.ndarray, centre: np.ndarray, far: np.ndarray) -> Node:
        out = Node(points, rows, centre, far)
        if len(rows) <= leaf:
            return out
        if not out.radius:  # equal points, in order of their ids
            return out.adopt([Node(points, rows[at : at + leaf], centre, far[at : at + leaf]) for at in range(0, len(rows), leaf)])
        own = points[rows]
        near, of, centres = far, np.zeros(len(rows), np.int64), [centre]
        while len(centres) < fan and near.max() > out.radius / 2:
            centres.append(own[near.argmax()])
            d = distances(own, centres[-1])
            closer = d < near
            of[closer] = len(centres) - 1
            near = np.where(closer, d, near)
        parts = [(c, np.flatnonzero(of == i)) for i, c in enumerate(centres)]
        # Small children side by side become leaves around the node's own centre.
        loose = [p for _, p in parts if len(p) <= leaf // 4]
        children = [node(rows[p], c, near[p]) for c, p in parts if len(p) > leaf // 4]
        if loose:
            rest = np.sort(np.concatenate(loose))
            children += [Node(points, rows[p], centre, far[p]) for p in (rest[at : at + leaf] for at in range(0, len(rest), leaf))]
        return out.adopt(children)

    rows = np.arange(len(points))
    return node(rows, points[0], distances(points, points[0]))


def bounds(dots: np.ndarray, a: tuple, b: tuple) -> np.ndarray:
    """What no inner product exceeds of two balls, each (radius, norm of the centre, largest norm), given their centres' products."""
    (ra, na, ma), (rb, nb, mb) = a, b
    top = np.minimum(np.minimum(dots + ra * mb + rb * na, dots + rb * ma + ra * nb), ma * mb)
    return top + 1e-9 * np.abs(top) + 1e-6  # what rounding may take away


class Search:
    """best, owner: for each query its k highest scores and their ids. floor: scores that queries have already (kth, or lowest)."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, leaf: int = 512, floor: np.ndarray | None = None):
        largest = float(max(np.abs(queries).max(initial=0), np.abs(points).max(initial=0))) ** 2 * max(1, queries.shape[1])
        kind = np.float32 if largest < 2.0**23 else np.float64 if largest < 2.0**52 else np.int64  # sums stay exact
        self.low = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        order = np.argsort(ids, kind="stable")
        points, self.ids = points[order], ids[order]
        self.q, self.p, self.query_ids, self.k = queries.astype(kind), points.astype(kind), query_ids, k
        self.best = np.full((len(queries), k), self.low, kind)
        self.owner = np.full((len(queries), k), NONE)
        self.kth = np.full(len(queries), self.low, kind)
        if floor is not None:
            self.kth = np.maximum(self.kth, np.where(floor == np.iinfo(np.int64).min, self.low, floor.astype(kind)))
        self.own = bool(np.isin(query_ids, ids).any())
        self.compared = 0
        a, b = cover_tree(queries.astype(float), max(8, leaf // 4)), cover_tree(points.astype(float), leaf)
        self.settle(a)
        self.pair(a, b)

    def settle(self, a: Node) -> None:
        for c in a.children:
            self.settle(c)
        a.worst = self.kth[a.rows].min()

    def pair(self, a: Node, b: Node) -> None:
        if not b.children and not a.children:
            self.compare(a, b)
        elif not b.children or (a.children and a.radius > b.radius):
            one = (b.radius, b.norm, b.most)
            top = bounds(a.centres @ b.centre, one, (a.radii, a.norms, a.mosts))
            for c, t in zip(a.children, top.tolist(), strict=True):
                if t >= c.worst:
                    self.pair(c, b)
            a.worst = min(c.worst for c in a.children)
        else:
            dots = b.centres @ a.centre
            top = bounds(dots, (a.radius, a.norm, a.most), (b.radii, b.norms, b.mosts))
            for i in np.argsort(-dots, kind="stable").tolist():  # likely ones first
                if top[i] >= a.worst:
                    self.pair(a, b.children[i])

    def compare(self, a: Node, b: Node) -> None:
        """All pairs of two leaves, at once."""
        ids, k = self.ids[b.rows], self.k
        score = self.q[a.rows] @ self.p[b.rows].T
        self.compared += score.size
        if self.own:
            score[self.query_ids[a.rows][:, None] == ids[None, :]] = self.low
        kth = self.kth[a.rows]
        new = kth == self.low
        if new.any() and len(ids) > k:  # the leaf's own kth score
            kth[new] = np.partition(score[new], len(ids) - k, axis=1)[:, len(ids) - k]
        good = score > kth[:, None]
        equal = (score == kth[:, None]) & (score > self.low)
        if equal.any():  # of equal scores the smaller id wins
            good |= equal & (ids[None, :] < np.where(new, NONE, self.owner[a.rows, k - 1])[:, None])
        r, c = np.nonzero(good)
        if len(r):
            touched = np.unique(r)
            had = self.owner[a.rows[touched]]
            hr, hc = np.nonzero(had != NONE)
            row = np.concatenate([r, touched[hr]])
            s = np.concatenate([score[r, c], self.best[a.rows[touched]][hr, hc]])
            o = np.concatenate([ids[c], had[hr, hc]])
            order = np.lexsort((o, -s, row))
            row, s, o = row[order], s[order], o[order]
            first = np.concatenate([[True], row[1:] != row[:-1]])
            place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
            keep = place < k
            at = (a.rows[row[keep]], place[keep])
            self.best[at], self.owner[at] = s[keep], o[keep]
            self.kth[a.rows[touched]] = np.maximum(self.kth[a.rows[touched]], self.best[a.rows[touched], k - 1])
        a.worst = self.kth[a.rows].min()


def quantized(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(id long, v array<long>): floor(scale * x) of every component; rows with a null or non-finite part are gone."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~bad)
    return rows.select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def matrix(v: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(v, pa.ChunkedArray):
        v = v.combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), size)


def placed(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """rows (id, v, size) with the nearest centre of their length (0 where there is none), the distance to it and the norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                x = matrix(part.column("v"), size).astype(float)
                c = centres.get(size, np.zeros((1, size)))
                cell, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
                for at in range(0, len(x), 1024):
                    d = (x[at : at + 1024] ** 2).sum(1)[:, None] - 2 * x[at : at + 1024] @ c.T + (c**2).sum(1)
                    cell[at : at + 1024] = d.argmin(1)
                    dist[at : at + 1024] = distances(x[at : at + 1024], c[cell[at : at + 1024]])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(dist), pa.array(np.sqrt((x**2).sum(1)))], [*part.schema.names, "cell", "dist", "norm"])

    return rows.mapInArrow(lean(run), "id long, v array<long>, size int, query boolean, cell int, dist double, norm double")


def searched(points: DataFrame, queries: DataFrame, k: int, leaf: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query's task. points (id, v, size, cell, b, g), queries the same and kth."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        query = table.column("query")
        q, p = table.filter(query), table.filter(pc.invert(query))
        if not q.num_rows or not p.num_rows:
            return kind.empty_table()
        ids = q.column("id").to_numpy()
        floor = pc.fill_null(q.column("kth"), np.iinfo(np.int64).min).to_numpy()
        found = Search(matrix(q.column("v"), size), ids, matrix(p.column("v"), size), p.column("id").to_numpy(), k, leaf, floor)
        r, c = np.nonzero(found.owner != NONE)
        return pa.table([pa.array(ids[r]), pa.array(found.owner[r, c]), pa.array(found.best[r, c].astype(np.int64))], schema=kind)

    key = ["size", "cell", "b", "g"]
    both = points.select("id", "v", F.lit(False).alias("query"), F.lit(None).cast("long").alias("kth"), *key).union(queries.select("id", "v", F.lit(True), "kth", *key))
    return both.groupBy(*key).applyInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding", block: int = 16384, query_block: int = 65536, cells: int = 1024, leaf: int = 512) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): for each row whose id is divisible by `every`, its k best other rows.

    Score: inner product of the integer vectors; of equal scores the smaller id ranks first. Rows without an id, or
    whose vector is null or holds a null or non-finite component, take no part. Vectors are compared with those of
    their own length only. Rows that share an id are candidates one by one, for every query of another id, and are dealt
    to blocks by a salt of their own; queries that share an id share its k places. Where a score might exceed 64 bits,
    an OverflowError is raised. Fewer than k candidates: all of them; no row for a query without any. Other
    columns are not read.

    A task holds at most `block` rows and `query_block` queries (fewer of long vectors). The centres are the distinct
    ones of at most `cells` rows, one for each block of rows, chosen by a hash; tables about pairs of cells, of which
    there are at most `cells` squared, are broadcast.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = quantized(vectors, scale, id_column, vector_column).withColumn("size", F.size("v")).withColumn("query", F.col("id") % every == 0)
    ends = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    total, width, largest = rows.agg(F.count("*"), F.max("size"), F.max(ends)).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if largest and max(1, width) * largest**2 >= 2.0**63:
        raise OverflowError(f"components up to {largest:g} after scaling: inner products of {width} of them may exceed 64 bits")
    fit = max(1, TASK_BYTES // (8 * max(1, width)))
    block, query_block = min(block, fit), min(query_block, fit)
    sample = rows.select("size", "v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(min(cells, -(-total // block))).toArrow()
    sizes = sample.column("size").to_numpy()
    centres = {s: np.unique(matrix(sample.filter(pa.array(sizes == s)).column("v"), s), axis=0).astype(float) for s in np.unique(sizes).tolist()}
    every_row = scratch.keep(placed(rows.select("id", "v", "size", "query"), centres).withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "cells")

    asked = F.col("query")
    stats = every_row.groupBy("size", "cell").agg(
        F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("most"), F.count_if(asked).alias("nq"),
        F.max(F.when(asked, F.col("dist"))).alias("q_radius"), F.max(F.when(asked, F.col("norm"))).alias("q_most"),
    ).orderBy("size", "cell").collect()
    # Query groups: cells with few queries share one, those with many have several. (size, cell): (first group, groups, blocks)
    deal: dict[tuple[int, int], tuple[int, int, int]] = {}
    group, room = -1, 0
    for i, s in enumerate(stats):
        if s.nq > room or s.nq > query_block or (i and stats[i - 1].size != s.size):
            group, room = group + 1, query_block
        deal[s["size"], s.cell] = (group, max(1, -(-s.nq // query_block)), -(-s.n // block))
        room -= s.nq
        if s.nq > query_block:
            group, room = group + deal[s["size"], s.cell][1] - 1, 0

    def dealt(pairs: list[tuple[int, int, int]], queries: DataFrame) -> DataFrame:
        """Search of pairs (size, cell of queries, cell of rows)."""
        to_rows = sorted({(s, d, *deal[s, c][:2]) for s, c, d in pairs})
        to_rows = spark.createDataFrame([(*x, deal[x[0], x[1]][2]) for x in to_rows], "size int, cell int, g0 int, gn int, nb int")
        to_queries = spark.createDataFrame([(s, c, d, *deal[s, c][:2], deal[s, d][2]) for s, c, d in pairs], "size int, cell int, to int, g0 int, gn int, nb int")
        of = lambda n, *key: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
        points = every_row.join(F.broadcast(to_rows), ["size", "cell"]).withColumn("b", of("nb", "salt")).withColumn("g", F.explode(F.sequence(F.col("g0"), F.col("g0") + F.col("gn") - 1)))
        meet = queries.join(F.broadcast(to_queries), ["size", "cell"]).withColumn("g", F.col("g0") + of("gn", "id", "v"))
        meet = meet.select("id", "v", "kth", "size", F.col("to").alias("cell"), "g", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
        return searched(points, meet, k, leaf)

    queries = every_row.where("query")
    own = [(s["size"], s.cell, s.cell) for s in stats if s.nq]
    if not own:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    home = scratch.keep(ranked(dealt(own, queries.withColumn("kth", F.lit(None).cast("long"))), k), "home")
    kth = home.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    queries = scratch.keep(queries.join(kth, "id", "left").select("id", "v", "size", "cell", "kth"), "queries")
    worst = {(r["size"], r.cell): r.kth if not r.open else -np.inf for r in queries.groupBy("size", "cell").agg(F.min("kth").alias("kth"), F.count_if(F.col("kth").isNull()).alias("open")).collect()}
    pairs = []
    for size in {s["size"] for s in stats}:
        mine = [s for s in stats if s["size"] == size]
        c = centres.get(size, np.zeros((1, size)))[[s.cell for s in mine]]
        norm, radius, most = np.sqrt((c**2).sum(1)), *(np.array([s[x] for s in mine], float) for x in ("radius", "most"))
        for i, s in enumerate(mine):
            if s.nq:
                top = bounds(c @ c[i], (s.q_radius, norm[i], s.q_most), (radius, norm, most))
                pairs += [(size, s.cell, mine[j].cell) for j in np.flatnonzero(top >= worst[size, s.cell]).tolist() if j != i]
    found = home.drop("rank")
    if pairs:
        found = found.union(dealt(pairs, queries).select(*found.columns))
    return ranked(found, k)
