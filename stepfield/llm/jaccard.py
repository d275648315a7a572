"""Exact join of texts on the Jaccard similarity of their sets of word shingles, by prefix trees.

Shingles are hashed to 58 bits. Texts that have too few shingles in common with any others go first, as they have no
partner: a set with `n` members and a partner share so many of the first members, in any order that is the same for
all, that it can be seen from the members that occur in other sets at all (`open_texts`: by the least third of hashes;
`reduce`: by all members of those that are left, from the rarest up, over again as long as that takes a quarter of them). What a set has
for itself is then only counted. Sets that are equal without such members are linked to the smallest of them at once.

The others meet by the members in their prefix, from the rarest up: two sets as alike as `share` have one in common.
Sets that meet by the same member make a prefix tree (paths from the rarest member up). It is walked once for all its
sets together: along a path every set that may still match it carries its overlap with the path so far, so that paths
share what they have in common. A set leaves a subtree when the members that already differ, with those that must
differ as too many or too few remain, are more than the two sizes allow; and when all sets under it are in the set's
own component, as only components are asked for.

Sets that meet, directly or by way of others, are a cluster. One of at most `chunk` sets makes one tree, so that each of
its sets is sent once. In larger ones a tree holds the sets of one member; members that the same sets have are one, and
those of more than `chunk` sets are dealt to pairs of chunks. Before all members are gone through there, an eighth of
them is, with each chunk by itself and the member's smallest set in all chunks: after that, what a large group of near
copies has in common has one component, and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Sieve, Words, key_edges, lean, ragged, ship, slices, whole_keys
from .components import components, forest
from .substring import _mix, run_hash, word_hashes

BITS = 58
LOW = (1 << BITS) - 1
#: Members of the sets of a chunk, beside their number.
MEMBERS = 1 << 21
#: `reduce` goes over the sets again where at most this part of them was left: the last ones go one by one, at the price of all.
HELPS = (3, 4)
#: Similarity as a fraction.
SHARE = (4, 5)


def _up(a: int | np.ndarray, share: tuple[int, int]) -> int | np.ndarray:
    """a * share, rounded up."""
    return -(-a * share[0] // share[1])


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text in order of both, and the number of each row. Shorter texts are one shingle."""
    w = Words(pc.ascii_lower(pc.fill_null(texts, "")))
    n = np.diff(w.bounds)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    h = word_hashes(w)[:, 0]
    out_row, out_hash = [], []
    for k in range(1, words + 1):
        rows = np.flatnonzero(n >= words) if k == words else np.flatnonzero(n == k)
        if len(rows):
            many = n[rows] - k + 1
            g = _mix(run_hash(h, k) + np.uint64(k))
            out_hash.append(g[ragged(w.bounds[:-1][rows], many)] >> np.uint64(64 - BITS))
            out_row.append(np.repeat(rows, many))
    row, token = np.concatenate(out_row), np.concatenate(out_hash).astype(np.int64)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (token[1:] != token[:-1])])
    row, token = row[new], token[new]
    return row, token, np.bincount(row, minlength=len(n))


def open_texts(docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """(doc_id, t1, t2, n, open): each row's id, hashes of its text, size of its set, and whether it may have a partner.

    Of the least hashes of a set, the first n - share * n and another tenth of n, at least a tenth of share * n are in any partner.
    """
    ship(docs.sparkSession)
    kind = "token long, uid long, doc_id long, t1 long, t2 long, n long, seen int"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                row, token, n = shingle_sets(part.column("text"), words)
                upto = n - _up(n, share) + -(-n // 10)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                some = nth < upto[row]
                row, token = row[some], token[some]
                # What several rows here have is sent once, for the others' sake.
                order = np.argsort(token, kind="stable")
                new = np.concatenate([[True], token[order][1:] != token[order][:-1]]) if len(order) else np.zeros(0, bool)
                many = np.diff(np.append(np.flatnonzero(new), len(order)))
                here = np.repeat(many > 1, many)
                seen = np.bincount(row[order][here], minlength=len(n)).astype(np.int32)
                token, owner = token[order][new], np.where(many > 1, -1, row[order][new] + at)
                uid = np.arange(len(n)) + at
                rest = len(token)
                gone = lambda c: pa.concat_arrays([pa.nulls(rest, pa.int64()), part.column(c).cast(pa.int64())])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([token, _mix(uid.astype(np.uint64)).view(np.int64) >> (64 - BITS)])),
                        pa.array(np.concatenate([owner, uid])),
                        gone("doc_id"), gone("t1"), gone("t2"),
                        pa.concat_arrays([pa.nulls(rest, pa.int64()), pa.array(n.astype(np.int64))]),
                        pa.array(np.concatenate([np.zeros(rest, np.int32), seen])),
                    ],
                    kind_names,
                )
                at += len(n)

    kind_names = [c.split()[0] for c in kind.split(", ")]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that say something of a text: its own row, and whether a member of it occurs again."""
        last = None  # the last row's token and row, as the next batch may go on with it
        for batch in batches:
            t = pa.Table.from_batches([batch]) if last is None else pa.concat_tables([last, pa.Table.from_batches([batch])])
            own = t.column("n").is_valid().to_numpy()
            yield from t.filter(pa.array(own)).select(kind_names[1:]).to_batches()
            m = t.filter(pa.array(~own))
            token, uid = m.column("token").to_numpy(), m.column("uid").to_numpy()
            equal = token[1:] == token[:-1] if len(token) else np.zeros(0, bool)
            twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]]) if len(token) else np.zeros(0, bool)
            # The last row waits, unless it is known by now to occur again.
            wait = len(token) and not twice[-1]
            hit = uid[twice & (uid >= 0)]
            if len(hit):
                u, c = np.unique(hit, return_counts=True)
                blank = [pa.nulls(len(u), pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([pa.array(u), *blank, pa.array(c.astype(np.int32))], kind_names[1:])
            if len(token):
                last = m.slice(len(token) - 1).set_column(1, t.schema.field("uid"), pa.chunked_array([pa.array([uid[-1] if wait else -1])]))

    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    sent = rows.mapInArrow(lean(first), kind).repartition("token").sortWithinPartitions("token")
    said = sent.mapInArrow(lean(met), ", ".join(kind.split(", ")[1:]))
    each = said.groupBy("uid").agg(*(F.max(c).alias(c) for c in ("doc_id", "t1", "t2", "n")), F.sum("seen").alias("seen"))
    a, b = share
    needed = F.expr(f"cast(ceil(ceil(n * {a} / {b}) / 10) as long)")
    return each.select("doc_id", "t1", "t2", "n", ((F.col("n") > 0) & (F.col("seen") >= needed)).alias("open"))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(t1, t2, n, tokens) of the texts whose hashes (t1, t2) are wanted, once each. The texts stay where they are."""
    sieve = Sieve(wanted, "t1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sieve.holds(batch.column("t1").to_numpy())))
            for part in slices(batch, "text"):
                _, keep = np.unique(np.stack([part.column("t1").to_numpy(), part.column("t2").to_numpy()], 1), axis=0, return_index=True)
                part = part.take(pa.array(np.sort(keep)))
                _, token, n = shingle_sets(part.column("text"), words)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(token))
                yield pa.RecordBatch.from_arrays([part.column("t1"), part.column("t2"), pa.array(n.astype(np.int64)), lists], ["t1", "t2", "n", "tokens"])

    rows = docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    rows = rows.mapInArrow(lean(run), "t1 long, t2 long, n long, tokens array<long>")
    # The list is not shuffled with what the filter lets through by mistake.
    rows = rows.where("n > 0").join(wanted.select("t1", "t2"), ["t1", "t2"], "left_semi")
    return rows.groupBy("t1", "t2").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def reduce(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Sets (node, n, tokens) without members that no other has, if enough are left: (node, n, path).

    path is in order, from rare members up: the number of binary digits of a member's sets, then its hash. Members of
    sets that come with a path are read from that.
    """
    rows = sets.select("node", "n", F.explode("tokens").alias("token"))
    many = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    key = F.expr(f"shiftleft(cast(length(bin(df)) - 1 as long), {BITS}) | token")
    rows = rows.join(many, "token").select("node", "n", key.alias("key"))
    rows = rows.groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("key")).alias("path"))
    return rows.where(F.size("path") * share[1] >= F.col("n") * share[0])


def settled(sets: DataFrame, share: tuple[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) to the smallest of sets with equal paths, and the sets that are still to be compared with others.

    Where two of them are alike, each is alike to the smallest. The smallest stands for those that are linked to it.
    """
    of = F.struct(F.xxhash64("path"), F.xxhash64(F.lit(1), "path"), F.size("path"))
    rows = sets.withColumn("of", of)
    least = rows.groupBy("of").agg(F.min(F.struct("n", "node")).alias("lead"), F.count("*").alias("k")).where("k > 1").select(F.col("of").alias("_of"), "lead")
    near = F.expr(f"size(path) * {sum(share)}L >= (n + lead.n) * {share[0]}L")
    rows = scratch.keep(rows.join(least, F.col("of") == F.col("_of"), "left").withColumn("linked", F.coalesce(near & (F.col("lead.node") != F.col("node")), F.lit(False))), "settled")
    links = rows.where("linked").select(F.col("node").alias("u"), F.col("lead.node").alias("v"))
    return links, rows.where("not linked").select("node", "n", "path")


class Bucket:
    """Sets that share a member: which of them are alike, as far as that joins components.

    paths: members of each set in order, all paths one after another with `size` of each; n: sizes with the members
    that no other set has; comp: component of each. side: sets of 0 and 1 are compared with each other, of 2 with all.
    """

    def __init__(self, flat: np.ndarray, size: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, share: tuple[int, int]):
        self.share, self.links, self.visited = share, [], 0
        starts = np.cumsum(size) - size
        text = flat.astype(">i8").tobytes()
        order = sorted(range(len(size)), key=lambda i: text[8 * starts[i] : 8 * (starts[i] + size[i])])
        self.order = order = np.array(order)
        self.size, self.n, self.side = size[order], n[order], side[order]
        _, self.comp = np.unique(comp[order], return_inverse=True)
        self.start = np.cumsum(self.size) - self.size
        self.flat = flat[ragged(starts[order], self.size)]
        self.own = self.n - self.size
        if len(order) > 1 and self.comp.any():
            self.pivot()
        if len(order) > 2 and (self.comp != self.comp[0]).any():
            self.walk()

    def alike(self, overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return overlap * sum(self.share) >= (n + m) * self.share[0]

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others:
            if self.comp[a] != self.comp[b]:
                self.links.append((self.order[a], self.order[b]))
                self.comp[self.comp == self.comp[b]] = self.comp[a]

    def pivot(self) -> None:
        """The smallest set against all: in a group of near copies that leaves one component."""
        p = int(np.argmin(np.where(self.side == 2, self.n, self.n + (1 << 40)))) if (self.side == 2).any() else 0
        mine = self.flat[self.start[p] : self.start[p] + self.size[p]]
        at = np.minimum(np.searchsorted(mine, self.flat), len(mine) - 1)
        overlap = np.add.reduceat((mine[at] == self.flat).astype(np.int64), self.start)
        near = self.alike(overlap, self.n[p], self.n) & ((self.side != self.side[p]) | (self.side == 2))
        near[p] = False
        self.join(p, np.flatnonzero(near))

    def walk(self) -> None:
        k = len(self.size)
        members, code = np.unique(self.flat, return_inverse=True)
        keys = np.repeat(np.arange(k), self.size) * len(members) + code
        paths = [code[s : s + z] for s, z in zip(self.start, self.size, strict=True)]
        common = np.zeros(k + 1, np.int64)  # with the set before; none before the first and behind the last
        for i in range(1, k):
            z = min(self.size[i - 1], self.size[i])
            apart = np.flatnonzero(paths[i - 1][:z] != paths[i][:z])
            common[i] = apart[0] if len(apart) else z
        a, b = self.share
        stack = [(0, k, 0, np.arange(k), np.zeros(k, np.int64))]
        while stack:
            low, high, depth, live, overlap = stack.pop()
            inside = self.comp[low:high]
            keep = live > low
            if (inside == inside[0]).all():
                keep &= self.comp[live] != inside[0]
            live, overlap = live[keep], overlap[keep]
            if not len(live):
                continue
            self.visited += 1
            to = int(self.size[low]) if high - low == 1 else int(min(common[low + 1 : high].min(), self.size[low]))
            if to > depth:
                edge = paths[low][depth:to]
                got = np.empty(len(live), np.int64)
                step = max(1, (1 << 21) // len(edge))
                for i in range(0, len(live), step):
                    ask = live[i : i + step, None] * len(members) + edge[None, :]
                    at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
                    got[i : i + step] = (keys[at] == ask).sum(1)
                overlap = overlap + got
                passed = np.searchsorted(keys, live * len(members) + edge[-1], side="right") - self.start[live]
                left = self.size[low:high] - to
                more = self.size[live] - passed
                differ = to + passed - 2 * overlap + self.own[live] + self.own[low:high].min() + np.maximum(0, np.maximum(more - left.max(), left.min() - more))
                # As alike as a / b: of both sizes together, at most (b - a) / (b + a) differ.
                keep = differ * (a + b) <= (self.n[live] + self.n[low:high].max()) * (b - a)
                live, overlap = live[keep], overlap[keep]
                if not len(live):
                    continue
            at = low
            while at < high and self.size[at] == to:  # paths that end here
                near = self.alike(overlap, self.n[at], self.n[live]) & ((self.side[live] != self.side[at]) | (self.side[live] == 2)) & (live > at)
                self.join(at, live[near])
                at += 1
            if at < high:
                cuts = [at, *(at + 1 + np.flatnonzero(common[at + 1 : high] == to)), high]
                stack += [(x, y, to, live, overlap) for x, y in zip(cuts[:-1], cuts[1:], strict=True)][::-1]


def joined(routes: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (u, v) of sets (node, n, path) that meet in routes (place, side, node, comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, held = [], 0
        for t in whole_keys(batches, ["place"], 1 << 16, 64 << 20):
            t = t.combine_chunks()
            edges = np.concatenate([[0], np.flatnonzero(key_edges(t, ["place"])) + 1, [t.num_rows]])
            path = t.column("path").chunk(0)
            flat, size = path.flatten().to_numpy(), pc.list_value_length(path).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            node, n, comp, side = (t.column(c).to_numpy() for c in ("node", "n", "comp", "side"))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if high - low > 1:
                    some = slice(low, high)
                    found = Bucket(flat[ends[low] : ends[high]], size[some], n[some], comp[some], side[some], share).links
                    wait += [(node[low + x], node[low + y]) for x, y in found]
            if len(wait) - held > 1 << 16:
                u, v = forest(*np.array(wait).T)
                wait = list(zip(u, v, strict=True))
                held = len(wait)
        if wait:
            u, v = forest(*np.array(wait).T)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = routes.join(sets, "node").select("place", "side", "node", "comp", "n", "path")
    return rows.repartition("place").sortWithinPartitions("place").mapInArrow(lean(run), "u long, v long")


def links(sets: DataFrame, before: DataFrame, share: tuple[int, int], scratch: Scratch, chunk: int) -> DataFrame:
    """Links (u, v) between sets (node, n, path), as many as connect all that are alike, beside those from before."""
    a, b = share
    # The first n - share * n + 1 members of a set, those that no other has being the first.
    first = F.expr(f"cast(size(path) - ceil(n * {a} / {b}) + 1 as int)")
    routes = scratch.keep(sets.select("node", F.explode(F.slice("path", 1, first)).alias("member")), "routes")

    def keys(rows: DataFrame) -> DataFrame:
        """(member, c, least) of members that sets of several components have: number of chunks and smallest set; of members of the same sets one."""
        held = rows.groupBy("member").agg(
            F.count("*").alias("k"), F.sum("m").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct("n", "node")).alias("least"),
            F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(20,0)")).alias("y"),
        ).where("c0 <> c1")
        one = held.groupBy("k", "m", "x", "y").agg(F.min(F.struct("member", "least")).alias("one"))
        return one.select("one.member", F.ceil(F.greatest(F.col("k") / chunk, F.col("m") / MEMBERS)).alias("c"), F.col("one.least.node").alias("least"))

    def with_component(rows: DataFrame, roots: DataFrame) -> DataFrame:
        sizes = sets.select("node", "n", F.size("path").alias("m")).join(roots.select("node", "root"), "node", "left")
        return rows.join(sizes.select("node", "n", "m", F.coalesce("root", "node").alias("comp")), "node")

    # Sets that can meet at all are a cluster. Small ones are compared as a whole: each set is sent once.
    known = components(before, scratch)
    every = with_component(routes, known)
    met = scratch.keep(every.join(keys(every), "member").select("node", "least", "m", "comp"), "met")
    cluster = components(met.select(F.col("node").alias("u"), F.col("least").alias("v")), scratch)
    nodes = met.groupBy("node").agg(F.first("m").alias("m"), F.first("comp").alias("comp")).join(cluster, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = nodes.groupBy("root").agg(F.count("*").alias("k"), F.sum("m").alias("all"))
    nodes = scratch.keep(nodes.join(of, "root").withColumn("small", (F.col("k") <= chunk) & (F.col("all") <= MEMBERS)), "nodes")
    got = nodes.where("small").select(F.xxhash64("root").alias("place"), F.lit(2).alias("side"), "node", "comp")
    found = scratch.keep(joined(got, sets, share), "links")
    large = nodes.where("not small").select("node")
    if large.isEmpty():
        return found

    # The others member by member. First an eighth of all members, in chunks that share the key's smallest set.
    routes = scratch.keep(routes.join(large, "node", "left_semi"), "routes")
    some = with_component(routes.where(F.expr(f"(member & {LOW}) % 8 = 0")), known)
    got = some.join(keys(some), "member")
    own = F.pmod(F.xxhash64("node"), F.col("c"))
    in_chunks = F.when(F.col("node") == F.col("least"), F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).otherwise(F.array(own))
    got = got.withColumn("x", F.explode(in_chunks)).select(F.xxhash64("member", "x").alias("place"), F.lit(2).alias("side"), "node", "comp")
    early = scratch.keep(joined(got, sets, share), "links")

    known = components(before.union(early), scratch)
    every = with_component(routes, known)
    got = every.join(keys(every), "member").withColumn("own", own)
    got = got.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    got = got.select(F.xxhash64("member", F.least("own", "other"), F.greatest("own", "other")).alias("place"), side.alias("side"), "node", "comp")
    return found.union(early).union(scratch.keep(joined(got, sets, share), "links"))


def join(docs: DataFrame, words: int = 5, share: tuple[int, int] = SHARE, chunk: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, n_shingles long, component_id long), one row per row of docs.

    Two rows link when the distinct `words`-word shingles of their texts (A-Z lower-cased) have a Jaccard similarity of
    at least share[0] / share[1]; a text of fewer words is one shingle. component_id is the smallest doc_id reachable by
    links, a row's own included. Null, empty and blank texts have an empty set and no links: component_id is their own
    doc_id. Null ids never are a component's id unless it has no other; repeated ids are rows of their own. An empty
    table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = scratch.keep(open_texts(docs, words, share), "texts")
    least = rows.where("n > 0").groupBy("t1", "t2").agg(F.min("doc_id").alias("least"), F.max("open").alias("open"), F.count("*").alias("k"))
    texts = scratch.keep(least.where("open").withColumn("node", F.monotonically_increasing_id()).select("t1", "t2", "node", "least"), "open")
    sets = scratch.keep(sets_of(docs, texts, words).join(texts, ["t1", "t2"]).select("node", "n", "tokens"), "sets")
    known, count = None, texts.count()
    while True:
        now, sets = settled(reduce(sets, share), share, scratch)
        known = now if known is None else known.union(now)
        size = sets.count()
        if size == 0 or size * HELPS[1] > count * HELPS[0]:
            break
        count = size
        sets = sets.select("node", "n", F.transform("path", lambda x: x.bitwiseAND(F.lit(LOW))).alias("tokens"), "path")
    sets = sets.select("node", "n", "path")
    found = known.union(links(sets, known, share, scratch, chunk)) if size else known
    roots = components(found, scratch)
    node = texts.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = node.groupBy("root").agg(F.min("least").alias("component_id"))
    of_text = node.join(of, "root").select(F.col("t1").alias("_a"), F.col("t2").alias("_b"), "component_id")
    out = rows.join(of_text, (F.col("t1") == F.col("_a")) & (F.col("t2") == F.col("_b")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
