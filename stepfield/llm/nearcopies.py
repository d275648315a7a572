"""SimHash near-copies at a similarity of word shingles.

Two texts are near copies if their sets of word shingles have a Jaccard similarity of at least `similarity`; groups
are components of these links.

* Texts with equal shingle sets are one node from the start (a key of 128 bits), however many there are.
* First the search of `simhash` links all fingerprints within `LINKED` bits of each other by its pivot tables; none is
  missed. Texts whose fingerprints are in one component meet.
* Fingerprints of 64 bits can't find the rest: at similarity 0.8 they differ in about ten bits, often in more than those
  of unrelated texts. So texts that are still apart meet by `BANDS` keys of four min-wise shingles each, too: at
  similarity 0.8 they share a key with a probability of 0.9998, and more alike ones more surely. Keys that only one text
  has, or only texts that are joined by then, go no further.
* Among texts that meet, the pivot table discards pairs (coordinates further apart than `RADIUS`), fingerprints are
  compared bit by bit, and survivors verified: by the sizes of their sets, exactly, and by 512 further min-wise
  values, which estimate the similarity with a standard deviation of 0.018 at 0.8. Where the estimate is within
  `MARGIN` of the limit, over five deviations, the shingle sets themselves decide, in a second pass over the texts
  of such pairs. It goes through the keys in `ROUNDS`, and a key whose texts are joined by then is left out.

Keys are unlimited: those of more than `chunk` texts are dealt to many tasks in chunks (see `links`). A task holds
two chunks at a time and gives a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Sieve, binary_rows, key_edges, lean, ship, slices, unpacked, whole_keys, whole_row
from .components import absorb, components
from .simhash import ONES, PIVOTS, fingerprint_links

BANDS, DEEP, CHECKS = 16, 4, 512
#: Five-word fingerprints of texts of similarity 0.8 differ in 9.7 bits on average, with a deviation of 2.9 (sets of four
#: and five shingles in 12, with one of 3.1); those of unrelated texts in 32, with one of 4.
RADIUS = 26
#: Differing bits up to which the search by pivot tables links fingerprints, as in op2.
LINKED = 3
#: An estimate of the similarity further from the limit than this is trusted.
MARGIN = 0.1
#: Bands whose keys the second pass takes together.
ROUNDS = ((0, 1), (2, BANDS - 1))
#: Odd factors: a shingle's hash times one of them, modulo 2 ** 64, puts shingles in an order of its own.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * DEEP + CHECKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Rows, or their bytes, that a task compares in one go, at least (whole keys).
GO, GO_BYTES = 8192, 64 << 20
#: Pairs left to the second pass that a comparison remembers as such; of more it remembers the texts.
OPEN = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of all texts, one text after another; their number in each text)."""
    import xxhash

    h = xxhash.xxh64_intdigest
    sets = []
    for text in texts:
        got = (text or "").encode("utf-8", "surrogatepass").lower().split()
        data = b" ".join(got)
        if len(got) <= words:
            sets.append(np.array([h(data, 42)] * bool(got), np.uint64))
            continue
        size = np.fromiter(map(len, got), np.int64, len(got))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(got) - words + 1].tolist()
        sets.append(np.unique(np.array([h(data[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.fromiter(map(len, sets), np.int64, len(sets))


def majority(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints: bits set in over half of a text's n hashes. Every n is positive."""
    first = np.cumsum(n) - n
    out = np.zeros(len(n), np.uint64)
    for k in range(8):  # a byte of a word counts every eighth bit
        part = ((flat >> np.uint64(k)) & ONES).astype("<u8").view(np.uint8).reshape(-1, 8)
        major = (2 * np.add.reduceat(part, first, axis=0, dtype=np.int64) > n[:, None]).astype(np.uint64)
        out |= (major << np.arange(k, 64, 8, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def sketches(texts: list[str | None], words: int) -> dict[str, np.ndarray]:
    """A row a text: size of its set, key of 128 bits for it, fingerprint, keys of bands, bytes to check by. Texts without words have zeros."""
    flat, n = shingle_sets(texts, words)
    full = np.flatnonzero(n)
    out = {"size": n, "fp": np.zeros(len(n), np.uint64), "bands": np.zeros((len(n), BANDS), np.uint64), "checks": np.zeros((len(n), CHECKS), np.uint8)}
    out |= {c: np.zeros(len(n), np.uint64) for c in ("same0", "same1")}
    if not len(full):
        return out
    n = n[full]
    first = np.cumsum(n) - n
    out["fp"][full] = majority(flat, n)
    for c, salt in (("same0", 0x51), ("same1", 0xA7)):
        out[c][full] = np.add.reduceat(mixed(flat ^ mixed(np.full(1, salt, np.uint64))), first)
    for b in range(BANDS):
        key = np.full(len(n), b + 1, np.uint64)
        for f in FACTORS[b * DEEP : (b + 1) * DEEP]:
            key = mixed(key + np.minimum.reduceat(flat * f, first))
        out["bands"][full, b] = key
    for c, f in enumerate(FACTORS[BANDS * DEEP :]):
        out["checks"][full, c] = mixed(np.minimum.reduceat(flat * f, first)) & np.uint64(255)
    return out


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Of two sets: sorted, distinct hashes."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def joined(uid: np.ndarray, runs: np.ndarray, side: np.ndarray, size: np.ndarray, fp: np.ndarray, checks: np.ndarray, similarity: float, sets: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the verified pairs within runs of equal `runs` (sorted): (uid, smallest uid of its component).

    Third, the rows of pairs that the estimate leaves open and the forest does not join. With `sets` there are none.

    side: 0 and 1 are compared with each other, 2 with all of their run. Pairs that are joined already aren't compared
    again, and a run that is one component is done: groups of near copies take time in proportion to their rows.
    """
    order = np.lexsort((size, runs))
    runs, side, size, fp = runs[order], side[order], size[order], fp[order]
    nodes, node = np.unique(uid[order], return_inverse=True)
    parent = np.arange(len(nodes))
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    length = np.diff(np.append(first, len(runs)))
    i = np.arange(len(order))
    unsure: list[tuple[np.ndarray, np.ndarray]] = []
    marked = np.zeros(len(order), bool)
    shift = 1
    while len(i):  # in order of size: a set too large for i ends its search
        i = i[i + shift < len(order)]
        j = i + shift
        on = (runs[i] == runs[j]) & (size[i] >= similarity * size[j])
        i, j = i[on], j[on]
        wanted = ((side[i] != side[j]) | (side[i] == 2)) & (parent[node[i]] != parent[node[j]])
        a, b = i[wanted], j[wanted]
        for c in range(table.shape[1]):
            if not len(a):
                break
            near = np.abs(table[a, c] - table[b, c]) <= RADIUS
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
        a, b = a[near], b[near]
        # Bytes of different minima agree once in 256.
        equal = ((checks[order[a]] == checks[order[b]]).mean(1) * 256 - 1) / 255
        if sets is None:
            good = equal >= similarity + MARGIN
            unclear = ~good & (equal >= similarity - MARGIN)
            if unclear.any():
                unsure.append((a[unclear], b[unclear]))
                if sum(len(x) for x, _ in unsure) > OPEN:
                    marked[np.concatenate([x for pair in unsure for x in pair])] = True
                    unsure = []
        else:
            good = equal >= similarity - MARGIN
            for k in np.flatnonzero(good):
                good[k] = alike(sets[order[a[k]]], sets[order[b[k]]], similarity)
        if good.any():
            absorb(parent, node[a[good]], node[b[good]])
            root = parent[node]
            done = np.repeat(np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first), length)
            i = i[~done[i]]
        shift += 1
    for a, b in unsure:
        apart = parent[node[a]] != parent[node[b]]
        marked[a[apart]] = marked[b[apart]] = True
    own = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[own], nodes[parent[own]], order[marked]


#: Columns that say where a text is compared: band, key, the chunks of the key, and with whom.
PLACE = ["band", "key", "x", "y", "side"]


def _forest(part: pa.Table, similarity: float) -> pa.RecordBatch:
    """Links (u, v), then the rows that need the sets: u and the row's place."""
    runs = np.cumsum(np.concatenate([[False], key_edges(part, ["key", "x", "y"])]))
    checks = np.frombuffer(b"".join(part.column("checks").to_pylist()), np.uint8).reshape(-1, CHECKS)
    uid, side, size, fp = (part.column(c).to_numpy() for c in ("uid", "side", "size", "fp"))
    sets = [np.frombuffer(s, np.uint64) for s in part.column("set").to_pylist()] if "set" in part.column_names else None
    u, v, open_rows = joined(uid, runs, side, size, fp.view(np.uint64), checks, similarity, sets)
    rest = part.select(["uid", *PLACE]).take(pa.array(open_rows)).combine_chunks()
    none = pa.nulls(len(open_rows), pa.int64())
    columns = [pa.concat_arrays([pa.array(u, pa.int64()), *rest.column("uid").chunks]), pa.concat_arrays([pa.array(v, pa.int64()), none])]
    columns += [pa.concat_arrays([pa.nulls(len(u), rest.column(c).type), *rest.column(c).chunks]) for c in PLACE]
    return pa.RecordBatch.from_arrays(columns, ["u", "v", *PLACE])


def links(keys: DataFrame, sketched: DataFrame, texts: DataFrame, scratch: Scratch, words: int, similarity: float, chunk: int) -> DataFrame:
    """(u, v): links between distinct texts, reduced to spanning forests. keys: (uid, band, key, root), sketched: (uid, size, fp, checks), texts: (uid, text).

    root is the component that a text is in by now; keys whose texts are all in one are left out.
    A key of more than `chunk` texts is dealt to chunks twice, by two hashes, which joins nearly all of a group at the
    price of two rows a text. Then texts outside the key's largest component are compared with all chunks of the key;
    texts within it are joined already. So no pair is left out, and only what stays apart is dealt more than once.
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("count"), F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select(F.col("key").alias("_key"), "count")
    shared = scratch.keep(keys.join(counts, F.col("key") == F.col("_key")).select("band", "key", "uid", F.ceil(F.col("count") / chunk).cast("int").alias("c")), "shared")
    # Most texts share no key: their sketches stay where they are.
    met = Sieve(shared.select("uid").distinct(), "uid")
    sketched = scratch.keep(sketched.where(met.may_hold("uid")), "met")

    def compared(dealt: DataFrame) -> DataFrame:
        return _compared(dealt, sketched, texts, scratch, words, similarity)

    cold = shared.where("c = 1").select("band", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).cast("short").alias("side"), "uid")
    hot = shared.where("c > 1")
    if hot.isEmpty():
        return compared(cold)

    def own(salt: int, of: str) -> Column:
        return F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(of)).cast("int")

    for salt in (0, 1):
        cold = cold.union(hot.select("band", "key", own(salt, "c"), F.lit(-1 - salt), F.lit(2).cast("short"), "uid"))
    joined_so_far = components(compared(cold), scratch)
    placed = hot.join(joined_so_far, F.col("uid") == F.col("node"), "left").select("band", "key", "uid", "c", F.coalesce("root", "uid").alias("root"))
    placed = scratch.keep(placed, "placed")
    largest = placed.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("n"))
    largest = largest.where("n > m.count").select(F.col("key").alias("_key"), F.col("m.root").alias("most"), F.ceil((F.col("n") - F.col("m.count")) / chunk).cast("int").alias("d"))
    apart = placed.join(scratch.keep(largest, "apart"), F.col("key") == F.col("_key"))
    every = apart.select("band", "key", own(0, "c").alias("x"), F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("y"), F.lit(0).cast("short").alias("side"), "uid")
    few = apart.where("root <> most").select("band", "key", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("x"), own(0, "d").alias("y"), F.lit(1).cast("short").alias("side"), "uid")
    return joined_so_far.select(F.col("node").alias("u"), F.col("root").alias("v")).union(compared(every.union(few)))


def _compared(dealt: DataFrame, sketched: DataFrame, texts: DataFrame, scratch: Scratch, words: int, similarity: float) -> DataFrame:
    """(u, v): a forest of the links among rows (band, key, x, y, side, uid) of equal key, x and y, for each task.

    The first pass decides by estimates and gives the rows of the pairs that these leave open; the second has their sets.
    """

    def with_sketches(rows: DataFrame) -> DataFrame:
        return rows.withColumnRenamed("uid", "_uid").join(sketched, F.col("_uid") == F.col("uid")).drop("_uid")

    def unjoined(rows: DataFrame) -> DataFrame:
        """Rows of places that hold texts of several components, with the component as root."""
        roots = components(found, scratch)
        rooted = scratch.keep(rows.join(roots, F.col("uid") == F.col("node"), "left").select(*PLACE, "uid", F.coalesce("root", "uid").alias("root")), "rooted")
        several = rooted.groupBy("key", "x", "y").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
        several = several.select(*(F.col(c).alias("_" + c) for c in ("key", "x", "y")))
        return rooted.join(several, [F.col(c) == F.col("_" + c) for c in ("key", "x", "y")], "left_semi")

    first = scratch.keep(_pass(with_sketches(dealt), similarity), "compared")
    found, rest = first.where("v is not null").select("u", "v"), first.where("v is null").select(*PLACE, F.col("u").alias("uid"))
    if rest.isEmpty():
        return found

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(holds(batch.column("uid").to_numpy()))), "text"):
                flat, n = shingle_sets(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("uid"), binary_rows(flat, n)], ["uid", "set"])

    sets = None
    for low, high in ROUNDS:
        rest = scratch.keep(unjoined(rest), "open")
        if sets is None:
            holds = Sieve(rest.select("uid").distinct(), "uid").holds
            sets = scratch.keep(texts.select("uid", "text").mapInArrow(lean(shingled), "uid long, set binary"), "sets")
        rows = with_sketches(rest.where(F.col("band").between(low, high))).join(sets, "uid")
        # The component stands for its texts: they aren't compared with each other again.
        decided = scratch.keep(_pass(rows.drop("uid").withColumnRenamed("root", "uid"), similarity).select("u", "v"), "decided")
        found = found.union(decided)
        rest = rest.where(F.col("band") > high).drop("root")
    return found


def _pass(rows: DataFrame, similarity: float) -> DataFrame:
    rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_keys(batches, ["key", "x", "y"], GO, GO_BYTES):
            yield _forest(part, similarity)

    return rows.mapInArrow(lean(link), "u long, v long, band int, key long, x int, y int, side short")


def linked_texts(distinct: DataFrame, sketched: DataFrame, texts: DataFrame, scratch: Scratch, words: int, similarity: float, chunk: int) -> DataFrame:
    """(node, root): components of the links among texts of different sets. distinct: their (uid, fp, bands), sketched: (uid, size, fp, checks), texts: (uid, text)."""
    of_fp = components(fingerprint_links(distinct.select("fp").distinct(), scratch, LINKED), scratch).withColumnRenamed("node", "_fp")
    by_fp = distinct.select("uid", "fp").join(of_fp, F.col("fp") == F.col("_fp"), "left").select("uid", F.lit(0).alias("band"), F.coalesce("root", "fp").alias("key"), F.col("uid").alias("root"))
    near = scratch.keep(links(scratch.keep(by_fp, "fingerprints"), sketched, texts, scratch, words, similarity, chunk), "near")
    # Keys of texts that the fingerprints have joined already are left out.
    joined_so_far = components(near, scratch).withColumnRenamed("node", "_uid")
    rooted = distinct.select("uid", "bands").join(joined_so_far, F.col("uid") == F.col("_uid"), "left").select("uid", "bands", F.coalesce("root", "uid").alias("root"))
    keys = scratch.keep(rooted.select("uid", F.posexplode("bands").alias("band", "key"), "root"), "keys")
    return components(near.union(links(keys, sketched, texts, scratch, words, similarity, chunk)), scratch)


def sketch_rows(rows: DataFrame, words: int) -> DataFrame:
    """What `sketches` gives, with uid, doc_id and a hash of the text, for every row of rows (uid, doc_id, text)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = sketches(part.column("text").to_pylist(), words)
                bands = pa.FixedSizeListArray.from_arrays(pa.array(got["bands"].view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
                checks = pa.array([c.tobytes() for c in got["checks"]], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("doc_id"), part.column("hash"), pa.array(got["size"]), *(pa.array(got[c].view(np.int64)) for c in ("fp", "same0", "same1")), bands, checks],
                    ["uid", "doc_id", "hash", "size", "fp", "same0", "same1", "bands", "checks"],
                )

    schema = "uid long, doc_id long, hash long, size long, fp long, same0 long, same1 long, bands array<long>, checks binary"
    return rows.select("uid", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").mapInArrow(lean(run), schema)


def grouped(rows: DataFrame, scratch: Scratch, words: int, similarity: float, chunk: int) -> DataFrame:
    """(uid, doc_id, hash, root): for every row of rows (uid, doc_id, text), the group that it is in. uid is unique."""
    every = scratch.keep(sketch_rows(rows, words), "sketches")
    # Written by itself, so that Spark can split the join of a set that very many rows have.
    set_key = ["same0", "same1", "size"]
    first = scratch.keep(every.groupBy(*set_key).agg(F.min("uid").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    of = scratch.keep(every.select("uid", "doc_id", "hash", *set_key).join(first, set_key, "left").select("uid", "doc_id", "hash", F.coalesce("first", "uid").alias("rep")), "copies")
    distinct = every.where("size > 0").join(of.where("uid <> rep").select("uid"), "uid", "left_anti")
    roots = linked_texts(scratch.keep(distinct.select("uid", "fp", "bands"), "distinct"), every.select("uid", "size", "fp", "checks"), rows.select("uid", "text"), scratch, words, similarity, chunk)
    return of.join(roots, F.col("rep") == F.col("node"), "left").select("uid", "doc_id", "hash", F.coalesce("root", "rep").alias("root"))


def _first(groups: DataFrame) -> DataFrame:
    """The row of each group with the smallest doc_id (null last), of equal ids with the least hash of its text."""
    return groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "hash", "uid")).alias("m"))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text", chunk: int = 2048) -> DataFrame:
    """One row per row of docs: (doc_id long, component_id long).

    component_id is the smallest doc_id of the group (null only if it has no other). A-Z are lower-cased; a text of
    fewer words than a shingle is one shingle. Null, empty and blank texts form one group; repeated rows give repeated
    rows; an empty table gives none. Other columns are not read.
    """
    scratch, spent = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = spent.keep(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), "documents")
    groups = scratch.keep(grouped(rows, spent, words, similarity, chunk), "groups")
    spent.clear()
    first = scratch.keep(_first(groups).select("root", F.col("m.doc_id").alias("component_id")), "first")
    return groups.join(first, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, chunk: int = 2048) -> DataFrame:
    """One row of each group of near copies, all columns kept: that with the smallest doc_id (null last; of equal ids that with the least hash of its text).

    Null, empty and blank texts form one group; an empty table gives none. Columns of any name pass through.
    """
    scratch, spent = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    base = scratch.keep(docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid")), "documents")
    text = f"row.c{docs.columns.index('text')}"
    groups = spent.keep(grouped(base.select("uid", "doc_id", F.col(text).alias("text")), spent, words, similarity, chunk), "groups")
    gone = scratch.keep(groups.join(_first(groups).select(F.col("m.uid").alias("uid")), "uid", "left_anti").select("uid"), "gone")
    spent.clear()
    # Rows that surely stay are kept where they are; the filter's others are looked up.
    may = Sieve(gone, "uid").may_hold("uid")
    kept = base.where(~may).union(base.where(may).join(gone, "uid", "left_anti").select(*base.columns))
    return kept.select(*unpacked("row", docs))
