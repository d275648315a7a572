"""SimHash near-duplicates, searched with pivot distance tables.

A text's fingerprint sums up the hashes of its word shingles. Two fingerprints link at `most` or fewer differing
bits; components of these links are groups of near copies.

Search: only distinct fingerprints are compared. Hamming distances from each to `PIVOTS` (rows of a Hadamard
matrix, whose distances are uncorrelated for random fingerprints) are put in a table; a pair whose coordinates
differ by more than `most` anywhere cannot be that close (triangle inequality) and is discarded, survivors are
verified bit by bit. Distances to any pivot concentrate around 32, so that coordinates alone could send pairs to
machines only with hundreds of copies of each row. What meets on one machine is therefore settled by two levels
of equal bit blocks: of `most + 1` blocks of a fingerprint one is equal in both, and so is one of `most + 1` parts
of the rest. Buckets are unlimited: those above `chunk` fingerprints are dealt to many tasks as pairs of chunks.
A task reads its buckets one after another and gives spanning forests of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, key_edges, lean, ship, slices, whole_keys
from .components import components, forest

ONES = np.uint64(0x0101010101010101)


def _hadamard(n: int = 64) -> np.ndarray:
    """Row i has bit j where i & j has an odd number of bits."""
    i = np.arange(n)
    odd = np.bitwise_count(i[:, None] & i[None, :]) & 1
    return (odd.astype(np.uint64) << i.astype(np.uint64)).sum(1, dtype=np.uint64)


#: Rows that a task compares together (more where one bucket has more: at most two chunks), and links that it holds.
GO, LINKS = 1 << 17, 1 << 20
#: Reference fingerprints; the first (no bits) gives the number of bits.
PIVOTS = _hadamard()[:24]


def fingerprint_rows(texts: list[str | None], words: int) -> np.ndarray:
    """Fingerprints (uint64) of texts: A-Z lower-cased, shingles of `words` words, XXH64 with seed 42, majority of bits."""
    import xxhash

    h = xxhash.xxh64_intdigest
    hashes, counts = [], []
    for text in texts:
        got = (text or "").encode("utf-8", "surrogatepass").lower().split()
        data = b" ".join(got)
        if len(got) < words:
            hashes += [h(data, 42)] * bool(got)
            counts.append(bool(got))
            continue
        size = np.fromiter(map(len, got), np.int64, len(got))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(got) - words + 1].tolist()
        hashes += [h(data[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
        counts.append(len(starts))
    n = np.array(counts, np.int64)
    if not len(hashes):
        return np.zeros(len(n), np.uint64)
    flat = np.array(hashes, np.uint64)
    # Bits are counted eight at a time in the bytes of a word, in runs of at most 255 shingles of one document.
    runs = -(-n // 255)
    row = np.repeat(np.arange(len(n)), runs)
    first = np.cumsum(n) - n
    run = first[row] + 255 * (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs))
    full = np.flatnonzero(runs)
    start = (np.cumsum(runs) - runs)[full]
    out = np.zeros(len(n), np.uint64)
    for k in range(8):
        part = np.add.reduceat((flat >> np.uint64(k)) & ONES, run)
        bits = np.add.reduceat(part.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), start, axis=0)
        major = (2 * bits > n[full, None]).astype(np.uint64)
        out[full] |= (major << np.arange(k, 64, 8, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, fp long) for every row. Null and blank texts have fingerprint 0."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprint_rows(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def block_keys(fp: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Bucket keys of fingerprints: for every block, every part of the rest, (number of the choice, bits of both)."""
    groups = most + 1
    for b, block in enumerate(np.array_split(np.arange(64), groups)):
        rest = np.setdiff1d(np.arange(64), block)
        for r, part in enumerate(np.array_split(rest, groups)):
            key = np.zeros(len(fp), np.uint64)
            for j, bit in enumerate([*block, *part]):
                key |= ((fp >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j)
            yield b * groups + r, key


def close_pairs(fp: np.ndarray, run: np.ndarray, side: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs within runs of equal `run` (sorted). side: 0 and 1 are compared with each other, 2 with all of their run."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    # Within a run rows are in order of the first coordinate; a pair further apart in it than `most` ends the search.
    order = np.lexsort((table[:, 0], run))
    fp, run, side, table = fp[order], run[order], side[order], table[order]
    i = np.arange(len(fp))
    shift = 1
    while len(i):
        i = i[i + shift < len(fp)]
        j = i + shift
        on = (run[i] == run[j]) & (table[j, 0] - table[i, 0] <= most)
        i, j = i[on], j[on]
        a, b = i[(side[i] != side[j]) | (side[i] == 2)], j[(side[i] != side[j]) | (side[i] == 2)]
        for c in range(1, table.shape[1]):
            if not len(a):
                break
            near = np.abs(table[a, c] - table[b, c]) <= most
            a, b = a[near], b[near]
        if len(a):
            near = np.bitwise_count(fp[a] ^ fp[b]) <= most
            yield fp[a[near]], fp[b[near]]
        shift += 1


def fingerprint_links(distinct: DataFrame, scratch: Scratch, most: int = 3, chunk: int = 8192) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp), in each task reduced to a spanning forest."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for k, key in block_keys(fp, most):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, np.int16)), pa.array(key.view(np.int64)), batch.column("fp")], ["k", "key", "fp"])

    rows = distinct.select("fp").mapInArrow(lean(keyed), "k short, key long, fp long")
    hot = scratch.keep(rows.groupBy("k", "key").count().where(F.col("count") > chunk).select("k", "key", F.ceil(F.col("count") / chunk).cast("int").alias("c")), "hot")
    if hot.isEmpty():
        rows = rows.select("k", "key", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(2).cast("short").alias("side"), "fp")
    else:  # a row of chunk i of c goes to the c pairs of chunks that i is in
        own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
        rows = rows.join(hot, ["k", "key"], "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("own", own)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("short")
        rows = rows.select("k", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "fp")
        # Chunks i and j also compare nothing within themselves: that is left to the pair (i, i).
    place = ["k", "key", "x", "y"]
    rows = rows.repartition(*place).sortWithinPartitions(*place)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, size = [], 0
        for t in whole_keys(batches, place, GO, GO * 64):
            run = np.cumsum(np.concatenate([[False], key_edges(t, place)]))
            fp = t.column("fp").to_numpy().view(np.uint64)
            side = t.column("side").to_numpy()
            many = np.bincount(run)[run] > 1
            for a, b in close_pairs(fp[many], run[many], side[many], most):
                wait.append((a.view(np.int64), b.view(np.int64)))
                size += len(a)
                if size > LINKS:
                    wait = [forest(*map(np.concatenate, zip(*wait, strict=True)))]
                    size = len(wait[0][0])
                if size > LINKS // 2 and len(wait) == 1:  # the forest itself has grown large
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in wait[0]], ["u", "v"])
                    wait, size = [], 0
        if wait:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*wait, strict=True)))], ["u", "v"])

    return rows.mapInArrow(lean(link), "u long, v long")


def groups(rows: DataFrame, scratch: Scratch, most: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root, least doc_id of the fingerprint) of linked fingerprints only, and (fp, least) of all of them."""
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct, scratch, most, chunk), scratch)
    member = roots.union(roots.select(F.col("root"), "root")).distinct().select(F.col("node").alias("fp"), "root")
    return scratch.keep(member.join(distinct, "fp").select("fp", "root", "least"), "member"), distinct


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3, id_column: str = "doc_id", text_column: str = "text", chunk: int = 8192) -> DataFrame:
    """One row per row of docs: (doc_id long, fp long, component_id long).

    component_id is the smallest doc_id among all rows whose fingerprint can be reached over links of at most `most`
    differing bits. Null doc_ids never are a component's id unless it has no other. Null, blank and empty texts
    have fingerprint 0 and link like any other; repeated rows give repeated rows; an empty table gives none. Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(fingerprints(docs, words, id_column, text_column), "fingerprints")
    member, distinct = groups(rows, scratch, most, chunk)
    of = member.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = member.join(of, "root").select(F.col("fp").alias("_fp"), "component_id")
    every = distinct.join(linked, F.col("fp") == F.col("_fp"), "left").select("fp", F.when(F.col("_fp").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(every, "fp").select("doc_id", "fp", "component_id")
