"""Removal of word sequences that occur earlier in the corpus: seed and extend.

A window is `size` consecutive words of one text. A word goes if some window over it has the same words as a window
that starts earlier (smaller doc_id, or the same document and an earlier start).

Seeds: of the `size - seed + 1` runs of `seed` words in a window, the one with the least hash is its anchor
(winnowing), so equal windows always have equal anchors. Documents are joined on anchors; one that occurs only once
ends there. Extension: each occurrence of a shared anchor is extended both ways as far as the windows reach that it is
the anchor of. Occurrences with the same words all the way (a key of 128 bits) are one match, settled by the earliest
of them in one step for all their windows. Only the earliest of each is extended again, word by word, against the
others of its anchor: its windows meet theirs by keys of 96 bits. Comparing all pairs of an anchor's occurrences would
grow with the square of a passage's copies; here each occurrence costs the same, and no match is lost. Matches that
touch or overlap join to maximal repeats, which are what is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Sieve, Words, lean, ragged, same, ship, slices, unpacked, whole_row

BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(BASE), k, 1 << 64))


def run_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the `size` items from each position on (the last size - 1 positions are not meaningful)."""
    out, done, part, width = np.zeros(len(h), np.uint64), 0, h, 1
    while size:
        if size & 1:
            out[: len(h) - done] += part[done:] * _power(done)
            done += width
        size >>= 1
        if size:
            part = part + np.concatenate([part[width:], np.zeros(min(width, len(part)), np.uint64)]) * _power(width)
            width *= 2
    return out


def word_hashes(words: Words) -> np.ndarray:
    """Two 64-bit hashes (columns) of each word."""
    import xxhash

    digest = xxhash.xxh3_128_digest
    data = b"".join([digest(w) for w in words.dictionary.to_pylist()])
    return np.frombuffer(data, "<u8").reshape(-1, 2)[words.codes]


def anchors(h: np.ndarray, bounds: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, position of its anchor, hash of the run at every position)."""
    n = np.diff(bounds)
    room = np.maximum(n - size + 1, 0)
    starts = np.repeat(bounds[:-1] - (np.cumsum(room) - room), room) + np.arange(room.sum())
    g = _mix(run_hash(h, seed))
    # The position in the low half: of equal hashes the leftmost wins, by contents alone.
    low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span, width = size - seed + 1, 1
    while width < span:
        by = min(width, span - width)
        moved = np.concatenate([low[by:], np.full(min(by, len(low)), ~np.uint64(0))])
        low = np.minimum(low, moved)
        width += by
    at = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return starts, at, g


def again(row: np.ndarray, start: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which items (row, start, keys of two columns) have an earlier start with equal keys in their row."""
    out = np.zeros(len(row), bool)
    mixed = _mix(keys[:, 0] ^ keys[:, 1] * BASE ^ _mix(row.astype(np.uint64) + np.uint64(1)))
    in_order = np.sort(mixed)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if len(twice):  # few, as a rule
        at = np.minimum(np.searchsorted(twice, mixed), len(twice) - 1)
        some = np.flatnonzero(twice[at] == mixed)
        order = some[np.lexsort((start[some], keys[some, 1], keys[some, 0], row[some]))]
        a, b = order[:-1], order[1:]
        out[b] = (row[a] == row[b]) & (keys[a] == keys[b]).all(1)
    return out


def segments(words: Words, h: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, extended over all their windows: (row, first window's start, number of windows, keys of two columns).

    Keys: of the anchor, and of all words of its windows and where in them it lies.
    """
    starts, at, g = anchors(h[:, 0], words.bounds, size, seed)
    if not len(starts):
        return starts, starts, starts, np.zeros((0, 2), np.uint64)
    row = words.rows[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    n = np.diff(np.append(first, len(starts)))
    low = starts[first]
    up = np.cumprod(np.full(len(h), BASE))
    down = np.cumprod(np.full(len(h), np.uint64(pow(int(BASE), -1, 1 << 64))))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[:, 1] * up)])
    span = (upto[low + n - 1 + size] - upto[low]) * down[low]
    span = _mix(span ^ _mix(((at[first] - low) * 4096 + n).astype(np.uint64)))
    return row[first], low, n, np.stack([g[at[first]], span], 1)


def segment_windows(text: pa.Array, wanted: list[np.ndarray], size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the segments whose second key is wanted: (row, start in its text, keys of two columns, whether the text has it earlier)."""
    words = Words(text)
    h = word_hashes(words)
    row, low, n, keys = segments(words, h, size, seed)
    hit = np.zeros(len(row), bool)
    edge = np.searchsorted(row, np.arange(len(text) + 1))
    for i, mine in enumerate(wanted):
        part = slice(edge[i], edge[i + 1])
        hit[part] = np.isin(keys[part, 1], mine)
    starts, row = ragged(low[hit], n[hit]), np.repeat(row[hit], n[hit])
    keys = np.stack([run_hash(h[:, 0], size)[starts], run_hash(h[:, 1], size)[starts]], 1) if len(starts) else np.zeros((0, 2), np.uint64)
    return row, starts - words.bounds[row], keys, again(row, starts, keys)


def covered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The union of ranges, as rows (first, end): those that touch are one."""
    order = np.argsort(starts, kind="stable")
    first, end = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return np.stack([first[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]], 1)


def spaced(text: str) -> bytes:
    """The words, joined by one space each."""
    data = text.encode("utf-8", "surrogatepass").translate(_SPACES)
    if b"  " in data or data[:1] == b" " or data[-1:] == b" ":
        data = b" ".join(data.split())
    return data


#: Starts and counts of windows are sent as one number.
PACK = 4096


def repeats(docs: DataFrame, scratch: Scratch, size: int = 20, seed: int = 8, own: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text and, if own, a unique long _uid; other columns are not read):
    (_uid long, doc_id long, n_words long, n_removed long, gone array<struct<first int, end int>>) and, unless own,
    kept_sha256 string.

    gone: the removed words as ranges of word numbers. A null text has no words and loses none, nor does one of fewer
    than `size` words. Rows are in order of doc_id (null before all); rows that share a doc_id count as documents of
    their own, in the order they are read. An empty table gives none.
    """
    if not seed <= size < PACK:
        raise ValueError(f"size must be from seed to {PACK - 1}")
    spark = docs.sparkSession
    ship(spark)
    md5 = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("h")
    text = docs.select(*(["_uid"] if own else []), F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if own else [md5]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("g", pa.int64()), ("s", pa.int64()), ("at", pa.int64())])
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                words = Words(part.column("text"))
                row, low, n, keys = segments(words, word_hashes(words), size, seed)
                at, later = (low - words.bounds[row]) * PACK + n, again(row, low, keys)
                upto = lambda which, row=row, rows=part.num_rows: pa.array(np.searchsorted(row[which], np.arange(rows + 1)), pa.int32())
                segs = pa.StructArray.from_arrays([pa.array(x[~later]) for x in (keys[:, 0].view(np.int64), keys[:, 1].view(np.int64), at)], fields=list(kind))
                cols = [c for c in ("_uid", "doc_id", "h") if c in part.schema.names]
                out = {c: part.column(c) for c in cols} | {"n_words": pa.array(np.diff(words.bounds))}
                if not own:
                    out["sha"] = pa.array([hashlib.sha256(spaced(t or "")).digest() for t in part.column("text").to_pylist()], pa.binary())
                out |= {"segs": pa.ListArray.from_arrays(upto(~later), segs), "again": pa.ListArray.from_arrays(upto(later), pa.array(at[later]))}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = ("_uid long, doc_id long, n_words long" if own else "doc_id long, h binary, n_words long, sha binary") + ", segs array<struct<g:long,s:long,at:long>>, again array<long>"
    table = text.mapInArrow(lean(scan), schema)
    table = scratch.keep(table if own else table.withColumn("_uid", F.monotonically_increasing_id()), "segments")

    # Seeds: anchors that occur twice. Written by itself, so that Spark can split the join of one that very many texts have.
    twice = table.select(F.explode("segs.g").alias("g")).groupBy("g").count().where("count > 1").select("g")
    shared = scratch.keep(table.select("doc_id", "_uid", F.inline("segs")).join(twice, "g"), "shared")
    least = F.min(F.struct("doc_id", "_uid")).alias("least")
    matches = scratch.keep(shared.groupBy("g", "s").agg(least, F.count("*").alias("n")), "matches")
    later = shared.join(matches.where("n > 1").select("g", "s", F.col("least._uid").alias("head")), ["g", "s"]).where("_uid <> head").select("_uid", "at")
    later = scratch.keep(later, "later")
    scratch.drop(shared)

    # Anchors whose matches differ: the earliest of each is extended window by window.
    several = matches.groupBy("g").count().where("count > 1").select("g")
    wanted = matches.join(several, "g").select(F.col("least._uid").alias("_uid"), "s").groupBy("_uid").agg(F.collect_list("s").alias("wanted"))
    if own:
        source = text.join(scratch.keep(wanted, "wanted"), "_uid")
    else:
        wanted = scratch.keep(wanted.join(table.select("_uid", "doc_id", "h"), "_uid").select("_uid", F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "wanted"), "wanted")
        source = text.join(wanted, same(F.col("doc_id"), F.col("_doc")) & (F.col("h") == F.col("_h")))
    scratch.drop(matches)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                lists = [np.array(x, np.int64).view(np.uint64) for x in part.column("wanted").to_pylist()]
                row, start, keys, twice = segment_windows(part.column("text"), lists, size, seed)
                short = (keys[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].view(np.int64)), pa.array(short), part.column("doc_id").take(at), part.column("_uid").take(at), pa.array(start.astype(np.int32)), pa.array(twice)], ["a", "b", "doc_id", "_uid", "start", "again"])

    # 96 bits of key: over all windows of 100 TB of text, a mistaken pair has a chance of about one in a thousand.
    windows = scratch.keep(source.select("doc_id", "_uid", "text", "wanted").mapInArrow(lean(extend), "a long, b int, doc_id long, _uid long, start int, again boolean"), "windows")
    own_first = windows.where("not again").select("a", "b", "doc_id", "_uid", "start")
    earliest = own_first.groupBy("a", "b").agg(least, F.count("*").alias("n")).where("n > 1").select("a", "b", F.col("least._uid").alias("head"))
    single = own_first.join(earliest, ["a", "b"]).where("_uid <> head").select("_uid", "start").union(windows.where("again").select("_uid", "start"))
    every = later.union(table.select("_uid", F.explode("again"))).union(single.select("_uid", F.col("start").cast("long") * PACK + 1))
    every = scratch.keep(every.groupBy("_uid").agg(F.collect_list("at").alias("at")), "found")
    scratch.drop(windows)
    scratch.drop(later)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            removed, gone = [], []
            for at in batch.column("at"):
                start, n = np.divmod(at.values.to_numpy(), PACK)
                ranges = covered(start, n - 1 + size)
                removed.append(int((ranges[:, 1] - ranges[:, 0]).sum()))
                gone.append([{"first": a, "end": b} for a, b in ranges.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("_uid"), pa.array(removed, pa.int64()), pa.array(gone, kind)], ["_uid", "removed", "gone"])

    ranges = "gone array<struct<first:int,end:int>>"
    merged = every.mapInArrow(lean(merge), f"_uid long, removed long, {ranges}")
    none = F.array().cast(ranges.removeprefix("gone "))
    if own:
        return table.select("_uid", "doc_id", "n_words").join(merged, "_uid", "left").select("_uid", "doc_id", "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("gone", none).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sha = []
                for t, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    kept, upto = [], 0
                    for r in gone:
                        kept += words[upto : r["first"]]
                        upto = r["end"]
                    sha.append(hashlib.sha256(b" ".join(kept + words[upto:])).digest())
                yield pa.RecordBatch.from_arrays([part.column("_uid"), pa.array(sha, pa.binary())], ["_uid", "cut_sha"])

    merged = scratch.keep(table.select("_uid", "doc_id", "n_words", "h").join(merged, "_uid"), "merged")
    # A text that is gone as a whole need not be read again.
    partly = merged.where("removed < n_words").select("_uid", F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "gone")
    hashed = text.join(partly, same(F.col("doc_id"), F.col("_doc")) & (F.col("h") == F.col("_h"))).select("_uid", "text", "gone")
    hashed = hashed.mapInArrow(lean(cut), "_uid long, cut_sha binary").dropDuplicates(["_uid"])
    nothing = F.when(F.col("removed") == F.col("n_words"), F.unhex(F.lit(hashlib.sha256(b"").hexdigest())))
    rows = table.select("_uid", "doc_id", "n_words", "sha").join(merged.select("_uid", "removed", "gone"), "_uid", "left").join(hashed, "_uid", "left")
    return rows.select(
        "_uid",
        "doc_id",
        "n_words",
        F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.lower(F.hex(F.coalesce(nothing, "cut_sha", "sha"))).alias("kept_sha256"),
        F.coalesce("gone", none).alias("gone"),
    )


def cut_repeats(docs: DataFrame, size: int = 20, seed: int = 8) -> DataFrame:
    """docs with the repeated words cut out of `text`; all rows and columns stay (n_chars, where there, is counted anew).

    Texts without a removed word are untouched, as are null and empty ones. In the others kept words keep the white
    space before them. Order, ties and repeated rows are those of `repeats`; columns of any name pass through; an empty
    table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    base = scratch.keep(docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("_uid")), "documents")
    place = docs.columns.index("text")
    work = Scratch(docs.sparkSession)
    text = base.select("_uid", "doc_id", F.col(f"row.c{place}").alias("text"))
    gone = scratch.keep(repeats(text, work, size, seed, True).where("n_removed > 0").select("_uid", "gone"), "gone")
    work.clear()
    word = r"[^\x20\x09-\x0D]+"

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(word)
        for batch in batches:
            out = []
            for t, ranges in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                spans = [m.span() for m in find.finditer(t)]
                keep, at = [], 0
                for r in ranges:
                    keep.append(t[at : spans[r["first"] - 1][1] if r["first"] else 0])
                    at = spans[r["end"] - 1][1]
                out.append("".join([*keep, t[at:]]).strip("\x20\t\n\x0b\x0c\r"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "cut"])

    # Rows that surely lose nothing stay where they are; the filter's others are looked up.
    may = Sieve(gone, "_uid").may_hold("_uid")
    # A merge join, as a broadcast would put the filter and `trim` into one task, each with a Python worker of its own.
    looked_up = base.where(may).join(gone.hint("merge"), "_uid", "left")
    untouched = base.where(~may).select("row").union(looked_up.where("gone is null").select("row"))
    cut = looked_up.where("gone is not null").select("row", F.col(f"row.c{place}").alias("text"), "gone")
    cut = cut.mapInArrow(lean(trim), T.StructType([base.schema["row"], T.StructField("cut", T.StringType())]))

    def column(i: int) -> Column:
        name = docs.columns[i]
        if i == place:
            return F.col("cut").alias(name)
        return (F.char_length("cut").cast(docs.schema[name].dataType) if name == "n_chars" else F.col(f"row.c{i}")).alias(name)

    return untouched.select(*unpacked("row", docs)).union(cut.select(*(column(i) for i in range(len(docs.columns)))))
