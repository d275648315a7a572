"""Grouping of spelling variants by a trie self-join with active-node sets.

Words are near if one inserted, deleted or replaced code point makes them equal. The vocabulary is a trie. A node's
active nodes are those whose spelling is at most one edit away: the node itself, with no edit spent, and others with
one. Children inherit: from the node itself come, with the edit spent, all pairs of its children (a replaced code
point) and the pairs of the node and its children (an inserted one); from a pair with the edit spent only pairs of
children under the same code point. Where both nodes of a pair end a word, that is a pair of near words. All pairs of a
level are handled at once, as arrays.

The trie is partitioned by prefixes. Near words first differ either behind their third code point or before. Those of
the first kind share their first three code points, hence a partition. Those of the second kind share their last three,
as words have six code points or more; they are found in the mirror trie, of words spelled backwards, of which only the
last three levels under a node matter. So every word is in two partitions, whatever its neighbours.

A partition above `most` words is divided by longer prefixes, until its parts are small enough. What differs first at a
level that was divided, has equal rests behind the edit: such words meet by prefix and rest (with the code point
dropped or not). At most as many words as there are letters share these, so that no key is hot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, lean, mapped, ragged, ship, slices, whole_keys

#: Letters are A-Z, a-z and U+00C0 to U+00FF, so that a word has as many bytes in Latin-1 as code points.
#: Here: A-Z in lower case, a-z and bytes beyond ASCII as they are, all else a space.
ASCII_LETTERS = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)
#: Longer runs get their checksum one by one.
LONG = 48
SHARED = 3


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc32_of(state: np.ndarray, words: pa.Array, of: np.ndarray) -> np.ndarray:
    """CRC-32 of what led to each state, followed by words[of[i]]."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    size = np.diff(ends)[of]
    out = state.copy()
    order = np.argsort(size, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if not len(part):
            continue
        if size[part[0]] > LONG:
            out[part] = [zlib.crc32(data[ends[w] : ends[w + 1]].tobytes(), int(s)) for s, w in zip(state[part], of[part], strict=True)]
            continue
        at, now = ends[of[part]], ~state[part]
        for j in range(size[part[0]]):
            now = (now >> 8) ^ CRC[(now ^ data[at + j]) & 0xFF]
        out[part] = ~now
    return out


def runs_of_letters(texts: pa.Array) -> Words:
    """Runs of letters of each text, A-Z in lower case."""

    def change(data: np.ndarray) -> np.ndarray:
        out = ASCII_LETTERS[data]
        accented = data == 0xC3  # and the byte behind it: U+00C0 to U+00FF
        accented[1:] |= accented[:-1]
        out[(data >= 0x80) & ~accented] = 0x20
        return out

    return Words(mapped(texts, change))


def count_words(docs: DataFrame, drop_one_in: int, least_letters: int, id_column: str, text_column: str) -> DataFrame:
    """(word, n), added up in each slice of texts; words of fewer letters are left out.

    Of runs whose CRC-32 of "<id>:<run>" is divisible by drop_one_in, one code point is dropped: that at CRC modulo length.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = runs_of_letters(part.column("text"))
                size = max(1, len(words.dictionary))
                pair, n = np.unique(words.rows * size + words.codes, return_counts=True)
                long = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False) if len(words.dictionary) else np.zeros(1, int)
                use = long[pair % size] >= least_letters
                pair, n = pair[use], n[use]
                row, code = pair // size, pair % size
                ids = part.column("id").to_pylist()
                first = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
                h = crc32_of(first[row], words.dictionary, code) if len(pair) else np.zeros(0, np.uint32)
                cut = h % drop_one_in == 0
                total = np.bincount(code[~cut], n[~cut], size).astype(np.int64)
                held = np.flatnonzero(total)
                spelled = words.dictionary.take(pa.array(code[cut])).to_pylist()
                spelled = [w[: int(x) % len(w)] + w[int(x) % len(w) + 1 :] for w, x in zip(spelled, h[cut], strict=True)]
                some = np.array([len(w) >= least_letters for w in spelled], bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([words.dictionary.take(pa.array(held)), pa.array([w for w, s in zip(spelled, some, strict=True) if s], pa.string())]), pa.array(np.concatenate([total[held], n[cut][some]]))],
                    ["word", "n"],
                )

    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(lean(run), "word string, n long")


class Trie:
    """A trie of sorted, distinct words in Latin-1: for each level its nodes, each a range of words; children stand together."""

    def __init__(self, words: np.ndarray):
        self.size = np.char.str_len(words).astype(np.int64)
        n, width = len(words), words.dtype.itemsize
        self.letters = np.frombuffer(words.tobytes(), np.uint8).reshape(n, width)
        alike = np.ones(n, bool)  # with the word before, up to the level
        alike[:1] = False
        inside = np.arange(n)
        self.first: list[np.ndarray] = [np.zeros(min(n, 1), np.int64)]
        self.label: list[np.ndarray] = [np.zeros(min(n, 1), np.uint8)]
        self.children: list[np.ndarray] = []  # bounds: node i of a level has children[i]:children[i + 1] of the next
        node_of = np.zeros(n, np.int64)
        for level in range(1, width + 1):
            inside = inside[self.size[inside] >= level]
            alike[inside] &= np.concatenate([[False], (inside[1:] == inside[:-1] + 1) & (self.letters[inside[1:], level - 1] == self.letters[inside[:-1], level - 1])])[: len(inside)]
            first = inside[~alike[inside]]
            above = node_of[first]
            self.children.append(np.searchsorted(above, np.arange(len(self.first[-1]) + 1)))
            node_of[inside] = np.cumsum(~alike[inside]) - 1
            self.first.append(first)
            self.label.append(self.letters[first, level - 1])
        self.children.append(np.zeros(len(self.first[-1]) + 1, np.int64))

    def ends(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Whether a word ends at the nodes: it is their first, then."""
        return self.size[self.first[level][nodes]] == level

    def under(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in nodes, child) of all children."""
        low, high = self.children[level][nodes], self.children[level][nodes + 1]
        return np.repeat(np.arange(len(nodes)), high - low), ragged(low, high - low)

    def down(self, level: int, u: np.ndarray, more: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children under the same letter, of nodes u of the level and v of level + more."""
        place, a = self.under(level, u)
        key = v[place] * 256 + self.label[level + 1][a]
        bounds = self.children[level + more]
        parent = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        keys = parent * 256 + self.label[level + more + 1]
        at = np.searchsorted(keys, key)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == key[hit]
        return a[hit], at[hit]


#: Pairs of children that are followed down together.
GO = 1 << 20


def near_pairs(words: np.ndarray, depth: np.ndarray, within: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near words that first differ behind the prefix of `depth` letters of their partition; each pair once.

    within: only words that end at most so many letters behind where they first differ.
    """
    trie = Trie(words)
    top = len(trie.children) - 1

    def follow(level: int, u: np.ndarray, more: int, v: np.ndarray, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len(u) and level + more <= last:
            both = trie.ends(level, u) & trie.ends(level + more, v)
            if both.any():
                yield trie.first[level][u[both]], trie.first[level + more][v[both]]
            if level + more >= top:
                return
            u, v = trie.down(level, u, more, v)
            level += 1

    for level in range(top):
        last = top if within is None else level + within
        nodes = np.flatnonzero(depth[trie.first[level]] <= level)
        if not len(nodes):
            continue
        below = None
        if within is not None and len(trie.first[level + 1]):
            # The least length under each child; children cover runs of words, with what ends above them in between.
            first = trie.first[level + 1]
            below = np.minimum.reduceat(np.where(trie.size > level, trie.size, 1 << 30), first)
        count = np.diff(trie.children[level])[nodes]
        for part in np.split(nodes, np.flatnonzero(np.diff(np.cumsum(count * (count + 1)) // GO)) + 1):
            place, a = trie.under(level, part)
            if below is not None:
                some = below[a] <= level + within
                place, a = place[some], a[some]
            if not len(a):
                continue
            # Replaced: each child with those after it under the same node.
            end = np.searchsorted(place, place, side="right")
            later = end - np.arange(len(a)) - 1
            i, j = np.repeat(np.arange(len(a)), later), ragged(np.arange(len(a)) + 1, later)
            yield from follow(level + 1, a[i], 0, a[j], last)
            # Inserted: the node and a child, which part at once; the same letter again would be a later difference.
            u = part[place]
            both = trie.ends(level, u) & trie.ends(level + 1, a)
            if both.any():
                yield trie.first[level][u[both]], trie.first[level + 1][a[both]]
            if level + 1 < top:
                x, y = trie.down(level, u, 1, a)
                parted = trie.label[level + 1][x] != trie.label[level + 1][_parents(trie, level + 1, y)]
                yield from follow(level + 1, x[parted], 1, y[parted], last)


def _parents(trie: Trie, level: int, nodes: np.ndarray) -> np.ndarray:
    return np.searchsorted(trie.children[level], nodes, side="right") - 1


def links(words: DataFrame, scratch: Scratch, most: int = 1 << 16) -> DataFrame:
    """(a, na, b, nb): each pair of near words of (word, n) once. Words are distinct, of six letters or more."""
    both = words.select(F.lit(0).alias("side"), F.col("word").alias("s"), "n").union(words.select(F.lit(1), F.reverse("word"), "n"))
    both = both.withColumn("depth", F.lit(SHARED))
    divided = None
    open_, settled = both, None
    while True:
        prefix = F.expr("substring(s, 1, depth)")
        full = open_.where(F.length("s") > F.col("depth")).groupBy("side", prefix.alias("prefix")).agg(F.count("*").alias("size")).where(F.col("size") > most)
        full = scratch.keep(full.select(F.col("side").alias("_side"), "prefix"), "full")
        if full.isEmpty():
            break
        # One level down, and only for the words of partitions that are too large.
        marked = scratch.keep(open_.join(full, (F.col("side") == F.col("_side")) & (prefix == F.col("prefix")), "left"), "divided")
        done, deeper = marked.where("prefix is null").select(*both.columns), marked.where("prefix is not null").select(*both.columns)
        settled = done if settled is None else settled.union(done)
        divided = deeper if divided is None else divided.union(deeper)
        open_ = deeper.withColumn("depth", F.col("depth") + 1)
    rows = open_ if settled is None else open_.union(settled)
    rows = rows.withColumn("part", F.xxhash64("side", F.expr("substring(s, 1, depth)"))).repartition("part").sortWithinPartitions("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, ["part"], most, 64 << 20):
            side, depth, n = (t.column(c).to_numpy() for c in ("side", "depth", "n"))
            spelled = np.array([s.encode("latin-1") for s in t.column("s").to_pylist()])
            for which in (0, 1):
                rows = np.flatnonzero(side == which)
                # Words of like length are joined together, so that one long word doesn't widen all; near ones differ by one at most.
                for mine in by_length(rows, np.char.str_len(spelled[rows]) if len(rows) else rows):
                    order = mine[np.argsort(spelled[mine])]
                    words = spelled[order]
                    for a, b in near_pairs(words, depth[order], SHARED if which else None):
                        if which:  # those that differ behind their third letter are found in the other trie
                            ahead = [words[x].tobytes() for x in (a, b)]
                            width = words.dtype.itemsize
                            p, q = (np.frombuffer(x, np.uint8).reshape(-1, width) for x in ahead)
                            i = np.arange(len(a))
                            alike = np.ones(len(a), bool)
                            for k in range(1, SHARED + 1):
                                alike &= p[i, np.char.str_len(words[a]) - k] == q[i, np.char.str_len(words[b]) - k]
                            a, b = a[~alike], b[~alike]
                        if len(a):
                            text = [pa.array([w.decode("latin-1")[:: -1 if which else 1] for w in words[x].tolist()], pa.string()) for x in (a, b)]
                            yield pa.RecordBatch.from_arrays([text[0], pa.array(n[order[a]]), text[1], pa.array(n[order[b]])], ["a", "na", "b", "nb"])

    out = rows.mapInArrow(lean(run), "a string, na long, b string, nb long")
    if divided is None:
        return out
    # Words of a divided partition that part at its level: equal rests behind the edit.
    cut = lambda c: F.expr(c)
    rests = divided.select("side", "depth", "s", "n", F.explode(F.array(
        F.struct(F.lit(False).alias("has"), cut("substring(s, depth + 1)").alias("rest")),
        *[F.when(F.length("s") > F.col("depth"), F.struct(F.lit(True).alias("has"), cut("substring(s, depth + 2)").alias("rest")))],
    )).alias("e")).where("e is not null").select("side", "depth", cut("substring(s, 1, depth)").alias("prefix"), "e.rest", "e.has", "s", "n")
    left = rests.where("has").select("side", "depth", "prefix", "rest", F.col("s").alias("x"), F.col("n").alias("nx"))
    right = rests.select("side", "depth", "prefix", "rest", F.col("has").alias("other"), F.col("s").alias("y"), F.col("n").alias("ny"))
    met = left.join(right, ["side", "depth", "prefix", "rest"])
    parted = (F.col("other") & (F.col("x") < F.col("y"))) | (~F.col("other") & ((F.col("rest") == "") | (cut("substring(x, depth + 1, 1)") != cut("substring(rest, 1, 1)"))))
    ahead = (F.col("side") == 0) | (F.expr(f"right(x, {SHARED})") != F.expr(f"right(y, {SHARED})"))
    spelled = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    return out.union(met.where(parted & ahead).select(spelled("x"), "nx", spelled("y"), "ny"))


def by_length(rows: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of rows whose lengths differ by a gap of more than one from all others, at most."""
    order = np.argsort(size, kind="stable")
    if len(order):
        gap = np.flatnonzero(np.diff(size[order]) > 1) + 1
        for part in np.split(order, gap):
            yield rows[part]


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of (word, form): where forms lead. A form's count is a multiple of its word's, so chains are short and have no circles; each step doubles what it has gone."""
    now = scratch.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = scratch.keep(now.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")
        now._scratch_path = after._scratch_path


def variants(docs: DataFrame, least_letters: int = 6, least_count: int = 5, factor: int = 5, drop_one_in: int = 199, most: int = 1 << 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least `least_letters` code points and `least_count` occurrences.

    form is the near word of largest n (ties: first in code-point order) if its n is at least `factor` times the word's,
    else null; root is where forms lead, the word itself without one. n_near counts near words. least_letters is six or
    more. Null, empty and wordless texts count for nothing; equal rows are counted each; a null id reads as empty; an
    empty table gives no rows; other columns are not read.
    """
    if least_letters < 2 * SHARED:
        raise ValueError(f"words of fewer than {2 * SHARED} letters may differ where neither trie looks")
    scratch = Scratch(docs.sparkSession)
    counted = count_words(docs, drop_one_in, least_letters, id_column, text_column).groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.keep(counted.where(F.col("n") >= least_count), "words")
    pairs = scratch.keep(links(words, scratch, most), "pairs")
    near = pairs.select(F.col("a").alias("w"), F.col("b").alias("form"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = near.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "form")).alias("best"))
    held: Column = -F.col("best.m") >= factor * F.col("n")
    rows = words.join(best, F.col("word") == F.col("w"), "left")
    rows = rows.select("word", F.when(held, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, -F.col("best.m")).alias("form_n"))
    rows = scratch.keep(rows, "forms")
    root = roots(rows.where("form is not null"), scratch).withColumnRenamed("word", "_w")
    return rows.join(root, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
