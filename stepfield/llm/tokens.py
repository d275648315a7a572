"""Token ids of whole texts, and a compressed file format for them.

Encoding: the tokenizers library gives the ids. A text's words are independent of each other for a vocabulary
whose pre-tokenizer never crosses white space, so each distinct word is encoded once and its ids are reused.
`TextEncoder` asks the vocabulary whether that holds and gives it whole texts where it does not.

File format (all integers little-endian). A file holds blocks; each block can be decoded alone:

    magic   8 bytes  b"SFTOKEN1"
    block*  header of six uint32 (documents, ids, bits, checkpoint step, checkpoints, body bytes),
            int64 document ids with a null flag byte each, uint32 ids per document, uint64 bit offsets of the
            checkpoints, then the Huffman bits (most significant first), padded to whole bytes plus 8 zero bytes

The code is canonical: code lengths (at most `limit` bits, by package-merge) of all ids come from global counts
and are stored once beside the files (`code.npy`); codes follow from lengths and ids. Decoding reads a table
indexed by the next `limit` bits. A checkpoint is kept every `step` ids, so that all stretches between
checkpoints are decoded side by side.
"""

from __future__ import annotations

import io
import os
import re
import struct
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, binary_rows, lean, ragged, release, remembered, ship, slices

MAGIC = b"SFTOKEN1"
HEADER = struct.Struct("<6I")
#: Name of a file by its number.
FILE = "part-%d.sft"


class TextEncoder:
    """Encodes whole texts with a vocabulary file of the tokenizers library, word by word where that gives the same ids.

    It does for vocabularies that drop white space before merging (no piece spans it), as the registered one.
    A word of Latin letters (U+0041-5A, 61-7A, C0-FF without the two signs) and then some of `TAIL` consists of
    two independent pieces, the letters and the tail, and its letters count in lower case, so these are encoded
    apart. Every other word is encoded as it stands. Pieces are remembered, up to `most` of them; then those that
    several calls have met stay, half as many at most, and the others are forgotten.
    All this is tried on every letter, white space, tail and pair of tail characters; a vocabulary that differs
    anywhere gets whole texts.
    """

    TAIL = ".,!?;:*$%&#|<>"
    LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"

    def __init__(self, path: str, most: int = 400_000):
        # Spark gives each core a task: threads of the library only take memory beside it.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        size = self.tokenizer.get_vocab_size()
        self.closing = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.apart = self._apart()
        self.bare = self._bare() if self.apart else None
        self.known: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start, self.count, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _apart(self) -> bool:
        """Whether the vocabulary keeps words, and the letters and tail of a word, apart and lower-cases letters."""

        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        letters = [c for c in map(chr, range(0x41, 0x100)) if re.match(self.LETTERS, c)]
        stems = [c + rest for c in letters for rest in ("", "ing")]
        tails = [a + b for a in self.TAIL for b in ("", *self.TAIL)]
        return (
            all(ids(w) == ids(w.lower()) and int(self.closing[ids(w)].sum()) == 1 for w in stems)
            and all(ids(w + t) == ids(w) + ids(t) for w in ("the", "\xe9t\xe9") for t in tails)
            and all(ids(f"ab{s}cd.{s}") == ids("ab") + ids("cd.") for s in " \t\n\v\f\r")
        )

    def _bare(self) -> dict[int, str] | None:
        """What the pre-tokenizer makes of each lower-case letter, if that and the model alone give the ids of letters in any place."""
        letters = sorted({c for c in map(str.lower, map(chr, range(0x41, 0x100))) if re.match(self.LETTERS, c)})
        before = self.tokenizer.pre_tokenizer
        table = {ord(c): "".join(t for t, _ in before.pre_tokenize_str(c)) if before else c for c in letters}
        words = [*letters, *(a + b for a in letters for b in letters), *(f"the{c}ing" for c in letters)]
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return table if all(e.ids == [t.id for t in self.tokenizer.model.tokenize(w.translate(table))] for w, e in zip(words, got, strict=True)) else None

    def _whole(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        ids = [np.array([*e.ids, end], np.uint32) for e in got]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _forget(self) -> None:
        n = len(self.known)
        stay = np.flatnonzero(self.met[:n] > 1)
        if len(stay) > self.most // 2:
            stay = np.sort(stay[np.argsort(-self.met[stay], kind="stable")[: self.most // 2]])
        stay = np.union1d([0], stay)
        names = list(self.known)
        self.known = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.flat = self.flat[ragged(self.start[stay], self.count[stay])]
        self.used = len(self.flat)
        self.count, self.met = self.count[stay], self.met[stay]
        self.start = np.cumsum(self.count) - self.count

    def _add(self, pieces: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        n, k = len(self.known), len(pieces)
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(flat)), np.uint32)])
        if n + k > len(self.start):
            self.start, self.count, self.met = (np.concatenate([a, np.zeros(max(len(a), k), np.int64)]) for a in (self.start, self.count, self.met))
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + k] = self.used + np.cumsum(counts) - counts
        self.count[n : n + k] = counts
        self.used += len(flat)
        self.known.update(zip(pieces, range(n, n + k), strict=True))

    def _plain(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 1 << 14):
            some = pieces[at : at + (1 << 14)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.array([i for ids in got for i in ids], np.uint32), np.array([len(i) for i in got], np.int64))

    def _letters(self, pieces: list[str]) -> None:
        """Pieces of lower-case letters only: by the model alone where it suffices, else many at a time, as each ends with its first closing id."""
        if self.bare:
            tokenize = self.tokenizer.model.tokenize
            for at in range(0, len(pieces), 1 << 14):
                got = [[t.id for t in tokenize(p.translate(self.bare))] for p in pieces[at : at + (1 << 14)]]
                self._add(pieces[at : at + (1 << 14)], np.array([i for ids in got for i in ids], np.uint32), np.fromiter(map(len, got), np.int64, len(got)))
            return
        for at in range(0, len(pieces), 1 << 14):
            some = pieces[at : at + (1 << 14)]
            joined = [" ".join(some[i : i + 512]) for i in range(0, len(some), 512)]
            ids = np.concatenate([np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(some):
                self._plain(some)
            else:
                self._add(some, ids.astype(np.uint32), np.diff(ends, prepend=0))

    def _entries(self, pieces: pa.Array, learn) -> np.ndarray:
        """The entry of each piece; what is not known yet is learnt."""
        coded = pieces.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        of = np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(of < 0)
        if len(new):  # entries are numbered as they are learnt
            of[new] = np.arange(len(self.known), len(self.known) + len(new))
            learn([texts[i] for i in new.tolist()])
        self.met[of] += 1
        return of[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (uint32), each text closed by `end`, and their number in each text."""
        if not self.apart:
            return self._whole(texts, end)
        if len(self.known) > self.most:
            self._forget()
        words = Words(texts)
        d = words.dictionary
        stems = pc.utf8_rtrim(d, characters=self.TAIL)
        simple = pc.match_substring_regex(stems, self.LETTERS)
        odd = np.flatnonzero(~simple.to_numpy(zero_copy_only=False))
        entry = np.zeros((len(d), 2), np.int64)
        plain = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        if len(plain):
            entry[plain, 0] = self._entries(pc.utf8_lower(stems.filter(simple)), self._letters)
            longer = plain[pc.greater(pc.binary_length(d.filter(simple)), pc.binary_length(stems.filter(simple))).to_numpy(zero_copy_only=False)]
            # The tail is what the stem leaves of the word.
            cut = pc.utf8_length(stems).to_numpy(zero_copy_only=False)
            w = d.take(pa.array(longer))
            tails = [t[c:] for t, c in zip(w.to_pylist(), cut[longer].tolist(), strict=True)]
            if tails:
                entry[longer, 1] = self._entries(pa.array(tails), self._plain)
        if len(odd):
            entry[odd, 0] = self._entries(d.take(pa.array(odd)), self._plain)
        two = self.count[entry]
        each = two.sum(1)
        flat = self.flat[ragged(self.start[entry].ravel(), two.ravel())]
        start = np.cumsum(each) - each
        ends = np.concatenate([[0], np.cumsum(each[words.codes])])
        n = np.diff(ends[words.bounds])
        ids = np.empty(ends[-1], np.uint32)
        for at in range(0, len(words), 1 << 14):  # places of all ids at once would take many times their bytes
            some = words.codes[at : at + (1 << 14)]
            ids[ends[at] : ends[at + len(some)]] = flat[ragged(start[some], each[some])]
        out = np.empty(len(ids) + len(n), np.uint32)
        place = np.ones(len(out), bool)
        last = np.cumsum(n + 1) - 1
        place[last] = False
        out[last] = end
        out[place] = ids
        return out, n + 1


_encoders: dict[str, TextEncoder] = remembered("encoder")


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, vocab: str, end: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, n_tokens long, ids binary of little-endian uint16 or uint32, wide boolean) for every row.

    ids are stored in two bytes where all of them fit. A null text has the end id only; other columns are not read.
    `vocab` names a file of the public tokenizers on each machine.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary(vocab))
        narrow = enc.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, n = enc.encode(part.column("text"), end)
                flat = ids.astype("<u2" if narrow else "<u4")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), binary_rows(flat, n), pa.array(np.full(len(n), not narrow))], ["doc_id", "n_tokens", "ids", "wide"])
                del ids, flat
                release()  # else what each step has freed adds up while the JVM's heap is full

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(lean(run, "encoder"), "doc_id long, n_tokens long, ids binary, wide boolean")


def unpack(ids: pa.Array, wide: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids (uint32) and their number in each row of what `tokenized` gives."""
    sizes = pc.binary_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    w = wide.to_numpy(zero_copy_only=False)
    data = b"".join(ids.to_pylist())
    if len(w) == 0 or not w.any():
        return np.frombuffer(data, "<u2").astype(np.uint32), sizes // 2
    return np.frombuffer(data, "<u4").astype(np.uint32), sizes // 4


# --- Huffman code --------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids have no code of at most {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # Each round merges the pairs of the round before with the leaves; how many of the chosen items of a round are
    # leaves tells how many ids get one bit more from it.
    level, leaf = weights, np.ones(len(order), bool)
    levels = [leaf]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, pairs])
        by = np.argsort(merged, kind="stable")
        level, leaf = merged[by], (by < len(order))
        levels.append(leaf)
    take = 2 * len(order) - 2
    out = np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes that follow from the lengths: shorter first, then by id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, before = 0, 0
    ls = lengths[order].astype(int)
    for size in np.unique(ls):
        members = order[ls == size]
        code <<= int(size) - before
        codes[members] = np.arange(code, code + len(members), dtype=np.uint64)
        code, before = code + len(members), int(size)
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.codes = canonical(lengths)
        self.bits = max(1, int(lengths.max(initial=0)))
        self._table = None

    def pack(self, ids: np.ndarray, step: int) -> tuple[bytes, int, np.ndarray]:
        """The bits of the ids, their number, and the bit offset of every step-th id."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        at = end - size
        total = int(end[-1]) if len(ids) else 0
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        value = self.codes[ids] << (np.uint64(64) - shift - size.astype(np.uint64))
        hi, lo = (value >> np.uint64(32)).astype(np.uint32), value.astype(np.uint32)
        out = np.zeros((total >> 5) + 3, np.uint32)
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] |= np.bitwise_or.reduceat(hi, first)
            out[word[first] + 1] |= np.bitwise_or.reduceat(lo, first)
        return out.astype(">u4").tobytes()[: (total + 7) // 8 + 8], total, at[::step].astype(np.uint64)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for every value of the next `bits` bits."""
        if self._table is None:
            ids, sizes = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.int64)
            used = np.flatnonzero(self.lengths)
            spans = (np.uint64(1) << (np.uint64(self.bits) - self.lengths[used].astype(np.uint64))).astype(np.int64)
            starts = (self.codes[used] << (np.uint64(self.bits) - self.lengths[used].astype(np.uint64))).astype(np.int64)
            where = ragged(starts, spans)
            ids[where], sizes[where] = np.repeat(used, spans), np.repeat(self.lengths[used], spans)
            self._table = ids, sizes
        return self._table

    def unpack(self, body: bytes, n: int, marks: np.ndarray, step: int) -> np.ndarray:
        """The n ids, with all stretches between checkpoints decoded side by side."""
        table, sizes = self.table()
        words = np.frombuffer(body + b"\0" * (12 - len(body) % 4), ">u4").astype(np.uint64)
        out = np.zeros((len(marks), step), np.uint32)
        at = marks.astype(np.int64)
        left = np.minimum(step, n - np.arange(len(marks)) * step)
        mask = np.uint64((1 << self.bits) - 1)
        for k in range(step):
            if n and left[-1] == k:  # only the last stretch is shorter
                at, left = at[:-1], left[:-1]
            if not len(at):
                break
            word = at >> 5
            window = (words[word] << np.uint64(32)) | words[word + 1]
            got = ((window >> (np.uint64(64 - self.bits) - (at & 31).astype(np.uint64))) & mask).astype(np.int64)
            out[: len(at), k] = table[got]
            at = at + sizes[got]
        return out.ravel()[:n]


def write_block(out, code: Code, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, step: int) -> None:
    body, bits, marks = code.pack(ids, step)
    out.write(HEADER.pack(len(doc_ids), len(ids), bits, step, len(marks), len(body)))
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids))
    out.write(counts.astype("<u4").tobytes() + marks.astype("<u8").tobytes() + body)


def read_blocks(src, code: Code) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, ids per document, ids) of each block in turn. Raises ValueError on a damaged file."""
    if src.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := src.read(HEADER.size):
        docs, n, bits, step, marks, size = HEADER.unpack(head)
        raw = src.read(docs * 13 + marks * 8 + size)
        if len(raw) != docs * 13 + marks * 8 + size:
            raise ValueError("the file ends inside a block")
        ids, null = np.frombuffer(raw, "<i8", docs), raw[docs * 8 : docs * 9]
        counts = np.frombuffer(raw, "<u4", docs, docs * 9).astype(np.int64)
        at = np.frombuffer(raw, "<u8", marks, docs * 13)
        if counts.sum() != n or bits > 8 * size:
            raise ValueError("a block's counts disagree")
        yield [None if z else int(i) for i, z in zip(ids, null, strict=True)], counts, code.unpack(raw[docs * 13 + marks * 8 :], n, at, step)


# --- Files ---------------------------------------------------------------------------------------------------------


def open_store(path: str):
    """(filesystem, path in it) of a folder that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def store_bytes(folder: str, name: str, fill: Callable) -> None:
    """Write a file as a whole or not at all; a repeated task replaces it by an equal one."""
    import uuid

    store, base = open_store(folder)
    store.create_dir(base, recursive=True)
    half = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(half, compression=None) as out:
        fill(out)
    store.move(half, f"{base}/{name}")


def write_token_files(docs: DataFrame, vocab: str, end: int, folder: str, scratch: Scratch, *, limit: int = 18, step: int = 128, block: int = 1 << 18, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text and write the files `part-N.sft` and `code.npy` to `folder`; ids in ascending doc_id order.

    Returns (file, first long): the name of each file and the number of ids in all files before it. Files follow
    each other by number. Rows with a null doc_id come first; rows that share a doc_id follow each other, ordered by
    a hash of their ids, and may lie in several files. A block holds about `block` ids; one document's ids are never split. Peak memory of a task: one
    block and one partition's sorted rows (Spark spills those). Empty input: no file and no row.
    """
    spark = docs.sparkSession
    rows = scratch.keep(tokenized(docs, vocab, end, id_column, text_column), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for part in slices(b, "ids"):
                got = np.bincount(unpack(part.column("ids"), part.column("wide"))[0])
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    # At most as many rows as the vocabulary has ids.
    found = rows.select("ids", "wide").mapInArrow(lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found.id.max()) + 1 if len(found) else 1, np.int64)
    counts[found.id.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    lengths = code_lengths(counts, limit)

    # Ranges of doc_id hold about 16 million ids each; a single document is never split.
    parts = max(1, int(counts.sum() // (16 << 20)) + 1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, number = Code(lengths), TaskContext.get().partitionId()
        total, name = 0, FILE % number

        def fill(out) -> None:
            nonlocal total
            out.write(MAGIC)
            ids_of, held, size = [], [], 0

            def flush() -> None:
                nonlocal ids_of, held, size, total
                if ids_of:
                    write_block(out, code, ids_of, np.concatenate([n for n, _ in held]), np.concatenate([i for _, i in held]), step)
                    total += size
                ids_of, held, size = [], [], 0

            for b in batches:
                for part in slices(b, "ids", 2 * block):
                    flat, n = unpack(part.column("ids"), part.column("wide"))
                    ids_of += part.column("doc_id").to_pylist()
                    held.append((n, flat))
                    size += len(flat)
                    if size >= block:
                        flush()
            flush()

        first = next(iter(batches), None)
        while first is not None and not first.num_rows:
            first = next(iter(batches), None)
        if first is None:
            return
        rest, head = batches, first

        def chained() -> Iterator[pa.RecordBatch]:
            yield head
            yield from rest

        batches = chained()
        store_bytes(folder, name, fill)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([total])], ["number", "n"])

    def save(out) -> None:
        held = io.BytesIO()
        np.save(held, lengths)
        out.write(held.getvalue())

    store_bytes(folder, "code.npy", save)
    # A doc_id that very many rows share is cut between files too; the row's place in the table settles the order of equal rows.
    order = [F.col("doc_id").asc_nulls_first(), "hash", "place"]
    ordered = rows.select("doc_id", "ids", "wide", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("place")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = scratch.keep(ordered.select("doc_id", "ids", "wide").mapInArrow(lean(write), "number int, n long"), "files")
    scratch.drop(rows)
    return _offsets(files)


def _offsets(files: DataFrame, cell: int = 4096) -> DataFrame:
    """(file, first) from (number, n): the ids before each file. Files are added up in cells; one task sees a row for each cell."""
    files = files.withColumn("cell", F.floor(F.col("number") / cell))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = files.groupBy("cell").agg(F.sum("n").alias("n")).select(F.col("cell").alias("_cell"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("number", "cell", inside.alias("inside")).join(cells, F.col("cell") == F.col("_cell"))
    return placed.select(F.format_string(FILE, "number").alias("file"), (F.col("base") + F.col("inside")).alias("first"))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id long, start long, n_tokens long, ids binary of little-endian uint32) of every document in the files."""
    spark = files.sparkSession
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        code = None
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("first").to_pylist(), strict=True):
                if code is None:
                    with store.open_input_stream(f"{base}/code.npy") as src:
                        code = Code(np.load(io.BytesIO(src.read())))
                with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as src:
                    for ids_of, counts, ids in read_blocks(src, code):
                        ends = start + np.cumsum(counts)
                        yield pa.RecordBatch.from_arrays([pa.array(ids_of, pa.int64()), pa.array(ends - counts), pa.array(counts), binary_rows(ids.astype("<u4"), counts)], ["doc_id", "start", "n_tokens", "ids"])
                        start = int(ends[-1])

    n = max(1, files.count())
    return files.repartition(n, "file").mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids binary")
