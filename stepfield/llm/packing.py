"""Lexical retrieval packing of documents into fixed windows.

Documents are dealt to shards by likeness: their token ids, weighted by how rare they are in all documents, are projected
at random to a few dimensions, and a document goes to the nearest of up to `CELLS` centres, fitted on a bounded sample.
A cell has as many shards as its tokens fill. Each shard holds a BM25 inverted index of its documents' token ids, weighted
by the document frequencies and the mean length of all documents. Only documents of one shard meet. A seed document
opens a window; the unused documents that score best for it follow, best first, and the last one is cut where the
window is full. Its rest seeds the next window, else the next unused document does. What a shard has left when its
documents end is dealt to sequences whose lengths are powers of two, so no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, binary_rows, lean, numbered, ragged, release, ship
from .tokens import tokenized, unpack


@dataclass
class Statistics:
    """Of a corpus: documents, their token ids, and how many documents have each id."""

    docs: int
    tokens: int
    df: np.ndarray


def distinct_pairs(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, document, times) of the distinct ids of each document, in order of id."""
    n = max(1, len(counts))
    kind = np.uint32 if (int(ids.max(initial=0)) + 1) * n <= 1 << 32 else np.int64  # four bytes sort in half the time
    pairs = ids.astype(kind) * kind(n) + np.repeat(np.arange(len(counts), dtype=kind), counts)
    pairs.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]]))
    tf = np.diff(first, append=len(pairs))
    pairs = pairs[first]
    term = pairs // kind(n)
    return term.astype(np.int64), (pairs - term * kind(n)).astype(np.int64), tf


def statistics(tokens: DataFrame) -> Statistics:
    """Of all rows of what `tokenized` gives; a row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            ids, counts = unpack(batch.column("ids"), batch.column("wide"))
            got = np.bincount(distinct_pairs(ids, counts)[0], minlength=len(df))
            got[: len(df)] += df
            df, docs, total = got, docs + len(counts), total + len(ids)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], term])), pa.array(np.concatenate([[docs, total], df[term]]))], ["term", "n"])

    got = tokens.select("ids", "wide").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(max(0, term.max(initial=-1) + 1), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return Statistics(int(n[term == -2].sum()), int(n[term == -1].sum()), df)


class Index:
    """BM25 postings of some documents' token ids, by the statistics of a corpus that holds them (None: by their own)."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, k1: float = 1.2, b: float = 0.75, corpus: Statistics | None = None):
        n = len(counts)
        width = np.int64(ids.max(initial=0)) + 1
        term, self.doc, tf = distinct_pairs(ids, counts)
        df = np.bincount(term, minlength=width)
        self.first = np.concatenate([[0], np.cumsum(df)])
        corpus = corpus or Statistics(n, int(counts.sum()), df)
        idf = np.log1p((corpus.docs - corpus.df + 0.5) / (corpus.df + 0.5))
        norm = k1 * (1 - b + b * counts / (corpus.tokens / corpus.docs))
        self.weight = idf[term] * tf * (k1 + 1) / (tf + norm[self.doc])
        by_doc = np.argsort(self.doc.astype(np.uint16) if n <= 1 << 16 else self.doc, kind="stable")  # two bytes are sorted by radix
        self.terms = term[by_doc]
        self.bounds = np.searchsorted(self.doc[by_doc], np.arange(n + 1))
        self.n = n

    def scores(self, doc: int) -> np.ndarray:
        """Of every document, for the distinct ids of one of them."""
        t = self.terms[self.bounds[doc] : self.bounds[doc + 1]]
        at = ragged(self.first[t], self.first[t + 1] - self.first[t])
        return np.bincount(self.doc[at], self.weight[at], minlength=self.n)


def pack_shard(ids: np.ndarray, counts: np.ndarray, window: int, corpus: Statistics | None = None) -> np.ndarray:
    """Pieces as rows (document, start, length, sequence, offset)."""
    index = Index(ids, counts, corpus=corpus)
    free = np.ones(len(counts), bool)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, at, nxt = 0, 0, 0
    held: list[tuple[int, int, int]] = []  # of the open window
    seed, done = -1, 0
    while True:
        if seed < 0:
            while nxt < len(counts) and not free[nxt]:
                nxt += 1
            if nxt == len(counts):
                break
            seed, done = nxt, 0
            free[seed] = False
        left = int(counts[seed]) - done
        whole = left // window
        for _ in range(whole):
            out.append((seed, done, window, sequence, 0))
            sequence, done = sequence + 1, done + window
        left -= whole * window
        if not left:
            seed = -1
            continue
        held, at = [(seed, done, left)], left
        score = np.where(free, index.scores(seed), -1.0)
        seed = -1
        for d in np.argsort(-score, kind="stable").tolist():
            if not free[d]:
                break
            free[d] = False
            take = min(int(counts[d]), window - at)
            held.append((d, 0, take))
            at += take
            if at == window:
                if take < counts[d]:
                    seed, done = d, take
                break
        if at < window:  # no document is left
            break
        offset = 0
        for d, s, n in held:
            out.append((d, s, n, sequence, offset))
            offset += n
        sequence, held, at = sequence + 1, [], 0
    size = room = 0
    for d, s, n in held:  # the shard's rest: lengths of falling powers of two
        while n:
            if not room:
                size = room = 1 << (at.bit_length() - 1)
            take = min(n, room)
            out.append((d, s, take, sequence, size - room))
            s, n, room, at = s + take, n - take, room - take, at - take
            sequence += not room
    return np.array(out, np.int64).reshape(-1, 5)


#: Centres at most, documents that they are fitted on (about), and dimensions that ids are projected to.
CELLS, SAMPLE, WIDTH = 1024, 16384, 16
#: More equal rows than these are spread over the shards of their cell.
MANY = 256


def projection(corpus: Statistics) -> np.ndarray:
    """A row of `WIDTH` numbers for each token id: a random direction, by the square of the id's rarity."""
    n = corpus.docs
    idf = np.where(corpus.df > 1, np.log1p((n - corpus.df + 0.5) / (corpus.df + 0.5)), 0.0)
    return (np.random.default_rng(1).normal(size=(len(idf), WIDTH)) * (idf**2)[:, None]).astype(np.float32)


def projected(ids: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The mean row of each document's ids. Every document has one at least."""
    first = np.cumsum(counts) - counts
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    columns = np.ascontiguousarray(table.T)  # one after another: each fits the cache, and sums run over adjacent numbers
    for at in range(0, len(counts), 1024):
        some = slice(at, at + 1024)
        own = ids[first[at] : first[at] + counts[some].sum()]
        for k, column in enumerate(columns):
            out[some, k] = np.add.reduceat(column.take(own), first[some] - first[at])
    return out / counts[:, None].astype(np.float32)


@dataclass
class Cells:
    """Centres on the unit sphere around the mean of all, and the share of the tokens that each cell has in the sample."""

    mean: np.ndarray
    centres: np.ndarray
    shares: np.ndarray

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.mean) @ self.centres.T).argmax(1) if len(vectors) else np.zeros(0, np.int64)


def fit_cells(vectors: np.ndarray, tokens: np.ndarray, k: int, rounds: int = 8) -> Cells:
    """Spherical k-means."""
    mean = vectors.mean(0)
    unit = vectors - mean
    unit = unit / np.maximum(1e-12, np.sqrt((unit**2).sum(1)))[:, None]
    centres = unit[np.random.default_rng(2).permutation(len(unit))[:k]].copy()
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(1)
        for c in np.unique(of).tolist():
            m = unit[of == c].mean(0)
            centres[c] = m / max(1e-12, float(np.sqrt((m**2).sum())))
    of = (unit @ centres.T).argmax(1)
    share = np.bincount(of, tokens, minlength=len(centres)) + tokens.mean()
    return Cells(mean, centres, share / share.sum())


def pack(docs: DataFrame, vocab: str = "word_bpe_49k.json", end: int = 2, window: int = 4096, shard_tokens: int = 1 << 20, id_column: str = "doc_id", text_column: str = "text", cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset: long, ids binary of little-endian uint32), a row for each piece.

    Every id of every row lies in one piece; a null or empty text has the end id only. Shards hold about
    `shard_tokens` ids, twice as many at most, or one longer document, so their number and with it the work follow the
    input; a window's documents are the best of its shard, not of all. Up to `cells` centres are fitted on about `sample`
    documents, chosen by a hash. Rows that share a doc_id are packed each for itself; more than `MANY` equal rows are
    spread over the shards of their cell. Null ids stay null; other columns are not read; an empty table gives none.
    Reruns agree.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    tokens = scratch.keep(tokenized(docs, vocab, end, id_column, text_column).withColumn("key", F.xxhash64("doc_id", "ids")), "tokens")
    corpus = statistics(tokens)
    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    if not corpus.docs:
        return spark.createDataFrame([], schema)
    shards = -(-corpus.tokens // shard_tokens)
    table = projection(corpus)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = unpack(batch.column("ids"), batch.column("wide"))
            yield pa.RecordBatch.from_arrays([pa.array(counts), binary_rows(projected(ids, counts, table).reshape(-1), np.full(len(counts), WIDTH))], ["n", "vector"])

    # A document in so many, by a hash: a bounded sample, as the centres need no more. Every document is dealt.
    every = max(1, corpus.docs // sample)
    got = tokens.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(every)) == 0).select("ids", "wide").mapInArrow(lean(vectors), "n long, vector binary").toArrow()
    points = np.frombuffer(b"".join(got.column("vector").to_pylist()), np.float32).reshape(-1, WIDTH)
    order = np.lexsort(points.T)  # whatever order the rows come in
    cell_of = fit_cells(points[order], got.column("n").to_numpy()[order], min(cells, shards)) if len(points) else Cells(np.zeros(WIDTH), np.zeros((1, WIDTH)), np.ones(1))
    wide = np.maximum(1, np.ceil(cell_of.shares * shards - 0.3)).astype(np.int64)
    first = np.cumsum(wide) - wide

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = unpack(batch.column("ids"), batch.column("wide"))
            cell = cell_of.of(projected(ids, counts, table))
            shard = first[cell] + batch.column("hash").to_numpy() % wide[cell]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), batch.column("wide"), pa.array(shard)], ["doc_id", "ids", "wide", "shard"])

    def packed(part: pa.Table, sequence: int) -> tuple[pa.RecordBatch, int]:
        """Pieces of some documents of one shard, whose sequences are numbered from `sequence` on."""
        part = part.combine_chunks()
        ids, counts = unpack(part.column("ids").combine_chunks(), part.column("wide").combine_chunks())
        p = pack_shard(ids, counts, window, corpus)
        base = np.cumsum(counts) - counts
        flat = ids[ragged(base[p[:, 0]] + p[:, 1], p[:, 2])].astype("<u4")
        doc, shard = part.column("doc_id").take(pa.array(p[:, 0])).combine_chunks(), part.column("shard")[0].as_py()
        doc = doc.chunk(0) if isinstance(doc, pa.ChunkedArray) else doc
        out = [doc, pa.array(p[:, 1]), pa.array(p[:, 2]), pa.array(counts[p[:, 0]]), pa.array((shard << 32) + sequence + p[:, 3]), pa.array(p[:, 4]), binary_rows(flat, p[:, 2])]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), sequence + int(p[:, 3].max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, size, sequence = None, 0, 0
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            n = pc.divide(pc.binary_length(batch.column("ids")), pc.if_else(batch.column("wide"), 4, 2)).to_numpy(zero_copy_only=False)
            begin = 0
            for row in range(batch.num_rows):
                if at is not None and (shard[row] != at or (size and size + n[row] > 2 * shard_tokens)):
                    if row > begin:
                        held.append(batch.slice(begin, row - begin))
                    out, sequence = packed(pa.Table.from_batches(held), sequence)
                    yield out
                    release()
                    held, size, begin = [], 0, row
                    if shard[row] != at:
                        sequence = 0
                at, size = shard[row], size + int(n[row])
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield packed(pa.Table.from_batches(held), sequence)[0]

    hot = scratch.keep(tokens.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select(F.col("key").alias("_key"), "n"), "hot")
    rows = tokens.withColumn("_place", F.lit(0).cast("long")) if hot.isEmpty() else numbered(tokens, hot, scratch)
    rows = rows.select("doc_id", "ids", "wide", (F.shiftrightunsigned(F.xxhash64("key", F.lit(5)), 24) + F.col("_place")).alias("hash"))
    dealt = rows.mapInArrow(lean(deal), "doc_id long, ids binary, wide boolean, shard long")
    # Many shards a partition: their number follows the cluster's setting, not the input.
    return dealt.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(lean(run), schema)
