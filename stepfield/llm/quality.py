"""Quality rules: plain text statistics with fixed limits, then a calibrated classifier with a fixed threshold.

The classifier is a logistic regression on hashed features of the words, each a share of the text's words: the word,
its character n-grams (with marks for its edges) and pairs of neighbouring words. It is trained on rows of `labels`
and calibrated on labelled rows that it was not trained on (Platt scaling), so its threshold is a probability.
Documents are scored in Arrow batches; weights are sent to every task and have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lean, named, ragged, ship, slices
from .substring import _mix, run_hash, word_hashes

SYMBOLS = r"[#*$%&|<>]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EDGE = 0x110000


@dataclass(frozen=True)
class Limits:
    """min_words, and the largest share (percent) of words in repeated windows; least probability of good quality."""

    min_words: int = 20
    repeat_percent: int = 30
    probability: float = 0.5


def repeated_words(h: np.ndarray, words: Words, size: int = 8) -> np.ndarray:
    """For each row, its words in windows of `size` words that occur twice or more in it."""
    n = np.diff(words.bounds)
    room = np.maximum(n - size + 1, 0)
    starts = ragged(words.bounds[:-1], room)
    out = np.zeros(len(n), np.int64)
    if not len(starts):
        return out
    row = words.rows
    key = _mix(run_hash(h, size)[starts] + _mix(row[starts].astype(np.uint64) + np.uint64(1)))
    in_order = np.sort(key)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
        s = starts[twice[at] == key]
        depth = np.bincount(s, minlength=len(h) + 1) - np.bincount(s + size, minlength=len(h) + 1)
        out = np.bincount(row[np.cumsum(depth)[:-1] > 0], minlength=len(n))
    return out


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """For each row, its lines that have a word and equal an earlier line of it."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = parts.flatten()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    full = pc.binary_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    coded = lines.dictionary_encode()
    key = (row * np.int64(len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False))[full]
    first = np.unique(key, return_index=True)[1]
    return np.bincount(row[full], minlength=len(texts)) - np.bincount(row[full][first], minlength=len(texts))


class Features:
    """Hashed features of the words of some texts."""

    def __init__(self, words: Words, h: np.ndarray, bits: int, grams: tuple[int, ...] = (1, 2, 3, 4)):
        mask = np.uint64((1 << bits) - 1)
        d = words.dictionary
        first = np.unique(words.codes, return_index=True)[1]
        size = pc.utf8_length(d).to_numpy(zero_copy_only=False).astype(np.int64)
        chars = np.frombuffer("".join(d.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
        end = np.cumsum(size + 2)
        start = end - size - 2
        text = np.full(int(end[-1]) if len(end) else 0, EDGE, np.uint64)
        text[ragged(start + 1, size)] = chars
        of = [np.arange(len(d))]
        ids = [(_mix(h[first] + np.uint64(7)) & mask).astype(np.int64)]
        for n in grams:
            room = np.maximum(size + 3 - n, 0)
            at = ragged(start, room)
            of.append(np.repeat(np.arange(len(d)), room))
            ids.append((_mix(run_hash(text + np.uint64(1), n)[at] + np.uint64(n << 40)) & mask).astype(np.int64))
        self.of, self.ids, self.distinct = np.concatenate(of), np.concatenate(ids), len(d)
        pair = (_mix(run_hash(h, 2) + np.uint64(11)) & mask).astype(np.int64)
        last = np.zeros(len(h), bool)
        last[words.bounds[1:][np.diff(words.bounds) > 0] - 1] = True
        self.pairs, self.pair_rows, self.words = pair[~last], words.rows[~last], words

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Sum of weights * shares for each row."""
        rows = len(self.words.bounds) - 1
        score = np.bincount(self.of, weights[self.ids], minlength=self.distinct)
        total = np.bincount(self.words.rows, score[self.words.codes], minlength=rows) + np.bincount(self.pair_rows, weights[self.pairs], minlength=rows)
        return total / np.maximum(np.diff(self.words.bounds), 1)

    def sparse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, share), one of each row and feature."""
        order = np.argsort(self.of, kind="stable")
        ids, count = self.ids[order], np.bincount(self.of, minlength=self.distinct)
        begin = np.cumsum(count) - count
        n = count[self.words.codes]
        row = np.concatenate([np.repeat(self.words.rows, n), self.pair_rows])
        feature = np.concatenate([ids[ragged(begin[self.words.codes], n)], self.pairs])
        key, times = np.unique((row << 32) | feature, return_counts=True)
        row = key >> 32
        return row, key & 0xFFFFFFFF, times / np.diff(self.words.bounds)[row]


@dataclass
class Model:
    """Weights by hashed feature, their bias, and the calibration: probability = sigmoid(slope * logit + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    bits: int

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (logits + self.bias) + self.shift, -60, 60)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, bits: int, epochs: int = 30, batch: int = 128, rate: float = 0.05, ridge: float = 1e-6, held: int = 4) -> Model | None:
    """A calibrated model of rows (features, shares), or None unless both labels are there to train and to calibrate on.

    Every held-th row calibrates. Memory: the rows and the temporaries of one batch.
    """
    test = np.arange(len(label)) % held == held - 1
    if any(len(np.unique(label[m])) < 2 for m in (test, ~test)):
        return None
    y = label.astype(float)

    def part(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(at)), [len(rows[i][0]) for i in at])
        return row, np.concatenate([rows[i][0] for i in at]).astype(np.int64), np.concatenate([rows[i][1] for i in at]).astype(float)

    train = np.flatnonzero(~test)
    w, bias = np.zeros(1 << bits), float(np.log((y[train].sum() + 1) / ((1 - y[train]).sum() + 1)))
    m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    order = np.random.default_rng(42)
    for _ in range(epochs):  # Adam
        for at in np.array_split(order.permutation(train), max(1, len(train) // batch)):
            t += 1
            r, f, x = part(at)
            err = (1 / (1 + np.exp(-np.clip(np.bincount(r, w[f] * x, minlength=len(at)) + bias, -60, 60))) - y[at]) / len(at)
            g, gb = np.bincount(f, err[r] * x, minlength=len(w)) + ridge * w, err.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix, fix2 = 1 - 0.9**t, 1 - 0.999**t
            w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
            bias -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    z = []
    for at in np.array_split(np.flatnonzero(test), max(1, int(test.sum()) // batch)):
        r, f, x = part(at)
        z.append(np.bincount(r, w[f] * x, minlength=len(at)) + bias)
    z = np.concatenate(z)
    pos, neg = y[test].sum(), (1 - y[test]).sum()
    goal = np.where(y[test] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))  # Platt's smoothed labels
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        q = p * (1 - p) + 1e-12
        grad = np.array([((p - goal) * z).sum(), (p - goal).sum()])
        hess = np.array([[(q * z * z).sum(), (q * z).sum()], [(q * z).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Model(w.astype(np.float32), bias, float(a), float(b), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 3000, bits: int = 17) -> Model | None:
    """Fit on at most `most` labelled documents: those whose ids have the least hashes, so that reruns agree.

    One task fits, on the features of that bounded sample; the driver gets the weights only.

    Labels that are null, or contradict each other for one doc_id, do not count. None where a class is missing.
    """
    ship(docs.sparkSession)
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top"))
    # A bounded sample: at most `most` rows, small enough to broadcast.
    chosen = given.where("y = top").select("doc_id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                row, feature, share = Features(words, word_hashes(words)[:, 0], bits).sparse()
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), cut(feature.astype("<u4")), cut(share.astype("<f4"))], ["doc_id", "y", "feature", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            got = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("feature", "ascending")])
            sparse = [(np.frombuffer(f, "<u4"), np.frombuffer(x, "<f4")) for f, x in zip(got.column("feature").to_pylist(), got.column("share").to_pylist(), strict=True)]
            model = fit(sparse, got.column("y").to_numpy(), bits)
            if model is not None:
                yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([x]) for x in (model.bias, model.slope, model.shift))], ["weights", "bias", "slope", "shift"])

    features = rows.mapInArrow(lean(run), "doc_id long, y int, feature binary, share binary")
    got = features.repartition(1).mapInArrow(lean(learn), "weights binary, bias double, slope double, shift double").first()
    return got and Model(np.frombuffer(bytes(got.weights), np.float32), got.bias, got.slope, got.shift, bits)


def judge(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), most: int = 3000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: the columns named by `keep`, then (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: long, probability double, base_failed, kept: boolean).

    base_failed: fewer than limits.min_words words, or more than limits.repeat_percent % of them in repeated windows.
    kept: not base_failed, and the model's probability is limits.probability or more (every document's, where the
    labels cannot train a model; probability is null then). A null text has no words. Rows are judged one by one, so
    repeated rows get the same verdict; other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, most=most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                words = Words(texts)
                rows, n = words.rows, np.diff(words.bounds)
                h = word_hashes(words)[:, 0]
                total = lambda per: np.bincount(rows, per.to_numpy(zero_copy_only=False)[words.codes], minlength=len(n)).astype(np.int64)  # noqa: E731, B023
                chars, symbols = total(pc.utf8_length(words.dictionary)), total(pc.count_substring_regex(words.dictionary, SYMBOLS))
                repeat = repeated_words(h, words)
                p = m.probabilities(Features(words, h, m.bits).logits(m.weights)) if m else None
                failed = (n < limits.min_words) | (100 * repeat > limits.repeat_percent * n)
                kept = ~failed & (p >= limits.probability) if m else ~failed
                cols = [n, chars, symbols, repeated_lines(texts), repeat]
                yield pa.RecordBatch.from_arrays([*(part.column(f"_{i}") for i in range(len(keep))), part.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(p, pa.float64()) if m else pa.nulls(len(n), pa.float64()), pa.array(failed), pa.array(kept)], [*(f"_{i}" for i in range(len(keep))), "doc_id", *STATISTICS, "probability", "base_failed", "kept"])

    kinds = {"doc_id": "long", **dict.fromkeys(STATISTICS, "long"), "probability": "double", "base_failed": "boolean", "kept": "boolean"}
    schema = ", ".join([*(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{c} {t}" for c, t in kinds.items())])
    return docs.select(*(named(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)


def keep_good(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), most: int = 3000) -> DataFrame:
    """The rows of docs that `judge` keeps; all columns kept. Rows that share a doc_id are judged each for itself."""
    judged = judge(docs, labels, limits, most, tuple(docs.columns))
    return judged.where("kept").select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))
