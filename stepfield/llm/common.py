"""What the operators share: the scratch folder, shipping the package to executors, and words in Arrow batches.

Words are runs of characters other than space and U+0009 to U+000D everywhere in this subpackage.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker handles together.
SLICE_BYTES = 4 << 20
#: Bytes of rows that Spark sends to a Python worker together.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20)

_shipped: set[str] = set()
_owned: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver found it. Done once for each application.

    Arrow batches get a bound in bytes, as a batch of 10,000 long texts may not fit.
    """
    if spark.conf.get(BATCH_CONF) != BATCH_BYTES:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "stepfield.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("stepfield", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: on one machine a new temporary one, on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stepfield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _owned:
        try:
            if spark._jsc.sc().isStopped():
                continue
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            pass


atexit.register(_sweep)


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and its memory counts on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What a Python worker remembers from one task to the next, by the name of its user.
_remembered: dict[str, dict] = {}


def remembered(user: str) -> dict:
    """A dictionary that a Python worker keeps until it gets a task of another user, as it serves all later stages, too."""
    return _remembered.setdefault(user, {})


def forget(but: str | None = None) -> None:
    """Drop what others than this user remember."""
    spent = [held for user, held in _remembered.items() if held and user != but]
    for held in spent:
        held.clear()
    if spent:
        release()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], user: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves no freed memory with its worker, and finds none that only other users need."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(user)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int) -> Iterator[pa.Table]:
    """Rows that come sorted by keys, in tables of about `rows` rows or `size` bytes; no key is split between two tables.

    Memory is bounded by that and the rows of one key, whatever a partition holds.
    """
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows >= rows or held.nbytes >= size:
            cuts = np.flatnonzero(key_edges(held, keys))
            if len(cuts):  # all but the last key, which may go on
                yield held.slice(0, cuts[-1] + 1)
                held = held.slice(cuts[-1] + 1)
    if held is not None and held.num_rows:
        yield held


def key_edges(part: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys are others than those of the row before, from the second row on."""
    new = np.zeros(max(0, part.num_rows - 1), bool)
    for c in keys:
        v = part.column(c).to_numpy()
        new |= v[1:] != v[:-1]
    return new


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/stepfield-{uuid.uuid4().hex}"
        self._n = 0
        _owned.append((spark, self.path))

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        # What led here is not needed again: Spark deletes its shuffle files now, not when the driver's heap is full.
        flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(flag)
        self.spark.conf.set(flag, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(flag, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _remove(self.spark, df._scratch_path)

    def clear(self) -> None:
        _remove(self.spark, self.path)


def named(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct with fields c0, c1, ..., whatever the columns' names."""
    return F.struct(*(named(c).alias(f"c{i}") for i, c in enumerate(df.columns)))


def unpacked(row: str, df: DataFrame) -> list[Column]:
    """The columns of df, from a struct column that `whole_row` made."""
    return [F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(df.columns)]


def numbered(rows: DataFrame, repeated: DataFrame, scratch: Scratch, parts: int = 64) -> DataFrame:
    """rows (key, ...) with _n and _place: how many rows share the key, and a number from 0, where `repeated` (_key, n) has the key.

    Other rows have a null _n and place 0. Which row gets which number is left open. The rows of a key are numbered in
    `parts` parts at a time, so that one task needn't hold them all.
    """
    joined = rows.join(repeated.withColumnRenamed("n", "_n"), F.col("key") == F.col("_key"), "left").drop("_key")
    some = scratch.keep(joined.where("_n is not null").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))), "repeated")
    of_part = some.groupBy("key", "_part").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = of_part.select(F.col("key").alias("_key"), F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("key", "_part").orderBy("_part")) - 1
    moved = some.withColumn("_nth", place).join(of_part, (F.col("key") == F.col("_key")) & (F.col("_part") == F.col("_p")))
    moved = moved.withColumn("_place", F.col("_before") + F.col("_nth")).select(*rows.columns, "_n", "_place")
    return joined.where("_n is null").withColumn("_place", F.lit(0).cast("long")).select(*rows.columns, "_n", "_place").union(moved)


class Sieve:
    """A Bloom filter of fixed size over long ids: most rows of a large table that have no partner stay where they are.

    The filter is the only thing broadcast, `bits` / 8 bytes whatever the number of ids. It is exact on ids that it was
    built of and lets others through by mistake, more of them the more ids there are; a join must follow.
    """

    def __init__(self, ids: DataFrame, column: str, bits: int = 1 << 26):
        spark = ids.sparkSession
        ship(spark)

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(Sieve.places(batch.column(0).to_numpy(), bits))
                word, first = np.unique(at >> 6, return_inverse=True)
                mask = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(mask, first, np.uint64(1) << (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], ["word", "mask"])

        got = ids.select(F.col(column).cast("long")).mapInArrow(build, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        held = spark.sparkContext.broadcast(words)

        def holds(x: np.ndarray) -> np.ndarray:
            out = np.ones(len(x), bool)
            for at in Sieve.places(x, bits):
                out &= (held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            return out

        @F.pandas_udf("boolean")
        def may_hold(x: pd.Series) -> pd.Series:
            forget()
            return pd.Series(holds(x.to_numpy()))

        #: For rows that go to mapInArrow without a shuffle: a column beside it takes each task a second Python worker.
        self.holds = holds
        self.may_hold = may_hold

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
        h = ids.astype(np.int64).view(np.uint64)
        out = []
        for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (h ^ (h >> np.uint64(29))) * np.uint64(odd)
            out.append((((x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(20)).astype(np.int64) & (bits - 1))
        return out


def same(a: Column, b: Column) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `most` bytes of text; a longer row stands alone."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of some texts: dictionary (distinct words), codes (a word each), bounds (row i has codes bounds[i]:bounds[i + 1])."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten()
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
        if not full.all():  # the split leaves an empty string at a text's edge
            rows = np.repeat(np.arange(len(counts)), counts)[full]
            counts = np.bincount(rows, minlength=len(counts))
            words = words.filter(pa.array(full))
        coded = words.dictionary_encode()
        self.dictionary = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mapped(texts: pa.Array, change: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Texts whose bytes of UTF-8, of all of them in a row, are changed one for one; nulls are empty texts."""
    texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    ends = np.frombuffer(ends, width)[texts.offset : texts.offset + len(texts) + 1]
    got = change(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
    return pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(got)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... (lengths[i] of them), one i after another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def binary_rows(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary value a row, of counts[i] items of the flat array each."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def scaled(spark: SparkSession, rows: DataFrame, bytes_column: str) -> int:
    """Total bytes of a column."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(bytes_column)), F.lit(0)).cast("long")).first()[0]
