"""Audit of how sources of a language differ in their words, by an inverted index of corrections to a baseline.

A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps the V terms that are in
at least `least` of its documents. A group is one source in one language; with N kept terms in it, a term that it has
`count` times weighs p = 1 + floor(1000000000 * (count + 2) / (N + 2 * V)). Two weights differ by
f = floor((p - q) * (p - q) / (p + q)), and two groups by the sum of f over all kept terms.

No table of groups times terms is made. Each pair of groups starts at V times f of their weights of zero counts. The
postings (term, group, count) then emit corrections where those are not zero: one for a term that the first group has,
one for a term that the second has, one more for a term that both have. The first two depend on a count alone, so equal
counts of a group are added up before they meet the other groups; the third comes from the postings of one term. All
are integers, so that the sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, lean, mapped, ship, slices

UNIT = 1_000_000_000

#: Each byte of UTF-8 as it counts in a term: letters in lower case, bytes beyond ASCII as they are, all else a space.
TERM_BYTES = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)


def term_counts(docs: DataFrame, lang_column: str, source_column: str, text_column: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up in each slice of texts; a row with a null term for each group."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(mapped(part.column("text"), TERM_BYTES.take))
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                of_row = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                size = max(1, len(words.dictionary))
                in_row, n = np.unique(words.rows * size + words.codes, return_counts=True)
                key, first, inverse = np.unique(of_row[in_row // size] * size + in_row % size, return_index=True, return_inverse=True)
                groups = np.unique(of_row)
                of = np.concatenate([key // size, groups])
                blank = np.zeros(len(groups), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(of // len(source.dictionary))),
                        source.dictionary.take(pa.array(of % len(source.dictionary))),
                        pa.concat_arrays([words.dictionary.take(pa.array(key % size)), pa.nulls(len(groups), pa.string())]),
                        pa.array(np.concatenate([np.bincount(inverse, n, len(key)).astype(np.int64), blank])),
                        pa.array(np.concatenate([np.bincount(inverse, minlength=len(key)), blank])),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_column).alias("lang"), text(source_column).alias("source"), text(text_column).alias("text"))
    return rows.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")


def _weight(count: Column, total: Column, terms: Column) -> Column:
    """The weight of a count; decimals hold the product whatever the count."""
    return F.call_function("div", (count.cast("decimal(19,0)") + 2) * F.lit(UNIT), total.cast("decimal(19,0)") + 2 * terms) + 1


def _differ(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def divergence(docs: DataFrame, least: int = 10, top: int = 10, lang_column: str = "lang", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(lang, source, part, item, value long, rank int).

    Part "pair": item is each other source of the language, value how far the two differ; all ranks. Part "term": item
    is each kept term that the group has and that weighs more there than in the language, value the difference of the
    two weights; the first `top` ranks. Ranks count from 1 in each group and part, largest value first, equal ones in
    order of the item's UTF-8.

    Null text, language and source are read as empty. Every group that has a row counts, even without terms; a language
    without kept terms has only pairs, of value 0, and one with a single source only no pairs. Equal rows are rows of
    their own. An empty table gives no rows. Only the three columns are read.
    """
    scratch = Scratch(docs.sparkSession)
    counted = term_counts(docs, lang_column, source_column, text_column)
    postings = scratch.keep(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "postings")
    terms = postings.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    terms = scratch.keep(terms.select("lang", "term", "total", F.monotonically_increasing_id().alias("term_id")), "terms")
    kept = postings.join(terms, ["lang", "term"]).select("lang", "source", "term_id", "n", "total")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    groups = postings.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    zero = F.when(F.col("v") > 0, _weight(F.lit(0), F.col("size"), F.col("v")))
    groups = scratch.keep(groups.withColumn("zero", zero).withColumn("g", F.monotonically_increasing_id()), "groups")

    weighed = kept.join(groups, ["lang", "source"])
    weighed = weighed.select("term_id", "lang", "g", "zero", _weight(F.col("n"), F.col("size"), F.col("v")).alias("p"), _weight(F.col("total"), F.col("lang_size"), F.col("v")).alias("q"))
    weighed = scratch.keep(weighed, "weighed")

    a, b = (groups.select("lang", F.col("g").alias(f"g{x}"), F.col("zero").alias(f"zero{x}"), "v") for x in "ab")
    base = a.join(b.drop("v"), "lang").where("ga < gb").select("ga", "gb", F.coalesce(F.col("v") * _differ("zeroa", "zerob"), F.lit(0)).alias("value"))
    same_count = weighed.groupBy("lang", "g", "zero", "p").agg(F.count("*").alias("k"))
    alone = same_count.join(b.drop("v"), "lang").where("g <> gb")
    alone = alone.select(F.least("g", "gb").alias("ga"), F.greatest("g", "gb").alias("gb"), (F.col("k") * (_differ("p", "zerob") - _differ("zero", "zerob"))).alias("value"))
    a, b = (weighed.select("term_id", F.col("g").alias(f"g{x}"), F.col("zero").alias(f"zero{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
    both = a.join(b, "term_id").where("ga < gb")
    both = both.select("ga", "gb", (_differ("pa", "pb") - _differ("pa", "zerob") - _differ("zeroa", "pb") + _differ("zeroa", "zerob")).alias("value"))
    # Corrections of a pair are added up before they are shuffled.
    pairs = base.union(alone.where("value <> 0")).union(both.where("value <> 0")).groupBy("ga", "gb").agg(F.sum("value").alias("value"))
    pairs = pairs.select(F.explode(F.array(F.struct(F.col("ga").alias("g"), F.col("gb").alias("o")), F.struct(F.col("gb").alias("g"), F.col("ga").alias("o")))).alias("p"), "value").select("p.g", "p.o", "value")
    names = groups.select("g", "lang", "source")
    pairs = pairs.join(names, "g").join(groups.select(F.col("g").alias("o"), F.col("source").alias("item")), "o")

    order = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", order("lang", "source").alias("rank"))
    # The window's limit is applied within each task before rows are shuffled to their group.
    over = weighed.where("p > q").select("g", "term_id", _differ("p", "q").alias("value")).join(terms.select("term_id", F.col("term").alias("item")), "term_id")
    over = over.withColumn("rank", order("g")).where(F.col("rank") <= top)
    over = over.join(names, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(over)
