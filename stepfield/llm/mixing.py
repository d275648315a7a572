"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Of all document rates that meet each source's target of words, those of least relative entropy to one copy of each
document are exponentially tilted: rate = min(2, exp(lambda * size / largest size)), with one lambda for a source
(the cap is a bound of the same convex problem). The dual is solved by Newton steps on counts of (source, size),
which are aggregated once; a step that leaves its bracket is replaced by halving. Rates become copies by a
threshold: a document has floor(rate + shift + 1 - u) copies, u from a hash of its row, with the source's shift set
so that its words come as close below the target as the next document allows. What is then still missing is filled by
copies of smaller ones, past those that are too large; or the next one is taken and smaller ones are left out (`fill`).
Of n rows equal in id, text and source the i-th has u + i / n (modulo 1) in place of u, so
that their copies are spread over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, same, unpacked, whole_row

WORD = r"[^\x20\x09-\x0D]+"
CAP = 2.0
BINS = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = CAP) -> DataFrame:
    """(source, source_size, largest, target) from (source, source_size, largest), a row for each source.

    Sources in order of code points, null last, weigh weights[0], weights[1], ... and again from the start. They share
    share * all sizes; what is above cap * a source's size is reshared by weight among the others.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(cap))
    # In order of the level at which a source is full, the full ones come first.
    order = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumn("all", F.lit(share) * F.sum("source_size").over(every)).withColumn("filled", F.coalesce(F.sum("top").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    full = F.col("filled") + F.col("top") / F.col("weight") * F.col("open") <= F.col("all")
    rows = rows.withColumn("full", full)
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("top"))).over(every), F.lit(0.0))
    level = rest / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return rows.withColumn("level", level).select("source", "source_size", "largest", F.when(F.col("full"), F.col("top")).otherwise(F.least("top", F.col("level") * F.col("weight"))).alias("target"))


def _rate(cap: float) -> Column:
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.least(F.lit(cap), F.exp(F.least(F.lit(50.0), F.col("tilt") * F.col("size") / F.col("largest")))))


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str, *more: Column) -> DataFrame:
    """(more columns, doc_id, source, key, size, u): what the mix needs to know of a row."""
    u = F.pmod(F.xxhash64(id_column, text_column), F.lit(1 << 52)) / F.lit(float(1 << 52))
    size = F.coalesce(F.regexp_count(text_column, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.xxhash64(id_column, text_column, source_column)
    return docs.select(*more, F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), key.alias("key"), size.alias("size"), u.alias("u"))


def spread(rows: DataFrame, repeated: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (key, u, ...) with u moved where rows share a key. repeated: (_key, n) of such keys."""
    if repeated.isEmpty():
        return rows
    u = F.pmod(F.col("u") + F.col("_place") / F.coalesce("_n", F.lit(1)), F.lit(1.0))
    return numbered(rows, repeated, scratch).withColumn("u", u).select(*rows.columns)


def _of(left: DataFrame, right: DataFrame) -> DataFrame:
    s = right.withColumnRenamed("source", "_source")
    return left.join(s, same(left.source, s._source)).drop("_source")


def _copies(cap: float) -> Column:
    n = F.floor(F.col("rate") + F.col("low") + 1 - F.col("u"))
    return F.when(F.col("full"), F.lit(int(cap))).otherwise(F.greatest(F.lit(0), F.least(F.lit(int(cap)), n))).cast("long")


def plan(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float, id_column: str, text_column: str, source_column: str, rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by their sizes (written once), for each source what decides its rows' copies, and the keys of repeated rows.

    Raises RuntimeError where a source's dual isn't solved in `rounds` steps.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(sized(docs, id_column, text_column, source_column), "sizes")
    repeated = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"), "n"), "keys")
    rows = spread(rows, repeated, scratch)
    counted = scratch.keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sizes = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.greatest(F.max("size"), F.lit(1)).alias("largest"))
    full = (F.col("target") >= F.lit(cap * (1 - 1e-12)) * F.col("source_size")) & (F.col("source_size") > 0)
    state = scratch.keep(
        targets(sizes, weights, share, cap)
        .withColumn("full", full)
        .withColumns({"tilt": F.lit(0.0), "low": F.lit(-1e5), "high": F.lit(1e5), "done": F.col("full") | (F.col("source_size") == 0)}),
        "dual",
    )

    for _ in range(rounds):
        if state.where(~F.col("done")).isEmpty():
            break
        rated = _of(counted, state.where(~F.col("done"))).withColumn("rate", _rate(cap))
        words = F.col("n") * F.col("size") * F.col("rate")
        slope = F.when(F.col("rate") < cap, words * F.col("size") / F.col("largest")).otherwise(0.0)
        step = rated.groupBy("source").agg((F.sum(words) - F.first("target")).alias("over"), F.sum(slope).alias("slope"))
        s = step.withColumnRenamed("source", "_source")
        both = state.join(s, same(state.source, s._source), "left").drop("_source")
        low, high = F.when(F.col("over") < 0, F.col("tilt")).otherwise(F.col("low")), F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(F.col("over"), F.col("slope"))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        near = (F.abs("over") <= F.lit(tolerance) * F.col("target")) | (F.col("high") - F.col("low") < 1e-13)
        moved = {
            "tilt": F.when(F.col("done") | near, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2),
            "low": F.when(F.col("done"), F.col("low")).otherwise(low),
            "high": F.when(F.col("done"), F.col("high")).otherwise(high),
            "done": F.col("done") | near,
        }
        after = scratch.keep(both.withColumns(moved).drop("over", "slope"), "dual")
        scratch.drop(state)
        state = after

    else:
        if not state.where(~F.col("done")).isEmpty():
            raise RuntimeError(f"the mix's dual is not solved after {rounds} steps")

    # Copies as a function of the shift: one at u - rate, the second at u - rate + 1.
    # The last digits of lambda depend on the order in which Spark adds; reruns shall agree.
    chosen = state.select("source", "source_size", "largest", "target", "full", F.round("tilt", 9).alias("tilt"))
    at = chosen.withColumns({"low": F.lit(-3.0), "width": F.lit(6.0 / BINS), "base": F.lit(0)})
    step = F.explode(F.sequence(F.lit(0), F.lit(int(cap) - 1)))
    for _ in range(3):
        jumps = _of(rows, at).withColumn("step", step).select("source", "size", "low", "width", "base", "target", (F.col("u") - _rate(cap) + F.col("step")).alias("jump"))
        cell = F.floor((F.col("jump") - F.col("low")) / F.col("width"))
        cells = jumps.withColumn("cell", cell).where(F.col("cell").between(0, BINS - 1)).groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("base").alias("base"), F.first("target").alias("target"))
        run = Window.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("upto", F.col("base") + F.sum("words").over(run))
        # The last cell that still fits ends where the search goes on.
        fits = cells.where(F.col("upto") <= F.col("target")).groupBy("source").agg(F.max("upto").alias("reached"))
        cross = cells.where(F.col("upto") > F.col("target")).groupBy("source").agg(F.min("cell").alias("cross"))
        f, c = fits.withColumnRenamed("source", "_f"), cross.withColumnRenamed("source", "_c")
        both = at.join(f, same(at.source, f._f), "left").join(c, same(at.source, c._c), "left").drop("_f", "_c")
        both = both.withColumns({"low": F.col("low") + F.coalesce("cross", F.lit(BINS)) * F.col("width"), "base": F.coalesce("reached", "base"), "width": F.col("width") / BINS})
        at = scratch.keep(both.drop("reached", "cross"), "shift")

    dealt = _of(rows, at).withColumn("rate", _rate(cap)).withColumn("copies", _copies(cap))
    had = dealt.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("had")).withColumnRenamed("source", "_source")
    short = scratch.keep(at.join(had, same(at.source, had._source), "left").drop("_source").withColumn("short", F.col("target") - F.col("had")), "short")
    last = scratch.keep(fill(_of(rows, short), short, cap), "filled")
    return rows, last, repeated


NO_PICKS = "cast(array() as array<struct<size: bigint, k: bigint>>)"


def _greedy(sizes: str, amount: str) -> Column:
    """Of (size, n), largest first, how many to take to come near the amount: struct(rest, picks). At last one that is too large, if that comes nearer."""

    def take(so_far: Column, x: Column) -> Column:
        k = F.least(x["n"], F.floor(so_far["rest"] / x["size"]))
        more = F.when(k > 0, F.concat(so_far["picks"], F.array(F.struct(x["size"].alias("size"), k.alias("k"))))).otherwise(so_far["picks"])
        return F.struct((so_far["rest"] - k * x["size"]).alias("rest"), more.alias("picks"))

    def finish(got: Column) -> Column:
        fits = F.filter(sizes, lambda x: (x["size"] > got["rest"]) & (x["size"] < 2 * got["rest"]) & ~F.exists(got["picks"], lambda p: p["size"] == x["size"]))
        last = F.array_min(F.transform(fits, lambda x: x["size"]))
        one = F.when(last.isNotNull(), F.array(F.struct(last.alias("size"), F.lit(1).cast("long").alias("k")))).otherwise(F.expr(NO_PICKS))
        return F.struct(F.coalesce(last - got["rest"], got["rest"]).alias("rest"), F.concat(got["picks"], one).alias("picks"))

    return F.aggregate(sizes, F.struct(F.col(amount).cast("double").alias("rest"), F.expr(NO_PICKS).alias("picks")), take, finish)


def fill(rows: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """sources with `more` and `less`: up to which distance from the source's shift rows of a size get a copy more or less.

    What is still missing is filled from the largest size that fits down to the smallest, past rows that are too large;
    or the next row behind the shift gets its copy, and what that is too much is taken off in the same way. The way
    that comes nearer counts. A source's sizes are one array, as long as its longest document at most. Of rows of one
    size those nearest to the shift are taken; they are ranked among those that can be, whose number does not grow
    with the rows.
    """
    dealt = rows.withColumn("rate", _rate(cap)).withColumn("copies", _copies(cap)).withColumn("behind", _behind()).where(~F.col("full") & (F.col("size") > 0))
    next_ = dealt.where(F.col("copies") < int(cap)).groupBy("source").agg(F.min(F.struct("behind", "size")).alias("next")).withColumnRenamed("source", "_source")
    known = sources.join(next_, same(sources.source, next_._source), "left").drop("_source").withColumn("excess", F.greatest(F.lit(0.0), F.col("next.size") - F.col("short")))
    ways = F.array(
        F.when(F.col("copies") < int(cap), F.struct(F.lit(True).alias("add"), F.col("behind").alias("d"))),
        F.when(F.col("copies") > 0, F.struct(F.lit(False).alias("add"), (1 - F.col("behind")).alias("d"))),
    )
    left = _of(dealt.select("source", "size", F.inline(F.array_compact(ways))), known.select("source", "short", "excess"))
    left = left.where(F.col("size") < 2 * F.when(F.col("add"), F.col("short")).otherwise(F.col("excess"))).select("source", "add", "size", "d")
    held = left.groupBy("source", "add", "size").agg(F.count("*").alias("n"), F.min("d").alias("nearest"))
    of = lambda add: F.sort_array(F.collect_list(F.when(F.col("add") == F.lit(add), F.struct("size", "n"))), asc=False)
    lists = held.groupBy("source").agg(of(True).alias("adds"), of(False).alias("drops")).withColumnRenamed("source", "_source")
    blank = F.expr("cast(array() as array<struct<size: bigint, n: bigint>>)")
    known = known.join(lists, same(known.source, lists._source), "left").drop("_source").withColumns({"adds": F.coalesce("adds", blank), "drops": F.coalesce("drops", blank)})
    known = known.withColumns({"up": _greedy("adds", "short"), "down": _greedy("drops", "excess")})
    cross = F.coalesce((F.col("next.size") > F.col("short")) & (F.col("down.rest") < F.col("up.rest")), F.lit(False))
    known = known.withColumn("cross", cross)
    picks = known.select("source", (~F.col("cross")).alias("add"), F.inline(F.when(F.col("cross"), F.col("down.picks")).otherwise(F.col("up.picks"))))
    p = picks.select(F.col("source").alias("_s"), F.col("add").alias("_a"), F.col("size").alias("_z"), "k")
    p = p.join(held, same(p._s, held.source) & (F.col("_a") == F.col("add")) & (F.col("_z") == F.col("size")))
    p = p.select("_s", "_a", "_z", "k", (F.col("nearest") + (F.col("k") + 10 * F.sqrt("k") + 100) / F.col("n")).alias("within"))
    some = left.join(p, same(left.source, p._s) & (F.col("add") == F.col("_a")) & (F.col("size") == F.col("_z"))).where(F.col("d") <= F.col("within"))
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("source", "add", "size").orderBy("d"))).where(F.col("nth") <= F.col("k"))
    upto = some.groupBy("source", "add", "size").agg(F.max("d").alias("upto")).groupBy(F.col("source").alias("_source")).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("add"), F.struct("size", "upto")))).alias("more"), F.map_from_entries(F.collect_list(F.when(~F.col("add"), F.struct("size", "upto")))).alias("less"),
    )
    out = known.join(upto, same(known.source, upto._source), "left")
    more = F.when(F.col("cross"), F.create_map("next.size", "next.behind")).otherwise(F.col("more"))
    return out.select(*sources.columns, more.alias("more"), "less")


def _behind() -> Column:
    """How far behind the shift a row gets its next copy."""
    return F.col("u") - F.col("rate") + F.col("copies") - F.col("low")


def decide(rows: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """rows with source_size, target, rate and copies. The sources' table is joined only; no row meets another."""
    dealt = _of(rows, sources).withColumn("rate", _rate(cap)).withColumn("copies", _copies(cap))
    upto = lambda c: F.try_element_at(c, F.col("size"))
    more = (_behind() <= upto(F.col("more"))) & (F.col("copies") < int(cap))
    less = (1 - _behind() <= upto(F.col("less"))) & (F.col("copies") > 0)
    extra = F.when(more, 1).when(less, -1).otherwise(0)
    return dealt.withColumn("copies", F.col("copies") + extra)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = CAP, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", rounds: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """One row per row of docs: (doc_id, source, size long, source_size long, target double, rate double, copies long, taken long).

    size counts the text's words (null: 0). copies are 0, 1 or 2 (cap rounded down), taken is copies * size. Of
    rows equal in id, text and source some may have a copy more; which of them is left open. A source without words has target 0 and rate 1. A null source is a
    source like any other, an empty table gives none. Reruns agree. The table of sources has a row for each; Spark
    broadcasts it where it is small and else splits a large source's rows.
    """
    rows, sources, _ = plan(docs, weights, share, cap, id_column, text_column, source_column, rounds, tolerance)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return decide(rows, sources, cap).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", taken)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = CAP) -> DataFrame:
    """docs with each row as often as the mix takes it (rows that are taken no time are gone); all columns kept, whatever their names.

    Nulls, ties, repeated rows and an empty table as in `mix`. Rows are decided where they are read, by the table of
    sources: texts are not shuffled, unless there are too many repeated rows to broadcast their keys.
    """
    _, sources, repeated = plan(docs, weights, share, cap, "doc_id", "text", "source", 60, 1e-9)
    rows = spread(sized(docs, "doc_id", "text", "source", whole_row(docs).alias("_row")), repeated, Scratch(docs.sparkSession))
    taken = decide(rows, sources, cap).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*unpacked("_row", docs))
