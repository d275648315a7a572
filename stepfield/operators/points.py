"""Points: lookup as of a time, access by place, and changes, each of which gives a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import before_first, by_series, check_bounds, default_cell, in_order, length, literal, neighbour, same


def lookup(points: DataFrame, probes: DataFrame, default=None, interpolate: str = "previous", cell: Column | None = None) -> DataFrame:
    """The value of each series at its probes (series_id, t, any more columns): probes with `value`.

    previous: the last value at or before t, else the default (a value, or a table (series_id, default)). linear: between the neighbours; the default before the
    first point, the last value after the last. One sort by (series_id, t) serves points and probes together.

    cell: an expression of t that grows with it, for series too long for one task. Each cell is sorted by itself; the
    last point of earlier cells (the first of later ones) comes from a row for each cell.
    """
    if interpolate not in ("previous", "linear"):
        raise ValueError(f"unknown interpolate '{interpolate}': previous or linear")
    more = [c for c in probes.columns if c not in ("series_id", "t")]
    kind = points.schema["value"].dataType
    held = F.struct(F.col("t").alias("t"), F.col("value").alias("value"))
    a = points.select("series_id", "t", F.lit(0).alias("k"), held.alias("p"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in more))
    b = probes.select("series_id", "t", F.lit(1).alias("k"), F.lit(None).cast(a.schema["p"].dataType).alias("p"), *more)
    both = a.unionByName(b).withColumn("_cell", F.lit(0) if cell is None else cell)
    order = Window.partitionBy("series_id", "_cell").orderBy("t", "k")
    sides = {"left": F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))}
    if interpolate == "linear":
        # Read backwards, as Spark folds a frame up to the last row anew for each row.
        back = Window.partitionBy("series_id", "_cell").orderBy(F.col("t").desc(), F.col("k").desc())
        sides["right"] = F.last("p", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    if cell is None:
        both = both.withColumns(sides)
    else:
        by_cell = Window.partitionBy("series_id").orderBy("_cell")
        of = both.groupBy("series_id", "_cell").agg(F.max_by("p", F.when(F.col("k") == 0, F.col("t"))).alias("a"), F.min_by("p", F.when(F.col("k") == 0, F.col("t"))).alias("b"))
        before = F.last("a", ignorenulls=True).over(by_cell.rowsBetween(Window.unboundedPreceding, -1))
        after = F.last("b", ignorenulls=True).over(Window.partitionBy("series_id").orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1))
        of = of.select(F.col("series_id").alias("_s"), F.col("_cell").alias("_c"), before.alias("_left"), after.alias("_right"))
        both = both.withColumns(sides).join(of, same(F.col("series_id"), F.col("_s")) & same(F.col("_cell"), F.col("_c")))
        both = both.withColumns({c: F.coalesce(c, f"_{c}") for c in sides})
    found = before_first(both.where("k = 1"), default, kind, F.col("left").isNotNull(), F.col("left.value"))
    value = F.col("value")
    if interpolate == "linear":
        share = length(points, F.col("left.t"), F.col("t")) / length(points, F.col("left.t"), F.col("right.t"))
        between = F.col("left.value") + share * (F.col("right.value") - F.col("left.value"))
        inside = F.col("left").isNotNull() & F.col("right").isNotNull() & (F.col("left.t") < F.col("t"))
        value = F.when(inside, between).otherwise(value.cast("double"))
    return found.select("series_id", "t", *more, value.alias("value"))


def at(points: DataFrame, t, default=None, interpolate: str = "previous") -> DataFrame:
    """(series_id, t, value) of every series at one time."""
    probes = points.select("series_id").distinct().select("series_id", literal(points, t).alias("t"))
    return lookup(points, probes, default, interpolate)


def item(points: DataFrame, index: int) -> DataFrame:
    """The index-th point of each series; negative from the end."""
    order = F.col("t").asc() if index >= 0 else F.col("t").desc()
    n = F.row_number().over(Window.partitionBy("series_id").orderBy(order))
    return points.withColumn("_n", n).where(F.col("_n") == (index + 1 if index >= 0 else -index)).drop("_n")


def ends(points: DataFrame) -> DataFrame:
    """(series_id, n, first_t, first_value, last_t, last_value)."""
    first, last = F.min_by(F.struct("value"), "t"), F.max_by(F.struct("value"), "t")
    rows = points.groupBy("series_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), first.alias("f"), F.max("t").alias("last_t"), last.alias("l"))
    return rows.select("series_id", "n", "first_t", F.col("f.value").alias("first_value"), "last_t", F.col("l.value").alias("last_value"))


def equal_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """(series_id, equal): whether both hold the same points of a series, repeated ones as often.

    One aggregation a side: the number of points, and a sum and an exclusive or of two hashes of each. Series that differ
    agree by chance once in 2 ** 128.
    """

    def of(points: DataFrame) -> DataFrame:
        point = [F.xxhash64("t", "value"), F.xxhash64(F.lit(1), "t", "value")]
        return points.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(point[0].cast("decimal(20,0)")).alias("s"), F.bit_xor(point[1]).alias("x"))

    x, y = of(a).alias("x"), of(b).alias("y")
    both = x.join(y, same(F.col("x.series_id"), F.col("y.series_id")), "full")
    alike = (F.col("x.n") == F.col("y.n")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.x") == F.col("y.x"))
    return both.select(F.coalesce("x.series_id", "y.series_id").alias("series_id"), F.coalesce(alike, F.lit(False)).alias("equal"))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same points. Runs a job; see `equal_series`."""
    return equal_series(a, b).where("not equal").isEmpty()


def islice(points: DataFrame, start: int | None = None, stop: int | None = None, cell: Column | None = None) -> DataFrame:
    """Points start, start + 1, ... before stop of each series, in order of t, with their place n; negative ones count from the end.

    An index of cells of t (a row for each: points, and those of earlier cells) tells in which cells they are; only
    points of these are put in order.
    """
    rows = points.select("series_id", "t", "value").withColumn("_cell", default_cell(points) if cell is None else cell)
    of = rows.groupBy("series_id", "_cell").agg(F.count("*").alias("k"))
    order = Window.partitionBy("series_id").orderBy("_cell")
    of = of.select("series_id", "_cell", "k", (F.sum("k").over(order) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("series_id")).alias("size"))
    place = lambda x, missing: missing if x is None else F.lit(x) if x >= 0 else F.greatest(F.lit(0), F.col("size") + F.lit(x))
    of = of.withColumns({"low": place(start, F.lit(0)), "high": place(stop, F.col("size"))}).where("before < high and before + k > low")
    n = F.col("before") + F.row_number().over(Window.partitionBy("series_id", "_cell").orderBy("t")) - 1
    return rows.join(of, ["series_id", "_cell"]).withColumn("n", n).where("n >= low and n < high").select("series_id", "t", "value", "n")


def _inside(points: DataFrame, start, end, inclusive: tuple[bool, bool]) -> Column:
    out = F.lit(True)
    if start is not None:
        s = literal(points, start)
        out = out & ((F.col("t") >= s) if inclusive[0] else (F.col("t") > s))
    if end is not None:
        e = literal(points, end)
        out = out & ((F.col("t") <= e) if inclusive[1] else (F.col("t") < e))
    return out


def irange(points: DataFrame, start=None, end=None, inclusive: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Points from start to end, the bounds themselves as `inclusive` says; a null bound is infinite."""
    return points.where(_inside(points, start, end, inclusive))


def upsert(points: DataFrame, new: DataFrame) -> DataFrame:
    """points with those of new, which win at the same t; of new ones the largest `seq`, if it has that column."""
    seq = F.col("seq") if "seq" in new.columns else F.lit(0)
    both = points.select("series_id", "t", "value", F.lit(0).alias("_new"), F.lit(None).cast("long").alias("_seq"))
    both = both.union(new.select("series_id", "t", "value", F.lit(1), seq.cast("long")))
    v = F.max_by(F.struct("value"), F.struct("_new", "_seq")).alias("v")
    return both.groupBy("series_id", "t").agg(v).select("series_id", "t", "v.value")


def skip_unchanged_input(new: DataFrame, default=None) -> DataFrame:
    """Points of new (with `seq`, the order of input) that differ from the one given before, the first from the default."""
    kind = new.schema["value"].dataType
    before = F.lag(F.struct("value")).over(Window.partitionBy("series_id").orderBy("seq"))
    prev = F.when(before.isNull(), F.lit(default).cast(kind)).otherwise(before["value"])
    return new.withColumn("_p", prev).where(~same(F.col("value"), F.col("_p"))).drop("_p")


def compact(points: DataFrame, cell: Column | None = None) -> DataFrame:
    """Points that change the value; the first always stays. cell: see `model.neighbour`."""
    return neighbour(points, F.struct("value"), cell).where(F.col("near").isNull() | ~same(F.col("value"), F.col("near.value"))).drop("near")


def set_point(points: DataFrame, t, value, default=None, compact: bool = False) -> DataFrame:
    """The value at t in every series. compact: only in series where another value holds there."""
    now = at(points, t, default)
    if compact:
        now = now.where(~same(F.col("value"), F.lit(value)))
    return upsert(points, now.withColumn("value", F.lit(value).cast(points.schema["value"].dataType)))


def set_interval(points: DataFrame, start, end, value, default=None, compact: bool = False) -> DataFrame:
    """The value on [start, end); what held at end holds from there on.

    compact: no new point where it would not change the value. A series that has no points outside gets its start anyhow.
    """
    check_bounds(start, end)
    s, e = literal(points, start), literal(points, end)
    rest = points.where(~((F.col("t") > s) & (F.col("t") < e)))
    at_start, at_end = at(points, start, default), at(points, end, default)
    if compact:
        held = rest.select("series_id").distinct().withColumn("held", F.lit(True))
        at_start = at_start.join(held, "series_id", "left").where(F.col("held").isNull() | ~same(F.col("value"), F.lit(value)))
        at_end = at_end.where(~same(F.col("value"), F.lit(value)))
    at_start = at_start.withColumn("value", F.lit(value).cast(points.schema["value"].dataType))
    return upsert(rest, at_start.select("series_id", "t", "value").union(at_end.select("series_id", "t", "value")))


def remove(points: DataFrame, t) -> DataFrame:
    """Points but those at t. Raises KeyError if no series has one."""
    gone = F.col("t") == literal(points, t)
    if points.where(gone).isEmpty():
        raise KeyError(f"no point at {t}")
    return points.where(~gone)


def remove_interval(points: DataFrame, start, end, inclusive: tuple[bool, bool] = (True, False)) -> DataFrame:
    """Points outside start to end, the bounds themselves as `inclusive` says; a null bound is infinite."""
    return points.where(~_inside(points, start, end, inclusive))


def is_not_none(points: DataFrame) -> DataFrame:
    return points.withColumn("value", F.col("value").isNotNull())


def rank(points: DataFrame, x, side: str = "left") -> DataFrame:
    """(series_id, rank): how many points or events lie before x (right: at or before)."""
    t = F.col("t") < literal(points, x) if side == "left" else F.col("t") <= literal(points, x)
    return points.groupBy("series_id").agg(F.count_if(t).alias("rank"))


def changes(points: DataFrame, expression: Column) -> DataFrame:
    return points.withColumn("value", expression)


def numbered(points: DataFrame) -> DataFrame:
    """points with their place n in the series, from 0, and the series' size."""
    return points.withColumn("n", F.row_number().over(in_order()) - 1).withColumn("size", F.count("*").over(by_series()))
