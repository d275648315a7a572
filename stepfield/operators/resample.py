"""Regular samples, moving averages and bins of a step function."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import check_bounds, is_clock, length, literal
from .merge import aligned
from .points import lookup
from .timeagg import within


def _step(points: DataFrame, period) -> Column:
    if is_clock(points):
        seconds = period.total_seconds() if isinstance(period, datetime.timedelta) else float(period)
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    return F.lit(period)


def check_period(start, end, period) -> None:
    zero = datetime.timedelta(0) if isinstance(period, datetime.timedelta) else 0
    if period <= zero:
        raise ValueError("the sampling period has to be positive")
    if start is not None and end is not None and period > end - start:
        raise ValueError("sampling_period is longer than the series")


def grid(points: DataFrame, period, start=None, end=None) -> DataFrame:
    """(series_id, t): start, start + period, ... up to end; missing bounds are each series' first and last t."""
    check_bounds(start, end)
    check_period(start, end, period)
    b = points.groupBy("series_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    a = F.col("a") if start is None else literal(points, start)
    z = F.col("b") if end is None else literal(points, end)
    step = _step(points, period)
    if is_clock(points):
        b = b.where(a <= z)
        return b.select("series_id", F.explode(F.sequence(a, z, step)).alias("t"))
    # Numbers: sequence() takes whole ones only.
    n = F.floor((z - a) / step).cast("long")
    rows = b.where(a <= z).withColumns({"a": a, "i": F.explode(F.sequence(F.lit(0).cast("long"), n))})
    return rows.select("series_id", (F.col("a") + F.col("i") * step).cast(points.schema["t"].dataType).alias("t"))


def sample(points: DataFrame, period, start=None, end=None, default=None, interpolate: str = "previous", mask: DataFrame | None = None) -> DataFrame:
    """(series_id, t, value) on a regular grid; with a mask (points or true periods, see `timeagg.within`) only where it is true."""
    probes = grid(points, period, start, end)
    if mask is not None:
        probes = within(probes, mask)
    return lookup(points, probes, default, interpolate)


def panes(points: DataFrame, edges: DataFrame, default=None) -> DataFrame:
    """Series cut at edges (series_id, t, mark), in one sort: rows (series_id, t, mark, pane, v, w) of pieces with one value.

    v is the value, w its length, t and mark are those of the edge before, pane is its number from 1. Edges without a
    piece have a row with a null w, so that every pane has a row.
    """
    kind = points.schema["value"].dataType
    rows = points.select("series_id", "t", F.struct(F.col("value").alias("value")).alias("p"), F.lit(None).cast(f"struct<t:{edges.schema['t'].dataType.simpleString()},mark:{edges.schema['mark'].dataType.simpleString()}>").alias("e"))
    rows = rows.union(edges.select("series_id", "t", F.lit(None).cast(rows.schema["p"].dataType), F.struct("t", "mark")))
    order = Window.partitionBy("series_id").orderBy("t", F.col("e").isNotNull())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("series_id", "t", "e", F.last("p", ignorenulls=True).over(upto).alias("p"), F.last("e", ignorenulls=True).over(upto).alias("edge"), F.count("e").over(upto).alias("pane"), F.lead("t").over(order).alias("until"))
    v = F.when(F.col("p").isNull(), F.lit(default).cast(kind)).otherwise(F.col("p.value")).cast("double")
    w = length(points, F.col("t"), F.col("until"))
    return rows.where("pane > 0 and (e is not null or until > t)").select("series_id", "edge.t", "edge.mark", "pane", v.alias("v"), F.when(w > 0, w).alias("w"))


def _sums() -> list[Column]:
    used = F.col("v").isNotNull() & F.col("w").isNotNull()
    return [F.sum(F.when(used, F.col("v") * F.col("w"))).alias("area"), F.sum(F.when(used, F.col("w"))).alias("known")]


def _mean() -> Column:
    return F.when(F.col("known") > 0, F.col("area") / F.col("known")).alias("value")


def window_means(points: DataFrame, windows: DataFrame, default=None) -> DataFrame:
    """(series_id, t, value): the mean over time of each window (series_id, g, low, high), null values left out; g becomes t.

    The windows' edges cut each series into panes; a pane's integral is added up from the values within it, and panes
    meet in aligned blocks of 2 ** k, of which a window takes two for each k at most. Nothing is subtracted: what lies
    outside a window, NaN and infinity included, has no part in its mean, however long the series. The work grows with
    the logarithm of a window's length.
    """
    edges = windows.select("series_id", F.col("low").alias("t")).union(windows.select("series_id", "high")).distinct()
    sums = panes(points, edges.withColumn("mark", F.lit(True)), default).groupBy("series_id", "t", "pane").agg(*_sums())
    low = sums.select(F.col("series_id").alias("_a"), F.col("t").alias("_t"), F.col("pane").alias("a"))
    high = sums.select(F.col("series_id").alias("_b"), F.col("t").alias("_u"), F.col("pane").alias("b"))
    runs = windows.join(low, (F.col("series_id") == F.col("_a")) & (F.col("low") == F.col("_t"))).join(high, (F.col("series_id") == F.col("_b")) & (F.col("high") == F.col("_u"))).select("series_id", "g", "a", "b")
    most = F.broadcast(runs.agg(F.max(F.col("b") - F.col("a")).alias("most")))  # one row
    levels = sums.where("known > 0").crossJoin(most).select("series_id", F.explode(F.expr("sequence(0, length(bin(most)) - 1)")).alias("k"), "pane", "area", "known")
    blocks = levels.groupBy("series_id", "k", F.expr("shiftright(pane, k)").alias("block")).agg(F.sum("area").alias("area"), F.sum("known").alias("known"))
    out = aligned(runs).join(blocks, ["series_id", "k", "block"], "left").groupBy("series_id", "g").agg(F.sum("area").alias("area"), F.sum("known").alias("known"))
    return out.select("series_id", F.col("g").alias("t"), _mean())


def moving_average(points: DataFrame, period, window=None, start=None, end=None, placement: str = "center", default=None) -> DataFrame:
    """(series_id, t, value): the mean over a window around, from ("left") or up to ("right") each grid point.

    See `window_means`.
    """
    if placement not in ("center", "left", "right"):
        raise ValueError(f"unknown placement '{placement}': center, left or right")
    window = period if window is None else window
    if window <= (datetime.timedelta(0) if isinstance(window, datetime.timedelta) else 0):
        raise ValueError("a window of no length has no mean")
    back, ahead = {"center": (window / 2, window / 2), "left": (0 * window, window), "right": (window, 0 * window)}[placement]
    g = grid(points, period, start, end).withColumn("g", F.col("t"))
    kind = points.schema["t"].dataType if is_clock(points) else "double"
    p = points if is_clock(points) else points.withColumn("t", F.col("t").cast("double"))
    at = lambda x, sign: (F.col("g") - _step(points, x) if sign < 0 else F.col("g") + _step(points, x)).cast(kind)
    return window_means(p, g.select("series_id", "g", at(back, -1).alias("low"), at(ahead, 1).alias("high")), default)


def sample_interval(points: DataFrame, period=None, start=None, end=None, index: DataFrame | None = None, operation: str = "mean", default=None) -> DataFrame:
    """(series_id, t, value) for bins [t, next t) of the grid or of the index (t): mean over time, max or min of values in effect.

    No pair of a bin and a period is ever joined: means come from the panes between the bins' edges,
    extremes from the value in effect at a bin's start and the points within it.
    """
    if operation not in ("mean", "max", "min"):
        raise KeyError(operation)
    g = grid(points, period, start, end) if index is None else points.select("series_id").distinct().crossJoin(index.select("t"))
    b = g.select("series_id", "t", F.lead("t").over(Window.partitionBy("series_id").orderBy("t")).alias("m1")).where("m1 is not null")
    if operation == "mean":
        edges = g.select("series_id", "t", F.lead("t").over(Window.partitionBy("series_id").orderBy("t")).isNotNull().alias("mark"))
        return panes(points, edges, default).where("mark").groupBy("series_id", "t").agg(*_sums()).select("series_id", "t", _mean())
    best = F.max if operation == "max" else F.min
    starts = lookup(points, b.select("series_id", "t"), default).select("series_id", F.col("t").alias("g"), "value")
    bins = b.select("series_id", "t", F.struct("t", "m1").alias("value"))
    inside = lookup(bins, points.select("series_id", "t", F.col("value").alias("v"))).where(F.col("t") < F.col("value.m1"))
    both = starts.union(inside.select("series_id", F.col("value.t").alias("g"), F.col("v")))
    return both.groupBy("series_id", F.col("g").alias("t")).agg(best("value").alias("value"))
