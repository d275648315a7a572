"""Aggregates over time: how long a series had which value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar
from ..model import check_bounds, is_clock, length, literal, micros, neighbour, seconds, truthy
from .merge import running
from .periods import periods, unbounded
from .points import lookup


def true_periods(mask: DataFrame, start=None, end=None) -> DataFrame:
    """(series_id, t0, t1) while the mask is true; with a bound also before its first and after its last point (false, its last value)."""
    p = periods(mask, start, end)
    return p.where(truthy(F.col("value"), p.schema["value"].dataType)).select("series_id", "t0", "t1")


def _where(sides: list[DataFrame], holds: Callable[..., Column]) -> DataFrame:
    """(series_id if there, t0, t1): disjoint periods in which holds(n of the first side, n of the second, ...) is true, n being how many periods of a side there are.

    One pass over the bounds of all sides in order, +1 where a period begins and -1 where it ends; no pair of periods is compared.
    """
    keys = [c for c in ("series_id",) if c in sides[0].columns]
    names = [f"n{i}" for i in range(len(sides))]
    rows = None
    for i, p in enumerate(sides):
        move = lambda c, n: F.struct(F.col(c).alias("t"), *(F.lit(n if j == i else 0).alias(m) for j, m in enumerate(names)))  # noqa: B023, E731
        one = p.where("t0 < t1").select(*keys, F.inline(F.array(move("t0", 1), move("t1", -1))))
        rows = one if rows is None else rows.union(one)
    cell = F.date_trunc("day", "t") if is_clock(sides[0], "t0") else F.floor(F.col("t") / 4096)
    moves = rows.groupBy(*keys, "t").agg(*(F.sum(m).alias(m) for m in names)).withColumns({f"d{m}": F.col(m) for m in names})
    held = running(moves, keys, names, cell, tuple(f"d{m}" for m in names))
    now, before = holds(*(F.col(m) for m in names)), holds(*(F.col(m) - F.col(f"d{m}") for m in names))
    edges = held.where(now != before).select(*(keys or [F.lit(0).alias("series_id")]), "t", now.alias("value"))
    return neighbour(edges, F.struct("t"), cell, ahead=True).where("value").select(*keys, F.col("t").alias("t0"), F.col("near.t").alias("t1"))


def sweep(true: DataFrame, least: int = 1) -> DataFrame:
    """Disjoint periods, in order, in which at least `least` of the true ones (t0, t1; series_id if there) hold; those that touch are one."""
    return _where([true], lambda n: n >= least)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where periods of both hold."""
    return _where([a, b], lambda n, m: (n > 0) & (m > 0))


def complement(true: DataFrame, start, end, series: DataFrame | None = None) -> DataFrame:
    """[start, end) without the true periods; series (series_id): those that count even if they have no true period."""
    check_bounds(start, end)
    keys = [c for c in ("series_id",) if c in true.columns]
    base = (true if series is None else series).select(*keys).distinct() if keys else true.sparkSession.range(1)
    whole = base.select(*keys, literal(true, start, "t0").alias("t0"), literal(true, end, "t0").alias("t1"))
    return _where([whole, true], lambda n, m: (n > 0) & (m == 0))


def _stats(right: DataFrame) -> DataFrame:
    """One row: first start and last end of periods (t0, t1; series_id if they differ by series), and their mean distance.

    Cells of that width hold about one period each.
    """
    own = "series_id" in right.columns
    span = seconds(right, length(right, F.min("t0"), F.max("t1"), "t0"), "t0")
    width = span.cast("double") * F.greatest(F.lit(1), F.approx_count_distinct("series_id") if own else F.lit(1)) / F.greatest(F.lit(1), F.count("*"))
    return right.agg(F.min("t0").alias("_a"), F.max("t1").alias("_b"), F.when(width > 0, width).otherwise(1.0).alias("_w"))


def _cells(df: DataFrame, column: str, width: Column) -> Callable[[Column], Column]:
    """Numbers of cells of times of the kind that the column has."""
    number = lambda c: seconds(df, length(df, calendar.origin(df.schema[column].dataType), c, column), column)
    return lambda c: F.floor(number(c) / width)


def overlap(left: DataFrame, right: DataFrame, width: float | None = None) -> DataFrame:
    """Pieces of left periods (series_id, t0, t1, any columns) within right ones (t0, t1; series_id if masks differ by series).

    Both sides are cut to cells of `width` (seconds or units; default: the mean distance of right periods) and joined on
    them, and on series_id if the right has one, each pair in the cell where its overlap starts. So neither side is
    compared as a whole with the other, and a long period meets about as many cells as there are pieces of it.
    """
    own = "series_id" in right.columns
    stats = F.broadcast(_stats(right).select("_w"))  # one row
    cell = _cells(left, "t0", F.col("_w") if width is None else F.lit(float(width)))
    r = right.crossJoin(stats).select(*([F.col("series_id").alias("m_id")] if own else []), F.col("t0").alias("m0"), F.col("t1").alias("m1"), "_w")
    a = left.crossJoin(stats).withColumn("cell", F.explode(F.sequence(cell(F.col("t0")), cell(F.col("t1")))))
    b = r.withColumn("m_cell", F.explode(F.sequence(cell(F.col("m0")), cell(F.col("m1"))))).drop("_w")
    on = (F.col("cell") == F.col("m_cell")) & (F.col("t0") < F.col("m1")) & (F.col("t1") > F.col("m0")) & (cell(F.greatest("t0", "m0")) == F.col("cell"))
    joined = a.join(b, on & (F.col("series_id") == F.col("m_id")) if own else on)
    rest = [c for c in left.columns if c not in ("t0", "t1")]
    return joined.select(*rest, F.greatest("t0", "m0").alias("t0"), F.least("t1", "m1").alias("t1"))


def masked(points: DataFrame, start=None, end=None, default=None, mask: DataFrame | None = None) -> DataFrame:
    """Periods on [start, end], only while the mask (points, or periods without a value) is true. Running it fails where the mask is never true."""
    check_bounds(start, end)
    if mask is None:
        return periods(points, start, end, default)
    true = mask if "t0" in mask.columns else true_periods(mask)
    if start is not None or end is not None:
        s, e = literal(points, start), literal(points, end)
        true = true.select(*true.columns[:-2], F.greatest("t0", s).alias("t0"), F.least("t1", e).alias("t1")).where("t0 < t1")
    never = F.raise_error(F.lit("the mask is never true"))
    edge = F.broadcast(_stats(true).select(F.when(F.col("_a").isNull(), never.cast(points.schema["t"].dataType)).otherwise(F.col("_a")).alias("_a"), "_b"))  # one row
    p = unbounded(points, default).crossJoin(edge)
    return overlap(p.select("series_id", F.greatest("t0", "_a").alias("t0"), F.least("t1", "_b").alias("t1"), "value").where("t0 < t1"), true)


def distribution(points: DataFrame, start=None, end=None, default=None, mask: DataFrame | None = None, normalized: bool = False, interpolate: str = "previous") -> DataFrame:
    """(series_id, value, mass): time at each value, null values included; normalized: as a share of the series' time.

    mass is in seconds (times) or units. interpolate="linear" takes each piece's value at its midpoint.
    """
    if interpolate == "linear":
        p = linear_pieces(points, start, end, default, mask)
    elif interpolate == "previous":
        p = masked(points, start, end, default, mask)
    else:
        raise ValueError(f"unknown interpolate '{interpolate}'")
    amount = F.sum(length(p, F.col("t0"), F.col("t1"), "t0"))
    out = p.groupBy("series_id", "value").agg(seconds(p, amount, "t0").alias("mass"))
    if normalized:
        out = out.withColumn("mass", F.try_divide("mass", F.sum("mass").over(Window.partitionBy("series_id"))))
    return out


def linear_pieces(points: DataFrame, start=None, end=None, default=None, mask: DataFrame | None = None) -> DataFrame:
    """Pieces whose value is the linear interpolation at their midpoint; the last value holds after the last point."""
    order = Window.partitionBy("series_id").orderBy("t")
    nxt = F.lead(F.struct("t", "value")).over(order)
    wide = points.select("series_id", "t", F.struct("t", "value", nxt.alias("next")).alias("value"))
    p = masked(wide, start, end, None, mask)
    mid = length(p, F.col("value.t"), F.col("t0"), "t0") + length(p, F.col("t0"), F.col("t1"), "t0") / 2
    share = mid / length(p, F.col("value.t"), F.col("value.next.t"), "t0")
    between = F.col("value.value") + share * (F.col("value.next.value") - F.col("value.value"))
    value = F.when(F.col("value").isNull(), F.lit(default).cast("double")).when(F.col("value.next").isNull(), F.col("value.value").cast("double")).otherwise(between)
    return p.select("series_id", "t0", "t1", value.alias("value"))


def mean(points: DataFrame, start=None, end=None, default=None, mask: DataFrame | None = None, interpolate: str = "previous") -> DataFrame:
    """(series_id, mean): weighted by time, null values left out."""
    p = linear_pieces(points, start, end, default, mask) if interpolate == "linear" else masked(points, start, end, default, mask)
    p = p.withColumn("value", F.col("value").cast("double"))
    w = length(p, F.col("t0"), F.col("t1"), "t0")
    known = F.when(F.col("value").isNotNull(), w)
    return p.groupBy("series_id").agg(F.try_divide(F.sum(F.col("value") * known), F.sum(known)).alias("mean"))


def n_points(points: DataFrame, start=None, end=None, mask: DataFrame | None = None, include_start: bool = True, include_end: bool = False, normalized: bool = False) -> DataFrame:
    """(series_id, n): points from start to end, or within each true period of the mask (a point on two counts twice)."""
    after = lambda a: F.col("t") >= a if include_start else F.col("t") > a
    before = lambda b: F.col("t") <= b if include_end else F.col("t") < b
    inside = F.lit(True)
    if start is not None:
        inside = inside & after(literal(points, start))
    if end is not None:
        inside = inside & before(literal(points, end))
    if mask is None:
        out = points.groupBy("series_id").agg(F.count_if(inside).alias("n"), F.count("*").alias("all"))
    else:
        true = mask if "t0" in mask.columns else true_periods(mask)
        own = "series_id" in true.columns
        # A point is in one cell, a period in all that it touches: each pair meets once.
        stats = F.broadcast(_stats(true).select("_w"))  # one row
        cell = _cells(points, "t", F.col("_w"))
        m = true.crossJoin(stats).select(*([F.col("series_id").alias("m_id")] if own else []), "t0", "t1", F.explode(F.sequence(cell(F.col("t0")), cell(F.col("t1")))).alias("m_cell"))
        on = (cell(F.col("t")) == F.col("m_cell")) & after(F.col("t0")) & before(F.col("t1"))
        hits = points.where(inside).crossJoin(stats).join(m, ((F.col("series_id") == F.col("m_id")) & on) if own else on).groupBy("series_id").agg(F.count("*").alias("n"))
        out = points.groupBy("series_id").agg(F.count("*").alias("all")).join(hits, "series_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("series_id", F.try_divide("n", "all").alias("n") if normalized else F.col("n"))


def split(p: DataFrame, unit: str, n: int = 1) -> DataFrame:
    """Periods cut at the unit's edges, with the `bin_start` of each piece."""
    if not is_clock(p, "t0"):
        raise ValueError("only times have calendar units")
    step = calendar.interval(unit, n)
    first = calendar.floor(F.col("t0"), unit, n)
    edges = F.explode(F.sequence(first, F.col("t1"), step))
    cut = p.withColumn("bin_start", edges)
    cut = cut.withColumn("bin_end", F.col("bin_start") + step).where("bin_start < t1 and bin_end > t0")
    rest = [c for c in p.columns if c not in ("t0", "t1")]
    return cut.select(*rest, F.greatest("t0", "bin_start").alias("t0"), F.least("t1", "bin_end").alias("t1"), "bin_start")


#: Microseconds of a part, parts of a cycle, and what moves the start of a cycle to 1970-01-01 (a Thursday).
PARTS = {"hour": (3_600_000_000, 24, 0), "weekday": (86_400_000_000, 7, 3 * 86_400_000_000)}


def distribution_by(points: DataFrame, part: str, start=None, end=None, default=None, normalized: bool = True, first: int = 0, last: int | None = None, mask: DataFrame | None = None) -> DataFrame:
    """(series_id, part, value, mass) for part "hour" (0 to 23) or "weekday" (0: Monday), from `first` to `last`, each part normalized by itself.

    How much of a period lies in a part is the difference of two sums since a cycle's start: so a period makes a row for
    each part that it touches, 24 or 7 at most, however long it is.
    """
    unit, cycle, shift = PARTS[part]
    last = cycle - 1 if last is None else last
    if not 0 <= first <= last < cycle:
        raise ValueError(f"parts from {first} to {last} are not within 0 to {cycle - 1}")
    p = masked(points, start, end, default, mask)
    if not is_clock(p, "t0"):
        raise ValueError("only times have hours and weekdays")
    origin = calendar.origin(p.schema["t0"].dataType)
    p = p.select("series_id", "value", (micros(origin, F.col("t0")) + shift).alias("a"), (micros(origin, F.col("t1")) + shift).alias("b"))
    steps = F.expr(f"sequence(floor(a / {unit}D), least(floor(a / {unit}D) + {cycle - 1}, floor((b - 1) / {unit}D)))")
    p = p.withColumn("i", F.explode(steps)).withColumn(part, F.pmod("i", F.lit(cycle)).cast("int")).where(F.col(part).between(first, last))

    def since(c: str) -> Column:
        """Time in the part from the start of all cycles to c."""
        whole, rest = F.floor(F.col(c) / (unit * cycle)), F.pmod(F.col(c), F.lit(unit * cycle))
        return whole * unit + F.greatest(F.lit(0).cast("long"), F.least(F.lit(unit).cast("long"), rest - F.col(part) * F.lit(unit)))

    out = p.groupBy("series_id", part, "value").agg((F.sum(since("b") - since("a")) / 1e6).alias("mass"))
    if normalized:
        out = out.withColumn("mass", F.try_divide("mass", F.sum("mass").over(Window.partitionBy("series_id", part))))
    return out


def bins(points: DataFrame, unit: str, n: int = 1, start=None, end=None, default=None, mask: DataFrame | None = None, keep_last: bool = False, smaller: str | None = None, transform: str = "distribution") -> DataFrame:
    """Calendar bins from the one that holds start: (series_id, bin_start, value, mass in seconds), or with transform "n_points" (series_id, bin_start, n).

    The last bin of a series is left out unless keep_last. mask: only while it is true; points count at its periods'
    starts, not at their ends. smaller: a unit whose floor bins start from, in place of their own: bins of n units from
    the floor of start. Bins without time or points have no row.
    """
    if transform not in ("distribution", "n_points"):
        raise ValueError(f"bins hold a distribution or n_points, not '{transform}'")
    if smaller is not None and (start is None or unit in ("years", "months")):
        raise ValueError("bins from a smaller unit's floor need a start, and units of fixed length")
    if transform == "n_points":
        p = points.select("series_id", "t")
        if start is not None:
            p = p.where(F.col("t") >= literal(points, start))
        if end is not None:
            p = p.where(F.col("t") < literal(points, end))
        if mask is not None:
            p = within(p, mask)
        b = calendar.floor(F.col("t"), unit, n) if smaller is None else _from(F.col("t"), points, start, smaller, unit, n)
        out = p.groupBy("series_id", b.alias("bin_start")).agg(F.count("*").alias("n"))
    else:
        p = masked(points, start, end, default, mask)
        cut = split(p, unit, n) if smaller is None else _split_from(p, points, start, smaller, unit, n)
        out = cut.groupBy("series_id", "bin_start", "value").agg((F.sum(length(p, F.col("t0"), F.col("t1"), "t0")) / 1e6).alias("mass"))
    if keep_last:
        return out
    if end is not None:
        e = literal(points, end)
        top = calendar.floor(e, unit, n) if smaller is None else _from(e, points, start, smaller, unit, n)
        # The bin that holds end is open; where end is a bin's edge the bin before it is the last.
        last = F.when(top == e, top - calendar.interval(unit, n)).otherwise(top)
        return out.where(F.col("bin_start") < last)
    return out.withColumn("_l", F.max("bin_start").over(Window.partitionBy("series_id"))).where("bin_start < _l").drop("_l")


def _fixed(unit: str, n: int) -> int:
    return n * {"weeks": 604_800, "days": 86_400, "hours": 3600, "minutes": 60, "seconds": 1}[unit] * 1_000_000


def _from(t: Column, points: DataFrame, start, smaller: str, unit: str, n: int) -> Column:
    """The start of the bin of t, bins of n units being counted from the floor of start."""
    base, us = calendar.floor(literal(points, start), smaller), _fixed(unit, n)
    back = F.pmod(micros(base, t), F.lit(us))
    return F.timestamp_add("MICROSECOND", -back, t)


def _split_from(p: DataFrame, points: DataFrame, start, smaller: str, unit: str, n: int) -> DataFrame:
    step = calendar.interval(unit, n)
    cut = p.withColumn("bin_start", F.explode(F.sequence(_from(F.col("t0"), points, start, smaller, unit, n), F.col("t1"), step)))
    cut = cut.withColumn("bin_end", F.col("bin_start") + step).where("bin_start < t1 and bin_end > t0")
    return cut.select("series_id", "value", F.greatest("t0", "bin_start").alias("t0"), F.least("t1", "bin_end").alias("t1"), "bin_start")


def within(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """rows (series_id, t, any columns) at which the mask (points, or periods (t0, t1), with series_id if they differ by series) is true.

    Each row looks up the last true period that has begun, of disjoint ones; no row is compared with all periods.
    """
    true = sweep(mask if "t0" in mask.columns else true_periods(mask))
    if "series_id" in true.columns:
        held = lookup(true.select("series_id", F.col("t0").alias("t"), F.col("t1").alias("value")), rows.withColumnRenamed("value", "_value") if "value" in rows.columns else rows)
        held = held.where(F.col("t") < F.col("value")).drop("value")
        return held.withColumnRenamed("_value", "value").select(*rows.columns)
    # One mask for all series: each distinct t asks it once, cell by cell.
    cell = F.date_trunc("day", "t") if is_clock(rows) else F.floor(F.col("t") / 4096)
    one = true.select(F.lit(0).alias("series_id"), F.col("t0").alias("t"), F.col("t1").alias("value"))
    at = lookup(one, rows.select(F.lit(0).alias("series_id"), "t").distinct(), cell=cell).where(F.col("t") < F.col("value")).select(F.col("t").alias("_t"))
    return rows.join(at, F.col("t") == F.col("_t"), "left_semi")


def rebin(binned: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """Bins added up by key(bin_start)."""
    return binned.groupBy("series_id", key(F.col("bin_start")).alias("bin"), "value").agg(F.sum("mass").alias("mass"))
