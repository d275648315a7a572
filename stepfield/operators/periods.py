"""Periods: what a series' value is from t0 to t1."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import before_first, check_bounds, in_order, literal, neighbour, same

ANY = object()


def periods(points: DataFrame, start=None, end=None, default=None, value=ANY, cell: Column | None = None) -> DataFrame:
    """(series_id, t0, t1, value) on [start, end]; a missing bound is the first or last t of the series.

    The default (a value, or a table (series_id, default)) holds before the first point. Empty periods are left out. value: only periods with that value, or for
    which value(t0, t1, value) holds. A bound given as a column may differ by series. Points after end are filtered
    at the scan; those before start are not, as one of them may hold at start. cell: see `model.neighbour`.
    """
    check_bounds(start, end)
    rows = points.select("series_id", "t", F.struct("value").alias("v"))
    if end is not None and not isinstance(end, Column):
        rows = rows.where(F.col("t") < literal(points, end))
    kind = points.schema["value"].dataType
    if start is not None:  # the default's own row, before all others
        first = before_first(points.select("series_id").distinct(), default, kind, F.lit(False), F.lit(None).cast(kind))
        rows = rows.union(first.select("series_id", F.lit(None).cast(points.schema["t"].dataType), F.struct("value")))
    rows = neighbour(rows, F.struct("t"), cell, ahead=True).withColumn("n", F.col("near.t"))
    t0 = F.greatest("t", literal(points, start)) if start is not None else F.col("t")
    t1 = F.least("n", literal(points, end)) if end is not None else F.col("n")
    out = rows.select("series_id", t0.alias("t0"), t1.alias("t1"), F.col("v.value").alias("value")).where("t0 < t1")
    if value is ANY:
        return out
    return out.where(value(F.col("t0"), F.col("t1"), F.col("value")) if callable(value) else same(F.col("value"), F.lit(value)))


def unbounded(points: DataFrame, default=None, cell: Column | None = None) -> DataFrame:
    """All periods, the first with a null t0 and the last with a null t1. cell: see `model.neighbour`."""
    kind = points.schema["value"].dataType
    first = before_first(points.select("series_id").distinct(), default, kind, F.lit(False), F.lit(None).cast(kind))
    first = first.select("series_id", F.lit(None).cast(points.schema["t"].dataType).alias("t"), "value")
    rows = neighbour(first.union(points.select("series_id", "t", "value")), F.struct("t"), cell, ahead=True)
    return rows.select("series_id", F.col("t").alias("t0"), F.col("near.t").alias("t1"), "value")


def runs(points: DataFrame, n: int = 2, cell: Column | None = None) -> DataFrame:
    """n consecutive points in a row: (series_id, t0, value0, t1, value1, ...).

    cell: see `model.neighbour`. The points ahead are then handed on one by one, in a pass each, as a cell may hold fewer than n.
    """
    if n < 1:
        raise ValueError("n must be positive")
    if cell is not None:
        rows = points.select("series_id", "t", F.struct("t", "value").alias("p0"))
        for i in range(1, n):
            rows = neighbour(rows, F.struct(F.col(f"p{i - 1}").alias("p")), cell, ahead=True).withColumn(f"p{i}", F.col("near.p")).drop("near")
        return rows.where(F.col(f"p{n - 1}").isNotNull()).select("series_id", *(F.col(f"p{i}.{c}").alias(f"{c}{i}") for i in range(n) for c in ("t", "value")))
    p = F.struct("t", "value")
    rows = points.select("series_id", "t", *((F.lead(p, i).over(in_order()) if i else p).alias(f"p{i}") for i in range(n)))
    return rows.where(F.col(f"p{n - 1}").isNotNull()).select("series_id", *(F.col(f"p{i}.{c}").alias(f"{c}{i}") for i in range(n) for c in ("t", "value")))


def cut(points: DataFrame, start=None, end=None, default=None) -> DataFrame:
    """The series on [start, end]: points at both bounds (None: unbounded) and all between."""
    check_bounds(start, end)
    from .points import at

    rows = points.select("series_id", "t", "value")
    if start is not None:
        rows = rows.where(F.col("t") > literal(points, start)).union(at(points, start, default).select("series_id", "t", "value"))
    if end is not None:
        rows = rows.where(F.col("t") < literal(points, end)).union(at(points, end, default).select("series_id", "t", "value"))
    return rows


def long_periods(points: DataFrame, keep: Callable[[Column], Column], least: float) -> DataFrame:
    """Periods of at least `least` seconds during which keep(value) holds throughout."""
    from ..model import length, seconds
    from .points import compact

    flags = compact(points.withColumn("value", F.coalesce(keep(F.col("value")), F.lit(False))))
    p = periods(flags, value=True)
    return p.where(seconds(p, length(p, F.col("t0"), F.col("t1"), "t0"), "t0") >= least)
