"""Events: multisets of times (series_id, t), duplicates included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import in_order, length, literal, neighbour, seconds
from .merge import running


def cumulative_sum(events: DataFrame, cell: Column | None = None) -> DataFrame:
    """(series_id, t, value): how many events there were up to each t. cell: as in `active`."""
    n = events.groupBy("series_id", "t").agg(F.count("*").alias("value"))
    if cell is not None:
        return running(n, ["series_id"], ["value"], cell)
    return n.select("series_id", "t", F.sum("value").over(in_order().rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def between(events: DataFrame, start, end) -> DataFrame:
    """(series_id, n): events in the closed interval."""
    return events.groupBy("series_id").agg(F.count_if(F.col("t").between(literal(events, start), literal(events, end))).alias("n"))


def gaps(events: DataFrame, cell: Column | None = None) -> DataFrame:
    """(series_id, t, gap) from each event to the one before, in seconds or units; none for the first. cell: as in `active`."""
    near = neighbour(events.select("series_id", "t"), F.struct("t"), cell).where("near is not null")
    return near.select("series_id", "t", seconds(events, length(events, F.col("near.t"), F.col("t"))).alias("gap"))


def active(opened: DataFrame, closed: DataFrame, cell: Column | None = None) -> DataFrame:
    """(series_id, t, value): opened less closed events up to each t of either. Before the first: null, or 0 if you like.

    cell: an expression of t by which one very long series is cut, so that no task holds it as a whole.
    """
    both = opened.select("series_id", "t", F.lit(1).alias("n")).union(closed.select("series_id", "t", F.lit(-1)))
    d = both.groupBy("series_id", "t").agg(F.sum("n").alias("value"))
    if cell is not None:
        return running(d, ["series_id"], ["value"], cell)
    return d.select("series_id", "t", F.sum("value").over(in_order().rowsBetween(Window.unboundedPreceding, 0)).alias("value"))


def clusters(events: DataFrame, gap: float, cell: Column | None = None) -> DataFrame:
    """(series_id, first_t, last_t, n): runs of events at most `gap` seconds (or units) apart. cell: as in `active`."""
    n = events.groupBy("series_id", "t").agg(F.count("*").alias("n"))
    near = neighbour(n, F.struct("t"), cell)
    apart = seconds(events, length(events, F.col("near.t"), F.col("t")))
    marked = near.select("series_id", "t", "n", F.when(apart <= gap, 0).otherwise(1).alias("new"))
    if cell is None:
        run = marked.withColumn("run", F.sum("new").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
        return run.groupBy("series_id", "run").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("n").alias("n")).drop("run")
    # What belongs together within a cell first, so that only that is numbered over all cells.
    inside = Window.partitionBy("series_id", "_cell").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.withColumn("_cell", cell).withColumn("part", F.sum("new").over(inside))
    parts = run.groupBy("series_id", "_cell", "part").agg(F.min("t").alias("t"), F.max("t").alias("last_t"), F.sum("n").alias("n"), F.max("new").alias("new"))
    starts = running(parts.select("series_id", "t", "new"), ["series_id"], ["new"], cell).withColumnRenamed("new", "run")
    joined = parts.drop("_cell", "part", "new").join(starts, ["series_id", "t"])
    return joined.groupBy("series_id", "run").agg(F.min("t").alias("first_t"), F.max("last_t").alias("last_t"), F.sum("n").alias("n")).drop("run")
