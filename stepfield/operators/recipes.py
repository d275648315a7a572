"""Queries that combine operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import in_order, literal, micros, neighbour, same
from .events import active
from .merge import COUNT, SUM, counts, folded, running_sum
from .points import lookup


def crossings(points: DataFrame, limit: float) -> DataFrame:
    """(series_id, t, rising): where a series crosses the limit."""
    over = F.col("value") > F.lit(limit)
    before = F.lag(over).over(in_order())
    return points.select("series_id", "t", over.alias("rising"), before.alias("b")).where("b is not null and b <> rising").drop("b")


def returns(points: DataFrame) -> DataFrame:
    """(series_id, t, value): change from each point to the next as a share."""
    before = F.lag("value").over(in_order())
    return points.select("series_id", "t", (F.try_divide(F.col("value"), before) - 1).alias("value"), before.alias("b")).where("b is not null").drop("b")


def vwap(points: DataFrame, price: str = "value", volume: str = "volume") -> DataFrame:
    """(series_id, vwap): mean price weighted by volume."""
    return points.groupBy("series_id").agg(F.try_divide(F.sum(F.col(price) * F.col(volume)), F.sum(volume)).alias("vwap"))


def anomalies(points: DataFrame, hours: float = 6, least: int = 3, min_std: float = 0.01, limit: float = 2.0) -> DataFrame:
    """(series_id, t, value, z): points further than `limit` deviations from the mean of the hours before them."""
    us = micros(F.lit("1970-01-01").cast("timestamp_ntz"), F.col("t"))
    w = Window.partitionBy("series_id").orderBy("us").rangeBetween(-int(hours * 3600e6), -1)
    rows = points.withColumn("us", us)
    rows = rows.select("series_id", "t", "value", F.count("value").over(w).alias("n"), F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s"))
    return rows.where((F.col("n") >= least) & (F.col("s") >= min_std)).select("series_id", "t", "value", ((F.col("value") - F.col("m")) / F.col("s")).alias("z")).where(F.abs("z") > limit)


def stacked(points: DataFrame, starts: DataFrame, span: float, default=None) -> DataFrame:
    """Each series folded over start times (start): (series_id, start, t microseconds since start, value) on [start, start + span seconds).

    The value in force at a start, or else the default, is its point at 0; then come the points within the span that
    change the value. Spans may overlap: a point belongs to all that hold it. Starts and points meet in cells of the
    span's length, a point in the two cells that can hold its start.
    """
    us = lambda c: micros(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    size = F.lit(int(span * 1e6))
    every = starts.select("start").distinct()
    # A row for each series and start, as the result has.
    first = lookup(points, points.select("series_id").distinct().crossJoin(every).select("series_id", F.col("start").alias("t")), default)
    first = first.select("series_id", F.col("t").alias("start"), F.lit(0).cast("long").alias("t"), "value")
    a = points.withColumn("us", us("t")).withColumn("cell", F.explode(F.array(F.floor(us("t") / size), F.floor(us("t") / size) - 1)))
    b = every.withColumn("s", us("start")).withColumn("cell", F.floor(us("start") / size))
    d = F.col("us") - F.col("s")
    inside = a.join(b, "cell").where((d > 0) & (d < size)).select("series_id", "start", d.alias("t"), "value")
    near = neighbour(first.union(inside), F.struct("value"), keys=("series_id", "start"))
    return near.where(F.col("near").isNull() | ~same(F.col("value"), F.col("near.value"))).drop("near")


def stack(points: DataFrame, starts: DataFrame, span: float, default=None) -> DataFrame:
    """(series_id, t seconds, value): the mean of each series' folds (`stacked`) at each t of any of them; null values have no part in it."""
    folds = stacked(points, starts, span, default)
    got = folded(folds, {"sum": SUM, "known": COUNT}, by=("series_id",), member="start", cell=F.floor(F.col("t") / F.lit(max(1, int(span * 1e6) // 64))))
    return got.select("series_id", (F.col("t") / 1e6).alias("t"), F.try_divide("sum", "known").alias("value"))


def aligned(points: DataFrame, names: list[str], step: dt.timedelta, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """(t, a column for each name): the values of the named series at start, start + step, ..., at most end; null before the first point.

    Each step keeps the last point that it has seen, which is aggregated before the shuffle: the windows that fill the
    steps in between hold a row for each step, not the points.
    """
    us = step // dt.timedelta(microseconds=1)
    since = micros(literal(points, start), F.col("t"))
    slot = F.greatest(F.lit(0), (since + F.pmod(-since, F.lit(us))) / us).cast("long")
    seen = points.where((F.col("t") <= literal(points, end)) & F.col("series_id").isin(names))
    seen = seen.groupBy("series_id", slot.alias("n")).agg(F.max_by(F.struct("value"), "t").alias("v"))
    slots = points.sparkSession.range((end - start) // step + 1).select(F.explode(F.array(*map(F.lit, names))).alias("series_id"), F.col("id").alias("n"))
    upto = Window.partitionBy("series_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = slots.join(seen, ["series_id", "n"], "left").withColumn("value", F.last("v", ignorenulls=True).over(upto)["value"])
    wide = filled.groupBy("n").pivot("series_id", names).agg(F.first("value"))
    return wide.select(F.timestamp_add("MICROSECOND", F.col("n") * us, literal(points, start)).alias("t"), *names)


def hourly_rate(events: DataFrame, flag: Column) -> DataFrame:
    """(t, n, flagged, rate): events of each hour from the first to the last, those with the flag, and their share (null: none in that hour)."""
    hour = F.date_trunc("hour", "t").cast("timestamp_ntz")
    n = events.groupBy(hour.alias("t")).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"))
    spine = n.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("INTERVAL '1' HOUR"))).alias("t"))
    rows = spine.join(n, "t", "left").na.fill(0, ["n", "flagged"])
    return rows.withColumn("rate", F.try_divide("flagged", "n"))


def open_tickets(tickets: DataFrame) -> DataFrame:
    """(t, by_sum, by_value, by_events): how many tickets (id, opened, closed; closed null: still open) are open at each t, counted in three ways.

    As the sum of series that are 1 while a ticket is open, as the count of series with the value 1, and as opened less closed events.
    """
    one = F.inline(F.array_compact(F.array(F.struct(F.col("opened").alias("t"), F.lit(1).cast("long").alias("value")), F.when(F.col("closed").isNotNull(), F.struct(F.col("closed").alias("t"), F.lit(0).cast("long").alias("value"))))))
    series = tickets.select(F.col("id").alias("series_id"), one)
    month = F.date_trunc("month", "t")
    a = running_sum(series, month).select("t", F.col("sum").alias("by_sum"))
    b = counts(series, cell=month).where("value = 1").select("t", F.col("n").alias("by_value"))
    every = lambda c: tickets.where(F.col(c).isNotNull()).select(F.lit(0).alias("series_id"), F.col(c).alias("t"))
    c = active(every("opened"), every("closed"), month).select("t", F.col("value").alias("by_events"))
    return a.join(b, "t", "full").join(c, "t", "full")
