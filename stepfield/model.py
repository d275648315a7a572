"""Series as DataFrames.

Points have the columns series_id, t, value: a value holds from its t until the next t of its series. Before the first
point a default holds, null if none is given: one value for all series, or where an operator says so a table
(series_id, default) with a row for each. t is a timestamp, a date or a number, and unique in a series (`normalize` sees to that). A null
value is a value like any other: it ends the one before. Infinite bounds are nulls.

Every operator works on all series at once, partitioned by series_id, and is a plan of built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = "1970-01-01 00:00:00"


def of(df: DataFrame, key: str, t: str, value: str | None = None) -> DataFrame:
    """Points from columns of any table; without a value column, events (series_id, t)."""
    cols = [F.col(key).alias("series_id"), F.col(t).alias("t")]
    return df.select(*cols, *([F.col(value).alias("value")] if value else []))


def normalize(df: DataFrame, key: str, t: str, value: str, seq: str) -> DataFrame:
    """Points of which, at one t, the one with the largest seq counts."""
    picked = F.max_by(F.struct(F.col(value).alias("value")), F.col(seq)).alias("v")
    return df.groupBy(F.col(key).alias("series_id"), F.col(t).alias("t")).agg(picked).select("series_id", "t", "v.value")


def by_series() -> Window:
    return Window.partitionBy("series_id")


def in_order() -> Window:
    return Window.partitionBy("series_id").orderBy("t")


def is_clock(df: DataFrame, column: str = "t") -> bool:
    return isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def micros(a: Column, b: Column) -> Column:
    """Microseconds from a to b, both times."""
    return F.timestamp_diff("MICROSECOND", a, b)


def length(df: DataFrame, a: Column, b: Column, column: str = "t") -> Column:
    """Length of a to b as an exact number: microseconds for times, the difference for numbers."""
    return micros(a, b) if is_clock(df, column) else b - a


def seconds(df: DataFrame, amount: Column, column: str = "t") -> Column:
    """A sum of lengths in seconds (times) or as it is (numbers)."""
    return amount / F.lit(1e6) if is_clock(df, column) else amount


def literal(df: DataFrame, x, column: str = "t") -> Column:
    """A bound as a column of the time type; None is null."""
    if isinstance(x, Column):
        return x
    return F.lit(x).cast(df.schema[column].dataType)


def check_bounds(start, end) -> None:
    if start is not None and end is not None and not isinstance(start, Column) and not isinstance(end, Column) and start >= end:
        raise ValueError(f"empty range: it starts at {start} and ends at {end}")


def truthy(c: Column, kind: T.DataType) -> Column:
    """What Python's bool() says of a value."""
    if isinstance(kind, T.BooleanType):
        out = c
    elif isinstance(kind, T.StringType):
        out = F.length(c) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        out = F.size(c) > 0
    elif isinstance(kind, T.NumericType):
        out = c != 0
    else:
        out = c.isNotNull()
    return F.coalesce(out, F.lit(False))


def default_cell(df: DataFrame) -> Column:
    """Days of times, runs of 4096 of numbers."""
    return F.date_trunc("day", "t") if is_clock(df) else F.floor(F.col("t") / 4096)


def neighbour(rows: DataFrame, what: Column, cell: Column | None = None, ahead: bool = False, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """rows with `near`: `what` (a struct) of the row before, or ahead, in order of t within the keys; null where there is none.

    cell: an expression of t that grows with it. Then rows are read in order within cells only, and the last (first) row
    of each cell is handed to the next one: a task that puts a series in order has a row for each cell, not for each point.
    """
    step = F.lead if ahead else F.lag
    order = F.col("t").asc_nulls_first()
    if cell is None:
        return rows.withColumn("near", step(what).over(Window.partitionBy(*keys).orderBy(order)))
    rows = rows.withColumns({"_cell": cell, "_what": what})
    edges = rows.groupBy(*keys, "_cell").agg((F.min_by if ahead else F.max_by)("_what", "t").alias("_edge"))
    edges = edges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_cell").alias("_c"), step("_edge").over(Window.partitionBy(*keys).orderBy(F.col("_cell").asc_nulls_first())).alias("_edge"))
    inside = rows.withColumn("near", step("_what").over(Window.partitionBy(*keys, "_cell").orderBy(order)))
    on = same(F.col("_cell"), F.col("_c"))
    for i, k in enumerate(keys):
        on = on & same(F.col(k), F.col(f"_k{i}"))
    return inside.join(edges, on).withColumn("near", F.coalesce("near", "_edge")).drop("_cell", "_what", "_c", "_edge", *(f"_k{i}" for i in range(len(keys))))


def carried(rows: DataFrame, columns: tuple[str, ...], cell: Column | None = None) -> DataFrame:
    """rows with each of the columns taken from the last row of the series up to t that has it.

    cell: see `neighbour`. Each cell is read in order by itself; what earlier cells end with comes from a row for each cell.
    """
    def last(c: str, w) -> Column:
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    if cell is None:
        return rows.withColumns({c: last(c, Window.partitionBy("series_id").orderBy("t")) for c in columns})
    rows = rows.withColumn("_cell", cell)
    held = rows.groupBy("series_id", "_cell").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("t"))).alias(c) for c in columns))
    before = Window.partitionBy("series_id").orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("series_id").alias("_s"), F.col("_cell").alias("_c"), *(F.last(c, ignorenulls=True).over(before).alias(f"_{c}") for c in columns))
    inside = rows.withColumns({c: last(c, Window.partitionBy("series_id", "_cell").orderBy("t")) for c in columns})
    out = inside.join(held, same(F.col("series_id"), F.col("_s")) & same(F.col("_cell"), F.col("_c")))
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_cell", "_s", "_c", *(f"_{c}" for c in columns))


def before_first(rows: DataFrame, default, kind: T.DataType, found: Column, value: Column) -> DataFrame:
    """rows with `value` where found, else with the default: one for all series, or a table (series_id, default), null where it has no row."""
    if not isinstance(default, DataFrame):
        return rows.withColumn("value", F.when(found, value).otherwise(F.lit(default).cast(kind)))
    of = default.select(F.col("series_id").alias("_series"), F.col("default").cast(kind).alias("_default"))
    picked = rows.withColumn("value", value).withColumn("_found", found).join(of, same(F.col("series_id"), F.col("_series")), "left")
    return picked.withColumn("value", F.when(F.col("_found"), F.col("value")).otherwise(F.col("_default"))).drop("_series", "_default", "_found")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
