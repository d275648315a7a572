"""Statistics of histograms: DataFrames (series_id, value, mass)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import same


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """How often each value occurs."""
    return df.groupBy(F.col(key).alias("series_id"), F.col(value).alias("value")).agg(F.count("*").alias("mass"))


def total(h: DataFrame) -> DataFrame:
    return h.groupBy("series_id").agg(F.sum("mass").alias("total"))


def normalized(h: DataFrame) -> DataFrame:
    return h.withColumn("mass", F.try_divide("mass", F.sum("mass").over(Window.partitionBy("series_id"))))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("series_id", "value").agg(F.sum("mass").alias("mass"))


def moments(h: DataFrame) -> DataFrame:
    """(series_id, mean, variance, std) of the population, null values left out. The variance is taken about the mean."""
    v, m = F.col("value").cast("double"), F.col("mass")
    mean = h.where("value is not null").groupBy("series_id").agg(F.try_divide(F.sum(v * m), F.sum(m)).alias("mean"))
    var = h.where("value is not null").join(mean, "series_id").groupBy("series_id", "mean")
    out = var.agg(F.try_divide(F.sum(m * (v - F.col("mean")) * (v - F.col("mean"))), F.sum(m)).alias("variance"))
    return out.select("series_id", "mean", "variance", F.sqrt("variance").alias("std"))


def extremes(h: DataFrame, include_zero: bool = False) -> DataFrame:
    """(series_id, min, max) of values with any mass (or all of them)."""
    v = F.col("value") if include_zero else F.when(F.col("mass") > 0, F.col("value"))
    return h.groupBy("series_id").agg(F.min(v).alias("min"), F.max(v).alias("max"))


def value_cell(value: Column, bits: int = 16) -> Column:
    """A long that grows with a double: equal where sign, power of two and the first bits of the mantissa are."""
    size, scale = F.abs(value), F.lit(float(1 << bits))
    e = F.floor(F.log2(size))
    # Where the logarithm of a number just below a power of two is rounded up, the part is -1: the cell below, as it should be.
    key = (e + 1100) * F.lit(1 << bits) + F.floor((size / F.pow(F.lit(2.0), e) - 1) * scale)
    huge = F.isnan(value) | (size == F.lit(float("inf")))
    key = F.when(huge, F.lit(4000 << bits)).when(size > 0, key).otherwise(F.lit(0))
    return F.when(F.isnan(value) | (value > 0), key).otherwise(-key)


def _knots(rows: DataFrame, beta) -> DataFrame:
    """(series_id, beta, x, y): both ends of the span of each value; `beta` says how much to leave out at them, by the least mass."""
    by = Window.partitionBy("series_id")
    order = by.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("series_id", "value", "mass", F.coalesce(F.sum("mass").over(order), F.lit(0.0)).alias("lo"), F.sum("mass").over(by).alias("all"), beta(F.min("mass").over(by)).alias("beta")).where("all > 0")
    return rows.select("series_id", "beta", F.inline(F.array(F.struct(((F.col("lo") + F.col("beta")) / F.col("all")).alias("x"), F.col("value").alias("y")), F.struct(((F.col("lo") + F.col("mass") - F.col("beta")) / F.col("all")).alias("x"), F.col("value").alias("y")))))


def _knots_by_cells(rows: DataFrame, beta, qs: list[float]) -> DataFrame:
    """The knots that the quantiles qs need: those of values in a cell that holds one, and of other cells' least and greatest values."""
    by = Window.partitionBy("series_id")
    sums = [F.sum("mass").alias("mass"), F.min("value").alias("v0"), F.max("value").alias("v9"), F.min_by("mass", "value").alias("m0"), F.max_by("mass", "value").alias("m9")]
    lo, mass, least, all_, cut = (F.col(c) for c in ("lo", "mass", "least", "all", "beta"))
    ends = [(lo + cut, "v0"), (lo + F.col("m0") - cut, "v0"), (lo + mass - F.col("m9") + cut, "v9"), (lo + mass - cut, "v9")]
    knots = F.inline(F.array(*(F.struct((at / all_).alias("x"), F.col(v).alias("y")) for at, v in ends)))
    order = by.orderBy("v0").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("series_id", value_cell(F.col("value")).alias("cell")).agg(*sums, F.min("mass").alias("least"))
    cells = cells.withColumns({"lo": F.coalesce(F.sum("mass").over(order), F.lit(0.0)), "all": F.sum("mass").over(by), "beta": beta(F.min(least).over(by))}).where("all > 0")
    first, last = F.min(F.least(*(at for at, _ in ends)) / all_).over(by), F.max(F.greatest(*(at for at, _ in ends)) / all_).over(by)
    # A cell's knots lie within its mass and beta. Is a quantile there? Then the values on both sides of it may be, too.
    holds = lambda q: F.least(F.greatest(q, F.col("first")), F.col("last")).between((lo - cut) / all_, (lo + mass + cut) / all_)
    cells = cells.withColumns({"first": first, "last": last}).withColumn("open", (F.col("v0") < F.col("v9")) & F.exists(F.array(*map(F.lit, qs)), holds))
    opened = cells.where("open").select(F.col("series_id").alias("_s"), F.col("cell").alias("_c"), F.col("lo").alias("_lo"), "all", "beta")
    inside = rows.join(opened, same(F.col("series_id"), F.col("_s")) & (value_cell(F.col("value")) == F.col("_c")))
    values = inside.groupBy("series_id", "_c", "_lo", "all", "beta", "value").agg(*sums)
    before = Window.partitionBy("series_id", "_c").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("lo", F.col("_lo") + F.coalesce(F.sum("mass").over(before), F.lit(0.0)))
    return cells.where("not open").select("series_id", "beta", knots).union(values.select("series_id", "beta", knots))


def quantiles(h: DataFrame, qs: list[float], alpha: float = 0.5, smallest: float | None = None, by_cells: bool = False) -> DataFrame:
    """(series_id, q, value): the inverse of the piecewise linear distribution.

    Each value spans its mass but for beta = alpha * min(smallest, least mass) at both ends; between spans the inverse is
    linear. beta = 0: it jumps, and at a jump is the mean of both sides (at q = 0 the least value).

    by_cells: for series of very many different values, which else a window puts in order. Masses are added up by cells
    of values (`value_cell`), at most 65,536 between two powers of two; only cells that hold a quantile are read again,
    value by value, each by itself. The result is the same (for alpha up to 1).
    """
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie in [0, 1]")
    if by_cells and not 0 <= alpha <= 1:
        raise ValueError("by cells, alpha lies in [0, 1]")
    qs = [float(q) for q in qs]
    by = Window.partitionBy("series_id")
    rows = h.where("value is not null").select("series_id", F.col("value").cast("double").alias("value"), F.col("mass").cast("double").alias("mass"))
    beta = lambda least: F.lit(float(alpha)) * (least if smallest is None else F.least(F.lit(float(smallest)), least))
    knots = _knots_by_cells(rows, beta, qs) if by_cells else _knots(rows, beta)
    # Of knots at the same x the later, larger value counts; the one before it is kept for jumps.
    knots = knots.groupBy("series_id", "beta", "x").agg(F.max("y").alias("y"))
    knots = knots.withColumn("prev", F.lag("y").over(by.orderBy("x"))).withColumn("first", F.min("x").over(by)).withColumn("last", F.max("x").over(by))
    asked = knots.withColumn("q0", F.explode(F.array(*map(F.lit, qs)))).withColumn("q", F.least(F.greatest("q0", "first"), "last"))
    below, above = F.col("x") <= F.col("q"), F.col("x") >= F.col("q")
    k = F.struct("x", "y", "prev", "beta")
    got = asked.groupBy("series_id", F.col("q0").alias("q"), F.col("q").alias("at")).agg(F.max_by(k, F.when(below, F.col("x"))).alias("a"), F.min_by(k, F.when(above, F.col("x"))).alias("b"))
    linear = F.col("a.y") + (F.col("at") - F.col("a.x")) / (F.col("b.x") - F.col("a.x")) * (F.col("b.y") - F.col("a.y"))
    jump = (F.col("a.y") + F.coalesce("a.prev", "a.y")) / 2
    exact = F.col("a.x") == F.col("at")
    value = F.when(F.col("a.beta") > 0, F.when(exact, F.col("a.y")).otherwise(linear)).otherwise(F.when(exact, jump).otherwise(F.col("a.y")))
    return got.select("series_id", "q", value.alias("value"))


def median(h: DataFrame, alpha: float = 0.5, smallest: float | None = None) -> DataFrame:
    return quantiles(h, [0.5], alpha, smallest).select("series_id", F.col("value").alias("median"))
