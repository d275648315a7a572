"""Arithmetic and logic of a series with another one or with a scalar."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import carried, truthy
from .merge import SUM, folded
from .points import compact

Function = Callable[[Column, Column], Column]


def both(x: DataFrame, y: DataFrame, x_default=None, y_default=None, cell: Column | None = None) -> DataFrame:
    """(series_id, t, x, y) at every t of either: a full outer as-of join, in one sort. cell: see `model.neighbour`."""
    a = x.select("series_id", "t", F.struct("value").alias("a"), F.lit(None).cast(f"struct<value:{y.schema['value'].dataType.simpleString()}>").alias("b"))
    b = y.select("series_id", "t", F.lit(None).cast(a.schema["a"].dataType).alias("a"), F.struct("value").alias("b"))
    one = a.unionByName(b).groupBy("series_id", "t").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    held = carried(one, ("a", "b"), cell)
    pick = lambda c, d, k: F.when(F.col(c).isNull(), F.lit(d).cast(k)).otherwise(F.col(f"{c}.value"))
    return held.select("series_id", "t", pick("a", x_default, x.schema["value"].dataType).alias("x"), pick("b", y_default, y.schema["value"].dataType).alias("y"))


def operation(x: DataFrame, y, function: Function, x_default=None, y_default=None, cell: Column | None = None) -> DataFrame:
    """Points of function(x, y) at every t of either; y may be a scalar. cell: see `model.neighbour`."""
    if isinstance(y, DataFrame):
        return both(x, y, x_default, y_default, cell).select("series_id", "t", function(F.col("x"), F.col("y")).alias("value"))
    return x.select("series_id", "t", function(F.col("value"), F.lit(y)).alias("value"))


def add(x: DataFrame, y, cell: Column | None = None, **defaults) -> DataFrame:
    """x + y with null as nothing, compacted; a scalar is added as it is."""
    f = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return compact(operation(x, y, f, cell=cell, **defaults), cell) if isinstance(y, DataFrame) else operation(x, y, lambda a, b: a + b)


def add_all(series: list[DataFrame]) -> DataFrame:
    """The sum of several tables of series, series by series, null as nothing, compacted; one alone is left as it is.

    The tables are united once and what holds is added up (`merge.folded`), however many there are.
    """
    if not series:
        raise ValueError("no series to add")
    if len(series) == 1:
        return series[0]
    rows = reduce(DataFrame.unionByName, (x.select("series_id", "t", "value", F.lit(i).alias("_table")) for i, x in enumerate(series)))
    out = folded(rows, {"value": SUM}, by=("series_id",), member="_table")
    return compact(out.select("series_id", "t", F.coalesce("value", F.lit(0)).alias("value")))


def strict_add(x: DataFrame, y: DataFrame, cell: Column | None = None, **defaults) -> DataFrame:
    """x + y, null where one is."""
    return compact(operation(x, y, lambda a, b: a + b, cell=cell, **defaults), cell)


def difference(x: DataFrame, y, **defaults) -> DataFrame:
    return operation(x, y, lambda a, b: a - b, **defaults)


def multiply(x: DataFrame, y, **defaults) -> DataFrame:
    return operation(x, y, lambda a, b: a * b, **defaults)


def _kind(x: DataFrame):
    return x.schema["value"].dataType


def logical_and(x: DataFrame, y, **defaults) -> DataFrame:
    """y where x counts as true, else x."""
    return operation(x, y, lambda a, b: F.when(truthy(a, _kind(x)), b).otherwise(a), **defaults)


def logical_or(x: DataFrame, y, **defaults) -> DataFrame:
    """x where it counts as true, else y."""
    return operation(x, y, lambda a, b: F.when(truthy(a, _kind(x)), a).otherwise(b), **defaults)


def logical_xor(x: DataFrame, y: DataFrame, **defaults) -> DataFrame:
    return operation(x, y, lambda a, b: truthy(a, _kind(x)) != truthy(b, _kind(y)), **defaults)


def to_bool(x: DataFrame, invert: bool = False) -> DataFrame:
    t = truthy(F.col("value"), _kind(x))
    return x.withColumn("value", ~t if invert else t)


NOT_GIVEN = object()


def bool_default(default, invert: bool = False, given=NOT_GIVEN):
    """The default of `to_bool`'s result: one that is given as it is, else null for null, else the truth of the default, inverted with it."""
    if given is not NOT_GIVEN:
        return given
    return None if default is None else bool(default) != invert


def threshold(x: DataFrame, limit, inclusive: bool = False) -> DataFrame:
    return x.withColumn("value", F.col("value") >= F.lit(limit) if inclusive else F.col("value") > F.lit(limit))
