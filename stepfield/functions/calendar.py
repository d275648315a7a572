"""Calendar: floors, ranges, weekdays, masks."""

from __future__ import annotations

import datetime
from numbers import Real

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _unit(unit: str) -> str:
    if unit not in UNITS:
        raise ValueError(f"unknown unit '{unit}': one of {', '.join(UNITS)}")
    return unit


def origin(kind: T.DataType) -> Column:
    """Where time is counted from."""
    return F.lit(datetime.datetime(1970, 1, 1)).cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.lit(0)


def interval(unit: str, n: int = 1) -> Column:
    _unit(unit)
    if unit in ("years", "months"):
        return F.expr(f"INTERVAL '{n * (12 if unit == 'years' else 1)}' MONTH")
    days = {"weeks": 7, "days": 1}.get(unit)
    if days:
        return F.expr(f"INTERVAL '{n * days}' DAY")
    return F.expr(f"INTERVAL '{n}' {unit[:-1].upper()}")


def floor(t: Column, unit: str = "days", n: int = 1) -> Column:
    """The start of the n units that t is in, counted within the next larger unit; null stays null.

    years: from year 1. months: within the year. weeks: Mondays, by ISO week number for n > 1. days: within the month.
    """
    _unit(unit)
    if unit == "weeks":
        back = F.lit(0) if n == 1 else (F.weekofyear(t) - 1) % n
        return F.date_trunc("week", t).cast("timestamp_ntz") - F.make_dt_interval(back * 7)
    if unit == "years":
        return F.date_trunc("year", t).cast("timestamp_ntz") - F.make_ym_interval((F.year(t) - 1) % n)
    if unit == "months":
        return F.date_trunc("month", t).cast("timestamp_ntz") - F.make_ym_interval(F.lit(0), (F.month(t) - 1) % n)
    if unit == "days":
        return F.date_trunc("day", t).cast("timestamp_ntz") - F.make_dt_interval((F.dayofmonth(t) - 1) % n)
    part = {"hours": F.hour, "minutes": F.minute, "seconds": F.second}[unit]
    over = part(t) % n
    zero = F.lit(0)
    back = {"hours": (zero, over), "minutes": (zero, zero, over), "seconds": (zero, zero, zero, over.cast("decimal(18,6)"))}[unit]
    return F.date_trunc(unit[:-1], t).cast("timestamp_ntz") - F.make_dt_interval(*back)


def date_range(spark: SparkSession, start: datetime.datetime, end: datetime.datetime, unit: str, n: int = 1, inclusive_end: bool = False) -> DataFrame:
    """(t): start, start + n units, ... up to end, which belongs to it if inclusive_end."""
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), interval(unit, n))).alias("t"))
    return rows if inclusive_end else rows.where(F.col("t") < F.lit(end).cast("timestamp_ntz"))


def weekday_number(day: int | str) -> int:
    """0 (Monday) to 6, from a number or an English name in any case."""
    if isinstance(day, int) and not isinstance(day, bool) and 0 <= day <= 6:
        return day
    if isinstance(day, str) and day.lower() in DAYS:
        return DAYS.index(day.lower())
    raise ValueError(f"not a weekday: {day!r}")


def duration_to_number(d, units: str = "seconds") -> float:
    """Seconds of a timedelta; a number stays itself."""
    if units != "seconds":
        raise NotImplementedError(units)
    if isinstance(d, datetime.timedelta):
        return d.total_seconds()
    if isinstance(d, Real):
        if d in (float("inf"), float("-inf")):
            raise ValueError("an infinite duration has no number")
        return d
    raise TypeError(f"not a duration: {d!r}")


def midpoint(a: Column, b: Column, clock: bool = True) -> Column:
    """The point halfway from a to b; times to the microsecond, of two the even one."""
    if not clock:
        return a + (b - a) / 2
    d = F.timestamp_diff("MICROSECOND", a, b)
    half = F.floor(d / 2)
    us = half + (d % 2) * (half % 2)
    return a + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(18,0)") / 1000000).cast("decimal(18,6)"))


def _days(spark: SparkSession, start: datetime.datetime, end: datetime.datetime) -> DataFrame:
    first = F.lit(start.replace(hour=0, minute=0, second=0, microsecond=0)).cast("timestamp_ntz")
    return spark.range(1).select(F.explode(F.sequence(first, F.lit(end).cast("timestamp_ntz"), F.expr("INTERVAL '1' DAY"))).alias("d"))


def _clip(rows: DataFrame, start: datetime.datetime, end: datetime.datetime) -> DataFrame:
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return rows.select(F.greatest("t0", s).alias("t0"), F.least("t1", e).alias("t1")).where("t0 < t1")


def hour_of_day(spark: SparkSession, start: datetime.datetime, end: datetime.datetime, hour: int) -> DataFrame:
    """True periods (t0, t1) of the mask that is true in that hour of each day of [start, end)."""
    d = _days(spark, start, end)
    return _clip(d.select((F.col("d") + F.make_dt_interval(F.lit(0), F.lit(hour))).alias("t0"), (F.col("d") + F.make_dt_interval(F.lit(0), F.lit(hour + 1))).alias("t1")), start, end)


def day_of_week(spark: SparkSession, start: datetime.datetime, end: datetime.datetime, day: int | str) -> DataFrame:
    """True periods (t0, t1) of the mask that is true on that weekday, within [start, end)."""
    d = _days(spark, start, end).where(F.weekday("d") == weekday_number(day))
    return _clip(d.select(F.col("d").alias("t0"), (F.col("d") + F.expr("INTERVAL '1' DAY")).alias("t1")), start, end)
