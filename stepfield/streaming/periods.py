"""Series that arrive as streams: closed periods and binned time, as points come in order of time in each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def closed_periods(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream of (series_id, t0, t1, value) from a stream of points (series_id, t timestamp, value double).

    A period is given out when the next point of its series arrives. State: the last point of each series. Points that
    are not later than it are too late and left out; of points at one t the last of a batch counts.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("t", kind="stable").drop_duplicates("t", keep="last")
        last = state.get if state.exists else None
        if last is not None:
            rows = rows[rows["t"] > last[0]]
        times, values = list(rows["t"]), list(rows["value"])
        if last is not None:
            times, values = [last[0], *times], [last[1], *values]
        if times:
            value = values[-1]
            state.update((times[-1], None if value is None or value != value else float(value)))
        yield pd.DataFrame({"series_id": [key[0]] * max(0, len(times) - 1), "t0": times[:-1], "t1": times[1:], "value": values[:-1]})

    kind = points.schema["series_id"].dataType.simpleString()
    p = points.select("series_id", F.col("t").cast("timestamp").alias("t"), F.col("value").cast("double").alias("value")).withWatermark("t", delay)
    return p.groupBy("series_id").applyInPandasWithState(run, f"series_id {kind}, t0 timestamp, t1 timestamp, value double", "t timestamp, value double", "append", GroupStateTimeout.NoTimeout)


def binned(events: DataFrame, width: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Stream of (series_id, bin_start, n): events in tumbling (or sliding) bins, complete once the watermark has passed."""
    w = F.window("t", width, slide) if slide else F.window("t", width)
    out = events.select("series_id", F.col("t").cast("timestamp").alias("t")).withWatermark("t", delay).groupBy("series_id", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("series_id", F.col("w.start").alias("bin_start"), "n")


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Stream of (series_id, first_t, end_t, n): events less than the gap apart."""
    out = events.select("series_id", F.col("t").cast("timestamp").alias("t")).withWatermark("t", delay).groupBy("series_id", F.session_window("t", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("series_id", F.col("w.start").alias("first_t"), F.col("w.end").alias("end_t"), "n")
