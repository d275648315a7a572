"""Reading and writing series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transform = Callable[[Column], Column]


def from_csv(spark: SparkSession, path: str, time_column: int = 0, value_column: int = 1, time_transform: Transform | None = None, value_transform: Transform | None = None, skip_header: bool = True, delimiter: str = ",", time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Points from CSV files, one series a file (its path is the series_id); values stay text unless transformed."""
    n = max(time_column, value_column) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
    rows = spark.read.schema(schema).option("header", skip_header).option("enforceSchema", True).option("sep", delimiter).csv(path)
    t, v = F.col(f"c{time_column}"), F.col(f"c{value_column}")
    t = time_transform(t) if time_transform else F.try_to_timestamp(t, F.lit(time_format)).cast("timestamp_ntz")
    return rows.select(F.input_file_name().alias("series_id"), t.alias("t"), (value_transform(v) if value_transform else v).alias("value"))


def iso(c: Column) -> Column:
    """A time from ISO text; Z is +00:00, and an offset is taken off."""
    return F.coalesce(F.try_to_timestamp(c).cast("timestamp_ntz"), c.try_cast("timestamp_ntz"))


def from_json(df: DataFrame, column: str, key: str = "series_id", time_key: str = "time", value_key: str = "value", value_type: str = "double", time_transform: Transform = iso) -> DataFrame:
    """Points from a column of JSON text: a list of records, or an object from times to values."""
    text = F.trim(F.col(column))
    listed = F.from_json(text, f"array<struct<`{time_key}`:string,`{value_key}`:{value_type}>>")
    mapped = F.transform(F.map_entries(F.from_json(text, f"map<string,{value_type}>")), lambda e: F.struct(e["key"].alias(time_key), e["value"].alias(value_key)))
    either = F.when(text.startswith("["), listed).when(text.startswith("{"), mapped)
    rows = df.select(F.col(key).alias("series_id"), F.explode(either).alias("p"))
    return rows.select("series_id", time_transform(F.col(f"p.{time_key}")).alias("t"), F.col(f"p.{value_key}").alias("value"))


def read_json(spark: SparkSession, path: str | None = None, json_string: str | None = None, **options) -> DataFrame:
    """Points from a JSON file (which wins) or a JSON text."""
    if path is None and json_string is None:
        raise ValueError("a path or a json_string is needed")
    if path is not None:
        rows = spark.read.option("wholetext", True).text(path).select(F.lit(path).alias("series_id"), F.col("value").alias("j"))
    else:
        if json_string.strip()[:1] not in ("[", "{"):
            raise TypeError("JSON must be a list or an object")
        rows = spark.range(1).select(F.lit("json").alias("series_id"), F.lit(json_string).alias("j"))
    return from_json(rows, "j", **options)


TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _written(points: DataFrame, time_format: str, time_transform: Transform | None) -> Column:
    if time_transform is not None:
        return time_transform(F.col("t"))
    return F.date_format("t", time_format) if isinstance(points.schema["t"].dataType, (T.TimestampType, T.TimestampNTZType)) else F.col("t").cast("string")


def to_json(points: DataFrame, dict_format: bool = False, time_format: str = TIME_FORMAT, time_transform: Transform | None = None) -> DataFrame:
    """(series_id, json): each series as a list of records, or as an object from times to values, in order of time.

    time_transform: how a time is written, in place of the format. A series becomes one value, so it must fit into a
    task's memory; `write_json_array` has no such bound.
    """
    t = _written(points, time_format, time_transform)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("t", t.alias("time"), "value"))), lambda x: F.struct(x["time"].alias("time"), x["value"].alias("value")))
    rows = points.groupBy("series_id").agg(listed.alias("l"))
    if dict_format:
        return rows.select("series_id", F.to_json(F.map_from_entries("l"), {"ignoreNullFields": "false"}).alias("json"))
    return rows.select("series_id", F.to_json("l", {"ignoreNullFields": "false"}).alias("json"))


def write_json(points: DataFrame, path: str, value_transform: Transform | None = None, **options) -> None:
    """What `to_json` gives, as text files with a series a line. options: those of `to_json`."""
    if value_transform is not None:
        points = points.withColumn("value", value_transform(F.col("value")))
    to_json(points, **options).select("json").write.mode("overwrite").text(path)


def write_json_array(points: DataFrame, path: str, time_format: str = TIME_FORMAT, time_transform: Transform | None = None) -> None:
    """Each series as one JSON array of records in order of t, in a folder series_id=... of text files.

    A line is a record, the first one behind "[", others behind ",", the last one before "]": the files of a folder, one
    after another, are the array. Points are dealt to tasks by ranges of (series_id, t), so that no task has a whole
    long series; no record is ever collected.
    """
    ends = points.groupBy("series_id").agg(F.min("t").alias("_a"), F.max("t").alias("_b")).withColumnRenamed("series_id", "_s")
    rows = points.join(ends, F.col("series_id").eqNullSafe(F.col("_s")))
    record = F.to_json(F.struct(_written(points, time_format, time_transform).alias("time"), "value"), {"ignoreNullFields": "false"})
    line = F.concat(F.when(F.col("t") == F.col("_a"), "[").otherwise(","), record, F.when(F.col("t") == F.col("_b"), "]").otherwise(""))
    in_order = rows.select("series_id", "t", line.alias("line")).repartitionByRange("series_id", "t").sortWithinPartitions("series_id", "t")
    in_order.select("series_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("series_id").text(path)


def read_json_array(spark: SparkSession, path: str, series_type: str = "string", value_type: str = "double", time_transform: Transform = iso) -> DataFrame:
    """Points of what `write_json_array` wrote; files are split among tasks by lines."""
    rows = spark.read.schema(f"value string, series_id {series_type}").text(path)
    record = F.regexp_replace(F.regexp_replace("value", r"^[\[,]", ""), r"\]$", "")
    p = F.from_json(record, f"struct<time:string,value:{value_type}>")
    return rows.select("series_id", p.alias("p")).select("series_id", time_transform(F.col("p.time")).alias("t"), "p.value")


def save(points: DataFrame, path: str, defaults: DataFrame | None = None) -> None:
    """Points, and each series' default if given, as Parquet."""
    points.write.mode("overwrite").parquet(f"{path}/points")
    if defaults is not None:
        defaults.write.mode("overwrite").parquet(f"{path}/defaults")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The points that `save` wrote."""
    return spark.read.parquet(f"{path}/points")


def load_defaults(spark: SparkSession, path: str) -> DataFrame:
    """The defaults (series_id, default) that `save` wrote, as `lookup` and others take them."""
    return spark.read.parquet(f"{path}/defaults")


def show(points: DataFrame, n: int = 20, default=None) -> str:
    """The first n points, how many more there are, and the default (of a series in memory)."""
    total = points.count()
    lines = [f"{r.t}: {r.value!r}" for r in points.orderBy("series_id", "t").limit(n).collect()]
    return "<Series>\n{" + ",\n ".join(lines) + (f",\n and {total - n} more items" if total > n else "") + f"}}\ndefault: {default!r}"


def plot(points: DataFrame, interpolate: str = "previous", width: float = 12, aspect: float | None = None, color: str = "#4a7aa5", linewidth: float = 1, marker: str = "o", markersize: float = 3):
    """(figure, axes) of the series; needs matplotlib. For series that fit in memory."""
    styles = {"previous": "steps-post", "linear": "default"}
    if interpolate not in styles:
        raise ValueError(f"unknown interpolate '{interpolate}': previous or linear")
    import matplotlib.pyplot as plt

    rows = points.orderBy("series_id", "t").toPandas()
    figure, axes = plt.subplots(figsize=(width, width * (aspect or min(1.0, 0.1 + 0.05 * rows["value"].nunique()))))
    for _, one in rows.groupby("series_id"):
        axes.plot(one["t"], one["value"], drawstyle=styles[interpolate], color=color, linewidth=linewidth, marker=marker, markersize=markersize)
    return figure, axes
