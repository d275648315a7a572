"""Many series as one: transitions, lists of values, sums and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import before_first, default_cell, literal, neighbour, same


def transitions(points: DataFrame, default=None, cell: Column | None = None) -> DataFrame:
    """(t, series_id, previous, value): every point with what held before it. Sort by (t, series_id) to read them in turn. cell: see `model.neighbour`."""
    kind = points.schema["value"].dataType
    rows = neighbour(points.select("series_id", "t", F.col("value").alias("now")), F.struct(F.col("now").alias("value")), cell)
    return before_first(rows, default, kind, F.col("near").isNotNull(), F.col("near.value")).select("t", "series_id", F.col("value").alias("previous"), F.col("now").alias("value"))


#: The least number of points in a block of `merged_changes`.
BLOCK = 4096


def _in_blocks(points: DataFrame, default, cell: Column | None) -> tuple[DataFrame, DataFrame]:
    """Points as (block, t, i, value), i the place of their series, and what each series holds when a block begins as (block, i, value).

    A block is a run of t with about as many points as there are series (at least BLOCK), so that the second table is
    about as large as the first at most, however few points a day has.
    """
    kind = points.schema["value"].dataType
    # A whole list holds a value of each series, so one task can number them.
    ids = points.select("series_id").distinct().withColumn("i", (F.row_number().over(Window.orderBy("series_id")) - 1).cast("int"))
    size = F.broadcast(number_of_series(points).select(F.greatest("k", F.lit(BLOCK)).alias("size")))
    at = running(points.groupBy("t").agg(F.count("*").alias("n")), [], ["n"], default_cell(points) if cell is None else cell)
    # At most one point of a series has the same t, so no block number is left out.
    at = at.crossJoin(size).select("t", F.floor((F.col("n") - 1) / F.col("size")).alias("block"))
    moves = points.select("series_id", "t", "value").join(ids.withColumnRenamed("series_id", "_id"), same(F.col("series_id"), F.col("_id"))).join(at, "t")
    ends = moves.groupBy("series_id", "i", "block").agg(F.max_by(F.struct("value"), "t").alias("v"))
    most = F.broadcast(at.agg(F.max("block").alias("most")))  # one row
    # The last value of a block holds when the next ones begin, up to the series' next block with a point.
    later = ends.crossJoin(most).withColumn("until", F.coalesce(F.lead("block").over(Window.partitionBy("i").orderBy("block")), "most"))
    later = later.where("block < until").select(F.explode(F.sequence(F.col("block") + 1, F.col("until"))).alias("block"), "i", "v.value")
    first = before_first(ends.groupBy("series_id", "i").agg(F.min("block").alias("b")), default, kind, F.lit(False), F.lit(None).cast(kind))
    return moves.select("block", "t", "i", "value"), later.union(first.select(F.explode(F.sequence(F.lit(0).cast("long"), "b")), "i", "value"))


def merged_changes(points: DataFrame, default=None, cell: Column | None = None) -> DataFrame:
    """(block, t, places, values): merged lists as changes, in proportion to the points; `expanded` makes lists of any part of them.

    For each t of any series the places, in order of series_id from 0, of those that have a point there, and its values.
    A row without t and places holds the values of all series when its block of times begins. default: a value, or a
    table (series_id, default). Written as Parquet sorted by block, a part of it is read by itself.
    """
    moves, starts = _in_blocks(points, default, cell)
    # Sorted by place alone: values may be of a type without an order.
    listed = F.array_sort(F.collect_list(F.struct("i", "value")), lambda x, y: x["i"] - y["i"])
    values = F.transform("_l", lambda x: x["value"]).alias("values")
    changes = moves.groupBy("block", "t").agg(listed.alias("_l")).select("block", "t", F.col("_l.i").alias("places"), values)
    whole = starts.groupBy("block").agg(listed.alias("_l")).select("block", F.lit(None).cast(points.schema["t"].dataType).alias("t"), F.lit(None).cast("array<int>").alias("places"), values)
    return whole.union(changes)


def expanded(changes: DataFrame, start=None, end=None) -> DataFrame:
    """(t, values): the lists of `merged_changes` at each of its t in [start, end]; only blocks with such a t are expanded."""
    within = F.col("t").isNotNull()
    for bound, ok in ((start, F.col("t").__ge__), (end, F.col("t").__le__)):
        within = within & ok(literal(changes, bound)) if bound is not None else within
    rows = changes
    if start is not None or end is not None:
        rows = rows.join(changes.where(within).select("block").distinct(), "block", "left_semi")
    starts = rows.where("t is null").select("block", "t", F.posexplode("values").alias("i", "value"))
    moves = rows.where("t is not null").select("block", "t", F.inline(F.arrays_zip("places", "values")).alias("i", "value"))
    return _filled(starts.union(moves)).where(within)


def merged_values(points: DataFrame, default=None, cell: Column | None = None) -> DataFrame:
    """(t, values): at each t of any series the values of all series, in order of series_id, as an array.

    The result has as many values as there are distinct t times series; use `running_sum`, `running_max`, `folded` or
    `counts` where they will do, and `merged_changes` to keep it. A task has the points of one cell of t and what each
    series held before it, and fills the cell's times one after another; no row is made for each time and series. Where
    cells have far fewer points than there are series, `expanded(merged_changes(points))` does with fewer rows.
    """
    kind = points.schema["value"].dataType
    # A row of the result holds a value of each series, so one task can number them.
    ids = points.select("series_id").distinct().withColumn("i", (F.row_number().over(Window.orderBy("series_id")) - 1).cast("int"))
    rows = points.select("series_id", "t", "value").withColumn("block", default_cell(points) if cell is None else cell)
    moves = rows.join(ids.withColumnRenamed("series_id", "_id"), same(F.col("series_id"), F.col("_id"))).select("block", "t", "i", "value")
    ends = moves.groupBy("i", "block").agg(F.max_by(F.struct("value"), "t").alias("v"))
    cells = rows.select("block").distinct()
    # What a series holds when a cell begins: a row for each cell and series.
    before = Window.partitionBy("i").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grid = cells.crossJoin(ids.select("i")).join(ends, ["i", "block"], "left")
    start = grid.select("i", "block", F.last("v", ignorenulls=True).over(before).alias("v"))
    start = start.select("block", F.lit(None).cast(points.schema["t"].dataType).alias("t"), "i", F.when(F.col("v").isNull(), F.lit(default).cast(kind)).otherwise(F.col("v.value")).alias("value"))
    return _filled(start.union(moves))


def _blocks(points: DataFrame, size: DataFrame, cell: Column) -> DataFrame:
    """(_cell, first, last, edges): the blocks of each cell of t. A point's is the first and one more for each edge up to its t.

    A block is a run of t with about as many points as `size` (one row) says. Small cells share one; a cell of more
    points is cut at percentiles of its t.
    """
    t = points.schema["t"].dataType
    rows = points.select("t", cell.alias("_cell"))
    cells = rows.groupBy("_cell").agg(F.count("*").alias("n")).crossJoin(F.broadcast(size))
    cells = cells.withColumn("before", F.sum("n").over(Window.orderBy("_cell")) - F.col("n"))
    large = F.broadcast(cells.where("n > size").select("_cell"))
    cut = F.percentile_approx("t", [x / 100 for x in range(1, 100)], 1000)
    edges = rows.join(large, "_cell", "left_semi").groupBy("_cell").agg(cut.alias("edges"))
    begin = F.concat(F.array(F.lit(None).cast(t)), F.coalesce("edges", F.array().cast(T.ArrayType(t))))
    parts = cells.join(edges, "_cell", "left").select("_cell", "n", "size", "before", F.posexplode(begin).alias("x", "edge"))
    # Of equal edges the last counts, and numbers have no gaps: each block has a row for every series.
    parts = parts.groupBy("_cell", "edge").agg(F.max(F.expr("(before + n * x div 100) div size")).alias("near"))
    parts = parts.withColumn("block", F.dense_rank().over(Window.orderBy("near")).cast("long"))
    parts = parts.groupBy("_cell", "block").agg(F.min(F.struct(F.col("edge").isNotNull().alias("later"), F.col("edge"))).alias("e"))
    return parts.groupBy("_cell").agg(F.min("block").alias("first"), F.max("block").alias("last"), F.collect_list("e.edge").alias("edges"))


def merged_texts(points: DataFrame, separator: str = ",", null: str = "null", default=None, cell: Column | None = None, start=None, end=None) -> DataFrame:
    """(t, text): the lists of `merged_values` at each t in [start, end], each value as text, joined by the separator; null stands for a null value.

    Points go to blocks of t once, and what each series holds when a block begins goes there, too: about as many rows
    at most, however few points a day has. A task joins anew only the parts of a list that change at a time. A row for
    each cell of t is broadcast.
    """
    kind, t, text = points.schema["value"].dataType, points.schema["t"].dataType, T.StringType()
    if isinstance(default, DataFrame):
        default = default.select("series_id", F.col("default").cast(kind).cast(text).alias("default"))
    else:
        default = F.lit(default).cast(kind).cast(text)
    key = F.col("series_id")
    if isinstance(points.schema["series_id"].dataType, (T.FloatType, T.DoubleType)):
        key = (key + F.lit(0).cast(points.schema["series_id"].dataType)).alias("series_id")  # -0.0 is 0.0
    points = points.select(key, "t", F.col("value").cast(text).alias("value"))
    earlier = F.lit(False) if start is None else F.col("t") < literal(points, start)
    first = points.groupBy("series_id").agg(F.max_by(F.when(earlier, F.struct("value")), F.when(earlier, F.col("t"))).alias("v"))
    first = before_first(first, default, text, F.col("v").isNotNull(), F.col("v.value")).select("series_id", F.lit(0).cast("long").alias("block"), "value")
    within = points.where(~earlier)
    if end is not None:
        within = within.where(F.col("t") <= literal(points, end))
    cell = default_cell(points) if cell is None else cell
    blocks = _blocks(within, number_of_series(points).select(F.greatest("k", F.lit(BLOCK)).alias("size")), cell)
    block = F.col("first") + F.size(F.filter("edges", lambda x: x <= F.col("t")))
    # In a given number of partitions, which Spark does not put together at run time: both sides of the union are dealt alike, and nothing is dealt twice.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moves = within.withColumn("_cell", cell).join(F.broadcast(blocks), "_cell").select(block.alias("block"), "t", "series_id", "value").repartition(n, "block")
    ends = moves.groupBy("series_id", "block").agg(F.max_by(F.struct("value"), "t").alias("v")).select("series_id", "block", "v.value")
    # A block's last value holds when the next ones begin, up to the series' next block with a point.
    until = F.coalesce(F.lead("block").over(Window.partitionBy("series_id").orderBy("block")), "most")
    later = first.union(ends).crossJoin(F.broadcast(blocks.agg(F.max("last").alias("most")))).withColumn("until", until).where("block < until")
    starts = later.select(F.explode(F.sequence(F.col("block") + 1, F.col("until"))).alias("block"), F.lit(None).cast(t).alias("t"), "series_id", "value")
    rows = starts.repartition(n, "block").union(moves).repartition(n, "block").sortWithinPartitions("block", F.col("t").asc_nulls_first(), "series_id")
    return _filled(rows, (separator, null))


def _filled(rows: DataFrame, text: tuple[str, str] | None = None) -> DataFrame:
    """(t, values) of rows (block, t, i, value): those without t hold when the block begins.

    text: a separator and what stands for null. Then rows (block, t, series_id, value) are dealt and sorted by block, t
    and series_id already, values are strings, and the result is (t, text).
    """

    def fill(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def places(ids, k):
            """Places of series_ids among the first k of them, which are in order."""
            if pa.types.is_nested(ids.type):
                ids = pa.array([repr(x) for x in ids.to_pylist()], pa.string())
            found = pc.index_in(ids, value_set=ids.slice(0, k))
            if found.null_count:
                raise ValueError("a block lacks what its series hold when it begins")
            return found.to_numpy()

        def read(held):
            """A cell's places and values, how many series there are, and the times, numbered, with the first row of each."""
            part = pa.Table.from_batches(held).combine_chunks()
            i, value, t = (part.column(c).combine_chunks() for c in ("series_id" if text else "i", "value", "t"))
            i, value, t = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (i, value, t))
            k = t.null_count  # series: their rows without a time come first
            i = places(i, k) if text else i.to_numpy()
            later = t.slice(k)
            code = pc.rank(later, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            return i, value, k, later, code, first

        def texts(held):
            """A cell's times and texts, in blocks of some MB."""
            i, value, k, later, code, first = read(held)
            separator, null = text
            i, value, width = i.tolist(), value.fill_null(null).to_pylist(), 256
            now = [null] * k
            for place, x in zip(i[:k], value[:k], strict=True):
                now[place] = x
            parts = [now[at : at + width] for at in range(0, k, width)]
            joined = [separator.join(x) for x in parts]
            done, size, begun = [], 0, 0
            for n, (at, upto) in enumerate(zip(first, [*first[1:], len(code)], strict=True), 1):
                moved = set()
                for row in range(k + at, k + upto):
                    a, b = divmod(i[row], width)
                    parts[a][b] = value[row]
                    moved.add(a)
                for a in moved:
                    joined[a] = separator.join(parts[a])
                done.append(separator.join(joined))
                size += len(done[-1])
                if size >= 1 << 22 or n == len(first):
                    yield pa.RecordBatch.from_arrays([later.take(pa.array(first[begun:n])), pa.array(done, pa.string())], ["t", "text"])
                    done, size, begun = [], 0, n

        def lists(held):
            """A cell's times and values, in blocks of some millions of values."""
            i, value, k, later, code, first = read(held)
            now = np.empty(k, np.int64)
            now[i[:k]] = np.arange(k)
            step = max(1, (1 << 21) // max(1, k))
            for at in range(0, len(first), step):
                upto = first[at + step] if at + step < len(first) else len(code)
                rows = slice(first[at], upto)
                n = len(first[at : at + step])
                table = np.full((n + 1, k), -1)
                table[0] = now
                table[code[rows] - at + 1, i[k:][rows]] = k + np.arange(len(code))[rows]
                where = np.where(table >= 0, np.arange(n + 1)[:, None], 0)
                np.maximum.accumulate(where, axis=0, out=where)
                full = np.take_along_axis(table, where, 0)
                now = full[-1]
                offsets = pa.array(np.arange(n + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays([later.take(pa.array(first[at : at + step])), pa.ListArray.from_arrays(offsets, value.take(pa.array(full[1:].reshape(-1))))], ["t", "values"])

        made = texts if text else lists
        held, cell_of = [], None
        for batch in batches:
            cells_of = batch.column("block")
            code = cells_of.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1), batch.num_rows]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if begin < end:
                    c = cells_of[int(begin)].as_py()
                    if held and c != cell_of:
                        yield from made(held)
                        held = []
                    held.append(batch.slice(int(begin), int(end - begin)))
                    cell_of = c
        if held:
            yield from made(held)

    t, kind = rows.schema["t"].dataType, rows.schema["value"].dataType
    if not text:
        # By a hash of the block, not by the block: of a union that is dealt by block already Spark drops that step, and then may cut its sides apart at run time.
        rows = rows.repartition(F.xxhash64("block")).sortWithinPartitions("block", F.col("t").asc_nulls_first())
    return rows.mapInArrow(fill, T.StructType([T.StructField("t", t), T.StructField("text", T.StringType()) if text else T.StructField("values", T.ArrayType(kind))]))


def merge(points: DataFrame, operation: Callable[[Column], Column] | None = None, default=None, compact: bool = True, cell: Column | None = None) -> DataFrame:
    """(t, value) of operation(array of values), or the array itself; compact leaves out what doesn't change it."""
    rows = merged_values(points, default, cell)
    out = rows.select("t", (operation(F.col("values")) if operation else F.col("values")).alias("value"))
    return compacted(out, cell) if compact else out


def compacted(series: DataFrame, cell: Column | None = None) -> DataFrame:
    """One series (t, value) without points that repeat the value before.

    Points are compared within cells of t; the first of a cell with the last of the cell before, of which there is a
    row for each cell in one task.
    """
    rows = series.withColumn("_cell", default_cell(series) if cell is None else cell)
    last = rows.groupBy("_cell").agg(F.max_by(F.struct("value"), "t").alias("v"))
    carried = last.select("_cell", F.lag("v").over(Window.orderBy("_cell")).alias("_v"))
    before = F.coalesce(F.lag(F.struct("value")).over(Window.partitionBy("_cell").orderBy("t")), F.col("_v"))
    return rows.join(carried, "_cell").withColumn("_b", before).where(F.col("_b").isNull() | ~same(F.col("value"), F.col("_b.value"))).select(*series.columns)


def ignorant(values: Column) -> Column:
    """The values that are not null."""
    return F.filter(values, lambda x: x.isNotNull())


def ignorant_sum(values: Column) -> Column:
    return F.aggregate(ignorant(values), F.lit(0.0), lambda a, x: a + x)


def strict(reducer: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A reducer that is null where a value is."""
    return lambda values: F.when(F.exists(values, lambda x: x.isNull()), F.lit(None)).otherwise(reducer(values))


def running(deltas: DataFrame, keys: list[str], amounts: list[str], cell: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of `amounts` over t by keys, without one task for all: totals of cells of t, their running sum, then within each cell.

    The totals have a row for each cell (and key); only they go to one task. keep: more columns of deltas that stay.
    """
    rows = deltas.withColumn("_cell", cell)
    totals = rows.groupBy(*keys, "_cell").agg(*(F.sum(a).alias(f"_{a}") for a in amounts))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_cell", *(F.coalesce(F.sum(f"_{a}").over(before), F.lit(0)).alias(f"_{a}") for a in amounts))
    inside = Window.partitionBy(*keys, "_cell").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets, [*keys, "_cell"])
    return out.select(*keys, "t", *((F.sum(a).over(inside) + F.col(f"_{a}")).alias(a) for a in amounts), *keep)


def running_sum(points: DataFrame, cell: Column | None = None) -> DataFrame:
    """(t, sum, known): the sum of all series' values at each t (null: nothing) and how many are known.

    Whole numbers and decimals come from changes alone, which leave no rest. Of floating-point numbers those that hold
    are added up (`folded`): one that has ceased to hold, NaN and infinity included, has no part in later sums.
    """
    cell = default_cell(points) if cell is None else cell
    if isinstance(points.schema["value"].dataType, T.FractionalType) and not isinstance(points.schema["value"].dataType, T.DecimalType):
        return folded(points, {"sum": SUM, "known": COUNT}, cell=cell).withColumn("sum", F.coalesce("sum", F.lit(0.0)))
    tr = transitions(points)
    change = F.coalesce("value", F.lit(0)) - F.coalesce("previous", F.lit(0))
    known = F.col("value").isNotNull().cast("long") - F.col("previous").isNotNull().cast("long")
    deltas = tr.groupBy("t").agg(F.sum(change).alias("sum"), F.sum(known).alias("known"))
    return running(deltas, [], ["sum", "known"], cell)


def strict_sum(points: DataFrame, cell: Column | None = None) -> DataFrame:
    """(t, value): the sum of all series' values at each t, null where that of any series is. See `running_sum`."""
    sums = running_sum(points, cell).crossJoin(F.broadcast(number_of_series(points)))
    return sums.select("t", F.when(F.col("known") == F.col("k"), F.col("sum")).alias("value"))


def number_of_series(points: DataFrame) -> DataFrame:
    """One row (k)."""
    return points.select("series_id").distinct().agg(F.count("*").alias("k"))


def aligned(runs: DataFrame) -> DataFrame:
    """Runs of places [a, b) (longs, a > 0) cut into aligned blocks of 2 ** k places, at most two for each k: k and block in place of a and b."""
    rest = [c for c in runs.columns if c not in ("a", "b")]
    cut = runs.where("a < b").select(*rest, "a", "b", F.explode(F.expr("sequence(0, length(bin(b - a)) - 1)")).alias("k"))
    cut = cut.select(*rest, "k", F.expr("shiftright(a + shiftleft(1L, k) - 1, k)").alias("a"), F.expr("shiftright(b, k)").alias("b")).where("a < b")
    ends = F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1))
    return cut.select(*rest, "k", F.explode(F.array_compact(ends)).alias("block"))


#: An aggregate of values, and one that puts its results together: associative, and in any order.
Fold = tuple[Callable[[Column], Column], Callable[[Column], Column]]
SUM: Fold = (F.sum, F.sum)
COUNT: Fold = (F.count, F.sum)
HELD: Fold = (lambda value: F.count(F.lit(1)), F.sum)
LEAST: Fold = (F.min, F.min)
GREATEST: Fold = (F.max, F.max)
ALL: Fold = (F.bool_and, F.bool_and)
ANY: Fold = (F.bool_or, F.bool_or)


def folded(points: DataFrame, folds: dict[str, Fold], by: tuple[str, ...] = (), member: str = "series_id", default=None, cell: Column | None = None) -> DataFrame:
    """(*by, t, a column for each fold) of the values of all series at each t of any of them, from changes alone.

    Any operation that is associative and heeds no order will do, such as those above; null values are left to it.
    Each value holds for a run of places among the distinct t. The run is cut into aligned blocks of 2 ** k places, at
    most two for each k, and a block's values are folded once; a place asks the blocks that it is in, one for each k. So
    n points make n log n rows, however many series there are, and nothing is ever subtracted.

    by: series are folded for each value of these columns apart; `member` tells them from each other there. default
    holds before a series' first point (None: nothing does): a value, or a table (series_id, default). cell: an expression of t, see `running`.
    """
    keys = list(by)
    cell = default_cell(points) if cell is None else cell
    ranks = running(points.select(*keys, "t").distinct().withColumn("x", F.lit(1)), keys, ["x"], cell)
    most = F.broadcast(ranks.agg(F.max("x").alias("most")))  # one row
    until = Window.partitionBy(*keys, member).orderBy("t")
    held = points.select(*keys, "t", "value", F.lead("t").over(until).alias("until"))
    runs = held.join(ranks.withColumnRenamed("x", "a"), [*keys, "t"]).join(ranks.select(*keys, F.col("t").alias("until"), F.col("x").alias("b")), [*keys, "until"], "left").crossJoin(most)
    runs = runs.select(*keys, "value", "a", F.coalesce("b", F.col("most") + 1).alias("b"))
    if default is not None:
        if isinstance(default, DataFrame) and member != "series_id":
            raise ValueError("a table of defaults is by series_id")
        first = points.groupBy(*keys, member).agg(F.min("t").alias("t")).join(ranks, [*keys, "t"])
        first = before_first(first, default, points.schema["value"].dataType, F.lit(False), F.lit(None).cast(points.schema["value"].dataType))
        runs = runs.union(first.select(*keys, "value", F.lit(1).cast("long"), "x"))
    blocks = aligned(runs).groupBy(*keys, "k", "block").agg(*(f[0](F.col("value")).alias(name) for name, f in folds.items()))
    asked = ranks.crossJoin(most).select(*keys, "t", "x", F.explode(F.expr("sequence(0, length(bin(most)))")).alias("k")).select(*keys, "t", "k", F.expr("shiftright(x, k)").alias("block"))
    return asked.join(blocks, [*keys, "k", "block"]).groupBy(*keys, "t").agg(*(f[1](F.col(name)).alias(name) for name, f in folds.items()))


def running_max(points: DataFrame, cell: Column | None = None) -> DataFrame:
    """(t, value): the greatest value of all series at each t (null: none is known)."""
    return folded(points, {"value": GREATEST}, cell=cell)


def counts(points: DataFrame, default=None, cell: Column | None = None) -> DataFrame:
    """(value, t, n): how many series have a value, at each t where one takes or leaves it.

    default: what all series have before their first point, or a table (series_id, default), or null.
    """
    tr = transitions(points, default)
    moves = tr.select("t", F.inline(F.array(F.struct(F.col("previous").alias("value"), F.lit(-1).alias("n")), F.struct(F.col("value"), F.lit(1).alias("n")))))
    deltas = moves.groupBy("t", "value").agg(F.sum("n").alias("n"))
    start = number_of_series(points)
    out = running(deltas.where(F.col("value").isNotNull()), ["value"], ["n"], default_cell(points) if cell is None else cell)
    if default is None:
        return out.select("value", "t", "n")
    if isinstance(default, DataFrame):  # series that start with each value
        kind = points.schema["value"].dataType
        first = before_first(points.select("series_id").distinct(), default, kind, F.lit(False), F.lit(None).cast(kind)).groupBy(F.col("value").alias("_v")).agg(F.count("*").alias("_k"))
        return out.join(first, F.col("value") == F.col("_v"), "left").select("value", "t", (F.col("n") + F.coalesce("_k", F.lit(0))).alias("n"))
    return out.crossJoin(F.broadcast(start)).select("value", "t", (F.col("n") + F.when(same(F.col("value"), F.lit(default)), F.col("k")).otherwise(0)).alias("n"))
