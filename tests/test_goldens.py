"""Operators on small series with known results."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield import model
from stepfield.functions import calendar
from stepfield.operators import algebra, events, hist, merge, periods, points, resample, timeagg
from stepfield.sources import io


def series(spark, items, value="int", t="int", name="a"):
    rows = [(name, *i) for i in items]
    return spark.createDataFrame(rows, f"series_id string, t {t}, value {value}")


def pairs(df, *cols):
    cols = cols or ("t", "value")
    return [tuple(r) for r in df.select(*cols).orderBy(cols[0]).collect()]


def test_light_switch(spark):
    d = lambda h, m=0, s=0: dt.datetime(2042, 2, 1, h, m, s)
    p = series(spark, [(d(6), 0), (d(7, 45, 56), 1), (d(8, 51, 42), 0), (d(12, 3, 56), 1), (d(12, 7, 13), 0)], t="timestamp_ntz")
    got = {r.value: r.mass for r in timeagg.distribution(p, d(6), d(13), normalized=True).collect()}
    assert got[1] == pytest.approx(0.16440476190476191)


def test_lookup(spark):
    p = series(spark, [(1, 2), (2, 3), (6, 1), (8, 4)])
    probes = spark.createDataFrame([("a", x) for x in (0, 1, 5, 6, 9)], "series_id string, t int")
    assert pairs(points.lookup(p, probes)) == [(0, None), (1, 2), (5, 3), (6, 1), (9, 4)]
    assert pairs(points.lookup(p, probes, 0, "linear")) == [(0, 0.0), (1, 2.0), (5, 1.5), (6, 1.0), (9, 4.0)]
    with pytest.raises(ValueError):
        points.lookup(p, probes, interpolate="cubic")


def test_null_measurement_ends_a_value(spark):
    p = series(spark, [(-5, None), (0, 1), (3, None)])
    probes = spark.createDataFrame([("a", x) for x in (-6, -5, 1, 4)], "series_id string, t int")
    assert pairs(points.lookup(p, probes, 7)) == [(-6, 7), (-5, None), (1, 1), (4, None)]


def test_set_interval(spark):
    p = series(spark, [(1.2, 1), (3.0, 0), (6.0, 2)], t="double")
    one = points.set_interval(p, 2.0, 4.0, 5)
    assert pairs(one) == [(1.2, 1), (2.0, 5), (4.0, 0), (6.0, 2)]
    assert pairs(points.set_interval(one, 3.0, 5.0, 4)) == [(1.2, 1), (2.0, 5), (3.0, 4), (5.0, 0), (6.0, 2)]
    with pytest.raises(ValueError):
        points.set_interval(p, 4.0, 2.0, 5)


def test_remove(spark):
    p = series(spark, [(1, 1), (2, 2)])
    assert pairs(points.remove(p, 1)) == [(2, 2)]
    with pytest.raises(KeyError):
        points.remove(p, 9)


def test_slice(spark):
    p = series(spark, [(0.0, 1), (1.0, 5), (4.0, 0), (6.0, 2)], t="double")
    assert pairs(periods.cut(p, 0.5, 2.5, 1)) == [(0.5, 1), (1.0, 5), (2.5, 5)]


def test_compact_equals_step_by_step(spark):
    rnd = random.Random(3)
    items = [(i, rnd.choice([0, 1, 2])) for i in range(100)]
    want, last = [], object()
    for t, v in items:
        if v != last:
            want.append((t, v))
        last = v
    assert pairs(points.compact(series(spark, items))) == want


def test_merge(spark):
    p = series(spark, [(21, 42), (22, 41), (23, 40)], name="a").union(series(spark, [(20, 1), (22, 2), (24, 3)], name="b"))
    got = [(r.t, list(r.value)) for r in merge.merge(p).orderBy("t").collect()]
    assert got == [(20, [None, 1]), (21, [42, 1]), (22, [41, 2]), (23, [40, 2]), (24, [40, 3])]
    quick = {r.t: r["sum"] for r in merge.running_sum(p, F.floor(F.col("t") / 2)).collect()}
    assert quick == {t: sum(x or 0 for x in v) for t, v in got}


def test_strict_and_ignorant(spark):
    p = series(spark, [(-5, None), (0, 1), (10, None)], name="a").union(series(spark, [(-5, 2), (3, None), (4, 5)], name="b"))
    ignorant = dict(pairs(merge.merge(p, merge.ignorant_sum, compact=False)))
    strict = dict(pairs(merge.merge(p, merge.strict(merge.ignorant_sum), compact=False)))
    assert ignorant == {-5: 2.0, 0: 3.0, 3: 1.0, 4: 6.0, 10: 5.0}
    assert strict == {-5: None, 0: 3.0, 3: None, 4: 6.0, 10: None}


def test_merges_of_many_series_from_changes(spark):
    """Of all series, against the lists of their values: also of ids that the queries on few series leave out."""
    rnd = random.Random(8)
    rows = [(i, t, rnd.choice([None, rnd.randint(-50, 50)])) for i in range(12) for t in sorted(rnd.sample(range(60), 1 + 2 * i))]
    p = spark.createDataFrame(rows, "series_id long, t int, value long")
    lists = {r.t: list(r.value) for r in merge.merge(p, compact=False).collect()}
    assert {len(v) for v in lists.values()} == {12}
    cell = F.floor(F.col("t") / 7)
    known = {t: [x for x in v if x is not None] for t, v in lists.items()}
    assert dict(pairs(merge.running_max(p, cell))) == {t: max(v, default=None) for t, v in known.items()}
    assert dict(pairs(merge.strict_sum(p.where("series_id > 8"), cell))) == {r.t: None if None in r.value else sum(r.value) for r in merge.merge(p.where("series_id > 8"), compact=False).collect()}
    assert {r.t: r["sum"] for r in merge.running_sum(p, cell).collect()} == {t: sum(v) for t, v in known.items()}


def test_count_by_value(spark):
    rows = [("a", 1, True), ("a", 3, False), ("b", 1, True), ("b", 4, False), ("c", 2, True), ("c", 5, False)]
    p = spark.createDataFrame(rows, "series_id string, t int, value boolean")
    got = merge.counts(p, False, F.floor(F.col("t") / 2)).where("value").select("t", "n")
    assert [tuple(r) for r in got.orderBy("t").collect()] == [(1, 2), (2, 3), (3, 2), (4, 1), (5, 0)]


def test_logic(spark):
    a, b = series(spark, [(1, 0), (2, 3)]), series(spark, [(1, 5), (3, 0)])
    assert pairs(algebra.logical_and(a, b)) == [(1, 0), (2, 5), (3, 0)]
    assert pairs(algebra.logical_or(a, b)) == [(1, 5), (2, 3), (3, 3)]
    assert pairs(algebra.logical_xor(a, b)) == [(1, True), (2, False), (3, True)]
    assert pairs(algebra.to_bool(a, invert=True)) == [(1, True), (2, False)]
    assert pairs(algebra.threshold(a, 3)) == [(1, False), (2, False)]
    assert pairs(algebra.threshold(a, 3, True)) == [(1, False), (2, True)]


def test_difference(spark):
    a, b = series(spark, [(0, 0), (2, 2)]), series(spark, [(1, 1), (3, 2)])
    assert pairs(algebra.difference(a, b, x_default=0, y_default=0)) == [(0, 0), (1, -1), (2, 1), (3, 0)]
    assert pairs(algebra.add(a, 5)) == [(0, 5), (2, 7)]


def test_linear_mean(spark):
    p = series(spark, [(0, 0), (1, 0), (3, 20)])
    assert timeagg.mean(p, 0, 2, interpolate="linear").first()["mean"] == pytest.approx(2.5)


def test_n_points(spark):
    p = series(spark, [(0, 1), (1, 1), (2, 1), (5, 1), (8, 1)])
    n = lambda **k: timeagg.n_points(p, 0, 8, **k).first()["n"]
    assert [n(), n(include_end=True), n(include_start=False), n(include_start=False, include_end=True)] == [4, 5, 3, 4]
    mask = spark.createDataFrame([("a", 0, 2), ("a", 2, 8)], "series_id string, t0 int, t1 int")
    assert timeagg.n_points(p, mask=mask, include_end=True).first()["n"] == 6


def test_moving_average(spark):
    p = series(spark, [(1, 2), (2, 3), (6, 1), (8, 4)])
    got = [v for _, v in pairs(resample.moving_average(p, 1, 2, -1, 11, default=0))]
    assert got == [0, 0, 1, 2.5, 3, 3, 3, 2, 1, 2.5, 4, 4, 4]
    for bad in (dict(placement="up"), dict(window=0)):
        with pytest.raises(ValueError):
            resample.moving_average(p, 1, **bad)
    with pytest.raises(ValueError):
        resample.sample(p, 0)


def test_bins_drop_the_last(spark):
    d = lambda k: dt.datetime(2024, 1, k)
    p = series(spark, [(d(1), 1), (d(3), 2)], t="timestamp_ntz")
    got = timeagg.bins(p, "days", 1, d(1), d(5))
    assert [tuple(r) for r in got.orderBy("bin_start").select("bin_start", "value", "mass").collect()] == [(d(1), 1, 86400.0), (d(2), 1, 86400.0), (d(3), 2, 86400.0)]


def test_histogram(spark):
    h = hist.histogram(spark.createDataFrame([("a", v) for v in (1, 1, 1, 2, 3, 5, 6, 7)], "k string, v int"), "k", "v")
    qs = [0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999]
    got = [r.value for r in hist.quantiles(h, qs, 0.0).orderBy("q").collect()]
    assert got == [1, 1, 1, 1, 2.5, 5.5, 7, 7, 7]
    import numpy as np

    some = np.random.default_rng(1).integers(0, 50, 40)
    h = hist.histogram(spark.createDataFrame([("a", int(v)) for v in set(some.tolist())], "k string, v int"), "k", "v")
    want = np.quantile(sorted(set(some.tolist())), qs, method="hazen")
    assert [r.value for r in hist.quantiles(h, qs).orderBy("q").collect()] == pytest.approx(list(want))
    with pytest.raises(ValueError):
        hist.quantiles(h, [1.5])


def test_events(spark):
    e = spark.createDataFrame([("a", x) for x in (1, 1, 4, 5, 9, 6, 3, 9, 15)], "series_id string, t int")
    assert pairs(events.cumulative_sum(e)) == [(1, 2), (3, 3), (4, 4), (5, 5), (6, 6), (9, 8), (15, 9)]
    assert [events.between(e, *x).first()["n"] for x in ((1, 3), (-10, 1))] == [3, 2]
    o = spark.createDataFrame([("a", x) for x in ("06:00", "07:00")], "series_id string, t string")
    c = spark.createDataFrame([("a", x) for x in ("08:00", "09:00", "09:00")], "series_id string, t string")
    assert pairs(events.active(o, c)) == [("06:00", 1), ("07:00", 2), ("08:00", 1), ("09:00", -1)]


def test_calendar(spark):
    t = F.lit(dt.datetime(2016, 5, 6, 11, 45, 6)).cast("timestamp_ntz")
    row = spark.range(1).select(*(calendar.floor(t, u, n).alias(u) for u, n in (("months", 3), ("weeks", 3), ("hours", 10), ("minutes", 15), ("seconds", 30)))).first()
    assert list(row) == [dt.datetime(2016, 4, 1), dt.datetime(2016, 4, 18), dt.datetime(2016, 5, 6, 10), dt.datetime(2016, 5, 6, 11, 45), dt.datetime(2016, 5, 6, 11, 45)]
    assert calendar.weekday_number("Monday") == 0 and calendar.weekday_number(3) == 3
    for bad in ("someday", 7, 2.5):
        with pytest.raises(ValueError):
            calendar.weekday_number(bad)
    with pytest.raises(ValueError):
        calendar.floor(t, "fortnights")
    assert calendar.duration_to_number(dt.timedelta(minutes=1)) == 60
    with pytest.raises(ValueError):
        calendar.duration_to_number(float("inf"))
    with pytest.raises(TypeError):
        calendar.duration_to_number("x")


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("hour,value\n2000-01-01 00:00:00,1\nbad,2\n2000-01-01 00:00:10,nan\n")
    got = io.from_csv(spark, str(tmp_path / "x.csv"), value_transform=lambda c: c.cast("double"))
    assert [r.t for r in got.orderBy(F.col("t").asc_nulls_first()).collect()] == [None, dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 1, 0, 0, 10)]


def test_compact_sets(spark):
    p = spark.createDataFrame([("a", 1, 5), ("a", 3, 2), ("a", 5, 4), ("b", 3, 9)], "series_id string, t long, value long")

    def held(df, key):
        return sorted((r.t, r.value) for r in df.collect() if r.series_id == key)

    assert held(points.set_point(p, 2, 5, compact=True), "a") == [(1, 5), (3, 2), (5, 4)]
    assert held(points.set_point(p, 2, 6, compact=True), "a") == [(1, 5), (2, 6), (3, 2), (5, 4)]
    got = points.set_interval(p, 2, 6, 5, compact=True)
    assert held(got, "a") == [(1, 5), (6, 4)]
    assert held(got, "b") == [(2, 5), (6, 9)]
    assert held(points.set_interval(p, 2, 6, 9, default=9, compact=True), "b") == [(2, 9)]


def test_write_json(spark, tmp_path):
    p = spark.createDataFrame([("a", 1, 5), ("a", 3, None)], "series_id string, t long, value long")
    io.write_json(p, str(tmp_path / "j"), value_transform=lambda v: v * 2, dict_format=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"1":10,"3":null}']


def test_json(spark, tmp_path):
    listed = '[{"time": "2000-01-01T00:00:00Z", "value": 1}, {"time": "2000-01-01T00:00:10", "value": null}]'
    want = [(dt.datetime(2000, 1, 1), 1.0), (dt.datetime(2000, 1, 1, 0, 0, 10), None)]
    assert pairs(io.read_json(spark, json_string=listed)) == want
    (tmp_path / "x.json").write_text('{"2000-01-01T00:00:00": 1, "2000-01-01T00:00:10": null}')
    assert pairs(io.read_json(spark, path=str(tmp_path / "x.json"))) == want
    with pytest.raises(ValueError):
        io.read_json(spark)
    with pytest.raises(TypeError):
        io.read_json(spark, json_string="3")


def test_state_roundtrip(spark, tmp_path):
    p = series(spark, [(1, 2), (3, None)])
    io.save(p, str(tmp_path / "s"))
    assert points.equal(p, io.load(spark, str(tmp_path / "s")))
    assert "more" not in io.show(p) and "items" in io.show(series(spark, [(i, i) for i in range(25)]))


def test_truthy(spark):
    row = spark.createDataFrame([(0, "", [1], True, None)], "a int, b string, c array<int>, d boolean, e string")
    got = row.select(*(model.truthy(F.col(c), row.schema[c].dataType).alias(c) for c in row.columns)).first()
    assert list(got) == [False, False, True, True, False]


def test_streams(spark, tmp_path):
    from stepfield.streaming import periods as streams

    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", t(0), 1.0), ("a", t(5), 2.0), ("a", t(9), None), ("b", t(1), 3.0)], "series_id string, t timestamp, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.closed_periods(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("closed").orderBy("t0").collect()] == [("a", t(0), t(5), 1.0), ("a", t(5), t(9), 2.0)]

def test_means_do_not_see_what_lies_outside(spark):
    """NaN and large values elsewhere in the series have no part in a window's mean."""
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    p = spark.createDataFrame([("a", day(0), float("nan")), ("a", day(1), 2.0), ("a", day(2), 3.0), ("a", day(6), 3.0), ("b", day(0), float("inf")), ("b", day(3), 1.0), ("b", day(6), 1.0)], "series_id string, t timestamp_ntz, value double")
    one = dt.timedelta(days=1)
    for got in (resample.sample_interval(p, one, day(0), day(6)), resample.moving_average(p, one, one, day(0), day(5), "left")):
        by = {(r.series_id, r.t): r.value for r in got.collect()}
        assert [by["a", day(i)] for i in range(1, 6)] == [2.0, 3.0, 3.0, 3.0, 3.0] and np.isnan(by["a", day(0)])
        assert [by["b", day(i)] for i in range(6)] == [float("inf")] * 3 + [1.0] * 3
    late = day(9000)
    q = spark.createDataFrame([("a", day(0), 1e6), ("a", late, 1.25)], "series_id string, t timestamp_ntz, value double")
    window = dt.timedelta(milliseconds=100)
    got = resample.moving_average(q, one, window, late, late + 2 * one, "left").collect()
    assert [r.value for r in got] == [1.25] * 3


def test_window_means_by_brute_force(spark):
    rnd = random.Random(3)
    rows = [(s, t, rnd.choice([None, 1.0, 2.5, -3.0])) for s in range(4) for t in sorted(rnd.sample(range(60), 12))]
    p = spark.createDataFrame(rows, "series_id int, t int, value double")
    for window, default in ((1, None), (7, None), (40, 2.0)):
        got = {(r.series_id, r.t): r.value for r in resample.moving_average(p, 3, window, -5, 70, "right", default=default).collect()}
        for (s, t), v in got.items():
            own = {x: y for a, x, y in rows if a == s}
            held = [own[max(x for x in own if x <= u)] if min(own) <= u else default for u in range(t - window, t)]
            known = [x for x in held if x is not None]
            assert v == (pytest.approx(sum(known) / len(known)) if known else None)
        assert len(got) == 4 * 26


def test_merge_by_brute_force(spark):
    """All series at all times, over many cells, with nulls and a default."""
    rnd = random.Random(4)
    rows = [(s, t, rnd.choice([None, "x", "y"])) for s in range(7) for t in rnd.sample(range(200), 25)]
    p = spark.createDataFrame(rows, "series_id int, t int, value string").repartition(3)
    got = {r.t: list(r.value) for r in merge.merge(p, default="d", compact=False, cell=F.floor(F.col("t") / 16)).collect()}
    of = lambda s, t: max(((x, v) for a, x, v in rows if a == s and x <= t), key=lambda y: y[0], default=(0, "d"))[1]
    want = {t: [of(s, t) for s in range(7)] for t in {t for _, t, _ in rows}}
    assert got == want
    steps = [(t, want[t]) for i, t in enumerate(sorted(want)) if not i or want[t] != want[sorted(want)[i - 1]]]
    assert [(r.t, list(r.value)) for r in merge.merge(p, default="d", cell=F.floor(F.col("t") / 16)).orderBy("t").collect()] == steps


def test_masks_by_brute_force(spark):
    """Shared masks and masks of their own, long and short periods together."""
    rnd = random.Random(5)
    rows = [(s, t, float(rnd.randint(0, 3))) for s in range(3) for t in sorted(rnd.sample(range(300), 30))]
    p = spark.createDataFrame(rows, "series_id int, t int, value double")
    own = [(s, a, a + rnd.choice([1, 2, 90])) for s in range(3) for a in range(5, 290, 100)]
    shared = [(10, 12), (20, 150), (160, 161), (200, 290)]
    for mask, of in ((spark.createDataFrame(own, "series_id int, t0 int, t1 int"), lambda s: [(a, b) for x, a, b in own if x == s]), (spark.createDataFrame(shared, "t0 int, t1 int"), lambda s: shared)):
        n = {r.series_id: r.n for r in timeagg.n_points(p, mask=mask, include_end=True).collect()}
        assert n == {s: sum(a <= t <= b for x, t, _ in rows if x == s for a, b in of(s)) for s in range(3)}
        got = {(r.series_id, r.value): r.mass for r in timeagg.distribution(p, mask=mask).collect()}
        want = {}
        for s in range(3):
            first = min(a for a, _ in (own_ for x in range(3) for own_ in of(x)))
            for a, b in of(s):
                for u in range(a, b):
                    v = max(((t, v) for x, t, v in rows if x == s and t <= u), default=(0, None))[1]
                    want[s, v] = want.get((s, v), 0) + 1
        assert first >= 0 and got == want


def test_no_query_compares_all_with_all(spark):
    """No plan of a series query holds a join of two unbounded sides without an equality."""
    from stepfield.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("merge_max", "merge_ignorant_sum", "merge_strict_sum", "n_points_masked", "distribution_masked", "moving_average_center", "sample_interval_mean"):
            plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_add_all(spark):
    a, b, c = (series(spark, [(t, v) for t, v in x]) for x in ([(0, 1), (4, 2)], [(2, 10)], [(3, None), (4, 5)]))
    assert pairs(algebra.add_all([a, b, c])) == [(0, 1), (2, 11), (4, 17)]
    assert pairs(algebra.add_all([a])) == [(0, 1), (4, 2)]
    with pytest.raises(ValueError):
        algebra.add_all([])


def brute_folds(items, ids, default=None):
    """Values of all series at each t, from {id: [(t, value)]}."""
    out = {}
    for t in sorted({t for pts in items.values() for t, _ in pts}):
        held = []
        for i in ids:
            before = [v for u, v in items[i] if u <= t]
            held.append(before[-1] if before else default)
        out[t] = held
    return out


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ([(1, NAN), (2, 1.0)], [(1, 2.0)], {1: NAN, 2: 3.0}),
        ([(1, INF), (2, 1.0)], [(1, 2.0)], {1: INF, 2: 3.0}),
        ([(1, 1e16), (2, 1.0)], [(1, 2.5)], {1: 1e16 + 2.5, 2: 3.5}),
        ([(1, -INF), (2, INF), (3, None)], [(1, 2.5)], {1: -INF, 2: INF, 3: None}),
    ],
)
def test_sums_forget_what_has_ceased(spark, a, b, want):
    p = series(spark, a, "double", name="a").union(series(spark, b, "double", name="b"))
    got = {r.t: r.value for r in merge.strict_sum(p).collect()}
    assert got == pytest.approx(want, nan_ok=True)
    ignorant = {r.t: r.sum for r in merge.running_sum(p).collect()}
    assert ignorant == pytest.approx({t: 2.5 if v is None else v for t, v in want.items()}, nan_ok=True)


def test_folded_equals_brute_force(spark):
    rnd = random.Random(6)
    items = {i: [(t, rnd.choice([None, 1.5, -2.0, 7.0])) for t in sorted(rnd.sample(range(60), rnd.randint(1, 25)))] for i in "abcdefg"}
    p = spark.createDataFrame([(i, t, v) for i, pts in items.items() for t, v in pts], "series_id string, t int, value double")
    for default in (None, 3.0):
        folds = {"least": merge.LEAST, "most": merge.GREATEST, "sum": merge.SUM, "known": merge.COUNT, "bits": (lambda v: F.bit_or(v.cast("int")), F.bit_or)}
        got = {r.t: r for r in merge.folded(p, folds, default=default, cell=F.floor(F.col("t") / 7)).collect()}
        for t, held in brute_folds(items, items, default).items():
            known = [v for v in held if v is not None]
            bits = 0
            for v in known:
                bits |= int(v)
            r = got.pop(t)
            assert (r.least, r.most, r["sum"], r.known, r.bits) == (min(known, default=None), max(known, default=None), sum(known) if known else None, len(known), bits if known else None)
        assert not got


def test_stack_holds_the_value_at_each_start(spark):
    d = lambda *x: dt.datetime(2024, 1, *x)
    p = series(spark, [(d(1), 1.0), (d(2, 12), 3.0), (d(3), 5.0), (d(4), 5.0)], "double", "timestamp_ntz")
    starts = spark.createDataFrame([(d(2),), (d(3),), (dt.datetime(2023, 12, 31),)], "start timestamp_ntz")
    from stepfield.operators import recipes

    hour = 3_600_000_000
    got = sorted((r.start, r.t, r.value) for r in recipes.stacked(p, starts, 2 * 86400).collect())
    old = dt.datetime(2023, 12, 31)
    assert got == [(old, 0, None), (old, 24 * hour, 1.0), (d(2), 0, 1.0), (d(2), 12 * hour, 3.0), (d(2), 24 * hour, 5.0), (d(3), 0, 5.0)]
    assert pairs(recipes.stack(p, starts, 2 * 86400)) == [(0.0, 3.0), (43200.0, 4.0), (86400.0, 11 / 3)]


def test_cells_change_no_result(spark):
    rnd = random.Random(9)
    rows = [(s, t, rnd.choice([None, 1, 2])) for s in "ab" for t in sorted(rnd.sample(range(500), 200))] + [("c", 499, 1)]
    p = spark.createDataFrame(rows, "series_id string, t int, value int")
    cell = F.floor(F.col("t") / 37)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(points.compact(p, cell)) == rows(points.compact(p))
    assert rows(merge.transitions(p, 7, cell)) == rows(merge.transitions(p, 7))
    assert rows(periods.unbounded(p, 5, cell)) == rows(periods.unbounded(p, 5))
    for n in (1, 2, 4):
        assert rows(periods.runs(p, n, cell)) == rows(periods.runs(p, n))
    sparse = p.where("t % 90 < 20")  # cells without a point
    assert rows(periods.runs(sparse, 3, cell)) == rows(periods.runs(sparse, 3))
    for f in (algebra.difference, algebra.add, algebra.strict_add, algebra.logical_or, algebra.logical_xor):
        assert rows(f(p, sparse, cell=cell)) == rows(f(p, sparse))
    assert rows(algebra.difference(sparse, p, x_default=1, y_default=2, cell=cell)) == rows(algebra.difference(sparse, p, x_default=1, y_default=2))
    for a, b in ((None, None), (10, 400), (None, 333), (100, None)):
        assert rows(periods.periods(p, a, b, 5, cell=cell)) == rows(periods.periods(p, a, b, 5))
    probes = spark.createDataFrame([(s, x) for s in "abc" for x in range(-5, 520, 3)], "series_id string, t int")
    for how in ("previous", "linear"):
        assert rows(points.lookup(p, probes, 9, how, cell)) == rows(points.lookup(p, probes, 9, how))
    e = p.select("series_id", "t").union(p.select("series_id", "t").where("t % 3 = 0"))
    assert rows(events.cumulative_sum(e, cell)) == rows(events.cumulative_sum(e))
    assert rows(events.gaps(e, cell)) == rows(events.gaps(e))
    assert rows(events.clusters(e, 3, cell)) == rows(events.clusters(e, 3))


def test_no_task_holds_a_long_series(spark):
    """A million points of one series: every window but that over the cells' edges is over a cell."""
    p = spark.range(1_000_000).select(F.lit("a").alias("series_id"), F.col("id").alias("t"), (F.col("id") % 7).alias("value"))
    cell = F.floor(F.col("t") / 10_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (points.compact(p, cell), periods.periods(p, cell=cell), periods.runs(p, 2, cell), algebra.difference(p, p.where("t % 2 = 0"), cell=cell), events.gaps(p.select("series_id", "t"), cell), points.lookup(p, p.select("series_id", "t"), cell=cell)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            whole = [line for line in plan.splitlines() if "Window " in line and "_cell" not in line.split("windowspecdefinition")[1].split("ASC")[0]]
            over_cells = [line for line in whole if "_cell" in line]
            assert whole == over_cells  # ordered by cells, of which there are 100
            assert df.count() in (999_999, 1_000_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_masks_as_sets(spark):
    rnd = random.Random(5)
    ps = [[(s, a, a + rnd.randint(0, 9)) for s in "ab" for a in (rnd.randint(0, 80) for _ in range(12))] for _ in range(2)]
    x, y = (spark.createDataFrame(p, "series_id string, t0 int, t1 int") for p in ps)

    def cells(p):
        return {(s, i) for s, a, b in p for i in range(a, b)}

    def check(df, want):
        got = sorted(tuple(r) for r in df.collect())
        assert cells(got) == want and all(g[0] != h[0] or g[2] < h[1] for g, h in zip(got, got[1:]))  # noqa: B905

    check(timeagg.sweep(x), cells(ps[0]))
    check(timeagg.intersection(x, y), cells(ps[0]) & cells(ps[1]))
    check(timeagg.complement(x, 5, 70), {(s, i) for s in "ab" for i in range(5, 70)} - cells(ps[0]))
    check(timeagg.sweep(x.union(y)), cells(ps[0]) | cells(ps[1]))
    p = spark.createDataFrame([(s, t, t) for s in "abc" for t in range(100)], "series_id string, t int, value int")
    assert {(r.series_id, r.t) for r in resample.sample(p, 1, 0, 99, mask=x).collect()} == cells(ps[0]) & {(s, t) for s in "ab" for t in range(100)}
    assert {(r.series_id, r.t) for r in resample.sample(p, 1, 0, 99, mask=x.drop("series_id")).collect()} == {(s, t) for s in "abc" for _, t in cells(ps[0])}


def test_a_long_period_makes_a_row_for_each_part(spark):
    d = dt.datetime
    p = series(spark, [(d(2010, 1, 1, 5, 30), 1), (d(2020, 1, 1), 2)], t="timestamp_ntz")
    got = {r.hour: r.mass for r in timeagg.distribution_by(p, "hour", normalized=False).collect()}
    days = (d(2020, 1, 1) - d(2010, 1, 1)).days
    assert got == {h: 3600.0 * days - (3600.0 * min(1, max(0, 5.5 - h)) if h <= 5 else 0) for h in range(24)}
    plan = timeagg.distribution_by(p, "weekday", normalized=False, first=5, last=6)
    assert sorted(r.weekday for r in plan.collect()) == [5, 6]
    with pytest.raises(ValueError):
        timeagg.distribution_by(p, "hour", first=3, last=24)


def test_a_mask_that_is_never_true(spark):
    p = series(spark, [(1, 1), (5, 2)])
    never = spark.createDataFrame([(1, 1)], "t0 int, t1 int").where("t0 < t1")
    with pytest.raises(Exception, match="never true"):
        timeagg.mean(p, mask=never).collect()


def test_places_and_ranges(spark):
    p = spark.createDataFrame([(s, t, t * t) for s, k in (("a", 50), ("b", 3)) for t in range(k)], "series_id string, t int, value int")
    for i, j in ((None, None), (0, 5), (7, 31), (-5, None), (None, -2), (-40, -30), (10, 5), (60, 70), (-100, 2)):
        for cell in (None, F.floor(F.col("t") / 8)):
            got = sorted((r.series_id, r.t, r.n) for r in points.islice(p, i, j, cell).collect())
            assert got == [(s, t, t) for s, k in (("a", 50), ("b", 3)) for t in range(k)[slice(i, j)]]
    for low in (True, False):
        for high in (True, False):
            want = [t for t in range(50) if (t >= 5 if low else t > 5) and (t <= 9 if high else t < 9)]
            assert sorted(r.t for r in points.irange(p, 5, 9, (low, high)).where("series_id = 'a'").collect()) == want
            assert sorted(r.t for r in points.remove_interval(p, 5, 9, (low, high)).where("series_id = 'a'").collect()) == [t for t in range(50) if t not in want]
    assert points.irange(p, None, 4).count() == 8


def test_equal_series(spark):
    p = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, 2.0), (None, 1, 0.0)], "series_id string, t int, value double")
    q = spark.createDataFrame([("a", 2, None), ("a", 1, 1.0), ("b", 1, 3.0), (None, 1, -0.0), ("c", 1, 1.0)], "series_id string, t int, value double")
    assert {r.series_id: r.equal for r in points.equal_series(p, q).collect()} == {"a": True, "b": False, None: True, "c": False}
    assert points.equal(p, p) and not points.equal(p, q) and not points.equal(p, p.union(p.limit(1)))


def test_merged_values_of_a_null_id(spark):
    p = spark.createDataFrame([(None, 1, 5), ("a", 2, 6), (None, 3, None)], "series_id string, t int, value int")
    assert pairs(merge.merged_values(p), "t", "values") == [(1, [5, None]), (2, [5, 6]), (3, [None, 6])]


def test_a_default_for_each_series(spark):
    p = spark.createDataFrame([("a", 2, 5), ("a", 4, None), ("b", 3, 6), ("c", 3, 1), (None, 4, 2)], "series_id string, t int, value int")
    d = spark.createDataFrame([("a", 10), ("b", 20), (None, 40), ("x", 99)], "series_id string, default int")
    probes = spark.createDataFrame([(s, t) for s in ("a", "b", "c", None) for t in (1, 3)], "series_id string, t int")
    for cell in (None, F.col("t")):
        assert {(r.series_id, r.t): r.value for r in points.lookup(p, probes, d, cell=cell).collect()} == {("a", 1): 10, ("a", 3): 5, ("b", 1): 20, ("b", 3): 6, ("c", 1): None, ("c", 3): 1, (None, 1): 40, (None, 3): 40}
    got = {r.t: (r.s, r.n) for r in merge.folded(p, {"s": merge.SUM, "n": merge.COUNT}, default=d).collect()}
    assert got == {2: (5 + 20 + 40, 3), 3: (5 + 6 + 1 + 40, 4), 4: (6 + 1 + 2, 3)}
    assert sorted((r.series_id or "", r.t0, r.t1, r.value) for r in periods.periods(p, 0, 3, d).collect()) == [("", 0, 3, 40), ("a", 0, 2, 10), ("a", 2, 3, 5), ("b", 0, 3, 20), ("c", 0, 3, None)]
    assert sorted((r.t, r.series_id or "", r.previous) for r in merge.transitions(p, d).collect()) == [(2, "a", 10), (3, "b", 20), (3, "c", None), (4, "", 40), (4, "a", 5)]
    assert {(r.value, r.t): r.n for r in merge.counts(p, d).collect()}[(40, 4)] == 0


def test_json_array_of_a_long_series(spark, tmp_path):
    import json

    d = dt.datetime(2024, 1, 1)
    rows = [("a", d + dt.timedelta(seconds=i), None if i % 10 == 3 else i / 4) for i in range(5000)] + [("b", d, 1.5)]
    p = spark.createDataFrame(rows, "series_id string, t timestamp_ntz, value double")
    path = str(tmp_path / "series")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # would put so few rows into one task
    try:
        io.write_json_array(p, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = sorted((tmp_path / "series" / "series_id=a").glob("part-*.txt"))
    assert len(files) > 1  # of several tasks
    whole = json.loads("".join(f.read_text() for f in files))
    assert [x["value"] for x in whole] == [v for s, _, v in rows if s == "a"]
    assert sorted(map(str, io.read_json_array(spark, path).collect())) == sorted(map(str, p.collect()))


def test_written_times_and_defaults(spark, tmp_path):
    p = series(spark, [(1, 5), (2, None)])
    j = io.to_json(p, time_transform=lambda t: F.concat(F.lit("day "), t.cast("string"))).first().json
    assert j == '[{"time":"day 1","value":5},{"time":"day 2","value":null}]'
    io.save(p, str(tmp_path), spark.createDataFrame([("a", 7)], "series_id string, default int"))
    probes = spark.createDataFrame([("a", 0), ("a", 1)], "series_id string, t int")
    assert pairs(points.lookup(io.load(spark, str(tmp_path)), probes, io.load_defaults(spark, str(tmp_path)))) == [(0, 7), (1, 5)]
    assert io.show(p, 1, default=7) == "<Series>\n{1: 5,\n and 1 more items}\ndefault: 7"


def test_default_of_booleans():
    assert [algebra.bool_default(x) for x in (None, 0, 3, "")] == [None, False, True, False]
    assert [algebra.bool_default(x, invert=True) for x in (None, 0, 3)] == [None, True, False]
    assert algebra.bool_default(5, True, given="as it is") == "as it is" and algebra.bool_default(5, given=None) is None


def test_quantiles_by_cells(spark):
    rng = random.Random(7)
    near = [1 + i * 2.0**-52 for i in range(40)]
    odd = [0.0, 5e-324, -1e-310, 1e308, -1e308, float("inf"), float("-inf"), float("nan"), 2.0**40, 2.0**40 * (1 - 2.0**-53)]
    of = {"few": [3.0], "near": near, "odd": odd, "many": [rng.gauss(0, 1000) for _ in range(3000)], "whole": [float(i) for i in range(-20, 20)], None: [rng.uniform(100, 100.001) for _ in range(500)]}
    h = spark.createDataFrame([(k, v, float(rng.choice([1, 2, 5]))) for k, vs in of.items() for v in vs], "series_id string, value double, mass double")
    h = h.union(spark.createDataFrame([("none", 1.0, 0.0), ("null", None, 3.0)], h.schema))
    qs = [0, 0.05, 0.3, 0.5, 0.95, 1]
    for alpha, smallest in ((0.5, None), (0.0, None), (0.5, 0.5), (1.0, None)):
        want = sorted(map(str, hist.quantiles(h, qs, alpha, smallest).collect()))
        assert sorted(map(str, hist.quantiles(h, qs, alpha, smallest, by_cells=True).collect())) == want and len(want) == 6 * len(of)
    assert hist.quantiles(h.limit(0), qs, by_cells=True).count() == 0
    with pytest.raises(ValueError):
        hist.quantiles(h, qs, 1.5, by_cells=True)
    values = sorted(odd[:-3] + near + of["many"])
    cells = [r.c for r in spark.createDataFrame([(v,) for v in values if v == v], "v double").select("v", hist.value_cell(F.col("v")).alias("c")).orderBy("v").collect()]
    assert cells == sorted(cells)


def test_merged_lists_as_changes(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(merge, "BLOCK", 8)
    rows = sorted({(s, rng.randrange(200)) for s in ("a", "b", "c", "d", None) for _ in range(rng.choice([1, 10, 60]))}, key=str)
    p = spark.createDataFrame([(s, t, rng.choice([None, 1, 2, 3])) for s, t in rows], "series_id string, t int, value int")
    held, want = {(s,): 9 if s == "a" else None for s in (None, "a", "b", "c", "d")}, {}
    points_at = {}
    for r in p.collect():
        points_at.setdefault(r.t, {})[(r.series_id,)] = r.value
    for t in sorted(points_at):
        held.update(points_at[t])
        want[t] = list(held.values())
    default = spark.createDataFrame([("a", 9)], "series_id string, default int")
    path = str(tmp_path / "changes")
    merge.merged_changes(p, default, F.floor(F.col("t") / 16)).write.parquet(path)
    kept = spark.read.parquet(path)
    assert kept.where("t is not null").count() == len(want) and kept.select("block").distinct().count() > 3
    assert kept.where("t is null").agg(F.sum(F.size("values"))).first()[0] <= len(rows) + 8  # whole lists: in proportion to points
    assert {r.t: r["values"] for r in merge.expanded(kept).collect()} == want
    assert {r.t: r["values"] for r in merge.expanded(kept, 50, 120).collect()} == {t: v for t, v in want.items() if 50 <= t <= 120}
    assert merge.expanded(merge.merged_changes(p.limit(0))).count() == 0 and merge.expanded(kept, 500).count() == 0


def test_merged_changes_of_many_series_expanded_at_once(spark):
    """Not kept in between: then the sides of the union are dealt by block already, and their partitions are put together at run time."""
    k = 1000
    p = spark.range(24 * k).select((F.col("id") % k).alias("series_id"), F.col("id").alias("t"), F.col("id").alias("value"))
    put = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {name: spark.conf.get(name, None) for name in put}
    try:
        for name, x in put.items():
            spark.conf.set(name, x)
        rows = merge.expanded(merge.merged_changes(p), 5000, 20000)
        right = F.col("values") == F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda s: F.col("t") - (F.col("t") - s) % k)
        assert tuple(rows.agg(F.count("*"), F.count_if(right), F.min("t"), F.max("t")).first()) == (15001, 15001, 5000, 20000)
    finally:
        for name, x in before.items():
            spark.conf.unset(name) if x is None else spark.conf.set(name, x)


def test_linear_lookup_reads_no_frame_again_for_each_row(spark):
    """Neighbours ahead over several cells, by a plan without frames up to the last row, which take the square of a cell's points."""
    rng = random.Random(5)
    rows = sorted(rng.sample(range(1000), 150))
    p = series(spark, [(t, rng.choice([None, 1, 4, 9])) for t in rows])
    probes = spark.createDataFrame([("a", x) for x in range(-3, 1003)], "series_id string, t int")
    held = dict(pairs(p))

    def want(x):
        left, right = [t for t in rows if t <= x], [t for t in rows if t > x]
        if not left or not right or left[-1] == x:
            v = held[left[-1]] if left else -1
            return v if v is None else float(v)
        a, b = held[left[-1]], held[right[0]]
        return None if a is None or b is None else pytest.approx(a + (x - left[-1]) / (right[0] - left[-1]) * (b - a))

    for cell in (None, F.floor(F.col("t") / 16)):
        got = points.lookup(p, probes, -1, "linear", cell)
        assert pairs(got) == [(x, want(x)) for x in range(-3, 1003)]
        assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()


def test_merged_texts(spark, monkeypatch):
    """Joined lists are those of merged_values: several blocks, more series than are joined together, null ids and values, several series at one t."""
    monkeypatch.setattr(merge, "BLOCK", 8)
    rng = random.Random(11)
    rows = [(s, t, rng.choice([None, 1.0, 2.5, -3.0])) for s in [None, *range(600)] for t in sorted(rng.sample(range(900), 3))]
    p = spark.createDataFrame(rows, "series_id int, t int, value double")
    for default in (None, 5):
        want = {r.t: ";".join("-" if x is None else str(x) for x in r["values"]) for r in merge.merged_values(p, default).collect()}
        got = merge.merged_texts(p, ";", "-", default, F.floor(F.col("t") / 16)).collect()
        assert len(got) == len(want) and {r.t: r.text for r in got} == want
    few = spark.createDataFrame([("a", 2, "x"), ("b", 1, "y"), ("c", 2, "")], "series_id string, t int, value string")
    d = spark.createDataFrame([("a", "d"), ("b", "e")], "series_id string, default string")
    assert pairs(merge.merged_texts(few, default=d), "t", "text") == [(1, "d,y,null"), (2, "x,y,")]
    assert merge.merged_texts(few.limit(0)).count() == 0


def test_merge_list_shuffles_in_proportion_to_points(spark, tmp_path, monkeypatch):
    """Many days with a point or two and many series: no row is exchanged for each day and series."""
    from stepfield.plans import registry

    monkeypatch.setattr(merge, "BLOCK", 256)
    series_n, days = 300, 1200
    rows = [(n % series_n, dt.datetime(2020, 1, 1) + dt.timedelta(days=n, seconds=n), "click", float(n % 97)) for n in range(days)]
    spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.t: r.l for r in registry.QUERIES["merge_list"](spark, str(tmp_path)).collect()}
    now, want = ["null"] * series_n, {}
    for who, t, _, value in rows:
        now[who] = str(value)
        want[t] = ",".join(now)
    assert got == want
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    nodes, totals = store.planGraph(run).allNodes(), store.executionMetrics(run)
    metrics = [m for n in range(nodes.size()) for x in [nodes.apply(n).metrics()] for m in (x.apply(k) for k in range(x.size()))]
    sent = {m.accumulatorId(): totals.get(m.accumulatorId()) for m in metrics if m.name() == "shuffle records written"}
    sent = [int(x.get().replace(",", "")) for x in sent.values() if x.isDefined()]
    assert sent and sum(sent) < 30 * days


def test_merged_texts_of_a_range(spark, monkeypatch):
    """What holds when the range begins, series that begin after it, cells larger and smaller than a block, crowded times, defaults."""
    monkeypatch.setattr(merge, "BLOCK", 16)
    rng = random.Random(7)
    rows = [(s, t, rng.choice([None, 1, 2])) for s in [None, *range(20)] for t in rng.sample([*range(0, 300, 25), *range(100, 120), 700], 12)]
    p = spark.createDataFrame([*rows, (99, 650, 5)], "series_id int, t int, value int")
    d = spark.createDataFrame([(3, 9), (99, 8), (None, 7)], "series_id int, default int")
    held = {s: {99: 8, 3: 9, None: 7}.get(s) for s in [None, *range(20), 99]}
    points_at, want = {}, {}
    for s, t, value in [*rows, (99, 650, 5)]:
        points_at.setdefault(t, {})[s] = value
    for t in sorted(points_at):
        held.update(points_at[t])
        want[t] = ",".join("null" if x is None else str(x) for x in held.values())
    for cell in (None, F.floor(F.col("t") / 10), F.floor(F.col("t") / 200)):
        for start, end in ((None, None), (101, 250), (None, 110), (275, None), (120, 120), (800, None)):
            got = merge.merged_texts(p, default=d, cell=cell, start=start, end=end).collect()
            right = {t: x for t, x in want.items() if (start is None or t >= start) and (end is None or t <= end)}
            assert len(got) == len(right) and {r.t: r.text for r in got} == right


@pytest.mark.parametrize("ids, kind", [([-0.0, 1.5], "double"), ([(1, "a"), (2, None)], "struct<a int, b string>"), (["", "b"], "string")])
def test_merged_texts_by_kind_of_id(spark, ids, kind):
    p = spark.createDataFrame([(ids[0], 1, 5), (ids[1], 2, 6), (ids[0], 3, 7)], f"series_id {kind}, t int, value int")
    assert pairs(merge.merged_texts(p), "t", "text") == [(1, "5,null"), (2, "5,6"), (3, "7,6")]
    assert pairs(merge.merged_texts(p, start=2), "t", "text") == [(2, "5,6"), (3, "7,6")]


def rows_exchanged(spark):
    """Rows that the last query has shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsList().last().executionId()
    nodes, totals = store.planGraph(run).allNodes(), store.executionMetrics(run)
    metrics = [m for n in range(nodes.size()) for x in [nodes.apply(n).metrics()] for m in (x.apply(k) for k in range(x.size()))]
    sent = {m.accumulatorId(): totals.get(m.accumulatorId()) for m in metrics if m.name() == "shuffle records written"}
    return sum(int(x.get().replace(",", "")) for x in sent.values() if x.isDefined())


def many_events(spark, path, n=12000, users=300):
    rows = [(k * 7919 % users, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=5 * k), "click", float(k % 97)) for k in range(n)]
    spark.createDataFrame(rows, "user_id int, ts timestamp_ntz, event_type string, value double").write.parquet(f"{path}/events.parquet")


def test_merge_list_between_exchanges_points_of_its_range_only(spark, tmp_path, monkeypatch):
    from stepfield.plans import registry

    monkeypatch.setattr(merge, "BLOCK", 256)
    many_events(spark, tmp_path)
    assert len(registry.QUERIES["merge_list_between"](spark, str(tmp_path)).collect()) == 4000
    assert 0 < rows_exchanged(spark) < 24000  # points twice


def test_merge_list_exchanges_points_once(spark, tmp_path, monkeypatch):
    """Besides them what series hold at the end and the beginning of blocks, and a row for each series or cell and task."""
    from stepfield.plans import registry

    monkeypatch.setattr(merge, "BLOCK", 256)
    many_events(spark, tmp_path)
    assert len(registry.QUERIES["merge_list"](spark, str(tmp_path)).collect()) == 12000
    assert 0 < rows_exchanged(spark) < 48000  # four times the points
