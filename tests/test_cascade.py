import random
from datetime import datetime

import pytest
from data import COLS, READING, SERIES, brute, random_rows, readings, rounded, series_rows
from pyspark.sql import functions as F

from tankline import Params
from tankline.operators import clean
from tankline.operators.layout import settle

GOLDEN = [
    ("v1", "2024-06-15T10:00:00", 200.0, 60.0, 27.0),
    ("v1", "2024-06-15T10:00:05", 198.0, 60.0, 27.0),
    ("v1", "2024-06-15T10:00:30", 197.0, 30.0, 22.0),
    ("v1", "2024-06-15T10:05:00", 190.0, 40.0, 26.0),
    ("v1", "2024-06-15T10:05:20", 5000.0, 40.0, 27.0),
    ("v1", "2024-06-15T10:40:00", 180.0, 0.0, 27.0),
    ("v1", "2024-06-15T10:40:20", 183.0, 0.0, 27.0),
    ("v1", "2024-06-15T10:45:00", 186.0, 0.0, 27.0),
]
EXPECTED = [
    ("v1", datetime(2024, 6, 15, 10, 0), 50.0, -10.0, 199.0, 275.0, 3.819444, -261.818182),
    ("v1", datetime(2024, 6, 15, 10, 30), 0.0, -7.0, 186.0, 2400.0, 0.0, None),
]
LAYOUTS = [Params(layout="slot"), Params(layout="slice")]


@pytest.mark.parametrize("p", LAYOUTS, ids=lambda p: p.layout)
def test_golden(spark, p):
    got = series_rows(clean.preprocess(clean.normalise(readings(spark, GOLDEN)), p))
    assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got] == EXPECTED


@pytest.mark.parametrize("zone", ["UTC", "Europe/Moscow", "America/New_York"])
def test_session_zone_and_clock_change_do_not_matter(spark, zone):
    # 2011-03-27 02:00 does not exist in Moscow, 2024-03-10 02:00 not in New York
    rows = [(c, t.replace("2024-06-15T10", f"{day}T02"), f, s, v) for day in ("2011-03-27", "2024-03-10") for c, t, f, s, v in GOLDEN]
    want = [
        (c, t.replace(year=d.year, month=d.month, day=d.day, hour=2), *rest)
        for d in (datetime(2011, 3, 27), datetime(2024, 3, 10))
        for c, t, *rest in EXPECTED
    ]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for p in LAYOUTS:
            got = series_rows(clean.preprocess(clean.normalise(readings(spark, rows)), p))
            assert [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in got] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("p", LAYOUTS, ids=lambda p: p.layout)
@pytest.mark.parametrize("hot", [0.0, 0.6])
def test_against_brute_force(spark, p, hot):
    rows = random_rows(3000, hot=hot)
    df = clean.normalise(spark.createDataFrame(rows, READING))
    assert series_rows(clean.preprocess(df, p)) == rounded(brute(rows))


@pytest.mark.parametrize("layout", ["slot", "slice"])
def test_short_widths_and_odd_widths(spark, layout):
    rows = random_rows(1500, cars=2, seed=3)
    df = clean.normalise(spark.createDataFrame(rows, READING))
    short = clean.preprocess_short(df, Params.short(layout=layout))
    assert {"dtime_s", "dtime_per_hour", "travel"}.isdisjoint(short.columns)
    want = [r[:5] for r in brute(rows, pre=120, period=600)]
    assert rounded(tuple(r) for r in short.select(*SERIES[:5]).collect()) == rounded(want)
    odd = Params(sensor_s=20, pre_s=100, period_s=700, gap_s=1100, diff_s=500, layout=layout)
    want = brute(rows, sensor=20, pre=100, period=700, gap=1100, diff=500)
    assert series_rows(clean.preprocess(df, odd)) == rounded(want)


def test_row_order_of_the_input_does_not_matter(spark):
    rows = random_rows(1200, seed=11)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    a, b = (clean.preprocess(clean.normalise(spark.createDataFrame(x, READING).repartition(n))) for x, n in ((rows, 1), (mixed, 5)))
    assert series_rows(a) == series_rows(b)


def test_vehicles_alone_equal_vehicles_together(spark):
    rows = random_rows(1200, cars=3, seed=5)
    together = series_rows(clean.preprocess(clean.normalise(spark.createDataFrame(rows, READING))))
    alone = []
    for car in ("v0", "v1", "v2"):
        mine = spark.createDataFrame([r for r in rows if r[0] == car], READING)
        alone += series_rows(clean.preprocess(clean.normalise(mine)))
    assert together == rounded(alone)


def test_steps_agree_between_layouts(spark):
    df = clean.fuel_range(clean.normalise(spark.createDataFrame(random_rows(2000, hot=0.5, seed=9), READING)))
    for step, column in ((clean.time_gap, "dtime_s"), (clean.fuel_diff, "spent_fuel")):
        a, b = (rounded(tuple(r) for r in step(df, p).select("seq", column).collect()) for p in LAYOUTS)
        assert a == b
    assert set(clean.time_gap(df).columns) == {*COLS, "dtime_s", "dtime_per_hour"}


def test_gaps_are_not_recomputed_after_the_voltage_filter(spark):
    df = clean.voltage_filter(clean.time_gap(clean.fuel_range(clean.normalise(readings(spark, GOLDEN)))))
    gaps = [r.dtime_s for r in df.orderBy("timestamp").collect()]
    assert gaps == [None, 5.0, 270.0, 2100.0, 20.0, 280.0]


def test_edges(spark):
    empty = clean.preprocess(clean.normalise(readings(spark, [])))
    assert empty.count() == 0 and set(SERIES) < set(empty.columns)
    one = series_rows(clean.preprocess(clean.normalise(readings(spark, GOLDEN[:1]))))
    assert one == [("v1", datetime(2024, 6, 15, 10, 0), 60.0, 0.0, 200.0, 0.0, 0.0, None)]
    blank = [("v1", "2024-06-15T10:00:00", None, 60.0, 27.0), ("v2", "2024-06-15T10:00:00", 100.0, 60.0, None)]
    assert clean.preprocess(clean.normalise(readings(spark, blank))).count() == 0
    nan = [("v1", "2024-06-15T10:00:00", float("nan"), 1.0, 27.0), ("v1", "2024-06-15T10:00:01", 5.0, float("nan"), 27.0)]
    assert series_rows(clean.preprocess(clean.normalise(readings(spark, nan))))[0][2:5] == (None, 0.0, 5.0)
    lost = readings(spark, GOLDEN).withColumn("auto", F.lit(None).cast("string"))
    assert clean.preprocess(clean.normalise(lost)).count() == 0
    ends = [("v1", "2024-06-15T10:00:00", 0.0, 1.0, 27.0), ("v1", "2024-06-15T10:00:01", 4096.0, 1.0, 27.0)]
    assert clean.fuel_range(clean.normalise(readings(spark, ends))).count() == 2


def test_text_times_are_parsed_and_bad_ones_dropped(spark):
    rows = [("v1", t, 10.0, 1.0, 27.0) for t in ("2024-06-15 10:00:00", "2024-06-15T10:00:01", "soon", None)]
    df = spark.createDataFrame(rows, "auto string, timestamp string, calc_sensors_fuel_level double, pos_s double, calc_sensors_voltage double")
    assert sorted(r.timestamp.second for r in clean.normalise(df).collect()) == [0, 1]
    with pytest.raises(ValueError, match="pos_s"):
        clean.normalise(df.drop("pos_s"))


def test_layout_and_widths(spark):
    assert settle(Params()).layout == "slot"
    with pytest.raises(ValueError):
        settle(Params(layout="slice", pre_s=15))


def test_scope_keeps_uploads_apart(spark):
    rows = random_rows(900, cars=2, seed=2)
    df = spark.createDataFrame(rows, READING).withColumn("upload_id", (F.col("seq") % 2).cast("string"))
    for layout in ("slot", "slice"):
        p = Params(scope=("upload_id",), layout=layout)
        both = clean.preprocess(clean.normalise(df, p), p)
        for u in ("0", "1"):
            mine = [r for r in rows if str(r[5] % 2) == u]
            assert series_rows(both.filter(F.col("upload_id") == u)) == rounded(brute(mine))
