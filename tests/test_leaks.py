import statistics
from datetime import datetime

import pytest
from data import fleet, norm_rows, readings, rounded
from pyspark.sql import functions as F
from test_cascade import GOLDEN

from tankline import Params
from tankline.operators import leaks
from tankline.operators.reports import leak_reports
from tankline.operators.upsert import missing_cars

CARS = [("v1", "Truck", 0.0, "o1")]
NORM = [("n1", "v1", 12.0, 10.0, None)]


def test_golden(spark):
    found = leaks.leak_pipeline(readings(spark, GOLDEN), fleet(spark, CARS), norm_rows(spark, NORM))
    a, b = found.orderBy("timestamp").collect()
    assert (a.spent_fuel, b.spent_fuel) == (10.0, 7.0)
    assert a.norma_rasx_per_travel == pytest.approx(0.2210326646)
    assert (a.leak, b.leak) == (pytest.approx(9.7789673354), pytest.approx(6.805))
    assert (a.is_leak, b.is_leak) == (True, False)
    assert (a.delta_sp, b.delta_sp) == (pytest.approx(9.7789673354), 7.0)
    assert a.delta_sp_median == b.delta_sp_median == pytest.approx(8.3894836677)
    assert a.delta_sp_std == pytest.approx(1.9650266476)
    assert (a.is_leak_delta_sp, b.is_leak_delta_sp) == (False, False)
    assert (a.max_fuel_diff, a.max_fuel_diff_back, b.max_fuel_diff, b.max_fuel_diff_back) == (-13.0, None, 0.0, -13.0)
    assert (a.is_max_fuel_diff_2, a.is_max_fuel_diff, b.is_max_fuel_diff_2) == (True, False, False)
    report = leak_reports(found, "u1").collect()
    assert [(r.car, r.datetime, r.volume, r.status) for r in report] == [("v1", datetime(2024, 6, 15, 10), 9, True)]
    assert leak_reports(found, "u1").collect()[0].id == report[0].id
    assert missing_cars(found, fleet(spark, CARS), "o1").count() == 0
    assert [r.name for r in missing_cars(found, fleet(spark, []), "o1").collect()] == ["Truck"]


CASES = [
    # travel, speed, spent, engine, month, summer, winter, leak, is_leak
    ("driving", 30.0, 60.0, -15.0, 0.0, 6, 10.0, 12.0, 12.0, True),
    ("january", 30.0, 60.0, -15.0, 0.0, 1, 10.0, 12.0, 11.4, True),
    ("march", 30.0, 60.0, -15.0, 0.0, 3, 10.0, 12.0, 12.0, True),
    ("october", 30.0, 60.0, -15.0, 0.0, 10, 10.0, 12.0, 12.0, True),
    ("november", 30.0, 60.0, -15.0, 0.0, 11, 10.0, 12.0, 11.4, True),
    ("refuel", 30.0, 60.0, 30.0, 0.0, 6, 10.0, 12.0, 0.0, False),
    ("idle 0", 0.0, 0.0, -0.5, 0.0, 6, 10.0, 12.0, 0.305, False),
    ("idle 1", 0.0, 0.0, -0.5, 1.0, 6, 10.0, 12.0, 1 / 3, False),
    ("idle 1 low", 0.0, 0.0, -0.18, 1.0, 6, 10.0, 12.0, 0.18, False),
    ("idle 2", 0.0, 0.0, -12.0, 2.0, 6, 10.0, 12.0, 12.0, True),
    ("no engine", 0.0, 0.0, -12.0, None, 6, 10.0, 12.0, 12.0, True),
    ("at limit", 30.0, 60.0, -12.0, 0.0, 6, 10.0, 12.0, 9.0, False),
    ("no speed", None, None, -15.0, 0.0, 6, 10.0, 12.0, 0.0, False),
    ("no norm", 30.0, 60.0, -15.0, 0.0, 6, -1.0, -1.0, 15.3, True),
    ("null norm", 30.0, 60.0, -15.0, 0.0, 6, None, None, 0.0, False),
]


def _series(spark, cases):
    rows = [
        (c[0], datetime(2024, c[5], 10, 12), c[2], c[3], 100.0, c[1], c[0], c[4]) for c in cases
    ]
    return spark.createDataFrame(
        rows,
        "auto string, timestamp timestamp_ntz, pos_s double, spent_fuel double, max_fuel double, travel double, id string, sl_tip_dvigat double",
    )


def test_branches(spark):
    norms = leaks.norm_columns(norm_rows(spark, [(c[0], c[0], c[7], c[6], None) for c in CASES]))
    found = {r.auto: r for r in leaks.detect_leaks(_series(spark, CASES), norms).collect()}
    for name, *_, leak, flag in CASES:
        assert (found[name].leak, found[name].is_leak) == (pytest.approx(leak), flag), name
        assert found[name].leak >= 0
    plain = leaks.detect_leaks(_series(spark, CASES), norms, sigma=False, drop_null_engine=True)
    assert {"delta_sp", "is_leak_delta_sp"}.isdisjoint(plain.columns)
    assert {r.auto for r in plain.collect()} == {c[0] for c in CASES} - {"no engine"}


def test_several_norms_fan_out_or_the_last_counts(spark):
    norms = norm_rows(
        spark,
        [("a", "driving", 12.0, 10.0, "2024-01-01"), ("b", "driving", 9.0, 8.0, None), ("c", "driving", 1.0, 1.0, "2023-01-01")],
    )
    norms = leaks.norm_columns(norms)
    rows = leaks.detect_leaks(_series(spark, CASES[:1]), norms).orderBy("leak").collect()
    assert [round(r.leak, 6) for r in rows] == [12.0, 12.6, 14.7]
    (row,) = leaks.detect_leaks(_series(spark, CASES[:1]), norms, policy="latest").collect()
    assert (row.norm_id, round(row.leak, 6)) == ("b", 12.6)
    with pytest.raises(ValueError):
        leaks.attach_norms(_series(spark, CASES), norms, "first")


def test_many_norms(spark):
    """No window runs after the norms have multiplied the rows; statistics and steps are right."""
    norms = leaks.norm_columns(
        norm_rows(spark, [(f"n{i}", "driving", 10.0 + i % 3, 8.0 + i % 5, [None, "2024-01-01", "2023-05-05"][i % 3]) for i in range(40)])
    )
    rows = [("driving", datetime(2024, 6, 1 + h // 20, h % 20), 60.0, -10.0 - h, 300.0 - h, 30.0, "driving", 0.0) for h in range(45)]
    series = spark.createDataFrame(rows, _series(spark, []).schema)
    b = leaks.detect_leaks(series, norms, Params())
    got = b.collect()
    assert len(got) == 45 * 40
    delta = [r.delta_sp for r in got]
    assert {round(r.delta_sp_median, 9) for r in got} == {round(statistics.median(delta), 9)}
    assert {round(r.delta_sp_std, 9) for r in got} == {round(statistics.stdev(delta), 9)}
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    windows = [k for k, line in enumerate(plan.split("\n")) if "Window" in line]
    norm_join = next(k for k, line in enumerate(plan.split("\n")) if "Join Inner" in line and "sl_avto" in line)
    assert windows and min(windows) > norm_join  # below the join in the tree
    # brute force: neighbours of the fanned-out rows in order of time, period (open last) and id
    rank = {r.norm_id: (r.period is None, r.period, r.norm_id) for r in norms.collect()}
    rank = sorted(rank, key=lambda n: (rank[n][0], str(rank[n][1]), n))
    full = [(t, lvl, n) for _, t, _, _, lvl, *_ in rows for n in rank]
    ahead = {}
    for i, (t, lvl, n) in enumerate(full):
        nxt = full[i + 1] if i + 1 < len(full) and full[i + 1][0].date() == t.date() else None
        prv = full[i - 1] if i and full[i - 1][0].date() == t.date() else None
        ahead[t, n] = (nxt[1] - lvl if nxt else 0.0, lvl - prv[1] if prv else None)
    assert {(r.timestamp, r.norm_id): (r.max_fuel_diff, r.max_fuel_diff_back) for r in b.collect()} == ahead


def test_vehicle_without_norm_or_unknown_vehicle_gives_no_row(spark):
    telemetry = readings(spark, GOLDEN + [("v2", *GOLDEN[0][1:]), ("v3", *GOLDEN[0][1:])])
    cars = fleet(spark, CARS + [("v2", "No norm", 0.0, "o1")])
    norms = norm_rows(spark, NORM + [("n3", "v3", 1.0, 1.0, None)])
    assert {r.auto for r in leaks.leak_pipeline(telemetry, cars, norms).collect()} == {"v1"}
    assert leaks.leak_pipeline(telemetry, cars, norms, org="o2").count() == 0
    assert leaks.org_norms(norms, cars, "o1").count() == 1


def test_outlier_needs_three_deviations(spark):
    rows = [("car", datetime(2024, 6, 1 + i), 60.0, -3.0, 100.0, 30.0, "car", 0.0) for i in range(20)]
    rows.append(("car", datetime(2024, 6, 25), 60.0, -40.0, 100.0, 30.0, "car", 0.0))
    series = spark.createDataFrame(rows, _series(spark, []).schema)
    norms = leaks.norm_columns(norm_rows(spark, [("n", "car", 10.0, 10.0, None)]))
    found = leaks.detect_leaks(series, norms)
    assert [r.timestamp.day for r in found.filter("is_leak_delta_sp").collect()] == [25]


def test_idle_rates_are_parameters(spark):
    norms = leaks.norm_columns(norm_rows(spark, [("n", "idle 2", 10.0, 10.0, None)]))
    p = Params(idle_rate={2: 2.0})
    (row,) = leaks.detect_leaks(_series(spark, [c for c in CASES if c[0] == "idle 2"]), norms, p).collect()
    assert row.leak == 10.0


def test_tank_steps_stay_inside_a_day(spark):
    rows = [
        ("c", datetime(2024, 6, 1, h), 60.0, -20.0, level, 1.0, "c", 0.0)
        for h, level in ((1, 100.0), (2, 80.0), (3, 50.0))
    ] + [("c", datetime(2024, 6, 2, 1), 60.0, -20.0, 10.0, 1.0, "c", 0.0)]
    norms = leaks.norm_columns(norm_rows(spark, [("n", "c", 10.0, 10.0, None)]))
    got = leaks.detect_leaks(spark.createDataFrame(rows, _series(spark, []).schema), norms).orderBy("timestamp").collect()
    assert [r.max_fuel_diff for r in got] == [-20.0, -30.0, 0.0, 0.0]
    assert [r.max_fuel_diff_back for r in got] == [None, -20.0, -30.0, None]
    assert [r.is_max_fuel_diff for r in got] == [False, True, False, False]
    assert [r.is_max_fuel_diff_2 for r in got] == [True, True, False, False]
    step = leaks.tank_steps(leaks.leak_volume(leaks.season_norm(leaks.attach_norms(spark.createDataFrame(rows, _series(spark, []).schema), norms))))
    assert not [c for c in step.columns if c[0] == "_"] and step.filter(F.col("max_fuel_diff") < 0).count() == 2
