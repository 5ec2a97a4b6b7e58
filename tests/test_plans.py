"""What the physical plans must look like to hold at scale."""

import os
import re
import subprocess

import pytest
from data import READING, fleet, norm_rows, random_rows
from pyspark.sql import functions as F

from tankline import Params
from tankline.operators import clean, leaks, metrics, reports

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SLOT = Params(layout="slot")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return text.count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "r")
    spark.createDataFrame(random_rows(500), READING).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def dims(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("d")
    fleet(spark, [("v1", "a", 0.0, "o")]).write.parquet(f"{base}/cars")
    norm_rows(spark, [("n", "v1", 1.0, 1.0, None)]).write.parquet(f"{base}/norms")
    return spark.read.parquet(f"{base}/cars"), spark.read.parquet(f"{base}/norms")


def test_cascade_has_one_exchange_and_one_sort(spark, stored):
    text = plan(clean.preprocess(clean.normalise(spark.read.parquet(stored)), SLOT))
    assert exchanges(text) == 1 and text.count("Sort [") == 1
    assert "hashpartitioning(auto#" in text and "_slot#" in text.split("hashpartitioning(")[1].split(")")[0]


def test_range_filter_reaches_the_scan(spark, stored):
    df = spark.read.parquet(stored).withColumn("unused", F.lit(1))
    text = df.transform(clean.normalise).transform(clean.fuel_range)._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(calc_sensors_fuel_level,0.0)" in pushed and "LessThanOrEqual" in pushed


def test_a_filter_on_the_vehicle_reaches_the_scan(spark, stored):
    series = clean.preprocess(clean.normalise(spark.read.parquet(stored)), SLOT)
    text = series.filter("auto = 'v1'")._jdf.queryExecution().toString()
    assert "EqualTo(auto,v1)" in text


def test_windows_of_detection_come_before_the_norms(spark, stored, dims):
    found = leaks.leak_pipeline(spark.read.parquet(stored), *dims, SLOT)
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    windows = [k for k, line in enumerate(lines) if "Window" in line]
    norms = next(k for k, line in enumerate(lines) if "Join Inner" in line and "sl_avto" in line)
    assert windows and min(windows) > norms  # below the join
    assert "partial_percentile" in plan(found)  # statistics combine map-side


def test_small_tables_are_broadcast_by_size_only(spark, stored, dims):
    """No hint: with the size limits off all joins become sort-merge joins."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        text = plan(leaks.leak_pipeline(spark.read.parquet(stored), *dims, SLOT))
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_reports_are_summed_before_the_join(spark):
    rows = spark.createDataFrame([], "id string, car string, datetime timestamp_ntz, volume int, status boolean")
    cars = fleet(spark, [("v1", "a", 0.0, "o")])
    for fn in (reports.daily_leaks, reports.car_leaks):
        text = plan(fn(rows, cars, "o"))
        assert re.search(r"Join.*\n(?:.*\n)*?.*HashAggregate", text)


def test_windowed_metrics_group_before_unpivoting(spark):
    df = spark.createDataFrame([], "organization string, auto string, timestamp timestamp_ntz, pos_s double, calc_sensors_fuel_level double, spent_fuel double")
    text = plan(metrics.car_metrics(df, None, None, every="1d"))
    assert text.index("Generate") < text.index("HashAggregate")


def test_no_driver_side_or_row_by_row_work_in_the_library():
    found = subprocess.run(
        ["grep", "-rnE", r"\.collect\(\)|toPandas|\.rdd|localCheckpoint|F\.udf|pandas_udf|F\.broadcast|crossJoin", os.path.join(ROOT, "tankline"), "--include=*.py"],
        capture_output=True, text=True,
    ).stdout.splitlines()
    # the text operators have their own rules: what they send or broadcast is bounded where they say so
    assert [x for x in found if "/tankline/llm/" not in x] == []


def test_drains_read_the_readings_once(spark, stored, dims):
    """Without statistics of the vehicle nothing is joined back."""
    found = leaks.leak_pipeline(spark.read.parquet(stored), *dims, SLOT, sigma=False)
    text = plan(reports.leak_reports(found, "u"))
    assert len(re.findall(r"FileScan parquet \[[^\]]*calc_sensors_fuel_level", text)) == 1 and text.count("Window ") <= 3


def test_statistics_take_one_join_back(spark, stored, dims):
    with_, without = (plan(leaks.leak_pipeline(spark.read.parquet(stored), *dims, SLOT, sigma=s)) for s in (True, False))
    joins = lambda text: len(re.findall(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) \[", text))
    # the statistics read the series once more, up to the join with vehicles and norms, and meet it in one join
    assert joins(with_) <= 2 * joins(without) + 1


def test_norms_of_other_tenants_are_left_out_first(spark, stored, dims):
    text = plan(leaks.leak_pipeline(spark.read.parquet(stored), *dims, SLOT, org="o"))
    assert "LeftSemi" in text
