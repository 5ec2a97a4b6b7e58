"""Exact medians by digits, and roll-ups that merge."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tankline.operators import quantiles, rollups
from tankline.schemas import FUEL


def medians(spark, rows):
    df = spark.createDataFrame(rows, "k string, x double")
    return {r.k: r.m for r in quantiles.exact_median(df, ["k"], "x", "m").collect()}


def test_exact_median(spark):
    rnd = random.Random(3)
    groups = {
        "odd": [rnd.uniform(-1e6, 1e6) for _ in range(101)], "even": [rnd.gauss(0, 1) for _ in range(500)], "one": [5e-324], "equal": [2.5] * 40,
        "near": [1.0 + k * 2**-52 for k in range(9)], "signs": [-0.0, 0.0, -1.5, 1.5], "far": [1e308, -1e308, 1e-308, math.inf, -math.inf], None: [3.0, 4.0],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("none", None), ("even", None)]
    want = {k: statistics.median(xs) for k, xs in groups.items()} | {"none": None}
    got = medians(spark, rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k] or math.isclose(got[k], want[k], rel_tol=1e-15), k
    assert medians(spark, []) == {}


def test_many_distinct_values_of_one_key(spark):
    df = spark.range(0, 400_000, 1, 8).select(F.lit("v").alias("k"), F.expr("rand(5) * 1000 - 500").alias("x"))
    want = df.agg(F.percentile("x", 0.5)).first()[0]
    assert math.isclose(quantiles.exact_median(df, ["k"], "x").first()["median"], want, rel_tol=1e-12)


def points(spark):
    rows = spark.range(0, 60_000).select(
        F.lit("o").alias("organization"), (F.col("id") % 3).cast("string").alias("auto"),
        (F.expr("timestamp_ntz'2024-01-30 22:00:00'") + F.make_dt_interval(secs=F.col("id") * 5)).alias("timestamp"), F.expr("floor(rand(7) * 1000)").alias(FUEL),
    )
    return rows.withColumn(FUEL, F.when(F.rand(1) < 0.9, F.col(FUEL)).cast("double"))


def test_roll_ups_merge(spark, tmp_path):
    path = str(tmp_path / "hours")
    rows = points(spark).cache()
    rollups.hourly(rows).write.parquet(path)
    hours = spark.read.parquet(path)
    months = rollups.merged(rollups.merged(hours, "day"), "month", ("organization",)).withColumn("m", rollups.quantile(0.5))
    assert "points" not in months._jdf.queryExecution().executedPlan().toString()
    found = {str(r.start)[:7]: r for r in months.collect()}
    assert set(found) == {"2024-01", "2024-02"}
    for month, r in found.items():
        own = [x[0] for x in rows.filter(F.substring(F.col("timestamp").cast("string"), 1, 7) == month).filter(F.col(FUEL).isNotNull()).select(FUEL).collect()]
        assert (r.n, r.total, r.least, r.greatest) == (len(own), sum(own), min(own), max(own))
        below, upto = sum(x < r.m for x in own) / len(own), sum(x <= r.m for x in own) / len(own)
        assert below <= 0.5 + rollups.RANK_ERROR and upto >= 0.5 - rollups.RANK_ERROR


def test_small_groups_are_exact(spark):
    rows = points(spark).filter("auto = '1'").limit(301)
    one = rollups.merged(rollups.hourly(rows), "month").withColumn("m", rollups.quantile(0.5)).collect()
    assert sum(r.n for r in one) == rows.filter(F.col(FUEL).isNotNull()).count()
    with pytest.raises(ValueError):
        rollups.merged(rollups.hourly(rows), "week")
