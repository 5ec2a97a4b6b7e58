"""One key holding far more than its share: results stay whole and work stays spread."""

from collections import Counter
from datetime import datetime, timedelta

from data import READING, brute, random_rows, rounded, series_rows
from pyspark.sql import functions as F

from tankline import Params
from tankline.functions.bins import add_bin
from tankline.operators import clean, entities, leaks, reports, upsert


def test_hot_vehicle_is_cut_into_slots_or_slices(spark):
    rows = random_rows(6000, cars=20, hot=0.6, span_s=12 * 3600)
    df = clean.normalise(spark.createDataFrame(rows, READING))
    for layout, cell, width in (("slot", "_slot", 7200), ("slice", "_sensor", 10)):
        p = Params(layout=layout)
        assert series_rows(clean.preprocess(df, p)) == rounded(brute(rows))
        biggest = add_bin(df, cell, width).groupBy("auto", cell).count().agg(F.max("count")).first()[0]
        assert biggest < (1200 if layout == "slot" else 30)


def test_many_copies_of_one_key_shrink_before_the_exchange(spark):
    df = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v")
    )
    best = upsert.latest_wins(df, ["k"], ["v"])
    assert best.filter("k = 'hot'").first().v == 99_999 and best.count() == df.select("k").distinct().count()
    text = best._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in text


def test_hot_vehicle_in_reports_and_norms(spark):
    base = datetime(2024, 1, 1)
    rows = [(str(i), "hot" if i % 3 else f"c{i % 7}", base + timedelta(days=i % 5), i % 11, i % 4 > 0) for i in range(3000)]
    rep = spark.createDataFrame(rows, "id string, car string, datetime timestamp_ntz, volume int, status boolean")
    cars = spark.createDataFrame([(c, c, "o") for c in ["hot", *[f"c{i}" for i in range(6)]]], "id string, name string, organization string")
    known = {"hot", *[f"c{i}" for i in range(6)]}
    want = Counter()
    for _, car, at, volume, ok in rows:
        if ok and car in known:
            want[at.strftime("%Y-%m-%d")] += volume
    assert {r.day: r.value for r in reports.daily_leaks(rep, cars, "o", measure="sum").collect()} == dict(want)
    norms = rep.select(F.col("car").alias("sl_avto"), F.lit(1.0).alias("norma_rasx_winter"), F.lit(1.0).alias("norma_rasx_summer"),
                       F.col("datetime").cast("date").alias("period"), F.col("id").alias("norm_id"))
    last = leaks.latest_norm(norms)
    assert last.count() == norms.select("sl_avto").distinct().count()
    assert "partial_max_by" in last._jdf.queryExecution().executedPlan().toString()


def test_busy_driver_is_cut_before_ranking(spark):
    drivers = spark.createDataFrame([("d", "x"), ("e", "y")], "id string, fullname string")
    driver = F.when(F.col("id") < 20_000, "d").otherwise("f")
    links = spark.range(20_001).select(driver.alias("driver"), F.col("id").cast("string").alias("car"))
    cars = spark.range(20_001).select(F.col("id").cast("string").alias("id"), F.format_string("n%05d", "id").alias("name"))
    out = entities.car_list(drivers, links, cars)
    assert {r.id: r.cars for r in out.collect()} == {"d": "n00000, n00001, n00002...", "e": ""}
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2
