from datetime import date, datetime

import pytest
from data import fleet
from pyspark.sql import functions as F

from tankline.functions.bins import add_bin, add_window_end, parse_every
from tankline.functions.values import car_label, mask_tail, matches, need, require_columns, split_terms
from tankline.operators import metrics as m
from tankline.operators import reference as ref
from tankline.operators import reports as rep
from tankline.operators import uploads as up
from tankline.operators import upsert as ups


def one(df):
    (row,) = df.collect()
    return row


def test_window_lengths():
    assert parse_every("30m") == (0, 1_800_000_000)
    assert parse_every("1h30m") == (0, 5_400_000_000)
    assert parse_every("1mo") == (1, 0) and parse_every("1y2mo") == (14, 0)
    for bad in ("", "30", "m", "1x", "-1h", "1h)", "1mo1d", "0s", "1h |> drop()", None):
        with pytest.raises(ValueError):
            parse_every(bad)


def test_window_ends(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-06-15 13:17:05' AS timestamp")
    ends = {e: one(add_window_end(df, "e", e)).e for e in ("30m", "1w", "1mo", "1y", "5mo")}
    assert ends["30m"] == datetime(2024, 6, 15, 13, 30)
    assert ends["1w"] == datetime(2024, 6, 20)  # weeks run from Thursday, like the epoch
    assert ends["1mo"] == datetime(2024, 7, 1) and ends["1y"] == datetime(2025, 1, 1)
    assert ends["5mo"] == datetime(2024, 8, 1)  # 655 months after the epoch
    early = spark.sql("SELECT timestamp_ntz'1969-12-31 23:59:59' AS timestamp")
    assert one(add_bin(early, "b", 3600)).b == datetime(1969, 12, 31, 23)


def test_text_helpers(spark):
    df = spark.createDataFrame([(None, "X5", "V1", "A1", "abcd1234")], "ma string, mo string, vin string, pl string, t string")
    row = one(df.select(car_label("ma", "mo", "vin", "pl").alias("n"), mask_tail(F.col("t")).alias("m"), mask_tail(F.col("ma")).alias("d")))
    assert (row.n, row.m, row.d) == (" X5 V1A1", "****1234", "Не указан")
    assert split_terms("a, b  'c d' \"e,f\"") == ["a", "b", "c d", "e,f"]
    hit = df.select(matches([F.col("mo"), F.col("ma")], "x 5").alias("yes"), matches([F.col("mo"), F.col("ma")], "x 6").alias("no"))
    assert tuple(one(hit)) == (True, False)
    assert require_columns(df, ["t", "zz", "mo", "aa"]) == ["zz", "aa"]
    with pytest.raises(ValueError, match="zz, aa"):
        need(df, ["zz", "aa"])


NORM = "sl_avto string, vid_norm_rasx string, period string, norma_rasx double, deystvuet_do string, seq long"


def test_norm_file(spark):
    rows = [
        ("1", ref.SUMMER, "p", 5.0, "2024-01-01", 1),
        ("1", ref.SUMMER, None, None, "2024-02-01", 2),
        ("2", ref.WINTER, "p", 7.0, "2024-03-01", 3),
        ("3", "other", "p", 1.0, "x", 4),
        ("4", ref.SUMMER, "p", None, None, 5),
        ("4", ref.WINTER, "p", 9.0, "2024-04-01", 6),
        (None, ref.WINTER, "p", 9.0, "2024-04-01", 7),
    ]
    df = spark.createDataFrame(rows, NORM)
    last = {(r.sl_avto, r.vid_norm_rasx): tuple(r)[2:] for r in ref.last_norms(df).collect()}
    assert last["1", ref.SUMMER] == ("p", 5.0, "2024-02-01")
    got = {r.auto: tuple(r)[1:] for r in ref.parse_norms(df).collect()}
    assert got == {"1": (-1.0, 5.0, "2024-02-01"), "2": (7.0, -1.0, "2024-03-01"), "4": (9.0, None, None)}
    assert {r.auto for r in ref.usable_norms(ref.parse_norms(df)).collect()} == {"1", "2"}
    assert {r.auto: r.winter_norm for r in ref.parse_norms(df, swap_seasons=True).collect()}["1"] == 5.0


def test_cars_upsert_by_file_order(spark):
    old = fleet(spark, [("1", "Old", 1.0, "o1"), ("2", "Stays", 0.0, "o2")]).select("id", "name", "description", "engine_type", "organization")
    rows = [("1", " New ", None, 0.0, 1), ("3", "First", "a", 1.0, 2), ("3", "Last", " b ", 0.0, 3), (None, "x", "x", 0.0, 4)]
    new = spark.createDataFrame(rows, "guid string, name string, description string, engine_type double, seq long")
    got = {r.id: tuple(r)[1:] for r in ups.upsert_cars(old, new, "o9").collect()}
    assert got == {"1": ("New", "", 1.0, "o1"), "2": ("Stays", "", 0.0, "o2"), "3": ("Last", "b", 1.0, "o9")}


def test_norms_load(spark):
    cars = fleet(spark, [("1", "a", 0.0, "o1"), ("2", "b", 0.0, "o2")])
    rows = [("1", None, 2.0, "2024-05-01 10:00:00"), ("2", 1.0, 1.0, "x"), ("9", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "car string, winter_norm double, summer_norm double, due string")
    good, bad = ups.load_norms(df, cars, "o1")
    assert [tuple(r) for r in good.collect()] == [("1", -1.0, 2.0, date(2024, 5, 1))]
    assert {r.car for r in bad.collect()} == {"2", "9"}


def test_latest_wins_and_update(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (1, 2, "c"), (2, 1, "d")], "k int, v int, x string")
    assert {tuple(r) for r in ups.latest_wins(df, ["k"], ["v"]).collect()} == {(1, 3, None), (2, 1, "d")}
    same = ups.upsert(ups.upsert(df, df, ["k"], ["v"]), df, ["k"], ["v"])
    assert {tuple(r) for r in same.collect()} == {(1, 3, None), (2, 1, "d")}
    got = ups.update_where(df, F.col("x") == "a", v=9).collect()
    assert sorted(r.v for r in got) == [1, 2, 3, 9]


REPORT = "id string, car string, datetime timestamp_ntz, volume int, status boolean"


def _reports(spark):
    at = lambda *a: datetime(2024, 1, *a)
    rows = [
        ("1", "a", at(1), 5, True),
        ("2", "a", at(2), 6, True),
        ("3", "b", at(2, 0, 0, 1), 7, True),
        ("4", "b", at(2), 8, False),
        ("5", "c", at(2), 9, True),
    ]
    return spark.createDataFrame(rows, REPORT), fleet(spark, [("a", "Zed", 0.0, "o"), ("b", "Amy", 0.0, "o"), ("c", "Cab", 0.0, "p")])


def test_report_questions(spark):
    reports, cars = _reports(spark)
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(rep.daily_leaks(reports, cars, "o")) == [("2024-01-01", 1), ("2024-01-02", 2)]
    assert rows(rep.daily_leaks(reports, cars, "o", measure="sum")) == [("2024-01-01", 5), ("2024-01-02", 13)]
    # the end date is its first instant
    assert rows(rep.daily_leaks(reports, cars, "o", "2024-01-02", date(2024, 1, 2))) == [("2024-01-02", 1)]
    assert rows(rep.car_leaks(reports, cars, "o")) == [("b", "Amy", 1.0), ("a", "Zed", 2.0)]
    assert rows(rep.car_leaks(reports, cars, "o", measure="sum")) == [("b", "Amy", 7.0), ("a", "Zed", 11.0)]
    assert rep.daily_leaks(reports, cars).count() == 3
    for bad in (dict(measure="max"), dict(frm="soon"), dict(due=5)):
        with pytest.raises(ValueError):
            rep.daily_leaks(reports, cars, "o", **bad)


POINT = "organization string, auto string, timestamp timestamp_ntz, pos_s double, calc_sensors_fuel_level double, spent_fuel double"


def test_metric_questions(spark):
    at = lambda *a: datetime(2024, 1, *a)
    rows = [
        ("o", "a", at(2, 23, 59, 58), 10.0, 100.0, 0.0),
        ("o", "a", at(2, 23, 59, 59), 20.0, 200.0, 0.0),
        ("o", "a", at(1, 13, 17, 5), 30.0, 300.0, 0.0),
        ("o", "b", at(1, 13, 17, 5), 40.0, 400.0, 0.0),
        ("p", "a", at(1, 13, 17, 5), 50.0, 500.0, 0.0),
    ]
    df = spark.createDataFrame(rows, POINT)
    ask = lambda **k: [tuple(r) for r in m.car_metrics(df, "o", "a", **k).collect()]
    assert ask(metric="speed", due="2024-01-02", now=datetime(2024, 6, 1)) == [
        ("2024-01-01 13:17:05", 30.0, "speed"), ("2024-01-02 23:59:58", 10.0, "speed"),
    ]
    assert ask(metric="fuel_level", frm="2024-01-01", due="2024-01-01", every="30m") == [("2024-01-01 13:30:00", 300.0, "fuel_level")]
    # the last label is cut to the end of the range
    assert ask(metric="speed", frm="2024-01-02", due="2024-01-02", every="1d", fn="sum") == [("2024-01-02 23:59:59", 10.0, "speed")]
    assert ask(metric="speed", frm="2024-01-01", every="1mo", fn="median", now=datetime(2024, 3, 1)) == [("2024-02-01 00:00:00", 20.0, "speed")]
    assert ask(metric="speed", every="1d", now=datetime(2024, 1, 2, 12)) == [("2024-01-02 00:00:00", 30.0, "speed")]
    assert ask(metric="speed", now=datetime(2034, 1, 2)) == [("2024-01-02 23:59:58", 10.0, "speed"), ("2024-01-02 23:59:59", 20.0, "speed")]
    assert len(ask(now=datetime(2024, 6, 1))) == 6
    assert m.car_metrics(df, None, None, now=datetime(2024, 6, 1)).columns == ["organization", "auto", "x", "y", "metric"]
    for bad in (dict(metric="rpm"), dict(fn="max"), dict(every="1h)"), dict(frm=datetime(2024, 1, 1)), dict(due="x")):
        with pytest.raises(ValueError):
            ask(**bad)


UPLOAD = "id string, organization string, status string, filename string, size int, type string, file_hash string"


def test_uploads(spark):
    rows = [
        ("1", "o", "completed", "a.csv", 1, "auto", "h1"),
        ("2", "o", "created", "b.csv", 1, "raw", "h2"),
        ("3", "o", "created", "c.csv", 1, "raw", "h3"),
        ("4", "o", "completed", "n.csv", 1, "norm", "h4"),
        ("5", "p", "created", "b.csv", 1, "raw", "h5"),
        ("6", "p", "completed", "a.csv", 1, "auto", "h6"),
        ("7", "o", "error", "e.csv", 1, "raw", "h7"),
    ]
    df = spark.createDataFrame(rows, UPLOAD)
    assert [r.id for r in up.pending_uploads(df).collect()] == ["3"]
    assert {r.organization for r in up.has_completed(df, "auto").collect()} == {"o", "p"}
    again = df.drop("status").withColumn("id", F.concat(F.lit("n"), "id"))
    taken = up.register_uploads(again, df, "o")
    assert {r.id for r in taken.collect()} == {"n2", "n3", "n5", "n7"} and {r.status for r in taken.collect()} == {"created"}
    moved = {r.id: r.status for r in up.advance(df, F.lit(True), "completed").collect()}
    assert moved["2"] == "completed" and moved["7"] == "error"
    with pytest.raises(ValueError):
        up.advance(df, F.lit(True), "created")
    odd = [("1", "raw", "x.CSV"), ("2", "norm", "x.csv"), ("3", "auto", "x.pdf"), ("4", "auto", "noext"), ("5", None, "x.csv"), ("6", "auto", "t.xlsx")]
    good, bad = up.split_by_type(spark.createDataFrame(odd, "id string, type string, filename string"))
    assert {r.id for r in good.collect()} == {"1", "6"} and bad.count() == 4
    kind = good.select("id", up.media_type(F.col("filename")).alias("m"))
    assert {r.id: r.m.split("/")[0] for r in kind.collect()} == {"1": "text", "6": "application"}
