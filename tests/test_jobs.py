import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from data import READING, brute, fleet, norm_rows, random_rows, rounded, series_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline import Params
from tankline.operators.clean import preprocess
from tankline.operators.leaks import leak_pipeline
from tankline.operators.reports import leak_reports
from tankline.plans.jobs import load_fleet, run_pending, run_upload
from tankline.schemas import FUEL, SPEED, TELEMETRY, VOLTAGE
from tankline.sources import sinks
from tankline.streaming.bins import LateRows, as_instant, as_wall_clock, stream_bins
from tankline.operators.uploads import folded
from tankline.plans import jobs
from tankline.streaming import cascade
from tankline.streaming.cascade import SlotKeeper, read_cascade, stream_cascade
from tankline.streaming.intake import stream_uploads

P = Params(leak_limit=1.0)


@pytest.fixture(scope="module")
def tables(spark):
    cars = fleet(spark, [(f"v{i}", f"Car {i}", float(i % 2), "o1") for i in range(3)])
    norms = norm_rows(spark, [(f"n{i}", f"v{i}", 12.0, 10.0, None) for i in range(3)])
    return {"car": cars, "car_consumption": norms}


def _frame(spark, seed):
    return spark.createDataFrame(random_rows(800, cars=4, seed=seed), READING)


def _rows(df):
    return sorted(tuple(r) for r in df.select("upload_id", "car", "datetime", "volume", "id").collect())


def _expected(spark, tables, seed, upload):
    found = leak_pipeline(_frame(spark, seed), tables["car"], tables["car_consumption"], P)
    return _rows(leak_reports(found, upload))


def test_an_upload_twice_is_an_upload_once(spark, tables, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        paths = run_upload(spark, _frame(spark, 1), tables, out, P, org="o1", upload_id="u1", load_seq=1)
    want = _expected(spark, tables, 1, "u1")
    assert want and _rows(sinks.read_reports(spark, paths["reports"])) == want
    points = sinks.read_metrics(spark, paths["metrics"])
    series = brute(random_rows(800, cars=4, seed=1))
    got = points.select("auto", "timestamp", SPEED, "spent_fuel", FUEL)
    # points of the vehicle nobody knows are stored as well
    assert rounded(tuple(r) for r in got.collect()) == rounded((r[0], r[1], r[2] or 0.0, r[3], r[4]) for r in series)
    assert {r.organization for r in points.select("organization").distinct().collect()} == {"o1"}
    # a rerun without readings clears what the upload had stored
    run_upload(spark, _frame(spark, 1).filter("false"), tables, out, P, org="o1", upload_id="u1", load_seq=1)
    assert _rows(sinks.read_reports(spark, paths["reports"])) == [] and sinks.read_metrics(spark, paths["metrics"]).count() == 0


def test_a_later_upload_overwrites_points(spark, tables, tmp_path):
    out = str(tmp_path / "store")
    for n, (name, seed) in enumerate((("u9", 1), ("u10", 2))):
        paths = run_upload(spark, _frame(spark, seed), tables, out, P, org="o1", upload_id=name, load_seq=n)
    got = sinks.read_metrics(spark, paths["metrics"])
    newest = {(r[0], r[1]): r[4] for seed in (1, 2) for r in brute(random_rows(800, cars=4, seed=seed))}
    assert {(r.auto, r.timestamp): r[FUEL] for r in got.collect()} == newest
    sinks.compact_metrics(spark, paths["metrics"], str(tmp_path / "compact"))
    again = sinks.read_metrics(spark, str(tmp_path / "compact"))
    assert sorted(again.collect()) == sorted(got.collect())
    one = sinks.read_metrics(spark, paths["metrics"], org="o1", car="v1")
    assert sorted(one.collect()) == sorted(r for r in got.collect() if r.auto == "v1")


def test_append_mode_and_missing_upload_id(spark, tables, tmp_path):
    for _ in range(2):
        paths = run_upload(spark, _frame(spark, 1), tables, str(tmp_path), P, org="o1", upload_id="u1", load_seq=1, mode="append")
    assert sinks.read_reports(spark, paths["reports"]).count() == 2 * len(_expected(spark, tables, 1, "u1"))
    with pytest.raises(ValueError, match="upload_id"):
        run_upload(spark, _frame(spark, 1), tables, str(tmp_path), P, load_seq=1)
    with pytest.raises(ValueError, match="load_seq"):
        run_upload(spark, _frame(spark, 1), tables, str(tmp_path), P, upload_id="u1")


def _csv(spark, seed, path):
    df = _frame(spark, seed).withColumn("timestamp", F.col("timestamp").cast("string"))
    df.select(*TELEMETRY.names).toPandas().to_csv(path, index=False)


def test_stream_of_files_equals_one_run_per_file(spark, tables, tmp_path):
    src, out, state = (tmp_path / x for x in ("in", "out", "state"))
    src.mkdir()

    def take_in():
        stream_uploads(spark, str(src), tables, str(out), str(state), P, max_files=2).awaitTermination()
        return _rows(sinks.read_reports(spark, f"{out}/reports"))

    for n in (1, 2, 3):
        _csv(spark, n, src / f"f{n}.csv")
    want = [r for n in (1, 2, 3) for r in _expected(spark, tables, n, f"f{n}.csv")]
    assert take_in() == sorted(want)
    assert take_in() == sorted(want)  # nothing new
    _csv(spark, 4, src / "f4.csv")
    assert take_in() == sorted(want + _expected(spark, tables, 4, "f4.csv"))


def test_stream_bins_and_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    schema = T.StructType([f for f in spark.createDataFrame([], READING).schema if f.name != "seq"])

    def put(n, *rows):
        df = spark.createDataFrame([("v1", *r) for r in rows], "auto string, t string, calc_sensors_fuel_level double, pos_s double")
        df = df.select("auto", F.col("t").cast("timestamp_ntz").alias("timestamp"), FUEL, SPEED, F.lit(27.0).alias("calc_sensors_voltage"))
        df.coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(src))
        query = (
            stream_bins(stream, Params(), "10 minutes").writeStream.format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return query

    put(1, ("2024-06-15 10:00:00", 200.0, 60.0), ("2024-06-15 10:00:05", 198.0, 40.0), ("2024-06-15 10:05:00", 190.0, 0.0), ("2024-06-15 11:00:00", 100.0, 10.0))
    run()
    read = lambda: [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert [(r[0], str(r[1]), r[2], r[3]) for r in read()] == [("v1", "2024-06-15 10:00:00", 25.0, 199.0)]
    put(2, ("2024-06-15 10:01:00", 4000.0, 0.0), ("2024-06-15 11:01:00", 110.0, 10.0))
    counter = LateRows()
    spark.streams.addListener(counter)
    query = run()
    for _ in range(50):
        if counter.dropped.get(str(query.id), 0):
            break
        time.sleep(0.2)
    spark.streams.removeListener(counter)
    assert counter.dropped[str(query.id)] >= 1
    assert len(read()) == 1


def test_wall_clock_survives_the_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Moscow")
    try:
        df = spark.sql("SELECT explode(array(timestamp_ntz'2011-03-27 02:30:00.123456', timestamp_ntz'1969-01-01 00:00:00.000001')) AS t")
        back = df.select("t", as_wall_clock(as_instant(F.col("t"))).alias("b")).collect()
        assert all(r.t == r.b for r in back)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_fleet_file(spark, tables):
    rows = [("v0", "New name", "d", 5.0, None, "2024-12-31", 1.0, 1), ("x1", "Added", None, 3.0, 4.0, "soon", 1.0, 2)]
    fleet_rows = spark.createDataFrame(rows, "guid string, name string, description string, winter_norm double, summer_norm double, due string, engine_type double, seq long")
    loaded, rejected = load_fleet(fleet_rows, tables, "o1", "f1")
    cars = {r.id: (r.name, r.engine_type, r.organization) for r in loaded["car"].collect()}
    assert cars["v0"] == ("New name", 0.0, "o1") and cars["x1"] == ("Added", 1.0, "o1") and len(cars) == 4
    norms = [(r.car, r.winter_volume, r.summer_volume, str(r.valid_period)) for r in loaded["car_consumption"].collect() if len(r.id) > 5]
    assert sorted(norms) == [("v0", 5.0, -1.0, "2024-12-31")]
    assert [r.car for r in rejected.collect()] == ["x1"]
    again, _ = load_fleet(fleet_rows, loaded, "o1", "f1")
    assert again["car_consumption"].count() == loaded["car_consumption"].count()
    other, _ = load_fleet(fleet_rows, loaded, "o1", "f2")
    assert other["car_consumption"].count() == loaded["car_consumption"].count() + 1
    _, foreign = load_fleet(fleet_rows, tables, "o2", "f1")
    assert sorted(r.car for r in foreign.collect()) == ["v0", "x1"]


def test_pending_uploads_run_as_one_job_and_stay_with_their_tenant(spark, tables, tmp_path):
    cars = tables["car"].withColumn("organization", F.when(F.col("id") == "v2", "o2").otherwise("o1"))
    kinds = [("a1", "o1", "completed", "auto"), ("n1", "o1", "completed", "norm"), ("r1", "o1", "created", "raw"), ("r2", "o1", "created", "raw"),
             ("a2", "o2", "completed", "auto"), ("n2", "o2", "completed", "norm"), ("r3", "o2", "created", "raw"), ("r4", "o3", "created", "raw")]
    uploads = spark.createDataFrame(kinds, "id string, organization string, status string, type string")
    readings = None
    for n, u in ((1, "r1"), (2, "r2"), (3, "r3"), (4, "r4")):
        part = _frame(spark, n).withColumn("upload_id", F.lit(u))
        readings = part if readings is None else readings.unionByName(part)
    mine = {**tables, "car": cars}
    after = run_pending(spark, uploads, readings, mine, str(tmp_path), P, load_seq=1)
    assert {r.id: r.status for r in after.collect() if r.id[0] == "r"} == {"r1": "created", "r2": "completed", "r3": "completed", "r4": "created"}
    want = []
    for seed, u, org in ((2, "r2", "o1"), (3, "r3", "o2")):
        found = leak_pipeline(_frame(spark, seed), cars, tables["car_consumption"], P, org=org)
        want += _rows(leak_reports(found, u))
    assert want and _rows(sinks.read_reports(spark, f"{tmp_path}/reports")) == sorted(want)
    points = sinks.read_metrics(spark, f"{tmp_path}/metrics")
    # a tenant's points hold every vehicle of its upload, known or not
    assert {(r.organization, r.auto) for r in points.select("organization", "auto").distinct().collect()} == {
        (o, f"v{i}") for o in ("o1", "o2") for i in range(4)
    }


def test_rejects_are_kept(spark, tables, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("timestamp,calc_sensors_fuel_level,pos_s,calc_sensors_voltage,auto\n2024-06-15 10:00:00,1,1,27,v1\nsoon,1,1,27,v1\n")
    paths = run_upload(spark, str(path), tables, str(tmp_path / "out"), P, org="o1", upload_id="u1", load_seq=1)
    assert [r.timestamp for r in spark.read.parquet(paths["rejects"]).collect()] == ["soon"]
    assert sinks.read_metrics(spark, paths["metrics"]).count() == 1


def test_labels_do_not_pass_through_the_zone(spark):
    from tankline.functions.values import clock

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Moscow")
    try:
        assert spark.sql("SELECT timestamp_ntz'2011-03-27 02:30:00.5' AS t").select(clock(F.col("t")).alias("c")).first().c == "2011-03-27 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_status_is_folded_from_events(spark):
    uploads = spark.createDataFrame([(k, "created") for k in "abcde"] + [("f", "error")], "id string, status string")
    rows = [("a", "completed", None, 1), ("a", "pending", None, 2), ("b", "pending", None, 1), ("b", "pending", None, 1), ("c", "error", "x", 1), ("c", "completed", None, 2),
            ("d", "completed", None, 3), ("d", "error", "y", 3), ("f", "completed", None, 1), ("z", "completed", None, 1)]
    events = spark.createDataFrame(rows, "id string, status string, reason string, load_seq long")
    got = {r.id: (r.status, r.reason) for r in folded(uploads, events).collect()}
    assert got == {"a": ("completed", None), "b": ("pending", None), "c": ("error", "x"), "d": ("completed", None), "e": ("created", None), "f": ("error", None)}


def test_uploads_run_again_after_a_stop_and_fail_alone(spark, tables, tmp_path, monkeypatch):
    cars = tables["car"].withColumn("organization", F.lit("o1"))
    mine = {**tables, "car": cars}
    kinds = [(f"{t}{o}", o, "completed", t) for o in ("o1", "o2", "o3") for t in ("auto", "norm")]
    kinds += [("r1", "o1", "created", "raw"), ("r2", "o1", "created", "raw"), ("r3", "o2", "created", "raw"), ("r4", "o3", "created", "raw"), ("r5", "o4", "created", "raw")]
    uploads = spark.createDataFrame(kinds, "id string, organization string, status string, type string")
    for n, u in ((1, "r1"), (2, "r2")):
        (tmp_path / "in" / u).mkdir(parents=True)
        _csv(spark, n, tmp_path / "in" / u / "part.csv")
    (tmp_path / "in/r3").mkdir()
    (tmp_path / "in/r3/part.csv").write_text("auto,timestamp\n1,2\n")
    out = str(tmp_path / "out")

    def run(n):
        after = jobs.run_ready_uploads(spark, uploads, str(tmp_path / "in"), mine, out, n, P)
        return {r.id: (r.status, r.reason) for r in after.collect() if r.id[0] == "r"}

    def stop(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(jobs, "run_upload", stop)
        with pytest.raises(RuntimeError, match="lost"):
            run(1)
    assert {r.id for r in jobs.status_log(spark, out).collect() if r.status == "pending"} == {"r2", "r3", "r4"}
    failed = {"r3": ("error", "missing columns: calc_sensors_fuel_level, pos_s, calc_sensors_voltage"), "r4": ("error", "no readings"), "r5": ("created", None)}
    assert run(2) == {"r1": ("created", None), "r2": ("completed", None), **failed}
    want = _rows(leak_reports(leak_pipeline(_frame(spark, 2), cars, tables["car_consumption"], P, org="o1"), "r2"))
    assert want and _rows(sinks.read_reports(spark, f"{out}/reports")) == sorted(want)
    assert run(3) == {"r1": ("completed", None), "r2": ("completed", None), **failed}
    assert run(4) == run(5)


def test_stream_cascade_keeps_a_state_for_each_share_not_for_each_vehicle(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [r for r in random_rows(3000, cars=300, span_s=12 * 3600)]
    last = max(r[1] for r in rows if r[2] is not None and 0 <= r[2] <= 4096)
    slot = Params().slot_s
    closes = lambda r: (r[1] - datetime(1970, 1, 1)) // timedelta(seconds=slot) * timedelta(seconds=slot) + datetime(1970, 1, 1) + timedelta(seconds=slot + 3600)
    early = [r for r in rows if r[5] % 5]
    after = [r for r in rows if not r[5] % 5 and r[1] < last - timedelta(hours=6)]
    counts = []
    for some in (early, after):
        spark.createDataFrame(some, READING).coalesce(1).write.mode("append").parquet(src)
        query = stream_cascade(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), out, state, Params(), late_for=10 * 86400, shares=3)
        query.awaitTermination()
        counts += [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    # 3 shares, 6 slots: readings or a flag, and timers (by key and by time), not some for each of 300 vehicles
    assert 0 < max(counts) <= 3 * 6 * 8
    legal = [r for r in rows if r[2] is not None and 0 <= r[2] <= 4096]
    newest = max(r[1] for r in legal if r[5] % 5)
    final = [r for r in legal if r[5] % 5 and closes(r) <= newest]
    assert series_rows(read_cascade(spark, out)) == rounded(brute(final))
    late = read_cascade(spark, out, "late")
    assert sorted(r.seq for r in late.collect()) == sorted(r[5] for r in after if r in legal)
    assert {(r.auto, r.timestamp) for r in late.collect()} == {(r[0], r[1]) for r in after if r in legal}


def test_slot_that_closes_takes_in_the_vehicles_it_has():
    class Kept:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        clear = lambda self: self.rows.clear()
        appendValue = lambda self, x: self.rows.append(x)
        update = lambda self, x: self.rows.append(x)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    keeper, timers = SlotKeeper((), 1000, 0), []
    keeper.held, keeper.closed = Kept(), Kept()
    keeper.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    rows = lambda *autos: pd.DataFrame({"auto": autos, "micros": 1, FUEL: 2.0, SPEED: np.nan, VOLTAGE: 27.0, "seq": 3})
    given = lambda found: [(r.auto, r.late) for x in found for r in x.itertuples()]
    key = (0, 5000)
    assert given(keeper.handleInputRows(key, iter([rows("a", "b")]), At(5000))) == [] and timers == [5000]
    assert given(keeper.handleInputRows(key, iter([rows("a", "c")]), At(5001))) == [("c", True)] and timers == [5000]
    assert given(keeper.handleExpiredTimer(key, At(5001), None)) == [("a", False), ("b", False), ("a", False)] and timers == [5000, 6000]
    assert given(keeper.handleInputRows(key, iter([rows("a", "c")]), At(5001))) == [("a", True), ("c", True)]
    keeper.handleExpiredTimer(key, At(6000), None)
    assert not keeper.held.exists()


def test_readings_reach_the_state_in_packets_of_a_share_and_slot():
    names = ["org", "share", "slot", "auto", "micros", FUEL, SPEED, VOLTAGE, "seq"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 3, pa.int64()]
    rows = [(org, k % 3, 1000 * (k % 2), f"v{k % 5}", k, float(k), None if k % 4 else 1.0, 27.0, k) for k in range(240) for org in ("o1", None)]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    found = list(cascade._packets(("org",))(iter(table.to_batches(max_chunksize=50))))
    packets = [r for batch in found for r in batch.to_pylist()]
    assert len(packets) == 12  # 2 tenants, 3 shares, 2 slots
    opened = lambda r: cascade._unpacked(r["rows"]).to_pylist()
    again = [(r["org"], r["share"], r["slot"], *x.values()) for r in packets for x in opened(r)]
    assert sorted(again, key=str) == sorted(rows, key=str)
    assert all(r["newest"] == max(x["micros"] for x in opened(r)) for r in packets)
    given = pa.RecordBatch.from_pylist([{"org": r["org"], "rows": r["rows"], "late": r["slot"] > 0} for r in packets])
    back = [x for batch in cascade._opened(("org",))(iter([given])) for x in batch.to_pylist()]
    assert sorted((str(x["org"]), x["seq"], x["late"]) for x in back) == sorted((str(r[0]), r[8], r[2] > 0) for r in rows)


def test_stream_cascade_of_tenants(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = random_rows(600, cars=3, span_s=12 * 3600)
    both = spark.createDataFrame(rows, READING).withColumn("org", F.explode(F.array(F.lit("o1"), F.lit(None).cast("string"))))
    both.write.parquet(src)
    p = Params(scope=("org",))
    stream_cascade(spark.readStream.schema(both.schema).parquet(src), out, state, p, shares=3).awaitTermination()
    one = preprocess(spark.createDataFrame(rows, READING), Params())
    got = read_cascade(spark, out)
    last = got.agg(F.max("timestamp")).first()[0]
    slot_end = F.lit(last) + F.expr("INTERVAL 30 MINUTES")
    for org in (F.col("org") == "o1", F.col("org").isNull()):
        mine = sorted(map(tuple, got.filter(org).select("auto", "timestamp", "max_fuel", "dtime_s").collect()), key=str)
        want = one.filter(F.col("timestamp") < slot_end).select("auto", "timestamp", "max_fuel", "dtime_s")
        assert mine == sorted(map(tuple, want.collect()), key=str) and mine
