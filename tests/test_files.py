import hashlib

import pytest
from data import fleet

from tankline.schemas import TABLES
from tankline.sources import files, scratch, sinks

HEAD = "junk,pos_s,auto,timestamp,calc_sensors_voltage,calc_sensors_fuel_level"


def put(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_telemetry_csv(spark, tmp_path):
    path = put(
        tmp_path / "t.csv",
        HEAD,
        "x,60,007,2024-06-15 10:00:00,27,200.5",
        "x,,007,2024-06-15T10:00:01.25,27,",
        "x,fast,007,2024-06-15 10:00:02,27,1",
        "x,60,007,yesterday,27,1",
        "x,60,007,2024-06-15 10:00:03,27,1,too,many",
        "x,60,007",
        "x,NaN,008,2024-06-15 10:00:04,27,1",
    )
    good, rejects = files.read_telemetry(spark, path)
    got = sorted((r.auto, str(r.timestamp), r.pos_s, r.calc_sensors_fuel_level) for r in good.collect())
    assert got == [
        ("007", "2024-06-15 10:00:00", 60.0, 200.5),
        ("007", "2024-06-15 10:00:01.250000", None, None),
        ("008", "2024-06-15 10:00:04", None, 1.0),
    ]
    assert [r.seq for r in good.orderBy("timestamp").collect()] == sorted(r.seq for r in good.collect())
    assert rejects.count() == 4
    # a pruned read keeps skipping the malformed lines
    assert good.select("auto").count() == 3 and good.count() == 3
    with pytest.raises(Exception, match="pos_s"):
        files.read_telemetry(spark, put(tmp_path / "bad.csv", "auto,timestamp", "1,2"))[0].count()


def test_reference_files(spark, tmp_path):
    cars = put(
        tmp_path / "cars.csv",
        "guid,gos_nomer,vin_nomer,marka,model,description,sl_tip_dvigat",
        "g1,A1,V1,,X5,text,",
        "g2,A1,V1,M,X5,text,1,surplus",
        "g3,A1,V1,M,X5,\"a, b\",1",
        "g4,A1,V1,M",
        "g5,A1,V1,M,X5,\"OOO \"\"Romashka\"\", 2\nsecond line\",diesel",
    )
    assert {r.guid: r.sl_tip_dvigat for r in files.read_cars(spark, cars)[0].collect()} == {"g1": None, "g3": 1.0, "g4": None, "g5": None}
    assert [r.guid for r in files.read_cars(spark, cars)[1].collect()] == ["g2"]
    assert {r.guid: r.description for r in files.read_cars(spark, cars)[0].collect()}["g5"] == 'OOO "Romashka", 2\nsecond line'
    norms = put(
        tmp_path / "norms.csv", "sl_avto,period,norma_rasx,vid_norm_rasx,deystvuet_do", "1,p,5.5,k,2024-01-01", "1,p,,k,"
    )
    rows = files.read_norms(spark, norms)[0].orderBy("seq").collect()
    assert [(r.norma_rasx, r.deystvuet_do) for r in rows] == [(5.5, "2024-01-01"), (None, None)]
    table = put(
        tmp_path / "fleet.csv", "guid,name,description,winter_norm,summer_norm,due,engine_type", "g,n,d,1,2,2024-01-01,1"
    )
    fleet_csv, _ = files.read_fleet(spark, table)
    assert tuple(fleet_csv.collect()[0])[:7] == ("g", "n", "d", 1.0, 2.0, "2024-01-01", 1.0)
    for fmt in ("parquet", "orc"):
        out = str(tmp_path / fmt)
        fleet_csv.write.format(fmt).save(out)
        assert files.read_fleet(spark, out, fmt)[0].drop("seq").collect() == fleet_csv.drop("seq").collect()
    with pytest.raises(ValueError):
        files.read_fleet(spark, table, "xls")


def test_digests_of_small_and_big_files(spark, tmp_path):
    want = {}
    for name, size in (("a.bin", 1), ("b.bin", 10), ("c.bin", 9 << 20)):
        content = bytes(i % 251 for i in range(size)) if size < 100 else b"xyz" * (size // 3)
        (tmp_path / name).write_bytes(content)
        want[name] = (len(content), hashlib.sha256(content).hexdigest())
    got = files.hash_files(spark, str(tmp_path / "*.bin")).collect()
    assert {r.path.rsplit("/", 1)[1]: (r.size, r.file_hash) for r in got} == want


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_export_and_import(spark, tmp_path, fmt):
    existing = fleet(spark, [("1", "a", 0.0, "o"), ("2", "b", 1.0, "o")]).select(*TABLES["car"].names)
    newer = fleet(spark, [("2", "новое, имя", 5.0, "p"), ("3", "c", None, "p")]).select(*TABLES["car"].names)
    path = str(tmp_path / "out")
    sinks.export_table(newer, path, fmt)
    got = {r.id: (r.name, r.engine_type) for r in sinks.import_table(spark, path, fmt, existing)[0].collect()}
    assert got == {"1": ("a", 0.0), "2": ("новое, имя", 5.0), "3": ("c", None)}
    with pytest.raises(ValueError):
        sinks.export_table(newer, path, "xml")


def test_microseconds_survive_export(spark, tmp_path):
    df = spark.sql("SELECT '1' AS id, timestamp_ntz'2024-01-01 00:00:00.123456' AS at")
    sinks.export_table(df, str(tmp_path / "o"), "csv")
    assert "00:00:00.123456" in "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv"))


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    assert scratch.fresh_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, *a):
            return None

    class Cluster:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Cluster())


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "p")
    mk = lambda *rows: spark.createDataFrame(rows, "id string, upload_id string")
    sinks.write_partitions(mk(("1", "007"), ("2", "b")), path, ["upload_id"])
    sinks.write_partitions(mk(("3", "b")), path, ["upload_id"])
    read = lambda: {(r.id, r.upload_id) for r in spark.read.schema("id string, upload_id string").parquet(path).collect()}
    assert read() == {("1", "007"), ("3", "b")}
    sinks.write_partitions(mk(("4", "b")), path, ["upload_id"], mode="append")
    assert ("4", "b") in read() and ("3", "b") in read()
    # a fixed partition is replaced even by nothing, whatever its name
    sinks.write_partitions(mk(("9", "b")).filter("false"), path, ["upload_id"], {"upload_id": "b"})
    sinks.write_partitions(mk(("5", "x/y z")), path, ["upload_id"], {"upload_id": "x/y z"})
    assert read() == {("1", "007"), ("5", "x/y z")}
    for name in ("july 2024.csv", "50%=a", "июль", "x/y z"):
        sinks.write_partitions(mk(("6", name)), path, ["upload_id"], {"upload_id": name})
        assert ("6", name) in read()
        sinks.write_partitions(mk(("6", name)).filter("false"), path, ["upload_id"], {"upload_id": name})
    assert read() == {("1", "007")}


def test_headers_of_each_file_and_the_order_of_files(spark, tmp_path):
    put(tmp_path / "a.csv", "auto,timestamp,pos_s,calc_sensors_fuel_level,calc_sensors_voltage", "1,2024-06-15 10:00:00,60,100,27", "1,2024-06-15 10:00:01,60,100,27")
    put(tmp_path / "b.csv", "calc_sensors_fuel_level,pos_s,calc_sensors_voltage,timestamp,auto", "100,60,27,2024-06-15 10:00:02,1")
    (tmp_path / "empty.csv").write_text("")
    good, rejects = files.read_telemetry(spark, str(tmp_path))
    assert {(r.pos_s, r.calc_sensors_fuel_level, r.calc_sensors_voltage) for r in good.collect()} == {(60.0, 100.0, 27.0)}
    assert [r.timestamp.second for r in good.orderBy("seq").collect()] == [0, 1, 2] and rejects.count() == 0
    put(tmp_path / "c.csv", "auto,timestamp", "1,2")
    with pytest.raises(Exception, match="c.csv"):
        files.read_telemetry(spark, str(tmp_path))[0].count()


def test_paths_that_look_like_uris(spark, tmp_path):
    odd = tmp_path / "a b%20#c"
    odd.mkdir()
    (odd / "x y.bin").write_bytes(b"abc")
    (row,) = files.hash_files(spark, str(tmp_path / "a b*" / "*.bin")).collect()
    assert (row.size, row.file_hash) == (3, hashlib.sha256(b"abc").hexdigest())
