import pytest
from pyspark.sql import functions as F

from tankline.operators import entities as ent
from tankline.operators import upsert as ups


@pytest.fixture(scope="module")
def tables(spark):
    mk = spark.createDataFrame
    return {
        "organization": mk([("o1", "North", None, "1"), ("o2", "South", "t", "2")], "id string, name string, bot_token string, chat_id string"),
        "org_user": mk([("u1", "o1", "ann", "a@x"), ("u2", None, "bob", "x@y"), ("u3", "o2", "cid", "zed@y")], "id string, org string, username string, email string"),
        "car": mk(
            [("c1", "Beta 12", "red", 0.0, "o1"), ("c2", "Alpha", None, 1.0, "o1"), ("c3", "Gamma", "blue", 0.0, "o2")],
            "id string, name string, description string, engine_type double, organization string",
        ),
        "car_consumption": mk([("k1", "c1", 1.0), ("k2", "c3", 2.0), ("k3", "c2", 3.0)], "id string, car string, winter_volume double").withColumn("valid_period", F.lit("2024-05-01").cast("date")),
        "report_query": mk([("q1", "o1", "created"), ("q2", "o2", "error")], "id string, organization string, status string"),
        "media": mk([("m1", "q1", "f.csv", "raw", "text/csv"), ("m2", "q2", "g.csv", "auto", "text/csv")], "id string, report_query string, filename string, type string, media_type string"),
        "car_report": mk([("r2", "c1", "2024-01-02", True), ("r1", "c1", "2024-01-02", False), ("r3", "c3", "2024-01-01", True), ("r0", "c2", "2024-01-03", True)], "id string, car string, d string, status boolean").select("id", "car", F.col("d").cast("timestamp_ntz").alias("datetime"), "status"),
        "driver": mk([("d1", "Ivo", "x", "1"), ("d2", "Jan", "y", "2"), ("d3", "Kim", "z", "3")], "id string, fullname string, address string, phone string"),
        "driver_car": mk([("d1", "c1"), ("d1", "c2"), ("d1", "c3"), ("d2", "c3")], "driver string, car string"),
    }


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize(
    "name, org, want",
    [
        ("organization", "o1", ["o1"]),
        ("org_user", "o1", ["u1"]),
        ("car", "o1", ["c1", "c2"]),
        ("car_consumption", "o1", ["k1", "k3"]),
        ("report_query", "o2", ["q2"]),
        ("media", "o2", ["m2"]),
        ("car_report", "o1", ["r1", "r2", "r0"]),
        ("driver", "o1", ["d1"]),
        ("driver", "o2", ["d1", "d2"]),
    ],
)
def test_a_tenant_sees_its_own(tables, name, org, want):
    assert ids(ent.list_entities(tables, name, org, nested=False)) == want
    assert sorted(ids(ent.list_entities(tables, name, org))) == sorted(want)
    for key in want:
        assert ids(ent.get_entity(tables, name, org, key)) == [key]
    other = {"o1": "o3", "o2": "o3"}[org]
    assert ids(ent.get_entity(tables, name, other, want[0])) == []


def test_pages(spark):
    df = spark.range(1, 6).select(F.col("id").cast("string").alias("id"))
    assert ids(ent.page(df, ("id",), 2, 2)) == ["3", "4"]
    assert ids(ent.page(df, ("id",), 9, 2)) == []
    assert ids(ent.page(df, ("id",), 1, 2, after=("2",))) == ["3", "4"]
    many = spark.range(1500).select(F.format_string("%05d", "id").alias("id"))
    assert len(ids(ent.page(many, ("id",), 1, 5000))) == 1000
    assert ids(ent.page(df, ("-id",), 1, 2, after=("4",))) == ["3", "2"]
    two = spark.createDataFrame([(k // 3, str(k)) for k in range(9)], "day int, id string")
    assert ids(ent.page(two, ("-day", "id"), 1, 4, after=(2, "7"))) == ["8", "3", "4", "5"]
    for bad in (dict(number=0),):
        with pytest.raises(ValueError):
            ent.page(df, **{"order": ("id",), **bad})


def test_search_and_filters(tables):
    find = lambda name, text: sorted(ids(ent.list_entities(tables, name, search=text, nested=False)))
    assert find("car", "beta") == ["c1"] and find("car", "NORTH a") == ["c1", "c2"]
    assert find("car", "north blue") == [] and find("car", "") == ["c1", "c2", "c3"]
    assert find("org_user", "zed@") == ["u3"]
    assert find("org_user", "b") == ["u2"] and find("org_user", "south") == ["u3"]
    assert find("car_report", "gamma 2024-01") == ["r3"]
    assert find("car_consumption", "2024-05 beta") == ["k1"]
    assert find("driver", "ivo gamma") == ["d1"] and find("driver", "gamma") == ["d1", "d2"]
    search = lambda text: ids(ent.search_entities(tables["report_query"], tables, "report_query", text, admin=True))
    assert search("csv") and search("no such file") == [] and search("south") == ["q2"] and search("err") == []
    assert find("media", "csv raw") == ["m1"] and find("report_query", "south err") == ["q2"]
    only = lambda entity, **f: ids(ent.list_entities(tables, entity, filters=f, nested=False))
    assert only("car_report", status=False) == ["r1"] and only("driver", car="c3", phone="2") == ["d2"]
    assert only("car", name="Alpha", organization="o1") == ["c2"]
    with pytest.raises(ValueError):
        only("car", engine_type=1.0)
    with pytest.raises(ValueError):
        ent.list_entities(tables, "nothing")


def test_nesting(tables):
    report = ent.list_entities(tables, "car_report", "o2").collect()[0]
    assert (report.car.name, report.car.organization.name) == ("Gamma", "South")
    users = {r.id: r.org for r in ent.list_entities(tables, "org_user").collect()}
    assert users["u2"] is None and users["u1"].name == "North"
    request = ent.get_entity(tables, "report_query", "o1", "q1").collect()[0]
    assert [m.id for m in request.media] == ["m1"]
    drivers = {r.id: [c.id for c in r.car] for r in ent.expand(tables["driver"], tables, "driver").collect()}
    assert drivers == {"d1": ["c1", "c2", "c3"], "d2": ["c3"], "d3": []}


def test_lists_come_in_as_many_parts_as_asked(spark, tables):
    links = spark.range(5000).select(F.lit("d1").alias("driver"), F.col("id").cast("string").alias("id")).unionByName(
        spark.createDataFrame([("d2", "7")], "driver string, id string")
    )
    got = ent.nest_children(tables["driver"], links, "driver", "car", parts=50).collect()
    mine = [r for r in got if r.id == "d1"]
    assert len(mine) == 50 and max(len(r.car) for r in mine) < 200
    assert sorted(int(c.id) for r in mine for c in r.car) == list(range(5000))
    whole = ent.nest_children(tables["driver"], links, "driver", "car").collect()
    assert sorted((r.id, r.part, len(r.car)) for r in whole) == [("d1", 0, 5000), ("d2", 0, 1), ("d3", 0, 0)]
    assert ent.child_rows(tables["driver"], links, "driver", "car").count() == 5001
    assert sorted(len(r.car) for r in got if r.id in ("d2", "d3")) == [0] * 99 + [1]


def test_drivers(tables):
    t = tables
    assert ids(ent.org_drivers(t["driver"], t["driver_car"], t["car"], "o1", distinct=False)) == ["d1", "d1"]
    shown = {r.id: r.cars for r in ent.car_list(t["driver"], t["driver_car"], t["car"], 2).collect()}
    assert shown == {"d1": "Alpha, Beta 12...", "d2": "Gamma", "d3": ""}
    assert {r.id: r.cars for r in ent.car_list(t["driver"], t["driver_car"], t["car"]).collect()}["d1"] == "Alpha, Beta 12, Gamma"


def test_orders(tables):
    assert ids(ent.default_sorted(tables["car_report"], tables, "car_report")) == ["r0", "r1", "r2", "r3"]
    assert ids(ent.default_sorted(tables["car_consumption"], tables, "car_consumption")) == ["k3", "k1", "k2"]
    assert ids(ent.first_row(tables["report_query"], tables, "report_query")) == ["q2"]
    assert ent.total_rows(tables["car"]).collect()[0].total == 3
    assert {r.engine_type for r in ent.facets(tables["car"], "engine_type").collect()} == {0.0, 1.0}


def test_cascade_delete(spark, tables):
    gone = spark.createDataFrame([("o1",)], "id string")
    left = {k: sorted(tuple(r)[0] for r in v.collect()) for k, v in ups.cascade_delete(tables, "organization", gone).items()}
    assert left["organization"] == ["o2"] and left["car"] == ["c3"] and left["car_report"] == ["r3"]
    assert left["org_user"] == ["u2", "u3"] and left["media"] == ["m2"] and left["car_consumption"] == ["k2"]
    assert left["driver"] == ["d1", "d2", "d3"] and left["driver_car"] == ["d1", "d2"]
    one = ups.cascade_delete(tables, "report_query", spark.createDataFrame([("q1",)], "id string"))
    assert one["media"].count() == 1 and one["car"] is tables["car"]
