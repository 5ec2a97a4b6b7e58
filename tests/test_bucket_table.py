"""Tables in buckets: what a merge touches, and what it leaves."""

import os
import re

import pytest
from data import fleet
from pyspark.sql import functions as F

from tankline.operators.upsert import update_where, upsert_cars
from tankline.schemas import TABLES
from tankline.sources import bucket_table
from tankline.sources.bucket_table import BucketTable

CARS = TABLES["car"]


@pytest.fixture
def table(spark, tmp_path):
    out = BucketTable(spark, str(tmp_path / "cars"), CARS, buckets=32)
    out.create(fleet(spark, [(str(k), f"car {k}", float(k % 2), "o") for k in range(300)]).select(*CARS.names))
    return out


def files(table):
    return {d: sorted(f for f in os.listdir(f"{table.path}/{d}") if f.endswith(".parquet")) for d in os.listdir(table.path) if d.startswith("bucket=")}


def incoming(spark, *ids):
    return spark.createDataFrame([(i, f" new {i} ", "d", 1.0, n) for n, i in enumerate(ids)], "guid string, name string, description string, engine_type double, seq long")


def names(table):
    return {r.id: r.name for r in table.read().collect()}


def test_ten_changes_rewrite_at_most_ten_buckets(spark, table):
    before, whole = files(table), names(table)
    ids = [str(k) for k in range(0, 300, 33)] + ["999"]
    touched = table.merge(incoming(spark, *ids), "guid", lambda old, new: upsert_cars(old, new, "p"))
    after = files(table)
    assert len(touched) <= 11 and {d for d in after if after[d] != before.get(d)} == {f"bucket={k}" for k in touched}
    assert names(table) == whole | {i: f"new {i}" for i in ids}
    assert {r.organization for r in table.read().filter("id = '999'").collect()} == {"p"}


def test_only_touched_buckets_are_read(spark, table):
    one = table.find("7", "8")
    assert {r.id for r in one.collect()} == {"7", "8"}
    plan = one._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_updates_deletes_and_empty_buckets(spark, table):
    some = spark.createDataFrame([("1",), ("2",)], "id string")
    table.merge(some, "id", lambda old, ids: update_where(old.join(ids.withColumn("hit", F.lit(True)), "id", "left"), F.col("hit"), name="x"))
    assert {i for i, n in names(table).items() if n == "x"} == {"1", "2"}
    everyone = table.read().select("id")
    table.merge(everyone, "id", lambda old, ids: old.join(ids, "id", "left_anti"))
    assert names(table) == {} and files(table) == {}
    assert table.merge(some.filter("false"), "id", lambda old, ids: old) == []
    table.merge(incoming(spark, "5"), "guid", lambda old, new: upsert_cars(old, new, "o"))
    assert names(table) == {"5": "new 5"}


def test_a_stopped_merge_changes_nothing(spark, table, monkeypatch):
    whole = names(table)

    def stop(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(bucket_table, "write_partitions", stop)
        with pytest.raises(RuntimeError, match="lost"):
            table.merge(incoming(spark, "1"), "guid", lambda old, new: upsert_cars(old, new, "o"))
    assert names(table) == whole


def test_a_key_that_the_changes_do_not_name(spark, table):
    with pytest.raises(ValueError, match="do not name"):
        table.merge(incoming(spark, "1"), "guid", lambda old, new: upsert_cars(old, incoming(spark, *map(str, range(400, 440))), "o"))


def test_a_missing_key_is_a_key(spark, tmp_path):
    out = BucketTable(spark, str(tmp_path / "t"), CARS, buckets=4)
    out.create(fleet(spark, [("1", "a", 0.0, "o")]).select(*CARS.names).unionByName(spark.createDataFrame([(None, "n", "", 0.0, "o")], CARS)))
    assert out.read().count() == 2
