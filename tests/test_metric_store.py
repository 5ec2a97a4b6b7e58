"""The metric store: what is read, what is replaced, how many folders there are."""

import os
import re
from datetime import datetime

import pytest

from tankline.schemas import METRICS
from tankline.sources import metric_store as store

LEVEL = METRICS.names[4]


def points(spark, rows, load_seq):
    """rows: organization, auto, timestamp, level."""
    df = spark.createDataFrame(rows, "organization string, auto string, t string, level double")
    return df.selectExpr("organization", "auto", "cast(t as timestamp_ntz) as timestamp", "1d as pos_s", f"level as {LEVEL}", "0d as spent_fuel", f"{load_seq}L as load_seq")


def levels(df):
    return {(r.organization, r.auto, str(r.timestamp)): r[LEVEL] for r in df.collect()}


def folders(path, what="settled"):
    return sorted(d for d, _, files in os.walk(f"{path}/{what}") if any(f.endswith(".parquet") for f in files))


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "metrics")


def test_later_loads_win_before_and_after_settling(spark, path):
    store.write_metrics(points(spark, [("o", "1", "2024-01-01 00:00:00", 1.0), ("o", "2", "2024-01-01 00:00:00", 1.0)], 2), path, "b", fan_in=None)
    store.write_metrics(points(spark, [("o", "1", "2024-01-01 00:00:00", 9.0), ("p", "1", "2024-01-01 00:00:00", 3.0)], 1), path, "a", fan_in=None)
    want = {("o", "1", "2024-01-01 00:00:00"): 1.0, ("o", "2", "2024-01-01 00:00:00"): 1.0, ("p", "1", "2024-01-01 00:00:00"): 3.0}
    assert levels(store.read_metrics(spark, path)) == want
    assert store.settle_metrics(spark, path) and store.recent_uploads(spark, path) == []
    assert levels(store.read_metrics(spark, path)) == want
    assert not store.settle_metrics(spark, path)


@pytest.mark.parametrize("settled", [False, True])
def test_an_upload_that_runs_again_replaces_its_rows(spark, path, settled):
    old, new = ("o", "1", "2024-01-01 00:00:00", 5.0), ("o", "2", "2024-02-01 00:00:00", 6.0)
    store.write_metrics(points(spark, [old], 1), path, "u", fan_in=1 if settled else None)
    store.write_metrics(points(spark, [new], 2), path, "u", fan_in=None)
    assert levels(store.read_metrics(spark, path)) == {new[:3]: 6.0}
    store.settle_metrics(spark, path)
    assert levels(store.read_metrics(spark, path)) == {new[:3]: 6.0}
    assert len(folders(path)) == 1
    # and by nothing
    store.write_metrics(points(spark, [new], 3).filter("false"), path, "u", fan_in=None)
    assert levels(store.read_metrics(spark, path)) == {}
    store.settle_metrics(spark, path)
    assert levels(store.read_metrics(spark, path)) == {} and folders(path) == []


def test_settling_again_after_a_stop_changes_nothing(spark, path, monkeypatch):
    rows = [("o", str(k), "2024-01-01 00:00:00", float(k)) for k in range(20)]
    store.write_metrics(points(spark, rows[:10], 1), path, "a", fan_in=1)
    store.write_metrics(points(spark, rows[5:], 2), path, "b", fan_in=None)
    want = levels(store.read_metrics(spark, path))

    def stop(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "remove_path", stop)
        with pytest.raises(RuntimeError, match="lost"):
            store.settle_metrics(spark, path)
    assert store.recent_uploads(spark, path) == ["b"] and levels(store.read_metrics(spark, path)) == want
    store.settle_metrics(spark, path)
    assert store.recent_uploads(spark, path) == [] and levels(store.read_metrics(spark, path)) == want


def test_folders_follow_tenants_and_months_not_uploads(spark, path):
    for n in range(7):
        rows = [(o, str(k), f"2024-0{m}-01 00:00:0{n}", float(n)) for o in ("o", "p") for k in range(3) for m in (1, 2)]
        store.write_metrics(points(spark, rows, n), path, f"u{n} %", fan_in=3)
    assert len(store.recent_uploads(spark, path)) == 1
    assert len(folders(path)) <= 2 * 2 * 3
    assert len(levels(store.read_metrics(spark, path))) == 2 * 3 * 2 * 7


def test_only_touched_places_are_written_again(spark, path):
    rows = [("o", str(k), f"2024-0{m}-01 00:00:00", 1.0) for k in range(6) for m in (1, 2, 3)]
    store.write_metrics(points(spark, rows, 1), path, "a", fan_in=1)
    stamp = lambda: {d: sorted(f for f in os.listdir(d) if f.endswith(".parquet")) for d in folders(path)}
    before = stamp()
    store.write_metrics(points(spark, [("o", "1", "2024-02-09 00:00:00", 1.0)], 2), path, "b", fan_in=1)
    assert sum(before[d] != files for d, files in stamp().items()) == 1


def test_a_vehicles_month_reads_its_bucket_only(spark, path):
    rows = [("o", str(k), f"2024-0{m}-0{day} 00:00:00", 1.0) for k in range(40) for m in (1, 2, 3) for day in (1, 2)]
    store.write_metrics(points(spark, rows, 1), path, "a", fan_in=1)
    one = store.read_metrics(spark, path, "o", "7", datetime(2024, 2, 1), datetime(2024, 2, 2))
    assert levels(one) == {("o", "7", "2024-02-01 00:00:00"): 1.0}
    plan = one._jdf.queryExecution().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], ", plan).group(1)
    assert "organization" in filters and "month" in filters and "bucket" in filters and "EqualTo(auto,7)" in plan
    inputs = {f.split("settled/")[1].rsplit("/", 1)[0] for f in one.inputFiles() if "settled/" in f}
    assert len(inputs) >= 1
    metrics = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in metrics


def test_missing_values_and_an_empty_store(spark, path):
    assert store.read_metrics(spark, path).count() == 0
    store.write_metrics(points(spark, [(None, "1", "2024-01-01 00:00:00", 1.0), ("o", None, "2024-01-01 00:00:00", None), ("o", "1", None, 2.0)], 1), path, "a", fan_in=1)
    assert store.read_metrics(spark, path).count() == 3
    # uploads named in the rows
    store.write_metrics(points(spark, [("o", "9", "2024-01-01 00:00:00", 1.0)], 1).selectExpr("*", "cast(null as string) as upload_id"), path, fan_in=1)
    assert store.read_metrics(spark, path).count() == 4 and store.recent_uploads(spark, path) == []
