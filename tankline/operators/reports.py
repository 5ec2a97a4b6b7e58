"""Drain reports and the questions asked of them."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = {"count": lambda: F.count("*"), "sum": lambda: F.sum("volume")}


def leak_reports(detected: DataFrame, upload_id: str | Column) -> DataFrame:
    """Flagged rows -> report rows. Whole litres, cut towards zero. The id is a digest of what
    the row is about, so a second run gives the same rows."""
    upload = F.lit(upload_id) if isinstance(upload_id, str) else upload_id
    norm = F.coalesce("norm_id", F.lit("")) if "norm_id" in detected.columns else F.lit("")
    identity = F.concat_ws("|", upload, "auto", F.col("timestamp").cast("string"), norm)
    return detected.filter("is_leak").select(
        F.sha2(identity, 256).alias("id"),
        F.col("auto").alias("car"),
        F.col("timestamp").alias("datetime"),
        F.coalesce(F.col("leak"), F.lit(0.0)).cast("int").alias("volume"),
        F.col("is_leak").alias("status"),
        upload.alias("upload_id"),
    )


def _day(value, name: str) -> Column:
    if isinstance(value, str):
        value = date.fromisoformat(value)
    if isinstance(value, datetime) or not isinstance(value, date):
        raise ValueError(f"{name} must be a date")
    return F.lit(value.isoformat()).cast("timestamp_ntz")


def in_period(reports: DataFrame, frm=None, due=None) -> DataFrame:
    """Confirmed reports between the two dates. A date means its first instant, so of the last
    day only reports at exactly midnight are in."""
    reports = reports.filter("status")
    if frm is not None:
        reports = reports.filter(F.col("datetime") >= _day(frm, "frm"))
    if due is not None:
        reports = reports.filter(F.col("datetime") <= _day(due, "due"))
    return reports


def _measure(name: str) -> Column:
    if name not in MEASURES:
        raise ValueError(f"unknown measure {name!r}")
    return MEASURES[name]().alias("value")


def _tenant(cars: DataFrame, org: str | None, *extra: str) -> DataFrame:
    if org is not None:
        cars = cars.filter(F.col("organization") == org)
    return cars.select(F.col("id").alias("car"), "organization", *extra)


def daily_leaks(
    reports: DataFrame,
    cars: DataFrame,
    org: str | None = None,
    frm=None,
    due=None,
    measure: str = "count",
) -> DataFrame:
    """Reports or litres per day (day as text). With ``org=None`` per tenant and day.

    Reports are first summed per vehicle and day: the join then sees few rows of even the busiest
    vehicle.
    """
    day = F.col("datetime").cast("date").cast("string").alias("day")
    per_car = in_period(reports, frm, due).groupBy("car", day).agg(_measure(measure))
    tenant = ["organization"] if org is None else []
    return (
        per_car.join(_tenant(cars, org), "car")
        .groupBy(*tenant, "day")
        .agg(F.sum("value").alias("value"))
        .orderBy(*tenant, "day")
    )


def car_leaks(
    reports: DataFrame,
    cars: DataFrame,
    org: str | None = None,
    frm=None,
    due=None,
    measure: str = "count",
) -> DataFrame:
    """Reports or litres per vehicle: id, label, value, by label. Vehicles without reports give no
    row. With ``org=None`` over all tenants, with the tenant as a column."""
    per_car = in_period(reports, frm, due).groupBy("car").agg(_measure(measure))
    tenant = ["organization"] if org is None else []
    return (
        per_car.join(_tenant(cars, org, "name"), "car")
        .select(
            *tenant,
            F.col("car").cast("string").alias("id"),
            F.col("name").alias("label"),
            F.col("value").cast("double").alias("value"),
        )
        .orderBy("label", "id")
    )
