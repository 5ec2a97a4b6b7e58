"""The metric series of a vehicle: points to store and windowed queries over them."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import add_window_end
from ..functions.values import clock
from ..schemas import FUEL, SPEED

# Public metric names and the stored field behind each.
FIELDS = {"fuel_level": FUEL, "speed": SPEED}
FUNCS = {"mean": F.avg, "median": F.median, "sum": F.sum}
POINT_KEY = ["organization", "auto", "timestamp"]


def metric_points(series: DataFrame, org: str | Column, *extra: str) -> DataFrame:
    """Series rows -> stored points; a missing value is stored as 0. ``extra`` columns come along."""
    org = F.lit(org) if isinstance(org, str) else org
    return series.select(
        org.cast("string").alias("organization"),
        "auto",
        "timestamp",
        F.coalesce(SPEED, F.lit(0.0)).alias(SPEED),
        F.coalesce("max_fuel", F.lit(0.0)).alias(FUEL),
        F.coalesce("spent_fuel", F.lit(0.0)).alias("spent_fuel"),
        *extra,
    )


def _as_date(value, name: str) -> date | None:
    if value is None or (isinstance(value, date) and not isinstance(value, datetime)):
        return value
    if isinstance(value, str):
        return date.fromisoformat(value)
    raise ValueError(f"{name} must be a date")


def time_range(frm=None, due=None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """Start (inclusive) and stop (exclusive): from 00:00:00, to 23:59:59; ten years back to now
    if not given."""
    frm, due = _as_date(frm, "frm"), _as_date(due, "due")
    now = now or datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    if frm:
        start = datetime.combine(frm, time.min)
    else:
        try:
            start = now.replace(year=now.year - 10)
        except ValueError:  # 29 February
            start = (now - timedelta(days=1)).replace(year=now.year - 10)
    stop = datetime.combine(due, time(23, 59, 59)) if due else now
    return start, stop


def _stamp(at: datetime) -> Column:
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def car_metrics(
    metrics: DataFrame,
    org: str | None,
    car: str | None,
    metric: str = "both",
    frm=None,
    due=None,
    every: str | None = None,
    fn: str = "mean",
    now: datetime | None = None,
) -> DataFrame:
    """Points (x, y, metric) of one vehicle, or of all when ``org`` and ``car`` are None; those
    rows then keep organization and auto.

    With ``every`` the points are aggregated in epoch-aligned windows labelled with their end, which
    never lies beyond the end of the range. Windows without points give no row. The median is exact.
    """
    if metric not in (*FIELDS, "both"):
        raise ValueError(f"unknown metric {metric!r}")
    if fn not in FUNCS:
        raise ValueError(f"unknown function {fn!r}")
    start, stop = time_range(frm, due, now)
    who = {"organization": org, "auto": car}
    for name, value in who.items():
        if value is not None:
            metrics = metrics.filter(F.col(name) == value)
    keep = [name for name, value in who.items() if value is None]
    ts = F.col("timestamp")
    points = metrics.filter((ts >= _stamp(start)) & (ts < _stamp(stop)))
    chosen = FIELDS if metric == "both" else {metric: FIELDS[metric]}
    # Aggregate the wide rows first, unpivot after: half the rows to group.
    fields = list(chosen.values())
    if every:
        points = add_window_end(points, "_end", every)
        points = points.withColumn("timestamp", F.least("_end", _stamp(stop)))
        points = points.groupBy(*keep, "timestamp").agg(*[FUNCS[fn](f).alias(f) for f in fields])
    x = clock(F.col("timestamp"))
    pairs = F.array(
        *[F.struct(F.lit(label).alias("metric"), F.col(f).cast("double").alias("y")) for label, f in chosen.items()]
    )
    out = points.select(*keep, x.alias("x"), F.explode(pairs).alias("p")).select(
        *keep, "x", F.col("p.y").alias("y"), F.col("p.metric").alias("metric")
    )
    # The answer for one vehicle comes in order; sorting the whole fleet is left to the caller.
    return out if keep else out.orderBy("metric", "x")
