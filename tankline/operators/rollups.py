"""Roll-ups of metric points that merge: hours of a vehicle, and days, months or tenants from these.

An hour keeps the number of its points, their sum, least and greatest value, and a KLL sketch of their
distribution. All of these merge, so a longer period or a whole tenant needs the roll-ups only and no points.
With K the rank of a quantile is off by at most RANK_ERROR of the points (at 99 % confidence); groups
of fewer than K points are exact. The exact median of points stays in ``metrics.car_metrics``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import add_bin
from ..schemas import FUEL

K = 800
RANK_ERROR = 0.01
#: start of the period that holds a time, without passing through the session zone
PERIODS = {
    "hour": lambda t: t,
    "day": lambda t: t.cast("date").cast("timestamp_ntz"),
    "month": lambda t: F.trunc(t.cast("date"), "month").cast("timestamp_ntz"),
}


def hourly(points: DataFrame, field: str = FUEL, keys: tuple[str, ...] = ("organization", "auto")) -> DataFrame:
    """(keys, start, n, total, least, greatest, sketch) of every hour that has a value."""
    rows = add_bin(points.filter(F.col(field).isNotNull()), "start", 3600)
    x = F.col(field)
    return rows.groupBy(*keys, "start").agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.kll_sketch_agg_double(x, F.lit(K)).alias("sketch"))


def merged(rollups: DataFrame, period: str = "day", keys: tuple[str, ...] = ("organization", "auto")) -> DataFrame:
    """Roll-ups of longer periods, and of fewer keys, from shorter ones."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}")
    return rollups.groupBy(*keys, PERIODS[period](F.col("start")).alias("start")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch")
    )


def quantile(rank: float, sketch: str = "sketch") -> Column:
    """The value at a rank between 0 and 1 of a roll-up."""
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(rank)))
