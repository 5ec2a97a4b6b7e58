"""Fuel-drain detection on the preprocessed series.

Joins carry no broadcast hint: cars and norms grow with the fleet, so Spark's own size check
(statically and, under AQE, at run time) decides between broadcast and sort-merge.

The per-vehicle window holds one row per final bin, at most 48 a day at the standard widths: its
size follows the length of the history, not the volume of readings. It is keyed by ``auto``, which
equals the vehicle's id after the join, so that joins and windows share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import Params
from ..schemas import SPEED
from ..sources.scratch import written_once
from .clean import normalise, preprocess
from .quantiles import exact_median


def org_cars(cars: DataFrame, org: str | None = None) -> DataFrame:
    """Vehicles as the detection step wants them; all tenants when ``org`` is None."""
    if org is not None:
        cars = cars.filter(F.col("organization") == org)
    return cars.select(
        F.col("id").cast("string").alias("id"),
        "name",
        F.col("engine_type").alias("sl_tip_dvigat"),
        "organization",
    )


def norm_columns(norms: DataFrame) -> DataFrame:
    """Norms as the detection step wants them. The norm id settles the order of equal periods."""
    return norms.select(
        F.col("car").cast("string").alias("sl_avto"),
        F.col("winter_volume").alias("norma_rasx_winter"),
        F.col("summer_volume").alias("norma_rasx_summer"),
        F.col("valid_period").alias("period"),
        F.col("id").cast("string").alias("norm_id"),
    )


def org_norms(norms: DataFrame, cars: DataFrame, org: str | None = None) -> DataFrame:
    """Consumption norms of the tenant's vehicles."""
    owner = cars if org is None else cars.filter(F.col("organization") == org)
    owner = owner.select(F.col("id").cast("string").alias("sl_avto"))
    return norm_columns(norms).join(owner, "sl_avto", "left_semi")


def scoped_norms(norms: DataFrame, cars: DataFrame, org: str | None = None) -> DataFrame:
    """Norms for a job of one tenant, or of all (None). Norms of other tenants' vehicles find no row of the
    series anyway; for one tenant they are left out before anything is aggregated."""
    return norm_columns(norms) if org is None else org_norms(norms, cars, org)


def attach_cars(series: DataFrame, cars: DataFrame) -> DataFrame:
    """Inner join on the vehicle. Where the series names its tenant, the vehicle must be theirs."""
    match = series["auto"] == cars["id"]
    if "organization" not in series.columns:
        return series.join(cars, match, "inner")
    match = match & (series["organization"] == cars["organization"])
    return series.join(cars, match, "inner").drop(cars["organization"])


def _norm_order() -> Column:
    # periods in order, open-ended ones last
    return F.struct(
        F.col("period").isNull().alias("open"), F.col("period").alias("p"), F.col("norm_id").alias("n")
    )


def latest_norm(norms: DataFrame) -> DataFrame:
    """One norm per vehicle, the last by period. max_by combines map-side, so a vehicle with a huge
    norm history costs no more than any other."""
    value = F.struct("norma_rasx_winter", "norma_rasx_summer", "period", "norm_id")
    last = norms.groupBy("sl_avto").agg(F.max_by(value, _norm_order()).alias("v"))
    return last.select("sl_avto", "v.*")


def attach_norms(series: DataFrame, norms: DataFrame, policy: str = "fanout") -> DataFrame:
    """Inner join on the vehicle. ``fanout`` gives one row per norm, ``latest`` uses the last norm."""
    if policy not in ("fanout", "latest"):
        raise ValueError(f"unknown norm policy {policy!r}")
    if policy == "latest":
        norms = latest_norm(norms)
    return series.join(norms, series["auto"] == norms["sl_avto"], "inner")


def consumed(df: DataFrame) -> DataFrame:
    """Turn level changes into litres used, in total and per 100 km: gains count as 0, losses lose
    their sign."""
    used = F.abs(F.least("spent_fuel", F.lit(0.0)))
    return df.withColumns({"spent_fuel": used, "spent_per_100": F.try_divide(used * 100, F.col("travel"))})


def season_norm(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Add the norm in force and the norm for the distance, scaled by the cube of relative speed."""
    summer = F.month("timestamp").between(*p.summer_months)
    norm = F.when(summer, F.col("norma_rasx_summer")).otherwise(F.col("norma_rasx_winter"))
    pace = F.pow(F.col(SPEED) / p.speed_ref, F.lit(3.0))
    return df.withColumns(
        {"norma_rasx": norm, "norma_rasx_per_travel": norm * F.col("travel") / 100 * pace}
    )


def leak_volume(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Add ``leak`` (litres above what is explained) and ``is_leak``."""
    spent = F.col("spent_fuel")
    idle = (F.col("travel") == 0) & (spent >= F.lit(p.idle_threshold))
    leak = F
    for engine, rate in p.idle_rate.items():
        leak = leak.when(idle & (F.col("sl_tip_dvigat") == engine), F.abs(spent - F.lit(rate)))
    leak = leak.otherwise(F.greatest(F.lit(0.0), spent - F.col("norma_rasx_per_travel")))
    return df.withColumns({"leak": leak, "is_leak": leak > p.leak_limit})


def _with_delta(df: DataFrame) -> DataFrame:
    return df.withColumn("delta_sp", F.col("spent_fuel") - F.col("norma_rasx_per_travel"))


def _flag_outliers(df: DataFrame, p: Params) -> DataFrame:
    bound = F.col("delta_sp_median") + p.sigma * F.col("delta_sp_std")
    outlier = (F.col("delta_sp") >= bound) & (F.col("leak") >= p.leak_limit)
    return df.withColumn("is_leak_delta_sp", F.coalesce(outlier, F.lit(False)))


def leak_stats(df: DataFrame, p: Params = Params(), by_digits: bool = False) -> DataFrame:
    """Add the vehicle's median and sample deviation of unexplained use, and the outlier flag.

    Both are aggregates that combine map-side (the median as a map from value to count), and their
    result, a row for each vehicle, is joined back: no task has to hold a vehicle's rows. ``by_digits`` finds
    the median without that map, for vehicles with too many distinct values for one task.
    """
    df = _with_delta(df)
    x = F.col("delta_sp")
    std = F.stddev_samp(x).alias("delta_sp_std")
    if by_digits:
        df = written_once(df, "explained")
        stats = df.groupBy(*p.keys).agg(std).join(exact_median(df, p.keys, "delta_sp", "delta_sp_median"), p.keys)
    else:
        stats = df.groupBy(*p.keys).agg(F.percentile(x, 0.5).alias("delta_sp_median"), std)
    return _flag_outliers(df.join(stats, p.keys), p)


def _neighbours(df: DataFrame, p: Params) -> DataFrame:
    """Add the tank maximum of the bins before and after, where they are of the same day."""
    order = Window.partitionBy(*p.keys).orderBy("timestamp")
    day = F.col("timestamp").cast("date")

    def near(fn) -> Column:
        return F.when(fn("timestamp").over(order).cast("date") == day, fn("max_fuel").over(order))

    return df.withColumns({"_next": near(F.lead), "_prev": near(F.lag)})


def _tank(df: DataFrame, many: bool) -> DataFrame:
    level = F.col("max_fuel")
    ahead, back = F.coalesce(F.col("_next") - level, F.lit(0.0)), level - F.col("_prev")
    if many:
        # The rows of one bin, one per norm, share its level: only the last steps to the next bin
        # and only the first comes from the one before.
        ahead = F.when(F.col("_last_norm"), ahead).otherwise(0.0)
        back = F.when(F.col("_first_norm"), back).otherwise(0.0)
    df = df.withColumns({"max_fuel_diff": ahead, "max_fuel_diff_back": back})
    falls = F.col("max_fuel_diff") < 0
    fell = F.coalesce(F.col("max_fuel_diff_back") < 0, F.lit(False))
    flags = {
        "is_max_fuel_diff_2": falls & (F.col("leak") <= -F.col("max_fuel_diff")),
        "is_max_fuel_diff": falls & fell,
    }
    return df.withColumns(flags).drop("_next", "_prev", "_first_norm", "_last_norm")


def tank_steps(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Add the change of the tank maximum to the next and from the previous bin of the day, and the
    two flags built on them. One row per vehicle and bin is expected."""
    return _tank(_neighbours(df, p), many=False)


def _mark_ends(norms: DataFrame) -> DataFrame:
    """Mark each vehicle's first and last norm. Both come from an aggregate that combines map-side,
    so a long norm history is never sorted in one task."""
    norms = norms.withColumn("_norm", _norm_order())
    ends = norms.groupBy("sl_avto").agg(F.min("_norm").alias("_lo"), F.max("_norm").alias("_hi"))
    marks = {"_first_norm": F.col("_norm") == F.col("_lo"), "_last_norm": F.col("_norm") == F.col("_hi")}
    return norms.join(ends, "sl_avto").withColumns(marks).drop("_norm", "_lo", "_hi")


def detect_leaks(
    df: DataFrame,
    norms: DataFrame,
    p: Params = Params(),
    sigma: bool = True,
    drop_null_engine: bool = False,
    policy: str = "fanout",
    by_digits: bool = False,
) -> DataFrame:
    """Flag drains in a series that already carries its vehicle (see ``attach_cars``).

    ``sigma=False, drop_null_engine=True`` gives the plain variant without per-vehicle statistics.

    The vehicle's window runs before the norms multiply its rows; nothing after that needs a vehicle's
    rows together.
    """
    many = policy == "fanout"
    df = attach_norms(_neighbours(consumed(df), p), _mark_ends(norms) if many else norms, policy)
    df = leak_volume(season_norm(df, p), p)
    if drop_null_engine:
        df = df.dropna(subset=["sl_tip_dvigat"])
    if sigma:
        df = leak_stats(df, p, by_digits)
    return _tank(df, many)


def leak_pipeline(
    telemetry: DataFrame,
    cars: DataFrame,
    norms: DataFrame,
    p: Params = Params(),
    org: str | None = None,
    **options,
) -> DataFrame:
    """Raw readings, vehicle table and norm table -> detection rows."""
    series = preprocess(normalise(telemetry, p), p)
    with_cars = attach_cars(series, org_cars(cars, org))
    return detect_leaks(with_cars, scoped_norms(norms, cars, org), p, **options)
