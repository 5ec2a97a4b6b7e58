"""Vehicle and norm joins, drain detection and its parts."""

from pyspark.sql import functions as F

from ..operators import leaks, quantiles
from ..operators.clean import normalise, preprocess
from ..operators.reports import daily_leaks, leak_reports
from . import binding as b
from . import sqltext as q
from .book import query

P = b.WIDE


def _series(spark, d):
    return preprocess(normalise(b.telemetry(spark, d), P), P)


def _with_cars(spark, d):
    return leaks.attach_cars(_series(spark, d), leaks.org_cars(b.cars(spark, d)))


def _norms(spark, d, source=b.norms):
    return leaks.org_norms(source(spark, d), b.cars(spark, d))


def _detect(spark, d, source=b.norms, **options):
    return leaks.detect_leaks(_with_cars(spark, d), _norms(spark, d, source), P, **options)


@query(
    "merge_cars",
    f"WITH {q.cascade(P)}, {q.CARS} SELECT auto, {q.t('timestamp')}, id, name, engine_type AS sl_tip_dvigat, organization, {q.r('spent_fuel', 'travel')} FROM series JOIN cars ON auto = id",
)
def merge_cars(spark, d):
    cols = ["auto", "timestamp", "id", "name", "sl_tip_dvigat", "organization", "spent_fuel", "travel"]
    return b.plain(_with_cars(spark, d).select(*cols))


@query(
    "season_norm",
    f"WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)} SELECT auto, {q.t('timestamp')}, {q.r('norma_rasx', 'norma_rasx_per_travel')} FROM d3",
)
def season_norm(spark, d):
    joined = leaks.attach_norms(_with_cars(spark, d), _norms(spark, d))
    out = leaks.season_norm(joined, P)
    return b.plain(out.select("auto", "timestamp", "norma_rasx", "norma_rasx_per_travel"))


@query(
    "norm_fanout",
    f"WITH {q.cascade(P)}, {q.NORM_HISTORY} SELECT auto, {q.t('timestamp')}, norm_id, strftime(period, '%Y-%m-%d') AS period, norma_rasx_summer, norma_rasx_winter FROM series JOIN norms ON auto = sl_avto",
)
def norm_fanout(spark, d):
    out = leaks.attach_norms(_series(spark, d), _norms(spark, d, b.norm_history))
    return b.plain(out.select("auto", "timestamp", "norm_id", "period", "norma_rasx_summer", "norma_rasx_winter"))


@query(
    "norm_latest",
    f"WITH {q.NORM_HISTORY}, {q.LATEST} SELECT sl_avto, norm_id, strftime(period, '%Y-%m-%d') AS period, norma_rasx_summer, norma_rasx_winter FROM norms_latest",
)
def norm_latest(spark, d):
    return b.plain(leaks.latest_norm(_norms(spark, d, b.norm_history)))


@query(
    "consumed_fuel",
    f"WITH {q.cascade(P)} SELECT auto, {q.t('timestamp')}, round(abs(least(spent_fuel, 0)) + 1.23e-7, 6) + 0.0 AS spent_fuel FROM series",
)
def consumed_fuel(spark, d):
    return b.plain(leaks.consumed(_series(spark, d)).select("auto", "timestamp", "spent_fuel"))


_DOUBLES = (
    "pos_s", "spent_fuel", "max_fuel", "dtime_s", "travel", "spent_per_100", "norma_rasx",
    "norma_rasx_per_travel", "leak", "max_fuel_diff", "max_fuel_diff_back",
)
_FLAGS = ("is_leak", "is_max_fuel_diff_2", "is_max_fuel_diff")
_STATS = ("delta_sp", "delta_sp_median", "delta_sp_std")
_ID = ("auto", "timestamp", "id", "name", "sl_tip_dvigat", "organization", "norm_id")
_PLAIN_SQL = f"auto, {q.t('timestamp')}, id, name, sl_tip_dvigat, organization, norm_id, {q.r(*_DOUBLES)}, {', '.join(_FLAGS)}"
_FULL_SQL = f"{_PLAIN_SQL}, {q.r(*_STATS)}, is_leak_delta_sp"
_FULL = (*_ID, *_DOUBLES, *_FLAGS, *_STATS, "is_leak_delta_sp")


@query("detect_leaks", f"WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)} SELECT {_FULL_SQL} FROM leaks")
def detect_leaks(spark, d):
    return b.plain(_detect(spark, d).select(*_FULL))


@query(
    "detect_leaks_fanout",
    f"WITH {q.cascade(P)}, {q.CARS}, {q.NORM_HISTORY}, {q.detection(P)} SELECT {_FULL_SQL} FROM leaks",
)
def detect_leaks_fanout(spark, d):
    return b.plain(_detect(spark, d, b.norm_history).select(*_FULL))


@query(
    "detect_leaks_latest",
    f"WITH {q.cascade(P)}, {q.CARS}, {q.NORM_HISTORY}, {q.LATEST}, {q.detection(P, 'norms_latest')} SELECT {_FULL_SQL} FROM leaks",
)
def detect_leaks_latest(spark, d):
    return b.plain(_detect(spark, d, b.norm_history, policy="latest").select(*_FULL))


@query(
    "detect_leaks_plain",
    f"WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)} SELECT {_PLAIN_SQL} FROM leaks WHERE sl_tip_dvigat IS NOT NULL",
)
def detect_leaks_plain(spark, d):
    found = _detect(spark, d, sigma=False, drop_null_engine=True)
    return b.plain(found.select(*_ID, *_DOUBLES, *_FLAGS))


@query(
    "leak_stats",
    f"WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)} SELECT id, {q.t('timestamp')}, {q.r(*_STATS)}, is_leak_delta_sp FROM leaks",
)
def leak_stats(spark, d):
    return b.plain(_detect(spark, d).select("id", "timestamp", *_STATS, "is_leak_delta_sp"))


@query(
    "leak_stats_by_digits",
    f"WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)} SELECT id, {q.t('timestamp')}, {q.r(*_STATS)}, is_leak_delta_sp FROM leaks",
)
def leak_stats_by_digits(spark, d):
    """The same statistics, the median found digit by digit."""
    return b.plain(_detect(spark, d, by_digits=True).select("id", "timestamp", *_STATS, "is_leak_delta_sp"))


@query("fleet_median", f"WITH {q.TELEMETRY} SELECT upload_id AS event_type, {q.r('m')} FROM (SELECT upload_id, median(calc_sensors_fuel_level) AS m FROM tele GROUP BY ALL)")
def fleet_median(spark, d):
    """Medians of a few keys that hold all readings."""
    rows = b.telemetry(spark, d, F.col("event_type"))
    return b.plain(quantiles.exact_median(rows, ["event_type"], b.FUEL, "m"))


# With one bin per vehicle and day nothing precedes or follows within the day, so tank steps run on
# the bins of six hours.
_STEP = b.WIDE.but(period_s=b.WIDE.pre_s)


@query(
    "max_fuel_steps",
    f"WITH {q.cascade(_STEP)}, {q.CARS}, {q.NORMS}, {q.detection(_STEP)} SELECT id, {q.t('timestamp')}, {q.r('max_fuel', 'leak', 'max_fuel_diff', 'max_fuel_diff_back')}, is_max_fuel_diff_2, is_max_fuel_diff FROM leaks",
)
def max_fuel_steps(spark, d):
    series = preprocess(normalise(b.telemetry(spark, d), _STEP), _STEP)
    with_cars = leaks.attach_cars(series, leaks.org_cars(b.cars(spark, d)))
    out = leaks.detect_leaks(with_cars, _norms(spark, d), _STEP)
    cols = ["max_fuel", "leak", "max_fuel_diff", "max_fuel_diff_back", "is_max_fuel_diff_2", "is_max_fuel_diff"]
    return b.plain(out.select("id", "timestamp", *cols))


@query(
    "leak_reports",
    f"WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)} SELECT auto AS car, {q.t('timestamp', 'datetime')}, CAST(trunc(leak) AS INTEGER) AS volume, is_leak AS status FROM leaks WHERE is_leak",
)
def flagged_reports(spark, d):
    return b.plain(leak_reports(_detect(spark, d), "u1").drop("id", "upload_id"))


@query(
    "drains_per_day",
    f"""WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)}
SELECT organization, strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS value FROM leaks WHERE is_leak GROUP BY ALL""",
)
def drains_per_day(spark, d):
    """From raw readings to suspected drains per tenant and day."""
    # drains need no statistics of the vehicle
    found = leaks.leak_pipeline(b.telemetry(spark, d), b.cars(spark, d), b.norms(spark, d), P, sigma=False)
    return daily_leaks(leak_reports(found, "u1"), b.cars(spark, d))


@query(
    "detect_leaks_tenant",
    f"WITH {q.cascade(P)}, {q.CARS}, {q.NORM_HISTORY}, {q.detection(P)} SELECT {_FULL_SQL} FROM leaks WHERE organization = '7'",
)
def detect_leaks_tenant(spark, d):
    """The whole pipeline for one tenant: its vehicles and their norms only."""
    found = leaks.leak_pipeline(b.telemetry(spark, d), b.cars(spark, d), b.norm_history(spark, d), P, org="7")
    return b.plain(found.select(*_FULL))


@query(
    "drained_volume_per_car",
    f"""WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)}
SELECT id, name, CAST(sum(trunc(leak)) AS BIGINT) AS volume, count(*) AS drains FROM leaks WHERE is_leak GROUP BY ALL""",
)
def drained_volume_per_car(spark, d):
    found = _detect(spark, d).filter("is_leak")
    return found.groupBy("id", "name").agg(
        F.sum(F.col("leak").cast("int")).alias("volume"), F.count("*").alias("drains")
    )


# Readings with quarter litres and without speed or voltage; vehicles of unknown and of other engine types.
_ODD_CARS = q.CARS.replace("CAST(c_custkey % 2 AS DOUBLE) AS engine_type", "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 3 THEN 2.0 ELSE CAST(c_custkey % 2 AS DOUBLE) END AS engine_type")
_ODD_TELEMETRY = (
    q.TELEMETRY.replace("floor(value * 40)", "floor(value * 160) / 4")
    .replace("CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)", "CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 13 <> 1 THEN CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) END")
    .replace("CAST(24 + event_id % 7 AS DOUBLE)", "CASE WHEN event_id % 17 <> 1 THEN CAST(24 + event_id % 7 AS DOUBLE) END")
)
_ODD = f"WITH {q.cascade(P).replace(q.TELEMETRY, _ODD_TELEMETRY)}, {_ODD_CARS}, {q.NORMS}, {q.detection(P)}"


def _odd(spark, d, **options):
    events = b.table(spark, d, "events")
    n = F.col("event_id")
    speed = F.when(n % 3 == 0, 0.0).when(n % 13 != 1, F.col(b.SPEED))
    rows = b.readings_of(events, n, "value").withColumns({b.FUEL: F.floor(F.col("value") * 160) / 4, b.SPEED: speed, b.VOLTAGE: F.when(n % 17 != 1, F.col(b.VOLTAGE))})
    key = F.col("id").cast("int")
    cars = b.cars(spark, d).withColumn("engine_type", F.when(key % 5 == 3, 2.0).when(key % 5 != 0, F.col("engine_type")))
    return leaks.leak_pipeline(rows.drop("event_id", "value"), cars, b.norms(spark, d), P, **options)


@query("detect_leaks_odd", f"{_ODD} SELECT {_FULL_SQL} FROM leaks")
def detect_leaks_odd(spark, d):
    """Detection where speeds, voltages and engine types are missing."""
    return b.plain(_odd(spark, d).select(*_FULL))


@query("detect_leaks_plain_odd", f"{_ODD} SELECT {_PLAIN_SQL} FROM leaks WHERE sl_tip_dvigat IS NOT NULL")
def detect_leaks_plain_odd(spark, d):
    """The plain variant leaves out vehicles of unknown engine type."""
    return b.plain(_odd(spark, d, sigma=False, drop_null_engine=True).select(*_ID, *_DOUBLES, *_FLAGS))
