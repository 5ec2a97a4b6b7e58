"""Report and metric questions."""

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators import reports as rep
from ..operators import rollups
from ..operators.clean import normalise, preprocess
from ..operators.entities import tenant_scope
from ..sources.scratch import written_once
from . import binding as b
from . import sqltext as q
from .book import query

P = b.WIDE
_BASE = f"WITH {q.CARS}, {q.REPORTS}"
_FROM = "FROM reports r JOIN cars c ON r.car = c.id WHERE r.status"
_DAY = "strftime(datetime, '%Y-%m-%d') AS day"
_PERIOD = "AND datetime >= TIMESTAMP '1996-03-01' AND datetime <= TIMESTAMP '1999-06-30'"
FRM, DUE = "1996-03-01", "1999-06-30"


def _ask(fn, spark, d, **options):
    return fn(b.reports(spark, d), b.cars(spark, d), **options)


@query("daily_leak_count", f"{_BASE} SELECT c.organization, {_DAY}, count(*) AS value {_FROM} GROUP BY ALL")
def daily_leak_count(spark, d):
    return _ask(rep.daily_leaks, spark, d)


@query(
    "daily_leak_sum",
    f"{_BASE} SELECT c.organization, {_DAY}, CAST(sum(volume) AS BIGINT) AS value {_FROM} GROUP BY ALL",
)
def daily_leak_sum(spark, d):
    return _ask(rep.daily_leaks, spark, d, measure="sum")


@query("daily_leak_count_period", f"{_BASE} SELECT c.organization, {_DAY}, count(*) AS value {_FROM} {_PERIOD} GROUP BY ALL")
def daily_leak_count_period(spark, d):
    return _ask(rep.daily_leaks, spark, d, frm=FRM, due=DUE)


@query(
    "daily_leak_count_tenant",
    f"{_BASE} SELECT {_DAY}, count(*) AS value {_FROM} AND c.organization = '7' GROUP BY ALL",
)
def daily_leak_count_tenant(spark, d):
    """What one tenant sees."""
    return _ask(rep.daily_leaks, spark, d, org="7")


_CAR = "r.car AS id, c.name AS label"


@query("car_leak_count", f"{_BASE} SELECT c.organization, {_CAR}, CAST(count(*) AS DOUBLE) AS value {_FROM} GROUP BY ALL")
def car_leak_count(spark, d):
    return _ask(rep.car_leaks, spark, d)


@query(
    "car_leak_volume",
    f"{_BASE} SELECT c.organization, {_CAR}, CAST(sum(volume) AS DOUBLE) AS value {_FROM} GROUP BY ALL",
)
def car_leak_volume(spark, d):
    return _ask(rep.car_leaks, spark, d, measure="sum")


@query(
    "car_leak_volume_period",
    f"{_BASE} SELECT c.organization, {_CAR}, CAST(sum(volume) AS DOUBLE) AS value {_FROM} {_PERIOD} GROUP BY ALL",
)
def car_leak_volume_period(spark, d):
    return _ask(rep.car_leaks, spark, d, frm=FRM, due=DUE, measure="sum")


@query(
    "tenant_reports",
    f"{_BASE} SELECT r.id, r.car, {q.t('r.datetime', 'datetime')}, r.volume, r.status FROM reports r JOIN cars c ON r.car = c.id WHERE c.organization = '7'",
)
def tenant_reports(spark, d):
    cols = ["id", "car", "datetime", "volume", "status"]
    return b.plain(tenant_scope(b.reports(spark, d), b.cars(spark, d), "7").select(*cols))


# ---- metrics ------------------------------------------------------------------------------------

_POINTS = f"""{q.cascade(P)}, points AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS organization, auto, timestamp, coalesce(pos_s, 0) AS pos_s,
         coalesce(max_fuel, 0) AS fuel, coalesce(spent_fuel, 0) AS spent_fuel
  FROM series JOIN customer ON auto = CAST(c_custkey AS VARCHAR))"""
_FROM_DAY, _DUE_DAY = "2024-01-03", "2024-01-30"
_SPAN = "timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-30 23:59:59'"


def _points(spark, d):
    series = preprocess(normalise(b.telemetry(spark, d), P), P)
    owner = b.cars(spark, d).selectExpr("id AS auto", "organization")
    joined = series.join(owner, "auto")
    return m.metric_points(joined, joined["organization"])


def _long(value: str) -> str:
    return f"""SELECT organization, auto, x, round(fuel + 1.23e-7, 6) + 0.0 AS y, 'fuel_level' AS metric FROM ({value})
UNION ALL SELECT organization, auto, x, round(pos_s + 1.23e-7, 6) + 0.0 AS y, 'speed' AS metric FROM ({value})"""


_X = "strftime({}, '%Y-%m-%d %H:%M:%S') AS x"
_RAW = f"SELECT organization, auto, {_X.format('timestamp')}, fuel, pos_s FROM points WHERE {_SPAN}"


@query("metrics_raw", f"WITH {_POINTS} {_long(_RAW)}")
def metrics_raw(spark, d):
    return b.plain(m.car_metrics(_points(spark, d), None, None, frm=_FROM_DAY, due=_DUE_DAY))


@query(
    "metrics_speed_of_car",
    f"WITH {_POINTS} SELECT {_X.format('timestamp')}, round(pos_s + 1.23e-7, 6) + 0.0 AS y, 'speed' AS metric FROM points WHERE {_SPAN} AND organization = '19' AND auto = '1'",
)
def metrics_speed_of_car(spark, d):
    """What the dashboard of one vehicle asks for."""
    return b.plain(m.car_metrics(_points(spark, d), "19", "1", "speed", _FROM_DAY, _DUE_DAY))


def _windowed(fn: str, end: str) -> str:
    label = f"least({end}, TIMESTAMP '2024-01-30 23:59:59')"
    return f"""SELECT organization, auto, {_X.format('e')}, {fn}(fuel) AS fuel, {fn}(pos_s) AS pos_s
FROM (SELECT *, {label} AS e FROM points WHERE {_SPAN}) GROUP BY organization, auto, e"""


def _clock_end(seconds: int) -> str:
    return f"{q.floor_to('timestamp', seconds)} + INTERVAL {seconds} SECOND"


@query("metrics_mean", f"WITH {_POINTS} {_long(_windowed('avg', _clock_end(7 * 86400)))}")
def metrics_mean(spark, d):
    return b.plain(m.car_metrics(_points(spark, d), None, None, "both", _FROM_DAY, _DUE_DAY, "1w", "mean"))


@query("metrics_median", f"WITH {_POINTS} {_long(_windowed('median', _clock_end(3 * 86400 + 43200)))}")
def metrics_median(spark, d):
    return b.plain(m.car_metrics(_points(spark, d), None, None, "both", _FROM_DAY, _DUE_DAY, "3d12h", "median"))


@query("metrics_sum", f"WITH {_POINTS} {_long(_windowed('sum', _clock_end(86400)))}")
def metrics_sum(spark, d):
    return b.plain(m.car_metrics(_points(spark, d), None, None, "both", _FROM_DAY, _DUE_DAY, "1d", "sum"))


_MONTH_END = "date_trunc('month', timestamp) + INTERVAL 1 MONTH"


@query("metrics_month", f"WITH {_POINTS} {_long(_windowed('avg', _MONTH_END))}")
def metrics_month(spark, d):
    return b.plain(m.car_metrics(_points(spark, d), None, None, "both", _FROM_DAY, _DUE_DAY, "1mo", "mean"))


@query(
    "metric_points",
    f"WITH {_POINTS} SELECT organization, auto, {q.t('timestamp')}, {q.r('pos_s', 'spent_fuel')}, round(fuel + 1.23e-7, 6) + 0.0 AS calc_sensors_fuel_level FROM points",
)
def metric_points(spark, d):
    return b.plain(_points(spark, d))


@query(
    "metrics_rollup",
    f"""WITH {q.TELEMETRY} SELECT CAST(CAST(auto AS INT) % 5 AS VARCHAR) AS organization, strftime(date_trunc('month', timestamp), '%Y-%m') AS month, count(*) AS n,
  {q.r('total', 'least', 'greatest')}, true AS median_within FROM (SELECT auto, timestamp, calc_sensors_fuel_level AS x FROM tele) GROUP BY ALL""".replace(
        q.r("total", "least", "greatest"), ", ".join(f"round({fn}(x) + {q.NUDGE}, {q.DIGITS}) + 0.0 AS {name}" for fn, name in (("sum", "total"), ("min", "least"), ("max", "greatest")))
    ),
)
def metrics_rollup(spark, d):
    """Months of tenants from the hours of their vehicles; the median's rank among all points is within the bound."""
    points = b.telemetry(spark, d).withColumn("organization", F.pmod(F.col("auto").cast("int"), F.lit(5)).cast("string"))
    hours = written_once(rollups.hourly(points), "hours")
    months = written_once(rollups.merged(hours, "month", ("organization",)).withColumn("median", rollups.quantile(0.5)), "months")
    month = rollups.PERIODS["month"](F.col("timestamp"))
    x, m = F.col(b.FUEL), F.col("median")
    ranks = points.join(months.select("organization", "start", "median"), (points["organization"] == months["organization"]) & (month == months["start"])).groupBy(months["organization"], "start").agg(
        F.avg((x < m).cast("double")).alias("below"), F.avg((x <= m).cast("double")).alias("upto")
    )
    within = (F.col("below") <= 0.5 + rollups.RANK_ERROR) & (F.col("upto") >= 0.5 - rollups.RANK_ERROR)
    out = months.join(ranks, ["organization", "start"]).select("organization", F.substring(F.col("start").cast("string"), 1, 7).alias("month"), "n", "total", "least", "greatest", within.alias("median_within"))
    return b.plain(out)
