"""Building blocks of the comparison SQL."""

from __future__ import annotations

from ..params import Params


# How doubles are rounded when two engines are compared. Sums in another order differ in the last
# bits; the nudge keeps values that lie exactly between two roundings, like a travel of 3.0000005,
# off that edge.
DIGITS, NUDGE = 6, 1.23e-7


def r(*names: str) -> str:
    """Rounded doubles, without a negative zero."""
    return ", ".join(f"round({n} + {NUDGE}, {DIGITS}) + 0.0 AS {n.split('.')[-1]}" for n in names)


def t(name: str, alias: str | None = None) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or name}"


def floor_to(ts: str, seconds: int) -> str:
    us = seconds * 1_000_000
    return f"make_timestamp(epoch_us({ts}) - epoch_us({ts}) % {us})"


TELEMETRY = """tele AS (
  SELECT CAST(user_id AS VARCHAR) AS auto, ts AS timestamp, floor(value * 40) AS calc_sensors_fuel_level,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS pos_s,
         CAST(24 + event_id % 7 AS DOUBLE) AS calc_sensors_voltage, event_id AS seq, event_type AS upload_id
  FROM events)"""

RANGE = "r0 AS (SELECT * FROM tele WHERE calc_sensors_fuel_level BETWEEN 0 AND 4096)"


def gaps(p: Params, keys: str = "auto") -> str:
    return f"""r1 AS (
  SELECT *, abs(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (
              PARTITION BY {keys}, {floor_to('timestamp', p.gap_s)} ORDER BY timestamp, seq)) / 1e6 AS dtime_s,
         max(calc_sensors_voltage) OVER (PARTITION BY {keys}, {floor_to('timestamp', p.gap_s)}) AS voltage_max
  FROM r0)"""


def steps(p: Params, keys: str = "auto", source: str = "r1") -> str:
    return f"""r2 AS (SELECT * FROM {source} WHERE voltage_max - calc_sensors_voltage < {p.voltage_drop}),
r3 AS (
  SELECT *, calc_sensors_fuel_level - lag(calc_sensors_fuel_level) OVER (
              PARTITION BY {keys}, {floor_to('timestamp', p.diff_s)} ORDER BY timestamp, seq) AS spent_fuel
  FROM r2)"""


def cascade(p: Params, keys: str = "auto") -> str:
    """CTEs up to ``series``: the preprocessed rows."""
    return f"""{TELEMETRY}, {RANGE}, {gaps(p, keys)}, {steps(p, keys)},
b1 AS (
  SELECT {keys}, {floor_to('timestamp', p.sensor_s)} AS ts, median(calc_sensors_fuel_level) AS fuel,
         avg(pos_s) AS pos_s, coalesce(sum(spent_fuel), 0) AS spent_fuel,
         coalesce(sum(dtime_s), 0) AS dtime_s, coalesce(sum(dtime_s / 3600), 0) AS dtime_per_hour
  FROM r3 GROUP BY ALL),
b2 AS (
  SELECT {keys}, {floor_to('ts', p.pre_s)} AS ts, median(pos_s) AS pos_s, sum(spent_fuel) AS spent_fuel,
         max(fuel) AS max_fuel, sum(dtime_s) AS dtime_s, sum(dtime_per_hour) AS dtime_per_hour
  FROM b1 GROUP BY {keys}, {floor_to('ts', p.pre_s)}),
b2n AS (
  SELECT * REPLACE (CASE WHEN pos_s = 0 AND spent_fuel > 0 AND spent_fuel < {p.parked_noise}
                         THEN 0 ELSE spent_fuel END AS spent_fuel) FROM b2),
b3 AS (
  SELECT {keys}, {floor_to('ts', p.period_s)} AS timestamp, avg(pos_s) AS pos_s, sum(spent_fuel) AS spent_fuel,
         max(max_fuel) AS max_fuel, sum(dtime_s) AS dtime_s, sum(dtime_per_hour) AS dtime_per_hour
  FROM b2n GROUP BY {keys}, {floor_to('ts', p.period_s)}),
series AS (
  SELECT *, pos_s * dtime_per_hour AS travel,
         spent_fuel / nullif(pos_s * dtime_per_hour, 0) * 100 AS spent_per_100 FROM b3)"""


CARS = """cars AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS description,
         CAST(c_custkey % 2 AS DOUBLE) AS engine_type, CAST(c_nationkey AS VARCHAR) AS organization
  FROM customer)"""

NORMS = """norms AS (
  SELECT CAST(c_custkey AS VARCHAR) AS norm_id, CAST(c_custkey AS VARCHAR) AS sl_avto,
         CAST(10 + c_custkey % 5 AS DOUBLE) AS norma_rasx_winter,
         CAST(8 + c_custkey % 4 AS DOUBLE) AS norma_rasx_summer, DATE '2024-12-31' AS period
  FROM customer)"""

NORM_HISTORY = """norms AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS norm_id, CAST(o_custkey AS VARCHAR) AS sl_avto,
         CAST(10 + o_orderkey % 5 AS DOUBLE) AS norma_rasx_winter,
         CAST(8 + o_orderkey % 4 AS DOUBLE) AS norma_rasx_summer, CAST(o_orderdate AS DATE) AS period
  FROM orders)"""

LATEST = """norms_latest AS (
  SELECT * FROM norms QUALIFY row_number() OVER (PARTITION BY sl_avto ORDER BY period DESC, norm_id DESC) = 1)"""


def detection(p: Params, norms: str = "norms", keys: str = "") -> str:
    """CTEs after ``series``, ``cars`` and a norm CTE, up to ``leaks``. ``keys`` is an extra key."""
    more = f"{keys}, " if keys else ""
    return f"""d1 AS (
  SELECT s.* REPLACE (abs(least(s.spent_fuel, 0)) AS spent_fuel), c.id, c.name, c.engine_type AS sl_tip_dvigat,
         c.organization, n.* FROM series s JOIN cars c ON s.auto = c.id JOIN {norms} n ON s.auto = n.sl_avto),
d2 AS (
  SELECT * EXCLUDE (spent_per_100), spent_fuel * 100 / nullif(travel, 0) AS spent_per_100,
         CASE WHEN month(timestamp) BETWEEN {p.summer_months[0]} AND {p.summer_months[1]}
              THEN norma_rasx_summer ELSE norma_rasx_winter END AS norma_rasx FROM d1),
d3 AS (
  SELECT *, norma_rasx * travel / 100 * pow(pos_s / {p.speed_ref}, 3.0) AS norma_rasx_per_travel FROM d2),
d4 AS (
  SELECT *, CASE WHEN travel = 0 AND spent_fuel >= CAST(1.17 AS DOUBLE) / 6 AND sl_tip_dvigat = 0
                 THEN abs(spent_fuel - CAST(1.17 AS DOUBLE) / 6)
                 WHEN travel = 0 AND spent_fuel >= CAST(1.17 AS DOUBLE) / 6 AND sl_tip_dvigat = 1
                 THEN abs(spent_fuel - CAST(1 AS DOUBLE) / 6)
                 ELSE greatest(0, spent_fuel - norma_rasx_per_travel) END AS leak,
         spent_fuel - norma_rasx_per_travel AS delta_sp FROM d3),
d5 AS (
  SELECT *, leak > {p.leak_limit} AS is_leak,
         median(delta_sp) OVER (PARTITION BY {more}id) AS delta_sp_median,
         stddev_samp(delta_sp) OVER (PARTITION BY {more}id) AS delta_sp_std,
         coalesce(lead(max_fuel) OVER w - max_fuel, 0) AS max_fuel_diff,
         max_fuel - lag(max_fuel) OVER w AS max_fuel_diff_back
  FROM d4 WINDOW w AS (PARTITION BY {more}id, CAST(timestamp AS DATE) ORDER BY timestamp, period, norm_id)),
leaks AS (
  SELECT *, coalesce(delta_sp >= delta_sp_median + {p.sigma} * delta_sp_std AND leak >= {p.leak_limit}, false)
              AS is_leak_delta_sp,
         max_fuel_diff < 0 AND leak <= -max_fuel_diff AS is_max_fuel_diff_2,
         max_fuel_diff < 0 AND coalesce(max_fuel_diff_back < 0, false) AS is_max_fuel_diff
  FROM d5)"""


REPORTS = """reports AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS car, o_orderdate AS datetime,
         CAST(trunc(o_totalprice / 1000) AS INTEGER) AS volume, o_orderstatus = 'F' AS status
  FROM orders)"""

ORGS = """orgs AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name,
         CASE WHEN length(n_name) < 9 THEN n_name || ':' || n_regionkey END AS bot_token,
         CAST(n_regionkey AS VARCHAR) AS chat_id FROM nation)"""

UPLOADS = """uploads AS (
  SELECT doc_id AS id, source AS organization,
         CASE WHEN quality = 1 THEN 'completed' WHEN quality = 0 THEN 'error' ELSE 'created' END AS status,
         lang || '.csv' AS filename, CAST(n_chars AS INTEGER) AS size,
         CASE WHEN lang = 'en' THEN 'raw' WHEN lang = 'de' THEN 'norm' ELSE 'auto' END AS type,
         sha256(text) AS file_hash
  FROM documents LEFT JOIN labels USING (doc_id))"""

DRIVERS = """drivers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS fullname, CAST(s_nationkey AS VARCHAR) AS address,
         '+7' || s_suppkey AS phone FROM supplier),
links AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS driver, CAST(l_partkey AS VARCHAR) AS car FROM lineitem)"""
