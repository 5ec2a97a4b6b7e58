"""Cleaning steps and the cascade over the readings."""

from ..functions.bins import add_bin
from ..operators import clean
from ..params import Params
from . import binding as b
from . import sqltext as q
from .book import query

P = b.WIDE
_ROW = ["auto", "timestamp", "seq"]
_ROW_SQL = f"auto, {q.t('timestamp')}, seq"


def _readings(spark, d):
    return clean.normalise(b.telemetry(spark, d), P)


def _in_range(spark, d):
    return clean.fuel_range(_readings(spark, d), P)


@query(
    "fuel_range_filter",
    f"WITH {q.TELEMETRY}, {q.RANGE} SELECT {_ROW_SQL}, {q.r('calc_sensors_fuel_level', 'pos_s', 'calc_sensors_voltage')} FROM r0",
)
def fuel_range_filter(spark, d):
    return b.plain(_in_range(spark, d))


@query(
    "time_gap",
    f"WITH {q.TELEMETRY}, {q.RANGE}, {q.gaps(P)} SELECT {_ROW_SQL}, {q.r('dtime_s')}, round(dtime_s / 3600 + 1.23e-7, 6) AS dtime_per_hour FROM r1",
)
def time_gap(spark, d):
    return b.plain(clean.time_gap(_in_range(spark, d), P).select(*_ROW, "dtime_s", "dtime_per_hour"))


@query(
    "voltage_max",
    f"WITH {q.TELEMETRY}, {q.RANGE}, {q.gaps(P)} SELECT {_ROW_SQL}, {q.r('voltage_max')} FROM r1",
)
def voltage_max(spark, d):
    return b.plain(clean.voltage_max(_in_range(spark, d), P).select(*_ROW, "voltage_max"))


@query(
    "voltage_drop_filter",
    f"WITH {q.TELEMETRY}, {q.RANGE}, {q.gaps(P)} SELECT {_ROW_SQL}, {q.r('calc_sensors_voltage', 'voltage_max')} FROM r1 WHERE voltage_max - calc_sensors_voltage < 4",
)
def voltage_drop_filter(spark, d):
    kept = clean.voltage_filter(_in_range(spark, d), P)
    return b.plain(kept.select(*_ROW, "calc_sensors_voltage", "voltage_max"))


@query(
    "fuel_diff",
    f"WITH {q.TELEMETRY}, {q.RANGE}, {q.gaps(P)}, {q.steps(P)} SELECT {_ROW_SQL}, {q.r('spent_fuel')} FROM r3",
)
def fuel_diff(spark, d):
    kept = clean.voltage_filter(_in_range(spark, d), P)
    return b.plain(clean.fuel_diff(kept, P).select(*_ROW, "spent_fuel"))


@query(
    "bin_10s",
    f"WITH {q.cascade(Params())} SELECT auto, {q.t('ts', 'timestamp')}, {q.r('pos_s', 'spent_fuel', 'dtime_s', 'dtime_per_hour')}, round(fuel + 1.23e-7, 6) AS calc_sensors_fuel_level FROM b1",
)
def bin_10s(spark, d):
    return b.plain(clean.bin_sensor(_readings(spark, d)))


@query(
    "bin_pre",
    f"WITH {q.cascade(P)} SELECT auto, {q.t('ts', 'timestamp')}, {q.r('pos_s', 'spent_fuel', 'max_fuel', 'dtime_s', 'dtime_per_hour')} FROM b2",
)
def bin_pre(spark, d):
    return b.plain(clean.bin_pre(_readings(spark, d), P))


@query(
    "bin_period",
    f"WITH {q.cascade(P)} SELECT auto, {q.t('timestamp')}, {q.r('pos_s', 'spent_fuel', 'max_fuel', 'dtime_s', 'dtime_per_hour')} FROM b3",
)
def bin_period(spark, d):
    return b.plain(clean.bin_period(_readings(spark, d), P))


_SERIES = q.r("pos_s", "spent_fuel", "max_fuel", "dtime_s", "dtime_per_hour", "travel", "spent_per_100")


@query("preprocess", f"WITH {q.cascade(P)} SELECT auto, {q.t('timestamp')}, {_SERIES} FROM series")
def preprocess(spark, d):
    return b.plain(clean.preprocess(_readings(spark, d), P))


@query("preprocess_standard", f"WITH {q.cascade(Params())} SELECT auto, {q.t('timestamp')}, {_SERIES} FROM series")
def preprocess_standard(spark, d):
    """The same with the standard widths: 10 s, 3 min, 30 min."""
    return b.plain(clean.preprocess(_readings(spark, d)))


@query("preprocess_sliced", f"WITH {q.cascade(P)} SELECT auto, {q.t('timestamp')}, {_SERIES} FROM series")
def preprocess_sliced(spark, d):
    """The layout for vehicles whose single slot is too big for a task."""
    return b.plain(clean.preprocess(_readings(spark, d), P.but(layout="slice")))


@query(
    "preprocess_short",
    f"WITH {q.cascade(Params.short())} SELECT auto, {q.t('timestamp')}, {q.r('pos_s', 'spent_fuel', 'max_fuel')} FROM b3",
)
def preprocess_short(spark, d):
    return b.plain(clean.preprocess_short(_readings(spark, d)))


@query(
    "parked_noise",
    f"WITH {q.TELEMETRY} SELECT {_ROW_SQL}, CASE WHEN pos_s = 0 AND calc_sensors_fuel_level > 0 AND calc_sensors_fuel_level < 800 THEN 0 ELSE calc_sensors_fuel_level END AS spent_fuel FROM tele",
)
def parked_noise(spark, d):
    """The parked-noise rule on raw rows, the level standing in for the gain."""
    rows = _readings(spark, d).withColumnRenamed("calc_sensors_fuel_level", "spent_fuel")
    return b.plain(clean.parked_noise(rows, P.but(parked_noise=800.0)).select(*_ROW, "spent_fuel"))


@query(
    "bin_floor",
    f"WITH {q.TELEMETRY} SELECT {_ROW_SQL}, "
    + ", ".join(f"strftime({q.floor_to('timestamp', s)}, '%Y-%m-%d %H:%M:%S.%f') AS bin_{s}" for s in (10, 3600, 7200, 604800))
    + " FROM tele",
)
def bin_floor(spark, d):
    rows = _readings(spark, d).select(*_ROW)
    for s in (10, 3600, 7200, 604800):
        rows = add_bin(rows, f"bin_{s}", s)
    return b.plain(rows)
