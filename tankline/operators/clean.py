"""Cleaning of raw readings and the cascade of tumbling windows.

Each step takes and returns a DataFrame, so the steps can be used alone; ``preprocess`` chains
them. Helper columns start with an underscore and never leave a public function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.bins import add_bin, seconds_between
from ..functions.values import nan_to_null, need
from ..params import Params
from ..schemas import FUEL, SPEED, VOLTAGE
from .layout import settle


def normalise(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Text key, wall-clock time, doubles without NaN, and an ingest order ``seq`` for ties.

    The level keeps a NaN: ``fuel_range`` drops it, and a bare column lets that filter reach the scan.
    """
    need(df, [*p.scope, "auto", "timestamp", FUEL, SPEED, VOLTAGE])
    seq = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
    return df.select(
        *p.scope,
        F.col("auto").cast("string").alias("auto"),
        F.col("timestamp").try_cast("timestamp_ntz").alias("timestamp"),
        F.col(FUEL).cast("double").alias(FUEL),
        *[nan_to_null(F.col(c)).alias(c) for c in (SPEED, VOLTAGE)],
        seq.alias("seq"),
    ).filter("auto IS NOT NULL AND timestamp IS NOT NULL")


def fuel_range(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Keep levels within the limits, both included. NaN, above every number, goes as well."""
    return df.filter(F.col(FUEL).between(p.fuel_min, p.fuel_max))


# ---- ordered steps ------------------------------------------------------------------------------


def _in_order(p: Params) -> WindowSpec:
    """Readings of one slot by time. Sorting by the gap bin first changes nothing in the order but
    lets the voltage maximum below reuse the same sort."""
    return Window.partitionBy(*p.keys, "_slot").orderBy("_gap", "timestamp", "seq")


def _with_slot(df: DataFrame, p: Params) -> DataFrame:
    return add_bin(add_bin(df, "_slot", p.slot_s), "_gap", p.gap_s)


def _with_slices(df: DataFrame, p: Params) -> DataFrame:
    """Add what a reading needs from its whole gap bin: the voltage maximum and, for the first
    reading of a sensor bin, the time of the reading before it."""
    rows = add_bin(add_bin(df, "_sensor", p.sensor_s), "_gap", p.gap_s)
    cell = [*p.keys, "_sensor"]
    facts = rows.groupBy(*cell, "_gap").agg(
        F.max(VOLTAGE).alias("_best"), F.max("timestamp").alias("_last")
    )
    gap_bin = Window.partitionBy(*p.keys, "_gap")
    facts = facts.select(
        *cell,
        F.max("_best").over(gap_bin).alias("voltage_max"),
        F.lag("_last").over(gap_bin.orderBy("_sensor")).alias("_carry_ts"),
    )
    return rows.join(facts, cell)


def _hours(df: DataFrame) -> DataFrame:
    """Hours next to seconds. Hours are linear in seconds, so sums need to carry only the seconds."""
    return df.withColumn("dtime_per_hour", F.col("dtime_s") / 3600)


def _gaps(df: DataFrame, p: Params) -> DataFrame:
    if p.layout == "slot":
        prev = F.lag("timestamp").over(_in_order(p))
        prev = F.when(prev >= F.col("_gap"), prev)
    else:
        order = Window.partitionBy(*p.keys, "_sensor").orderBy("timestamp", "seq")
        prev = F.coalesce(F.lag("timestamp").over(order), F.col("_carry_ts"))
    return df.withColumn("dtime_s", F.abs(seconds_between(prev, F.col("timestamp"))))


def _best_voltage(df: DataFrame, p: Params) -> DataFrame:
    if p.layout == "slice":
        return df
    return df.withColumn(
        "voltage_max", F.max(VOLTAGE).over(Window.partitionBy(*p.keys, "_slot", "_gap"))
    )


def _arranged(df: DataFrame, p: Params) -> DataFrame:
    return _with_slot(df, p) if p.layout == "slot" else _with_slices(df, p)


def _public(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def time_gap(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Add ``dtime_s`` and ``dtime_per_hour``: time since the previous reading of the gap bin."""
    p = settle(p)
    return _hours(_public(_gaps(_arranged(df, p), p)).drop("voltage_max"))


def voltage_max(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Add ``voltage_max``, the best voltage of the gap bin. A maximum needs no order, so it is
    pre-aggregated map-side and joined back; a hot bin then only meets a one-row partner."""
    rows = add_bin(df, "_gap", p.gap_s)
    best = rows.groupBy(*p.keys, "_gap").agg(F.max(VOLTAGE).alias("voltage_max"))
    return _public(rows.join(best, [*p.keys, "_gap"]))


def voltage_filter(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Keep readings less than ``voltage_drop`` below the best of their gap bin."""
    if "voltage_max" not in df.columns:
        df = voltage_max(df, p)
    return df.filter(F.col("voltage_max") - F.col(VOLTAGE) < p.voltage_drop)


def fuel_diff(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Add ``spent_fuel``: change of level since the previous reading of the diff bin."""
    p = settle(p)
    if p.layout == "slot":
        return _public(_steps(_with_slot(df, p), p))
    rows = add_bin(add_bin(df, "_sensor", p.sensor_s), "_diff", p.diff_s)
    cell = [*p.keys, "_sensor"]
    last = rows.groupBy(*cell, "_diff").agg(
        F.max_by(FUEL, F.struct("timestamp", "seq")).alias("_last")
    )
    carry = F.lag("_last").over(Window.partitionBy(*p.keys, "_diff").orderBy("_sensor"))
    rows = rows.join(last.select(*cell, carry.alias("_carry")), cell)
    order = Window.partitionBy(*cell).orderBy("timestamp", "seq")
    prev = F.coalesce(F.lag(FUEL).over(order), F.col("_carry"))
    return _public(rows.withColumn("spent_fuel", F.col(FUEL) - prev))


def _steps(df: DataFrame, p: Params) -> DataFrame:
    order = _in_order(p)
    df = df.withColumns({"_prev": F.lag(FUEL).over(order), "_prev_ts": F.lag("timestamp").over(order)})
    df = add_bin(df, "_diff", p.diff_s)
    same_bin = F.col("_prev_ts") >= F.col("_diff")
    return df.withColumn("spent_fuel", F.when(same_bin, F.col(FUEL) - F.col("_prev")))


# ---- cascade ------------------------------------------------------------------------------------


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0.0)).alias(name)


def _sensor_bins(df: DataFrame, p: Params) -> DataFrame:
    """Sensor bins of cleaned readings, with the helper columns of the layout still on."""
    levels = [F.median(FUEL).alias(FUEL), F.avg(SPEED).alias(SPEED)]
    times = [_total("dtime_s")]
    if p.layout == "slot":
        df = add_bin(_steps(df, p), "_sensor", p.sensor_s)
        return df.groupBy(*p.keys, "_slot", "_sensor").agg(*levels, _total("spent_fuel"), *times)
    # Steps inside a bin telescope: their sum is the last level minus the last level before the
    # bin, so only two levels per bin have to cross slices.
    at = F.struct("timestamp", "seq")
    ends = [F.min_by(FUEL, at).alias("_first"), F.max_by(FUEL, at).alias("_last")]
    bins = add_bin(
        df.groupBy(*p.keys, "_sensor").agg(*levels, *ends, *times), "_diff", p.diff_s, "_sensor"
    )
    before = F.lag("_last").over(Window.partitionBy(*p.keys, "_diff").orderBy("_sensor"))
    bins = bins.withColumn("spent_fuel", F.col("_last") - F.coalesce(before, F.col("_first")))
    return bins.drop("_first", "_last", "_diff")


def _pre_bins(bins: DataFrame, p: Params) -> DataFrame:
    slot = ["_slot"] if p.layout == "slot" else []
    bins = add_bin(bins, "_pre", p.pre_s, "_sensor")
    return bins.groupBy(*p.keys, *slot, "_pre").agg(
        F.median(SPEED).alias(SPEED),
        _total("spent_fuel"),
        F.max(FUEL).alias("max_fuel"),
        _total("dtime_s"),
    )


def parked_noise(df: DataFrame, p: Params = Params()) -> DataFrame:
    """A small gain while standing still is noise and counts as no change."""
    gain = F.col("spent_fuel")
    noise = (F.col(SPEED) == 0) & (gain > 0) & (gain < p.parked_noise)
    return df.withColumn("spent_fuel", F.when(noise, 0.0).otherwise(F.coalesce(gain, F.lit(0.0))))


def _period_bins(bins: DataFrame, p: Params) -> DataFrame:
    slot = ["_slot"] if p.layout == "slot" else []
    bins = add_bin(bins, "_period", p.period_s, "_pre")
    return bins.groupBy(*p.keys, *slot, "_period").agg(
        F.avg(SPEED).alias(SPEED),
        _total("spent_fuel"),
        F.max("max_fuel").alias("max_fuel"),
        _total("dtime_s"),
    )


def cleaned(df: DataFrame, p: Params) -> DataFrame:
    """In-range readings with gaps, minus those at low voltage; helper columns still on."""
    rows = _best_voltage(_gaps(_arranged(fuel_range(df, p), p), p), p)
    return rows.filter(F.col("voltage_max") - F.col(VOLTAGE) < p.voltage_drop)


def _labelled(df: DataFrame, p: Params, bin_col: str) -> DataFrame:
    rest = [c for c in df.columns if not c.startswith("_") and c not in p.keys]
    hours = (F.col("dtime_s") / 3600).alias("dtime_per_hour")
    return df.select(*p.keys, F.col(bin_col).alias("timestamp"), *rest, hours)


def bin_sensor(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Readings -> sensor bins (median level, mean speed, summed steps and gaps)."""
    p = settle(p)
    return _labelled(_sensor_bins(cleaned(df, p), p), p, "_sensor")


def bin_pre(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Readings -> middle bins, before the parked-noise rule."""
    p = settle(p)
    return _labelled(_pre_bins(_sensor_bins(cleaned(df, p), p), p), p, "_pre")


def bin_period(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Readings -> final bins, before travel and consumption are derived."""
    p = settle(p)
    pre = parked_noise(_pre_bins(_sensor_bins(cleaned(df, p), p), p), p)
    return _labelled(_period_bins(pre, p), p, "_period")


def preprocess(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Clean readings and roll them up to the final bins.

    ``spent_per_100`` is NULL where nothing was travelled.
    """
    travel = F.col(SPEED) * F.col("dtime_per_hour")
    return bin_period(df, p).withColumns(
        {"travel": travel, "spent_per_100": F.try_divide(F.col("spent_fuel"), travel) * 100}
    )


def preprocess_short(df: DataFrame, p: Params | None = None) -> DataFrame:
    """The short cascade: no distance columns and no gaps."""
    return bin_period(df, p or Params.short()).drop("dtime_s", "dtime_per_hour")
