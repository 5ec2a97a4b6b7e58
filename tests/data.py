"""Small inputs for the tests, and the cascade written out a second time, row by row."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

READING = "auto string, timestamp timestamp_ntz, calc_sensors_fuel_level double, pos_s double, calc_sensors_voltage double, seq long"
COLS = ["auto", "timestamp", "calc_sensors_fuel_level", "pos_s", "calc_sensors_voltage", "seq"]


def readings(spark, rows):
    """rows: (auto, time text, level, speed, voltage)"""
    full = [(a, datetime.fromisoformat(t), f, s, v, i) for i, (a, t, f, s, v) in enumerate(rows)]
    return spark.createDataFrame(full, READING)


def random_rows(n, cars=4, hot=0.0, seed=7, start="2024-06-15", span_s=4 * 3600):
    """Readings over four hours; ``hot`` is the share of the first vehicle."""
    rng = random.Random(seed)
    base = datetime.fromisoformat(start)
    rows = []
    for i in range(n):
        auto = "v0" if rng.random() < hot else f"v{rng.randrange(cars)}"
        at = base + timedelta(milliseconds=rng.randrange(span_s * 1000 // 250) * 250)
        level = rng.choice([None, -1.0, 5000.0]) if rng.random() < 0.05 else float(rng.randrange(100, 400))
        speed = None if rng.random() < 0.03 else float(rng.choice([0, 0, 0, 30, 60, 90]))
        volts = None if rng.random() < 0.02 else float(rng.randrange(20, 28))
        rows.append((auto, at, level, speed, volts, i))
    return rows


def brute(rows, sensor=10, pre=180, period=1800, gap=3600, diff=7200, drop=4.0, noise=8.0):
    """The cascade over plain tuples, one vehicle at a time."""
    def floor(t, s):
        us = int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        return datetime(1970, 1, 1) + timedelta(microseconds=us - us % (s * 1_000_000))

    def median(xs):
        xs = sorted(xs)
        k = len(xs)
        return None if not k else (xs[(k - 1) // 2] + xs[k // 2]) / 2

    def mean(xs):
        return sum(xs) / len(xs) if xs else None

    out = []
    for auto in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == auto and r[2] is not None and 0 <= r[2] <= 4096), key=lambda r: (r[1], r[5]))
        best = {}
        for r in mine:
            if r[4] is not None:
                best[floor(r[1], gap)] = max(best.get(floor(r[1], gap), r[4]), r[4])
        kept, prev = [], None
        for r in mine:
            g = (r[1] - prev).total_seconds() if prev and floor(prev, gap) == floor(r[1], gap) else None
            prev = r[1]
            if r[4] is not None and best[floor(r[1], gap)] - r[4] < drop:
                kept.append((r, g))
        steps, last = [], None
        for r, g in kept:
            s = r[2] - last[2] if last and floor(last[1], diff) == floor(r[1], diff) else None
            last = r
            steps.append((r, g, s))
        b1 = {}
        for r, g, s in steps:
            b1.setdefault(floor(r[1], sensor), []).append((r[2], r[3], s or 0.0, g or 0.0))
        b2 = {}
        for t, xs in b1.items():
            row = (median([x[0] for x in xs]), mean([x[1] for x in xs if x[1] is not None]), sum(x[2] for x in xs), sum(x[3] for x in xs))
            b2.setdefault(floor(t, pre), []).append(row)
        b3 = {}
        for t, xs in b2.items():
            speed = median([x[1] for x in xs if x[1] is not None])
            spent = sum(x[2] for x in xs)
            if speed == 0 and 0 < spent < noise:
                spent = 0.0
            b3.setdefault(floor(t, period), []).append((speed, spent, max(x[0] for x in xs), sum(x[3] for x in xs)))
        for t, xs in b3.items():
            speed = mean([x[0] for x in xs if x[0] is not None])
            dt = sum(x[3] for x in xs)
            spent = sum(x[1] for x in xs)
            travel = None if speed is None else speed * dt / 3600
            out.append((auto, t, speed, spent, max(x[2] for x in xs), dt, travel, spent / travel * 100 if travel else None))
    return out


SERIES = ["auto", "timestamp", "pos_s", "spent_fuel", "max_fuel", "dtime_s", "travel", "spent_per_100"]


class Near(float):
    """A double that equals its neighbours, so that the order of additions does not matter."""

    def __eq__(self, other):
        return isinstance(other, float) and math.isclose(self, other, rel_tol=1e-9, abs_tol=1e-9)

    __hash__ = None


def rounded(rows):
    """Rows in a fixed order, doubles compared with a tolerance, NaN as None."""

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else Near(x)
        return x

    return [tuple(map(cell, r)) for r in sorted(rows, key=lambda r: str(r[:2]))]


def series_rows(df):
    return rounded(tuple(r) for r in df.select(*SERIES).collect())


def fleet(spark, rows):
    """rows: (id, name, engine type, tenant)"""
    df = spark.createDataFrame(rows, "id string, name string, engine_type double, organization string")
    return df.withColumn("description", F.lit(""))


def norm_rows(spark, rows):
    """rows: (id, car, winter, summer, period)"""
    df = spark.createDataFrame(rows, "id string, car string, winter_volume double, summer_volume double, valid_period string")
    return df.withColumn("valid_period", F.col("valid_period").cast("date"))
