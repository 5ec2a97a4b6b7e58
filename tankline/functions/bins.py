"""Epoch-aligned time bins, exact gaps and window-length parsing.

All of it works on TIMESTAMP_NTZ, so neither the session time zone nor a daylight-saving change
moves a bin or stretches a gap.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_bin(df: DataFrame, name: str, seconds: int, ts: str = "timestamp") -> DataFrame:
    """Add the start of the ``seconds``-wide bin holding ``ts``; rows without a time are dropped."""
    return df.withColumn(name, F.window(F.col(ts), f"{seconds} seconds")["start"])


def seconds_between(earlier: Column, later: Column) -> Column:
    """Wall-clock gap in seconds as a double. Unlike timestampdiff it never passes through a zone."""
    return (later - earlier).cast("interval second").cast("decimal(18,6)").cast("double")


# Length of each duration unit, in microseconds or calendar months.
MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
    "w": 604_800_000_000,
}
MONTHS = {"mo": 1, "y": 12}

_PART = re.compile(r"(\d+)(mo|us|ms|s|m|h|d|w|y)")


def parse_every(text: str) -> tuple[int, int]:
    """``"1h30m"`` -> (0 months, microseconds); ``"1mo"`` -> (1, 0). Anything else is refused."""
    parts = _PART.findall(text or "")
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a window length: {text!r}")
    months = sum(int(n) * MONTHS[u] for n, u in parts if u in MONTHS)
    micros = sum(int(n) * MICROS[u] for n, u in parts if u in MICROS)
    if (months > 0) == (micros > 0):
        raise ValueError(f"window length must be all calendar or all clock units, and above 0: {text!r}")
    return months, micros


def add_window_end(df: DataFrame, name: str, every: str, ts: str = "timestamp") -> DataFrame:
    """Add the end of the epoch-aligned window of length ``every`` that holds ``ts``."""
    months, micros = parse_every(every)
    if micros:
        return df.withColumn(name, F.window(F.col(ts), f"{micros} microseconds")["end"])
    since_epoch = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    next_edge = since_epoch - F.pmod(since_epoch, F.lit(months)) + months
    day = F.add_months(F.lit("1970-01-01").cast("date"), next_edge)
    return df.withColumn(name, day.cast("timestamp_ntz"))
