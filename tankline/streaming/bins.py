"""Streaming roll-up of level and speed through the three tumbling windows.

Watermarks need TIMESTAMP with a time zone. The wall clock is carried over as if it were UTC, by
arithmetic and not by the session zone, so bins fall where the batch cascade puts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..params import Params
from ..schemas import FUEL, SPEED
from ..operators.clean import fuel_range

_EPOCH = "1970-01-01 00:00:00"


def as_instant(ntz: Column) -> Column:
    """Wall clock -> the instant at which a UTC clock shows it."""
    since = ntz - F.lit(_EPOCH).cast("timestamp_ntz")
    return F.timestamp_micros((since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long"))


def as_wall_clock(instant: Column) -> Column:
    """The reverse of ``as_instant``."""
    seconds = (F.unix_micros(instant) / F.lit(1_000_000)).cast("decimal(20,6)")
    return F.lit(_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def stream_bins(readings: DataFrame, p: Params = Params(), watermark: str = "1 hour") -> DataFrame:
    """Readings (auto, timestamp, level, speed) -> final bins with mean speed and maximum level.

    Append mode: a bin comes out once the watermark has passed its end. Steps between readings are
    left out; they need the order of readings and belong to the upload job.
    """
    rows = fuel_range(readings, p).select(
        *p.keys, as_instant(F.col("timestamp")).alias("at"), FUEL, SPEED
    )
    rows = rows.withWatermark("at", watermark)

    def roll(df: DataFrame, seconds: int, time: Column, *aggs: Column) -> DataFrame:
        return df.groupBy(*p.keys, F.window(time, f"{seconds} seconds")).agg(*aggs)

    sensor = roll(rows, p.sensor_s, F.col("at"), F.median(FUEL).alias(FUEL), F.avg(SPEED).alias(SPEED))
    pre = roll(
        sensor, p.pre_s, F.window_time("window"), F.max(FUEL).alias("max_fuel"), F.median(SPEED).alias(SPEED)
    )
    final = roll(
        pre, p.period_s, F.window_time("window"), F.max("max_fuel").alias("max_fuel"), F.avg(SPEED).alias(SPEED)
    )
    return final.select(
        *p.keys, as_wall_clock(F.col("window.start")).alias("timestamp"), SPEED, "max_fuel"
    )


class LateRows(StreamingQueryListener):
    """Counts what queries drop for being older than the watermark, as they go.

    The numbers are of groups (readings of one bin that a task has already put together), as that is
    what the operators report. Register with ``spark.streams.addListener``.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        late = sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)
        key = str(event.progress.id)
        self.dropped[key] = self.dropped.get(key, 0) + late

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
