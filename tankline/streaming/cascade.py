"""The whole cleaning cascade over a stream of readings: gaps, best voltage, steps and all bins.

All windows and bins of the cascade nest in slots (``Params.slot_s``), so a slot of a vehicle can be
worked on alone. Vehicles are dealt by a hash to ``shares``, and keyed state (``transformWithState``)
gathers the readings of each share and slot: what a key costs is paid for many vehicles together, and
their readings are handled as columns. A timer closes a slot once the stream has passed its end by
``delay`` seconds, and its readings go on together. The batch cascade then runs on the slots that a
micro-batch has closed, so both give the same rows.

Spark hands rows to keyed state in Python one by one, so each task first puts its readings of a share and
slot together in packets (Arrow batches), and the state takes packets.

A reading is late if its slot is closed. Late readings go to a side table for ``late_for`` seconds of
stream time after the slot has closed. Spark drops packets that hold only readings behind the watermark, and
tells how many (``bins.LateRows``; here the numbers are of packets). What shares a packet with a newer
reading of its slot still comes to the side table.

The watermark runs behind the newest reading by the delay, a slot and ``late_for``: no reading of an open
slot is ever behind it. State of a share is what its vehicles have in open slots, and one flag for each
closed slot until the watermark has passed the slot. It lives in RocksDB and in the checkpoint. A task
holds the readings that one share has in a slot, so the number of shares bounds its memory; a checkpoint
goes on only with the number it began with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.clean import fuel_range, normalise, preprocess
from ..params import Params
from ..schemas import FUEL, SPEED, VOLTAGE
from ..sources.scratch import written_once
from .bins import as_instant

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_READING = pa.schema([("auto", pa.string()), ("micros", pa.int64()), *((c, pa.float64()) for c in (FUEL, SPEED, VOLTAGE)), ("seq", pa.int64())])
_PACKET = pa.schema([("newest", pa.int64()), ("rows", pa.binary())])
SHARES = 256  # of the vehicles; each has a state for every open slot
PACK = 1 << 19  # readings that a task puts together at once


def _packed(rows: pd.DataFrame) -> bytes:
    columns = [rows[f.name].to_numpy(np.float64, na_value=np.nan) if f.type == pa.float64() else rows[f.name] for f in _READING]
    arrays = [pa.array(c, f.type, from_pandas=f.type != pa.float64()) for f, c in zip(_READING, columns)]
    return pa.RecordBatch.from_arrays(arrays, schema=_READING).serialize().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(data), _READING)


def _packets(scope: tuple[str, ...]):
    """Rows with share and slot as packets: the keys, the time of the newest reading, and the readings."""
    keys = [*scope, "share", "slot"]

    def put_together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        codes = [rows.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy() for k in keys]
        order = np.lexsort(codes)
        edges = np.flatnonzero(np.logical_or.reduce([np.diff(c[order], prepend=-2) != 0 for c in codes]))
        rows = rows.take(pa.array(order)).combine_chunks()
        readings = rows.select(_READING.names).cast(_READING).to_batches()[0]
        ends = [*edges[1:].tolist(), len(order)]
        packets = [readings.slice(x, y - x).serialize().to_pybytes() for x, y in zip(edges.tolist(), ends)]
        newest = np.maximum.reduceat(readings.column("micros").to_numpy(), edges)
        first = rows.select(keys).take(pa.array(edges)).combine_chunks()
        columns = [*(c.combine_chunks() for c in first.columns), pa.array(newest), pa.array(packets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, *_PACKET.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACK:
                yield put_together(held)
                held, n = [], 0
        if held:
            yield put_together(held)

    return run


class SlotKeeper(StatefulProcessor):
    """Readings of one share of the vehicles and one slot, until the slot closes."""

    def __init__(self, scope: tuple[str, ...], slot_ms: int, late_ms: int):
        self.scope, self.slot_ms, self.late_ms = scope, slot_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one entry for each micro-batch that has readings of the slot
        self.held = handle.getListState("held", T.StructType([T.StructField("rows", T.BinaryType())]))
        self.closed = handle.getValueState("closed", T.StructType([T.StructField("closed", T.BooleanType())]))

    def _closes(self, key) -> int:
        """The watermark at which the slot closes."""
        return key[-1] - self.late_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed, empty = self.closed.exists(), not self.held.exists()
        over = closed or timerValues.getCurrentWatermarkInMs() > self._closes(key)
        # a slot that this micro-batch closes still takes in the vehicles it has
        waits = {x for (rows_,) in self.held.get() for x in _unpacked(rows_).column("auto").unique().to_pylist()} if over and not closed and not empty else set()
        for some in rows:
            if over:
                late = ~some["auto"].isin(waits)
                if late.any():
                    yield self._given(key, some[late], late=True)
                some = some[~late]
            if not len(some):
                continue
            if empty:
                self.handle.registerTimer(max(1, self._closes(key)))
                empty = False
            self.held.appendValue((_packed(some),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.closed.exists():  # the watermark has passed the slot: nothing of it comes any more
            self.closed.clear()
            return
        for (rows,) in self.held.get():
            yield self._kept(key, rows)
        self.held.clear()
        self.closed.update((True,))
        self.handle.registerTimer(key[-1] + self.slot_ms)

    def _kept(self, key, rows: bytes) -> pd.DataFrame:
        return self._given(key, _unpacked(rows).to_pandas(), late=False)

    def _given(self, key, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        out = pd.DataFrame({k: [v] * len(rows) for k, v in zip(self.scope, key)})
        for name in _READING.names:
            out[name] = rows[name].to_numpy()
        return out.assign(late=late)

    def close(self) -> None:
        pass


class PacketKeeper(SlotKeeper):
    """As ``SlotKeeper``, for readings in packets; gives packets. Only those of a slot that is over are opened."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            readings = pa.Table.from_batches([_unpacked(x) for x in some["rows"]])
            if timerValues.getCurrentWatermarkInMs() >= self._closes(key):
                yield from super().handleInputRows(key, iter([readings.to_pandas()]), timerValues)
                continue
            if not self.held.exists():
                self.handle.registerTimer(max(1, self._closes(key)))
            self.held.appendValue((readings.combine_chunks().to_batches()[0].serialize().to_pybytes(),))

    def _kept(self, key, rows: bytes) -> pd.DataFrame:
        return self._packet(key, rows, late=False)

    def _given(self, key, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        return self._packet(key, _packed(rows), late)

    def _packet(self, key, rows: bytes, late: bool) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(self.scope, key)}, "rows": [rows], "late": [late]})


def _opened(scope: tuple[str, ...]):
    """The readings of packets, with the scope and ``late`` of their packet."""
    own = [*scope, "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, rows in enumerate(batch.column("rows").to_pylist()):
                readings = _unpacked(rows)
                again = pa.array(np.full(len(readings), n))
                yield pa.RecordBatch.from_arrays([*readings.columns, *(batch.column(k).take(again) for k in own)], names=[*_READING.names, *own])

    return run


def closed_slots(readings: DataFrame, p: Params = Params(), delay: int = 3600, late_for: int = 86400, shares: int = SHARES) -> DataFrame:
    """Readings, when their slot has closed, and late ones (``late``) as they come. The time is in ``micros``."""
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    behind = delay + p.slot_s + late_for
    rows = fuel_range(normalise(readings, p), p).withColumn("at", as_instant(F.col("timestamp")))
    slot = F.floor(F.unix_micros("at") / (p.slot_s * 1_000_000)) * (p.slot_s * 1000)
    share = F.pmod(F.xxhash64("auto"), F.lit(shares))
    rows = rows.select(*p.keys, share.alias("share"), slot.alias("slot"), F.unix_micros("at").alias("micros"), FUEL, SPEED, VOLTAGE, F.col("seq").cast("long").alias("seq"))
    kinds = [f"`{k}` {readings.schema[k].dataType.simpleString()}" for k in p.scope]
    values = [f"{f.name} {({pa.string(): 'string', pa.int64(): 'long'}).get(f.type, 'double')}" for f in _READING]
    packets = rows.mapInArrow(_packets(p.scope), ", ".join([*kinds, "share long, slot long, newest long, rows binary"]))
    packets = packets.select(*p.scope, "share", "slot", F.timestamp_micros("newest").alias("at"), "rows").withWatermark("at", f"{behind} seconds")
    given = packets.groupBy(*p.scope, "share", "slot").transformWithStateInPandas(
        statefulProcessor=PacketKeeper(p.scope, p.slot_s * 1000, late_for * 1000),
        outputStructType=", ".join([*kinds, "rows binary, late boolean"]),
        outputMode="Append",
        timeMode="EventTime",
    )
    return given.mapInArrow(_opened(p.scope), ", ".join([*values, *kinds, "late boolean"])).select(*p.scope, *_READING.names, "late")


def _readings(rows: DataFrame) -> DataFrame:
    """The readings of a table of closed slots, with their wall-clock time."""
    # by arithmetic, not through the session zone
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("micros") / F.lit(1_000_000)).cast("decimal(20,6)"))
    return rows.withColumn("timestamp", at).drop("micros", "late")


def stream_cascade(
    readings: DataFrame, out: str, checkpoint: str, p: Params = Params(), delay: int = 3600, late_for: int = 86400, shares: int = SHARES
) -> StreamingQuery:
    """Run the cascade on all readings that are there, then stop: the final bins of closed slots go to
    ``out``/series, late readings to ``out``/late, both by micro-batch, so a batch that runs again
    replaces its rows."""
    out = out.rstrip("/")

    def process(batch: DataFrame, batch_id: int) -> None:
        rows = written_once(batch, "closed-slots")  # the state is gone through once
        given = _readings(rows.filter("not late"))
        preprocess(given, p).write.mode("overwrite").parquet(f"{out}/series/batch={batch_id}")
        _readings(rows.filter("late")).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")

    stream = closed_slots(readings, p, delay, late_for, shares).writeStream.foreachBatch(process)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cascade(spark: SparkSession, out: str, what: str = "series") -> DataFrame:
    """The ``series`` or the ``late`` readings that a stream has stored."""
    return spark.read.parquet(f"{out.rstrip('/')}/{what}").drop("batch")
