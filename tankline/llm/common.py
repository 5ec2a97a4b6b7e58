"""Shared helpers: plain input columns, row identity, Arrow text access, tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import fresh_dir


_SHIPPED: set[str] = set()
#: text bytes that a task works on at once; a longer text stands alone
PIECE = 1 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: tasks import it there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"  # Spark copies it from here
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator works on, whatever else the table carries; a missing one is NULL."""
    ship(docs.sparkSession)
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "item_id": "long", "toxic": "int", "quality": "int"}
    have = set(docs.columns)
    return docs.select(*((docs[c] if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in columns))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row for joining results back: the id and a hash of the text.

    Rows equal in both get equal results from every operator here, so they may share a key.
    """
    return F.xxhash64(F.lit(17), F.col(doc_id), F.col(text))


def saved(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_arrays(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n+1 offsets of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.fill_null("" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    ends = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def parts(batches, limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut to about ``limit`` text bytes, with the bytes and offsets of their ``text``."""
    for batch in batches:
        raw, ends = text_arrays(batch.column("text"))
        for lo, hi in slices(ends, limit):
            yield batch.slice(lo, hi - lo), raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
    give_back()


def give_back() -> None:
    """Return freed memory of this worker to the system: workers are used again, and would keep what a task has freed."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another libc
            ctypes.CDLL(None).malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of byte stretches of one array: equal stretches get equal values wherever they start.

    Prefix sums of bytes (through a random table) times powers of an odd base, modulo 2**64; a
    difference of two prefix sums is moved to a common power with the inverse base. Table and base
    come from the seed. Powers are kept for up to PIECE bytes. Sums modulo 2**64 have made-up collisions
    that no base avoids: a Thue-Morse string of 1 kB or more and its complement are equal under every seed.
    So what is compared by these values are stretches under 512 bytes, and words of any length.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(1, 1 << 60)) * 8 + 5  # of the greatest order
        self.up = self.down = np.zeros(0, np.uint64)

    def load(self, raw: np.ndarray) -> None:
        n = len(raw) + 1
        if len(self.up) < n or len(self.up) > max(n, PIECE + 1):
            size = max(n, min(PIECE + 1, 2 * n))
            self.up, self.down = _powers(self.base, size), _powers(pow(self.base, -1, 1 << 64), size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self.table[raw] * self.up[: n - 1], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _ODD)


#: ``[\x20\x09-\x0D]`` by byte
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: bytes of words of letters: ASCII letters and all of longer characters
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(raw: np.ndarray, ends: np.ndarray, of: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (by default ``[^\\x20\\x09-\\x0D]+``), and the first word of each row (n+1)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = of[raw]
    begin = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cut = ends[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begin[cut] = inside[cut + 1]
    last[cut - 1] = inside[cut]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, ends)


def bounded_sample(df: DataFrame, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, at most twice as many, chosen by a hash of their id (``doc_id``).

    For fitting models only. Every label has its rows, however many labels there are, and the choice is
    the same in every run: what a hash of all columns puts first stays where ids repeat very often.
    """
    # only labels with more rows are thinned; the driver sees one count for each of these
    many = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")).filter(F.col("_n") > per_label)
    share = [F.lit(x) for r in many.toLocalIterator() for x in (r["_label"], per_label / r["_n"])]
    spot = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000
    some = df.filter(spot < F.coalesce(F.try_element_at(F.create_map(*share), F.col(label)), F.lit(2.0))) if share else df
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(*df.columns), *df.columns))
    return some.withColumn("_place", place).filter(F.col("_place") <= 2 * per_label).select(*df.columns)


def boxed(docs: DataFrame) -> DataFrame:
    """``docs`` as (doc, row): all columns in one struct, so that none can clash, and the row's key."""
    own = {c: docs[f"`{c}`"] for c in docs.columns}
    key = F.xxhash64(F.lit(17), own.get("doc_id", F.lit(None)).cast("long"), own.get("text", F.lit(None)).cast("string"))
    return docs.select(F.struct(*(c.alias(n) for n, c in own.items())).alias("doc"), key.alias("row"))
