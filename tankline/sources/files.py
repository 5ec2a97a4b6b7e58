"""Readers for uploaded files.

CSV readers parse text only; ``try_cast`` turns it into typed columns. A value that does not fit
makes its row a reject, so one bad field neither stops a job nor disappears silently. Every reader
returns (good rows, rejects).

Columns are matched by name in every file: files with different headers are read apart, each under its
own. Doubled quotes stand for one. ``seq`` follows the order of files (time of change, then path) and
of the lines in each.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import nan_to_null, need
from ..schemas import CARS_FILE, FLEET, NORMS_FILE, TELEMETRY
from .uploaded import read_uploaded, readable, store_of

CORRUPT = "_corrupt_record"
SURPLUS = "_surplus"
_COLUMNAR = ("parquet", "orc")
#: options of every CSV reader and writer: a quote inside a quoted field is doubled
QUOTES = {"quote": '"', "escape": '"'}


def text_schema(names, last: str = CORRUPT) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, last]])


def _paths(path) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def _file_headers(spark: SparkSession, path, wanted: list[str]) -> list[tuple[tuple[str, ...], str]]:
    """(header, file) of every file that is not empty. A file whose first line lacks a wanted name raises.

    Only lines that hold all wanted names are looked at, so one short text pass finds the headers.
    The driver gets a line for each file, as it does from the listing.
    """
    listed = spark.read.format("binaryFile").load(_paths(path)).filter("length > 0").select("path")
    lines = spark.read.text(_paths(path)).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    holds = reduce(Column.__and__, (F.contains("value", F.lit(n)) for n in wanted))
    first = lines.filter(holds).groupBy("file").agg(F.min_by("value", "at").alias("line"))
    plain = lambda name: name.partition(":")[2].lstrip("/")  # noqa: E731  schemes come with one slash or three
    found = {plain(unquote(r.file)): tuple(next(csv.reader([r.line.lstrip("\ufeff")]))) for r in first.toLocalIterator()}
    out = []
    for r in listed.toLocalIterator():
        header = found.get(plain(r.path)) or _first_line(spark, r.path)
        missing = [n for n in wanted if n not in header]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)} in {r.path}")
        out.append((header, r.path))
    return out


def _first_line(spark: SparkSession, file: str) -> tuple[str, ...]:
    return tuple(spark.read.options(header=True, **QUOTES).csv(file).columns)


def _read_text(spark: SparkSession, path, schema: T.StructType, header: list[str] | None, last: str = CORRUPT, lines: bool = False) -> DataFrame:
    """CSV rows as text, and ``_seq``. Columns are matched by each file's header, others are not kept.

    A row with too many or too few fields has its text in ``_corrupt_record``; with ``last`` SURPLUS
    short rows are filled with NULL and what follows a full row is in ``_surplus``. With ``lines``
    fields may hold line breaks (a file is then read by one task). A given ``header`` holds for all
    files; one with another header stops the job.
    """
    if header is None:
        by: dict[tuple[str, ...], list[str]] = {}
        for own, file in _file_headers(spark, path, schema.names):
            by.setdefault(own, []).append(file)
    else:
        missing = [f for f in schema.names if f not in header]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        by = {tuple(header): _paths(path)}
    found = []
    for own, files in by.items():
        # With column pruning the parser skips the check of the field count, so it is switched off
        # for this reader only.
        reader = spark.read.schema(text_schema(own, last)).options(
            header=True, mode="PERMISSIVE", columnPruning=False, multiLine=lines, enforceSchema=header is None, **QUOTES
        )
        if last == CORRUPT:
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        rows = reader.csv(files)
        found.append(rows.select(*schema.names, last, *_place()))
    if not found:
        empty = T.StructType([*text_schema(schema.names, last), T.StructField("_seq", T.LongType())])
        return spark.createDataFrame([], empty)
    return _in_order(reduce(DataFrame.unionByName, found))


def _place() -> list[Column]:
    m = F.col("_metadata")
    # rows of a split rise by one, and a split has fewer rows than bytes, so this rises along a file
    within = m["file_block_start"] + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return [F.struct(m["file_modification_time"], m["file_path"]).alias("_file"), within.alias("_at")]


def _in_order(df: DataFrame) -> DataFrame:
    """Number the files by time of change, then path; ``_seq`` is the file's number, then the place in it."""
    files = list(df.select("_file").distinct().toLocalIterator())
    ranked = {r["_file"]: n for n, r in enumerate(sorted(files, key=lambda r: tuple(r["_file"])))}
    if len(ranked) <= 1:
        return df.drop("_file").withColumnRenamed("_at", "_seq")
    kind = T.StructType([T.StructField("_file", df.schema["_file"].dataType), T.StructField("_no", T.LongType())])
    numbers = df.sparkSession.createDataFrame(list(ranked.items()), kind)
    joined = df.join(numbers, "_file", "left")
    return joined.withColumn("_seq", F.col("_no") * (1 << 42) + F.col("_at")).drop("_file", "_no", "_at")


def _typed(df: DataFrame, schema: T.StructType, lenient: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    cols = {f.name: F.trim(F.col(f.name)) for f in schema.fields}
    cast = {
        f.name: cols[f.name] if isinstance(f.dataType, T.StringType) else cols[f.name].try_cast(f.dataType)
        for f in schema.fields
    }
    last = CORRUPT if CORRUPT in df.columns else SURPLUS
    bad = F.col(last).isNotNull()
    for f in schema.fields:
        if f.name not in lenient and not isinstance(f.dataType, T.StringType):
            given = F.coalesce(F.length(cols[f.name]) > 0, F.lit(False))
            bad = bad | (given & cast[f.name].isNull())
    extra = [c for c in df.columns if c not in schema.names and c != last]
    values = []
    for f in schema.fields:
        value = cast[f.name]
        if isinstance(f.dataType, T.DoubleType):
            value = nan_to_null(value)
        values.append(value.alias(f.name))
    good = df.filter(~bad).select(*values, *extra)
    return good, df.filter(bad)


def type_text(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Typed good rows and untouched rejects of a text frame (static or streaming)."""
    if CORRUPT not in df.columns:
        df = df.withColumn(CORRUPT, F.lit(None).cast("string"))
    return _typed(df, schema)


def _read(spark, path, schema, fmt, header, ordered, lines=False, pad=False, lenient=()) -> tuple[DataFrame, DataFrame]:
    if fmt in _COLUMNAR:
        df = need(spark.read.format(fmt).load(path), schema.names)
        if ordered and "seq" not in df.columns:
            df = _in_order(df.select(*schema.names, *_place())).withColumnRenamed("_seq", "seq")
        seq = ["seq"] if "seq" in df.columns else []
        cols = []
        for f in schema.fields:
            value = F.col(f.name).cast(f.dataType)
            cols.append((nan_to_null(value) if isinstance(f.dataType, T.DoubleType) else value).alias(f.name))
        good = df.select(*cols, *seq)
        return good, good.filter(F.lit(False))
    if fmt == "json":
        text = spark.read.schema(text_schema(schema.names)).option("columnNameOfCorruptRecord", CORRUPT)
        df = _in_order(text.json(path).select(*schema.names, CORRUPT, *_place()))
    elif fmt == "csv" and not lines and header is None and all(map(readable, _paths(path))):
        df = read_uploaded(spark, _paths(path), schema.names).drop("_file", "_changed")
    elif fmt == "csv":
        df = _read_text(spark, path, schema, header, SURPLUS if pad else CORRUPT, lines)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    df = df.withColumnRenamed("_seq", "seq") if ordered else df.drop("_seq")
    return _typed(df, schema, lenient)


def read_telemetry(spark: SparkSession, path, fmt: str = "csv", header: list[str] | None = None):
    """Sensor readings. Every CSV file is read under its own header, in one pass (``uploaded``); a file without
    the wanted columns fails the job. In a store that only the JVM knows, and with a ``header`` that all
    files share, Spark's own reader is used; without ``header`` it needs a pass for the headers first."""
    return _read(spark, path, TELEMETRY, fmt, header, ordered=True)


def telemetry_text(spark: SparkSession, path) -> DataFrame:
    """Sensor readings of CSV files as text rows with ``seq``, for ``type_text``."""
    if all(map(readable, _paths(path))):
        df = read_uploaded(spark, _paths(path), TELEMETRY.names).drop("_file", "_changed")
    else:
        df = _read_text(spark, path, TELEMETRY, None)
    return df.withColumnRenamed("_seq", "seq")


def read_cars(spark: SparkSession, path, fmt: str = "csv", header: list[str] | None = None):
    """Vehicle file. Only lines with too many fields are rejects: short ones are filled with NULL, and
    an engine type that is no number is NULL."""
    return _read(spark, path, CARS_FILE, fmt, header, ordered=False, lines=True, pad=True, lenient=("sl_tip_dvigat",))


def read_norms(spark: SparkSession, path, fmt: str = "csv", header: list[str] | None = None):
    return _read(spark, path, NORMS_FILE, fmt, header, ordered=True, lines=True)


def read_fleet(spark: SparkSession, path, fmt: str = "csv", header: list[str] | None = None):
    """Merged vehicle and norm table."""
    return _read(spark, path, FLEET, fmt, header, ordered=True, lines=True)


def read_table(spark: SparkSession, path, schema: T.StructType, fmt: str):
    """A table in its own columns, with the file order ``seq``."""
    return _read(spark, path, schema, fmt, None, ordered=True, lines=True)


# ---- file digests -------------------------------------------------------------------------------

_DIGEST = "path string, size long, file_hash string"


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of files, a few megabytes at a time."""
    import hashlib

    for batch in batches:
        hashes = []
        for path in batch["path"]:
            system, inner, _ = store_of(path)
            digest = hashlib.sha256()
            with system.open_input_stream(inner, compression=None) as stream:
                while block := stream.read(4 << 20):
                    digest.update(block)
            hashes.append(digest.hexdigest())
        yield batch.assign(file_hash=hashes)[["path", "size", "file_hash"]]


def hash_files(spark: SparkSession, glob: str) -> DataFrame:
    """Path, size in bytes and SHA-256 of every file but empty ones, which Spark does not list. Tasks read the
    files as streams, whatever their size; in a store that only the JVM knows Spark reads them whole, up to
    its limit of 2 GB for a value."""
    files = spark.read.format("binaryFile").load(glob)
    size = F.col("length").alias("size")
    if not readable(glob):
        return files.select("path", size, F.sha2("content", 256).alias("file_hash"))
    return files.select("path", size).mapInPandas(_digest, _DIGEST)
