"""The store of metric points: uploads on top, months and buckets of vehicles below.

``recent``/upload_id=…   what the last uploads have written, a folder for each
``settled``/organization=…/month=…/bucket=…   all before, a folder for a tenant's month and a bucket of its vehicles

A job writes its upload into ``recent`` and, once FAN_IN of them are there, settles them: only the
months and buckets that they touch are written again. So the number of folders follows tenants and months,
not uploads, and what a vehicle's month takes to read is one bucket and the few recent uploads.

Rows keep upload_id and load_seq, in both places: of a point written by several uploads that of the
greatest load_seq counts, on reading. An upload that runs again replaces its own rows: settled rows of
an upload that has a recent folder do not count. That also makes settling safe to repeat: until its
folder goes, last of all, an upload counts from there, whatever has been settled of it.

One job at a time may settle a store; uploads may be written meanwhile.
"""

from __future__ import annotations

from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import POINT_KEY
from ..operators.upsert import latest_wins
from ..schemas import METRICS
from .partitions import folder, write_partitions
from .scratch import written_once

FAN_IN = 8  # recent uploads that are settled together
BUCKETS = 16  # of a tenant's vehicles; fixed for the life of a store
_PLACE = ["organization", "month", "bucket"]
_RECENT = T.StructType([*METRICS.fields, T.StructField("load_seq", T.LongType()), T.StructField("upload_id", T.StringType())])
_SETTLED = T.StructType([*_RECENT.fields, T.StructField("month", T.StringType()), T.StructField("bucket", T.IntegerType())])


def _store(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def has_path(spark: SparkSession, path: str) -> bool:
    system, p = _store(spark, path)
    return system.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    system, p = _store(spark, path)
    system.delete(p, True)


def recent_uploads(spark: SparkSession, path: str) -> list[str | None]:
    """Uploads that are not settled; about FAN_IN."""
    system, p = _store(spark, f"{path}/recent")
    names = [s.getPath().getName() for s in system.listStatus(p)] if system.exists(p) else []
    values = [unquote(n.partition("=")[2]) for n in names if n.startswith("upload_id=")]
    return sorted((None if v == "__HIVE_DEFAULT_PARTITION__" else v for v in values), key=str)


def _is_one_of(uploads: list[str | None]) -> Column:
    named = F.coalesce(F.col("upload_id").isin([u for u in uploads if u is not None]), F.lit(False))
    return named | F.col("upload_id").isNull() if None in uploads else named


def _bucket(auto: Column) -> Column:
    return F.pmod(F.xxhash64(auto), F.lit(BUCKETS)).cast("int")


def _placed(points: DataFrame) -> DataFrame:
    month = F.substring(F.col("timestamp").cast("string"), 1, 7)
    return points.withColumns({"month": F.coalesce(month, F.lit("none")), "bucket": _bucket(F.col("auto"))})


def _same_place(a: DataFrame, b: DataFrame) -> Column:
    """Months and buckets are never NULL, a tenant may be."""
    return a["organization"].eqNullSafe(b["organization"]) & (a["month"] == b["month"]) & (a["bucket"] == b["bucket"])


def _settled(spark: SparkSession, path: str) -> DataFrame:
    system, p = _store(spark, f"{path}/settled")
    return spark.read.schema(_SETTLED).parquet(f"{path}/settled") if system.exists(p) else spark.createDataFrame([], _SETTLED)


def _recent(spark: SparkSession, path: str) -> DataFrame:
    system, p = _store(spark, f"{path}/recent")
    return spark.read.schema(_RECENT).parquet(f"{path}/recent") if system.exists(p) else spark.createDataFrame([], _RECENT)


def write_metrics(points: DataFrame, path: str, upload_id: str | None = None, fan_in: int | None = FAN_IN) -> None:
    """Store points (with organization, upload_id and load_seq), then settle where ``fan_in`` uploads are there.

    With ``upload_id`` all points are of that upload, which is replaced as a whole, also by nothing;
    without it the uploads that have points are.
    """
    path = path.rstrip("/")
    fixed = {} if upload_id is None else {"upload_id": upload_id}
    rows = points.select(*_RECENT.names) if upload_id is None else points.withColumn("upload_id", F.lit(upload_id)).select(*_RECENT.names)
    write_partitions(rows, f"{path}/recent", ["upload_id"], fixed, sort=("organization", "auto", "timestamp"))
    if fan_in is not None:
        settle_metrics(points.sparkSession, path, at_least=fan_in)


def settle_metrics(spark: SparkSession, path: str, at_least: int = 1) -> bool:
    """Move the recent uploads to their months and buckets, if there are ``at_least`` so many."""
    path = path.rstrip("/")
    uploads = recent_uploads(spark, path)
    if len(uploads) < at_least or not uploads:
        return False
    new = _placed(_recent(spark, path).filter(_is_one_of(uploads)))
    settled = _settled(spark, path)
    # places that get rows, and places that lose those of an upload that ran again
    places = written_once(new.select(*_PLACE).union(settled.filter(_is_one_of(uploads)).select(*_PLACE)).distinct(), "places")
    kept = settled.filter(~_is_one_of(uploads)).join(places, _same_place(settled, places), "left_semi")
    # written before anything is replaced: a place can't be read and overwritten at once
    merged = written_once(kept.unionByName(new), "settling")
    write_partitions(merged, f"{path}/settled", _PLACE, sort=("auto", "timestamp"))
    filled = merged.select(*_PLACE).distinct()
    for r in places.join(filled, _same_place(places, filled), "left_anti").toLocalIterator():
        remove_path(spark, "/".join([f"{path}/settled", *(folder(c, r[c]) for c in _PLACE)]))
    for upload in uploads:
        remove_path(spark, f"{path}/recent/{folder('upload_id', upload)}")
    return True


def read_metrics(
    spark: SparkSession, path: str, org: str | None = None, car: str | None = None, start: datetime | None = None, stop: datetime | None = None
) -> DataFrame:
    """Current points, one per (organization, auto, timestamp); of one tenant, one vehicle, from ``start`` (inclusive)
    to ``stop`` (exclusive) if given. A tenant's vehicle in some months reads its bucket of these months."""
    path = path.rstrip("/")
    uploads = recent_uploads(spark, path)
    settled, recent = _settled(spark, path).filter(~_is_one_of(uploads)), _recent(spark, path)
    if org is not None:
        settled, recent = (df.filter(F.col("organization") == org) for df in (settled, recent))
    if car is not None:
        settled = settled.filter(F.col("bucket") == _bucket(F.lit(car)))
        settled, recent = (df.filter(F.col("auto") == car) for df in (settled, recent))
    for at, beyond in ((start, Column.__ge__), (stop, Column.__lt__)):
        if at is not None:
            edge = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
            month = f"{at:%Y-%m}"
            settled = settled.filter(F.col("month") >= month if at is start else F.col("month") <= month)
            settled, recent = (df.filter(beyond(F.col("timestamp"), edge)) for df in (settled, recent))
    rows = settled.drop("month", "bucket").unionByName(recent)
    return latest_wins(rows, POINT_KEY, ["load_seq", "upload_id"]).drop("load_seq", "upload_id")


def compact_metrics(spark: SparkSession, path: str, to: str) -> None:
    """Write the store anew at ``to``, settled, with one row per point."""
    current = read_metrics(spark, path).withColumns({"upload_id": F.lit("compacted"), "load_seq": F.lit(-1).cast("long")})
    write_metrics(current, to, "compacted", fan_in=1)
