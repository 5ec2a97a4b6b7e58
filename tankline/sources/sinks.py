"""Writers. Every table an upload adds to is partitioned by ``upload_id`` and only its own partitions
are overwritten: running an upload again replaces its rows and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import upsert
from ..schemas import TABLES
from .files import QUOTES, read_table
from .metric_store import compact_metrics, read_metrics, write_metrics  # noqa: F401
from .partitions import folder, write_partitions  # noqa: F401


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*TABLES["car_report"].fields, T.StructField("upload_id", T.StringType())])
    return spark.read.schema(schema).parquet(path)


def export_table(df: DataFrame, path: str, fmt: str) -> None:
    """CSV or JSON files with a header or field names; times keep their microseconds."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown format {fmt!r}")
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType))]
    df = df.withColumns({c: F.col(c).cast("string") for c in times})
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(header=True, **QUOTES).csv(path)
    else:
        writer.json(path)


def snapshot(df: DataFrame, path: str) -> None:
    """CSV copy of a flat frame, for looking at."""
    export_table(df, path, "csv")


def import_table(
    spark: SparkSession, path: str, fmt: str, existing: DataFrame, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Existing rows with those of the file put in or over them, by ``key``; of a key that repeats in
    the file the last row counts. Returns the table and the rejects."""
    incoming, rejects = read_table(spark, path, existing.schema, fmt)
    both = upsert(existing.withColumn("seq", F.lit(0).cast("long")), incoming, [key], ["seq"])
    return both.drop("seq"), rejects
