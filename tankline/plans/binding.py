"""Gives the given star-schema tables the shape of the fleet domain.

Every binding reads whole tables. Levels are whole litres, so sums and differences are exact and do
not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Params
from ..schemas import FUEL, SPEED, VOLTAGE
from .sqltext import DIGITS, NUDGE

# One reading per vehicle and hour on average, so the registered queries use wide bins.
WIDE = Params(sensor_s=3600, pre_s=6 * 3600, period_s=86400, gap_s=86400, diff_s=2 * 86400)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def _text(name: str):
    return F.col(name).cast("string")


def telemetry(spark: SparkSession, d: str, *extra) -> DataFrame:
    return readings_of(table(spark, d, "events"), *extra)


def readings_of(events: DataFrame, *extra) -> DataFrame:
    """Events, static or streaming, as sensor readings."""
    return events.select(
        _text("user_id").alias("auto"),
        F.col("ts").alias("timestamp"),
        F.floor(F.col("value") * 40).cast("double").alias(FUEL),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias(SPEED),
        (F.lit(24) + F.col("event_id") % 7).cast("double").alias(VOLTAGE),
        F.col("event_id").alias("seq"),
        *extra,
    )


def cars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        _text("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        (F.col("c_custkey") % 2).cast("double").alias("engine_type"),
        _text("c_nationkey").alias("organization"),
    )


def norms(spark: SparkSession, d: str) -> DataFrame:
    """One norm per vehicle."""
    return table(spark, d, "customer").select(
        _text("c_custkey").alias("id"),
        _text("c_custkey").alias("car"),
        (10 + F.col("c_custkey") % 5).cast("double").alias("winter_volume"),
        (8 + F.col("c_custkey") % 4).cast("double").alias("summer_volume"),
        F.lit("2024-12-31").cast("date").alias("valid_period"),
    )


def norm_history(spark: SparkSession, d: str) -> DataFrame:
    """Many norms per vehicle, one per order."""
    return table(spark, d, "orders").select(
        _text("o_orderkey").alias("id"),
        _text("o_custkey").alias("car"),
        (10 + F.col("o_orderkey") % 5).cast("double").alias("winter_volume"),
        (8 + F.col("o_orderkey") % 4).cast("double").alias("summer_volume"),
        F.col("o_orderdate").cast("date").alias("valid_period"),
    )


def norm_file(spark: SparkSession, d: str) -> DataFrame:
    """Norm file rows with gaps: the priority is the norm kind."""
    known = F.col("o_orderstatus") != "P"
    return table(spark, d, "orders").select(
        _text("o_custkey").alias("sl_avto"),
        F.date_format("o_orderdate", "yyyy").alias("period"),
        F.when(known, F.col("o_totalprice")).alias("norma_rasx"),
        F.col("o_orderpriority").alias("vid_norm_rasx"),
        F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("deystvuet_do"),
        F.col("o_orderkey").alias("seq"),
    )


NORM_KINDS = {"summer": "1-URGENT", "winter": "5-LOW"}


def reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        _text("o_orderkey").alias("id"),
        _text("o_custkey").alias("car"),
        F.col("o_orderdate").alias("datetime"),
        (F.col("o_totalprice") / 1000).cast("int").alias("volume"),
        (F.col("o_orderstatus") == "F").alias("status"),
    )


def organizations(spark: SparkSession, d: str) -> DataFrame:
    short = F.length("n_name") < 9
    return table(spark, d, "nation").select(
        _text("n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.when(short, F.concat("n_name", F.lit(":"), _text("n_regionkey"))).alias("bot_token"),
        _text("n_regionkey").alias("chat_id"),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        _text("s_suppkey").alias("id"),
        F.when(F.col("s_acctbal") >= 0, _text("s_nationkey")).alias("org"),
        F.col("s_name").alias("username"),
        F.concat(F.lit("post"), _text("s_suppkey"), F.lit("@fleet.example")).alias("email"),
        (F.col("s_acctbal") > 5000).alias("is_active"),
    )


def drivers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(
        _text("s_suppkey").alias("id"),
        F.col("s_name").alias("fullname"),
        _text("s_nationkey").alias("address"),
        F.concat(F.lit("+7"), _text("s_suppkey")).alias("phone"),
    )


def driver_car(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select(
        _text("l_suppkey").alias("driver"), _text("l_partkey").alias("car")
    )
    return pairs.distinct()


def uploads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as uploaded files; a label, where there is one, gives the status."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    kind = F.when(F.col("lang") == "en", "raw").when(F.col("lang") == "de", "norm").otherwise("auto")
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "error")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("organization"),
        status.otherwise("created").alias("status"),
        F.concat("lang", F.lit(".csv")).alias("filename"),
        F.col("n_chars").cast("int").alias("size"),
        kind.alias("type"),
        F.sha2("text", 256).alias("file_hash"),
    )


def report_queries(spark: SparkSession, d: str) -> DataFrame:
    orgs = F.pmod(F.length("organization") + F.col("size"), F.lit(25)).cast("string")
    return uploads(spark, d).select(_text("id").alias("id"), orgs.alias("organization"), "status")


def media(spark: SparkSession, d: str) -> DataFrame:
    return uploads(spark, d).select(
        F.concat(F.lit("m"), _text("id")).alias("id"), F.lit("text/csv").alias("media_type"), "size", "filename",
        "type", _text("id").alias("report_query"), "file_hash",
    )


BINDINGS = {
    "organization": organizations,
    "org_user": users,
    "car": cars,
    "car_consumption": norms,
    "report_query": report_queries,
    "media": media,
    "car_report": reports,
    "driver": drivers,
    "driver_car": driver_car,
}


def fleet_tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    """The named fleet tables, all if none is named."""
    return {name: BINDINGS[name](spark, d) for name in names or BINDINGS}


def plain(df: DataFrame) -> DataFrame:
    """Round doubles and write times as text, for comparison between engines."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c + NUDGE, DIGITS) + 0.0
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            text = c.cast("string")
            c = F.rpad(F.when(F.length(text) == 19, F.concat(text, F.lit("."))).otherwise(text), 26, "0")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)
