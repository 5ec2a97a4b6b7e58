"""Whole jobs: what an upload sets off, from file to stored metrics and reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import normalise, preprocess
from ..operators.leaks import attach_cars, detect_leaks, org_cars, scoped_norms
from ..operators.metrics import metric_points
from ..operators.reference import split_fleet
from ..operators.reports import leak_reports
from ..operators.uploads import advance, folded, pending_uploads, status_events
from ..operators.upsert import load_norms, upsert_cars
from ..params import Params
from ..schemas import TELEMETRY
from ..sources.files import CORRUPT, telemetry_text, type_text
from ..sources.metric_store import has_path
from ..sources.scratch import fresh_dir, written_once
from ..sources.sinks import folder, write_metrics, write_partitions
from ..sources.uploaded import MISSING, read_uploaded


def run_upload(
    spark: SparkSession,
    telemetry: DataFrame | str,
    tables: dict[str, DataFrame],
    out: str,
    p: Params = Params(),
    org: str | None = None,
    upload_id: str | None = None,
    load_seq: int | None = None,
    mode: str = "overwrite",
    **detection,
) -> dict[str, str]:
    """Process readings into series, metrics and reports below ``out``; returns the paths.

    ``telemetry`` is a path, whose rejected rows are stored too, or a frame. Without ``upload_id``
    the frame must have that column: many uploads then run as one job, each with its own statistics.

    ``load_seq`` says which load is later: of a metric point written by several, that of the greatest
    one counts. Without it the frame must have that column, one value for each upload.

    The tenant is ``org``, else the frame's column ``organization``, else that of the vehicle; in
    the last case points of unknown vehicles go to the tenant "unknown".

    The series, orders of magnitude smaller than the readings, is written first and both sinks read
    it back: the readings are shuffled once, and a lost executor costs no second pass over them.
    """
    out = out.rstrip("/")
    paths = {name: f"{out}/{name}" for name in ("series", "metrics", "reports", "rejects")}
    fixed = {} if upload_id is None else {"upload_id": upload_id}
    if isinstance(telemetry, str):
        # parsed once: rejects and readings come from what is written
        telemetry, bad = type_text(written_once(telemetry_text(spark, telemetry)), TELEMETRY)
        if fixed:
            write_partitions(bad.withColumn("upload_id", F.lit(upload_id)), paths["rejects"], ["upload_id"], fixed)
    if fixed:
        telemetry = telemetry.withColumn("upload_id", F.lit(upload_id))
    if load_seq is not None:
        telemetry = telemetry.withColumn("load_seq", F.lit(load_seq).cast("long"))
    elif "load_seq" not in telemetry.columns:
        raise ValueError("a load needs load_seq, or readings with that column")
    scope = [c for c in ("organization", "upload_id", "load_seq") if c != "organization" or (org is None and c in telemetry.columns)]
    p = p.but(scope=tuple(dict.fromkeys([*p.scope, *scope])))

    series = preprocess(normalise(telemetry, p), p)
    load = f"{paths['series']}/{folder('load', upload_id)}" if fixed else fresh_dir(spark, "series")
    series.write.mode("overwrite").parquet(load)
    series = spark.read.schema(series.schema).parquet(load)

    cars = org_cars(tables["car"], org)
    if org is not None:
        points = metric_points(series, org, "upload_id", "load_seq")
    else:
        owned = series
        if "organization" not in series.columns:
            owned = series.join(cars.select(F.col("id").alias("auto"), "organization"), "auto", "left")
        points = metric_points(owned, F.coalesce("organization", F.lit("unknown")), "upload_id", "load_seq")
    write_metrics(points, paths["metrics"], upload_id)

    norms = scoped_norms(tables["car_consumption"], tables["car"], org)
    detected = detect_leaks(attach_cars(series, cars), norms, p, **detection)
    write_partitions(leak_reports(detected, F.col("upload_id")), paths["reports"], ["upload_id"], fixed, mode)
    return paths


def run_pending(
    spark: SparkSession,
    uploads: DataFrame,
    readings: DataFrame,
    tables: dict[str, DataFrame],
    out: str,
    p: Params = Params(),
    load_seq: int | None = None,
    **detection,
) -> DataFrame:
    """Process the next waiting upload of every tenant that is ready, all in one job.

    ``readings`` holds the raw rows of the uploads with their ``upload_id``. A later run has a
    greater ``load_seq``. Returns the upload table with the processed ones completed.
    """
    following = pending_uploads(uploads).select(F.col("id").alias("upload_id"), "organization")
    mine = readings.drop("organization").join(following, "upload_id", "inner")
    run_upload(spark, mine, tables, out, p, load_seq=load_seq, **detection)
    done = following.select(F.col("upload_id").alias("id"), F.lit(True).alias("_done"))
    return advance(uploads.join(done, "id", "left"), F.col("_done"), "completed").drop("_done")


def run_ready_uploads(
    spark: SparkSession, uploads: DataFrame, root: str, tables: dict[str, DataFrame], out: str, load_seq: int, p: Params = Params(), **detection
) -> DataFrame:
    """Process the next waiting upload of every tenant that is ready, all in one Spark job, and keep what became of each.

    The files of an upload are below ``root``/<id>, each under its own header. An upload that has no file, a
    file without the columns, or no readable reading fails alone: its status is error, with the reason.
    The others are completed. Steps are appended to ``out``/status as events; a job that stops half-way
    leaves its uploads pending, and they run again with the next one. Returns ``uploads`` with status and reason.

    The driver sees one id for each tenant.
    """
    out, root = out.rstrip("/"), root.rstrip("/")
    now = folded(uploads, status_log(spark, out)).drop("reason")
    # what a stopped job has left pending is next again
    again = F.when((F.col("type") == "raw") & (F.col("status") == "pending"), "created").otherwise(F.col("status"))
    following = written_once(pending_uploads(now.withColumn("status", again)).select(F.col("id").cast("string").alias("id"), "organization"), "next")
    _log(status_events(following, "pending", load_seq), out)

    paths = [f"{root}/{r.id}" for r in following.select("id").toLocalIterator()]
    rows = read_uploaded(spark, paths, TELEMETRY.names, lenient=True)
    place = F.regexp_extract("_file", re.escape(re.sub("^[a-z0-9]+:/*", "/", root)) + "/([^/]+)/", 1)
    text = written_once(rows.withColumn("upload_id", place).withColumnRenamed("_seq", "seq").drop("_file", "_changed"), "uploads")
    good, bad = type_text(text, TELEMETRY)
    write_partitions(bad, f"{out}/rejects", ["upload_id"])
    wrong = bad.filter(F.col(CORRUPT).startswith(MISSING)).groupBy("upload_id").agg(F.min(CORRUPT).alias("wrong"))
    found = good.groupBy("upload_id").agg(F.count("*").alias("n"))
    reason = F.coalesce("wrong", F.when(F.col("n").isNull(), F.lit("no readings")))
    verdict = written_once(following.withColumnRenamed("id", "upload_id").join(wrong, "upload_id", "left").join(found, "upload_id", "left").select("upload_id", "organization", reason.alias("reason")), "verdict")

    mine = good.join(verdict.filter("reason is null").select("upload_id", "organization"), "upload_id")
    run_upload(spark, mine, tables, out, p, load_seq=load_seq, **detection)
    done = verdict.withColumnRenamed("upload_id", "id")
    _log(status_events(done, F.when(F.col("reason").isNull(), "completed").otherwise("error"), load_seq, F.col("reason")), out)
    return folded(uploads, status_log(spark, out))


_EVENTS = "id string, status string, reason string, load_seq long"


def _log(events: DataFrame, out: str) -> None:
    events.withColumn("id", F.col("id").cast("string")).coalesce(1).write.mode("append").parquet(f"{out}/status")  # one row for each tenant


def status_log(spark: SparkSession, out: str) -> DataFrame:
    """The events of a store; none if there are none yet."""
    return spark.read.schema(_EVENTS).parquet(f"{out}/status") if has_path(spark, f"{out}/status") else spark.createDataFrame([], _EVENTS)


def load_fleet(
    fleet: DataFrame, tables: dict[str, DataFrame], org: str, upload_id: str
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Take a merged fleet table into the vehicle and norm tables. Returns the new tables and the
    norm rows whose vehicle belongs to somebody else or whose date can't be read.

    A norm's id tells its upload and its place in the file, so an upload loaded again adds nothing and
    the same norm in another upload is another row.
    """
    cars, norms = split_fleet(fleet)
    known = upsert_cars(tables["car"], cars, org)
    accepted, rejected = load_norms(norms, known, org)
    identity = F.to_json(F.struct(F.lit(upload_id).alias("upload"), "seq", "car"))
    accepted = accepted.withColumn("id", F.sha2(identity, 256))
    stored = tables["car_consumption"]
    new = accepted.select(*stored.columns).join(stored.select("id"), "id", "left_anti")
    return {**tables, "car": known, "car_consumption": stored.unionByName(new)}, rejected
