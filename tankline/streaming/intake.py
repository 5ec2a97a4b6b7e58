"""Continuous intake: new telemetry files are picked up, processed and stored exactly once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import Params
from ..plans.jobs import run_upload
from ..schemas import TELEMETRY
from ..sources.files import CORRUPT, QUOTES, text_schema, type_text
from ..sources.scratch import written_once
from ..sources.sinks import write_partitions
from ..sources.uploaded import stream_uploaded

# Which part of a file's path names its upload.
UNITS = {"file": r"([^/]+)$", "dir": r"([^/]+)/[^/]+$"}


def telemetry_stream(
    spark: SparkSession,
    in_dir: str,
    log: str,
    header: list[str] | None = None,
    unit: str = "file",
    max_files: int | None = None,
    tenant: str | None = None,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Text rows of new CSV files with ``upload_id``, taken from the file name or its folder, with
    the time the file was ``changed`` (microseconds), with their place ``_seq``, and with ``organization`` if
    ``tenant``, a pattern with one group, tells it from the path. ``extra`` names further columns to read.

    Every file is read under its own header; ``log`` is the folder that remembers which files were taken.
    Where all files share one, ``header`` may give it: Spark's own file source then reads them, at
    most ``max_files`` in a batch, and a file with another header stops the stream.
    """
    wanted = [*TELEMETRY.names, *extra]
    if header is None:
        rows = stream_uploaded(spark, in_dir, wanted, log).withColumnsRenamed({"_file": "_path", "_changed": "changed"})
        path, changed = F.col("_path"), F.col("changed")
    else:
        reader = (
            spark.readStream.schema(text_schema(header))
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("columnPruning", False)
            .option("enforceSchema", False)
            .options(**QUOTES)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.csv")
        )
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        rows = reader.csv(in_dir)
        path, changed = F.col("_metadata.file_path"), F.unix_micros(F.col("_metadata.file_modification_time"))
    named = {"upload_id": F.regexp_extract(path, UNITS[unit], 1), "changed": changed}
    if tenant:
        named["organization"] = F.regexp_extract(path, tenant, 1)
    return rows.withColumns(named).drop("_path")


def stream_uploads(
    spark: SparkSession,
    in_dir: str,
    tables: dict[str, DataFrame],
    out: str,
    checkpoint: str,
    p: Params = Params(),
    header: list[str] | None = None,
    unit: str = "file",
    max_files: int | None = None,
    tenant: str | None = None,
    extra: tuple[str, ...] = (),
    **options,
) -> StreamingQuery:
    """Run ``run_upload`` on whatever files are new, then stop.

    All new files of a micro-batch are one job: the upload is part of every key, so their statistics
    stay apart and results equal one batch run per upload. The checkpoint remembers what was taken,
    and the sinks replace an upload's own rows, so a retried batch changes nothing. With
    ``unit="dir"`` an upload is a folder of part files, which must arrive together.

    The text of a batch is parsed once and written; rejects, the time of the last change of each upload and
    the readings come from there. A column ``seq`` (named in ``extra`` or in ``header``) orders readings of
    one time; without it the order of files and lines does.
    """
    text = telemetry_stream(spark, in_dir, f"{checkpoint.rstrip('/')}-files", header, unit, max_files, tenant, extra)

    def process(batch: DataFrame, batch_id: int) -> None:
        good, bad = type_text(written_once(batch), TELEMETRY)
        write_partitions(bad, f"{out.rstrip('/')}/rejects", ["upload_id"])
        own = next((c for c in ("seq", "_seq") if c in good.columns), None)
        seq = F.col(own).cast("long") if own else F.monotonically_increasing_id()
        # of a point in several uploads that of the file changed last counts
        last = good.groupBy("upload_id").agg(F.max("changed").alias("load_seq"))
        good = good.withColumn("seq", seq).drop("changed", "_seq").join(last, "upload_id")
        run_upload(spark, good, tables, out, p, **options)

    return (
        text.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
