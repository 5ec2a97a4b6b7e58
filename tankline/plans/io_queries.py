"""Queries that write to the shared folder and read back: files, whole upload jobs, streams."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.clean import normalise, preprocess
from ..operators.metrics import POINT_KEY, metric_points
from ..schemas import CARS_FILE, FUEL, SPEED, TELEMETRY, VOLTAGE
from ..sources import files, sinks
from ..sources.scratch import fresh_dir, written_once
from ..streaming.bins import stream_bins
from ..streaming.cascade import read_cascade, stream_cascade
from ..streaming.intake import stream_uploads
from . import binding as b
from . import sqltext as q
from .book import query
from .jobs import load_fleet, run_ready_uploads, run_upload

P = b.WIDE
_READINGS = [*TELEMETRY.names]
_READINGS_SQL = f"auto, {q.t('timestamp')}, {q.r(FUEL, SPEED, VOLTAGE)}"


@query("csv_roundtrip", f"WITH {q.TELEMETRY} SELECT {_READINGS_SQL} FROM tele")
def csv_roundtrip(spark, d):
    """Readings out to CSV and in again through the telemetry reader."""
    path = fresh_dir(spark, "csv")
    sinks.snapshot(b.telemetry(spark, d), path)
    good, _ = files.read_telemetry(spark, path)
    return b.plain(good.select(*_READINGS))


@query("csv_rejects", f"WITH {q.TELEMETRY} SELECT auto, seq FROM tele WHERE {FUEL} > 4096")
def csv_rejects(spark, d):
    """Readings whose level was spoilt on the way come out as rejects."""
    path = fresh_dir(spark, "csv")
    spoilt = F.when(F.col(FUEL) > 4096, F.lit("n/a")).otherwise(F.col(FUEL).cast("string"))
    sinks.snapshot(b.telemetry(spark, d).withColumn(FUEL, spoilt).withColumn(VOLTAGE, F.col("seq")), path)
    _, rejects = files.read_telemetry(spark, path)
    return rejects.select("auto", F.col(VOLTAGE).cast("long").alias("seq"))


def _cars_over(spark, d, fmt):
    """Vehicle rows from the parts table go over the stored ones."""
    path = fresh_dir(spark, fmt)
    new = b.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("description"), F.col("p_size").cast("double").alias("engine_type"),
        F.lit("0").alias("organization"),
    )
    sinks.export_table(new, path, fmt)
    return sinks.import_table(spark, path, fmt, b.cars(spark, d))[0]


_IMPORT_SQL = f"""WITH {q.CARS}
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS description, CAST(p_size AS DOUBLE) AS engine_type, '0' AS organization FROM part
UNION ALL SELECT * FROM cars WHERE id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part)"""


@query("table_import_csv", _IMPORT_SQL)
def table_import_csv(spark, d):
    return _cars_over(spark, d, "csv")


@query("table_import_json", _IMPORT_SQL)
def table_import_json(spark, d):
    return _cars_over(spark, d, "json")


@query(
    "csv_mixed_headers",
    f"WITH {q.TELEMETRY} SELECT {_READINGS_SQL} FROM tele",
)
def csv_mixed_headers(spark, d):
    """Readings in two folders whose files have their columns in different order, read together."""
    root = fresh_dir(spark, "csv")
    rows = b.telemetry(spark, d)
    other = ["auto", VOLTAGE, SPEED, "timestamp", FUEL]
    for n, names in ((0, TELEMETRY.names), (1, other)):
        sinks.snapshot(rows.filter(F.pmod("seq", F.lit(2)) == n).select(*names), f"{root}/{n}")
    good, _ = files.read_telemetry(spark, [f"{root}/0", f"{root}/1"])
    return b.plain(good.select(*_READINGS))


_ODD_TEXT = "p_name || ' \"' || p_type || '\", ' || chr(10) || p_brand"


@query("csv_quoted", f"SELECT CAST(p_partkey AS VARCHAR) AS id, {_ODD_TEXT} AS name FROM part")
def csv_quoted(spark, d):
    """Texts with quotes, commas and line breaks, out and in again."""
    path = fresh_dir(spark, "csv")
    text = F.concat("p_name", F.lit(' "'), "p_type", F.lit('", \n'), "p_brand")
    sinks.export_table(b.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), text.alias("name")), path, "csv")
    good, _ = files.read_table(spark, path, b.cars(spark, d).select("id", "name").schema, "csv")
    return good.select("id", "name")


@query(
    "cars_file",
    """SELECT CAST(p_partkey AS VARCHAR) AS guid, CASE WHEN p_partkey % 7 = 1 THEN NULL ELSE p_type END AS description,
  CASE WHEN p_partkey % 7 IN (1, 2) THEN NULL ELSE CAST(p_size AS DOUBLE) END AS sl_tip_dvigat, p_partkey % 7 = 3 AS rejected FROM part""",
)
def cars_file(spark, d):
    """A vehicle file with short rows (kept), engine types that are no numbers (kept) and long rows (rejects)."""
    path = fresh_dir(spark, "csv")
    kind = F.col("p_partkey") % 7
    cells = [F.col("p_partkey").cast("string"), *(F.lit(x) for x in ("A1", "V1", "make", "model"))]
    tail = [F.col("p_type"), F.when(kind == 2, "diesel").otherwise(F.col("p_size").cast("string"))]
    line = F.when(kind == 1, F.concat_ws(",", *cells)).when(kind == 3, F.concat_ws(",", *cells, *tail, F.lit("more"))).otherwise(F.concat_ws(",", *cells, *tail))
    # a file for every brand, each with its header
    rows = b.table(spark, d, "part").select("p_brand", F.lit(1).alias("place"), line.alias("value"))
    heads = rows.select("p_brand").distinct().select("p_brand", F.lit(0).alias("place"), F.lit(",".join(CARS_FILE.names)).alias("value"))
    rows.unionByName(heads).repartition(16, "p_brand").sortWithinPartitions("p_brand", "place").drop("place").write.partitionBy("p_brand").text(path)
    good, rejects = files.read_cars(spark, path)
    out = good.withColumn("rejected", F.lit(False)).unionByName(
        rejects.select(*CARS_FILE.names[:-1], F.col("sl_tip_dvigat").cast("double").alias("sl_tip_dvigat"), F.lit(True).alias("rejected"))
    )
    return out.select("guid", "description", "sl_tip_dvigat", "rejected")


@query(
    "norms_file",
    """SELECT CAST(p_partkey AS VARCHAR) AS sl_avto, CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS norma_rasx,
  p_partkey % 5 = 1 AS rejected FROM part""",
)
def norms_file(spark, d):
    """A norm file in which some norms are no numbers."""
    path = fresh_dir(spark, "csv")
    size = F.when(F.col("p_partkey") % 5 == 1, "many").otherwise(F.col("p_size").cast("string"))
    rows = b.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("sl_avto"), F.lit("p").alias("period"), size.alias("norma_rasx"),
        F.col("p_type").alias("vid_norm_rasx"), F.lit("2025-01-01").alias("deystvuet_do"),
    )
    sinks.export_table(rows, path, "csv")
    good, rejects = files.read_norms(spark, path)
    return good.select("sl_avto", "norma_rasx", F.lit(False).alias("rejected")).unionByName(
        rejects.select("sl_avto", F.lit(None).cast("double").alias("norma_rasx"), F.lit(True).alias("rejected"))
    )


@query(
    "fleet_file",
    """SELECT CAST(p_partkey AS VARCHAR) AS guid, p_name AS name, CAST(p_size AS DOUBLE) AS winter_norm, strftime(DATE '2025-01-01', '%Y-%m-%d') AS due FROM part""",
)
def fleet_file(spark, d):
    """The merged table written as CSV, in another order of columns, and read."""
    path = fresh_dir(spark, "csv")
    rows = b.table(spark, d, "part").select(
        F.lit("2025-01-01").alias("due"), (F.col("p_partkey") % 2).alias("engine_type"), F.col("p_name").alias("name"),
        F.col("p_size").alias("winter_norm"), F.lit(None).cast("double").alias("summer_norm"), F.col("p_type").alias("description"),
        F.col("p_partkey").cast("string").alias("guid"),
    )
    sinks.export_table(rows, path, "csv")
    good, _ = files.read_fleet(spark, path)
    return good.select("guid", "name", "winter_norm", "due")


@query(
    "import_repeated_id",
    """SELECT CAST(p_size AS VARCHAR) AS id, max_by(p_name, p_partkey) AS name, CAST(max(p_partkey) AS DOUBLE) AS engine_type
FROM part GROUP BY p_size""",
)
def import_repeated_id(spark, d):
    """A file in which most ids repeat: the last row of each counts."""
    path = fresh_dir(spark, "csv")
    rows = b.table(spark, d, "part").orderBy("p_partkey").select(
        F.col("p_size").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("description"),
        F.col("p_partkey").cast("double").alias("engine_type"), F.lit("0").alias("organization"),
    )
    sinks.export_table(rows.coalesce(1), path, "csv")
    out, _ = sinks.import_table(spark, path, "csv", b.cars(spark, d).filter("false"))
    return out.select("id", "name", "engine_type")


@query(
    "table_file_hash",
    """SELECT p_brand AS file, CAST(sum(strlen(p_name) + 1) AS BIGINT) AS size, sha256(string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10)) AS file_hash
FROM part GROUP BY p_brand""",
)
def table_file_hash(spark, d):
    """A file of all parts of each brand, in a folder whose name has a blank and signs that mean something in a URI."""
    path = fresh_dir(spark, "files") + "/a b%20#c"
    names = b.table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_name").alias("value"))
    names.repartition(16, "p_brand").sortWithinPartitions("p_brand", "p_partkey").drop("p_partkey").write.partitionBy("p_brand").text(path)
    out = files.hash_files(spark, path.replace("%", "?").replace("#", "?") + "/p_brand=*/*.txt")
    return out.select(F.regexp_replace(F.regexp_extract("path", "p_brand=([^/]+)", 1), "%23", "#").alias("file"), "size", "file_hash")


@query(
    "fleet_load",
    """WITH new AS (SELECT CAST(p_partkey AS VARCHAR) AS car, CAST(p_size AS DOUBLE) AS winter_volume, CAST(-1 AS DOUBLE) AS summer_volume,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '2025-01-01' END AS valid_period
FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) AND p_partkey % 3 <> 1),
allof AS (SELECT * FROM new UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), CAST(10 + c_custkey % 5 AS DOUBLE), CAST(8 + c_custkey % 4 AS DOUBLE), '2024-12-31' FROM customer)
SELECT car, winter_volume, summer_volume, valid_period, true AS all_ids_differ FROM allof""",
)
def fleet_load(spark, d):
    """A tenant's merged file, loaded twice over the stored norms: its own and its new vehicles only,
    dates that can't be read left out, missing ones NULL, every norm once and with an id of its own."""
    fleet = b.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("guid"), F.col("p_name").alias("name"),
        F.col("p_type").alias("description"), F.col("p_size").cast("double").alias("winter_norm"),
        F.lit(None).cast("double").alias("summer_norm"),
        F.when(F.col("p_partkey") % 3 == 1, "2025-13-45").when(F.col("p_partkey") % 3 == 2, "2025-01-01").alias("due"),
        (F.col("p_partkey") % 2).cast("double").alias("engine_type"), F.col("p_partkey").alias("seq"),
    )
    tables = b.fleet_tables(spark, d, "car", "car_consumption")
    for _ in range(2):
        tables, _ = load_fleet(fleet, tables, "3", "f1")
    out = tables["car_consumption"]
    alone = F.count("*").over(Window.partitionBy("id")) == 1
    return out.select("car", "winter_volume", "summer_volume", F.col("valid_period").cast("string").alias("valid_period"), alone.alias("all_ids_differ"))


# ---- upload jobs --------------------------------------------------------------------------------

_REPORT_SQL = f"car, {q.t('datetime')}, volume, status"


def _report_rows(df, *extra):
    return b.plain(df.select(*extra, "car", "datetime", "volume", "status"))


@query(
    "upload_reports",
    f"""WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)}
SELECT auto AS car, {q.t('timestamp', 'datetime')}, CAST(trunc(leak) AS INTEGER) AS volume, true AS status FROM leaks WHERE is_leak""",
)
def upload_reports(spark, d):
    """One upload, run twice: the stored reports are those of one run."""
    out = fresh_dir(spark, "upload")
    tables = b.fleet_tables(spark, d, "car", "car_consumption")
    for _ in range(2):
        paths = run_upload(spark, b.telemetry(spark, d), tables, out, P, upload_id="u 1%", load_seq=1)
    return _report_rows(sinks.read_reports(spark, paths["reports"]))


_METRICS_SQL = f"""WITH {q.cascade(P)} SELECT CAST(c_nationkey AS VARCHAR) AS organization, auto, {q.t('timestamp')},
  {q.r('pos_s', 'spent_fuel')}, round(max_fuel + 1.23e-7, 6) + 0.0 AS {FUEL}
FROM series JOIN customer ON auto = CAST(c_custkey AS VARCHAR)"""


def _uploaded_twice(spark, d):
    """The store of two uploads over the same vehicles and times, named against their order; the first one's
    levels are not the last one's."""
    out = fresh_dir(spark, "upload")
    tables = b.fleet_tables(spark, d, "car", "car_consumption")
    for n, name in ((1, "u9"), (2, "u10")):
        rows = b.telemetry(spark, d)
        if n == 1:
            rows = rows.withColumn(FUEL, F.when(F.col(FUEL) <= 4096, F.col(FUEL) / 2).otherwise(F.col(FUEL)))
        paths = run_upload(spark, rows, tables, out, P, upload_id=name, load_seq=n)
    return paths["metrics"]


def _points(df):
    return b.plain(df.select(*POINT_KEY, SPEED, "spent_fuel", FUEL))


@query("upload_metrics", _METRICS_SQL)
def upload_metrics(spark, d):
    """The stored points of two uploads."""
    return _points(sinks.read_metrics(spark, _uploaded_twice(spark, d)))


@query("compact_metrics", _METRICS_SQL)
def compact_metrics(spark, d):
    """The same points, from a store written anew with one row for each."""
    to = fresh_dir(spark, "compact")
    sinks.compact_metrics(spark, _uploaded_twice(spark, d), to)
    return _points(sinks.read_metrics(spark, to))


@query(
    "metrics_settled",
    f"""WITH {q.cascade(P)} SELECT CAST(CAST(auto AS INT) % 25 AS VARCHAR) AS organization, auto, {q.t('timestamp')}, {q.r('pos_s', 'spent_fuel')},
  round(CASE WHEN CAST(auto AS INT) % 2 = 0 THEN max_fuel ELSE max_fuel / 2 END + 1.23e-7, 6) + 0.0 AS {FUEL} FROM series""",
)
def metrics_settled(spark, d):
    """Two uploads of the same points are settled; the second one runs again, with half of its vehicles, and is settled
    again: of the others the points of the first are back."""
    out = fresh_dir(spark, "metrics")
    points = metric_points(preprocess(normalise(b.telemetry(spark, d), P), P), F.pmod(F.col("auto").cast("int"), F.lit(25)).cast("string"))
    points = written_once(points, "points")
    even = F.col("auto").cast("int") % 2 == 0
    for n, name, rows in ((1, "u1", points.withColumn(FUEL, F.col(FUEL) / 2)), (2, "u2", points), (3, "u2", points.filter(even))):
        sinks.write_metrics(rows.withColumn("load_seq", F.lit(n).cast("long")), out, name, fan_in=None if n == 1 else 1)
    return b.plain(sinks.read_metrics(spark, out).select(*POINT_KEY, SPEED, "spent_fuel", FUEL))


_UNITS_SQL = "(SELECT DISTINCT user_id % 40 AS k FROM events)"


@query(
    "many_uploads",
    f"""SELECT 'u' || k AS id, 'o' || k AS organization, CASE WHEN k % 5 = 0 THEN 'created' WHEN k % 7 = 3 OR k % 7 = 4 THEN 'error' ELSE 'completed' END AS status,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 3 THEN 'missing columns: {VOLTAGE}' WHEN k % 7 = 4 THEN 'no readings' END AS reason FROM {_UNITS_SQL}""",
)
def many_uploads(spark, d):
    """The waiting uploads of all tenants in one job: some tenants are not ready, some files lack a column or hold no reading."""
    root, out = fresh_dir(spark, "in"), fresh_dir(spark, "out")
    rows = b.telemetry(spark, d, (F.col("user_id") % 40).cast("int").alias("k"))
    unit = F.concat(F.lit("u"), "k")
    text = rows.select(F.when(F.col("k") % 7 == 4, "soon").otherwise(F.col("timestamp").cast("string")).alias("timestamp"), FUEL, SPEED, "auto", VOLTAGE, unit.alias("unit"), "k")
    for names, some in ((text.columns, text.filter("k % 7 <> 3")), ([c for c in text.columns if c != VOLTAGE], text.filter("k % 7 = 3"))):
        some.select(*[c for c in names if c != "k"]).write.mode("append").partitionBy("unit").option("header", True).csv(root)
    units = rows.select("k").distinct()
    kinds = F.when(F.col("k") % 5 == 0, F.array(F.lit("raw"))).otherwise(F.array(F.lit("raw"), F.lit("auto"), F.lit("norm")))
    uploads = units.select("k", F.explode(kinds).alias("type")).select(
        F.when(F.col("type") == "raw", F.concat(F.lit("unit=u"), "k")).otherwise(F.concat("type", "k")).alias("id"), F.concat(F.lit("o"), "k").alias("organization"),
        F.when(F.col("type") == "raw", "created").otherwise("completed").alias("status"), "type",
    )
    after = run_ready_uploads(spark, uploads, root, b.fleet_tables(spark, d, "car", "car_consumption"), out, 1, P)
    return after.filter("type = 'raw'").select(F.regexp_replace("id", "^unit=", "").alias("id"), "organization", "status", "reason")


_INTAKE_SQL = f"""WITH {q.cascade(P, 'upload_id, auto')}, {q.CARS}, {q.NORMS}, {q.detection(P, keys='upload_id')}
SELECT upload_id, auto AS car, {q.t('timestamp', 'datetime')}, CAST(trunc(leak) AS INTEGER) AS volume, true AS status FROM leaks WHERE is_leak"""


def _taken_in(spark, d, src):
    """The reports of all folders below ``src``, taken in as a stream."""
    out, state = fresh_dir(spark, "out"), fresh_dir(spark, "state")
    tables = b.fleet_tables(spark, d, "car", "car_consumption")
    stream_uploads(spark, src, tables, out, state, P, unit="dir", extra=("seq",)).awaitTermination()
    found = sinks.read_reports(spark, f"{out}/reports")
    return _report_rows(found.withColumn("upload_id", F.regexp_replace("upload_id", "^unit=", "")), "upload_id")


def _unit_text(spark, d):
    rows = b.telemetry(spark, d, F.col("event_type").alias("unit"))
    return rows.select(F.col("timestamp").cast("string").alias("timestamp"), FUEL, SPEED, VOLTAGE, "auto", "seq", "unit")


@query("stream_intake", _INTAKE_SQL)
def stream_intake(spark, d):
    """Readings arrive as one folder of CSV files per event type and are taken in as a stream."""
    src = fresh_dir(spark, "in")
    _unit_text(spark, d).write.partitionBy("unit").option("header", True).csv(src)
    return _taken_in(spark, d, src)


@query("stream_mixed_headers", _INTAKE_SQL)
def stream_mixed_headers(spark, d):
    """As ``stream_intake``; the files of each folder have their columns in two orders, and one of them a column more."""
    src = fresh_dir(spark, "in")
    rows = _unit_text(spark, d)
    other = rows.select("seq", F.lit("a, b").alias("note"), "auto", VOLTAGE, SPEED, FUEL, "timestamp", "unit")
    for n, some in ((0, rows), (1, other)):
        some.filter(F.pmod("seq", F.lit(2)) == n).write.mode("append").partitionBy("unit").options(header=True, **files.QUOTES).csv(src)
    return _taken_in(spark, d, src)


@query(
    "stream_bins",
    f"""WITH {q.TELEMETRY}, {q.RANGE}, edge AS (SELECT max(timestamp) - INTERVAL 1 HOUR AS at FROM r0),
b1 AS (SELECT auto, {q.floor_to('timestamp', 3600)} AS ts, median({FUEL}) AS fuel, avg(pos_s) AS pos_s FROM r0 GROUP BY ALL),
b2 AS (SELECT auto, {q.floor_to('ts', 21600)} AS ts, max(fuel) AS max_fuel, median(pos_s) AS pos_s FROM b1 GROUP BY auto, {q.floor_to('ts', 21600)}),
b3 AS (SELECT auto, {q.floor_to('ts', 86400)} AS timestamp, max(max_fuel) AS max_fuel, avg(pos_s) AS pos_s FROM b2 GROUP BY auto, {q.floor_to('ts', 86400)})
SELECT auto, {q.t('timestamp')}, {q.r('pos_s', 'max_fuel')} FROM b3, edge WHERE timestamp + INTERVAL 1 DAY <= edge.at""",
)
def stream_bins_query(spark, d):
    """Readings as a stream; the bins closed by the watermark."""
    out, state = fresh_dir(spark, "bins"), fresh_dir(spark, "state")
    path = f"{d.rstrip('/')}/event[s].parquet"  # a pattern may name a file or a folder of files
    schema = b.table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(path)
    bins = stream_bins(b.readings_of(events), P)
    stream = (
        bins.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return b.plain(spark.read.schema(bins.schema).parquet(out))


# Some readings come after all others. Slots closed by then (their end and an hour passed) go without
# them; what the stream has not passed in the end stays open.
_END = f"{q.floor_to('timestamp', P.slot_s)} + INTERVAL {P.slot_s + 3600} SECOND"
_LATE = f"seq % 7 = 0 AND {_END} <= (SELECT max(ts) FROM events WHERE event_id % 7 <> 0 AND floor(value * 40) BETWEEN 0 AND 4096)"
_OPEN = f"{_END} > (SELECT max(ts) FROM events WHERE floor(value * 40) BETWEEN 0 AND 4096)"
_IN_TIME = q.cascade(P).replace(q.RANGE, f"{q.RANGE[:-1]} AND NOT ({_LATE}) AND NOT ({_OPEN}))")


def _streamed(spark, d):
    src, out, state = (fresh_dir(spark, x) for x in ("in", "out", "state"))
    rows = b.telemetry(spark, d)
    for n in (0, 1):
        rows.filter((F.col("seq") % 7 == 0) == (n == 1)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        stream_cascade(stream, out, state, P, late_for=4000 * 86400).awaitTermination()
    return out


@query("stream_cascade", f"WITH {_IN_TIME} SELECT auto, {q.t('timestamp')}, {q.r('pos_s', 'spent_fuel', 'max_fuel', 'dtime_s', 'travel', 'spent_per_100')} FROM series")
def stream_cascade_query(spark, d):
    """The cascade over a stream, with gaps, voltages and steps; a seventh of the readings comes after the others."""
    cols = ["auto", "timestamp", SPEED, "spent_fuel", "max_fuel", "dtime_s", "travel", "spent_per_100"]
    return b.plain(read_cascade(spark, _streamed(spark, d)).select(*cols))


@query("stream_late_readings", f"WITH {q.TELEMETRY}, {q.RANGE} SELECT auto, {q.t('timestamp')}, seq FROM r0 WHERE {_LATE}")
def stream_late_readings(spark, d):
    """Every reading that came after its slot was closed."""
    return b.plain(read_cascade(spark, _streamed(spark, d), "late").select("auto", "timestamp", "seq"))
