"""Reference files, upserts, uploads and entity listings."""

from pyspark.sql import functions as F

from ..functions.values import car_label, mask_tail
from ..operators import entities as ent
from ..operators import reference as ref
from ..operators import uploads as up
from ..operators import upsert as ups
from ..sources.bucket_table import BucketTable
from ..sources.scratch import fresh_dir
from . import binding as b
from . import sqltext as q
from .book import query

# ---- reference files ----------------------------------------------------------------------------

_NORM_FILE = """f AS (
  SELECT CAST(o_custkey AS VARCHAR) AS sl_avto, o_orderpriority AS vid_norm_rasx, strftime(o_orderdate, '%Y') AS period,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS norma_rasx,
         CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS deystvuet_do, o_orderkey AS seq
  FROM orders)"""
_LAST = "arg_max({0}, CASE WHEN {0} IS NOT NULL THEN seq END)"
_LASTS = f"""lasts AS (
  SELECT sl_avto, vid_norm_rasx, {', '.join(f"{_LAST.format(c)} AS {c}" for c in ('period', 'norma_rasx', 'deystvuet_do'))}
  FROM f GROUP BY ALL)"""


@query(
    "norms_last",
    f"WITH {_NORM_FILE}, {_LASTS} SELECT sl_avto, vid_norm_rasx, period, {q.r('norma_rasx')}, deystvuet_do FROM lasts",
)
def norms_last(spark, d):
    return b.plain(ref.last_norms(b.norm_file(spark, d)))


_PIVOT = f"""WITH {_NORM_FILE}, {_LASTS}, s AS (SELECT * FROM lasts WHERE vid_norm_rasx = '1-URGENT'),
w AS (SELECT * FROM lasts WHERE vid_norm_rasx = '5-LOW'),
p AS (SELECT coalesce(s.sl_avto, w.sl_avto) AS auto,
        CASE WHEN w.sl_avto IS NULL THEN -1.0 ELSE w.norma_rasx END AS winter_norm,
        CASE WHEN s.sl_avto IS NULL THEN -1.0 ELSE s.norma_rasx END AS summer_norm,
        CASE WHEN s.sl_avto IS NOT NULL THEN s.deystvuet_do ELSE w.deystvuet_do END AS due
      FROM s FULL JOIN w ON s.sl_avto = w.sl_avto)"""


@query("norms_pivot", f"{_PIVOT} SELECT auto, {q.r('winter_norm', 'summer_norm')}, due FROM p")
def norms_pivot(spark, d):
    return b.plain(ref.parse_norms(b.norm_file(spark, d), **b.NORM_KINDS))


@query(
    "norms_pivot_swapped",
    f"{_PIVOT} SELECT auto, round(summer_norm + 1.23e-7, 6) + 0.0 AS winter_norm, round(winter_norm + 1.23e-7, 6) + 0.0 AS summer_norm, due FROM p WHERE due IS NOT NULL AND summer_norm IS NOT NULL AND winter_norm IS NOT NULL",
)
def norms_pivot_swapped(spark, d):
    parsed = ref.parse_norms(b.norm_file(spark, d), swap_seasons=True, **b.NORM_KINDS)
    return b.plain(ref.usable_norms(parsed))



@query(
    "car_name",
    """SELECT CAST(p_partkey AS VARCHAR) AS guid,
  coalesce(nullif(p_brand, 'Brand#1'), '') || ' ' || coalesce(nullif(p_type, 'ECONOMY'), '') || ' ' || p_name || CAST(p_size AS VARCHAR) AS name,
  p_type AS description, coalesce(CAST(nullif(p_size, 1) AS DOUBLE), 0.0) AS sl_tip_dvigat FROM part""",
)
def car_name(spark, d):
    raw = b.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("guid"),
        F.col("p_size").cast("string").alias("gos_nomer"),
        F.col("p_name").alias("vin_nomer"),
        F.nullif("p_brand", F.lit("Brand#1")).alias("marka"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("model"),
        F.col("p_type").alias("description"),
        F.nullif("p_size", F.lit(1)).cast("double").alias("sl_tip_dvigat"),
    )
    return ref.usable_cars(ref.parse_cars(raw))


def _fleet(spark, d):
    return b.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("guid"),
        F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("description"),
        F.nullif("p_size", F.lit(3)).cast("double").alias("winter_norm"),
        (F.col("p_retailprice") / 100).alias("summer_norm"),
        F.concat(F.lit("2025-01-"), F.lpad((F.col("p_size") % 31).cast("string"), 2, "0")).alias("due"),
        (F.col("p_partkey") % 3).cast("double").alias("engine_type"),
        F.col("p_partkey").alias("seq"),
    )


_DUE = "'2025-01-' || lpad(CAST(p_size % 31 AS VARCHAR), 2, '0')"


@query(
    "fleet_cars",
    "SELECT CAST(p_partkey AS VARCHAR) AS guid, ' ' || p_name || ' ' AS name, nullif(p_type, 'ECONOMY') AS description, CAST(p_partkey % 3 AS INTEGER) AS engine_type FROM part",
)
def fleet_cars(spark, d):
    return ref.split_fleet(_fleet(spark, d))[0].drop("seq")


@query(
    "fleet_norms",
    f"SELECT CAST(p_partkey AS VARCHAR) AS car, CAST(nullif(p_size, 3) AS DOUBLE) AS winter_norm, round(p_retailprice / 100 + 1.23e-7, 6) + 0.0 AS summer_norm, {_DUE} AS due FROM part",
)
def fleet_norms(spark, d):
    return b.plain(ref.split_fleet(_fleet(spark, d))[1].drop("seq"))


# ---- upserts ------------------------------------------------------------------------------------


def _load_norms(spark, d):
    return ups.load_norms(ref.split_fleet(_fleet(spark, d))[1].drop("seq"), b.cars(spark, d))


@query(
    "norm_load",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS car, coalesce(CAST(nullif(p_size, 3) AS DOUBLE), -1.0) AS winter_volume,
  round(p_retailprice / 100 + 1.23e-7, 6) + 0.0 AS summer_volume, strftime(try_cast({_DUE} AS DATE), '%Y-%m-%d') AS valid_period
FROM part WHERE p_partkey IN (SELECT c_custkey FROM customer) AND ({_DUE} IS NULL OR try_cast({_DUE} AS DATE) IS NOT NULL)""",
)
def norm_load(spark, d):
    return b.plain(_load_norms(spark, d)[0])


@query(
    "norm_rejects",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS car, CAST(nullif(p_size, 3) AS DOUBLE) AS winter_norm,
  round(p_retailprice / 100 + 1.23e-7, 6) + 0.0 AS summer_norm, {_DUE} AS due
FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) OR ({_DUE} IS NOT NULL AND try_cast({_DUE} AS DATE) IS NULL)""",
)
def norm_rejects(spark, d):
    return b.plain(_load_norms(spark, d)[1])


_CAR_UPSERT = f"""WITH {q.CARS}, n AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
  coalesce(nullif(p_type, 'ECONOMY'), '') AS description, CAST(p_partkey % 3 AS DOUBLE) AS engine_type FROM part)
SELECT coalesce(c.id, n.id) AS id, CASE WHEN n.id IS NULL THEN c.name ELSE n.name END AS name,
  CASE WHEN n.id IS NULL THEN c.description ELSE n.description END AS description,
  CASE WHEN c.id IS NULL THEN n.engine_type ELSE c.engine_type END AS engine_type,
  CASE WHEN c.id IS NULL THEN 'own' ELSE c.organization END AS organization
FROM cars c FULL JOIN n ON c.id = n.id"""


@query("car_upsert", _CAR_UPSERT)
def car_upsert(spark, d):
    return ups.upsert_cars(b.cars(spark, d), _fleet(spark, d).drop("winter_norm", "summer_norm", "due"), "own")



@query("car_upsert_buckets", _CAR_UPSERT)
def car_upsert_buckets(spark, d):
    """The same, in a table of buckets that are written over one by one."""
    cars = b.cars(spark, d)
    table = BucketTable(spark, fresh_dir(spark, "cars"), cars.schema)
    table.create(cars)
    table.merge(_fleet(spark, d).drop("winter_norm", "summer_norm", "due"), "guid", lambda old, new: ups.upsert_cars(old, new, "own"))
    return table.read()


@query(
    "status_merge_buckets",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS organization,
  CASE WHEN o_orderkey % 50 = 0 THEN 'completed' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 50 <> 1""",
)
def status_merge_buckets(spark, d):
    """Some requests are completed and some deleted, in the buckets of their ids."""
    rows = b.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("organization"), F.col("o_orderstatus").alias("status"))
    table = BucketTable(spark, fresh_dir(spark, "requests"), rows.schema)
    table.create(rows)
    number = F.col("id").cast("long") % 50
    done, gone = rows.filter(number == 0).select("id"), rows.filter(number == 1).select("id")
    table.merge(done, "id", lambda old, ids: ups.update_where(old.join(ids.withColumn("hit", F.lit(True)), "id", "left"), F.col("hit"), status="completed"))
    table.merge(gone, "id", lambda old, ids: old.join(ids, "id", "left_anti"))
    return table.read()


@query(
    "metrics_upsert",
    f"""WITH both_sides AS (
  SELECT '0' AS organization, CAST(o_custkey AS VARCHAR) AS auto, o_orderdate AS timestamp, o_totalprice AS y, o_orderkey AS seq, 0 AS side FROM orders
  UNION ALL SELECT '0', CAST(l_suppkey AS VARCHAR), l_shipdate, l_extendedprice, l_orderkey * 100 + l_linenumber, 1 FROM lineitem)
SELECT organization, auto, {q.t('timestamp')}, {q.r('y')}, CAST(side AS INTEGER) AS side FROM both_sides
QUALIFY row_number() OVER (PARTITION BY organization, auto, timestamp ORDER BY side DESC, seq DESC, y DESC) = 1""",
)
def metrics_upsert(spark, d):
    """Points written again replace stored ones; the last of several on a side counts."""
    key = [F.lit("0").alias("organization")]
    old = b.table(spark, d, "orders").select(
        *key, F.col("o_custkey").cast("string").alias("auto"), F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("y"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("side"),
    )
    new = b.table(spark, d, "lineitem").select(
        *key, F.col("l_suppkey").cast("string").alias("auto"), F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        F.lit(1).alias("side"),
    )
    out = ups.upsert(old, new, ["organization", "auto", "timestamp"], ["seq", "y"])
    return b.plain(out.drop("seq"))


@query(
    "bulk_status",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS organization,
  CASE WHEN o_orderstatus = 'P' THEN 'completed' ELSE o_orderstatus END AS status FROM orders""",
)
def bulk_status(spark, d):
    rows = b.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("organization"),
        F.col("o_orderstatus").alias("status"),
    )
    return ups.update_where(rows, F.col("status") == "P", status="completed")


@query(
    "user_switch",
    "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS username, s_acctbal > 5000 OR coalesce(CASE WHEN s_acctbal >= 0 THEN s_nationkey END = 3, false) AS is_active FROM supplier",
)
def user_switch(spark, d):
    """All users of one tenant are activated."""
    out = ups.update_where(b.users(spark, d), F.col("org") == "3", is_active=True)
    return out.select("id", "username", "is_active")


def _cascade(spark, d):
    tables = b.fleet_tables(spark, d, "organization", "org_user", "car", "car_consumption", "car_report", "driver_car")
    ids = b.table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").cast("string").alias("id"))
    return ups.cascade_delete(tables, "organization", ids)


_KEPT = "(SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey <> 2)"


@query(
    "cascade_delete",
    f"""WITH {q.REPORTS}, {q.CARS}, {q.DRIVERS}, kept AS (SELECT id FROM cars WHERE organization IN {_KEPT}),
lost AS (SELECT id FROM cars WHERE organization NOT IN {_KEPT})
SELECT 'car' AS table_name, id AS key FROM kept
UNION ALL SELECT 'car_report', id FROM reports WHERE car NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'car_consumption', id FROM kept
UNION ALL SELECT 'driver_car', driver || '/' || car FROM links WHERE car NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'org_user', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE NOT (s_acctbal >= 0 AND CAST(s_nationkey AS VARCHAR) NOT IN {_KEPT})
UNION ALL SELECT 'organization', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey <> 2""",
)
def cascade_delete(spark, d):
    """What is left after deleting the tenants of one region."""
    left = _cascade(spark, d)
    out = None
    for name in ("car", "car_report", "car_consumption", "driver_car", "org_user", "organization"):
        key = F.concat_ws("/", "driver", "car") if name == "driver_car" else F.col("id")
        part = left[name].select(F.lit(name).alias("table_name"), key.alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- uploads ------------------------------------------------------------------------------------


@query("file_hash", "SELECT doc_id, sha256(text) AS file_hash, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def file_hash(spark, d):
    return b.table(spark, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("size")
    )


@query(
    "duplicate_uploads",
    f"""WITH {q.UPLOADS} SELECT CAST(id AS VARCHAR) AS id, organization, 'created' AS status, 'text/csv' AS media_type,
  filename, size, type, file_hash FROM uploads u
WHERE NOT EXISTS (SELECT 1 FROM uploads o WHERE o.status = 'completed' AND o.filename = u.filename AND o.size = u.size
                  AND o.type = u.type AND o.file_hash = u.file_hash)""",
)
def duplicate_uploads(spark, d):
    """Every file is uploaded a second time: which ones are taken in."""
    manifest = b.uploads(spark, d)
    again = manifest.withColumn("id", F.col("id").cast("string")).drop("status")
    return up.register_uploads(again, manifest, F.col("organization"))


@query(
    "prerequisite",
    f"""WITH {q.UPLOADS} SELECT id, organization, filename FROM uploads u WHERE EXISTS (
  SELECT 1 FROM uploads o WHERE o.organization = u.organization AND o.type = 'auto' AND o.status = 'completed')""",
)
def prerequisite(spark, d):
    uploads = b.uploads(spark, d)
    return up.ready(uploads, uploads, "auto").select("id", "organization", "filename")


@query(
    "pending_uploads",
    f"""WITH {q.UPLOADS}, done AS (SELECT organization, type FROM uploads WHERE status = 'completed')
SELECT organization, max(id) AS id FROM uploads WHERE type = 'raw' AND status = 'created'
  AND organization IN (SELECT organization FROM done WHERE type = 'auto')
  AND organization IN (SELECT organization FROM done WHERE type = 'norm') GROUP BY ALL""",
)
def pending_uploads(spark, d):
    return up.pending_uploads(b.uploads(spark, d)).select("organization", "id")


@query(
    "upload_types",
    f"WITH {q.UPLOADS} SELECT id, filename, type, 'csv' AS kind, 'text/csv' AS media_type FROM uploads WHERE type IN ('raw', 'auto')",
)
def upload_types(spark, d):
    good, _ = up.split_by_type(b.uploads(spark, d))
    path = F.col("filename")
    return good.select("id", "filename", "type", up.file_kind(path).alias("kind"), up.media_type(path).alias("media_type"))


@query(
    "status_steps",
    f"WITH {q.UPLOADS} SELECT id, CASE WHEN type = 'raw' AND status = 'created' THEN 'pending' ELSE status END AS status FROM uploads",
)
def status_steps(spark, d):
    return up.advance(b.uploads(spark, d), F.col("type") == "raw", "pending").select("id", "status")


# ---- entities -----------------------------------------------------------------------------------


# What a listing touches besides its own table.
_WITH = {
    "org_user": ["organization"],
    "car": ["organization"],
    "car_consumption": ["car", "organization"],
    "car_report": ["car", "organization"],
    "report_query": ["organization", "media"],
    "media": ["report_query"],
    "driver": ["driver_car", "car", "organization"],
}


def _tables(spark, d, name):
    return b.fleet_tables(spark, d, name, *_WITH[name])


def _list(spark, d, name, org=None, **options):
    options.setdefault("page_number", None)
    return ent.list_entities(_tables(spark, d, name), name, org, **options)


_CARS_ORGS = f"{q.CARS}, {q.ORGS}"


@query(
    "entity_page",
    f"""WITH {_CARS_ORGS}, {q.REPORTS}
SELECT r.id, {q.t('r.datetime', 'datetime')}, r.volume, r.status, c.id AS car_id, c.name AS car_name, o.name AS org_name
FROM reports r JOIN cars c ON r.car = c.id JOIN orgs o ON c.organization = o.id WHERE c.organization = '7'
ORDER BY r.datetime, r.id LIMIT 50 OFFSET 50""",
)
def entity_page(spark, d):
    """Second page of a tenant's report list, 50 to a page."""
    out = _list(spark, d, "car_report", "7", page_number=2, size=50)
    return b.plain(
        out.select(
            "id", "datetime", "volume", "status", F.col("car.id").alias("car_id"), F.col("car.name").alias("car_name"),
            F.col("car.organization.name").alias("org_name"),
        )
    )


@query(
    "entity_page_after",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE CAST(c_custkey AS VARCHAR) > '1100' ORDER BY 1 LIMIT 25",
)
def entity_page_after(spark, d):
    """A page found by the last key seen, at the page size of the back office."""
    out = _list(spark, d, "car", page_number=1, size=ent.ADMIN_PAGE_SIZE, after=("1100",), nested=False)
    return out.select("id", "name")


@query("entity_total", f"WITH {q.REPORTS}, {q.CARS} SELECT count(*) AS total FROM reports JOIN cars c ON car = c.id WHERE c.organization = '7'")
def entity_total(spark, d):
    return ent.total_rows(_list(spark, d, "car_report", "7", nested=False))


@query(
    "entity_search",
    f"""WITH {_CARS_ORGS} SELECT c.id, c.name, c.description, c.organization FROM cars c JOIN orgs o ON c.organization = o.id
WHERE (contains(lower(c.name), '12') OR contains(lower(c.description), '12') OR contains(lower(o.name), '12'))
  AND (contains(lower(c.name), 'build') OR contains(lower(c.description), 'build') OR contains(lower(o.name), 'build'))""",
)
def entity_search(spark, d):
    """Vehicles matching both terms in name, description or tenant name."""
    return _list(spark, d, "car", search="12, BUILD", nested=False).select("id", "name", "description", "organization")


@query(
    "driver_search",
    f"""WITH {q.CARS}, {q.DRIVERS} SELECT id, fullname FROM drivers dr
WHERE EXISTS (SELECT 1 FROM links l JOIN cars c ON l.car = c.id WHERE l.driver = dr.id)
  AND (contains(lower(fullname), '0000001') OR contains(address, '0000001') OR contains(phone, '0000001')
   OR EXISTS (SELECT 1 FROM links l JOIN cars c ON l.car = c.id WHERE l.driver = dr.id AND contains(lower(c.name), '0000001')))
  AND (contains(lower(fullname), 'supplier') OR contains(address, 'supplier') OR contains(phone, 'supplier')
   OR EXISTS (SELECT 1 FROM links l JOIN cars c ON l.car = c.id WHERE l.driver = dr.id AND contains(lower(c.name), 'supplier')))""",
)
def driver_search(spark, d):
    return _list(spark, d, "driver", search="0000001 Supplier", nested=False).select("id", "fullname")


@query(
    "entity_filter",
    f"WITH {q.CARS}, {q.REPORTS} SELECT r.id, r.car, {q.t('datetime')}, volume FROM reports r JOIN cars c ON r.car = c.id WHERE r.status AND c.organization = '11'",
)
def entity_filter(spark, d):
    out = _list(spark, d, "car_report", "11", filters={"status": True}, nested=False)
    return b.plain(out.select("id", "car", "datetime", "volume"))


@query(
    "entity_detail",
    f"WITH {_CARS_ORGS} SELECT c.id, c.name, c.engine_type, o.id AS org_id, o.name AS org_name FROM cars c JOIN orgs o ON c.organization = o.id WHERE c.id = '1' AND o.id = '19'",
)
def entity_detail(spark, d):
    out = ent.get_entity(_tables(spark, d, "car"), "car", "19", "1")
    org = F.col("organization")
    return out.select("id", "name", "engine_type", org["id"].alias("org_id"), org["name"].alias("org_name"))


@query(
    "nested_report",
    f"""WITH {_CARS_ORGS}, {q.REPORTS}
SELECT r.id, {q.t('r.datetime', 'datetime')}, r.volume, c.id AS car_id, c.engine_type, o.id AS org_id, o.name AS org_name, o.bot_token
FROM reports r JOIN cars c ON r.car = c.id JOIN orgs o ON c.organization = o.id""",
)
def nested_report(spark, d):
    out = _list(spark, d, "car_report")
    car = F.col("car")
    org = car["organization"]
    return b.plain(
        out.select(
            "id", "datetime", "volume", car["id"].alias("car_id"), car["engine_type"].alias("engine_type"),
            org["id"].alias("org_id"), org["name"].alias("org_name"), org["bot_token"].alias("bot_token"),
        )
    )


@query(
    "nested_consumption",
    f"""WITH {_CARS_ORGS}, {q.NORMS}
SELECT norm_id AS id, c.name AS car_name, o.name AS org_name, norma_rasx_winter AS winter_volume, strftime(period, '%Y-%m-%d') AS valid_period
FROM norms n JOIN cars c ON n.sl_avto = c.id JOIN orgs o ON c.organization = o.id""",
)
def nested_consumption(spark, d):
    out = _list(spark, d, "car_consumption")
    car = F.col("car")
    org_name = car["organization"]["name"].alias("org_name")
    return b.plain(out.select("id", car["name"].alias("car_name"), org_name, "winter_volume", "valid_period"))


@query(
    "user_orgs",
    f"WITH {q.ORGS} SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS username, o.name AS org_name FROM supplier LEFT JOIN orgs o ON CASE WHEN s_acctbal >= 0 THEN CAST(s_nationkey AS VARCHAR) END = o.id",
)
def user_orgs(spark, d):
    out = _list(spark, d, "org_user")
    return out.select("id", "username", F.col("org")["name"].alias("org_name"))


@query(
    "query_media",
    f"""WITH {q.UPLOADS}, {q.ORGS}
SELECT CAST(u.id AS VARCHAR) AS id, o.name AS org_name, status, CAST(0 AS INTEGER) AS part, 'm' || u.id || ':' || file_hash AS media
FROM uploads u JOIN orgs o ON o.id = CAST((length(organization) + size) % 25 AS VARCHAR)""",
)
def query_media(spark, d):
    """Upload requests with tenant and media list."""
    out = _list(spark, d, "report_query")
    items = F.transform("media", lambda m: F.concat_ws(":", m["id"], m["file_hash"]))
    return out.select("id", F.col("organization")["name"].alias("org_name"), "status", "part", F.array_join(items, ",").alias("media"))


@query(
    "media_list",
    f"WITH {q.UPLOADS} SELECT 'm' || id AS id, CAST(id AS VARCHAR) AS report_query, filename, size FROM uploads WHERE CAST((length(organization) + size) % 25 AS VARCHAR) = '4'",
)
def media_list(spark, d):
    return _list(spark, d, "media", "4", nested=False).select("id", "report_query", "filename", "size")


@query(
    "driver_cars",
    f"""WITH {q.CARS}, {q.DRIVERS}
SELECT dr.id, fullname, CAST(0 AS INTEGER) AS part, string_agg(c.id || '@' || c.organization, ',' ORDER BY c.id) AS cars
FROM drivers dr JOIN links l ON l.driver = dr.id JOIN cars c ON l.car = c.id GROUP BY ALL""",
)
def driver_cars(spark, d):
    """Drivers with the list of their vehicles."""
    out = _list(spark, d, "driver")
    items = F.transform("car", lambda c: F.concat_ws("@", c["id"], c["organization"]["id"]))
    return out.select("id", "fullname", "part", F.array_join(items, ",").alias("cars"))


@query(
    "driver_per_car",
    f"WITH {q.CARS}, {q.DRIVERS} SELECT dr.id, fullname FROM drivers dr JOIN links l ON l.driver = dr.id JOIN cars c ON l.car = c.id WHERE c.organization = '5'",
)
def driver_per_car(spark, d):
    """A tenant's drivers, once per vehicle."""
    return _list(spark, d, "driver", "5", nested=False, distinct=False).select("id", "fullname")


@query(
    "car_list_display",
    f"""WITH {q.CARS}, {q.DRIVERS}, n AS (
  SELECT driver, list(name ORDER BY name, car) AS names FROM links JOIN cars c ON car = c.id GROUP BY driver)
SELECT dr.id, coalesce(array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN '...' ELSE '' END, '') AS cars
FROM drivers dr LEFT JOIN n ON n.driver = dr.id""",
)
def car_list_display(spark, d):
    return ent.car_list(b.drivers(spark, d), b.driver_car(spark, d), b.cars(spark, d)).select("id", "cars")


@query(
    "token_mask",
    f"WITH {q.ORGS} SELECT id, CASE WHEN length(bot_token) > 0 THEN '****' || right(bot_token, 4) ELSE 'Не указан' END AS bot_token FROM orgs",
)
def token_mask(spark, d):
    return b.organizations(spark, d).select("id", mask_tail(F.col("bot_token")).alias("bot_token"))


@query("facets", "SELECT DISTINCT CAST(c_custkey % 2 AS DOUBLE) AS engine_type FROM customer")
def facets(spark, d):
    return ent.facets(b.cars(spark, d), "engine_type")


@query("facets_period", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS datetime FROM orders")
def facets_period(spark, d):
    return b.plain(ent.facets(b.reports(spark, d), "datetime"))


@query(
    "first_of_order",
    f"WITH {q.REPORTS} SELECT id, {q.t('datetime')} FROM reports ORDER BY reports.datetime DESC, id LIMIT 1",
)
def first_of_order(spark, d):
    """First row in an entity's own order."""
    tables = _tables(spark, d, "car_report")
    return b.plain(ent.first_row(tables["car_report"], tables, "car_report").select("id", "datetime"))


@query(
    "sorted_norms",
    f"WITH {q.CARS}, {q.NORMS} SELECT norm_id AS id, sl_avto AS car, norma_rasx_summer AS summer_volume FROM norms JOIN cars ON sl_avto = id",
)
def sorted_norms(spark, d):
    """Norms in their own order, by vehicle name and period."""
    tables = _tables(spark, d, "car_consumption")
    return ent.default_sorted(tables["car_consumption"], tables, "car_consumption").select("id", "car", "summer_volume")


@query(
    "car_labels",
    "SELECT c_custkey, c_mktsegment || ' ' || c_name || ' ' || c_nationkey || c_custkey AS name FROM customer",
)
def car_labels(spark, d):
    text = b.table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", "c_name", F.col("c_nationkey").cast("string").alias("v"),
        F.col("c_custkey").cast("string").alias("g"),
    )
    return text.select("c_custkey", car_label("c_mktsegment", "c_name", "v", "g").alias("name"))
