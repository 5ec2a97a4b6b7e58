"""More queries over the fleet tables: details of every entity, facets, pages backwards, status."""

from pyspark.sql import functions as F

from ..operators import entities as ent
from ..operators import leaks
from ..operators import uploads as up
from ..operators import upsert as ups
from . import binding as b
from . import sqltext as q
from .book import query

P = b.WIDE


def _all(spark, d):
    return b.fleet_tables(spark, d)


@query("organization_list", f"WITH {q.ORGS} SELECT id, name, bot_token, chat_id FROM orgs WHERE contains(lower(name), 'an') OR contains(lower(coalesce(bot_token, '')), 'an') OR contains(lower(chat_id), 'an')")
def organization_list(spark, d):
    return ent.list_entities(_all(spark, d), "organization", search="AN", page_number=None).select("id", "name", "bot_token", "chat_id")


@query("organization_detail", f"WITH {q.ORGS} SELECT id, name FROM orgs WHERE id = '7'")
def organization_detail(spark, d):
    return ent.get_entity(_all(spark, d), "organization", "7", "7").select("id", "name")


@query("user_detail", f"WITH {q.ORGS} SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS username, o.name AS org_name FROM supplier JOIN orgs o ON CAST(s_nationkey AS VARCHAR) = o.id WHERE s_acctbal >= 0 AND s_suppkey = 1")
def user_detail(spark, d):
    return ent.get_entity(_all(spark, d), "org_user", None, "1").filter("org is not null").select("id", "username", F.col("org.name").alias("org_name"))


@query("consumption_detail", f"WITH {q.CARS}, {q.NORMS} SELECT norm_id AS id, c.name AS car_name, norma_rasx_winter AS winter_volume FROM norms n JOIN cars c ON n.sl_avto = c.id WHERE norm_id = '5'")
def consumption_detail(spark, d):
    return ent.get_entity(_all(spark, d), "car_consumption", None, "5").select("id", F.col("car.name").alias("car_name"), "winter_volume")


@query("report_detail", f"WITH {q.CARS}, {q.REPORTS} SELECT r.id, c.name AS car_name, volume FROM reports r JOIN cars c ON r.car = c.id WHERE r.id = '7'")
def report_detail(spark, d):
    return ent.get_entity(_all(spark, d), "car_report", None, "7").select("id", F.col("car.name").alias("car_name"), "volume")


@query("request_detail", f"WITH {q.UPLOADS} SELECT CAST(id AS VARCHAR) AS id, status, 'm' || id AS media FROM uploads WHERE id = 7")
def request_detail(spark, d):
    out = ent.get_entity(_all(spark, d), "report_query", None, "7")
    return out.select("id", "status", F.element_at("media", 1)["id"].alias("media"))


@query("media_detail", f"WITH {q.UPLOADS} SELECT 'm' || id AS id, filename, size FROM uploads WHERE id = 7")
def media_detail(spark, d):
    return ent.get_entity(_all(spark, d), "media", None, "m7").select("id", "filename", "size")


@query("driver_detail", f"WITH {q.CARS}, {q.DRIVERS} SELECT dr.id, fullname, count(*) AS n_cars FROM drivers dr JOIN links l ON l.driver = dr.id JOIN cars c ON c.id = l.car WHERE dr.id = '3' GROUP BY ALL")
def driver_detail(spark, d):
    out = ent.get_entity(_all(spark, d), "driver", None, "3")
    return out.select("id", "fullname", F.size("car").cast("long").alias("n_cars"))


@query(
    "facets_joined",
    f"WITH {q.UPLOADS} SELECT DISTINCT CAST((length(organization) + size) % 25 AS VARCHAR) AS value FROM uploads",
)
def facets_joined(spark, d):
    """Tenants of the requests that media belong to."""
    return ent.entity_facets(_all(spark, d), "media", "report_query.organization")


@query(
    "media_search",
    f"WITH {q.UPLOADS}, {q.ORGS} SELECT 'm' || u.id AS id FROM uploads u JOIN orgs o ON o.id = CAST((length(organization) + size) % 25 AS VARCHAR) WHERE contains(lower(o.name), 'united')",
)
def media_search(spark, d):
    """Media by the name of the tenant, two foreign keys away."""
    return ent.list_entities(_all(spark, d), "media", search="UNITED", page_number=None, nested=False).select("id")


@query(
    "entity_page_down",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS description FROM customer WHERE (c_mktsegment, CAST(c_custkey AS VARCHAR)) < ('FURNITURE', '5') ORDER BY c_mktsegment DESC, 1 DESC LIMIT 40",
)
def entity_page_down(spark, d):
    """A page in descending order, after the last row seen."""
    return ent.page(b.cars(spark, d), ("-description", "-id"), 1, 40, after=("FURNITURE", "5")).select("id", "name", "description")


@query(
    "cascade_requests",
    f"""WITH {q.UPLOADS}, req AS (SELECT id, CAST((length(organization) + size) % 25 AS INTEGER) AS org FROM uploads),
left_over AS (SELECT id FROM req WHERE org NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))
SELECT 'report_query' AS table_name, CAST(id AS VARCHAR) AS key FROM left_over UNION ALL SELECT 'media', 'm' || id FROM left_over""",
)
def cascade_requests(spark, d):
    """Requests and their media after the tenants of one region are deleted from all nine tables."""
    ids = b.table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").cast("string").alias("id"))
    left = ups.cascade_delete(_all(spark, d), "organization", ids)
    return left["report_query"].select(F.lit("report_query").alias("table_name"), F.col("id").alias("key")).unionByName(
        left["media"].select(F.lit("media").alias("table_name"), F.col("id").alias("key"))
    )


@query(
    "upload_status",
    f"""WITH {q.UPLOADS}, able AS (SELECT organization FROM uploads WHERE status = 'completed' AND type = 'auto'
  INTERSECT SELECT organization FROM uploads WHERE status = 'completed' AND type = 'norm'),
nxt AS (SELECT max(id) AS id FROM uploads WHERE type = 'raw' AND status = 'created' AND organization IN (SELECT organization FROM able) GROUP BY organization)
SELECT id, CASE WHEN id NOT IN (SELECT id FROM nxt) THEN status WHEN id % 2 = 0 THEN 'completed' ELSE 'error' END AS status FROM uploads""",
)
def upload_status(spark, d):
    """The next upload of every tenant that is ready runs; those with an odd id fail and stop nobody else."""

    def process(one):
        if one % 2:
            raise RuntimeError(f"upload {one} can't be read")

    return up.run_ready(b.uploads(spark, d), process, failures=(RuntimeError,)).select("id", "status")


@query(
    "missing_cars",
    f"""WITH {q.cascade(P)}, {q.CARS}, {q.NORMS}, {q.detection(P)}
SELECT DISTINCT auto AS id, 'Car ' || auto AS name, ' ' AS description, CAST(CAST(auto AS INTEGER) % 2 AS DOUBLE) AS engine_type, 'o9' AS organization
FROM leaks WHERE is_leak AND CAST(auto AS INTEGER) % 3 <> 0""",
)
def missing_cars(spark, d):
    """Vehicles with a drain that the table lacks: it holds every third one."""
    tables = b.fleet_tables(spark, d, "car", "car_consumption")
    found = leaks.leak_pipeline(b.telemetry(spark, d), tables["car"].withColumn("name", F.concat(F.lit(" Car "), "id")), tables["car_consumption"], P)
    return ups.missing_cars(found, tables["car"].filter(F.col("id").cast("int") % 3 == 0), "o9")


# Of each entity: where its rows come from, and its facets as text.
_FACETS = {
    "organization": ("orgs", {"name": "name"}),
    "org_user": ("supplier", {"org": "CASE WHEN s_acctbal >= 0 THEN CAST(s_nationkey AS VARCHAR) END", "is_active": "CAST(s_acctbal > 5000 AS VARCHAR)", "is_staff": "CAST(s_acctbal > 9000 AS VARCHAR)"}),
    "car": ("cars", {"organization": "organization", "engine_type": "printf('%.1f', engine_type)"}),
    "car_consumption": ("norms", {"car": "sl_avto", "valid_period": "strftime(period, '%Y-%m-%d')"}),
    "report_query": ("uploads", {"status": "status", "organization": "CAST((length(organization) + size) % 25 AS VARCHAR)"}),
    "media": ("uploads", {"type": "type", "report_query.organization": "CAST((length(organization) + size) % 25 AS VARCHAR)"}),
    "car_report": ("reports", {"car": "car", "datetime": "strftime(datetime, '%Y-%m-%d')", "status": "CAST(status AS VARCHAR)"}),
    "driver": ("drivers", {"fullname": "fullname"}),
}


@query(
    "all_facets",
    f"WITH {q.ORGS}, {q.CARS}, {q.NORMS}, {q.UPLOADS}, {q.REPORTS}, {q.DRIVERS} "
    + " UNION ALL ".join(f"SELECT '{name}' AS entity, '{facet}' AS facet, {text} AS value, count(*) AS rows FROM {source} GROUP BY ALL" for name, (source, facets) in _FACETS.items() for facet, text in facets.items()),
)
def all_facets(spark, d):
    """Every facet of every entity with its values and their numbers of rows, one pass for each entity."""
    tables = _all(spark, d)
    staff = b.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_acctbal") > 9000).alias("is_staff"))
    tables["org_user"] = tables["org_user"].join(staff, "id")
    tables["car_report"] = tables["car_report"].withColumn("datetime", F.col("datetime").cast("date"))
    out = None
    for name in _FACETS:
        one = ent.all_facets(tables, name).select(F.lit(name).alias("entity"), "facet", "value", "rows")
        out = one if out is None else out.unionByName(one)
    return out


_KINDS = "CASE id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.tar.Csv' END"


@query(
    "upload_kinds",
    f"""WITH {q.UPLOADS}, named AS (SELECT id, type, lang || {_KINDS} AS filename FROM uploads JOIN (SELECT doc_id, lang FROM documents) ON doc_id = id)
SELECT id, filename, type, CASE id % 5 WHEN 1 THEN 'xlsx' ELSE 'csv' END AS kind,
  CASE id % 5 WHEN 1 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'text/csv' END AS media_type
FROM named WHERE type IN ('raw', 'auto') AND id % 5 NOT IN (2, 3)""",
)
def upload_kinds(spark, d):
    """Uploads with known, unknown and no extensions, in any case."""
    kinds = F.array(*(F.lit(x) for x in (".csv", ".XLSX", ".txt", "", ".tar.Csv")))
    rows = b.uploads(spark, d).withColumn("filename", F.concat(F.regexp_replace("filename", "[.]csv$", ""), F.get(kinds, (F.col("id") % 5).cast("int"))))
    good, _ = up.split_by_type(rows)
    path = F.col("filename")
    return good.select("id", "filename", "type", up.file_kind(path).alias("kind"), up.media_type(path).alias("media_type"))


@query(
    "request_search_file",
    f"""WITH {q.UPLOADS}, {q.ORGS} SELECT CAST(u.id AS VARCHAR) AS id FROM uploads u JOIN orgs o ON o.id = CAST((length(organization) + size) % 25 AS VARCHAR)
WHERE (contains(lower(o.name), 'fr') OR contains(lower(filename), 'fr')) AND (contains(lower(o.name), 'csv') OR contains(lower(filename), 'csv'))""",
)
def request_search_file(spark, d):
    """The back office finds requests by the names of their files."""
    tables = _all(spark, d)
    return ent.search_entities(tables["report_query"], tables, "report_query", "FR csv", admin=True).select("id")


@query(
    "car_admin_page",
    f"WITH {q.CARS} SELECT id, name, engine_type FROM cars ORDER BY name, engine_type, id LIMIT {ent.ADMIN_PAGE_SIZE}",
)
def car_admin_page(spark, d):
    """The first page of vehicles in the back office, by name and engine type."""
    tables = _all(spark, d)
    return ent.default_sorted(tables["car"], tables, "car", admin=True).limit(ent.ADMIN_PAGE_SIZE).select("id", "name", "engine_type")
