"""Tenant-scoped listings and lookups over the fleet tables.

``tables`` maps table names (see ``schemas.TABLES``) to DataFrames. A listing narrows the base
table first (tenant, filters, search, page) and only then attaches what the row refers to, so a page
of 200 joins 200 rows, not the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import matches, split_terms

PAGE_SIZE, MAX_PAGE_SIZE, ADMIN_PAGE_SIZE = 200, 1000, 25


@dataclass(frozen=True)
class Entity:
    filters: tuple[str, ...]
    search: tuple[str, ...]  # "parent.column" reaches through a foreign key
    order: tuple[str, ...] = ("id",)  # page order
    default_order: tuple[str, ...] = ("id",)  # a leading "-" turns the order round
    facets: tuple[str, ...] = ()
    tenant: str | None = "organization"  # own column, or the parent that leads to the tenant
    parents: tuple[tuple[str, str, str], ...] = ()  # (foreign key, table, join type)
    # the back office, where it differs; "child>key.column" reaches the rows that refer to this one
    admin_search: tuple[str, ...] = ()
    admin_order: tuple[str, ...] = ()


# What each listing filters, searches and sorts by.
ENTITIES = {
    "organization": Entity(
        ("name",), ("name", "bot_token", "chat_id"), default_order=("name",), facets=("name",), tenant="id"
    ),
    "org_user": Entity(
        ("org", "username"), ("username", "email", "org.name"), default_order=("username",),
        facets=("org", "is_active", "is_staff"), tenant="org", parents=(("org", "organization", "left"),),
    ),
    "car": Entity(
        ("organization", "name"), ("id", "name", "description", "organization.name"),
        default_order=("organization.name", "name"), facets=("organization", "engine_type"), admin_order=("name", "engine_type"),
        parents=(("organization", "organization", "inner"),),
    ),
    "car_consumption": Entity(
        ("car", "valid_period"), ("car.name", "valid_period"),
        default_order=("car.name", "valid_period"), facets=("car", "valid_period"),
        tenant="car", parents=(("car", "car", "inner"),),
    ),
    "report_query": Entity(
        ("status", "organization"), ("organization.name", "status"), default_order=("-id",),
        facets=("status", "organization"), parents=(("organization", "organization", "inner"),),
        admin_search=("organization.name", "media>report_query.filename"),
    ),
    "media": Entity(
        ("type", "report_query"), ("filename", "media_type", "type", "report_query.organization.name"), default_order=("filename",),
        facets=("type", "report_query.organization"), tenant="report_query", parents=(("report_query", "report_query", "inner"),),
    ),
    "car_report": Entity(
        ("car", "datetime", "status"), ("car.name", "datetime"), order=("datetime", "id"),
        default_order=("-datetime",), facets=("car", "datetime", "status"),
        tenant="car", parents=(("car", "car", "inner"),),
    ),
    "driver": Entity(
        ("car", "phone"), ("fullname", "address", "phone", "car.name"), default_order=("fullname",),
        facets=("fullname",), tenant=None,
    ),
}


def _spec(name: str) -> Entity:
    if name not in ENTITIES:
        raise ValueError(f"unknown entity {name!r}")
    return ENTITIES[name]


# ---- tenant -------------------------------------------------------------------------------------


def tenant_scope(df: DataFrame, cars: DataFrame, org: str, key: str = "car") -> DataFrame:
    """Rows whose vehicle belongs to the tenant."""
    own = cars.filter(F.col("organization") == org).select(F.col("id").alias(key))
    return df.join(own, key, "left_semi")


def org_drivers(
    drivers: DataFrame, bridge: DataFrame, cars: DataFrame, org: str | None, distinct: bool = True
) -> DataFrame:
    """Drivers of at least one of the tenant's vehicles; ``distinct=False`` gives a driver once per
    such vehicle."""
    own = cars if org is None else cars.filter(F.col("organization") == org)
    links = bridge.join(own.select(F.col("id").alias("car")), "car", "left_semi")
    if not distinct:
        return drivers.join(links.select(F.col("driver").alias("id")), "id", "inner")
    # one row per driver before the join: the busiest driver costs the same as any other
    links = links.groupBy(F.col("driver").alias("id")).agg(F.lit(True).alias("_any")).select("id")
    return drivers.join(links, "id", "left_semi")


def _scoped(tables: dict, name: str, org: str | None, distinct: bool = True) -> DataFrame:
    df, spec = tables[name], _spec(name)
    if name == "driver":
        return org_drivers(df, tables["driver_car"], tables["car"], org, distinct)
    if org is None:
        return df
    if spec.tenant == "car":
        return tenant_scope(df, tables["car"], org)
    if spec.tenant == "report_query":
        return tenant_scope(df, tables["report_query"], org, "report_query")
    return df.filter(F.col(spec.tenant) == org)


# ---- narrowing ----------------------------------------------------------------------------------


def filter_entities(df: DataFrame, tables: dict, name: str, filters: dict) -> DataFrame:
    """Exact matches, only on the columns the entity allows."""
    spec = _spec(name)
    for key, value in (filters or {}).items():
        if key not in spec.filters:
            raise ValueError(f"{name} cannot be filtered by {key!r}")
        if name == "driver" and key == "car":
            links = tables["driver_car"].filter(F.col("car") == value)
            df = df.join(links.select(F.col("driver").alias("id")), "id", "left_semi")
        else:
            df = df.filter(F.col(key) == F.lit(value))
    return df


def _reach(df: DataFrame, tables: dict, name: str, path: str) -> tuple[DataFrame, Column]:
    """``df`` with what a path of foreign keys, such as "car.organization.name", leads to, as a column.
    Each step is joined once."""
    *keys, last = path.split(".")
    tag, column = "", (keys + [last])[0]
    for key, following in zip(keys, [*keys[1:], last]):
        table, how = next((t, h) for k, t, h in _spec(name).parents if k == key)
        tag += f"_{key}"
        if f"{tag}_id" not in df.columns:
            parent = tables[table].select(*(F.col(c).alias(f"{tag}_{c}") for c in tables[table].columns))
            df = df.join(parent, df[column] == parent[f"{tag}_id"], how)
        name, column = table, f"{tag}_{following}"
    return df, F.col(column)


def search_entities(df: DataFrame, tables: dict, name: str, text: str | None, admin: bool = False) -> DataFrame:
    """Keep rows matching every term in some search column; ``admin`` searches what the back office does."""
    spec = _spec(name)
    if not text or not text.strip():
        return df
    if name == "driver":
        return _search_drivers(df, tables, text)
    columns = admin and spec.admin_search or spec.search
    fields, joined = [], df
    for column in (c for c in columns if ">" not in c):
        joined, field = _reach(joined, tables, name, column)
        fields.append(field)
    children = [c for c in columns if ">" in c]
    if not children:
        return joined.filter(matches(fields, text)).select(*df.columns)
    terms = split_terms(text)
    cond = [matches(fields, f'"{t}"') for t in terms]
    for n, path in enumerate(children):
        joined = joined.join(_child_hits(tables, path, terms, f"_hit{n}"), "id", "left")
        cond = [c | F.coalesce(F.col(f"_hit{n}")[k], F.lit(False)) for k, c in enumerate(cond)]
    return joined.filter(reduce(Column.__and__, cond, F.lit(True))).select(*df.columns)


def _child_hits(tables: dict, path: str, terms: list[str], name: str) -> DataFrame:
    """(id, ``name``): for each row that others refer to, whether each term is in the column of some of them.
    One row for each, however many there are."""
    child, _, rest = path.partition(">")
    key, column = rest.split(".")
    hits = [F.coalesce(F.max(matches([F.col(column)], f'"{t}"')), F.lit(False)) for t in terms]
    return tables[child].groupBy(F.col(key).alias("id")).agg(F.array(*hits).alias(name))


def _search_drivers(df: DataFrame, tables: dict, text: str) -> DataFrame:
    """A driver matches if each term is in a column of their own or in the name of some vehicle.
    Per-term hits of the vehicles are reduced to one row per driver, whatever their number."""
    terms = split_terms(text)
    cars = tables["car"].select(F.col("id").alias("car"), F.col("name").alias("_car_name"))
    hits = (
        tables["driver_car"]
        .join(cars, "car")
        .groupBy(F.col("driver").alias("id"))
        .agg(*[F.max(matches([F.col("_car_name")], f'"{t}"')).alias(f"_hit{i}") for i, t in enumerate(terms)])
    )
    own = [F.col(c) for c in ("fullname", "address", "phone")]
    cond = F.lit(True)
    for i, term in enumerate(terms):
        cond = cond & (matches(own, f'"{term}"') | F.coalesce(F.col(f"_hit{i}"), F.lit(False)))
    return df.join(hits, "id", "left").filter(cond).select(*df.columns)


# ---- order and pages ----------------------------------------------------------------------------


def _sort_key(column: str) -> Column:
    return F.col(column[1:]).desc() if column.startswith("-") else F.col(column).asc()


def default_sorted(df: DataFrame, tables: dict, name: str, admin: bool = False) -> DataFrame:
    """Sort as the entity is listed when nothing else is asked for, or as the back office does."""
    spec, columns = _spec(name), df.columns
    keys = []
    for path in admin and spec.admin_order or spec.default_order:
        df, column = _reach(df, tables, name, path.lstrip("-"))
        keys.append(column.desc() if path.startswith("-") else column.asc())
    return df.orderBy(*keys, "id").select(*columns)


def page(df: DataFrame, order: tuple[str, ...], number: int = 1, size: int = PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """Page ``number`` of ``size`` rows. For deep pages pass ``after``, the order values of the
    last row seen: the page then costs the same at any depth."""
    size = min(max(int(size), 1), MAX_PAGE_SIZE)
    if number < 1:
        raise ValueError("pages start at 1")
    keys = [_sort_key(c) for c in order]
    if after is None:
        return df.orderBy(*keys).offset((number - 1) * size).limit(size)
    # rows beyond a key: greater in the first column, or equal in it and beyond in the rest; the bound
    # on the first column alone is what the scan can use
    beyond, bound = F.lit(False), None
    for c, v in reversed(list(zip(order, after))):
        col, down = F.col(c.lstrip("-")), c.startswith("-")
        further = col < F.lit(v) if down else col > F.lit(v)
        beyond = further | ((col == F.lit(v)) & beyond)
        bound = col <= F.lit(v) if down else col >= F.lit(v)
    return df.filter(bound & beyond).orderBy(*keys).limit(size)


def first_row(df: DataFrame, tables: dict, name: str) -> DataFrame:
    return default_sorted(df, tables, name).limit(1)


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


# ---- nesting ------------------------------------------------------------------------------------


def with_parent(df: DataFrame, parent: DataFrame, fk: str, how: str = "inner") -> DataFrame:
    """Replace a foreign key by the row it points to, as a struct."""
    inner = parent.select(F.col("id").alias("_pk"), F.struct(*parent.columns).alias("_row"))
    keep = [F.col("_row").alias(fk) if c == fk else F.col(c) for c in df.columns]
    return df.join(inner, df[fk] == inner["_pk"], how).select(*keep)


def child_rows(df: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """(id of the parent, child as a struct), one row for each child: the form for parents of any size."""
    item = [c for c in children.columns if c != key]
    return children.join(df.select("id"), children[key] == df["id"], "left_semi").select(F.col(key).alias("id"), F.struct(*item).alias(name))


def nest_children(df: DataFrame, children: DataFrame, key: str, name: str, sort: str = "id", parts: int = 1) -> DataFrame:
    """Attach the child rows as sorted lists of structs; parents without children get an empty one.

    Every parent has ``parts`` rows, numbered by ``part`` from 0, among which its children are dealt by
    hash; the caller names their number, whatever the data. With more than one the exchange on
    (parent, part) is asked for by name: without it the lists would be built where the join left all
    children of a parent.
    """
    item = [c for c in children.columns if c != key]
    dealt = children.withColumn("part", F.pmod(F.xxhash64(*item), F.lit(parts)).cast("int"))
    if parts > 1:
        dealt = dealt.repartition(F.col(key), F.col("part"))
    lists = dealt.groupBy(key, "part").agg(
        F.sort_array(F.collect_list(F.struct(sort, *[c for c in item if c != sort]))).alias(name)
    )
    kind = lists.schema[name].dataType
    slots = df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else df.withColumn("_part", F.lit(0))
    out = slots.join(lists, (slots["id"] == lists[key]) & (slots["_part"] == lists["part"]), "left")
    return out.select(
        *[slots[c] for c in df.columns],
        F.col("_part").alias("part"),
        F.coalesce(F.col(name), F.array().cast(kind)).alias(name),
    )


def expand(df: DataFrame, tables: dict, name: str, few: bool = False) -> DataFrame:
    """Attach what a row refers to: report{car{organization}}, query{organization, media[]},
    driver{car[]}. With ``few`` (a page, a single row) child tables are first cut to its parents."""
    if name in ("org_user", "car", "report_query"):
        fk = "org" if name == "org_user" else "organization"
        df = with_parent(df, tables["organization"], fk, _spec(name).parents[0][2])
    if name == "report_query":
        media = tables["media"]
        if few:
            media = media.join(df.select(F.col("id").alias("report_query")), "report_query", "left_semi")
        df = nest_children(df, media, "report_query", "media")
    if name in ("car_consumption", "car_report"):
        cars = with_parent(tables["car"], tables["organization"], "organization")
        df = with_parent(df, cars, "car")
    if name == "driver":
        links = tables["driver_car"]
        if few:
            links = links.join(df.select(F.col("id").alias("driver")), "driver", "left_semi")
        df = nest_children(df, driver_links(tables, links), "driver", "car")
    return df


def driver_links(tables: dict, links: DataFrame | None = None) -> DataFrame:
    """Each driver's vehicles, one row per pair."""
    cars = with_parent(tables["car"], tables["organization"], "organization")
    links = tables["driver_car"] if links is None else links
    return links.withColumnRenamed("car", "id").join(cars, "id")


def car_list(drivers: DataFrame, bridge: DataFrame, cars: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` vehicle names of each driver joined by a comma, with dots if there are more.

    Spark cuts each driver to n + 1 names per task before the exchange, so a driver of very many
    vehicles is never gathered.
    """
    links = bridge.join(cars.select(F.col("id").alias("car"), "name"), "car")
    ranked = links.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("driver").orderBy("name", "car"))
    ).filter(F.col("_rank") <= n + 1)
    names = ranked.groupBy("driver").agg(F.sort_array(F.collect_list(F.struct("_rank", "name"))).alias("_l"))
    text = F.array_join(F.slice(F.transform("_l", lambda x: x["name"]), 1, n), ", ")
    text = F.concat(text, F.when(F.size("_l") > n, F.lit("...")).otherwise(F.lit("")))
    shown = names.select(F.col("driver").alias("id"), text.alias("cars"))
    return drivers.join(shown, "id", "left").withColumn("cars", F.coalesce("cars", F.lit("")))


def facets(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, as a listing offers them for filtering."""
    return df.select(column).distinct()


def entity_facets(tables: dict, name: str, path: str, org: str | None = None) -> DataFrame:
    """Distinct values (``value``) of one of the entity's facets, also of one behind foreign keys."""
    if path not in _spec(name).facets:
        raise ValueError(f"{name} has no facet {path!r}")
    df, column = _reach(_scoped(tables, name, org), tables, name, path)
    return df.select(column.alias("value")).distinct()


def all_facets(tables: dict, name: str, org: str | None = None) -> DataFrame:
    """(facet, value, rows): all facets of an entity with the number of rows of each value, values as text.

    One pass over the table: grouping sets, a set for each facet, combine map-side.
    """
    spec = _spec(name)
    df, columns = _scoped(tables, name, org), []
    for k, path in enumerate(spec.facets):
        df, column = _reach(df, tables, name, path)
        columns.append(column.cast("string").alias(f"_f{k}"))
    rows = df.select(*columns)
    sets = [[F.col(f"_f{k}")] for k in range(len(columns))]
    counted = rows.groupingSets(sets, *[F.col(f"_f{k}") for k in range(len(columns))]).agg(F.grouping_id().alias("_set"), F.count("*").alias("rows"))
    # the set of facet k has all bits but its own
    which, full = F, (1 << len(columns)) - 1
    value = F
    for k, path in enumerate(spec.facets):
        own = F.col("_set") == full - (1 << (len(columns) - 1 - k))
        which, value = which.when(own, F.lit(path)), value.when(own, F.col(f"_f{k}"))
    return counted.select(which.alias("facet"), value.alias("value"), "rows")


# ---- entry points -------------------------------------------------------------------------------


def list_entities(
    tables: dict,
    name: str,
    org: str | None = None,
    filters: dict | None = None,
    search: str | None = None,
    page_number: int | None = 1,
    size: int = PAGE_SIZE,
    after: tuple | None = None,
    nested: bool = True,
    distinct: bool = True,
) -> DataFrame:
    """A page of an entity's listing; ``page_number=None`` gives every row and ``org=None`` all
    tenants."""
    spec = _spec(name)
    df = _scoped(tables, name, org, distinct)
    df = search_entities(filter_entities(df, tables, name, filters), tables, name, search)
    few = page_number is not None
    if few:
        df = page(df, spec.order, page_number, size, after)
    return expand(df, tables, name, few) if nested else df


def get_entity(tables: dict, name: str, org: str | None, key: str, nested: bool = True) -> DataFrame:
    """The row with this id, if the tenant may see it."""
    df = _scoped(tables, name, org).filter(F.col("id") == key)
    return expand(df, tables, name, few=True) if nested else df
