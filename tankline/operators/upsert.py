"""Set-based inserts, updates and deletes on plain tables.

Nothing here sorts or windows a key group: ``max_by``/``min_by`` combine map-side, so many copies
of one key shrink before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import trimmed


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``. Filters on the keys still reach the scan."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``existing`` with the same key; ``order`` ranks several
    rows of one key on the same side."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_wins(both, keys, ["_new", *order]).drop("_new")


def upsert_cars(existing: DataFrame, incoming: DataFrame, org: str | Column) -> DataFrame:
    """Add unknown vehicles under ``org``; for known ones only name and description change.

    ``incoming``: guid, name, description, engine_type and ``seq``, the file order. If a guid
    repeats, the first row decides the engine type and the last one the texts.
    """
    org = F.lit(org) if isinstance(org, str) else org
    new = (
        incoming.filter("guid IS NOT NULL")
        .groupBy(F.col("guid").cast("string").alias("id"))
        .agg(
            F.max_by(F.struct(trimmed("name").alias("n"), trimmed("description").alias("d")), "seq").alias("t"),
            F.min_by(F.struct(F.col("engine_type").cast("double").alias("e")), "seq").alias("f"),
        )
        .select(
            F.col("id"),
            F.col("t.n").alias("new_name"),
            F.col("t.d").alias("new_description"),
            F.coalesce("f.e", F.lit(0.0)).alias("new_engine"),
            F.lit(True).alias("_in"),
        )
    )
    joined = existing.withColumn("_old", F.lit(True)).join(new, "id", "full_outer")
    known = F.col("_old").isNotNull()
    changed = F.col("_in").isNotNull()
    return joined.select(
        "id",
        F.when(changed, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.when(changed, F.col("new_description")).otherwise(F.col("description")).alias("description"),
        F.when(known, F.col("engine_type")).otherwise(F.col("new_engine")).alias("engine_type"),
        F.when(known, F.col("organization")).otherwise(org).alias("organization"),
    )


def missing_cars(detected: DataFrame, cars: DataFrame, org: str) -> DataFrame:
    """Vehicles that have a drain but no row yet, as rows for the vehicle table."""
    found = detected.filter("is_leak").select(
        F.col("auto").alias("id"), F.trim("name").alias("name"), "sl_tip_dvigat"
    )
    found = found.join(cars.select("id"), "id", "left_anti")
    return found.groupBy("id").agg(
        F.min("name").alias("name"),
        F.lit(" ").alias("description"),
        F.coalesce(F.min("sl_tip_dvigat"), F.lit(0.0)).alias("engine_type"),
        F.lit(org).alias("organization"),
    )


def load_norms(norms: DataFrame, cars: DataFrame, org: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split incoming norms (car, winter_norm, summer_norm, due) into rows for the norm table and
    rejects: those whose vehicle the tenant does not have, and those with a due date that can't be
    read. A missing norm becomes -1, a missing date NULL. The file order ``seq`` comes along."""
    own = cars if org is None else cars.filter(F.col("organization") == org)
    own = own.select(F.col("id").alias("car"), F.lit(True).alias("_own"))
    marked = norms.withColumn("car", F.col("car").cast("string")).join(own, "car", "left")
    period = F.col("due").try_cast("timestamp_ntz").cast("date")
    given = F.coalesce(F.length(F.trim("due")) > 0, F.lit(False))
    fits = F.col("_own").isNotNull() & (period.isNotNull() | ~given)
    accepted = marked.filter(fits).select(
        "car",
        F.coalesce(F.col("winter_norm").cast("double"), F.lit(-1.0)).alias("winter_volume"),
        F.coalesce(F.col("summer_norm").cast("double"), F.lit(-1.0)).alias("summer_volume"),
        period.alias("valid_period"),
        *(["seq"] if "seq" in norms.columns else []),
    )
    return accepted, marked.filter(~fits).select(*norms.columns)


def update_where(df: DataFrame, cond: Column, **values) -> DataFrame:
    """Set columns on the rows that meet ``cond``; the rest is left as it is."""
    hit = F.coalesce(cond, F.lit(False))
    new = {
        name: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(name))
        for name, v in values.items()
    }
    return df.withColumns(new)


# Which table hangs on which, and by which column.
CHILDREN = {
    "organization": [("org_user", "org"), ("car", "organization"), ("report_query", "organization")],
    "car": [("car_consumption", "car"), ("car_report", "car"), ("driver_car", "car")],
    "report_query": [("media", "report_query")],
    "driver": [("driver_car", "driver")],
}


def cascade_delete(tables: dict[str, DataFrame], entity: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete the rows of ``entity`` whose id is in ``ids`` (one column ``id``) and all that hang on
    them. Returns what is left of every table; tables out of reach come back untouched."""
    left = dict(tables)
    gone = {entity: tables[entity].join(ids.select("id").distinct(), "id", "left_semi")}
    todo = [entity]
    while todo:  # over the handful of table names, never over rows
        parent = todo.pop(0)
        left[parent] = left[parent].join(gone[parent].select("id"), "id", "left_anti")
        dead = gone[parent].select(F.col("id").alias("_dead"))
        for child, fk in CHILDREN.get(parent, []):
            if child not in tables:
                continue
            rows = left[child]
            match = rows[fk] == dead["_dead"]
            if "id" in rows.columns and child in CHILDREN:
                gone[child] = rows.join(dead, match, "left_semi")
                todo.append(child)
            else:
                left[child] = rows.join(dead, match, "left_anti")
    return left
