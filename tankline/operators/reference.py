"""Vehicle and norm reference files -> clean tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import car_label, need

# The two season labels of the norm file.
SUMMER = "Норма на 100 км (Норма за час для ТС по моточасам) Летняя"
WINTER = "Норма на 100 км (Норма за час для ТС по моточасам) Зимняя"
# Fixed value: due date of a vehicle that has neither season.
NO_DUE = "2000-12-31 21:00:00"


def parse_cars(df: DataFrame) -> DataFrame:
    """guid, display name, description and engine type (0 if unknown)."""
    need(df, ["guid", "gos_nomer", "vin_nomer", "marka", "model", "description", "sl_tip_dvigat"])
    return df.select(
        "guid",
        car_label("marka", "model", "vin_nomer", "gos_nomer").alias("name"),
        "description",
        F.coalesce(F.col("sl_tip_dvigat"), F.lit(0.0)).alias("sl_tip_dvigat"),
    )


def usable_cars(cars: DataFrame) -> DataFrame:
    """Parsed vehicles with every required value present."""
    return cars.dropna(how="any", subset=["guid", "name", "description"])


def last_norms(df: DataFrame) -> DataFrame:
    """Last value of each column per (vehicle, norm kind) in file order ``seq``. Every column looks
    past its own gaps."""
    need(df, ["sl_avto", "vid_norm_rasx", "period", "norma_rasx", "deystvuet_do", "seq"])
    return (
        df.filter("sl_avto IS NOT NULL AND vid_norm_rasx IS NOT NULL")
        .groupBy("sl_avto", "vid_norm_rasx")
        .agg(*[_last(c).alias(c) for c in ("period", "norma_rasx", "deystvuet_do")])
    )


def _last(name: str, among: Column | None = None) -> Column:
    filled = F.col(name).isNotNull()
    filled = filled if among is None else filled & among
    return F.max_by(name, F.when(filled, F.col("seq")))


def parse_norms(
    df: DataFrame, swap_seasons: bool = False, summer: str = SUMMER, winter: str = WINTER
) -> DataFrame:
    """One row per vehicle: auto, winter_norm, summer_norm, due.

    A season without rows gives -1. The due date is the summer one if there are summer rows.
    Last value and pivot are one aggregation, so there is one exchange, combined map-side.
    ``swap_seasons`` gives the two norms under each other's name.
    """
    need(df, ["sl_avto", "vid_norm_rasx", "norma_rasx", "deystvuet_do", "seq"])
    kind = F.col("vid_norm_rasx")
    of = {"s": kind == summer, "w": kind == winter}
    aggs = []
    for s, cond in of.items():
        aggs += [
            F.max(F.when(cond, True)).alias(f"{s}_any"),
            _last("norma_rasx", cond).alias(f"{s}_norm"),
            _last("deystvuet_do", cond).alias(f"{s}_due"),
        ]
    per_car = df.filter(kind.isin(summer, winter) & F.col("sl_avto").isNotNull())
    per_car = per_car.groupBy(F.col("sl_avto").alias("auto")).agg(*aggs)

    def norm(s: str) -> Column:
        return F.when(F.col(f"{s}_any"), F.col(f"{s}_norm")).otherwise(F.lit(-1.0))

    names = ("summer_norm", "winter_norm") if swap_seasons else ("winter_norm", "summer_norm")
    due = F.when(F.col("s_any"), F.col("s_due")).when(F.col("w_any"), F.col("w_due"))
    return per_car.select(
        "auto", norm("w").alias(names[0]), norm("s").alias(names[1]), due.otherwise(F.lit(NO_DUE)).alias("due")
    ).select("auto", "winter_norm", "summer_norm", "due")


def usable_norms(norms: DataFrame) -> DataFrame:
    return norms.dropna(how="any", subset=["auto", "winter_norm", "summer_norm", "due"])


def split_fleet(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged fleet table -> (cars, norms), both with the file order ``seq`` if it is there."""
    need(df, ["guid", "name", "description", "winter_norm", "summer_norm", "due", "engine_type"])
    seq = ["seq"] if "seq" in df.columns else []
    cars = df.select(
        "guid", "name", "description", F.col("engine_type").cast("int").alias("engine_type"), *seq
    )
    norms = df.select(F.col("guid").alias("car"), "winter_norm", "summer_norm", "due", *seq)
    return cars, norms
