"""Column names and types of the tables this library reads and writes."""

from pyspark.sql import types as T

FUEL = "calc_sensors_fuel_level"
SPEED = "pos_s"
VOLTAGE = "calc_sensors_voltage"


def _schema(**cols) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols.items()])


_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_TS, _DATE = T.TimestampNTZType(), T.DateType()

TELEMETRY = _schema(**{"timestamp": _TS, FUEL: _D, SPEED: _D, VOLTAGE: _D, "auto": _S})
FLEET = _schema(
    guid=_S, name=_S, description=_S, winter_norm=_D, summer_norm=_D, due=_S, engine_type=_D
)
CARS_FILE = _schema(
    guid=_S, gos_nomer=_S, vin_nomer=_S, marka=_S, model=_S, description=_S, sl_tip_dvigat=_D
)
NORMS_FILE = _schema(sl_avto=_S, period=_S, norma_rasx=_D, vid_norm_rasx=_S, deystvuet_do=_S)

TABLES = {
    "organization": _schema(id=_S, name=_S, bot_token=_S, chat_id=_S),
    "org_user": _schema(
        id=_S, org=_S, username=_S, email=_S, is_active=_B, is_staff=_B, last_login=_TS,
        date_joined=_TS,
    ),
    "car": _schema(id=_S, name=_S, description=_S, engine_type=_D, organization=_S),
    "car_consumption": _schema(
        id=_S, car=_S, winter_volume=_D, summer_volume=_D, valid_period=_DATE
    ),
    "report_query": _schema(id=_S, organization=_S, status=_S),
    "media": _schema(
        id=_S, media_type=_S, file=_S, size=_I, filename=_S, type=_S, report_query=_S, file_hash=_S
    ),
    "car_report": _schema(id=_S, car=_S, datetime=_TS, volume=_I, status=_B),
    "driver": _schema(id=_S, fullname=_S, address=_S, phone=_S),
    "driver_car": _schema(driver=_S, car=_S),
}

METRICS = _schema(
    **{"organization": _S, "auto": _S, "timestamp": _TS, SPEED: _D, FUEL: _D, "spent_fuel": _D}
)
