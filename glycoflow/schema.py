"""The nine domain tables as Spark schemas, and vocabularies.

Each table is a StructType whose fields say in their metadata whether they belong to the key and which one is the time.
Spark has no enum type: vocabularies are lists and checked by an expression (`valid`).  Decimals are stored as such
and computed on as doubles.  All timestamps are instants; sessions run in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

# Vocabularies of the data model.
BOLUS_SOURCE = ["user", "auto", "override", "unknown"]
BOLUS_CATEGORY = ["auto_correction", "user_meal", "user_meal_and_correction", "user_correction_only", "override_up", "override_down", "unknown"]
RATE_SOURCE = ["suspended", "profile", "temp_rate", "algorithm", "temp_rate_and_algorithm", "unknown"]
FOOD_CARRYING = ["user_meal", "user_meal_and_correction", "override_up"]
CORRECTIONS = ["user_correction_only", "auto_correction"]


_TYPES = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def _table(columns: str, key: str, time: str) -> StructType:
    pairs = (c.split() for c in columns.split(","))
    return StructType([StructField(name, _TYPES[kind], True, {"key": name in ("pump_serial", key), "time": name == time}) for name, kind in pairs])


# Names, columns, keys and time columns of the data model.
TABLES: dict[str, StructType] = {
    "cgm": _table("pump_serial string, seqnum long, timestamp timestamp, bg_mgdl int, backfilled boolean, sensor_timestamp timestamp", "seqnum", "timestamp"),
    "bolus": _table("pump_serial string, bolus_id long, timestamp timestamp, insulin_units double", "bolus_id", "timestamp"),
    "requests": _table(
        "pump_serial string, bolus_id long, timestamp timestamp, carbs_g int, bg_mgdl int, iob double, bolus_source string, food_insulin double, correction_insulin double, "
        "total_requested double, bolus_category string, override_delta double", "bolus_id", "timestamp",
    ),
    "basal": _table("pump_serial string, timestamp timestamp, commanded_rate double, rate_source string", "timestamp", "timestamp"),
    "suspension": _table(
        "pump_serial string, suspend_timestamp timestamp, resume_timestamp timestamp, duration_minutes double, suspend_reason string, insulin_at_suspend int, "
        "pairing_suspect boolean, alarm_id int, alarm_name string", "suspend_timestamp", "suspend_timestamp",
    ),
    "events": _table("pump_serial string, seqnum long, timestamp timestamp, event_type string, event_subtype string, previous_mode string, details string, forced_by_alarm boolean", "seqnum", "timestamp"),
    "alarms": _table("pump_serial string, seqnum long, timestamp timestamp, category string, action string, alarm_id int, alarm_name string, param1 double, param2 double", "seqnum", "timestamp"),
    "site_issues": _table(
        "pump_serial string, first_occlusion_ts timestamp, last_occlusion_ts timestamp, occlusion_count long, resolved_by_site_change_ts timestamp, resolution_delay_minutes double",
        "first_occlusion_ts", "first_occlusion_ts",
    ),
    # By the number of the alarm that opened it: two may begin in one second.
    "cgm_gaps": _table("pump_serial string, start_ts timestamp, end_ts timestamp, duration_minutes double, ongoing boolean, seqnum long", "seqnum", "start_ts"),
}


def table(name: str) -> StructType:
    try:
        return TABLES[name]
    except KeyError:
        raise ValueError(f"no table is called {name!r}; there are {', '.join(TABLES)}") from None


def key_of(name: str) -> list[str]:
    return [f.name for f in table(name).fields if f.metadata["key"]]


def time_of(name: str) -> str:
    return next(f.name for f in table(name).fields if f.metadata["time"])


def conform(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """Columns in order, cast null-safely; missing ones are null, others go, but for those in `keep`, which get a leading underscore."""
    have = {c.lower() for c in df.columns}
    columns = ((F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in table(name).fields)
    return df.select(*columns, *(F.col(c).alias(f"_{c}") for c in keep or []))


def valid(column: str, vocabulary: list[str]) -> Column:
    return F.col(column).isNull() | F.col(column).isin(vocabulary)
