"""Time expressions.  Windows are half-open UTC instants with local midnights as edges, so days have 23 to 25 hours."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local(ts: Column | str, tz: str) -> Column:
    """The wall clock of an instant in a zone."""
    return F.from_utc_timestamp(ts, tz)


def local_date(ts: Column | str, tz: str) -> Column:
    return F.to_date(local(ts, tz))


def midnight(day: Column | str, tz: str) -> Column:
    """The instant at which a local date begins."""
    return F.to_utc_timestamp((F.col(day) if isinstance(day, str) else day).cast("timestamp"), tz)


def seconds(ts: Column | str) -> Column:
    return F.unix_seconds(ts)


def minutes_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 60e6


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def window_bounds(end: date, days: int, tz: str) -> tuple[datetime, datetime]:
    """[since, until) of so many local days ending with `end`."""
    zone = ZoneInfo(tz)
    at = lambda d: datetime.combine(d, time(), zone).astimezone(timezone.utc)
    return at(end - timedelta(days=days - 1)), at(end + timedelta(days=1))


def expected_readings(since: datetime, until: datetime, interval_minutes: int = 5) -> int:
    return round((until - since).total_seconds() / 60 / interval_minutes)


def dates(end: date, days: int) -> list[date]:
    return [end - timedelta(days=days - 1 - i) for i in range(days)]


def day_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))


def between(df: DataFrame, column: str, since: datetime, until: datetime) -> DataFrame:
    """Half-open filter on the raw column, so that it reaches the scan."""
    return df.where((F.col(column) >= F.lit(since)) & (F.col(column) < F.lit(until)))


def overlaps(start: str, end: str, since: Column, until: Column) -> Column:
    """Interval rows that touch [since, until); a null end is ongoing."""
    return (F.col(start) < until) & (F.col(end).isNull() | (F.col(end) >= since))


def iso_minute(ts: Column, tz: str) -> Column:
    """Local ISO time to the minute with its offset, whatever the session zone."""
    wall = local(ts, tz)
    offset = (F.unix_seconds(wall) - F.unix_seconds(ts)) / 60
    sign = F.when(offset < 0, "-").otherwise("+")
    whole = F.abs(offset).cast("int")
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm"), sign, F.lpad((whole / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
