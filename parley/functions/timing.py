"""Time predicates and time-derived columns. Nothing here reads a clock: ``as_of`` is explicit."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta
from decimal import Decimal
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Service levels in seconds and business hours.
GOOD_RESPONSE = 300
ACCEPTABLE_RESPONSE = 900
POOR_RESPONSE = 1800
RESPONSE_CAP = 3600
OPENING_HOUR = 9
CLOSING_HOUR = 18
BUSINESS_ZONE = "Asia/Bangkok"

Day = date | str

#: The date column a stored table is partitioned by: the day of its time column in the session zone.
PARTITION = "day"


def as_day(day: Day) -> date:
    """Accept a date, a datetime (its time part is dropped) or an ISO string."""
    if isinstance(day, datetime):
        return day.date()
    if isinstance(day, date):
        return day
    return date.fromisoformat(day[:10])


def session_zone(frame: DataFrame) -> str:
    return frame.sparkSession.conf.get("spark.sql.session.timeZone")


def _midnight(frame: DataFrame, column: str, day: date, tz: str | None) -> Column:
    """Start of ``day`` as a literal of the column's own type, so it reaches the scan."""
    if tz is None:
        return F.lit(day)
    instant = datetime.combine(day, time.min, ZoneInfo(tz))
    if isinstance(frame.schema[column].dataType, T.TimestampNTZType):
        wall = instant.astimezone(ZoneInfo(session_zone(frame))).replace(tzinfo=None)
        return F.lit(wall.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(instant.isoformat(sep=" ")).cast("timestamp")


def in_days(frame: DataFrame, column: str, start: Day, end: Day, tz: str | None = None) -> Column:
    """Both days included. Written as a half-open range on the bare column: it is pushed
    to the parquet scan and prunes row groups, which ``to_date(ts)`` relies on a rewrite for.
    On a table partitioned by day the partitions are bounded too, one day wider where a zone is given."""
    first, last = as_day(start), as_day(end)
    ts = F.col(column)
    after_last = _midnight(frame, column, last + timedelta(days=1), tz)
    exact = (ts >= _midnight(frame, column, first, tz)) & (ts < after_last)
    if not _partitioned(frame, column):
        return exact
    wider = timedelta(days=0 if tz is None else 1)
    return exact & F.col(PARTITION).between(F.lit(first - wider), F.lit(last + wider))


def _partitioned(frame: DataFrame, column: str) -> bool:
    """Whether the frame still has the partition column that belongs to its time column."""
    return column == "timestamp" and PARTITION in frame.columns and isinstance(frame.schema[PARTITION].dataType, T.DateType)


def trailing_days(frame: DataFrame, column: str, as_of: Day, days: int) -> Column:
    """From midnight ``days`` before ``as_of``, without an upper bound."""
    first = as_day(as_of) - timedelta(days=days)
    exact = F.col(column) >= F.lit(first)
    return exact & (F.col(PARTITION) >= F.lit(first)) if _partitioned(frame, column) else exact


def local_time(frame: DataFrame, column: str, tz: str | None) -> Column:
    """Wall-clock time in ``tz``; a zone-less column is read in the session zone."""
    ts = F.col(column)
    if tz is None:
        return ts
    zone = F.lit(session_zone(frame))
    return F.convert_timezone(zone, F.lit(tz), ts.cast("timestamp_ntz"))


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def moment(ts: Column, id: Column) -> Column:
    """(time, id) as one number with the same order, a fixed-width one: minima and maxima of it
    are kept in place by hash aggregation, those of a struct make Spark sort the input."""
    high = epoch_micros(ts).cast("decimal(19,0)") * F.lit(Decimal(2**64))
    return (high + id.cast("decimal(19,0)")).cast("decimal(38,0)")


def response_band(seconds: Column) -> Column:
    return (
        F.when(seconds <= GOOD_RESPONSE, "good")
        .when(seconds <= ACCEPTABLE_RESPONSE, "acceptable")
        .when(seconds <= POOR_RESPONSE, "poor")
        .when(seconds.isNotNull(), "beyond")
    )


def in_business_hours(
    frame: DataFrame,
    column: str = "timestamp",
    tz: str | None = BUSINESS_ZONE,
    opening: int = OPENING_HOUR,
    closing: int = CLOSING_HOUR,
) -> Column:
    hour = F.hour(local_time(frame, column, tz))
    return (hour >= opening) & (hour < closing)
