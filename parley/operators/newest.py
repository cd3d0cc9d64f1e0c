"""The newest rows of a table partitioned by day, without reading the days behind them.

A table's folder names tell its days. They are read from the newest backwards, one day, then two, four, and so on,
until enough rows satisfy the filter; everything older is never opened. As a row's day is that of
its time, no older day can hold a newer row.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.timing import PARTITION
from parley.operators.filters import newest, null_state, project, sender
from parley.sources.sinks import read_days, table_days

Rule = Callable[[DataFrame], DataFrame]

#: Days read beyond the last one needed: a table written under several session zones may be off by one.
MARGIN = 1


def newest_days(
    spark: SparkSession, path: str, schema: T.StructType, limit: int, rule: Rule | None = None, day: str = PARTITION
) -> DataFrame:
    """The rows that satisfy ``rule``, of as many of the newest days as hold ``limit`` of them.

    ``rule`` filters a frame; it is the caller's exact predicate and is applied both while counting and to the
    result. With too few rows in all, the whole table is given, rows without a day included.
    """
    keep = rule or (lambda frame: frame)
    table = read_days(spark, path, schema, day)
    days = sorted((d for d in table_days(spark, path, day) if d is not None), reverse=True)
    found, at, step = 0, 0, 1
    while found < limit and at < len(days):
        part = days[at: at + step]
        found += keep(table.where(F.col(day).between(F.lit(part[-1]), F.lit(part[0])))).limit(limit - found).count()
        at, step = at + len(part), 2 * step
    if found < limit:
        return keep(table)
    return keep(table.where(F.col(day) >= F.lit(_oldest(days, at))))


def _oldest(days: list[date], read: int) -> date:
    return days[min(read - 1 + MARGIN, len(days) - 1)]


def newest_stored(
    spark: SparkSession, path: str, schema: T.StructType, limit: int, rule: Rule | None = None, day: str = PARTITION
) -> DataFrame:
    """The ``limit`` newest rows that satisfy ``rule``, ties by descending id."""
    return newest(newest_days(spark, path, schema, limit, rule, day), limit)


def recent_messages(spark: SparkSession, path: str, schema: T.StructType, limit: int = 10) -> DataFrame:
    return project(newest_stored(spark, path, schema, limit), "recent")


def context_messages(spark: SparkSession, path: str, schema: T.StructType, limit: int = 100) -> DataFrame:
    return project(newest_stored(spark, path, schema, limit), "context")


def latest_customer_messages(spark: SparkSession, path: str, schema: T.StructType, limit: int = 100) -> DataFrame:
    return newest_stored(spark, path, schema, limit, lambda frame: sender(frame, "customer"))


def unprocessed_messages(spark: SparkSession, path: str, schema: T.StructType, limit: int = 100) -> DataFrame:
    return newest_stored(
        spark, path, schema, limit, lambda frame: null_state(sender(frame, "customer"), absent=("processed_at",))
    )
