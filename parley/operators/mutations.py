"""Keyed writes as whole-table joins: what an engine with row updates does one row at a time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_defaults(rows: DataFrame, now: datetime | Column) -> DataFrame:
    """Fill the columns an incoming message may leave out."""
    defaults = {"message_type": F.lit("text"), "metadata": F.lit("{}"), "timestamp": now if isinstance(now, Column) else F.lit(now)}
    out = rows
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return out


def append_messages(table: DataFrame, rows: DataFrame, now: datetime | Column) -> DataFrame:
    """The table with the new rows; columns a new row lacks are NULL."""
    return table.unionByName(with_defaults(rows, now), allowMissingColumns=True)


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last write per key, combined before the shuffle, so a hot key costs one row per task.

    The combining sorts each task's rows by key, as whole rows cannot be kept in place.
    """
    values = [c for c in rows.columns if c not in key]
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return rows.groupBy(*key).agg(last).select(*key, "_last.*")


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first write per key; see :func:`latest_per_key`."""
    values = [c for c in rows.columns if c not in key]
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("_first")
    return rows.groupBy(*key).agg(first).select(*key, "_first.*")


def absent_rows(
    table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """The new rows whose key the table does not hold, one per key: the first by ``order``,
    which may be left out when new rows with the same key are alike."""
    single = first_per_key(rows, key, order) if order else rows.dropDuplicates(list(key))
    return single.join(table.select(*key), list(key), "left_anti")


def insert_ignore(
    table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    return table.unionByName(absent_rows(table, rows, key, order).select(*table.columns))


def upsert(
    table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Insert or overwrite on key; ``order`` says which of several new rows is the last.

    Replaced rows leave by an anti join against the new keys alone, which Spark broadcasts
    when they are few, instead of a full outer join that would shuffle every column of both.
    """
    fresh = latest_per_key(rows, key, order) if order else rows
    kept = table.join(fresh.select(*key), list(key), "left_anti")
    return kept.unionByName(fresh.select(*table.columns))


def patch_columns(
    table: DataFrame,
    patches: DataFrame,
    columns: Sequence[str],
    processed_at: datetime | Column,
    key: str = "id",
    order: Sequence[str] | None = None,
    only_new: bool = False,
) -> DataFrame:
    """Set ``columns`` and ``processed_at`` on the rows a patch exists for.

    Of several patches of a key the last by ``order`` counts; without an order the one with the greatest
    values, so a row is never doubled. A patch may set a column to NULL. With ``only_new`` rows that were
    processed before stay as they are.
    """
    stamp = processed_at if isinstance(processed_at, Column) else F.lit(processed_at)
    patches = latest_per_key(patches.select(key, *columns, *(c for c in order or () if c not in (key, *columns))), [key], order or columns)
    renamed = patches.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_patched"))
    joined = table.join(renamed, key, "left")
    hit = F.col("_patched").isNotNull() & (F.col("processed_at").isNull() if only_new else F.lit(True))
    out = []
    for c in table.columns:
        if c in columns:
            kind = table.schema[c].dataType
            out.append(F.when(hit, F.col(f"_new_{c}").cast(kind)).otherwise(F.col(c)).alias(c))
        elif c == "processed_at":
            out.append(F.when(hit, stamp.cast(table.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def live_rows(table: DataFrame, as_of: datetime | Column, expires: str = "expires_at") -> DataFrame:
    """Rows that may still be read: those expiring after ``as_of``."""
    return table.filter(F.col(expires) > as_of)


def after_cleanup(table: DataFrame, as_of: datetime | Column, expires: str = "expires_at") -> DataFrame:
    """Rows a cleanup leaves in place: those not expired before ``as_of``.

    A row expiring exactly then is neither readable nor removed.
    """
    return table.filter(F.col(expires) >= as_of)


def expired_rows(table: DataFrame, as_of: datetime | Column, expires: str = "expires_at") -> DataFrame:
    """Rows a cleanup removes."""
    return table.filter(F.col(expires) < as_of)
