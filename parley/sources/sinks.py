"""Materialised results with a time to live, tables partitioned by day, and exports."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.mutations import after_cleanup, expired_rows, latest_per_key, live_rows, patch_columns, upsert
from parley.schema import RESULT_MANIFEST
from parley.session import fresh_folder
from parley.sources.folders import folder_names, folder_values, move_folder, remove_folder, table_exists, written_whole

# Fixed value: time to live.
RESULT_HOURS = 1

#: Rows of a file of a partitioned table.
FILE_ROWS = 5_000_000

# Text formats that keep microseconds.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _manifest_path(base: str) -> str:
    return f"{base}/manifest"


def store_result(
    result: DataFrame, base: str, key: str, now: datetime, hours: float = RESULT_HOURS
) -> bool:
    """Write a result and its manifest row; an empty result is not registered.

    ``now`` is taken in the session zone.
    """
    spark = result.sparkSession
    path = f"{base}/{_name(key)}"
    result.write.mode("overwrite").parquet(path)
    if spark.read.schema(result.schema).parquet(path).isEmpty():
        return False
    entry = spark.createDataFrame([(key, path, now, now + timedelta(hours=hours))], RESULT_MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(_manifest_path(base))
    return True


def _name(key: str) -> str:
    """A folder that no other result has: the key's hash and an id of its own."""
    return f"results/{hashlib.sha256(key.encode()).hexdigest()[:16]}-{uuid.uuid4().hex}"


def manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(RESULT_MANIFEST).parquet(_manifest_path(base))


def load_result(spark: SparkSession, base: str, key: str, now: datetime) -> DataFrame | None:
    """The newest result stored under the key that has not expired."""
    if not table_exists(spark, _manifest_path(base)):
        return None
    live = live_rows(manifest(spark, base), now).filter(F.col("cache_key") == key)
    found = live.orderBy(F.col("created_at").desc()).limit(1).collect()
    return spark.read.parquet(found[0]["result_path"]) if found else None


def cached(result: DataFrame, base: str, key: str, now: datetime, hours: float = RESULT_HOURS) -> DataFrame:
    """The live stored result, or this one after storing it."""
    spark = result.sparkSession
    stored = load_result(spark, base, key, now)
    if stored is not None:
        return stored
    kept = store_result(result, base, key, now, hours)
    return load_result(spark, base, key, now) if kept else result


def clean_results(spark: SparkSession, base: str, now: datetime) -> int:
    """Remove the results that expired before ``now``, payload and manifest row; returns how many."""
    path = _manifest_path(base)
    if not table_exists(spark, path):
        return 0
    gone = expired_rows(manifest(spark, base), now).select("result_path").collect()
    if gone:
        replace_table(after_cleanup(manifest(spark, base), now), path)
        for row in gone:
            remove_folder(spark, row["result_path"])
    return len(gone)


def replace_table(frame: DataFrame, path: str) -> None:
    """Overwrite an unpartitioned table, possibly with what was read from it: staged before the swap."""
    staged = _staged(frame)
    staged.write.mode("overwrite").parquet(path)


def _staged(frame: DataFrame) -> DataFrame:
    path = fresh_folder(frame.sparkSession, "staged")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def write_by_date(frame: DataFrame, path: str, day: str, mode: str = "overwrite") -> None:
    """Write partitioned by a date column. Spark rebalances by size: a busy date is split over as many
    tasks as its rows need, quiet dates share one."""
    balanced = frame.hint("rebalance", day)
    balanced.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, schema, day: str = "day") -> DataFrame:
    """A table partitioned by ``day``; date ranges on it open only the days they touch."""
    from pyspark.sql import types as T

    whole = T.StructType([*schema.fields, T.StructField(day, T.DateType())])
    return spark.read.schema(whole).parquet(path)


def table_days(spark: SparkSession, path: str, day: str = "day") -> list[date | None]:
    """The days a table has folders for; None where rows have no day."""
    values = folder_values(spark, path, day)
    return [None if value == "__HIVE_DEFAULT_PARTITION__" else date.fromisoformat(value) for value in values]


def days_of(frame: DataFrame, day: str = "day") -> list[date]:
    """The distinct days, at most one value per partition of the table."""
    return [r[0] for r in frame.select(day).distinct().collect()]


CHANGE = "_change-"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def replace_days(path: str, frame: DataFrame, days: Sequence[date], day: str = "day") -> None:
    """Make the given day partitions hold exactly the rows of ``frame``, which has no others; it may read from them.

    The rows are written once, to a folder of the table that readers pass over. Then the change is declared: which days it
    moves in and which lose their folder. From there on it is only folders that are moved and removed, and a call lost
    on the way is finished by the next (``finish_changes``). A table has one writer at a time.
    """
    spark, change = frame.sparkSession, f"{path}/{CHANGE}{uuid.uuid4().hex}"
    frame.hint("rebalance", day).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy(day).parquet(f"{change}/rows")
    new = set(folder_values(spark, f"{change}/rows", day))
    gone = {NO_DAY if d is None else str(d) for d in days} - new
    declared = [(name, True) for name in sorted(new)] + [(name, False) for name in sorted(gone)]
    spark.createDataFrame(declared, "name string, moved boolean").coalesce(1).write.parquet(f"{change}/days")
    _apply_change(spark, path, change, day)


def _apply_change(spark: SparkSession, path: str, change: str, day: str) -> None:
    """Carry out a declared change, or what is left of it: every step may be repeated."""
    for name, moved in spark.read.parquet(f"{change}/days").collect():  # a row per day concerned
        target, staged = f"{path}/{day}={name}", f"{change}/rows/{day}={name}"
        if not moved:
            remove_folder(spark, target)
        elif table_exists(spark, staged):
            remove_folder(spark, target)
            move_folder(spark, staged, target)
    remove_folder(spark, change)


def finish_changes(spark: SparkSession, path: str, day: str = "day") -> int:
    """Finish the changes of a table that were declared and not carried out, drop those never declared; returns how many were finished.

    The keyed writes below do so first; a reader may call it after a writer was lost.
    """
    finished = 0
    for name in folder_names(spark, path):
        if name.startswith(CHANGE):
            if written_whole(spark, f"{path}/{name}/days"):
                _apply_change(spark, path, f"{path}/{name}", day)
                finished += 1
            else:
                remove_folder(spark, f"{path}/{name}")
    return finished


def _settled(path: str, table: DataFrame, day: str) -> DataFrame:
    """The table, read anew if a lost change had to be finished."""
    spark = table.sparkSession
    return spark.read.schema(table.schema).parquet(path) if finish_changes(spark, path, day) else table


def _touched(table: DataFrame, keys: DataFrame, key: Sequence[str], day: str) -> list[date]:
    """Days that hold a row with one of the keys."""
    return days_of(table.select(*key, day).join(keys.select(*key).distinct(), list(key), "left_semi"), day)


def upsert_days(
    path: str, table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str] | None = None, day: str = "day"
) -> None:
    """Upsert into a table partitioned by day: only days with a replaced or a new row are rewritten."""
    table = _settled(path, table, day)
    fresh = _staged(latest_per_key(rows, key, order) if order else rows)
    days = sorted(set(_touched(table, fresh, key, day)) | set(days_of(fresh, day)))
    replace_days(path, upsert(table.where(F.col(day).isin(days)), fresh, key), days, day)


def patch_days(
    path: str, table: DataFrame, patches: DataFrame, columns: Sequence[str], processed_at: datetime | Column,
    key: str = "id", order: Sequence[str] | None = None, only_new: bool = False, day: str = "day",
) -> int:
    """Patch rows of a table partitioned by day, rewriting only their days; returns how many rows were patched."""
    table = _settled(path, table, day)
    kept = _staged(latest_per_key(patches, [key], order) if order else patches)
    goal = table.where(F.col("processed_at").isNull()) if only_new else table
    days = _touched(goal, kept, [key], day)
    if not days:
        return 0
    some = table.where(F.col(day).isin(days))
    hit = goal.where(F.col(day).isin(days)).select(key).join(kept.select(key), key, "left_semi").count()
    replace_days(path, patch_columns(some, kept, columns, processed_at, key, only_new=only_new), days, day)
    return hit


def expire_days(path: str, table: DataFrame, as_of: datetime | Column, expires: str = "expires_at", day: str = "day") -> int:
    """Delete the rows that expired before ``as_of``; returns how many."""
    table = _settled(path, table, day)
    gone = expired_rows(table, as_of, expires).groupBy(day).agg(F.count("*").alias("n")).collect()
    days = [r[day] for r in gone]
    if days:
        replace_days(path, after_cleanup(table.where(F.col(day).isin(days)), as_of, expires), days, day)
    return sum(r["n"] for r in gone)


def export_rows(frame: DataFrame, path: str, fmt: str, *order: Column, limit: int | None = None) -> None:
    """CSV or JSON export of all rows, or of the first ``limit`` in the given order."""
    if limit is not None:
        frame = frame.orderBy(*order).limit(limit)
    if fmt == "csv":
        frame.write.options(**TIME_FORMATS).option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        frame.write.options(**TIME_FORMATS).option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
