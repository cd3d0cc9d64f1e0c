"""Running a stream over everything that has arrived, and keyed sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.mutations import absent_rows
from parley.sources.folders import folder_values, remove_folder, table_exists, written_whole


def drain_to_files(stream: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process all files present, append the results to ``folder/rows``, return them as a table.

    The checkpoint lies beside the rows: a later call with the same folder continues where this
    one stopped, and a lost executor or driver neither skips nor repeats input.
    """
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_open(stream: DataFrame, folder: str, done: DataFrame, key: str = "id") -> DataFrame:
    """Process what has arrived and return the rows whose keys are not among ``done``, those of earlier calls included.

    ``done`` holds the keys whose results are stored, so what a call returned and its caller never stored comes back with
    the next call. Every micro-batch is written whole to a folder of its number, so a repeated batch replaces itself. What is
    open then goes into one table named by the last batch in it, and only when that is written whole are the batches and
    the table before it dropped: a call lost at any point loses and repeats nothing, and a message that
    stays open costs its own row, not its batch.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    drain_batches(stream, folder, write)
    tables = [int(n) for n in folder_values(spark, f"{folder}/open", "upto")]
    last = max((n for n in tables if written_whole(spark, f"{folder}/open/upto={n}")), default=-1)
    batches = [int(n) for n in folder_values(spark, f"{folder}/rows", "batch")]
    fresh = sorted(n for n in batches if n > last)
    paths = [f"{folder}/open/upto={last}"] * (last >= 0) + [f"{folder}/rows/batch={n}" for n in fresh]
    if not paths:
        return spark.createDataFrame([], stream.schema)
    left = spark.read.schema(stream.schema).parquet(*paths).join(done.select(key), key, "left_anti").select(*stream.columns)
    if not fresh:
        return left
    kept = f"{folder}/open/upto={fresh[-1]}"
    left.write.mode("overwrite").parquet(kept)
    for old in [f"{folder}/rows/batch={n}" for n in batches] + [f"{folder}/open/upto={n}" for n in tables if n != fresh[-1]]:
        remove_folder(spark, old)
    return spark.read.schema(stream.schema).parquet(kept)


def drain_batches(
    stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """The same with a function per micro-batch."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def stored_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows at ``path``; none where nothing has arrived that would have been written there."""
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def drain_updates(stream: DataFrame, folder: str, key: Sequence[str]) -> DataFrame:
    """Run an updating aggregation and return the latest state of every key.

    Each micro-batch is written whole to a folder of its own number, so a repeated batch
    replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    drain_batches(stream, folder, write, "update")
    rows = stored_rows(stream.sparkSession, f"{folder}/rows", T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())]))
    values = [c for c in stream.columns if c not in key]
    last = F.max_by(F.struct(*values), F.col("batch")).alias("_last")
    return rows.groupBy(*key).agg(last).select(*key, "_last.*")


def insert_ignore_sink(spark: SparkSession, path: str, schema, key: str = "id", time: str = "timestamp") -> Callable:
    """A micro-batch handler appending the rows whose key the table at ``path`` lacks.

    The table is partitioned by day and only the days a batch touches are looked at, which
    relies on a repeated row carrying the same time. A repeated batch adds nothing. The batch is
    kept while it is handled, so what stands above it in the stream runs once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("day", F.to_date(time)).persist(StorageLevel.DISK_ONLY)
        try:
            days = [r["day"] for r in rows.select("day").distinct().collect()]
            if not days:
                return
            fresh = rows
            if table_exists(spark, path):
                stored = spark.read.schema(f"{schema}, day date").parquet(path)
                fresh = absent_rows(stored.filter(F.col("day").isin(days)), rows, [key])
            fresh.write.mode("append").partitionBy("day").parquet(path)
        finally:
            rows.unpersist()

    return write
