"""Reading the message table from files, a catalog table or a database."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.timing import PARTITION
from parley.functions.vectors import decode_vector
from parley.schema import MESSAGES


def _text_form(schema: T.StructType) -> T.StructType:
    """The same columns as a CSV can hold them: arrays as JSON text."""
    return T.StructType([
        T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType, True)
        for f in schema.fields
    ])


def scan_messages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = MESSAGES,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read with an explicit schema; malformed JSON or CSV input fails instead of vanishing."""
    if fmt == "csv":
        frame = (
            spark.read.schema(_text_form(schema))
            .option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("mode", "FAILFAST")
            .csv(path)
        )
        for field in schema.fields:
            if isinstance(field.dataType, T.ArrayType):
                frame = frame.withColumn(field.name, decode_vector(F.col(field.name)))
    elif fmt == "json":
        frame = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    elif fmt in ("parquet", "orc"):
        frame = spark.read.schema(schema).format(fmt).load(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return frame.select(*columns) if columns else frame


def stored_form(messages: DataFrame) -> DataFrame:
    """Rows in the types of the stored message table, with the day it is partitioned by; missing columns are NULL."""
    columns = [
        (F.col(f.name) if f.name in messages.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in MESSAGES.fields
    ]
    return messages.select(*columns).withColumn(PARTITION, F.to_date("timestamp"))


def scan_database(
    spark: SparkSession,
    url: str,
    table: str,
    lower: int,
    upper: int,
    partitions: int,
    fetch_rows: int = 10_000,
    **options: str,
) -> DataFrame:
    """Read a database table in ``partitions`` ranges of ``id``; vectors arrive as JSON text."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", "id")
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .option("fetchsize", fetch_rows)
        .options(**options)
    )
    return reader.load().withColumn("embedding_vector", decode_vector(F.col("embedding_vector")))


def scan_message_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = MESSAGES,
    files_per_batch: int = 64,
    pattern: str | None = None,
) -> DataFrame:
    """The same table as a stream of arriving parquet files; ``files_per_batch`` bounds a micro-batch.

    ``path`` is a folder or a pattern of paths; ``pattern`` is one of the names of the files in it.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)
