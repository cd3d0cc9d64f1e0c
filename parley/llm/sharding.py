"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows per range partition, and the most range partitions: the table of totals has at most so many rows.
RANGE_ROWS = 16_384
MAX_RANGES = 4096
#: Frees its buffers with each file; the default codec's wait for a garbage collection, which so little work seldom asks for.
CODEC = "zstd"


def keyed(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, size, text_crc32)``: UTF-8 bytes of the text plus one, and its checksum (NULL: as empty)."""
    content = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )


def shard_by_bytes(rows: DataFrame, shards: int) -> DataFrame:
    """``rows (key, size, text_crc32)`` plus ``shard`` (from 0) and ``slot`` (from 0 in each shard).

    In the order of (key, checksum, size) every row covers an interval of the corpus' bytes; the
    corpus is cut at equal targets and a row goes where its middle lies, so a shard misses its
    target by half a row at either end. The order comes from range partitions, which are written
    once; their totals (one row per partition, at most ``MAX_RANGES``) give each its offset, and
    only then are prefix sums taken inside the partitions. The scan position breaks ties, so
    that any number of equal rows, NULL keys included, is spread over partitions.

    Empty table: no rows. A shard may stay empty if one row is larger than a target.
    """
    ranges = max(1, min(MAX_RANGES, -(-rows.count() // RANGE_ROWS)))
    order = ["key", "text_crc32", "size", "scanned"]
    placed = written(
        rows.withColumn("scanned", F.monotonically_increasing_id())
        .repartitionByRange(ranges, *order)
        .withColumn("part", F.spark_partition_id()),
        "shard-ranges", CODEC,
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = written(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        ),
        "shard-offsets", CODEC,
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.withColumns(
        {"upto": F.sum("size").over(inside), "nth": F.row_number().over(inside)}
    ).join(F.broadcast(offsets), "part")  # at most MAX_RANGES rows
    cut = written(
        cut.select(
            "key", "size", "text_crc32",
            F.expr(f"least({shards - 1}, ({2 * shards} * (bytes_before + upto) - {shards} * size) div (2 * total))")
            .cast("int").alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("position"),
        ),
        "shard-cut", CODEC,
    )
    first = cut.groupBy("shard").agg(F.min("position").alias("first"))
    return cut.join(F.broadcast(first), "shard").select(  # one row per shard
        "key", "size", "text_crc32", "shard", (F.col("position") - F.col("first")).cast("long").alias("slot")
    )


def shard_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Every document's shard under the ``bytes`` law.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` (NULL under this law). A NULL
    text counts as empty; NULL ids come first; extra columns of ``documents`` are not read.
    """
    placed = shard_by_bytes(keyed(documents), shards)
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
