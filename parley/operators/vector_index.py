"""An index of message vectors by angle: exact threshold search that leaves out blocks that cannot hold a hit.

Angles between vectors obey the triangle inequality. Every row lies in the cell of its nearest pivot; rows of a cell
are sorted by their angle to it and packed into blocks, which know the least and the greatest of these angles. A
query block knows the least and greatest angle of its queries to every pivot. If the two ranges lie further apart than the
angle of the threshold, no row of the one can be similar to a query of the other, and the block is not paired with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.similarity import MIN_SIMILARITY, QUERY_BLOCK, ROW_BLOCK, SEARCH_LIMIT, Hits, beside_all, held_vectors
from parley.operators.slices import first_rows

PIVOTS = 64
#: What rounding may add to an angle.
SLACK = 1e-6


def _unit(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(places, unit vectors)`` of the vectors of this length that have a direction."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.cumsum([0, *[n or 0 for n in vectors.value_lengths().to_pylist()]])
    at = np.array([i for i in range(len(vectors)) if starts[i + 1] - starts[i] == width], dtype=np.int64)
    matrix = flat[(starts[at][:, None] + np.arange(width))] if len(at) else np.empty((0, width))
    norm = np.linalg.norm(matrix, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return at[good], matrix[good] / norm[good, None]


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _placed(frame: DataFrame, pivots: np.ndarray, schema: T.StructType) -> DataFrame:
    """``frame (.., vector)`` plus ``cell, angle`` of the nearest pivot; rows without a direction are left out."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = _unit(batch.column("vector"), pivots.shape[1])
            angles = _angles(unit, pivots)
            cell = angles.argmin(axis=1) if len(at) else np.empty(0, dtype=np.int64)
            columns = [c.take(pa.array(at)) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(at)), cell])], names=[*batch.schema.names, "cell", "angle"]
            )

    return frame.mapInArrow(place, T.StructType([*schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and angle -> blocks ``cell, low, high, id, micros, vector``; a block has rows of one cell."""

    def block(part: pa.RecordBatch) -> pa.RecordBatch:
        angle = part.column("angle").to_numpy()
        listed = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column(c)])) for c in ("id", "micros", "vector")]
        return pa.RecordBatch.from_arrays(
            [part.column("cell").slice(0, 1), pa.array([angle.min()]), pa.array([angle.max()]), *listed],
            names=["cell", "low", "high", "id", "micros", "vector"],
        )

    for batch in batches:
        cells = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
        for begin, end in zip(cuts, cuts[1:]):
            for at in range(begin, end, ROW_BLOCK):
                yield block(batch.slice(at, min(ROW_BLOCK, end - at)))


def build_index(corpus: DataFrame, path: str, width: int, pivots: int = PIVOTS) -> None:
    """Write the index of the vectors of ``width`` numbers: ``corpus`` has id, timestamp, embedding_vector.

    Pivots are the vectors whose ids hash least, a bounded number. Rows are dealt by ranges of cell, angle and id, so a cell that holds a
    large part of the table, copies of one vector included, is spread over many tasks. Rows without a vector
    of this length or with a zero vector are like nothing and left out.
    """
    spark = corpus.sparkSession
    whole = F.forall("embedding_vector", lambda x: x.isNotNull()) & F.exists("embedding_vector", lambda x: x != 0)
    slim = corpus.where((F.size("embedding_vector") == width) & whole).select(
        "id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"), F.col("embedding_vector").cast("array<double>").alias("vector")
    )
    drawn = slim.select("vector").orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    chosen = np.array([r["vector"] for r in drawn], dtype=float).reshape(len(drawn), width)
    chosen = chosen / np.linalg.norm(chosen, axis=1, keepdims=True) if len(chosen) else np.ones((1, width)) / math.sqrt(width)
    spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(chosen)], "cell int, vector array<double>").coalesce(1).write.parquet(f"{path}/pivots")
    placed = _placed(slim, chosen, slim.schema)
    ordered = placed.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id")
    listed = [T.StructField(c, T.ArrayType(slim.schema[c].dataType)) for c in ("id", "micros", "vector")]
    edges = [T.StructField("cell", T.IntegerType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    ordered.mapInArrow(_pack, T.StructType([*edges, *listed])).write.parquet(f"{path}/blocks")


def _pivots(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/pivots").collect()  # a bounded number
    return np.array([r["vector"] for r in sorted(rows, key=lambda r: r["cell"])], dtype=float)


def query_blocks(queries: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """``query_id, vector, number``: queries of one cell share blocks of about ``block``."""
    asked = queries.select("query_id", "vector").where(F.size("vector") == pivots.shape[1])
    placed = _placed(asked.select("query_id", F.col("vector").cast("array<double>").alias("vector")), pivots, T.StructType([
        queries.schema["query_id"], T.StructField("vector", T.ArrayType(T.DoubleType()))
    ]))
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row per pivot
    number = F.lit(0)
    at = 0
    for cell in sorted(counts):
        parts = -(-counts[cell] // block)
        number = F.when(F.col("cell") == cell, at + F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).otherwise(number)
        at += parts
    return placed.select("query_id", "vector", number.alias("number"))


def paired(spark: SparkSession, path: str, blocks: DataFrame, min_similarity: float) -> DataFrame:
    """The index's blocks beside the ``number`` of every query block that may hold a hit for them."""
    if not 0 <= min_similarity < 1:
        raise ValueError("the threshold of an indexed search lies from 0 to 1")
    pivots = _pivots(spark, path)
    reach = math.acos(min_similarity) + SLACK

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, unit = _unit(batch.column("vector"), pivots.shape[1])
            numbers, back = np.unique(batch.column("number").to_numpy(), return_inverse=True)
            angles = _angles(unit, pivots)
            for i, number in enumerate(numbers):
                own = angles[back == i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pivots), number, np.int32)), pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(own.min(axis=0)), pa.array(own.max(axis=0))],
                    names=["number", "cell", "least", "most"],
                )

    spread = blocks.mapInArrow(spans, "number int, cell int, least double, most double").groupBy("number", "cell").agg(
        F.min("least").alias("least"), F.max("most").alias("most")
    )
    rows = spark.read.parquet(f"{path}/blocks")
    apart = F.greatest(F.col("low") - F.col("most"), F.col("least") - F.col("high"))
    return rows.join(spread, "cell").where(apart <= reach)


def similar_in_index(
    spark: SparkSession, path: str, queries: DataFrame, limit: int = SEARCH_LIMIT, min_similarity: float = MIN_SIMILARITY,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id, rank, id, similarity`` of the indexed rows above the threshold, the same as of a search of all.

    ``queries``: query_id (unique), vector. Ties are ranked newest first, then by descending id.
    """
    blocks = query_blocks(queries, _pivots(spark, path), block)
    place = ["cell", "low", "high"]  # blocks with the same edges are paired with the same queries
    tiles = paired(spark, path, blocks, min_similarity).select(*place, "number").distinct()
    listed = tiles.groupBy(*place).agg(F.collect_list("number").alias("numbers"))
    rows = spark.read.parquet(f"{path}/blocks").join(listed, place).select("id", "micros", "vector", "numbers")
    schema = T.StructType([
        queries.schema["query_id"], T.StructField("id", rows.schema["id"].dataType.elementType),
        T.StructField("micros", T.LongType()), T.StructField("similarity", T.DoubleType()),
    ])
    asked = beside_all(
        rows, blocks, F.col("number"), *held_vectors(blocks), lambda a: Hits(a, limit, min_similarity, QUERY_BLOCK), schema
    )
    order = [F.col("similarity").desc(), F.col("micros").desc(), F.col("id").desc()]
    return first_rows(asked, ["query_id"], order, limit).select("query_id", "rank", "id", "similarity")
