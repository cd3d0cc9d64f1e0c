"""Look-back over ordered groups of any size.

A plain ``lag`` over ``partitionBy(key)`` puts a whole key into one task. Here a key is cut
into slices that follow the order (an hour of its time, a thousand of its turns), the window
runs inside one slice, and only the first row of a slice takes its value from the summary of
the slice before it. The summary has one row per key and slice and is combined before its
shuffle, so a key holding a third of the table is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import fresh_folder


#: Rows of a part, where a key's first rows are too many for Spark's own cut.
PART_ROWS = 1_000_000


def previous_row(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    order_value: Column,
    slice_of: Column,
    carry: Mapping[str, Column],
) -> DataFrame:
    """Add for every name in ``carry`` its expression's value on the previous row of the key.

    ``order`` must be unique within a key; ``order_value`` is the same order as one fixed-width
    value (see :func:`parley.functions.timing.moment`), and the carried values should be
    fixed-width too: the summary is then a hash aggregation instead of one that sorts its input.
    ``slice_of`` must never decrease along ``order`` and must not be NULL.
    """
    group = [*keys, "_slice"]
    sliced = frame.withColumns(
        {"_slice": slice_of, **{f"_own_{n}": value for n, value in carry.items()}}
    )
    inside = Window.partitionBy(*group).orderBy(*order)
    looked = sliced.withColumns({
        **{f"_near_{n}": F.lag(f"_own_{n}").over(inside) for n in carry},
        "_first": F.row_number().over(inside) == 1,
    })
    last = sliced.groupBy(*group).agg(*(F.max_by(f"_own_{n}", order_value).alias(f"_last_{n}") for n in carry))
    along = Window.partitionBy(*keys).orderBy("_slice")
    carried = last.select(*group, *(F.lag(f"_last_{n}").over(along).alias(f"_far_{n}") for n in carry))
    joined = looked.join(carried, group, "left")
    return joined.select(
        *frame.columns,
        *(F.when(F.col("_first"), F.col(f"_far_{n}")).otherwise(F.col(f"_near_{n}")).alias(n) for n in carry),
    )


def previous_in_order(
    frame: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Mapping[str, Column]
) -> DataFrame:
    """The same for groups of any density: a segmented scan over ranges of (keys, order), with no slice to choose.

    The rows are dealt by ranges of key and order, so whatever is crowded, one hour of one key included, is cut by Spark's own
    sample. Each task looks back within its range and passes its rows on with the row before; the first row
    of a range takes its value from the last row of the range before, of which there is one per range. The input is
    scanned once: what the tasks have looked up is written to the shared folder, and the ends are read from there.
    ``order`` must be unique within a key.
    """
    spark = frame.sparkSession
    own = frame.withColumns({f"_own_{n}": value for n, value in carry.items()})
    near = [T.StructField(f"_near_{n}", own.schema[f"_own_{n}"].dataType) for n in carry]
    marks = [T.StructField("_part", T.IntegerType()), T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())]
    schema = T.StructType([*own.schema.fields, *near, *marks])
    ranged = own.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    path = fresh_folder(spark, "ordered")
    ranged.mapInArrow(_look_back(list(keys), list(carry)), schema).write.parquet(path)
    looked = spark.read.schema(schema).parquet(path)
    ends = looked.where("_last").select("_part", *[F.col(k).alias(f"_key_{k}") for k in keys], *[F.col(f"_own_{n}").alias(f"_far_{n}") for n in carry])
    along = Window.partitionBy().orderBy("_part")  # a row per range that has rows
    far = [c for c in ends.columns if c != "_part"]
    before = ends.select("_part", *[F.lag(c).over(along).alias(c) for c in far], F.lit(True).alias("_first"))
    joined = looked.join(F.broadcast(before), ["_part", "_first"], "left")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return joined.select(
        *frame.columns, *(F.when(F.col("_first"), F.when(same, F.col(f"_far_{n}"))).otherwise(F.col(f"_near_{n}")).alias(n) for n in carry)
    )


def _look_back(keys: list[str], carry: list[str]):
    """Task function: rows in order, each with the carried values of the row before it in the same key."""

    def equal(left: pa.Array, right: pa.Array) -> pa.Array:
        both = pc.and_(left.is_null(), right.is_null())
        return pc.or_(pc.fill_null(pc.equal(left, right), False), both)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId(), None, None

        def out(batch: pa.RecordBatch, near: list[pa.Array], first: bool, end: bool) -> pa.RecordBatch:
            n = batch.num_rows
            marks = [pa.array([part] * n, pa.int32()), pa.array([first] + [False] * (n - 1)), pa.array([False] * (n - 1) + [end])]
            names = [*batch.schema.names, *(f"_near_{c}" for c in carry), "_part", "_first", "_last"]
            return pa.RecordBatch.from_arrays([*batch.columns, *near, *marks], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            def shifted(name: str) -> pa.Array:
                own = batch.column(name)
                start = pa.nulls(1, own.type) if last is None else last.column(name)
                return pa.concat_arrays([start, own.slice(0, batch.num_rows - 1)])

            same = reduce(pc.and_, [equal(batch.column(k), shifted(k)) for k in keys])
            if last is None:
                same = pa.concat_arrays([pa.array([False]), same.slice(1)])
            near = [pc.if_else(same, shifted(f"_own_{c}"), pa.scalar(None, batch.column(f"_own_{c}").type)) for c in carry]
            if held is not None:
                yield out(*held, False)
            held, last = (batch, near, last is None), batch.slice(batch.num_rows - 1, 1)
        if held is not None:
            yield out(*held, True)

    return look


def first_rows(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], count: int, rank: str = "rank"
) -> DataFrame:
    """The first ``count`` rows of every key, numbered from 1.

    The bare ``row_number() <= count`` form lets Spark cut each key down to ``count`` rows in
    every task before the shuffle, so the size of a key does not matter. Spark does so up to its
    ``windowGroupLimitThreshold``; for more rows a key is first cut in parts, as many as its counted rows
    need, each of which keeps its first ``count``.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if count > int(frame.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        sizes = frame.groupBy(*keys).agg(F.ceil(F.count("*") / max(PART_ROWS, 4 * count)).alias("_parts"))
        same = [F.col(f"_key{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
        sized = frame.join(sizes.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)}), same)
        cut = sized.withColumn("_part", F.pmod(F.xxhash64(*[F.col(c) for c in frame.columns]), F.col("_parts")))
        inside = Window.partitionBy(*keys, "_part").orderBy(*order)
        frame = cut.withColumn("_nth", F.row_number().over(inside)).filter(F.col("_nth") <= count).select(*frame.columns)
    return frame.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= count)
