"""Vector search over the message table.

Rows are packed into blocks; a task holds a bounded share of the queries, and each block of rows that it gets is scored
against them with matrix products, of which only the best rows per query leave the task. It is one lazy pass over the
table for any number of queries: few are sent along with the tasks, more are dealt over parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.filters import newest, sender
from parley.operators.slices import first_rows

# Search defaults.
MIN_SIMILARITY = 0.7
SEARCH_LIMIT = 5

#: Queries and rows of a block; a product takes QUERY_BLOCK * ROW_BLOCK * 8 bytes.
QUERY_BLOCK = 1024
ROW_BLOCK = 2048
DIGITS = 6


#: Bytes of queries that are sent along with every block of rows, and that a task holds of those that are dealt, about.
SENT_BYTES, HELD_BYTES = 2**20, 32 * 2**20
#: Hits that a task collects before it keeps the best of them.
HELD_HITS = 500_000


def _matrices(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(places, matrix, norms)`` for every length that occurs among the vectors; NULLs are left out."""
    size = np.array([-1 if n is None else n for n in vectors.value_lengths().to_pylist()])
    out = []
    for width in np.unique(size[size > 0]):
        at = np.flatnonzero(size == width)
        values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        matrix = values.astype(float).reshape(-1, width)
        out.append((at, matrix, np.linalg.norm(matrix, axis=1)))
    return out


def _cosines(rows: list, row_count: int, queries: list, query_count: int) -> np.ndarray:
    out = np.zeros((row_count, query_count))
    of_length = {q.shape[1]: (at, q, norm) for at, q, norm in queries}
    for at, matrix, norm in rows:
        if matrix.shape[1] in of_length:
            q_at, q, q_norm = of_length[matrix.shape[1]]
            scale = norm[:, None] * q_norm[None, :]
            out[np.ix_(at, q_at)] = np.divide(matrix @ q.T, scale, out=np.zeros_like(scale), where=scale > 0)
    return out


def cosine_matrix(rows: pa.Array, queries: pa.Array) -> np.ndarray:
    """Rows x queries; 0 where a vector is zero, NULL or of another length."""
    return _cosines(_matrices(rows), len(rows), _matrices(queries), len(queries))


def _packed(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields])


def pack_rows(frame: DataFrame) -> DataFrame:
    """Rows of a task in blocks: one row per block, every column an array."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                columns = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frame.mapInArrow(pack, _packed(frame.schema))


def beside_all(packed: DataFrame, asked: DataFrame, key: Column, size: int, groups: int, task: Callable, schema: T.StructType) -> DataFrame:
    """Every block of rows beside every row of ``asked``, which takes ``size`` bytes: what ``task`` makes of them.

    ``task(asked)`` is made of an array of structs of the queries, ``meet(block)`` gets the blocks one by one as a row of a batch, and it
    and ``end()`` yield batches. A few queries are sent along with the blocks. More are split by ``key`` into ``groups``,
    each of which a task can hold, and copied to parts; blocks are dealt over the parts of each group. A block is copied once a
    group, a query once a part of its group, and there are about as many parts in all as shuffle partitions, however many queries there are.
    """
    spark = packed.sparkSession
    entry = F.struct(*asked.columns)
    broadcast = int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if groups == 1 and size <= min(SENT_BYTES, broadcast):
        grouped = asked.groupBy(F.lit(0).alias("_group")).agg(F.collect_list(entry).alias("_asked"))
        return beside(packed.withColumn("_group", F.lit(0)), grouped, "_group", size).drop("_group").mapInArrow(_with_sent(task), schema)
    copies = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // groups)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = asked.select(F.pmod(key, F.lit(groups)).cast("int").alias("_group"), entry.alias("_asked")).withColumn("_copy", each(copies))
    share = F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int").alias("_copy")
    theirs = packed.select(share, F.struct(*packed.columns).alias("_block")).withColumn("_group", each(groups))
    part = (F.col("_group") * copies + F.col("_copy")).alias("part")
    both = ours.select(part, F.lit(0).alias("_turn"), "_asked", F.lit(None).cast(theirs.schema["_block"].dataType).alias("_block")).unionAll(
        theirs.select(part, F.lit(1).alias("_turn"), F.lit(None).cast(ours.schema["_asked"].dataType).alias("_asked"), "_block")
    )
    dealt = both.repartition(groups * copies, "part").sortWithinPartitions("part", "_turn")
    return dealt.mapInArrow(_with_held(task), schema)


def _with_sent(task: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for row in range(batch.num_rows):
                if work is None:  # the same queries beside every block
                    work = task(batch.column("_asked")[row].values)
                yield from work.meet({n: batch.column(n)[row] for n in batch.schema.names})
        if work is not None:
            yield from work.end()

    return run


def _with_held(task: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, work = None, [], None
        for batch in batches:
            parts, turns = (batch.column(c).to_numpy() for c in ("part", "_turn"))
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (turns[1:] != turns[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if begin == end:
                    continue
                if parts[begin] != part:
                    if work is not None:
                        yield from work.end()
                    part, held, work = parts[begin], [], None
                if turns[begin] == 0:
                    held.append(batch.column("_asked").slice(begin, end - begin))
                elif work is not None or held:
                    if work is None:
                        work, held = task(pa.concat_arrays(held)), []
                    blocks = batch.column("_block")
                    names = [blocks.type.field(i).name for i in range(blocks.type.num_fields)]
                    for row in range(begin, end):
                        yield from work.meet({n: blocks.field(n)[row] for n in names})
        if work is not None:
            yield from work.end()

    return run


def held_vectors(asked: DataFrame) -> tuple[int, int]:
    """The bytes of the queries, and how many groups of ``HELD_BYTES`` they make."""
    size = 8 * asked.agg(F.coalesce(F.sum(F.greatest(F.size("vector"), F.lit(0)) + 4), F.lit(0))).first()[0]
    return size, max(1, -(-size // HELD_BYTES))


def beside(packed: DataFrame, grouped: DataFrame, key: str, size: int) -> DataFrame:
    """Blocks of rows joined with the blocks of queries of the same ``key``; the queries' vectors take ``size`` bytes.

    Queries below the session's broadcast limit are sent along. Beyond it each block of queries is copied to as many parts
    as there are shuffle partitions, and blocks of rows are dealt over the parts: a key has few
    values, part and key together have many.
    """
    spark = packed.sparkSession
    if size <= int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()):
        return packed.join(F.broadcast(grouped), key)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = packed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    copied = grouped.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copied, ["part", key]).drop("part")


class Hits:
    """The best ``limit`` rows for every query of a task, in blocks of at most ``block`` queries that share their ``number``.

    A block of rows may name the ``numbers`` of the queries it is to be compared with.
    """

    def __init__(self, asked: pa.Array, limit: int, min_similarity: float, block: int):
        self.limit, self.least = limit, min_similarity
        columns = {asked.type.field(i).name: i for i in range(asked.type.num_fields)}
        numbers = np.zeros(len(asked), np.int64)
        if "number" in columns:
            numbers = asked.field("number").to_numpy()
            order = np.argsort(numbers, kind="stable")
            asked, numbers = asked.take(pa.array(order)), numbers[order]
        self.ids = asked.field("query_id")
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1), len(asked)]
        self.blocks = [
            (numbers[at], at, min(at + block, end), _matrices(asked.field("vector").slice(at, min(at + block, end) - at)))
            for begin, end in zip(cuts, cuts[1:]) for at in range(begin, end, block)
        ]
        self.edge = np.full(len(asked), -np.inf)  # what the last of the best rows found so far has
        self.held, self.fresh = [], 0

    def meet(self, block: dict) -> Iterator[pa.RecordBatch]:
        ids, micros, vectors = (block[c].values for c in ("id", "micros", "vector"))
        rows = _matrices(vectors)
        wanted_numbers = None if "numbers" not in block else set(block["numbers"].values.to_pylist())
        for number, begin, end, queries in self.blocks:
            if wanted_numbers is not None and number not in wanted_numbers:
                continue
            similar = _cosines(rows, len(ids), queries, end - begin)
            wanted = (similar > self.least) & (similar >= self.edge[begin:end])
            if not wanted.any():
                continue
            if len(similar) > self.limit:
                wanted &= similar >= np.partition(similar, len(similar) - self.limit, axis=0)[len(similar) - self.limit]
            at, query = np.nonzero(wanted)
            names = ["query", "id", "micros", "similarity"]
            arrays = [pa.array(query + begin), ids.take(pa.array(at)), micros.take(pa.array(at)), pa.array(similar[at, query])]
            self.held.append(pa.RecordBatch.from_arrays(arrays, names=names))
            self.fresh += len(at)
            if self.fresh > HELD_HITS:
                yield from self.cut()

    def cut(self) -> Iterator[pa.RecordBatch]:
        """Keep the best; should they be too many for a task, they leave it."""
        found = pa.Table.from_batches(self.held)
        found = found.sort_by([("query", "ascending"), ("similarity", "descending"), ("micros", "descending"), ("id", "descending")])
        query = found.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = np.flatnonzero(place == self.limit - 1)
        self.edge[query[last]] = np.maximum(self.edge[query[last]], found.column("similarity").to_numpy()[last])
        kept = found.filter(pa.array(place < self.limit))
        self.held, self.fresh = kept.to_batches(), 0
        if kept.num_rows > 2 * HELD_HITS:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        for batch in self.held:
            columns = [self.ids.take(batch.column("query")), *(batch.column(c) for c in ("id", "micros", "similarity"))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "micros", "similarity"])
        self.held = []

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self.cut()
            yield from self.out()


def similar_ids(
    corpus: DataFrame,
    queries: DataFrame,
    limit: int = SEARCH_LIMIT,
    min_similarity: float = MIN_SIMILARITY,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``similarity`` of the rows above the threshold.

    ``corpus``: id, timestamp, embedding_vector. ``queries``: query_id (unique), vector.
    """
    slim = corpus.filter(F.col("embedding_vector").isNotNull()).select(
        "id",
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"),
        F.col("embedding_vector").cast("array<double>").alias("vector"),
    )
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", corpus.schema["id"].dataType),
        T.StructField("micros", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ])
    asked = queries.select("query_id", "vector").filter(F.col("vector").isNotNull())
    scored = beside_all(
        pack_rows(slim), asked, F.xxhash64("query_id"), *held_vectors(asked), lambda a: Hits(a, limit, min_similarity, block), schema
    )
    order = [F.col("similarity").desc(), F.col("micros").desc(), F.col("id").desc()]
    return first_rows(scored, ["query_id"], order, limit).select("query_id", "rank", "id", "similarity")


def similar_messages(
    messages: DataFrame,
    queries: DataFrame,
    limit: int = SEARCH_LIMIT,
    min_similarity: float = MIN_SIMILARITY,
    candidates: int | None = None,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """Customer messages most like each query vector, newest first among equals.

    ``candidates`` restricts the search to the newest rows with a vector; by default the
    whole table is searched. Only ids and vectors pass through Python; the texts of the few
    hits are joined back afterwards.
    """
    stored = newest(sender(messages, "customer").filter(F.col("embedding_vector").isNotNull()), candidates)
    hits = similar_ids(stored.select("id", "timestamp", "embedding_vector"), queries, limit, min_similarity, block)
    return messages.select("id", "conversation_id", "message", "timestamp").join(hits, "id")


def nearest_labels(messages: DataFrame, labelled: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """For every message with a vector the most similar entry of a labelled vector table.

    ``labelled``: label (unique), vector. Emits one row per message; of equally similar labels
    the highest.
    """
    id_field, label_type = messages.schema["id"], labelled.schema["label"].dataType
    stored = messages.filter(F.col("embedding_vector").isNotNull()).select(
        "id", F.col("embedding_vector").cast("array<double>").alias("vector")
    )
    schema = T.StructType([id_field, T.StructField("label", label_type), T.StructField("similarity", T.DoubleType())])
    asked = labelled.select("label", "vector").filter(F.col("vector").isNotNull())
    found = beside_all(
        pack_rows(stored), asked, F.xxhash64("label"), *held_vectors(asked), lambda a: Labels(a, block), schema
    )
    best = found.groupBy("id").agg(F.max(F.struct("similarity", "label")).alias("_best"))
    return best.select("id", "_best.label", F.round("_best.similarity", DIGITS).alias("similarity"))


class Labels:
    """The best label of a task for every row; of equally similar ones the highest."""

    def __init__(self, asked: pa.Array, block: int):
        names = asked.field("label").to_pylist()
        asked = asked.take(pa.array(sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i]), reverse=True), pa.int64()))
        self.labels = asked.field("label")
        self.blocks = [(at, _matrices(asked.field("vector").slice(at, block)), len(asked.slice(at, block))) for at in range(0, len(asked), block)]

    def meet(self, block: dict) -> Iterator[pa.RecordBatch]:
        ids, rows = block["id"].values, _matrices(block["vector"].values)
        best, label = None, None
        for at, queries, count in self.blocks:
            similar = _cosines(rows, len(ids), queries, count)
            place = similar.argmax(axis=1)
            found = similar[np.arange(len(ids)), place]
            better = np.ones(len(ids), bool) if best is None else (found > best) | (np.isnan(found) & ~np.isnan(best))
            best = np.where(better, found, found if best is None else best)
            label = np.where(better, place + at, place if label is None else label)
        yield pa.RecordBatch.from_arrays([ids, self.labels.take(pa.array(label)), pa.array(best)], names=["id", "label", "similarity"])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class VectorGroups(NamedTuple):
    """``id, group`` of every message with a vector, and ``label, vector`` of the groups' centres."""

    members: DataFrame
    centres: DataFrame


def vector_groups(messages: DataFrame, groups: int, seed: int = 42, rounds: int = 20) -> VectorGroups:
    """Group messages by their vectors (spherical k-means on unit vectors).

    A zero vector has no direction, and one of another length than most has none among them: such
    messages get the group NULL.
    """
    stored = messages.filter(F.col("embedding_vector").isNotNull()).select(
        "id", F.col("embedding_vector").cast("array<double>").alias("vector")
    )
    lengths = stored.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.col("n").desc(), "width").limit(1).collect()
    width = common[0]["width"] if common else 0
    usable: Column = (F.size("vector") == width) & F.exists("vector", lambda x: x != 0)
    features = stored.filter(usable).select("id", array_to_vector("vector").alias("features"))
    spark = messages.sparkSession
    if features.isEmpty():
        none = stored.select("id", F.lit(None).cast("int").alias("group"))
        return VectorGroups(none, spark.createDataFrame([], "label int, vector array<double>"))
    model = KMeans(k=groups, seed=seed, maxIter=rounds, distanceMeasure="cosine", predictionCol="group").fit(features)
    rest = stored.filter(~F.coalesce(usable, F.lit(False))).select("id", F.lit(None).cast("int").alias("group"))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return VectorGroups(
        model.transform(features).select("id", "group").unionByName(rest),
        spark.createDataFrame(centres, "label int, vector array<double>"),
    )


def word_bucket(word: Column, dimensions: int) -> Column:
    """The component a word counts in: the first 32 bits of its MD5, modulo."""
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(dimensions))


def hashed_encoder(dimensions: int = 64) -> Callable[[DataFrame, str], DataFrame]:
    """Default text encoder: hashed word counts scaled to length 1, built in and JVM-side."""

    def encode(frame: DataFrame, text: str) -> DataFrame:
        words = F.filter(F.split(F.lower(F.col(text)), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
        buckets = F.transform(words, lambda w: word_bucket(w, dimensions).cast("string"))
        names = [str(i) for i in range(dimensions)]
        counter = CountVectorizerModel.from_vocabulary(names, inputCol="_buckets", outputCol="_counts")
        counts = counter.transform(frame.withColumn("_buckets", buckets))
        scaled = Normalizer(inputCol="_counts", outputCol="_scaled", p=2.0).transform(counts)
        return scaled.withColumn("embedding_vector", vector_to_array("_scaled")).drop("_buckets", "_counts", "_scaled")

    return encode


def embed_messages(
    messages: DataFrame,
    text: str = "message",
    encoder: Callable[[list[str]], list] | None = None,
    enabled: bool = True,
    dimensions: int = 64,
) -> DataFrame:
    """Add ``embedding_vector``.

    ``encoder`` is called once per batch of texts and returns a vector or None for each. Without
    one the built-in encoder is used. NULL text gets a NULL vector, as does a failed text.
    """
    kept = messages.drop("embedding_vector")
    if not enabled:
        return kept.withColumn("embedding_vector", F.lit(None).cast("array<double>"))
    if encoder is None:
        present = F.col(text).isNotNull()
        filled = kept.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        encoded = hashed_encoder(dimensions)(filled, "_text").drop("_text")
        return encoded.withColumn("embedding_vector", F.when(present, F.col("embedding_vector")))

    @F.pandas_udf("array<double>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            present = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if present.any():
                values = encoder(list(batch[present]))
                out[present] = pd.Series(list(values), index=batch.index[present], dtype=object)
            yield out

    return kept.withColumn("embedding_vector", encode(F.col(text)))
