"""Helpers the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parley.session import fresh_folder

#: Words are separated by the six ASCII white-space characters only.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def written(frame: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """The frame, written to a new folder of the shared place and read back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the steps before.
    """
    spark = frame.sparkSession
    path = fresh_folder(spark, label)
    frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; none for a NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def packed_row(frame: DataFrame) -> Column:
    """All columns of a frame as one column ``row``: what an operator adds beside it clashes with none of their names."""
    return F.struct(*[F.col("`" + name.replace("`", "``") + "`").alias(name) for name in frame.columns]).alias("row")


def unpacked(frame: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` out of ``row``."""
    return frame.select(*[F.col("row").getField(name).alias(name) for name in like.columns])


#: Words of 64 bits in a key filter: its table has at most so many rows, whatever the number of keys.
FILTER_WORDS = 1 << 18


def _bit_of(columns: list[Column]) -> tuple[Column, Column]:
    """The word and the bit within it that a key sets."""
    place = F.xxhash64(F.lit(9), *columns)
    return F.pmod(F.shiftright(place, 6), F.lit(FILTER_WORDS)), F.pmod(place, F.lit(64))


def likely_in(frame: DataFrame, columns: list[Column], keys: DataFrame, key_columns: list[Column]) -> DataFrame:
    """``frame`` plus ``_likely``: false only where its key is surely not among the keys.

    A Bloom filter of fixed size, so it may be broadcast: it lets rows without a partner pass by a join before their
    texts are shuffled. With very many keys it lets everything through, and the join alone decides.
    """
    word, bit = _bit_of(key_columns)
    marks = keys.select(word.alias("_word"), bit.cast("int").alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")
    )
    word, bit = _bit_of(columns)
    keyed = frame.withColumns({"_word": word, "_bit": bit.cast("int")})
    found = keyed.join(F.broadcast(marks), "_word", "left")  # at most FILTER_WORDS rows
    hit = F.expr("shiftright(_bits, _bit) & 1L") == 1
    return found.withColumn("_likely", F.coalesce(hit, F.lit(False))).drop("_word", "_bit", "_bits")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: its component's least node.

    Distributed union-find: large-star and small-star rounds. Each node hangs its neighbours under
    the least node it sees, first the larger ones, then the smaller ones, until nothing moves. Every
    round is two joins on the node, with the minimum combined before the shuffle; the edge list
    never grows, and a hub's neighbours are spread because only its minimum is grouped.
    """

    def kept(found: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, written, and what tells whether they are those of the round before, counted meanwhile."""
        seen = Observation()
        sums = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        out = written(found.observe(seen, F.count(F.lit(1)).alias("n"), sums.alias("sum")), label)
        return out, (seen.get["n"], seen.get["sum"])

    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    current, state = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while state[0] and state != before:  # no round for no edges, one for stars
        before = state
        both = current.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").repartition("a").distinct()
        )  # dealt by a once: distinct, minimum and join need no other shuffle
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = F.array(pair("a", "m"), F.when(F.col("b") != F.col("m"), pair("b", "m")))
        small = large.join(least, "a").select(F.explode(F.array_compact(hung)).alias("e")).select("e.*").distinct()
        current, state = kept(small)
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
