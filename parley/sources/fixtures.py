"""The message table the tests and registered queries run on, derived from the given tables.

Row id = ``conv_id*8 + turn``; its time, type and metadata come from the event numbered
``conv_id*48 + turn``; the user is that of the conversation's event ``conv_id*48``; the vector
is the one numbered like the row. Each part is joined only when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.lexical import score_sentiment
from parley.functions.timing import epoch_micros
from parley.lexicons import PROBE_SENTIMENT, Lexicon
from parley.operators.slices import previous_row

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

TURNS_PER_SLICE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sender(role: Column) -> Column:
    return F.when(role == "user", "customer").when(role == "assistant", "admin").otherwise("system")


def _message_type(event_type: Column) -> Column:
    return (
        F.when(event_type == "view", "text")
        .when(event_type == "click", "image")
        .when(event_type == "signup", "sticker")
        .when(event_type == "error", "file")
        .otherwise("location")
    )


def add_event(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Time, type and metadata of each (conv_id, turn); works on a stream of rows too."""
    own = events.select(
        F.col("event_id").alias("_event"), "ts", "event_type", F.col("props").alias("metadata")
    )
    return rows.join(own, F.col("conv_id") * 48 + F.col("turn") == F.col("_event")).drop("_event")


def add_user(rows: DataFrame, events: DataFrame) -> DataFrame:
    """The user of a conversation: a many-to-one join, event numbers are unique."""
    first = events.select(F.col("event_id").alias("_event"), "user_id")
    return rows.join(first, F.col("conv_id") * 48 == F.col("_event")).drop("_event")


def shape(rows: DataFrame, *extra: Column | str) -> DataFrame:
    return rows.select(
        (F.col("conv_id") * 8 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("conversation_id"),
        "user_id",
        F.col("text").alias("message"),
        _message_type(F.col("event_type")).alias("message_type"),
        _sender(F.col("role")).alias("sender_type"),
        F.col("ts").alias("timestamp"),
        "metadata",
        *extra,
    )


def messages(
    spark: SparkSession,
    sf_dir: str,
    *,
    response_time: bool = False,
    sentiment: bool = False,
    vectors: bool = False,
    lexicon: Lexicon = PROBE_SENTIMENT,
) -> DataFrame:
    """``response_time``, ``sentiment`` (+ score, ``processed_at``) and ``embedding_vector``
    are present only when requested. Every third row counts as not processed yet."""
    events = table(spark, sf_dir, "events")
    rows = add_event(table(spark, sf_dir, "conversations"), events)
    extra: list[Column | str] = []
    if response_time:
        rows = previous_row(
            rows,
            ["conv_id"],
            ["turn"],
            F.col("turn"),
            F.floor(F.col("turn") / TURNS_PER_SLICE),
            {"_asked": F.col("role") == "user", "_asked_ts": F.col("ts")},
        )
        gap = F.floor((epoch_micros(F.col("ts")) - epoch_micros(F.col("_asked_ts"))) / 1_000_000)
        answered = (F.col("role") == "assistant") & F.col("_asked")
        extra.append(F.when(answered, gap.cast("int")).alias("response_time"))
    frame = shape(add_user(rows, events), *extra)
    if sentiment:
        scored = score_sentiment(frame, "message", lexicon).drop("sentiment_confidence")
        seen = F.col("id") % 3 != 0
        frame = scored.withColumns({
            "sentiment": F.when(seen, F.col("sentiment")),
            "sentiment_score": F.when(seen, F.col("sentiment_score")),
            "processed_at": F.when(seen, F.col("timestamp")),
        })
    if vectors:
        stored = table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding_vector")
        )
        frame = frame.join(stored, "id", "left")
    return frame
