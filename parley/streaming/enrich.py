"""Message enrichment, the same for a table and a stream."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.lexical import (
    TOPIC_FACTOR,
    best_labels,
    sentiment_of,
    sentiment_sides,
    with_hits,
)
from parley.lexicons import SENTIMENT, TOPICS, Lexicon
from parley.operators.filters import null_state, sender
from parley.operators.mutations import patch_columns
from parley.operators.similarity import embed_messages
from parley.streaming.sinks import drain_open


def enrich(
    messages: DataFrame,
    processed_at: Column,
    sentiment: Lexicon = SENTIMENT,
    topics: Lexicon = TOPICS,
    vectors: bool = False,
    encoder=None,
) -> DataFrame:
    """Add sentiment, topics, optionally a vector, and the time of processing."""
    counted, [mood_hits, topic_hits] = with_hits(messages, "message", [sentiment_sides(sentiment), topics])
    label, score = sentiment_of(mood_hits)
    added = ("sentiment", "sentiment_score", "sentiment_confidence", "topics")
    labelled = counted.select(
        *(c for c in messages.columns if c not in added),
        label.alias("sentiment"),
        score.alias("sentiment_score"),
        F.abs(score).alias("sentiment_confidence"),
        best_labels(topic_hits, topics, TOPIC_FACTOR).alias("topics"),
    )
    if vectors:
        labelled = embed_messages(labelled, encoder=encoder)
    return labelled.withColumn("processed_at", processed_at)


class Worked(NamedTuple):
    """The table with the results of a call, the topics found in it, and how many messages were worked off."""

    table: DataFrame
    topics: DataFrame
    processed: int


def incremental_enrich(
    table: DataFrame,
    arriving: DataFrame,
    folder: str,
    processed_at: Column,
    sentiment: Lexicon = SENTIMENT,
    topics: Lexicon = TOPICS,
    encoder=None,
) -> Worked:
    """Work off the customer messages not processed yet: sentiment and vector go into the table, topics are returned.

    The stream's checkpoint and its batch folders are the queue: each call sees what arrived since the last, and
    what came before but is not processed in ``table``, as its caller never stored it or the table had no row for it. A
    message delivered twice is worked off once, and one that the table has as processed keeps its stamp.
    """
    waiting = null_state(sender(arriving, "customer"), absent=("processed_at",)).select("id", "message")
    label = F.array_compact(F.col("topics.label"))
    scored = enrich(waiting, F.lit(None).cast("timestamp"), sentiment, topics, vectors=True, encoder=encoder)
    arrived = drain_open(
        scored.select("id", "sentiment", "sentiment_score", "embedding_vector", label.alias("topics")), folder,
        null_state(table, present=("processed_at",)).select("id"),
    )
    open_ = null_state(table, absent=("processed_at",)).select("id")
    once = arrived.dropDuplicates(["id"]).join(open_, "id", "left_semi")
    columns = ["sentiment", "sentiment_score", *(["embedding_vector"] if "embedding_vector" in table.columns else [])]
    patched = patch_columns(table, once.select("id", *columns), columns, processed_at, only_new=True)
    return Worked(patched, once.select("id", "topics"), once.count())
