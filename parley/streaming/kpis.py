"""Windowed measures over a message stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.streaming.state import needs_state_store


def stream_kpis(
    messages: DataFrame, width: str = "1 hour", delay: str = "1 hour", approx_conversations: bool = False,
    error: float = 0.02,
) -> DataFrame:
    """Messages and customer messages per tumbling window.

    Exact distinct counts are not available on a stream; ``approx_conversations`` adds an
    approximate one with a relative standard deviation of ``error``.
    """
    timed = messages.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    measures = [
        F.count("*").alias("messages"),
        F.count_if(F.col("sender_type") == "customer").alias("customer_messages"),
    ]
    if approx_conversations:
        measures.append(F.approx_count_distinct("conversation_id", error).alias("conversations"))
    grouped = timed.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width)).agg(*measures)
    return grouped.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *(c for c in grouped.columns if c != "window"),
    )


def first_sightings(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first message of each conversation and day, emitted at once.

    Counting the emitted rows per day gives exact conversations per day, the open day included.
    """
    timed = messages.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    firsts = (
        timed.withColumn("day", F.to_date("timestamp"))
        .withWatermark("timestamp", delay)
        .dropDuplicatesWithinWatermark(["conversation_id", "day"])
    )
    return firsts.select("day", "conversation_id")


def daily_sightings(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same, exact whatever the delay: a conversation's days are kept until the watermark has passed their end.

    A message counts on the day it falls on in the session zone if it comes no later than ``delay`` behind the newest; rows without
    a time are left out. Each conversation holds one small entry per day that is still open. This needs the RocksDB state
    store (``parley.streaming.state.state_store``), else it is an error before anything runs.
    """
    needs_state_store(messages.sparkSession)
    kind = messages.schema["conversation_id"].dataType.simpleString()
    timed = messages.select("conversation_id", F.col("timestamp").cast("timestamp").alias("timestamp")).where("timestamp is not null")
    day = F.to_date("timestamp")
    rows = timed.withWatermark("timestamp", delay).select(
        "conversation_id", "timestamp", F.unix_date(day).alias("day"), F.unix_millis(F.date_add(day, 1).cast("timestamp")).alias("ends")
    )
    seen = rows.groupBy("conversation_id").transformWithStateInPandas(
        Sightings(), f"conversation_id {kind}, day int", "Append", "EventTime"
    )
    return seen.select(F.date_from_unix_date("day").alias("day"), "conversation_id")


class Sightings(StatefulProcessor):
    """The open days of a conversation, by the moment they end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "ends long", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for chunk in rows:
            for ends, day in chunk[["ends", "day"]].drop_duplicates().itertuples(index=False):
                if not self.open.containsKey((int(ends),)):
                    self.open.updateValue((int(ends),), (int(day),))
                    self.handle.registerTimer(int(ends))
                    new.append(int(day))
        if new:
            yield pd.DataFrame({"conversation_id": [key[0]] * len(new), "day": pd.array(new, dtype="int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.removeKey((int(expiredTimerInfo.getExpiryTimeInMs()),))
        return iter(())

    def close(self) -> None:
        pass


def daily_from_sightings(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy(F.col("day").alias("date")).agg(F.count("*").alias("conversations")).orderBy("date")


def dedup_messages(messages: DataFrame, delay: str = "1 day", key: str = "id") -> DataFrame:
    """Drop repeated deliveries arriving within the delay."""
    timed = messages.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return timed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([key])
