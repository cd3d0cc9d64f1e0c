"""Row filters and column subsets of the message table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.timing import RESPONSE_CAP, Day, in_days, trailing_days

PREVIEW_CHARS = 100

# The column subsets of the reports.
SUBSETS = {
    "recent": ("conversation_id", "user_id", "message_preview", "sender_type", "timestamp", "message_type"),
    "log": ("conversation_id", "user_id", "message", "sender_type", "timestamp", "message_type"),
    "context": ("conversation_id", "user_id", "message", "sender_type", "timestamp", "sentiment"),
    "vectors": ("id", "conversation_id", "message", "embedding_vector", "timestamp", "sender_type"),
    "summary": ("message", "sender_type", "timestamp", "sentiment"),
}


def message_preview(messages: DataFrame, chars: int = PREVIEW_CHARS) -> DataFrame:
    return messages.withColumn("message_preview", F.left(F.col("message"), F.lit(chars)))


def project(messages: DataFrame, subset: str) -> DataFrame:
    frame = message_preview(messages) if subset == "recent" else messages
    return frame.select(*SUBSETS[subset])


def date_range(messages: DataFrame, start: Day, end: Day, tz: str | None = None) -> DataFrame:
    return messages.filter(in_days(messages, "timestamp", start, end, tz))


def one_day(messages: DataFrame, day: Day, tz: str | None = None) -> DataFrame:
    return date_range(messages, day, day, tz)


def last_days(messages: DataFrame, as_of: Day, days: int = 30) -> DataFrame:
    return messages.filter(trailing_days(messages, "timestamp", as_of, days))


def sender(messages: DataFrame, kind: str) -> DataFrame:
    return messages.filter(F.col("sender_type") == kind)


def null_state(messages: DataFrame, present: tuple[str, ...] = (), absent: tuple[str, ...] = ()) -> DataFrame:
    rules: list[Column] = [F.col(c).isNotNull() for c in present] + [F.col(c).isNull() for c in absent]
    return messages.filter(reduce(and_, rules)) if rules else messages


def optional(messages: DataFrame, user_id=None, day: Day | None = None) -> DataFrame:
    """Only the conditions whose argument is given."""
    rules: list[Column] = []
    if user_id is not None and user_id != "":
        rules.append(F.col("user_id") == F.lit(user_id))
    if day is not None:
        rules.append(in_days(messages, "timestamp", day, day))
    return messages.filter(reduce(and_, rules)) if rules else messages


def caseless(messages: DataFrame, *columns: str) -> DataFrame:
    """Compare, group and count these columns without regard to case and accents."""
    return messages.withColumns({c: F.collate(F.col(c), "UNICODE_CI_AI") for c in columns})


def response_cap(messages: DataFrame, cap: int = RESPONSE_CAP) -> DataFrame:
    return messages.filter(F.col("response_time") <= cap)


def newest(messages: DataFrame, limit: int | None) -> DataFrame:
    """Latest rows first, ties by descending id; ``None`` keeps the whole table unsorted."""
    if limit is None:
        return messages
    return messages.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)


def recent_messages(messages: DataFrame, limit: int = 10) -> DataFrame:
    return project(newest(messages, limit), "recent")


def filtered_messages(messages: DataFrame, user_id=None, day: Day | None = None, limit: int = 50) -> DataFrame:
    return project(newest(optional(messages, user_id, day), limit), "log")


def context_messages(messages: DataFrame, limit: int = 100) -> DataFrame:
    return project(newest(messages, limit), "context")


def latest_customer_messages(messages: DataFrame, limit: int | None = 100) -> DataFrame:
    return newest(sender(messages, "customer"), limit)


def unprocessed_messages(messages: DataFrame, limit: int | None = 100) -> DataFrame:
    return newest(null_state(sender(messages, "customer"), absent=("processed_at",)), limit)


def ordered_transcript(messages: DataFrame) -> DataFrame:
    """All messages by conversation and time: a range sort, whose cuts may fall inside a
    conversation because the sort key continues with time and id."""
    return messages.orderBy("conversation_id", "timestamp", "id")
