"""Row validation and pseudonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.schema import (
    MAX_CONVERSATION_ID,
    MAX_MESSAGE,
    MAX_USER_ID,
    MESSAGE_TYPES,
    SENDER_TYPES,
    SENTIMENTS,
)


def _rules() -> list[tuple[str, str, Column]]:
    """(rule name, column it looks at, condition that breaks it)."""

    def missing(column: str):
        return f"{column}_missing", column, F.col(column).isNull()

    def too_long(column: str, limit: int):
        return f"{column}_too_long", column, F.length(F.col(column).cast("string")) > limit

    def unknown(column: str, domain: tuple[str, ...]):
        broken = F.col(column).isNotNull() & ~F.col(column).isin(*domain)
        return f"{column}_unknown", column, broken

    return [
        missing("conversation_id"),
        too_long("conversation_id", MAX_CONVERSATION_ID),
        missing("user_id"),
        too_long("user_id", MAX_USER_ID),
        missing("message"),
        too_long("message", MAX_MESSAGE),
        unknown("message_type", MESSAGE_TYPES),
        missing("sender_type"),
        unknown("sender_type", SENDER_TYPES),
        unknown("sentiment", SENTIMENTS),
        ("sentiment_score_out_of_range", "sentiment_score", ~F.col("sentiment_score").between(-1, 1)),
    ]


def validate_messages(messages: DataFrame) -> DataFrame:
    """Add ``violations``: the rules a row breaks, in rule order; absent columns are not checked."""
    named = [F.when(broken, F.lit(name)) for name, column, broken in _rules() if column in messages.columns]
    return messages.withColumn("violations", F.array_compact(F.array(*named)))


def violation_counts(messages: DataFrame) -> DataFrame:
    opened = validate_messages(messages).select(F.explode("violations").alias("rule"))
    return opened.groupBy("rule").agg(F.count("*").alias("rows"))


def pseudonymise_users(messages: DataFrame, salt: str, column: str = "user_id") -> DataFrame:
    return messages.withColumn(column, F.sha2(F.concat(F.lit(salt), F.col(column).cast("string")), 256))
