"""Explicit schemas and value domains of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the enumerated columns and the length rules.
MESSAGE_TYPES = ("text", "image", "video", "audio", "file", "sticker", "location")
SENDER_TYPES = ("customer", "admin", "system")
SENTIMENTS = ("positive", "negative", "neutral")
CONVERSATION_STATES = ("active", "closed", "escalated")
MAX_USER_ID = 100
MAX_CONVERSATION_ID = 100
MAX_MESSAGE = 4000
MAX_TOPIC_NAME = 200

MESSAGES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("conversation_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("message_type", T.StringType()),
    T.StructField("sender_type", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("response_time", T.IntegerType()),
    T.StructField("sentiment", T.StringType()),
    T.StructField("sentiment_score", T.DecimalType(3, 2)),
    T.StructField("embedding_vector", T.ArrayType(T.DoubleType())),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("metadata", T.StringType()),
])

CONVERSATION_SUMMARY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("conversation_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()),
    T.StructField("total_messages", T.IntegerType()),
    T.StructField("customer_messages", T.IntegerType()),
    T.StructField("admin_messages", T.IntegerType()),
    T.StructField("avg_response_time", T.DecimalType(10, 2)),
    T.StructField("satisfaction_score", T.DecimalType(3, 2)),
    T.StructField("summary", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("resolved", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

TOPICS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("topic_name", T.StringType(), False),
    T.StructField("topic_keywords", T.ArrayType(T.StringType())),
    T.StructField("frequency", T.IntegerType()),
    T.StructField("embedding_vector", T.ArrayType(T.DoubleType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

RESULT_MANIFEST = T.StructType([
    T.StructField("cache_key", T.StringType(), False),
    T.StructField("result_path", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("expires_at", T.TimestampType(), False),
])
