"""Rule-based findings and threshold alerts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.timing import Day, as_day, in_days
from parley.lexicons import TOPICS, Lexicon
from parley.operators.metrics import day_of
from parley.operators.topics import topic_frequency

# Rules, wording and formats of the findings.
SLOW_MINUTES = 10
NEGATIVE_PERCENT = 30
INSIGHT_DAYS = 7
INSIGHT_MESSAGES = 50
SLOW_TITLE = "เวลาตอบกลับช้า"
SLOW_TEXT = "เวลาตอบกลับเฉลี่ย %s นาที ควรปรับปรุง"
NEGATIVE_TITLE = "ความรู้สึกลูกค้าไม่ดี"
NEGATIVE_TEXT = "พบความรู้สึกเชิงลบ %s%% ควรตรวจสอบ"
TOPIC_TITLE = "หัวข้อยอดฮิต: %s"
TOPIC_TEXT = "พบการสนทนาเรื่อง%sบ่อยที่สุด"

# Alert thresholds.
ALERT_NEGATIVE_SHARE = 0.3
ALERT_RESPONSE_SECONDS = 1800.0
ALERT_MESSAGES = 1000.0

DIGITS = 6


def one_decimal(value):
    """One decimal, halves to even, no grouping."""
    return F.call_function("format_number", value, F.lit("0.0"))


def insights(
    messages: DataFrame,
    as_of: Day,
    lexicon: Lexicon = TOPICS,
    days: int = INSIGHT_DAYS,
    newest_messages: int | None = INSIGHT_MESSAGES,
    slow_minutes: float = SLOW_MINUTES,
    negative_percent: float = NEGATIVE_PERCENT,
) -> DataFrame:
    """type, title, description, priority: slow answers, bad mood, the leading topic.

    The first two rules share one scan; every rule drops its row when it does not hold.
    """
    end = as_day(as_of)
    recent = in_days(messages, "timestamp", end - timedelta(days=days), end)
    measured = messages.agg(
        F.coalesce(F.avg(F.when(recent, F.col("response_time"))) / 60, F.lit(0.0)).alias("minutes"),
        F.try_divide(
            100.0 * F.count_if(F.col("sentiment") == "negative"), F.count("sentiment")
        ).alias("negative"),
    )
    slow = F.when(
        F.col("minutes") > slow_minutes,
        F.struct(
            F.lit("warning").alias("type"),
            F.lit(SLOW_TITLE).alias("title"),
            F.format_string(SLOW_TEXT, one_decimal(F.col("minutes"))).alias("description"),
            F.lit("high").alias("priority"),
        ),
    )
    mood = F.when(
        F.col("negative") > negative_percent,
        F.struct(
            F.lit("alert").alias("type"),
            F.lit(NEGATIVE_TITLE).alias("title"),
            F.format_string(NEGATIVE_TEXT, one_decimal(F.col("negative"))).alias("description"),
            F.lit("high").alias("priority"),
        ),
    )
    rules = measured.select(F.explode(F.array(slow, mood)).alias("_rule"))
    fired = rules.filter(F.col("_rule").isNotNull()).select("_rule.*")
    leading = topic_frequency(messages, lexicon, newest_messages).limit(1).select(
        F.lit("info").alias("type"),
        F.format_string(TOPIC_TITLE, F.col("topic")).alias("title"),
        F.format_string(TOPIC_TEXT, F.col("topic")).alias("description"),
        F.lit("medium").alias("priority"),
    )
    return fired.unionByName(leading)


def alert_flags(
    messages: DataFrame,
    negative_share: float = ALERT_NEGATIVE_SHARE,
    response_seconds: float = ALERT_RESPONSE_SECONDS,
    volume: float = ALERT_MESSAGES,
) -> DataFrame:
    """One row per day and threshold exceeded."""
    daily = messages.groupBy(day_of(messages).alias("date")).agg(
        F.try_divide(
            F.count_if(F.col("sentiment") == "negative").cast("double"), F.count("sentiment")
        ).alias("negative_share"),
        F.avg("response_time").alias("response_seconds"),
        F.count("*").cast("double").alias("volume"),
    )
    rules = (
        ("high_negative_sentiment", "negative_share", negative_share),
        ("slow_response_time", "response_seconds", response_seconds),
        ("high_message_volume", "volume", volume),
    )
    flags = F.inline(F.array(*(
        F.struct(
            F.lit(name).alias("alert"),
            F.round(F.col(measure), DIGITS).alias("value"),
            F.lit(float(threshold)).alias("threshold"),
            (F.col(measure) > threshold).alias("_fired"),
        )
        for name, measure, threshold in rules
    )))
    return daily.select("date", flags).filter("_fired").drop("_fired")
