"""Operators on a stored message table in its production types, partitioned by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import conversations, filters, metrics, newest, sketches
from parley.plans.metrics import DAILY, SATISFACTION_TREND
from parley.plans.oracle import with_messages
from parley.plans.registry import query
from parley.plans.rows import AS_OF, END, NEWEST, RANGE, START
from parley.schema import MESSAGES
from parley.session import fresh_folder
from parley.sources.fixtures import messages
from parley.sources.readers import stored_form
from parley.sources.sinks import read_days, write_by_date

_PATHS: dict[tuple[str, str], str] = {}


def stored_path(spark, sf):
    """The message view in the stored types, with ids as text, written once per session and input."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _PATHS:
        view = messages(spark, sf, response_time=True, sentiment=True)
        named = view.withColumns({
            "conversation_id": F.concat(F.lit("c"), "conversation_id"), "user_id": F.concat(F.lit("u"), "user_id"),
        })
        path = fresh_folder(spark, "messages")
        write_by_date(stored_form(named), path, "day")
        _PATHS[key] = path
    return _PATHS[key]


def stored_messages(spark, sf):
    return read_days(spark, stored_path(spark, sf), MESSAGES)


@query(
    "range_kpis_stored",
    with_messages(
        "SELECT count(DISTINCT conversation_id) AS total_conversations, count(*) AS total_messages,"
        " count(DISTINCT user_id) AS unique_users,"
        f" coalesce(round(avg(response_time) / 60, 6), 0) AS avg_response_minutes FROM v WHERE {RANGE}"
    ),
)
def _(spark, sf):
    return metrics.range_kpis(stored_messages(spark, sf), START, END)


@query("daily_conversations_stored", with_messages(DAILY))
def _(spark, sf):
    return metrics.daily_conversations(stored_messages(spark, sf), START, END)


@query(
    "filter_day_stored",
    with_messages(
        "SELECT id, 'c' || conversation_id AS conversation_id, sentiment_score FROM m"
        " WHERE CAST(\"timestamp\" AS DATE) = DATE '2024-01-05'"
    ),
)
def _(spark, sf):
    found = filters.one_day(stored_messages(spark, sf), START)
    return found.select("id", "conversation_id", F.col("sentiment_score").cast("double").alias("sentiment_score"))


@query("satisfaction_trend_stored", SATISFACTION_TREND)
def _(spark, sf):
    return metrics.satisfaction_trend(stored_messages(spark, sf), AS_OF)


@query("derive_response_time_stored", with_messages("SELECT id, response_time FROM v"))
def _(spark, sf):
    found = conversations.derive_response_time(stored_messages(spark, sf))
    return found.select("id", "response_time")


# -- newest first: only the newest days are opened -----------------------------------------------

_NAMED = "'c' || conversation_id AS conversation_id, 'u' || user_id AS user_id"


@query(
    "recent_messages_stored",
    with_messages(f'SELECT {_NAMED}, left(message, 100) AS message_preview, sender_type, message_type FROM (SELECT * FROM v {NEWEST} 10)'),
)
def _(spark, sf):
    return newest.recent_messages(spark, stored_path(spark, sf), MESSAGES, 10).drop("timestamp")


@query(
    "context_messages_stored",
    with_messages(f"SELECT {_NAMED}, message, sender_type, sentiment FROM (SELECT * FROM m {NEWEST} 100)"),
)
def _(spark, sf):
    return newest.context_messages(spark, stored_path(spark, sf), MESSAGES, 100).drop("timestamp")


@query(
    "latest_customer_messages_stored",
    with_messages(f"SELECT id, message FROM (SELECT * FROM v WHERE sender_type = 'customer' {NEWEST} 100)"),
)
def _(spark, sf):
    return newest.latest_customer_messages(spark, stored_path(spark, sf), MESSAGES, 100).select("id", "message")


@query(
    "unprocessed_messages_stored",
    with_messages(
        f"SELECT id, message FROM (SELECT * FROM m WHERE sender_type = 'customer' AND processed_at IS NULL {NEWEST} 50)"
    ),
)
def _(spark, sf):
    return newest.unprocessed_messages(spark, stored_path(spark, sf), MESSAGES, 50).select("id", "message")


# -- sketches: exact values of a range, and whether the merged daily sketches keep their bounds --------


@query(
    "range_kpis_sketched",
    with_messages(
        f""", r AS (SELECT * FROM v WHERE {RANGE})
        SELECT 'total_messages' AS measure, count(*)::BIGINT AS exact, true AS within FROM r
        UNION ALL SELECT 'total_conversations', count(DISTINCT conversation_id), true FROM r
        UNION ALL SELECT 'unique_users', count(DISTINCT user_id), true FROM r
        UNION ALL SELECT unnest(['response_q50', 'response_q90', 'response_q99']), count(response_time), true FROM r"""
    ),
)
def _(spark, sf):
    stored, path = stored_messages(spark, sf), fresh_folder(spark, "sketches")
    sketches.daily_sketches(stored).write.parquet(path)
    about = sketches.range_from_sketches(spark.read.parquet(path), START, END).first()
    rows = filters.date_range(stored, START, END)
    exact = rows.agg(
        F.count("*").alias("total_messages"), F.countDistinct("conversation_id").alias("total_conversations"),
        F.countDistinct("user_id").alias("unique_users"), F.count("response_time").alias("answers"),
        *(F.avg((F.col("response_time") < about[f"response_q{p}"]).cast("double")).alias(f"below{p}") for p in (50, 90, 99)),
        *(F.avg((F.col("response_time") <= about[f"response_q{p}"]).cast("double")).alias(f"upto{p}") for p in (50, 90, 99)),
    )
    bound = {"total_messages": 0.0, "total_conversations": sketches.DISTINCT_BOUND, "unique_users": sketches.DISTINCT_BOUND}
    counts = [(c, F.col(c), F.abs(F.col(c) - about[c]) <= F.col(c) * b) for c, b in bound.items()]
    ranks = [
        (f"response_q{p}", F.col("answers"), (F.col(f"below{p}") <= p / 100 + sketches.RANK_BOUND) & (F.col(f"upto{p}") >= p / 100 - sketches.RANK_BOUND))
        for p in (50, 90, 99)
    ]
    shown = [F.struct(F.lit(m).alias("measure"), e.alias("exact"), w.alias("within")) for m, e, w in counts + ranks]
    return exact.select(F.inline(F.array(*shown)))
