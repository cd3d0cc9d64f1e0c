"""Per-conversation summaries, transcripts, digests and prompts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from parley.lexicons import PROBE_TOPICS
from parley.operators import conversations, states
from parley.operators.slices import first_rows
from parley.plans.metrics import SCORE
from parley.plans.oracle import text_literal, topics_of_messages, with_messages
from parley.plans.registry import query
from parley.plans.texts import NOW, TOP_TOPICS
from parley.session import fresh_folder
from parley.sources.fixtures import messages, table
from parley.sources.sinks import upsert_days, write_by_date

EARLIER = datetime(2024, 1, 10)

SUMMARY = """SELECT conversation_id, count(*) AS total_messages,
    count(*) FILTER (WHERE sender_type = 'customer') AS customer_messages,
    count(*) FILTER (WHERE sender_type = 'admin') AS admin_messages,
    min("timestamp") AS start_time, max("timestamp") AS end_time,
    round(avg(response_time), 2) AS avg_response_time,
    round((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 60e6, 6) AS duration_minutes"""


@query("conversation_summary", with_messages(SUMMARY + " FROM v GROUP BY conversation_id"))
def _(spark, sf):
    return conversations.conversation_summary(messages(spark, sf, response_time=True))


COUNTS = ", ".join(f"count(*) FILTER (WHERE sentiment = '{s}') AS {s}" for s in ("positive", "negative", "neutral"))


@query("conversation_sentiments", with_messages(f"SELECT conversation_id, {COUNTS} FROM m GROUP BY conversation_id"))
def _(spark, sf):
    return conversations.conversation_sentiments(messages(spark, sf, sentiment=True))


@query(
    "conversation_sentiment_map",
    with_messages(
        """SELECT conversation_id, string_agg(sentiment || '=' || CAST(n AS VARCHAR), ' ' ORDER BY sentiment) AS sentiments
           FROM (SELECT conversation_id, sentiment, count(*) AS n FROM m WHERE sentiment IS NOT NULL GROUP BY 1, 2)
           GROUP BY conversation_id
           UNION ALL SELECT conversation_id, '' FROM m GROUP BY 1 HAVING count(sentiment) = 0"""
    ),
)
def _(spark, sf):
    counts = conversations.conversation_sentiments(messages(spark, sf, sentiment=True))
    pairs = F.array_sort(F.map_entries("sentiment_distribution"))
    shown = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return conversations.sentiment_map(counts).select("conversation_id", F.array_join(shown, " ").alias("sentiments"))


SUMMARY_TABLE = with_messages(
        topics_of_messages()
        + f""", g AS ({TOP_TOPICS}),
        b AS ({SUMMARY}, arg_min(user_id, {{'ts': "timestamp", 'id': id}}) AS user_id,
              round(avg(CASE WHEN sentiment IS NOT NULL THEN {SCORE} END), 2) AS satisfaction_score, {COUNTS}
              FROM m GROUP BY conversation_id)
        SELECT b.conversation_id, user_id, start_time, end_time, CAST(start_time AS DATE) AS start_date,
               CAST(total_messages AS INT) AS total_messages, CAST(customer_messages AS INT) AS customer_messages,
               CAST(admin_messages AS INT) AS admin_messages, duration_minutes, avg_response_time, satisfaction_score,
               positive, negative, neutral, coalesce(tags, '') AS tags, 'active' AS status, false AS resolved,
               TIMESTAMP '2024-01-15 00:00:00' AS updated_at
        FROM b LEFT JOIN (SELECT conversation_id, string_agg(topic, ',' ORDER BY rank) AS tags FROM g GROUP BY 1) USING (conversation_id)"""
    )


def _shown(stored):
    return stored.drop("summary", "created_at").withColumns({
        "updated_at": F.col("updated_at").cast("timestamp_ntz"),
        "tags": F.array_join("tags", ","),
        "avg_response_time": F.col("avg_response_time").cast("double"),
        "satisfaction_score": F.col("satisfaction_score").cast("double"),
    })


@query("summary_table", SUMMARY_TABLE)
def _(spark, sf):
    rows = messages(spark, sf, response_time=True, sentiment=True)
    path = fresh_folder(spark, "summaries")
    # the table as of an earlier day, then brought up to date on its key
    before = conversations.full_summary(rows.where(F.col("id") % 5 != 0), PROBE_TOPICS, EARLIER)
    write_by_date(before, path, "start_date")
    stored = spark.read.schema(before.schema).parquet(path)
    upsert_days(path, stored, conversations.full_summary(rows, PROBE_TOPICS, NOW), ["conversation_id"], day="start_date")
    return _shown(spark.read.schema(before.schema).parquet(path))


@query("summary_table_incremental", SUMMARY_TABLE)
def _(spark, sf):
    rows = messages(spark, sf, response_time=True, sentiment=True)
    follower = states.SummaryFollower(fresh_folder(spark, "followed"), rows, PROBE_TOPICS)
    # the middle of the time comes last, and one arrival twice
    late = F.date_trunc("day", "timestamp").between(F.lit("2024-01-04"), F.lit("2024-01-08"))
    odd = F.col("id") % 2 == 1
    follower.arrive(rows.where(~late & odd), "a", EARLIER)
    follower.arrive(rows.where(~late & ~odd), "b", EARLIER)
    follower.counts.compact()
    follower.topics.compact()
    follower.arrive(rows.where(late), "c", NOW)
    follower.arrive(rows.where(late), "c", NOW)
    follower.arrive(rows.where(~late & odd), "a", NOW)
    return _shown(follower.table()).withColumn("updated_at", F.lit(NOW).cast("timestamp_ntz"))


@query(
    "resolution_rate",
    "SELECT round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE WHEN quality = 0 THEN 0.0::DOUBLE END), 6) AS resolution_rate FROM labels",
)
def _(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("resolved"))
    return conversations.resolution_rate(rows)


@query("derive_response_time", with_messages(
    """SELECT id, CASE WHEN sender_type = 'admin' AND before = 'customer'
          THEN CAST(floor((epoch_us("timestamp") - epoch_us(prior_ts)) / 1e6) AS INT) END AS response_time
       FROM (SELECT *, lag(sender_type) OVER w AS before, lag("timestamp") OVER w AS prior_ts
             FROM v WINDOW w AS (PARTITION BY conversation_id ORDER BY "timestamp", id))"""
))
def _(spark, sf):
    return conversations.derive_response_time(messages(spark, sf)).select("id", "response_time")


@query("derive_response_time_events", """SELECT id, CASE WHEN event_type = 'click' AND before = 'view'
          THEN CAST(floor((epoch_us(ts) - epoch_us(prior_ts)) / 1e6) AS INT) END AS response_time
       FROM (SELECT event_id AS id, ts, event_type, lag(event_type) OVER w AS before, lag(ts) OVER w AS prior_ts
             FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def _(spark, sf):
    # an event log as one long conversation per user
    kind = F.when(F.col("event_type") == "view", "customer").when(F.col("event_type") == "click", "admin")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("conversation_id"),
        F.col("ts").alias("timestamp"),
        kind.otherwise("system").alias("sender_type"),
    )
    return conversations.derive_response_time(rows).select("id", "response_time")


_DIGEST_LINE = (
    "CAST(place AS VARCHAR) || '. [' || strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') || '] ' || sender_type || ' (' ||"
    " CAST(user_id AS VARCHAR) || '): ' || left(message, 100) || ' [ความรู้สึก: ' || coalesce(sentiment, 'None') || ']'"
)
_LATEST = "ORDER BY \"timestamp\" DESC, id DESC"
_DIGESTS = (
    f"SELECT conversation_id, string_agg({_DIGEST_LINE}, chr(10) ORDER BY place) AS digest FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY conversation_id {_LATEST}) AS place FROM m) WHERE place <= 10"
    " GROUP BY conversation_id"
)


@query(
    "context_digest",
    with_messages(
        f"SELECT string_agg({_DIGEST_LINE}, chr(10) ORDER BY place) AS digest FROM ("
        f"SELECT *, row_number() OVER ({_LATEST}) AS place FROM m) WHERE place <= 10"
    ),
)
def _(spark, sf):
    return conversations.context_digest(messages(spark, sf, sentiment=True))


@query("conversation_digests", with_messages(_DIGESTS))
def _(spark, sf):
    return conversations.conversation_digests(messages(spark, sf, sentiment=True))


_TRANSCRIPTS = (
    "SELECT conversation_id, string_agg(CAST(place AS VARCHAR) || '. [' || sender_type || '] ' || left(message, 150) ||"
    " ' (ความรู้สึก: ' || coalesce(sentiment, 'None') || ')', chr(10) ORDER BY place) AS transcript FROM ("
    'SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY "timestamp", id) AS place FROM m)'
    " WHERE place <= 20 GROUP BY conversation_id"
)


@query("conversation_transcript", with_messages(_TRANSCRIPTS))
def _(spark, sf):
    return conversations.conversation_transcripts(messages(spark, sf, sentiment=True))


@query(
    "prompt_table",
    with_messages(
        f"SELECT conversation_id, {text_literal(conversations.REVIEW_INSTRUCTION)} || chr(10) || chr(10) || transcript AS prompt"
        f" FROM ({_TRANSCRIPTS})"
    ),
)
def _(spark, sf):
    return conversations.review_prompts(messages(spark, sf, sentiment=True))


@query(
    "question_prompts",
    with_messages(
        f"""SELECT conversation_id, question, {text_literal(conversations.ASSISTANT_INSTRUCTION)} || chr(10) || chr(10) || digest
             || chr(10) || chr(10) || 'Question: ' || question AS prompt
        FROM ({_DIGESTS}) JOIN (SELECT conversation_id, arg_max(message, {{'ts': "timestamp", 'id': id}}) AS question
             FROM m WHERE sender_type = 'customer' GROUP BY 1) USING (conversation_id)"""
    ),
)
def _(spark, sf):
    rows = messages(spark, sf, sentiment=True)
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    customers = rows.filter(F.col("sender_type") == "customer")
    last = first_rows(customers.select("conversation_id", "message", "timestamp", "id"), ["conversation_id"], order, 1)
    questions = last.select("conversation_id", F.col("message").alias("question"))
    return conversations.question_prompts(rows, questions)
