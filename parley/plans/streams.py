"""Streams over the given tables, drained, read back and compared with the batch result.

Messages arrive as the conversation file; event time and user come from the static events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.lexical import explode_labels
from parley.lexicons import PROBE_SENTIMENT, PROBE_TOPICS
from parley.plans.oracle import MESSAGE_VIEW, ranked_labels, scored, with_messages
from parley.plans.registry import query
from parley.session import fresh_folder
from parley.sources.fixtures import CONVERSATIONS, EVENTS, add_event, add_user, messages, shape, table
from parley.sources.readers import scan_message_stream
from parley.streaming.enrich import enrich, incremental_enrich
from parley.streaming.kpis import daily_from_sightings, daily_sightings, dedup_messages, first_sightings, stream_kpis
from parley.streaming.lockout import stream_lockout
from parley.streaming.sinks import drain_batches, drain_to_files, drain_updates, insert_ignore_sink, stored_rows
from parley.streaming.state import state_store


#: More files than any folder has: a given table is one arrival, and the order of its files says nothing of their times.
ALL_FILES = 2**31 - 1


def message_stream(spark, sf):
    # a pattern, which a single file and a folder of files both match
    arriving = scan_message_stream(spark, f"{sf}/conversations{{.parquet}}", CONVERSATIONS, files_per_batch=ALL_FILES)
    events = table(spark, sf, "events")
    return shape(add_user(add_event(arriving, events), events))


def _stamp():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


def _later():
    return F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")


_STREAM_ENRICH = f"""WITH {MESSAGE_VIEW}, s AS ({scored('v', 'message', PROBE_SENTIMENT)})
    SELECT s.id, label AS sentiment, score AS sentiment_score, coalesce(t.topics, '') AS topics,
           TIMESTAMP '2024-01-15 00:00:00' AS processed_at
    FROM s LEFT JOIN (SELECT id, string_agg(label, ',' ORDER BY rank) AS topics
                      FROM ({ranked_labels('v', 'id', 'message', PROBE_TOPICS)}) GROUP BY id) t ON t.id = s.id"""


def _shown(rows):
    return rows.select(
        "id", "sentiment", "sentiment_score", F.array_join("topics.label", ",").alias("topics"), "processed_at"
    )


@query("stream_enrich", _STREAM_ENRICH)
def _(spark, sf):
    stream = enrich(message_stream(spark, sf), _stamp(), PROBE_SENTIMENT, PROBE_TOPICS)
    return _shown(drain_to_files(stream, fresh_folder(spark, "enriched")))


@query("batch_enrich", _STREAM_ENRICH)
def _(spark, sf):
    return _shown(enrich(messages(spark, sf), _stamp(), PROBE_SENTIMENT, PROBE_TOPICS))


@query(
    "incremental_enrich",
    with_messages(
        """SELECT s.id, CASE WHEN w THEN s.label ELSE m.sentiment END AS sentiment,
                  CASE WHEN w THEN s.score ELSE m.sentiment_score END AS sentiment_score,
                  CASE WHEN w AND m.id % 2 = 0 THEN TIMESTAMP '2024-01-15 00:00:00'
                       WHEN w THEN TIMESTAMP '2024-01-16 00:00:00' ELSE m.processed_at END AS processed_at
           FROM (SELECT *, processed_at IS NULL AND sender_type = 'customer' AS w FROM m) m JOIN s ON s.id = m.id"""
    ),
)
def _(spark, sf):
    stored = messages(spark, sf, sentiment=True)
    # two arrivals: the second delivers some messages again, which must not touch what the first call stored
    inbox, folder = fresh_folder(spark, "inbox"), fresh_folder(spark, "queue")
    rows = messages(spark, sf).withColumn("processed_at", F.when(F.col("id") % 3 != 0, F.col("timestamp")))
    result = stored
    for number, (chosen, stamp) in enumerate(((F.col("id") % 2 == 0, _stamp()), (F.col("id") % 4 != 2, _later()))):
        rows.where(chosen).write.mode("append").parquet(inbox)
        arriving = scan_message_stream(spark, inbox, rows.schema)
        worked = incremental_enrich(result, arriving, folder, stamp, PROBE_SENTIMENT, PROBE_TOPICS)
        path = fresh_folder(spark, f"worked-{number}")
        worked.table.write.parquet(path)
        result = spark.read.schema(worked.table.schema).parquet(path)
    return result.select("id", "sentiment", "sentiment_score", "processed_at")


def _windows_sql(width: str) -> str:
    return with_messages(
        f"""SELECT date_trunc('{width}', "timestamp") AS window_start,
                   date_trunc('{width}', "timestamp") + INTERVAL 1 {width} AS window_end, count(*) AS messages,
                   count(*) FILTER (WHERE sender_type = 'customer') AS customer_messages FROM v GROUP BY 1, 2"""
    )


def _ntz(rows):
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_kpis", _windows_sql("hour"))
def _(spark, sf):
    kpis = stream_kpis(message_stream(spark, sf))
    return _ntz(drain_updates(kpis, fresh_folder(spark, "kpis"), ["window_start", "window_end"]))


@query("window_kpis", _windows_sql("day"))
def _(spark, sf):
    return _ntz(stream_kpis(messages(spark, sf), "1 day"))


@query(
    "stream_kpis_approx",
    with_messages(
        """SELECT date_trunc('day', "timestamp") AS window_start, date_trunc('day', "timestamp") + INTERVAL 1 day AS window_end,
                  count(*) AS messages, count(*) FILTER (WHERE sender_type = 'customer') AS customer_messages,
                  count(DISTINCT conversation_id) AS exact, true AS close FROM v GROUP BY 1, 2"""
    ),
)
def _(spark, sf):
    kpis = stream_kpis(message_stream(spark, sf), "1 day", approx_conversations=True)
    found = _ntz(drain_updates(kpis, fresh_folder(spark, "kpis"), ["window_start", "window_end"]))
    days = F.date_trunc("day", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz").alias("window_start")
    exact = messages(spark, sf).groupBy(days).agg(F.countDistinct("conversation_id").alias("exact"))
    near = F.abs(F.col("conversations") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return found.join(exact, "window_start").withColumn("close", near).drop("conversations")


@query(
    "stream_daily_conversations",
    with_messages(
        'SELECT CAST("timestamp" AS DATE) AS date, count(DISTINCT conversation_id) AS conversations FROM v GROUP BY 1'
    ),
)
def _(spark, sf):
    seen = drain_to_files(first_sightings(message_stream(spark, sf)), fresh_folder(spark, "sightings"))
    return daily_from_sightings(seen)


def _arrive_late(rows, time, seconds, inbox):
    """Write rows to five files one after the other, each row up to so many seconds later than its time."""
    late = F.pmod(F.xxhash64("id"), F.lit(seconds)) * F.expr("INTERVAL 1 SECOND")
    arriving = rows.withColumn("at", F.unix_micros((F.col(time) + late).cast("timestamp")))
    first, last = arriving.agg(F.min("at"), F.max("at")).first()
    for turn in range(5):
        begin, end = (first + (last + 1 - first) * t // 5 for t in (turn, turn + 1))
        arriving.where((F.col("at") >= begin) & (F.col("at") < end)).drop("at").coalesce(1).write.mode("append").parquet(inbox)


@query(
    "stream_daily_conversations_late",
    with_messages(
        'SELECT CAST("timestamp" AS DATE) AS date, count(DISTINCT conversation_id) AS conversations FROM v GROUP BY 1'
    ),
)
def _(spark, sf):
    # messages arrive up to half an hour late and the stream waits an hour, far less than a day
    inbox = fresh_folder(spark, "late")
    rows = messages(spark, sf).select("id", "conversation_id", "timestamp")
    _arrive_late(rows, "timestamp", 1_800, inbox)
    with state_store(spark):
        stream = scan_message_stream(spark, inbox, rows.schema, files_per_batch=1)
        seen = drain_to_files(daily_sightings(stream, "1 hour"), fresh_folder(spark, "sightings"))
    return daily_from_sightings(seen)


@query(
    "stream_lockout",
    """WITH RECURSIVE a AS (
         SELECT event_id AS id, user_id, epoch_us(ts) AS us, event_type = 'signup' AS ok,
                row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
         FROM events WHERE event_type IN ('error', 'signup')),
       fold AS (
         SELECT user_id, id, n, CASE WHEN ok THEN []::BIGINT[] ELSE [us] END AS recorded, false AS refused FROM a WHERE n = 1
         UNION ALL
         SELECT user_id, id, n, CASE WHEN len(live) >= 3 THEN live WHEN ok THEN []::BIGINT[] ELSE list_append(live, us) END,
                len(live) >= 3
         FROM (SELECT a.*, list_filter(fold.recorded, lambda t: a.us - t < 86400000000) AS live
               FROM fold JOIN a ON a.user_id = fold.user_id AND a.n = fold.n + 1))
       SELECT user_id, id, CAST(len(recorded) AS INT) AS failures, refused FROM fold""",
)
def _(spark, sf):
    from datetime import timedelta

    events = table(spark, sf, "events")
    attempts = events.filter(F.col("event_type").isin("error", "signup")).select(
        F.col("event_id").alias("id"), "user_id", "ts", (F.col("event_type") == "signup").alias("ok")
    )
    # each attempt arrives up to half a day late; a last attempt of nobody two days later moves the watermark past them all
    inbox = fresh_folder(spark, "attempts")
    _arrive_late(attempts, "ts", 43_200, inbox)
    closing = attempts.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("user_id"),
        (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(True).alias("ok"),
    )
    closing.write.mode("append").parquet(inbox)
    with state_store(spark):
        stream = scan_message_stream(spark, inbox, attempts.schema, files_per_batch=1)
        decided = stream_lockout(stream, "user_id", 3, timedelta(days=1), delay="1 day")
        return drain_to_files(decided, fresh_folder(spark, "lockout")).where("user_id >= 0")


@query("stream_dedup_append", with_messages('SELECT id, conversation_id, message, "timestamp" FROM v'))
def _(spark, sf):
    # every message is delivered twice
    twice = message_stream(spark, sf).unionByName(message_stream(spark, sf))
    rows = dedup_messages(twice.select("id", "conversation_id", "message", "timestamp"))
    folder = fresh_folder(spark, "ingest")
    schema = "id long, conversation_id long, message string, timestamp timestamp"
    drain_batches(rows, folder, insert_ignore_sink(spark, f"{folder}/rows", schema))
    stored = stored_rows(spark, f"{folder}/rows", schema)
    return stored.select("id", "conversation_id", "message", F.col("timestamp").cast("timestamp_ntz"))
