"""Scans, projections, filters, newest-first lists and row checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.timing import in_business_hours, response_band
from parley.operators import filters, lockout, quality
from parley.operators.slices import first_rows
from parley.plans.oracle import with_messages
from parley.plans.registry import query
from parley.schema import MESSAGES
from parley.session import fresh_folder
from parley.sources import readers
from parley.sources.fixtures import messages, table
from parley.sources.sinks import TIME_FORMATS

START, END, AS_OF = "2024-01-05", "2024-01-11", "2024-01-15"
CAP = 600
SALT = "pepper"
RANGE = "CAST(\"timestamp\" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'"

PLAIN = 'id, conversation_id, user_id, message, message_type, sender_type, "timestamp", metadata'


@query("scan_messages", with_messages(f"SELECT {PLAIN}, response_time, sentiment, sentiment_score FROM m"))
def _(spark, sf):
    return messages(spark, sf, response_time=True, sentiment=True).drop("processed_at")


def _typed(frame):
    """The message view in the column types of the stored table."""
    return frame.select(*(
        (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in MESSAGES.fields
    ))


def _read_back(frame):
    return frame.select(
        "id",
        F.col("conversation_id").cast("long"),
        F.col("user_id").cast("long"),
        "message",
        "sender_type",
        F.col("timestamp").cast("timestamp_ntz"),
        "response_time",
        F.col("sentiment_score").cast("double"),
        F.round(F.aggregate("embedding_vector", F.lit(0.0), lambda a, x: a + x), 4).alias("vector_sum"),
    )


READ_BACK_SQL = with_messages(
    """SELECT id, conversation_id, user_id, message, sender_type, "timestamp", response_time, sentiment_score,
              round(list_sum(embedding::DOUBLE[]), 4) AS vector_sum
       FROM m LEFT JOIN embeddings ON vec_id = id"""
)


@query("scan_json", READ_BACK_SQL)
def _(spark, sf):
    path = fresh_folder(spark, "messages-json")
    full = _typed(messages(spark, sf, response_time=True, sentiment=True, vectors=True))
    full.write.options(**TIME_FORMATS).json(path)
    return _read_back(readers.scan_messages(spark, path, "json"))


@query("scan_csv", READ_BACK_SQL)
def _(spark, sf):
    path = fresh_folder(spark, "messages-csv")
    full = _typed(messages(spark, sf, response_time=True, sentiment=True, vectors=True))
    flat = full.withColumn("embedding_vector", F.to_json("embedding_vector"))
    flat.write.options(**TIME_FORMATS).option("header", True).option("escape", '"').csv(path)
    return _read_back(readers.scan_messages(spark, path, "csv"))


@query("scan_orc", READ_BACK_SQL)
def _(spark, sf):
    path = fresh_folder(spark, "messages-orc")
    _typed(messages(spark, sf, response_time=True, sentiment=True, vectors=True)).write.orc(path)
    return _read_back(readers.scan_messages(spark, path, "orc"))


@query("project_messages", with_messages("SELECT conversation_id, user_id, message, sender_type, \"timestamp\", message_type FROM v"))
def _(spark, sf):
    return filters.project(messages(spark, sf), "log")


@query(
    "project_vectors",
    with_messages(
        "SELECT id, conversation_id, message, coalesce(len(embedding), 0) AS dims, \"timestamp\", sender_type"
        " FROM v LEFT JOIN embeddings ON vec_id = id"
    ),
)
def _(spark, sf):
    found = filters.project(messages(spark, sf, vectors=True), "vectors")
    dims = F.coalesce(F.size("embedding_vector"), F.lit(0)).cast("long").alias("dims")
    return found.select("id", "conversation_id", "message", dims, "timestamp", "sender_type")


@query("project_summary", with_messages('SELECT message, sender_type, "timestamp", sentiment FROM m'))
def _(spark, sf):
    return filters.project(messages(spark, sf, sentiment=True), "summary")


@query("message_preview", with_messages("SELECT id, left(message, 100) AS message_preview FROM v"))
def _(spark, sf):
    return filters.message_preview(messages(spark, sf)).select("id", "message_preview")


@query("filter_date_range", with_messages(f"SELECT id, \"timestamp\" FROM v WHERE {RANGE}"))
def _(spark, sf):
    return filters.date_range(messages(spark, sf), START, END).select("id", "timestamp")


@query(
    "filter_date_range_zoned",
    with_messages(
        "SELECT id, \"timestamp\" FROM v WHERE CAST(\"timestamp\" + INTERVAL 7 HOURS AS DATE)"
        " BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'"
    ),
)
def _(spark, sf):
    return filters.date_range(messages(spark, sf), START, END, "Asia/Bangkok").select("id", "timestamp")


@query("filter_day", with_messages("SELECT id FROM v WHERE CAST(\"timestamp\" AS DATE) = DATE '2024-01-05'"))
def _(spark, sf):
    return filters.one_day(messages(spark, sf), START).select("id")


@query("filter_trailing_days", with_messages("SELECT id FROM v WHERE \"timestamp\" >= DATE '2024-01-15' - 7"))
def _(spark, sf):
    return filters.last_days(messages(spark, sf), AS_OF, 7).select("id")


@query(
    "filter_optional",
    """WITH e AS (SELECT event_id, user_id, ts, event_type FROM events)
       SELECT event_id, user_id, 'user' AS given FROM e WHERE user_id = 8
       UNION ALL SELECT event_id, user_id, 'day' FROM e WHERE CAST(ts AS DATE) = DATE '2024-01-05'
       UNION ALL SELECT event_id, user_id, 'both' FROM e WHERE user_id = 8 AND CAST(ts AS DATE) = DATE '2024-01-05'
       UNION ALL SELECT event_id, user_id, 'none' FROM e""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("ts", "timestamp")
    cases = {"user": {"user_id": 8}, "day": {"day": START}, "both": {"user_id": 8, "day": START}, "none": {}}
    out = None
    for name, given in cases.items():
        part = filters.optional(rows, **given).select("event_id", "user_id", F.lit(name).alias("given"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "filter_null_state",
    with_messages(
        "SELECT id, sentiment FROM m WHERE sentiment IS NOT NULL AND response_time IS NOT NULL"
        " UNION ALL SELECT id, sentiment FROM m WHERE processed_at IS NULL"
    ),
)
def _(spark, sf):
    rows = messages(spark, sf, response_time=True, sentiment=True)
    done = filters.null_state(rows, present=("sentiment", "response_time"))
    waiting = filters.null_state(rows, absent=("processed_at",))
    return done.select("id", "sentiment").unionByName(waiting.select("id", "sentiment"))


@query("filter_sender", with_messages("SELECT id, sender_type FROM v WHERE sender_type = 'customer'"))
def _(spark, sf):
    return filters.sender(messages(spark, sf), "customer").select("id", "sender_type")


@query("filter_response_cap", with_messages(f"SELECT id, response_time FROM v WHERE response_time <= {CAP}"))
def _(spark, sf):
    return filters.response_cap(messages(spark, sf, response_time=True), CAP).select("id", "response_time")


@query(
    "validate_messages",
    """SELECT rule, count(*) AS "rows" FROM (
         SELECT unnest(list_filter([
           CASE WHEN d.text IS NULL THEN 'message_missing' END,
           CASE WHEN length(d.text) > 4000 THEN 'message_too_long' END,
           CASE WHEN d.lang NOT IN ('text','image','video','audio','file','sticker','location')
                THEN 'message_type_unknown' END,
           CASE WHEN l.quality IS NULL THEN 'sender_type_missing' END,
           CASE WHEN l.quality NOT IN (1) THEN 'sender_type_unknown' END], lambda x: x IS NOT NULL)) AS rule
         FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY rule""",
)
def _(spark, sf):
    # documents as ill-formed messages: long texts, types outside the domain, missing senders
    labels = table(spark, sf, "labels")
    kind = F.when(F.col("quality") == 1, "customer").otherwise(F.col("quality").cast("string"))
    rows = table(spark, sf, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("conversation_id"),
        F.col("source").alias("user_id"),
        F.col("text").alias("message"),
        F.col("lang").alias("message_type"),
        kind.alias("sender_type"),
    )
    return quality.violation_counts(rows)


@query("pseudonymise_users", with_messages(f"SELECT id, sha256('{SALT}' || CAST(user_id AS VARCHAR)) AS user_id FROM v"))
def _(spark, sf):
    return quality.pseudonymise_users(messages(spark, sf), SALT).select("id", "user_id")


# -- newest first ---------------------------------------------------------------------------

NEWEST = 'ORDER BY "timestamp" DESC, id DESC LIMIT'


@query(
    "recent_messages",
    with_messages(
        "SELECT conversation_id, user_id, left(message, 100) AS message_preview, sender_type, \"timestamp\", message_type"
        f" FROM (SELECT * FROM v {NEWEST} 10)"
    ),
)
def _(spark, sf):
    return filters.recent_messages(messages(spark, sf), 10)


@query(
    "filtered_messages",
    with_messages(
        'SELECT conversation_id, user_id, message, sender_type, "timestamp", message_type FROM ('
        f"SELECT * FROM v WHERE CAST(\"timestamp\" AS DATE) = DATE '2024-01-11' {NEWEST} 20)"
    ),
)
def _(spark, sf):
    return filters.filtered_messages(messages(spark, sf), day=END, limit=20)


@query(
    "context_messages",
    with_messages(
        'SELECT conversation_id, user_id, message, sender_type, "timestamp", sentiment'
        f" FROM (SELECT * FROM m {NEWEST} 100)"
    ),
)
def _(spark, sf):
    return filters.context_messages(messages(spark, sf, sentiment=True), 100)


@query(
    "latest_customer_messages",
    with_messages(f"SELECT id, message FROM (SELECT * FROM v WHERE sender_type = 'customer' {NEWEST} 100)"),
)
def _(spark, sf):
    return filters.latest_customer_messages(messages(spark, sf), 100).select("id", "message")


@query(
    "unprocessed_messages",
    with_messages(
        "SELECT id, message FROM (SELECT * FROM m WHERE sender_type = 'customer' AND processed_at IS NULL"
        f" {NEWEST} 50)"
    ),
)
def _(spark, sf):
    return filters.unprocessed_messages(messages(spark, sf, sentiment=True), 50).select("id", "message")


@query("ordered_transcript", with_messages('SELECT conversation_id, "timestamp", id, sender_type, message FROM v'))
def _(spark, sf):
    rows = messages(spark, sf).select("conversation_id", "timestamp", "id", "sender_type", "message")
    return filters.ordered_transcript(rows)


# -- windows ---------------------------------------------------------------------------------


@query(
    "topn_per_group",
    """SELECT user_id, event_id, CAST(rank AS INT) AS rank FROM (
         SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
         FROM events) WHERE rank <= 3""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    top = first_rows(rows, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3)
    return top.select("user_id", "event_id", "rank")


_LOGINS = (
    "SELECT event_id AS id, user_id, ts, epoch_us(ts) AS us, event_type = 'signup' AS ok"
    " FROM events WHERE event_type IN ('error', 'signup')"
)


def _lockout_sql(failures: int, micros: int, source: str = _LOGINS) -> str:
    return f"""WITH a AS ({source}),
    s AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY us, id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM a),
    f AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id, streak ORDER BY us
                   RANGE BETWEEN {micros - 1} PRECEDING AND CURRENT ROW) AS failures FROM s)
    SELECT id, user_id, ts, failures, failures >= {failures} AS locked FROM f WHERE NOT ok"""


def _attempts(spark, sf):
    rows = table(spark, sf, "events").filter(F.col("event_type").isin("error", "signup"))
    return rows.select(
        F.col("event_id").alias("id"), "user_id", "ts", (F.col("event_type") == "signup").alias("ok")
    )


@query("failed_login_lockout", _lockout_sql(5, 900_000_000))
def _(spark, sf):
    return lockout.failure_lockout(_attempts(spark, sf), "user_id")


@query("failed_login_lockout_day", _lockout_sql(3, 86_400_000_000))
def _(spark, sf):
    from datetime import timedelta

    return lockout.failure_lockout(_attempts(spark, sf), "user_id", 3, timedelta(days=1))


_BUSY = "SELECT event_id AS id, 0 AS user_id, ts, epoch_us(ts) AS us, event_type = 'signup' AS ok FROM events"


@query("failed_login_lockout_busy", _lockout_sql(5, 900_000_000, _BUSY))
def _(spark, sf):
    """All events as attempts of one key, which the default rule does lock."""
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit(0).alias("user_id"), "ts", (F.col("event_type") == "signup").alias("ok")
    )
    return lockout.failure_lockout(rows, "user_id")


# -- row-level time columns -----------------------------------------------------------------


@query(
    "response_band_rows",
    with_messages(
        "SELECT id, CASE WHEN response_time <= 300 THEN 'good' WHEN response_time <= 900 THEN 'acceptable'"
        " WHEN response_time <= 1800 THEN 'poor' WHEN response_time IS NOT NULL THEN 'beyond' END AS band FROM v"
    ),
)
def _(spark, sf):
    rows = messages(spark, sf, response_time=True)
    return rows.select("id", response_band(F.col("response_time")).alias("band"))


@query(
    "business_hours_events",
    """SELECT hour(ts + INTERVAL 7 HOURS) BETWEEN 9 AND 17 AS business_hours, count(*) AS events
       FROM events GROUP BY 1""",
)
def _(spark, sf):
    rows = table(spark, sf, "events")
    return rows.groupBy(in_business_hours(rows, "ts").alias("business_hours")).agg(F.count("*").alias("events"))
