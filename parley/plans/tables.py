"""Keyed writes, stored results and exports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parley.operators import metrics, mutations
from parley.plans.metrics import DAILY
from parley.plans.oracle import with_messages
from parley.plans.registry import query
from parley.plans.rows import END, START
from parley.session import fresh_folder
from parley.sources.fixtures import messages, table
from parley.sources.readers import scan_messages
from parley.sources.sinks import (
    cached,
    clean_results,
    expire_days,
    export_rows,
    load_result,
    patch_days,
    upsert_days,
    write_by_date,
)

NOW = datetime(2024, 1, 15)


def _now():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


def _stored(rows, time, label):
    """The rows as a table partitioned by day, and how to read it."""
    path = fresh_folder(rows.sparkSession, label)
    dated = rows.withColumn("day", F.to_date(time))
    write_by_date(dated, path, "day")
    return path, lambda: rows.sparkSession.read.schema(dated.schema).parquet(path)


def _document_messages(spark, sf):
    """Every document as an incoming message without type, time and metadata."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("conversation_id"),
        F.col("n_chars").alias("user_id"),
        F.col("text").alias("message"),
        F.lit("customer").alias("sender_type"),
    )


NEW_ROWS = (
    "SELECT doc_id AS id, doc_id AS conversation_id, n_chars AS user_id, text AS message, 'text' AS message_type,"
    " 'customer' AS sender_type, TIMESTAMP '2024-01-15 00:00:00' AS \"timestamp\", '{}' AS metadata FROM documents"
)
OLD_ROWS = 'SELECT id, conversation_id, user_id, message, message_type, sender_type, "timestamp", metadata FROM v'


@query("append_messages", with_messages(f"{OLD_ROWS} UNION ALL {NEW_ROWS}"))
def _(spark, sf):
    path = fresh_folder(spark, "appended")
    base = messages(spark, sf)
    base.write.parquet(path)
    rows = mutations.with_defaults(_document_messages(spark, sf), _now())
    rows.select(*base.columns).write.mode("append").parquet(path)
    return spark.read.schema(base.schema).parquet(path)


@query("insert_ignore", with_messages(f"{OLD_ROWS} UNION ALL SELECT * FROM ({NEW_ROWS}) WHERE id NOT IN (SELECT id FROM v)"))
def _(spark, sf):
    rows = mutations.with_defaults(_document_messages(spark, sf), _now())
    return mutations.insert_ignore(messages(spark, sf), rows, ["id"])


@query(
    "upsert_by_key",
    """WITH k AS (SELECT conv_id AS user_id, count(*)::DOUBLE AS value, TIMESTAMP '2024-01-01 00:00:00' AS ts
                  FROM conversations GROUP BY conv_id),
       e AS (SELECT user_id, value, ts FROM (
               SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)
       SELECT * FROM e UNION ALL SELECT * FROM k WHERE user_id NOT IN (SELECT user_id FROM e)""",
)
def _(spark, sf):
    # settings-like table: one value per key, overwritten by the last event of the key
    stored = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(
        F.count("*").cast("double").alias("value"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
    )
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "ts", F.to_date("ts").alias("day"))
    path, read = _stored(stored, "ts", "settings")
    upsert_days(path, read(), events, ["user_id"], ["ts", "event_id"])
    return read().drop("day")


@query(
    "patch_columns",
    with_messages(
        "SELECT m.id, CASE WHEN m.sentiment IS NULL THEN s.label ELSE m.sentiment END AS sentiment,"
        " CASE WHEN m.sentiment IS NULL THEN s.score ELSE m.sentiment_score END AS sentiment_score,"
        " CASE WHEN m.sentiment IS NULL THEN TIMESTAMP '2024-01-15 00:00:00' ELSE m.processed_at END AS processed_at"
        " FROM m JOIN s ON s.id = m.id"
    ),
)
def _(spark, sf):
    from parley.functions.lexical import score_sentiment
    from parley.lexicons import PROBE_SENTIMENT

    rows = messages(spark, sf, sentiment=True)
    path, read = _stored(rows, "timestamp", "patched")
    waiting = rows.filter(F.col("processed_at").isNull()).select("id", "message")
    patches = score_sentiment(waiting, lexicon=PROBE_SENTIMENT)
    patch_days(path, read(), patches, ["sentiment", "sentiment_score"], _now())
    return read().select("id", "sentiment", "sentiment_score", "processed_at")


@query(
    "patch_vectors",
    with_messages(
        "SELECT id, coalesce(len(embedding), 0) AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total,"
        " CASE WHEN embedding IS NOT NULL THEN TIMESTAMP '2024-01-15 00:00:00' ELSE processed_at END AS processed_at"
        " FROM m LEFT JOIN embeddings ON vec_id = id"
    ),
)
def _(spark, sf):
    rows = messages(spark, sf, sentiment=True).withColumn("embedding_vector", F.lit(None).cast("array<double>"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embedding_vector"))
    patched = mutations.patch_columns(rows, vectors, ["embedding_vector"], _now())
    total = F.aggregate("embedding_vector", F.lit(0.0), lambda a, x: a + x)
    return patched.select(
        "id",
        F.coalesce(F.size("embedding_vector"), F.lit(0)).cast("long").alias("dims"),
        F.round(total, 4).alias("total"),
        "processed_at",
    )


@query(
    "key_patch_joins",
    """SELECT doc_id, quality, 'left' AS kind FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT doc_id, NULL, 'anti' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT coalesce(d.doc_id, e.vec_id), e.label, 'full' FROM documents d
                 FULL JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def _(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("quality"))
    left = documents.join(labels, "doc_id", "left").withColumn("kind", F.lit("left"))
    anti = mutations.absent_rows(labels, documents, ["doc_id"]).select(
        "doc_id", F.lit(None).cast("int").alias("quality"), F.lit("anti").alias("kind")
    )
    full = documents.join(vectors, "doc_id", "full").withColumn("kind", F.lit("full"))
    return left.unionByName(anti).unionByName(full)


@query(
    "expire_rows",
    """WITH c AS (SELECT event_id, date_trunc('day', ts) + INTERVAL 7 DAYS AS expires_at FROM events)
       SELECT event_id, expires_at, 'live' AS kind FROM c WHERE expires_at > TIMESTAMP '2024-01-15 00:00:00'
       UNION ALL SELECT event_id, expires_at, 'kept' FROM c WHERE expires_at >= TIMESTAMP '2024-01-15 00:00:00'""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        (F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
    )
    live = mutations.live_rows(rows, _now()).withColumn("kind", F.lit("live"))
    path, read = _stored(rows, "expires_at", "expiring")
    expire_days(path, read(), _now())
    return live.unionByName(read().drop("day").withColumn("kind", F.lit("kept")))


@query("materialize_result", with_messages(DAILY))
def _(spark, sf):
    base = fresh_folder(spark, "results")
    daily = metrics.daily_conversations(messages(spark, sf), START, END)
    # another result of nearly the same name, and one that has expired
    cached(daily.limit(1), base, "daily-conversations", NOW)
    cached(daily.limit(2), base, "daily_conversations", NOW - timedelta(days=1))
    cached(daily, base, "daily_conversations", NOW)
    clean_results(spark, base, NOW)
    return load_result(spark, base, "daily_conversations", NOW)


EXPORT = with_messages(OLD_ROWS)


def _exported(spark, sf, fmt, limit=None):
    path = fresh_folder(spark, f"export-{fmt}")
    rows = messages(spark, sf)
    export_rows(rows, path, fmt, F.col("timestamp").desc(), F.col("id").desc(), limit=limit)
    return scan_messages(spark, path, fmt, rows.schema)


@query("export_rows_limited", with_messages(OLD_ROWS + ' ORDER BY "timestamp" DESC, id DESC LIMIT 100'))
def _(spark, sf):
    return _exported(spark, sf, "json", 100)


@query("export_rows", EXPORT)
def _(spark, sf):
    return _exported(spark, sf, "csv")


@query("export_json", EXPORT)
def _(spark, sf):
    return _exported(spark, sf, "json")
