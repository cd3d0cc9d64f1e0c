"""Keyword scoring, topics, intents, replies and text cleaning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from parley.functions import cleaning, lexical
from parley.lexicons import (
    INTENTS,
    PROBE_INTENTS,
    PROBE_REPLIES,
    PROBE_SENTIMENT,
    PROBE_TOPICS,
    REPLIES,
    REPLY_CATEGORIES,
    SENTIMENT,
    TOPICS,
)
from parley.operators import lexicon_table, states, topics
from parley.operators.mutations import upsert
from parley.plans.oracle import (
    hits,
    lexicon_values,
    ranked_labels,
    scored,
    text_literal,
    topics_of_messages,
    with_messages,
)
from parley.plans.registry import query
from parley.session import fresh_folder
from parley.sources.fixtures import messages, table
from parley.sources.sinks import replace_table

NOW = datetime(2024, 1, 15)


def _sentiment_sql(source: str, key: str, text: str, lexicon) -> str:
    return (
        f"SELECT {key}, CAST(p AS INT) AS positive_hits, CAST(n AS INT) AS negative_hits, label AS sentiment,"
        f" score AS sentiment_score, abs(score) AS sentiment_confidence FROM ({scored(source, text, lexicon)})"
    )


@query("score_sentiment", with_messages(_sentiment_sql("v", "id", "message", PROBE_SENTIMENT)))
def _(spark, sf):
    rows = messages(spark, sf).select("id", "message")
    return lexical.score_sentiment(rows, lexicon=PROBE_SENTIMENT, with_counts=True).drop("message")


@query("score_sentiment_default", with_messages(_sentiment_sql("v", "id", "message", SENTIMENT)))
def _(spark, sf):
    rows = messages(spark, sf).select("id", "message")
    return lexical.score_sentiment(rows, with_counts=True).drop("message")


@query("score_sentiment_documents", _sentiment_sql("documents", "doc_id", "text", SENTIMENT))
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return lexical.score_sentiment(rows, "text", with_counts=True).drop("text")


def _labels_sql(source, key, text, lexicon, factor, name):
    return (
        f"SELECT {key}, CAST(rank AS INT) AS rank, label AS {name}, round(confidence, 6) AS confidence,"
        f" CAST(hits AS INT) AS hits FROM ({ranked_labels(source, key, text, lexicon, factor)})"
    )


def _rounded(frame):
    return frame.withColumn("confidence", F.round("confidence", 6))


@query("classify_topics", with_messages(_labels_sql("v", "id", "message", PROBE_TOPICS, 2, "topic")))
def _(spark, sf):
    rows = messages(spark, sf).select("id", "message")
    labelled = lexical.classify_topics(rows, lexicon=PROBE_TOPICS).drop("message")
    return _rounded(lexical.explode_labels(labelled, "topics"))


@query("classify_topics_documents", _labels_sql("documents", "doc_id", "text", PROBE_TOPICS, 2, "topic"))
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    labelled = lexical.classify_topics(rows, "text", PROBE_TOPICS).drop("text")
    return _rounded(lexical.explode_labels(labelled, "topics"))


@query("lexicon_match", with_messages(
    "SELECT id, 'topics' AS lexicon, label, CAST(label_order AS INT) AS label_order, keyword,"
    f" CAST(label_size AS INT) AS label_size FROM v, {lexicon_values(PROBE_TOPICS)} WHERE contains(lower(message), keyword)"
))
def _(spark, sf):
    rows = messages(spark, sf).select("id", "message")
    return lexical.match_lexicon(rows, "message", "topics", PROBE_TOPICS)


#: Every long word of the documents as a keyword, its first letter as the label.
_WORD_LIST = """SELECT DISTINCT word AS keyword, left(word, 1) AS label, ascii(word) - 96 AS label_order
   FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{4,}')) AS word FROM documents)"""


@query("lexicon_match_table", with_messages(
    f""", k AS ({_WORD_LIST}), z AS (SELECT label, count(*) AS label_size FROM k GROUP BY label)
    SELECT id, label, CAST(label_order AS INT) AS label_order, keyword, CAST(label_size AS INT) AS label_size
    FROM v JOIN k ON contains(lower(message), keyword) JOIN z USING (label)"""
))
def _(spark, sf):
    found = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), F.lit(0))).alias("keyword"))
    lexicon = found.distinct().select("keyword", F.left("keyword", F.lit(1)).alias("label"), (F.ascii("keyword") - 96).alias("label_order"))
    return lexicon_table.match_lexicon_table(messages(spark, sf).select("id", "message"), lexicon)


@query("lexicon_match_words", with_messages(
    f"SELECT id, label, keyword FROM v, {lexicon_values(PROBE_TOPICS)}"
    " WHERE regexp_matches(lower(message), '(^|[^\\p{L}\\p{M}\\p{Nd}_])' || keyword || '($|[^\\p{L}\\p{M}\\p{Nd}_])')"
))
def _(spark, sf):
    rows = messages(spark, sf).select("id", "message")
    found = lexical.match_lexicon(rows, "message", "topics", PROBE_TOPICS, match="word")
    return found.select("id", "label", "keyword")


def _intent_sql(source, key, text, lexicon):
    ranked = ranked_labels(source, key, text, lexicon, 1)
    return (
        f"SELECT s.{key}, coalesce(max(r.label) FILTER (WHERE r.rank = 1), 'general') AS primary_intent,"
        " coalesce(string_agg(r.label || ':' || CAST(r.hits AS VARCHAR), ' ' ORDER BY r.rank), '') AS intents"
        f" FROM {source} s LEFT JOIN ({ranked}) r ON r.{key} = s.{key} GROUP BY s.{key}"
    )


def _intents(frame, key):
    listed = F.transform("intents", lambda i: F.concat(i["label"], F.lit(":"), i["hits"].cast("string")))
    return frame.select(key, "primary_intent", F.array_join(listed, " ").alias("intents"))


@query("classify_intent", with_messages(_intent_sql("v", "id", "message", PROBE_INTENTS)))
def _(spark, sf):
    rows = messages(spark, sf).select("id", "message")
    return _intents(lexical.classify_intent(rows, lexicon=PROBE_INTENTS), "id")


@query("classify_intent_documents", _intent_sql("documents", "doc_id", "text", PROBE_INTENTS))
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return _intents(lexical.classify_intent(rows, "text", PROBE_INTENTS), "doc_id")


def _category_sql(text, categories):
    cases = " ".join(f"WHEN {hits(text, keywords)} > 0 THEN '{label}'" for label, keywords in categories.items())
    return f"CASE {cases} ELSE 'general' END"


_REPLY_ROWS = ", ".join(
    f"('{category}', {rank}, {text_literal(reply)}, {confidence}::DOUBLE)"
    for category, options in REPLIES.items()
    for rank, (reply, confidence) in enumerate(options, 1)
)
_REPLY_VALUES = f"(VALUES {_REPLY_ROWS}) AS r(category, rank, reply, confidence)"


def _replies_sql(source, key, text, categories):
    return (
        f"SELECT {key}, category, CAST(rank AS INT) AS rank, reply, confidence FROM ("
        f"SELECT {key}, {_category_sql(text, categories)} AS category FROM {source}) JOIN {_REPLY_VALUES} USING (category)"
    )


@query("suggest_replies", with_messages(_replies_sql("(SELECT * FROM v WHERE sender_type = 'customer')", "id", "message", PROBE_REPLIES)))
def _(spark, sf):
    rows = messages(spark, sf).filter(F.col("sender_type") == "customer").select("id", "message")
    return lexical.suggest_replies(rows, categories=PROBE_REPLIES).drop("message")


@query("suggest_replies_documents", _replies_sql("documents", "doc_id", "text", REPLY_CATEGORIES))
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text")
    return lexical.suggest_replies(rows, "text").drop("text")


@query(
    "auto_reply_gate",
    with_messages(
        "SELECT id, category, reply, confidence, true AS is_auto, TIMESTAMP '2024-01-15 00:00:00' AS replied_at FROM ("
        + _replies_sql("(SELECT * FROM v WHERE sender_type = 'customer')", "id", "message", PROBE_REPLIES)
        + ") WHERE rank = 1 AND confidence >= 0.8"
    ),
)
def _(spark, sf):
    rows = messages(spark, sf).filter(F.col("sender_type") == "customer").select("id", "message")
    replied = lexical.auto_reply(rows, NOW, categories=PROBE_REPLIES).drop("message")
    return replied.withColumn("replied_at", F.col("replied_at").cast("timestamp_ntz"))


# -- topic totals ----------------------------------------------------------------------------


def _frequency(limit=None, top=None):
    order = "ORDER BY frequency DESC, seen DESC" + (f" LIMIT {top}" if top else "")
    return with_messages(
        topics_of_messages(limit)
        + """ SELECT topic, frequency, messages FROM (
              SELECT label AS topic, round(sum(confidence), 6) AS frequency, count(*) AS messages,
                     max({'ts': "timestamp", 'id': id, 'r': -rank}) AS seen FROM t GROUP BY label) """
        + order
    )


@query("topic_frequency", _frequency())
def _(spark, sf):
    return topics.topic_frequency(messages(spark, sf), PROBE_TOPICS)


@query("topic_frequency_newest", _frequency(limit=100))
def _(spark, sf):
    return topics.topic_frequency(messages(spark, sf), PROBE_TOPICS, limit=100)


@query("top_topics", _frequency(top=2))
def _(spark, sf):
    return topics.top_topics(messages(spark, sf), 2, PROBE_TOPICS)


@query(
    "topic_examples",
    with_messages(
        topics_of_messages()
        + """ SELECT label AS topic, CAST(place AS INT) AS rank, id, message FROM (
              SELECT *, row_number() OVER (PARTITION BY label ORDER BY "timestamp" DESC, id DESC) AS place FROM t)
              WHERE place <= 5"""
    ),
)
def _(spark, sf):
    found = topics.topic_examples(messages(spark, sf), PROBE_TOPICS)
    return found.select("topic", "rank", "id", "message")


@query(
    "topic_example_lists",
    with_messages(
        topics_of_messages()
        + """ SELECT label AS topic, string_agg(message, ' | ' ORDER BY place) AS examples FROM (
              SELECT *, row_number() OVER (PARTITION BY label ORDER BY "timestamp" DESC, id DESC) AS place FROM t)
              WHERE place <= 3 GROUP BY label"""
    ),
)
def _(spark, sf):
    lists = topics.topic_example_lists(messages(spark, sf), PROBE_TOPICS, 3)
    return lists.select("topic", F.array_join("examples", " | ").alias("examples"))


TOP_TOPICS = """ SELECT conversation_id, CAST(place AS INT) AS rank, topic, "count" FROM (
      SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY "count" DESC, seen) AS place FROM (
        SELECT conversation_id, label AS topic, count(*) AS "count",
               min({'ts': "timestamp", 'id': id, 'r': rank}) AS seen FROM t GROUP BY 1, 2)) WHERE place <= 3"""


@query("conversation_top_topics", with_messages(topics_of_messages() + TOP_TOPICS))
def _(spark, sf):
    return topics.conversation_top_topics(messages(spark, sf), PROBE_TOPICS)


TOPICS_TABLE = with_messages(
        f""", h AS (SELECT m.id, label, keyword FROM m, {lexicon_values(PROBE_TOPICS)}
                 WHERE sender_type = 'customer' AND contains(lower(message), keyword)),
        d AS (SELECT label, count(DISTINCT id) AS frequency, string_agg(DISTINCT keyword, ' ' ORDER BY keyword) AS keywords
              FROM h GROUP BY label),
        x AS (SELECT g.label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
              FROM (SELECT DISTINCT id, label FROM h) g JOIN embeddings ON vec_id = g.id),
        e AS (SELECT label, pos, avg(x::DOUBLE) AS x FROM x GROUP BY label, pos)
        SELECT d.label AS topic_name, frequency, keywords, CAST(pos AS INT) AS pos, round(x, 5) AS x,
               TIMESTAMP '2024-01-15 00:00:00' AS updated_at
        FROM d JOIN e USING (label)"""
    )


def _opened(found):
    return found.select(
        "topic_name",
        "frequency",
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.array_join("topic_keywords", " ").alias("keywords"),
        F.posexplode("embedding_vector").alias("pos", "x"),
    ).select(
        "topic_name", "frequency", "keywords", (F.col("pos") + 1).alias("pos"), F.round("x", 5).alias("x"), "updated_at"
    )


@query("topics_table", TOPICS_TABLE)
def _(spark, sf):
    rows, path = messages(spark, sf, vectors=True), fresh_folder(spark, "topics")
    # the dictionary as of an earlier day, then brought up to date on its key
    replace_table(topics.topics_table(rows.where(F.col("id") % 2 == 0), 64, PROBE_TOPICS, datetime(2024, 1, 10)), path)
    fresh = topics.topics_table(rows, 64, PROBE_TOPICS, datetime(2024, 1, 15))
    replace_table(upsert(spark.read.schema(fresh.schema).parquet(path), fresh, ["topic_name"]), path)
    return _opened(spark.read.schema(fresh.schema).parquet(path))


@query("topics_table_incremental", TOPICS_TABLE)
def _(spark, sf):
    rows = messages(spark, sf, vectors=True)
    follower = states.TopicFollower(fresh_folder(spark, "followed"), rows, 64, PROBE_TOPICS)
    for part in (2, 0, 1):
        follower.arrive(rows.where(F.col("id") % 3 == part), f"part{part}")
    follower.states.compact()
    follower.arrive(rows.where(F.col("id") % 3 == 0), "part0")
    return _opened(follower.table(datetime(2024, 1, 15)))


# -- cleaning --------------------------------------------------------------------------------

# Unicode white space, as the SQL engine's regular expressions have no name for it
_SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PROBE_LABELS = ("The:", "The", "Le")
PROBE_OPENERS = ("Is", "La", "Die")


def _cleaned_sql(text: str, labels, openers) -> str:
    body = text
    for label in labels:
        body = f"regexp_replace({body}, '(?m)^{_SPACE}*{label}{_SPACE}*', '', 'g')"
    starts = " OR ".join(f"starts_with(body, '{o}')" for o in openers)
    return (
        f"SELECT doc_id, regexp_replace(regexp_replace(short, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS reply FROM ("
        " SELECT doc_id, CASE WHEN length(polite) > 2000 THEN left(polite, 1950) || "
        f"{text_literal(cleaning.REPLY_NOTICE)} ELSE polite END AS short FROM ("
        f" SELECT doc_id, CASE WHEN {starts} THEN body ELSE {text_literal(cleaning.REPLY_PREFIX)} || body END AS polite FROM ("
        f" SELECT doc_id, {body} AS body FROM documents)))"
    )


@query("clean_reply", _cleaned_sql("text", PROBE_LABELS, PROBE_OPENERS))
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("reply"))
    return cleaning.clean_reply(rows, labels=PROBE_LABELS, openers=PROBE_OPENERS)


PROBE_MARKS = (("The", "📊 The"), ("Die", "😊 Die"), ("<p>", "• <p>"))


def _markup_sql(key, text, source):
    out = f"regexp_replace({text}, '\\*\\*(.*?)\\*\\*', '<strong>\\1</strong>', 'g')"
    out = f"regexp_replace({out}, '\\*(.*?)\\*', '<em>\\1</em>', 'g')"
    out = f"regexp_replace({out}, '(?m)^\\p{{Nd}}+\\.{_SPACE}+', '• ', 'g')"
    out = f"regexp_replace({out}, '(?m)^-{_SPACE}+', '• ', 'g')"
    for term, mark in PROBE_MARKS:
        out = f"replace({out}, {text_literal(term)}, {text_literal(mark)})"
    return f"SELECT {key}, {out} AS shown FROM {source}"


@query("display_markup", _markup_sql("page_id", "html", "pages"))
def _(spark, sf):
    shown = cleaning.display_markup(F.col("html"), PROBE_MARKS)
    return table(spark, sf, "pages").select("page_id", shown.alias("shown"))


@query("display_markup_documents", _markup_sql("doc_id", "text", "documents"))
def _(spark, sf):
    shown = cleaning.display_markup(F.col("text"), PROBE_MARKS)
    return table(spark, sf, "documents").select("doc_id", shown.alias("shown"))
