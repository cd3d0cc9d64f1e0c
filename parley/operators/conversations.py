"""Per-conversation results: summaries, transcripts, prompts and response times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.lexical import satisfaction_score
from parley.functions.timing import epoch_micros, moment
from parley.lexicons import TOPICS, Lexicon
from parley.operators.filters import newest
from parley.operators.slices import first_rows, previous_in_order, previous_row
from parley.operators.topics import conversation_topics, first_topics, merged_conversation_topics
from parley.schema import CONVERSATION_STATES, SENTIMENTS

DIGITS = 6

# Line formats and lengths of the digests.
DIGEST_LINES = 10
DIGEST_CHARS = 100
DIGEST_FORMAT = "%d. [%s] %s (%s): %s [ความรู้สึก: %s]"
TRANSCRIPT_LINES = 20
TRANSCRIPT_CHARS = 150
TRANSCRIPT_FORMAT = "%d. [%s] %s (ความรู้สึก: %s)"
MISSING = "None"

# Wording of the prompts: our own, replaceable.
ASSISTANT_INSTRUCTION = (
    "You help the operators of a customer chat channel. Use only the messages below; "
    "say so when they are not enough to answer."
)
REVIEW_INSTRUCTION = (
    "Review this conversation: overall mood of the customer, what they care about, "
    "how well they were answered, what to improve."
)


def derive_response_time(messages: DataFrame, slice_unit: str | None = None) -> DataFrame:
    """Seconds from a customer message to the admin message right after it, else NULL.

    Messages are looked back over in ranges of (conversation, time, id): one scan, and a conversation of any size or density is
    cut as it needs (``previous_in_order``). With a ``slice_unit`` (``hour``, ``minute``, ...) the look-back stays lazy and in
    built-in functions: conversations are cut into slices of time, the busier the finer the unit should be.
    """
    kept = [c for c in messages.columns if c != "response_time"]
    carry = {"_asked": F.col("sender_type") == "customer", "_asked_ts": F.col("timestamp")}
    keys, order = ["conversation_id"], ["timestamp", "id"]
    if slice_unit is None:
        looked = previous_in_order(messages.select(*kept), keys, order, carry)
    else:
        place = F.date_trunc(slice_unit, F.col("timestamp").cast("timestamp"))
        looked = previous_row(messages.select(*kept), keys, order, moment(F.col("timestamp"), F.col("id")), place, carry)
    gap = epoch_micros(F.col("timestamp")) - epoch_micros(F.col("_asked_ts"))
    answered = (F.col("sender_type") == "admin") & F.col("_asked")
    seconds = F.when(answered, F.floor(gap / 1_000_000).cast("int"))
    return looked.select(*kept, seconds.alias("response_time"))


def _sentiment_counts() -> list[Column]:
    return [F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS]


def _duration_minutes() -> Column:
    micros = epoch_micros(F.col("end_time")) - epoch_micros(F.col("start_time"))
    return F.round(micros / 60e6, DIGITS)


def conversation_summary(messages: DataFrame) -> DataFrame:
    """Message counts, start, end, duration and response time of every conversation."""
    grouped = messages.groupBy("conversation_id").agg(
        F.count("*").alias("total_messages"),
        F.count_if(F.col("sender_type") == "customer").alias("customer_messages"),
        F.count_if(F.col("sender_type") == "admin").alias("admin_messages"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.round(F.avg("response_time"), 2).alias("avg_response_time"),
    )
    return grouped.withColumn("duration_minutes", _duration_minutes())


def conversation_sentiments(messages: DataFrame) -> DataFrame:
    """Labelled messages per conversation, one column per label."""
    return messages.groupBy("conversation_id").agg(*_sentiment_counts())


def sentiment_map(counts: DataFrame) -> DataFrame:
    """The counts as a map without the labels that do not occur."""
    pairs = F.map_from_arrays(
        F.array(*(F.lit(s) for s in SENTIMENTS)), F.array(*(F.col(s) for s in SENTIMENTS))
    )
    return counts.select("conversation_id", F.map_filter(pairs, lambda k, v: v > 0).alias("sentiment_distribution"))


def conversation_states(messages: DataFrame) -> DataFrame:
    """What a summary is made of, per conversation and user: fixed-width, hash-aggregated in one pass, and mergeable."""
    satisfied = F.when(F.col("sentiment").isNotNull(), satisfaction_score(F.col("sentiment")))
    return messages.groupBy("conversation_id", "user_id").agg(
        F.min(moment(F.col("timestamp"), F.col("id"))).alias("_opened"),
        F.min("timestamp").alias("_start"),
        F.max("timestamp").alias("_end"),
        F.count("*").alias("_messages"),
        F.count_if(F.col("sender_type") == "customer").alias("_customer"),
        F.count_if(F.col("sender_type") == "admin").alias("_admin"),
        F.sum(F.col("response_time").cast("long")).alias("_seconds"),
        F.count("response_time").alias("_answers"),
        F.sum(satisfied).alias("_satisfied"),
        F.count(satisfied).alias("_scored"),
        *_sentiment_counts(),
    )


def merged_conversations(states: DataFrame) -> DataFrame:
    """One state per conversation and user from the states of any number of arrivals."""
    sums = ("_messages", "_customer", "_admin", "_seconds", "_answers", "_satisfied", "_scored", *SENTIMENTS)
    return states.groupBy("conversation_id", "user_id").agg(
        F.min("_opened").alias("_opened"), F.min("_start").alias("_start"), F.max("_end").alias("_end"),
        *(F.sum(c).alias(c) for c in sums),
    )


def full_summary(messages: DataFrame, lexicon: Lexicon = TOPICS, as_of=None) -> DataFrame:
    """The rows of the summary table, from all messages."""
    return summaries_of(conversation_states(messages), conversation_topics(messages, lexicon), as_of)


def summaries_of(states: DataFrame, topics: DataFrame, as_of=None) -> DataFrame:
    """The rows of the summary table from the states of conversations and of their topics, merged or not.

    The few rows per conversation are folded into one, whose user is that of the first message. ``summary``
    text is produced elsewhere and left NULL; a conversation nobody closed is ``active`` and not ``resolved``.
    """
    measures = states.groupBy("conversation_id").agg(
        F.min_by("user_id", "_opened").alias("user_id"),
        F.min("_start").alias("start_time"),
        F.max("_end").alias("end_time"),
        F.sum("_messages").cast("int").alias("total_messages"),
        F.sum("_customer").cast("int").alias("customer_messages"),
        F.sum("_admin").cast("int").alias("admin_messages"),
        F.round(F.try_divide(F.sum("_seconds"), F.sum("_answers")), 2).alias("avg_response_time"),
        F.round(F.try_divide(F.sum("_satisfied"), F.sum("_scored")), 2).alias("satisfaction_score"),
        *(F.sum(s).alias(s) for s in SENTIMENTS),
    )
    tags = first_topics(merged_conversation_topics(topics)).groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "topic"))).alias("_tags")
    )
    return measures.join(tags, "conversation_id", "left").select(
        "conversation_id",
        "user_id",
        "start_time",
        "end_time",
        F.to_date("start_time").alias("start_date"),
        "total_messages",
        "customer_messages",
        "admin_messages",
        _duration_minutes().alias("duration_minutes"),
        F.col("avg_response_time").cast("decimal(10,2)").alias("avg_response_time"),
        F.col("satisfaction_score").cast("decimal(3,2)").alias("satisfaction_score"),
        *SENTIMENTS,
        F.lit(None).cast("string").alias("summary"),
        F.coalesce(F.col("_tags.topic"), F.array().cast("array<string>")).alias("tags"),
        F.lit(CONVERSATION_STATES[0]).alias("status"),
        F.lit(False).alias("resolved"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
        F.lit(as_of).cast("timestamp").alias("updated_at"),
    )


def resolution_rate(summaries: DataFrame) -> DataFrame:
    """Share of resolved conversations, for inputs that carry the ``resolved`` column."""
    return summaries.agg(F.round(F.avg(F.col("resolved").cast("double")), DIGITS).alias("resolution_rate"))


def _shortened(messages: DataFrame, chars: int) -> DataFrame:
    """What a line needs, the message cut to its shown length before anything is shuffled."""
    return messages.select(
        "conversation_id",
        "id",
        "timestamp",
        "sender_type",
        "user_id",
        F.left(F.col("message"), F.lit(chars)).alias("message"),
        F.coalesce(F.col("sentiment"), F.lit(MISSING)).alias("sentiment"),
    )


def _digest_line() -> Column:
    return F.format_string(
        DIGEST_FORMAT,
        F.col("rank"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        F.col("sender_type"),
        F.col("user_id").cast("string"),
        F.col("message"),
        F.col("sentiment"),
    )


def _joined_lines(lines: DataFrame, out: str, *keys: str) -> DataFrame:
    """Lines of a group as one text; a group never holds more than the digest's lines."""
    packed = F.array_sort(F.collect_list(F.struct("rank", "line")))
    grouped = lines.groupBy(*keys).agg(packed.alias("_lines"))
    return grouped.select(*keys, F.array_join(F.col("_lines.line"), "\n").alias(out))


def context_lines(messages: DataFrame, lines: int = DIGEST_LINES) -> DataFrame:
    """Numbered lines of the newest messages of the whole table."""
    latest = newest(_shortened(messages, DIGEST_CHARS), lines)
    order = Window.partitionBy().orderBy(F.col("timestamp").desc(), F.col("id").desc())
    ranked = latest.withColumn("rank", F.row_number().over(order))
    return ranked.select("rank", _digest_line().alias("line"))


def context_digest(messages: DataFrame, lines: int = DIGEST_LINES) -> DataFrame:
    return _joined_lines(context_lines(messages, lines), "digest")


def conversation_digests(messages: DataFrame, lines: int = DIGEST_LINES) -> DataFrame:
    """The same per conversation: its newest messages, newest first."""
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    ranked = first_rows(_shortened(messages, DIGEST_CHARS), ["conversation_id"], order, lines)
    numbered = ranked.select("conversation_id", "rank", _digest_line().alias("line"))
    return _joined_lines(numbered, "digest", "conversation_id")


def conversation_transcripts(messages: DataFrame, lines: int = TRANSCRIPT_LINES) -> DataFrame:
    """The opening lines of every conversation."""
    order = [F.col("timestamp").asc(), F.col("id").asc()]
    ranked = first_rows(_shortened(messages, TRANSCRIPT_CHARS), ["conversation_id"], order, lines)
    line = F.format_string(
        TRANSCRIPT_FORMAT, F.col("rank"), F.col("sender_type"), F.col("message"), F.col("sentiment")
    )
    numbered = ranked.select("conversation_id", "rank", line.alias("line"))
    return _joined_lines(numbered, "transcript", "conversation_id")


def review_prompts(messages: DataFrame, instruction: str = REVIEW_INSTRUCTION) -> DataFrame:
    """One prompt text per conversation, the input of a batch inference job."""
    transcripts = conversation_transcripts(messages)
    text = F.concat_ws("\n\n", F.lit(instruction), F.col("transcript"))
    return transcripts.select("conversation_id", text.alias("prompt"))


def question_prompts(
    messages: DataFrame, questions: DataFrame, instruction: str = ASSISTANT_INSTRUCTION
) -> DataFrame:
    """One prompt per question: the digest of the question's conversation and the question.

    ``questions`` has ``conversation_id`` and ``question``.
    """
    digests = conversation_digests(messages)
    text = F.concat_ws(
        "\n\n", F.lit(instruction), F.col("digest"), F.concat(F.lit("Question: "), F.col("question"))
    )
    return questions.join(digests, "conversation_id").select(*questions.columns, text.alias("prompt"))
