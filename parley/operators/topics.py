"""Topic totals, examples, per-conversation topics and the topic dictionary."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.lexical import (
    TOPIC_FACTOR,
    classify_topics,
    explode_labels,
    keywords_met,
    open_array,
)
from parley.functions.timing import moment
from parley.lexicons import TOPICS, Lexicon
from parley.operators.filters import latest_customer_messages, sender
from parley.operators.slices import first_rows
from parley.schema import MAX_TOPIC_NAME

DIGITS = 6


def message_topics(messages: DataFrame, lexicon: Lexicon = TOPICS, limit: int | None = None) -> DataFrame:
    """One row per customer message and one of its topics."""
    chosen = latest_customer_messages(messages, limit)
    return explode_labels(classify_topics(chosen, "message", lexicon), "topics")


def _seen() -> Column:
    return moment(F.col("timestamp"), F.col("id")).alias("_seen")


def _size_of(lexicon: Lexicon, topic: Column) -> Column:
    chain = None
    for label, keywords in lexicon.items():
        size = F.lit(float(len(keywords)))
        chain = F.when(topic == label, size) if chain is None else chain.when(topic == label, size)
    return chain


def topic_frequency(messages: DataFrame, lexicon: Lexicon = TOPICS, limit: int | None = None) -> DataFrame:
    """Sum of confidences per topic, highest first; ties by first appearance, newest message first.

    A confidence is a whole number over the topic's size, so the whole numbers are summed and
    divided once: the total does not depend on the order in which tasks add it up.
    """
    opened = message_topics(messages, lexicon, limit)
    weight = F.least(F.col("hits") * TOPIC_FACTOR, _size_of(lexicon, F.col("topic")).cast("int"))
    totals = opened.select("topic", "rank", weight.cast("long").alias("_weight"), _seen()).groupBy("topic").agg(
        F.sum("_weight").alias("_weight"),
        F.count("*").alias("messages"),
        F.max("_seen").alias("_newest"),
        F.max_by("rank", "_seen").alias("_rank"),
    )
    frequency = F.round(F.col("_weight") / _size_of(lexicon, F.col("topic")), DIGITS)
    return (
        totals.withColumn("frequency", frequency)
        .orderBy(F.col("frequency").desc(), F.col("_newest").desc(), F.col("_rank").asc())
        .select("topic", "frequency", "messages")
    )


def top_topics(messages: DataFrame, count: int = 10, lexicon: Lexicon = TOPICS, limit: int | None = None) -> DataFrame:
    return topic_frequency(messages, lexicon, limit).limit(count)


def topic_examples(
    messages: DataFrame, lexicon: Lexicon = TOPICS, count: int = 5, limit: int | None = None
) -> DataFrame:
    """The most recent messages of every topic, newest first, one row each."""
    opened = message_topics(messages, lexicon, limit).select("topic", "id", "timestamp", "message")
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    return first_rows(opened, ["topic"], order, count)


def topic_example_lists(
    messages: DataFrame, lexicon: Lexicon = TOPICS, count: int = 5, limit: int | None = None
) -> DataFrame:
    """The same as one array per topic; it never holds more than ``count`` messages."""
    ranked = topic_examples(messages, lexicon, count, limit)
    packed = F.array_sort(F.collect_list(F.struct("rank", "message")))
    return ranked.groupBy("topic").agg(packed.alias("_rows")).select("topic", F.col("_rows.message").alias("examples"))


def conversation_topics(messages: DataFrame, lexicon: Lexicon = TOPICS) -> DataFrame:
    """How many customer messages of a conversation have a topic, and where it first appeared; mergeable."""
    opened = message_topics(messages, lexicon).select("conversation_id", "topic", "rank", _seen())
    return opened.groupBy("conversation_id", "topic").agg(
        F.count("*").alias("count"),
        F.min("_seen").alias("_oldest"),
        F.min_by("rank", "_seen").alias("_rank"),
    )


def merged_conversation_topics(states: DataFrame) -> DataFrame:
    return states.groupBy("conversation_id", "topic").agg(
        F.sum("count").alias("count"), F.min("_oldest").alias("_oldest"), F.min_by("_rank", "_oldest").alias("_rank")
    )


def first_topics(counted: DataFrame, count: int = 3) -> DataFrame:
    """The most frequent topics of each conversation; ties by first appearance, oldest message first."""
    order = [F.col("count").desc(), F.col("_oldest").asc(), F.col("_rank").asc()]
    return first_rows(counted, ["conversation_id"], order, count).select(
        "conversation_id", "rank", "topic", "count"
    )


def conversation_top_topics(messages: DataFrame, lexicon: Lexicon = TOPICS, count: int = 3) -> DataFrame:
    """Most frequent topics per conversation; ties by first appearance, oldest message first."""
    return first_topics(conversation_topics(messages, lexicon), count)


def _vector_sum(vector: Column, usable: Column, dimensions: int) -> Column:
    """The sum, position by position, of the vectors that are usable; the others count as zeros."""
    zeros = F.array_repeat(F.lit(0.0), dimensions)
    return vector_to_array(Summarizer.sum(array_to_vector(F.when(usable, vector).otherwise(zeros))))


def dictionary_states(messages: DataFrame, dimensions: int | None = None, lexicon: Lexicon = TOPICS) -> DataFrame:
    """What the topic dictionary is made of, per topic: message count, keywords met, vector sum and its vectors; mergeable.

    Membership is "at least one keyword of the topic occurs". All comes from one aggregate over one pass;
    vectors of another length or with a NULL are left out.
    """
    if long := [label for label in lexicon if len(label) > MAX_TOPIC_NAME]:
        raise ValueError(f"topic names of more than {MAX_TOPIC_NAME} characters: {long}")
    customers = sender(messages, "customer")
    words = list(dict.fromkeys(k for keywords in lexicon.values() for k in keywords))
    kept = ["embedding_vector"] if dimensions else []
    met = customers.select(keywords_met(F.col("message"), words).alias("met"), *kept)
    member = F.array(*(
        F.when(F.arrays_overlap("met", F.array(*(F.lit(words.index(k)) for k in keywords))), F.lit(label))
        for label, keywords in lexicon.items()
    ))
    listed = met.select("met", *kept, F.array_compact(member).alias("labels"))
    opened = open_array(listed, "labels", "label")
    flags = [F.max(F.array_contains("met", i)).alias(f"_word_{i}") for i in range(len(words))]
    own = F.array(*(
        F.when(F.col(f"_word_{i}") & F.col("label").isin(*(l for l, ks in lexicon.items() if k in ks)), F.lit(k))
        for i, k in enumerate(words)
    ))
    sums = []
    if dimensions:
        usable = F.coalesce(
            (F.size("embedding_vector") == dimensions) & F.forall("embedding_vector", lambda x: x.isNotNull()), F.lit(False)
        )
        sums = [F.count_if(usable).alias("vectors"), _vector_sum(F.col("embedding_vector"), usable, dimensions).alias("vector_sum")]
    counted = opened.groupBy("label").agg(F.count("*").alias("frequency"), *flags, *sums)
    names = ["vectors", "vector_sum"] if dimensions else []
    return counted.select(F.col("label").alias("topic_name"), "frequency", F.array_compact(own).alias("topic_keywords"), *names)


def merged_dictionary(states: DataFrame, dimensions: int | None = None) -> DataFrame:
    """One state per topic from the states of any number of arrivals."""
    sums = []
    if dimensions:
        sums = [F.sum("vectors").alias("vectors"), _vector_sum(F.col("vector_sum"), F.lit(True), dimensions).alias("vector_sum")]
    return states.groupBy("topic_name").agg(
        F.sum("frequency").alias("frequency"), F.array_distinct(F.flatten(F.collect_set("topic_keywords"))).alias("topic_keywords"), *sums
    )


def dictionary_of(states: DataFrame, dimensions: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """The rows of the topic dictionary: the mean vector is NULL where no vector had the right length."""
    columns = ["topic_name", "frequency", F.sort_array("topic_keywords").alias("topic_keywords")]
    if dimensions:
        mean = F.transform("vector_sum", lambda x: x / F.col("vectors"))
        columns.append(F.when(F.col("vectors") > 0, mean).alias("embedding_vector"))
    stamp = F.lit(as_of).cast("timestamp")
    return merged_dictionary(states, dimensions).select(*columns, stamp.alias("created_at"), stamp.alias("updated_at"))


def topics_table(
    messages: DataFrame, dimensions: int | None = None, lexicon: Lexicon = TOPICS, as_of: datetime | None = None
) -> DataFrame:
    """The topic dictionary: name, keywords met, message count, mean vector and times of writing.

    A topic name longer than the table's column is an error.
    """
    return dictionary_of(dictionary_states(messages, dimensions, lexicon), dimensions, as_of)
