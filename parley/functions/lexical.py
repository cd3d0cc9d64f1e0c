"""Keyword scoring, shared by batch and stream.

Matching is substring matching on the lower-cased text: each lexicon entry counts once per
text, however often it occurs and whatever it overlaps, so neither words nor one alternation
pattern can stand in for it. A hundred ``contains`` per row is the built-in way, and at 3 ns per
byte and keyword it is what such a job would spend its time on; one Arrow batch pass through
Python's own substring search does the same in a seventh of the core time (README, "Measured").
Only that pass is Python: it turns a text into hit counts per label, once per row and for all
lexicons of an operator together. Labels, scores and rankings are built-in expressions on the
counts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.lexicons import (
    INTENTS,
    OTHER_INTENT,
    OTHER_REPLY,
    REPLIES,
    REPLY_CATEGORIES,
    SENTIMENT,
    TOPICS,
    Lexicon,
)

# Sentiment score and topic confidence rules.
BASE_SCORE = 0.5
SCORE_STEP = 0.1
SCORE_LIMIT = 0.8
TOPIC_FACTOR = 2
TOP_LABELS = 3
AUTO_REPLY_CONFIDENCE = 0.8
SATISFACTION = {"positive": 4.5, "neutral": 3.0, "negative": 2.0}
NEUTRAL_SATISFACTION = 3.0

# characters of a word besides \\w: combining marks, Thai vowel and tone marks
_MARKS = "\u0300-\u036f\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"


def _matchers(keywords: Sequence[str], match: str) -> list:
    """One test per keyword on a lower-cased text."""
    if match == "substring":
        return [lambda text, k=k: k in text for k in keywords]
    if match == "word":
        edge = rf"[\w{_MARKS}]"
        patterns = [re.compile(rf"(?<!{edge}){re.escape(k)}(?!{edge})") for k in keywords]
        return [lambda text, p=p: p.search(text) is not None for p in patterns]
    raise ValueError(f"unknown match mode {match!r}")


def keyword_hits(text: Column, groups: Sequence[Sequence[str]], match: str = "substring") -> Column:
    """array<int>: for each group how many of its keywords occur in the text; NULL for NULL."""
    groups = [tuple(g) for g in groups]
    _matchers([], match)

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        if match == "substring":
            def counted(low):
                return [sum([k in low for k in g]) for g in groups]
        else:
            tests = [_matchers(g, match) for g in groups]

            def counted(low):
                return [sum([test(low) for test in g]) for g in tests]

        return pa.array(
            [None if t is None else counted(t.lower()) for t in texts.to_pylist()], pa.list_(pa.int32())
        )

    return count(text)


def keywords_met(text: Column, keywords: Sequence[str], match: str = "substring") -> Column:
    """array<int>: positions of the keywords that occur in the text; NULL for NULL."""
    keywords = tuple(keywords)
    _matchers([], match)

    @F.arrow_udf("array<int>")
    def positions(texts: pa.Array) -> pa.Array:
        tests = list(enumerate(_matchers(keywords, match)))

        def met(low):
            return [i for i, test in tests if test(low)]

        return pa.array([None if t is None else met(t.lower()) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return positions(text)


def with_hits(
    frame: DataFrame, text: str, lexicons: Sequence[Lexicon], match: str = "substring"
) -> tuple[DataFrame, list[Column]]:
    """Add the hit counts of several lexicons from one pass over the text, as ``_hits``.

    Returns the frame and, per lexicon, the array<int> of its counts in label order.
    """
    groups = [keywords for lexicon in lexicons for keywords in lexicon.values()]
    counted = frame.withColumn("_hits", keyword_hits(F.col(text), groups, match))
    if len(lexicons) == 1:
        return counted, [F.col("_hits")]
    starts = [sum(len(lexicon) for lexicon in lexicons[:n]) for n in range(len(lexicons))]
    return counted, [F.slice("_hits", at + 1, len(lexicon)) for at, lexicon in zip(starts, lexicons)]


def sentiment_of(hits: Column) -> tuple[Column, Column]:
    """Label and score from the positive and negative hit counts."""
    lead = F.get(hits, F.lit(0)) - F.get(hits, F.lit(1))
    label = F.when(lead > 0, "positive").when(lead < 0, "negative").when(lead == 0, "neutral")
    score = (
        F.when(lead > 0, F.least(F.lit(SCORE_LIMIT), BASE_SCORE + lead * SCORE_STEP))
        .when(lead < 0, F.greatest(F.lit(-SCORE_LIMIT), lead * SCORE_STEP - BASE_SCORE))
        .when(lead == 0, F.lit(0.0))
    )
    return label, F.round(score, 2)


def sentiment_sides(lexicon: Lexicon) -> Lexicon:
    return {"positive": lexicon["positive"], "negative": lexicon["negative"]}


def score_sentiment(
    frame: DataFrame,
    text: str = "message",
    lexicon: Lexicon = SENTIMENT,
    match: str = "substring",
    with_counts: bool = False,
) -> DataFrame:
    """Add ``sentiment``, ``sentiment_score`` and ``sentiment_confidence``."""
    counted, [hits] = with_hits(frame, text, [sentiment_sides(lexicon)], match)
    label, score = sentiment_of(hits)
    added = ("sentiment", "sentiment_score", "sentiment_confidence")
    kept = [c for c in frame.columns if c not in added]
    sides = ("positive_hits", "negative_hits") if with_counts else ()
    counts = [F.get(hits, F.lit(i)).alias(name) for i, name in enumerate(sides)]
    return counted.select(
        *kept,
        *counts,
        label.alias("sentiment"),
        score.alias("sentiment_score"),
        F.abs(score).alias("sentiment_confidence"),
    )


def best_labels(
    hits: Column,
    lexicon: Lexicon,
    factor: int = 1,
    top: int = TOP_LABELS,
    min_confidence: float = 0.0,
) -> Column:
    """array<struct<confidence, priority, label, hits>> of the best labels, from hit counts.

    The confidence is ``min(1, factor * hits / entries)``. Descending struct order is by
    confidence, then by lexicon order (``priority`` is its negative). Array functions over a
    constant table of labels keep the expression small, whatever the size of the lexicon.
    """
    labels = F.array(*(
        F.struct(F.lit(i).alias("at"), F.lit(label).alias("label"), F.lit(len(keywords)).alias("size"))
        for i, (label, keywords) in enumerate(lexicon.items())
    ))

    def entry(label):
        met = F.get(hits, label["at"])
        return F.struct(
            (F.least(met * factor, label["size"]) / label["size"]).alias("confidence"),
            (-1 - label["at"]).alias("priority"),
            label["label"].alias("label"),
            met.alias("hits"),
        )

    found = F.filter(
        F.transform(labels, entry), lambda e: (e["hits"] > 0) & (e["confidence"] >= min_confidence)
    )
    return F.when(hits.isNotNull(), F.slice(F.sort_array(found, asc=False), 1, top))


def rank_labels(
    frame: DataFrame,
    text: str,
    lexicon: Lexicon,
    out: str,
    factor: int = 1,
    top: int = TOP_LABELS,
    min_confidence: float = 0.0,
    match: str = "substring",
) -> DataFrame:
    """Add ``out``: the best labels of the text, see :func:`best_labels`."""
    counted, [hits] = with_hits(frame, text, [lexicon], match)
    kept = [c for c in frame.columns if c != out]
    return counted.select(*kept, best_labels(hits, lexicon, factor, top, min_confidence).alias(out))


def classify_topics(
    frame: DataFrame,
    text: str = "message",
    lexicon: Lexicon = TOPICS,
    out: str = "topics",
    top: int = TOP_LABELS,
    min_confidence: float = 0.0,
    match: str = "substring",
) -> DataFrame:
    return rank_labels(frame, text, lexicon, out, TOPIC_FACTOR, top, min_confidence, match)


def classify_intent(
    frame: DataFrame, text: str = "message", lexicon: Lexicon = INTENTS, match: str = "substring"
) -> DataFrame:
    """Add ``intents`` (best three) and ``primary_intent``."""
    ranked = rank_labels(frame, text, lexicon, "intents", match=match)
    return ranked.withColumn(
        "primary_intent",
        F.coalesce(F.get(F.col("intents"), F.lit(0))["label"], F.lit(OTHER_INTENT)),
    )


def open_array(frame: DataFrame, array: str, item: str) -> DataFrame:
    """One row per element of an array column, with its position ``_pos`` from 0.

    A plain explode makes Spark infer ``size(array) > 0`` and push it below the projection that
    makes the array, which would compute the keyword hits twice. The outer form does not.
    """
    kept = [c for c in frame.columns if c != array]
    opened = frame.select(*kept, F.posexplode_outer(array).alias("_pos", item))
    return opened.filter(F.col("_pos").isNotNull())


def explode_labels(frame: DataFrame, labels: str, name: str = "topic") -> DataFrame:
    """One row per label of an array made by :func:`rank_labels`; ``rank`` starts at 1."""
    kept = [c for c in frame.columns if c != labels]
    opened = open_array(frame.select(*kept, labels), labels, "_label")
    return opened.select(
        *kept,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_label.label").alias(name),
        F.col("_label.confidence").alias("confidence"),
        F.col("_label.hits").alias("hits"),
    )


def match_lexicon(
    frame: DataFrame, text: str, name: str, lexicon: Lexicon, match: str = "substring"
) -> DataFrame:
    """One row per text and keyword that occurs in it.

    A lexicon is a job parameter, so it travels with the task: the hits of a row are found in
    place and only they are emitted. No join and no shuffle takes place.
    """
    entries = [
        (label, order, keyword, len(keywords))
        for order, (label, keywords) in enumerate(lexicon.items(), 1)
        for keyword in keywords
    ]
    listed = F.array(*(
        F.struct(
            F.lit(name).alias("lexicon"),
            F.lit(label).alias("label"),
            F.lit(order).alias("label_order"),
            F.lit(keyword).alias("keyword"),
            F.lit(size).alias("label_size"),
        )
        for label, order, keyword, size in entries
    ))
    kept = [c for c in frame.columns if c != text]
    met = keywords_met(F.col(text), [keyword for _, _, keyword, _ in entries], match)
    opened = open_array(frame.select(*kept, met.alias("_met")), "_met", "_at")
    return opened.select(*kept, F.get(listed, F.col("_at")).alias("_entry")).select(*kept, "_entry.*")


def reply_category(
    frame: DataFrame,
    text: str = "message",
    categories: Lexicon = REPLY_CATEGORIES,
    match: str = "substring",
) -> DataFrame:
    """Add ``category``: the first category with a keyword in the text."""
    counted, [hits] = with_hits(frame, text, [categories], match)
    chain = None
    for at, label in enumerate(categories):
        hit = F.get(hits, F.lit(at)) > 0
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    category = chain.when(hits.isNotNull(), OTHER_REPLY)
    return counted.select(*frame.columns, category.alias("category"))


def _ranked_replies(replies, top):
    return {
        category: sorted(options, key=lambda o: o[1], reverse=True)[:top]
        for category, options in replies.items()
    }


def suggest_replies(
    frame: DataFrame,
    text: str = "message",
    categories: Lexicon = REPLY_CATEGORIES,
    replies=REPLIES,
    top: int = TOP_LABELS,
    match: str = "substring",
) -> DataFrame:
    """One row per suggested reply: ``category``, ``rank``, ``reply``, ``confidence``."""
    labelled = reply_category(frame, text, categories, match)
    options = None
    for category, ranked in _ranked_replies(replies, top).items():
        value = F.array(*(
            F.struct(F.lit(reply).alias("reply"), F.lit(float(conf)).alias("confidence"))
            for reply, conf in ranked
        ))
        condition = F.col("category") == category
        options = F.when(condition, value) if options is None else options.when(condition, value)
    listed = labelled.select(*frame.columns, "category", options.alias("_options"))
    opened = open_array(listed, "_options", "_option")
    return opened.select(
        *frame.columns, "category", (F.col("_pos") + 1).alias("rank"), "_option.*"
    )


def auto_reply(
    frame: DataFrame,
    as_of,
    text: str = "message",
    threshold: float = AUTO_REPLY_CONFIDENCE,
    categories: Lexicon = REPLY_CATEGORIES,
    replies=REPLIES,
    match: str = "substring",
) -> DataFrame:
    """The best reply where its confidence reaches the threshold; other rows drop out."""
    best = suggest_replies(frame, text, categories, replies, top=1, match=match)
    return best.filter(F.col("confidence") >= threshold).select(
        *frame.columns,
        "category",
        "reply",
        "confidence",
        F.lit(True).alias("is_auto"),
        F.lit(as_of).alias("replied_at"),
    )


def satisfaction_score(sentiment: Column) -> Column:
    """Sentiment label to a 1-5 score; any other label counts as neutral."""
    chain = None
    for label, score in SATISFACTION.items():
        chain = (
            F.when(sentiment == label, F.lit(score))
            if chain is None
            else chain.when(sentiment == label, F.lit(score))
        )
    return chain.otherwise(F.lit(NEUTRAL_SATISFACTION))
