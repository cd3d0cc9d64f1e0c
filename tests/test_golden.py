"""Hand-worked rows for the text scorers, default lexicons."""

import pytest

from parley.functions import lexical

# message, positive, negative, sentiment, score, topics, reply category
ROWS = [
    ("Great product, love it", 2, 0, "positive", 0.7, [("สินค้า", 0.2857)], "general"),
    ("สินค้าไม่ดี", 1, 2, "negative", -0.6, [("สินค้า", 0.2857)], "complaint"),
    (
        "this is bad, wrong item, problem with delivery", 0, 3, "negative", -0.8,
        [("การจัดส่ง", 0.2857), ("สินค้า", 0.2857)], "greeting",
    ),
    ("I want a refund", 0, 0, "neutral", 0.0, [("การคืนสินค้า", 0.3333)], "general"),
    ("ขอบคุณ", 1, 0, "positive", 0.6, [], "thanks"),
    ("dislike", 1, 0, "positive", 0.6, [], "general"),
    ("ไม่พอใจ", 1, 1, "neutral", 0.0, [], "general"),
    ("จัดส่งแล้วได้รับของ", 0, 0, "neutral", 0.0, [("การจัดส่ง", 1.0), ("สินค้า", 0.2857)], "greeting"),
    ("Please ship my order", 0, 0, "neutral", 0.0, [("การจัดส่ง", 0.2857), ("การสั่งซื้อ", 0.25)], "greeting"),
    ("What is the price?", 0, 0, "neutral", 0.0, [("ราคา", 0.25)], "price_inquiry"),
    ("", 0, 0, "neutral", 0.0, [], "general"),
]


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "id long, message string")


def test_sentiment(golden):
    got = lexical.score_sentiment(golden, with_counts=True).orderBy("id").collect()
    for row, want in zip(got, ROWS):
        assert (row.positive_hits, row.negative_hits, row.sentiment, row.sentiment_score) == want[1:5]
        assert row.sentiment_confidence == abs(want[4])


def test_topics(golden):
    got = lexical.classify_topics(golden).orderBy("id").collect()
    for row, want in zip(got, ROWS):
        assert [(t.label, round(t.confidence, 4)) for t in row.topics] == want[5]


def test_reply_category(golden):
    got = lexical.reply_category(golden).orderBy("id").collect()
    assert [r.category for r in got] == [r[6] for r in ROWS]


def test_replies_are_ranked_and_gated(golden):
    replies = lexical.suggest_replies(golden).orderBy("id", "rank").collect()
    by_id = {}
    for r in replies:
        by_id.setdefault(r.id, []).append(r.confidence)
    assert by_id[9] == [0.85, 0.8] and by_id[4] == [0.95, 0.9] and by_id[0] == [0.6]
    sent = {r.id for r in lexical.auto_reply(golden, None).collect()}
    assert 0 not in sent and {1, 2, 4, 7, 8, 9} <= sent
    strict = lexical.auto_reply(golden, None, threshold=0.95).collect()
    assert [r.id for r in strict] == [4]


def test_intents(spark):
    rows = spark.createDataFrame(
        [(0, "ขอสถิติและกราฟ response time"), (1, "อะไรนะ"), (2, "ไม่พอใจ"), (3, None)], "id int, message string"
    )
    got = lexical.classify_intent(rows).orderBy("id").collect()
    assert got[0].primary_intent == "analytics"
    assert [(i.label, round(i.confidence, 4)) for i in got[0].intents] == [("analytics", 0.3333), ("performance", 0.2)]
    assert got[1].primary_intent == "general" and got[1].intents == []
    assert [(i.label, round(i.confidence, 4)) for i in got[2].intents] == [("sentiment", 0.3333)]
    assert got[3].primary_intent == "general"


def test_match_word(spark):
    rows = spark.createDataFrame([("dislike",), ("I like it",)], "message string")
    got = lexical.score_sentiment(rows, match="word").collect()
    assert [r.sentiment for r in got] == ["neutral", "positive"]


def test_only_three_topics_are_kept_in_order(spark):
    rows = spark.createDataFrame([("order delivery product price return",)], "message string")
    topics = lexical.classify_topics(rows).first().topics
    assert [t.label for t in topics] == ["การคืนสินค้า", "การจัดส่ง", "สินค้า"]
    assert lexical.classify_topics(rows, min_confidence=0.3).first().topics[0].label == "การคืนสินค้า"
    assert len(lexical.classify_topics(rows, min_confidence=0.3).first().topics) == 1
