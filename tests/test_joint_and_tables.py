"""Lexicons that are tables, daily sketches and the joint model of satisfaction."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.lexicons import PROBE_TOPICS, lexicon_frame
from parley.operators import lexicon_table, metrics, sketches

ENTRIES = "label string, label_order int, keyword string"


def met(spark, texts, entries):
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, message string")
    found = lexicon_table.match_lexicon_table(frame, spark.createDataFrame(entries, ENTRIES))
    return {(r.id, r.label, r.label_order, r.keyword, r.label_size) for r in found.collect()}


def brute(texts, entries):
    entries = {e for e in entries if e[2] is not None}
    size = {(l, o): sum(e[:2] == (l, o) for e in entries) for l, o, _ in entries}
    return {(i, l, o, k, size[l, o]) for i, t in enumerate(texts) if t is not None for l, o, k in entries if k in t.lower()}


TEXTS = ["abcabc ABC", "ไม่ดี เลย", None, "", "xyz", "she sells hers", "ä Ä ß"]
KEYWORDS = [("a", 1, "abc"), ("a", 1, "bca"), ("b", 2, "abc"), ("b", 2, "bc"), ("b", 2, "bc"), ("t", 3, "ไม่ดี"), ("t", 3, "ดี"), ("t", 3, None),
            ("e", 4, ""), ("n", 5, "ABC"), ("h", 6, "he"), ("h", 6, "hers"), ("h", 6, "she"), (None, None, "xyz"), ("u", 7, "ä")]


def test_overlaps_repeats_and_nulls(spark):
    want = {r for r in brute(TEXTS, KEYWORDS) if r[1] is not None}
    assert {r for r in met(spark, TEXTS, KEYWORDS) if r[1] is not None} == want
    assert met(spark, TEXTS, KEYWORDS[:0]) == set() and met(spark, [], KEYWORDS) == set()


def test_a_hundred_thousand_keywords_in_several_blocks(spark, monkeypatch):
    draw = random.Random(4)
    words = {"".join(draw.choice("abcdefgh") for _ in range(draw.randint(4, 9))) for _ in range(130_000)}
    entries = [(w[0], ord(w[0]), w) for w in sorted(words)[:100_000]]
    texts = [" ".join(draw.choice(entries)[2] + draw.choice("abcxyz") for _ in range(12)) for _ in range(40)]
    known = {e[2] for e in entries}
    pieces = lambda t: {t[i:j] for i in range(len(t)) for j in range(i + 4, min(len(t), i + 9) + 1)}
    want = {(i, k) for i, t in enumerate(texts) for k in pieces(t) & known}
    for keywords in (500_000, 9_000):
        monkeypatch.setattr(lexicon_table, "BLOCK_KEYWORDS", keywords)
        assert {(r[0], r[3]) for r in met(spark, texts, entries)} == want
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16b")
        assert {(r[0], r[3]) for r in met(spark, texts, entries)} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_table_gives_what_the_lexicon_gives(spark):
    from parley.functions.lexical import match_lexicon

    frame = spark.createDataFrame([(i, f"The ration {k}ly") for i, k in enumerate("die ung que de".split())], "id long, message string")
    table = lexicon_frame(spark, "topics", PROBE_TOPICS)
    found = lexicon_table.match_lexicon_table(frame, table).select("id", "label", "label_order", "keyword", "label_size")
    want = match_lexicon(frame, "message", "topics", PROBE_TOPICS).select("id", "label", "label_order", "keyword", "label_size")
    assert sorted(found.collect()) == sorted(want.collect()) != []


def test_sketches_over_any_range_keep_their_bounds(spark, tmp_path):
    rows = spark.range(200_000).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % (20 * 86_400)).alias("timestamp"),
        (F.col("id") % 60_000).cast("string").alias("conversation_id"), (F.col("id") % 7).cast("string").alias("user_id"),
        F.when(F.col("id") % 3 > 0, F.pmod(F.xxhash64("id"), F.lit(5000))).cast("int").alias("response_time"),
    ).union(spark.createDataFrame([(None, "none", "none", 3)], "timestamp timestamp, conversation_id string, user_id string, response_time int"))
    path = str(tmp_path / "sketches")
    sketches.daily_sketches(rows).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() <= 20
    days = F.to_date("timestamp")
    for start, end in (("2024-01-01", "2024-01-20"), ("2024-01-02", "2024-01-02"), ("2024-01-01", "2024-01-02")):
        about = sketches.range_from_sketches(stored, start, end).first()
        chosen = rows.where(days.between(start, end))
        exact = chosen.agg(F.count("*"), F.countDistinct("conversation_id"), F.countDistinct("user_id")).first()
        assert about.total_messages == exact[0] and about.unique_users == exact[2]
        assert abs(about.total_conversations - exact[1]) <= exact[1] * sketches.DISTINCT_BOUND
        for p in (50, 90, 99):
            share = chosen.agg(F.avg((F.col("response_time") <= about[f"response_q{p}"]).cast("double"))).first()[0]
            assert share is None or abs(share - p / 100) <= sketches.RANK_BOUND + 0.001
    none = sketches.range_from_sketches(stored, "2025-01-01", "2025-02-01").first()
    assert none.total_messages == 0 and none.total_conversations in (0, None) and none.response_q50 is None


def conversations_of(measures):
    """Messages whose conversations have the measures given: score class, response time, length, hour, count."""
    rows = []
    for c, (sentiment, response, length, hour, count) in enumerate(measures):
        for i in range(count):
            at = datetime(2024, 1, 1, hour) + timedelta(seconds=i)
            rows.append((f"c{c}", at, "x" * length, response, sentiment))
    return rows


MESSAGE = "conversation_id string, timestamp timestamp, message string, response_time int, sentiment string"


def joint(spark, measures):
    found = metrics.satisfaction_drivers_joint(spark.createDataFrame(conversations_of(measures), MESSAGE)).collect()
    return {r.factor: r for r in found}


def test_joint_drivers_tell_correlated_factors_apart(spark):
    draw = np.random.default_rng(6)
    score = {"positive": 4.5, "neutral": 3.0, "negative": 2.0}
    measures = []
    for _ in range(300):
        slow = int(draw.integers(0, 3))
        length = 10 + 30 * slow + int(draw.integers(0, 40))  # long where slow, but without an influence of its own
        mood = ["positive", "neutral", "negative"][slow if draw.random() < 0.85 else int(draw.integers(0, 3))]
        measures.append((mood, 100 * slow + int(draw.integers(0, 20)), length, int(draw.integers(0, 24)), int(draw.integers(1, 5))))
    found = joint(spark, measures)
    x = np.array([[r, n, h, c] for _, r, n, h, c in measures], dtype=float)
    y = np.array([score[m] for m, *_ in measures])
    solved = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0][1:]
    for i, name in enumerate(metrics.FACTORS):
        others = np.column_stack([np.ones(len(x)), np.delete(x, i, axis=1)])
        left = [v - others @ np.linalg.lstsq(others, v, rcond=None)[0] for v in (x[:, i], y)]
        assert found[name].coefficient == pytest.approx(solved[i], abs=2e-6)
        assert found[name].beta == pytest.approx(solved[i] * x[:, i].std() / y.std(), abs=2e-6)
        assert found[name].partial_correlation == pytest.approx(np.corrcoef(*left)[0, 1], abs=2e-6)
    alone = {r.factor: r.correlation for r in metrics.satisfaction_drivers(spark.createDataFrame(conversations_of(measures), MESSAGE)).collect()}
    assert alone["message_length"] < -0.4 and abs(found["message_length"].partial_correlation) < 0.2


def test_factors_without_a_value(spark):
    measures = [(("positive", "negative")[i % 2], 10 * (i % 5), 7, 3 + 2 * (i % 5), 1 + i % 3) for i in range(40)]
    found = joint(spark, measures + [(None, 5, 5, 5, 5), ("positive", None, 5, 5, 5)])  # incomplete ones are left out
    assert found["message_length"].coefficient is None  # never varies
    assert found["response_time"].coefficient is not None and found["hour"].coefficient is None  # the hour follows from it
    assert found["message_count"].partial_correlation is not None and found["message_count"].impact
    none = joint(spark, [("positive", 1, 2, 3, 1)] * 4)
    assert all(r.coefficient is None for r in none.values()) and len(none) == 4
    empty = metrics.satisfaction_drivers_joint(spark.createDataFrame([], MESSAGE)).collect()
    assert len(empty) == 4 and all(r.beta is None for r in empty)


def test_a_dealt_lexicon_is_read_as_rows(spark):
    """No row holds a block of the lexicon: a task reads its entries one by one, whatever their number."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16b")
        frame = spark.createDataFrame(list(enumerate(TEXTS)), "id long, message string")
        found = lexicon_table.match_lexicon_table(frame, spark.createDataFrame(KEYWORDS, ENTRIES))
        assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.id, r.label, r.label_order, r.keyword, r.label_size) for r in found.collect() if r.label is not None}
        assert got == {r for r in brute(TEXTS, KEYWORDS) if r[1] is not None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
