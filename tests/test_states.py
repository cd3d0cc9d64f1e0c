"""Tables kept up to date from arrivals equal those made from all messages, whatever the order and the repeats."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parley.lexicons import PROBE_TOPICS
from parley.operators import conversations, states, topics
from parley.schema import MAX_TOPIC_NAME

SCHEMA = (
    "id long, conversation_id string, user_id string, message string, sender_type string, timestamp timestamp, "
    "response_time int, sentiment string, embedding_vector array<double>"
)
KEYWORDS = [k for keywords in PROBE_TOPICS.values() for k in keywords]
NOW, LATER = datetime(2024, 2, 1), datetime(2024, 2, 2)


@pytest.fixture(scope="module")
def rows(spark):
    made = []
    for i in range(240):
        at = datetime(2024, 1, 1) + timedelta(hours=7 * (i % 37), minutes=i // 37)  # conversations run over several days
        words = " ".join(KEYWORDS[(i * 5 + j) % len(KEYWORDS)] for j in range(i % 3))
        vector = None if i % 5 == 0 else [float(i % 7), 1.0] if i % 4 else [1.0, 2.0, 3.0]
        made.append((
            i, f"c{i % 11}", f"u{(i * 7) % 3}", f"text {words}", ("customer", "admin", "system")[i % 3] if i % 4 else "customer", at,
            None if i % 3 == 0 else i % 500, (None, "positive", "negative", "neutral")[i % 4], vector,
        ))
    return spark.createDataFrame(made, SCHEMA).repartition(3).cache()


def plain(frame):
    drop = [c for c in ("created_at", "updated_at") if c in frame.columns]
    shown = frame.drop(*drop)
    rounded = lambda v: [round(x, 9) for x in v] if isinstance(v, list) and v and isinstance(v[0], float) else v
    return sorted(str([(c, rounded(r[c])) for c in sorted(shown.columns)]) for r in shown.collect())


def test_summaries_of_any_order_of_arrivals(spark, rows, tmp_path):
    follower = states.SummaryFollower(str(tmp_path / "s"), rows, PROBE_TOPICS)
    late = F.col("timestamp") < F.lit("2024-01-04").cast("timestamp")  # the beginnings come last: days change
    follower.arrive(rows.where(~late & (F.col("id") % 2 == 0)), "one", NOW)
    follower.arrive(rows.where(~late & (F.col("id") % 2 == 1)), "two", NOW)
    assert plain(follower.table()) == plain(conversations.full_summary(rows.where(~late), PROBE_TOPICS, NOW))
    follower.arrive(rows.where(late & (F.col("conversation_id") != "c3")), "three", LATER)
    follower.arrive(rows.limit(0), "none", LATER)
    follower.arrive(rows.where(late & (F.col("conversation_id") == "c3")), "four", LATER)
    want = plain(conversations.full_summary(rows, PROBE_TOPICS, NOW))
    assert plain(follower.table()) == want
    assert {r.created_at for r in follower.table().collect()} == {NOW}  # kept from the first writing
    follower.arrive(rows.where(~late & (F.col("id") % 2 == 0)), "one", LATER)  # delivered again
    assert plain(follower.table()) == want
    follower.counts.compact()
    follower.topics.compact()
    assert len(follower.counts.arrivals()) == len(follower.topics.arrivals()) == 1
    follower.arrive(rows.where(~late & (F.col("id") % 2 == 0)), "one", LATER)  # and once more, after it was merged
    assert plain(follower.table()) == want
    follower.rebuild(LATER)
    assert plain(follower.table()) == want


def test_a_table_of_states_survives_a_lost_job(spark, rows, tmp_path, monkeypatch):
    made = conversations.conversation_states(rows)
    table = states.StateTable(spark, str(tmp_path / "t"), made.schema, conversations.merged_conversations)
    assert table.arrivals() == [] and table.read().count() == 0
    table.compact()
    for part in range(3):
        table.store(conversations.conversation_states(rows.where(F.col("id") % 3 == part)), f"p{part}")
    want = plain(made)
    whole = lambda: plain(conversations.merged_conversations(table.read()))
    assert whole() == want
    # lost before the ledger: the merged folder does not count
    with monkeypatch.context() as patch:
        patch.setattr(spark, "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.compact()
    assert len(table.arrivals()) == 3 and whole() == want
    # lost after it: the old folders do not count
    with monkeypatch.context() as patch:
        patch.setattr(states, "remove_folder", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            table.compact()
    assert len(table.arrivals()) == 1 and whole() == want
    assert not table.store(made, "p1") and whole() == want
    table.store(conversations.conversation_states(rows.where("id = 5")), "p9")
    table.compact()
    assert not table.store(made, "p0") and not table.store(made, "p9")  # known through both merges
    assert len(table.arrivals()) == 1
    for name in ("merged-1", "a/b", ""):
        with pytest.raises(ValueError):
            table.store(made, name)


def test_dictionary_of_arrivals(spark, rows, tmp_path):
    for dimensions in (None, 2):
        follower = states.TopicFollower(str(tmp_path / f"d{dimensions}"), rows, dimensions, PROBE_TOPICS)
        for part in (3, 0, 2, 1):
            follower.arrive(rows.where(F.col("id") % 4 == part), f"p{part}")
        want = plain(topics.topics_table(rows, dimensions, PROBE_TOPICS, NOW))
        assert want and plain(follower.table(NOW)) == want
        follower.states.compact()
        follower.arrive(rows.where("id % 4 = 3"), "p3")
        assert plain(follower.table(NOW)) == want


def test_mean_vectors_leave_out_other_lengths(spark):
    word = KEYWORDS[0]
    made = [(i, f"x {word}", v) for i, v in enumerate([[1.0, 2.0], [3.0, 6.0], [9.0], None, [None, 1.0]])]
    frame = spark.createDataFrame(made, "id long, message string, embedding_vector array<double>").withColumns(
        {"sender_type": F.lit("customer")}
    )
    found = topics.topics_table(frame, 2, PROBE_TOPICS).collect()
    assert [r.embedding_vector for r in found] == [[2.0, 4.0]] * len(found) and all(r.frequency == 5 for r in found)
    none = topics.topics_table(frame.where("id > 1"), 2, PROBE_TOPICS).collect()
    assert none and all(r.embedding_vector is None for r in none)


def test_a_topic_name_that_is_too_long_is_an_error(spark, rows):
    with pytest.raises(ValueError, match="topic names"):
        topics.topics_table(rows, None, {"x" * (MAX_TOPIC_NAME + 1): ("a",)})
