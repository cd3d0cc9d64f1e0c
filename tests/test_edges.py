"""Edge rows and properties of the operators."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from parley.functions import cleaning, lexical
from parley.functions.timing import in_days, response_band
from parley.functions.vectors import cosine_similarity, decode_vector, encode_vector
from parley.lexicons import TOPICS, lexicon_frame, lexicon_from_frame
from parley.operators import conversations, filters, insights, metrics, mutations, quality, topics
from parley.sources import sinks
from parley.sources.fixtures import messages
from parley.session import fresh_folder

FOLDER = "/root/testdata/sf0.01"


def test_null_message_scores_null(spark):
    rows = spark.createDataFrame([(None,)], "message string")
    scored = lexical.score_sentiment(rows).first()
    assert scored.sentiment is None and scored.sentiment_score is None
    assert lexical.classify_topics(rows).first().topics is None
    assert lexical.suggest_replies(rows).count() == 0


def test_response_limits(spark):
    rows = spark.createDataFrame([(None,), (0,), (300,), (301,), (900,), (1800,), (3600,), (3601,)], "response_time int")
    assert filters.response_cap(rows).count() == 6
    bands = [r[0] for r in rows.select(response_band(F.col("response_time"))).collect()]
    assert bands == [None, "good", "good", "acceptable", "acceptable", "poor", "beyond", "beyond"]


def test_cosine_edges(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0]), (None, [1.0]), ([1.0, 1.0], [1.0, 0.0])],
        "a array<double>, b array<double>",
    )
    got = [r[0] for r in rows.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [1.0, 0.0, 0.0, None] and abs(got[4] - 0.5**0.5) < 1e-12
    back = [r[0] for r in rows.select(cosine_similarity(F.col("b"), F.col("a"))).collect()]
    assert back == got


def test_vector_json(spark):
    rows = spark.createDataFrame([("[1.5, 2]",), ("[1, oops]",), ("nothing",), (None,), ("[]",)], "t string")
    got = [r[0] for r in rows.select(decode_vector(F.col("t"))).collect()]
    assert got == [[1.5, 2.0], None, None, None, []]
    again = spark.range(1).select(decode_vector(encode_vector(F.array(F.lit(0.25), F.lit(-3.0)))).alias("v")).first().v
    assert again == [0.25, -3.0]


def test_preview_and_length_rules(spark):
    rows = spark.createDataFrame(
        [("ก" * 100, "customer", "text"), ("ก" * 101, "bot", "hologram"), ("x" * 4000, None, None), ("x" * 4001, "admin", "image"), (None, "admin", "text")],
        "message string, sender_type string, message_type string",
    )
    previews = [r.message_preview for r in filters.message_preview(rows).collect()]
    assert previews[0] == previews[1] == "ก" * 100
    found = [r.violations for r in quality.validate_messages(rows).collect()]
    assert found == [[], ["message_type_unknown", "sender_type_unknown"], ["sender_type_missing"], ["message_too_long"], ["message_missing"]]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_day_bounds_are_inclusive(spark, kind):
    rows = spark.createDataFrame(
        [("2024-01-04 23:59:59.999999",), ("2024-01-05 00:00:00",), ("2024-01-11 23:59:59.999999",), ("2024-01-12 00:00:00",)],
        "t string",
    ).select(F.col("t").cast(kind).alias("timestamp"))
    kept = filters.date_range(rows, datetime(2024, 1, 5, 17, 0), "2024-01-11")
    assert kept.count() == 2
    bangkok = rows.filter(in_days(rows, "timestamp", date(2024, 1, 12), date(2024, 1, 12), "Asia/Bangkok"))
    assert bangkok.count() == 2


def test_expiry_boundary(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 14)), (2, datetime(2024, 1, 15)), (3, datetime(2024, 1, 16))], "id int, expires_at timestamp")
    as_of = datetime(2024, 1, 15)
    assert [r.id for r in mutations.live_rows(rows, as_of).collect()] == [3]
    assert [r.id for r in mutations.after_cleanup(rows, as_of).collect()] == [2, 3]


def test_clean_reply_texts(spark):
    rows = [
        "คำตอบ: สวัสดีครับ", "  ตอบ: ยอดขาย\nคำตอบ: สอง\n", "x" * 3000, "ขอบคุณ  ", " ตาม ", "a\n\n ตอบ:\n b", "สวัสดี" + "y" * 1995,
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.t for r in cleaning.clean_reply(frame, "t").orderBy("i").collect()]
    assert got[0] == "สวัสดีครับ"
    assert got[1] == "ตามข้อมูลที่มี ยอดขาย\nสอง"
    assert got[2] == ("ตามข้อมูลที่มี " + "x" * 3000)[:1950] + cleaning.REPLY_NOTICE
    assert got[3] == "ขอบคุณ"
    assert got[4] == cleaning.REPLY_PREFIX + " ตาม"
    assert got[5] == "ตามข้อมูลที่มี a\nb"
    assert got[6].endswith("ยาวเกินไป)") and len(got[6]) == 1950 + len(cleaning.REPLY_NOTICE)


def test_display_markup_texts(spark):
    text = "**หัวข้อ** *a* b\n1. one\n-  two\n*x\ny*"
    got = spark.createDataFrame([(text,)], "t string").select(cleaning.display_markup(F.col("t"))).first()[0]
    assert got == "<strong>🏷️ หัวข้อ</strong> <em>a</em> b\n• one\n• two\n*x\ny*"


def test_ids_compared_without_case_and_accents(spark):
    rows = spark.createDataFrame([("Zoé",), ("zoe",), ("ZOÉ",), ("max",)], "conversation_id string")
    assert metrics.total_conversations(rows).first().total == 4
    assert metrics.total_conversations(filters.caseless(rows, "conversation_id")).first().total == 2


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_lexicon_round_trip(spark):
    frame = lexicon_frame(spark, "topics", TOPICS)
    again = lexicon_from_frame(frame)
    assert list(again) == list(TOPICS) and all(set(again[k]) == set(TOPICS[k]) for k in TOPICS)


def test_append_defaults(spark):
    table = spark.createDataFrame([(1, "a", "image", "{}", datetime(2024, 1, 1))], "id int, message string, message_type string, metadata string, timestamp timestamp")
    new = spark.createDataFrame([(2, "b", None), (3, "c", "file")], "id int, message string, message_type string")
    rows = mutations.append_messages(table, new, datetime(2024, 1, 15)).orderBy("id").collect()
    assert [(r.message_type, r.metadata, r.timestamp.day) for r in rows] == [("image", "{}", 1), ("text", "{}", 15), ("file", "{}", 15)]


def test_insert_ignore_twice_is_once(spark):
    table = spark.createDataFrame([(1, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "x", 0), (2, "second", 2), (2, "first", 1)], "id int, v string, n int")
    once = mutations.insert_ignore(table, new, ["id"], ["n"])
    twice = mutations.insert_ignore(once, new, ["id"], ["n"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "old"), (2, "first")]


def test_upsert_last_write_wins(spark):
    table = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    new = spark.createDataFrame([("b", "3", 1), ("b", None, 2), ("c", "5", 1)], "k string, v string, n int")
    got = mutations.upsert(table, new, ["k"], ["n"])
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("b", None), ("c", "5")]


def test_patch_is_idempotent_and_may_set_null(spark):
    table = spark.createDataFrame([(1, "x", None), (2, "y", None)], "id int, sentiment string, processed_at timestamp")
    patch = spark.createDataFrame([(1, None)], "id int, sentiment string")
    stamp = datetime(2024, 1, 15)
    once = mutations.patch_columns(table, patch, ["sentiment"], stamp)
    twice = mutations.patch_columns(once, patch, ["sentiment"], stamp)
    want = [(1, None, stamp), (2, "y", None)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want


def test_empty_input_defaults(spark):
    rows = messages(spark, FOLDER, response_time=True, sentiment=True).filter("id < 0")
    kpis = metrics.range_kpis(rows, "2024-01-01", "2024-01-31").first()
    assert tuple(kpis) == (0, 0, 0, 0.0)
    assert metrics.satisfaction_overall(rows).first()[0] == 3.0
    assert metrics.negative_share(rows).first().negative_pct == 0.0
    assert insights.insights(rows, "2024-01-15").count() == 0


def test_distributions_add_up(spark):
    rows = messages(spark, FOLDER, sentiment=True).cache()
    kinds = metrics.message_type_distribution(rows, "2024-01-01", "2024-01-31").collect()
    assert sum(r["count"] for r in kinds) == rows.count() and abs(sum(r.share for r in kinds) - 100) < 1e-4
    feelings = metrics.sentiment_distribution(rows).collect()
    assert sum(r["count"] for r in feelings) == rows.filter("sentiment IS NOT NULL").count()
    assert rows.filter("abs(sentiment_score) > 0.8").count() == 0
    days = metrics.daily_conversations(rows, "2024-01-05", "2024-01-11").agg(F.sum("messages")).first()[0]
    whole = metrics.range_kpis(rows.withColumn("response_time", F.lit(None).cast("int")), "2024-01-05", "2024-01-11").first()
    assert days == whole.total_messages
    rows.unpersist()


def test_topic_ties_follow_first_appearance(spark):
    rows = spark.createDataFrame(
        [(1, 7, "refund", "2024-01-01 10:00"), (2, 7, "help", "2024-01-01 11:00"), (3, 7, "sale", "2024-01-01 11:00")],
        "id long, conversation_id long, message string, t string",
    ).select("*", F.to_timestamp("t").alias("timestamp"), F.lit("customer").alias("sender_type"))
    newest_first = [r.topic for r in topics.topic_frequency(rows).collect()]
    assert newest_first == ["โปรโมชั่น", "บริการ", "การคืนสินค้า"]
    oldest_first = [r.topic for r in topics.conversation_top_topics(rows).orderBy("rank").collect()]
    assert oldest_first == ["การคืนสินค้า", "บริการ", "โปรโมชั่น"]


def test_digest_prints_missing_sentiment(spark):
    rows = spark.createDataFrame([(1, 5, 9, "hi", "customer", None)], "id long, conversation_id long, user_id long, message string, sender_type string, sentiment string")
    rows = rows.withColumn("timestamp", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    assert conversations.context_digest(rows).first().digest == "1. [2024-01-01 10:00:00] customer (9): hi [ความรู้สึก: None]"
    assert conversations.conversation_transcripts(rows).first().transcript == "1. [customer] hi (ความรู้สึก: None)"


def test_stored_result_expires(spark):
    base = fresh_folder(spark, "cache-test")
    rows = spark.range(3)
    now = datetime(2024, 1, 15, 12)
    assert sinks.load_result(spark, base, "k", now) is None
    assert sinks.store_result(rows, base, "k", now)
    assert sinks.load_result(spark, base, "k", datetime(2024, 1, 15, 12, 59)).count() == 3
    assert sinks.load_result(spark, base, "k", datetime(2024, 1, 15, 13)) is None
    assert not sinks.store_result(rows.limit(0), base, "empty", now)
    assert sinks.load_result(spark, base, "empty", now) is None
    assert sinks.cached(spark.range(9), base, "k", now).count() == 3
    # a result that expires this very moment can no longer be read and is not removed yet
    assert sinks.clean_results(spark, base, datetime(2024, 1, 15, 13)) == 0
    path = sinks.manifest(spark, base).first().result_path
    assert sinks.table_exists(spark, path)
    assert sinks.clean_results(spark, base, datetime(2024, 1, 15, 14)) == 1
    assert not sinks.table_exists(spark, path) and sinks.manifest(spark, base).count() == 0


def test_results_of_like_keys_do_not_mix(spark):
    base, now = fresh_folder(spark, "cache-test"), datetime(2024, 1, 15, 12)
    sinks.store_result(spark.range(3), base, "a-b", now)
    sinks.store_result(spark.range(7), base, "a_b", now)
    assert sinks.load_result(spark, base, "a-b", now).count() == 3
    assert sinks.load_result(spark, base, "a_b", now).count() == 7


def test_two_patches_of_a_key_leave_one_row(spark):
    table = spark.createDataFrame([(1, None, None), (2, "old", datetime(2024, 1, 1))], "id int, sentiment string, processed_at timestamp")
    patches = spark.createDataFrame([(1, "first", 1), (1, "last", 2), (2, "new", 3)], "id int, sentiment string, at int")
    stamp = datetime(2024, 1, 15)
    rows = mutations.patch_columns(table, patches, ["sentiment"], stamp, order=["at"]).orderBy("id").collect()
    assert [(r.id, r.sentiment) for r in rows] == [(1, "last"), (2, "new")]
    kept = mutations.patch_columns(table, patches, ["sentiment"], stamp, order=["at"], only_new=True).orderBy("id").collect()
    assert [(r.sentiment, r.processed_at.day) for r in kept] == [("last", 15), ("old", 1)]


def _by_day(spark, rows, schema):
    path = fresh_folder(spark, "days")
    frame = spark.createDataFrame(rows, schema).withColumn("day", F.to_date("timestamp"))
    sinks.write_by_date(frame, path, "day")
    return path, lambda: spark.read.schema(frame.schema).parquet(path)


def test_keyed_writes_touch_only_their_days(spark):
    rows = [(i, datetime(2024, 1, 1 + i % 5), f"v{i}", None) for i in range(50)]
    path, read = _by_day(spark, rows, "id int, timestamp timestamp, value string, processed_at timestamp")
    before = {f.split("day=")[1]: f for f in read().inputFiles()}
    new = spark.createDataFrame([(3, datetime(2024, 1, 5), "moved", None), (99, datetime(2024, 1, 9), "added", None)], "id int, timestamp timestamp, value string, processed_at timestamp")
    sinks.upsert_days(path, read(), new.withColumn("day", F.to_date("timestamp")), ["id"])
    got = {r.id: (r.value, r.day.day) for r in read().collect()}
    assert len(got) == read().count() == 51 and got[3] == ("moved", 5) and got[99] == ("added", 9) and got[4] == ("v4", 5)
    after = {f.split("day=")[1]: f for f in read().inputFiles()}
    untouched = {f for f in before if f[:10] in ("2024-01-01", "2024-01-02", "2024-01-03")}
    assert untouched <= set(after)
    patches = spark.createDataFrame([(7, "patched")], "id int, value string")
    assert sinks.patch_days(path, read(), patches, ["value"], datetime(2024, 2, 1)) == 1
    assert sinks.patch_days(path, read(), patches, ["value"], datetime(2024, 3, 1), only_new=True) == 0
    assert read().where("id = 7").first().processed_at == datetime(2024, 2, 1)
    assert sinks.expire_days(path, read(), datetime(2024, 1, 2), "timestamp") == 10
    assert read().count() == 41 and not sinks.table_exists(spark, f"{path}/day=2024-01-01")


def test_a_huge_day_is_several_files(spark, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 1000)
    path = fresh_folder(spark, "huge")
    rows = spark.range(5000).select("id", F.lit("2024-01-01").cast("date").alias("day"))
    sinks.write_by_date(rows, path, "day")
    assert len(spark.read.parquet(path).inputFiles()) >= 5 and spark.read.parquet(path).count() == 5000


def test_date_ranges_prune_partitions(spark):
    from parley.operators import filters
    from parley.schema import MESSAGES
    from parley.sources.readers import stored_form

    rows = spark.range(300).select(
        "id", F.lit("c").alias("conversation_id"), F.lit("u").alias("user_id"), F.lit("m").alias("message"),
        F.lit("customer").alias("sender_type"), F.expr("timestamp'2024-01-01 12:00:00' + make_interval(0,0,0,cast(id % 30 as int))").alias("timestamp"),
    )
    path = fresh_folder(spark, "stored")
    sinks.write_by_date(stored_form(rows), path, "day")
    table = sinks.read_days(spark, path, MESSAGES)
    for found, days, read in (
        (filters.date_range(table, "2024-01-05", "2024-01-06"), 2, 2),
        (filters.one_day(table, "2024-01-05"), 1, 1),
        (filters.date_range(table, "2024-01-05", "2024-01-06", "Asia/Bangkok"), 2, 4),
        (filters.last_days(table, "2024-01-30", 3), 4, 4),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in plan
        assert found.count() == 10 * days
        pruned = found._jdf.queryExecution().optimizedPlan()
        assert pruned is not None
        assert len({f for f in found.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) <= read


def test_first_rows_beyond_the_window_limit(spark):
    from parley.operators.slices import first_rows

    frame = spark.range(20_000).withColumn("k", F.col("id") % 2)
    top = first_rows(frame, ["k"], [F.col("id").desc()], 1001)
    assert top.columns == ["id", "k", "rank"]
    got = top.where("k = 0").orderBy("rank").collect()
    assert [r.id for r in got] == list(range(19_998, 19_998 - 2 * 1001, -2)) and [r["rank"] for r in got] == list(range(1, 1002))


def test_groups_of_awkward_vectors(spark):
    from parley.operators.similarity import vector_groups

    rows = [(i, [float(i % 2), float(1 - i % 2)]) for i in range(20)] + [(90, [0.0, 0.0]), (91, [1.0]), (92, None), (93, [])]
    frame = spark.createDataFrame(rows, "id int, embedding_vector array<double>")
    got = {r.id: r.group for r in vector_groups(frame, 2).members.collect()}
    assert len({got[i] for i in range(0, 20, 2)}) == len({got[i] for i in range(1, 20, 2)}) == 1 and got[0] != got[1]
    assert got[90] is None and got[91] is None and got[93] is None and 92 not in got
    assert vector_groups(frame.where("id >= 90"), 2).members.count() == 3
