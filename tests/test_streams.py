"""Streams drained from growing folders."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parley.operators.similarity import embed_messages
from parley.session import fresh_folder
from parley.sources.readers import scan_message_stream
from parley.streaming.enrich import enrich, incremental_enrich
from parley.streaming.kpis import daily_from_sightings, daily_sightings, dedup_messages, first_sightings
from parley.streaming.lockout import Lockout, stream_lockout
from parley.streaming.state import STATE_STORE, state_store
from parley.streaming.sinks import drain_batches, drain_to_files, insert_ignore_sink

START = datetime(2024, 1, 1)
SCHEMA = "id long, conversation_id long, message string, timestamp timestamp"


def _arrive(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_second_run_takes_only_new_files(spark):
    inbox, out = fresh_folder(spark, "inbox"), fresh_folder(spark, "out")
    _arrive(spark, inbox, [(1, 1, "great", START), (2, 1, "bad", START)])
    schema = spark.read.parquet(inbox).schema

    def run():
        stream = enrich(scan_message_stream(spark, inbox, schema), F.lit(START))
        return {r.id: r.sentiment for r in drain_to_files(stream, out).collect()}

    assert run() == {1: "positive", 2: "negative"}
    assert run() == {1: "positive", 2: "negative"}
    _arrive(spark, inbox, [(3, 2, "dunno", START)])
    assert run() == {1: "positive", 2: "negative", 3: "neutral"}


def test_repeated_deliveries_are_stored_once(spark):
    inbox, out = fresh_folder(spark, "inbox"), fresh_folder(spark, "out")
    rows = [(i, i % 3, f"m{i}", START + timedelta(minutes=i)) for i in range(50)]
    _arrive(spark, inbox, rows)
    schema = spark.read.parquet(inbox).schema

    def run(checkpoint):
        stream = dedup_messages(scan_message_stream(spark, inbox, schema))
        drain_batches(stream, checkpoint, insert_ignore_sink(spark, f"{out}/rows", SCHEMA))
        return spark.read.parquet(f"{out}/rows")

    assert run(f"{out}/a").count() == 50
    _arrive(spark, inbox, rows[:10] + [(99, 0, "new", START + timedelta(minutes=50))])
    assert run(f"{out}/a").count() == 51
    # a lost checkpoint replays everything and still adds nothing
    assert run(f"{out}/b").count() == 51


def test_sightings_count_exactly(spark):
    inbox = fresh_folder(spark, "inbox")
    rows = [(i, i % 7, "x", START + timedelta(hours=i)) for i in range(100)]
    _arrive(spark, inbox, rows)
    stream = first_sightings(scan_message_stream(spark, inbox, spark.read.parquet(inbox).schema))
    got = {r.date: r.conversations for r in daily_from_sightings(drain_to_files(stream, fresh_folder(spark, "s"))).collect()}
    want = {}
    for _, conv, _, at in rows:
        want.setdefault(at.date(), set()).add(conv)
    assert got == {d: len(c) for d, c in want.items()}


def test_online_lockout_matches_a_loop_over_several_batches(spark):
    rng = random.Random(5)
    rows, at = [], START
    for i in range(900):
        at += timedelta(seconds=rng.randrange(1, 40))
        rows.append((i, 0 if rng.random() < 0.4 else rng.randrange(1, 6), at, rng.random() < 0.1))
    inbox = fresh_folder(spark, "inbox")
    schema = "id long, user_id long, ts timestamp, ok boolean"
    mixed = rng.sample(rows, len(rows))  # out of order over all files
    for part in range(3):
        _arrive(spark, inbox, mixed[300 * part : 300 * (part + 1)], schema)
    _arrive(spark, inbox, [(-1, -1, at + timedelta(days=3), True)], schema)  # moves the watermark past all
    found = []
    for files in (1, 64):
        stream = scan_message_stream(spark, inbox, spark.read.parquet(inbox).schema, files_per_batch=files)
        with state_store(spark):
            decided = drain_to_files(stream_lockout(stream, delay="1 day"), fresh_folder(spark, "o")).where("id >= 0")
        found.append({r.id: (r.failures, r.refused) for r in decided.collect()})
    got = found[0]
    assert found[0] == found[1]
    want, recorded = {}, {}
    for i, user, ts, ok in rows:
        live = [t for t in recorded.get(user, []) if ts - t < timedelta(minutes=15)]
        refused = len(live) >= 5
        if not refused:
            live = [] if ok else [*live, ts]
        recorded[user] = live
        want[i] = (len(live), refused)
    assert any(refused for _, refused in want.values())
    assert got == want


def test_embedding_hook(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "fail")], "id int, message string")

    def encoder(texts):
        return [None if t == "fail" else [float(len(t)), 1.0] for t in texts]

    got = {r.id: r.embedding_vector for r in embed_messages(rows, encoder=encoder).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: None}
    built_in = {r.id: r.embedding_vector for r in embed_messages(rows, dimensions=16).collect()}
    assert built_in[2] is None and abs(sum(x * x for x in built_in[1]) - 1) < 1e-9
    assert embed_messages(rows, enabled=False).filter("embedding_vector IS NOT NULL").count() == 0


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    import parley.session as session

    class Conf:
        @staticmethod
        def get(key, default=None):
            return "hdfs://shared/place/" if key == "spark.checkpoint.dir" else default

    class Fake:
        conf = Conf

    assert session.shared_folder(Fake) == "hdfs://shared/place"

    class Remote:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        session.shared_folder(Remote)


def test_enrichment_of_a_second_arrival(spark):
    """An id delivered again is not worked off again, and what the first call stored keeps its stamp."""
    schema = "id long, message string, sender_type string, processed_at timestamp"
    inbox, folder = fresh_folder(spark, "inbox"), fresh_folder(spark, "queue")
    rows = [(i, "good day" if i % 2 else "bad day", "customer", None) for i in range(6)]
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], f"{schema}, sentiment string, sentiment_score double, embedding_vector array<double>")
    counts = []
    for number, (ids, stamp) in enumerate((((0, 1, 1), datetime(2024, 1, 1)), ((1, 2), datetime(2024, 2, 1)), ((), datetime(2024, 3, 1)))):
        if ids:
            _arrive(spark, inbox, [rows[i] for i in ids], schema)
        stream = scan_message_stream(spark, inbox, spark.read.parquet(inbox).schema)
        worked = incremental_enrich(table, stream, folder, F.lit(stamp), {"positive": ("good",), "negative": ("bad",)}, {"time": ("day",)})
        counts.append(worked.processed)
        assert sorted(r.topics for r in worked.topics.collect()) == [["time"]] * worked.processed
        path = fresh_folder(spark, f"table-{number}")
        worked.table.write.parquet(path)
        table = spark.read.schema(worked.table.schema).parquet(path)
    assert counts == [2, 1, 0]
    got = {r.id: r for r in table.collect()}
    assert len(got) == table.count() == 6
    assert [got[i].processed_at and got[i].processed_at.month for i in range(6)] == [1, 1, 2, None, None, None]
    assert got[1].sentiment == "positive" and got[2].sentiment == "negative" and len(got[1].embedding_vector) == 64


def test_ingest_evaluates_a_batch_once(spark):
    inbox, folder = fresh_folder(spark, "inbox"), fresh_folder(spark, "ingest")
    schema = "id long, timestamp timestamp"
    _arrive(spark, inbox, [(i, START + timedelta(days=i % 3)) for i in range(100)], schema)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(value):
        calls.add(1)
        return value

    stream = scan_message_stream(spark, inbox, spark.read.parquet(inbox).schema).select(counted("id").alias("id"), "timestamp")
    drain_batches(stream, folder, insert_ignore_sink(spark, f"{folder}/rows", schema))
    assert calls.value == 100
    _arrive(spark, inbox, [(i, START + timedelta(days=i % 3)) for i in range(50, 150)], schema)
    drain_batches(stream, folder, insert_ignore_sink(spark, f"{folder}/rows", schema))
    assert spark.read.parquet(f"{folder}/rows").count() == 150


def test_waiting_attempts_are_state_entries_of_their_own(spark):
    """A key's whole history is never one value: forty attempts that wait are forty entries at least."""
    inbox, out = fresh_folder(spark, "inbox"), fresh_folder(spark, "o")
    rows = [(i, 7, START + timedelta(seconds=i), False) for i in range(40)]
    _arrive(spark, inbox, rows, "id long, user_id long, ts timestamp, ok boolean")
    stream = scan_message_stream(spark, inbox, spark.read.parquet(inbox).schema)
    before = spark.conf.get(STATE_STORE)
    with pytest.raises(ValueError, match="stateStore"):  # the session's store is the caller's choice
        stream_lockout(stream, delay="1 day")
    with state_store(spark):
        query = (
            stream_lockout(stream, delay="1 day").writeStream.format("parquet").option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    assert spark.conf.get(STATE_STORE) == before
    assert max(state["numRowsTotal"] for p in query.recentProgress for state in p["stateOperators"]) >= 40


def test_enrichment_that_was_not_stored_comes_back(spark):
    """A call whose table is lost, and a message that arrives before its row, are worked off later."""
    schema = "id long, message string, sender_type string, processed_at timestamp"
    inbox, folder = fresh_folder(spark, "inbox"), fresh_folder(spark, "queue")
    rows = [(i, "good day", "customer", None) for i in range(4)]
    full = f"{schema}, sentiment string, sentiment_score double, embedding_vector array<double>"
    table = spark.createDataFrame([(*r, None, None, None) for r in rows[:3]], full)

    def call(table):
        stream = scan_message_stream(spark, inbox, spark.read.parquet(inbox).schema)
        return incremental_enrich(table, stream, folder, F.lit(START), {"positive": ("good",), "negative": ("bad",)}, {"time": ("day",)})

    def stored(table):
        path = fresh_folder(spark, "table")
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    _arrive(spark, inbox, [rows[i] for i in (0, 1, 3)], schema)
    assert call(table).processed == 2  # the result is lost
    _arrive(spark, inbox, [rows[2]], schema)
    worked = call(table)
    assert worked.processed == 3
    table = stored(worked.table)
    table = stored(table.union(spark.createDataFrame([(*rows[3], None, None, None)], full)))  # the row comes late
    worked = call(table)
    assert worked.processed == 1
    table = stored(worked.table)
    assert call(table).processed == 0
    assert table.where("sentiment = 'positive' and processed_at is not null").count() == 4


def test_sightings_with_a_delay_shorter_than_a_day(spark):
    """A conversation that is quiet for hours is counted once a day, in every batch order within the delay."""
    inbox = fresh_folder(spark, "inbox")
    schema = "conversation_id string, timestamp timestamp"
    day = datetime(2024, 1, 1)
    for hours in ((1, 2), (9,), (15, 14.5), (23.5, 26), (25.5,), (40,), (80,)):
        rows = [(c, day + timedelta(hours=h)) for h in hours for c in ("a", "b") if not (c == "b" and h in (9, 40))]
        _arrive(spark, inbox, rows + [(None, day + timedelta(hours=hours[0]))], schema)
    stream = scan_message_stream(spark, inbox, spark.read.parquet(inbox).schema, files_per_batch=1)
    with pytest.raises(ValueError, match="stateStore"):
        daily_sightings(stream)
    with state_store(spark):
        seen = drain_to_files(daily_sightings(stream, "1 hour"), fresh_folder(spark, "s"))
    got = {str(r.date): r.conversations for r in daily_from_sightings(seen).collect()}
    assert got == {"2024-01-01": 3, "2024-01-02": 3, "2024-01-04": 3}
    forgetful = drain_to_files(first_sightings(stream, "1 hour"), fresh_folder(spark, "s"))
    assert {str(r.date): r.conversations for r in daily_from_sightings(forgetful).collect()}["2024-01-01"] > 3


@pytest.mark.parametrize("query", ["stream_kpis", "stream_kpis_approx", "stream_dedup_append", "stream_enrich", "stream_daily_conversations"])
def test_a_table_that_is_a_folder_of_files(spark, tmp_path, query):
    """The messages of a folder of files, later ones in the first of them, are those of a single file; a table without rows has none."""
    from parley.plans import registry

    registry.load()
    events = [(c * 48 + t, START + timedelta(days=20 - c, minutes=t), c, "view", 1.0, "{}") for c in range(12) for t in range(3)]
    talks = [(c, t, ("user", "assistant")[t % 2], f"word {c}") for c in range(12) for t in range(3)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    rows = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    for i in range(12):
        rows.where(F.col("conv_id") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    found = registry.QUERIES[query](spark, str(tmp_path))
    counted = found.agg(F.sum("messages" if "kpis" in query else "conversations" if "daily" in query else F.lit(1))).first()[0]
    assert counted == (12 if "daily" in query else 36)
    rows.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert registry.QUERIES[query](spark, str(tmp_path)).count() == 0


def test_a_key_is_worked_off_with_a_bounded_number_of_state_calls():
    """However many of a key's attempts a micro-batch's watermark has passed, its state is read and written once."""
    calls = []

    class Handle:
        stored = None

        def getValueState(self, name, schema):
            return self

        def get(self):
            calls.append("get")
            return self.stored

        def update(self, value):
            calls.append("update")
            self.stored = value

        def clear(self):
            calls.append("clear")
            self.stored = None

        def registerTimer(self, at):
            calls.append("timer")

        def deleteTimer(self, at):
            calls.append("no timer")

    lockout = Lockout(3, 10**6)
    lockout.init(Handle())
    held = [{"us": us, "id": us, "ok": False} for us in range(500, 0, -1)]
    got = list(lockout.handleInputRows((7,), iter([{"held": held[:200]}, {"held": held[200:]}]), None))
    assert [(r.id, r.failures, r.refused) for r in got[:5]] == [(1, 1, False), (2, 2, False), (3, 3, False), (4, 3, True), (5, 3, True)]
    late = list(lockout.handleInputRows((7,), iter([{"held": [{"us": 10**6 + 2, "id": 900, "ok": True}]}]), None))
    assert len(got) == 500 and [(r.id, r.failures, r.refused) for r in late] == [(900, 0, False)]
    assert len(calls) <= 7
