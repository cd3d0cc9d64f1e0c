"""Groups larger than a task should hold: sliced operators against plain reference loops."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from parley.operators.conversations import derive_response_time
from parley.operators.lockout import failure_lockout
from parley.operators.similarity import nearest_labels, similar_ids, similar_messages
from parley.operators.slices import first_rows

START = datetime(2024, 1, 1)


def _attempts(seed, count):
    """A third of all rows belong to key 0."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        key = 0 if rng.random() < 0.34 else rng.randrange(1, 20)
        at = START + timedelta(seconds=rng.randrange(0, 40_000))
        rows.append((i, key, at, rng.random() < 0.15))
    return rows


def test_lockout_of_a_hot_key_matches_a_loop(spark):
    rows = _attempts(1, 4000)
    frame = spark.createDataFrame(rows, "id long, user_id long, ts timestamp, ok boolean")
    got = {r.id: (r.failures, r.locked) for r in failure_lockout(frame, "user_id", slice_width=timedelta(minutes=20)).collect()}
    want = {}
    for key in range(20):
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        streak, streaks = 0, []
        for r in mine:
            streak += r[3]
            streaks.append((r, streak))
        for r, s in streaks:
            if r[3]:
                continue
            n = sum(1 for q, t in streaks if t == s and not q[3] and timedelta(0) <= r[2] - q[2] < timedelta(minutes=15))
            want[r[0]] = (n, n >= 5)
    assert got == want


def test_response_time_of_a_hot_conversation_matches_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        conv = 0 if rng.random() < 0.34 else rng.randrange(1, 50)
        # many equal timestamps, so the id has to break ties
        at = START + timedelta(seconds=60 * rng.randrange(0, 600))
        rows.append((i, conv, at, rng.choice(["customer", "admin", "system"])))
    frame = spark.createDataFrame(rows, "id long, conversation_id long, timestamp timestamp, sender_type string")
    got = {r.id: r.response_time for r in derive_response_time(frame).collect()}
    assert got == {r.id: r.response_time for r in derive_response_time(frame, "minute").collect()}
    want = {}
    for conv in range(50):
        before = None
        for r in sorted((r for r in rows if r[1] == conv), key=lambda r: (r[2], r[0])):
            answered = before is not None and r[3] == "admin" and before[3] == "customer"
            want[r[0]] = int((r[2] - before[2]).total_seconds()) if answered else None
            before = r
    assert got == want


def test_first_rows_are_cut_before_the_shuffle(spark):
    frame = spark.range(10_000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97))
    top = first_rows(frame, ["k"], [F.col("id").desc()], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert {r.id for r in top.filter("k = 0").collect()} == {9999, 9996, 9993}


def _vectors(spark, count, width=8, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(count, width))
    rows = [(i, START + timedelta(seconds=i % 50), [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(count, START, [0.0] * width), (count + 1, START, [1.0] * (width - 1)), (count + 2, START, None)]
    return data, spark.createDataFrame(rows, "id long, timestamp timestamp, embedding_vector array<double>")


def _brute(data, queries, limit, threshold):
    want = {}
    for name, q in queries:
        sims = data @ q / (np.linalg.norm(data, axis=1) * np.linalg.norm(q))
        ranked = sorted((-s, -(i % 50), -i) for i, s in enumerate(sims) if s > threshold)
        want[name] = [-i for _, _, i in ranked[:limit]]
    return want


def test_search_matches_brute_force_in_one_block_and_in_many(spark):
    data, corpus = _vectors(spark, 500)
    rng = np.random.default_rng(4)
    queries = [(f"q{i}", rng.normal(size=8)) for i in range(40)]
    frame = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in queries], "query_id string, vector array<double>")
    want = _brute(data, queries, 5, 0.5)
    for block in (1024, 10):
        got = {}
        for r in similar_ids(corpus.repartition(4), frame, 5, 0.5, block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {k: v for k, v in want.items() if v}


def test_search_candidates_and_text(spark):
    data, corpus = _vectors(spark, 60)
    table = corpus.select(
        "*",
        F.lit("customer").alias("sender_type"),
        F.col("id").alias("conversation_id"),
        F.concat(F.lit("m"), "id").alias("message"),
    )
    query = spark.createDataFrame([(1, [float(x) for x in data[7]])], "query_id int, vector array<double>")
    best = similar_messages(table, query, limit=1).first()
    assert (best.id, best.message, best["rank"]) == (7, "m7", 1)
    # row 7 is not among the newest ten
    assert 7 not in [r.id for r in similar_messages(table, query, min_similarity=-1.1, candidates=10).collect()]


def test_nearest_label_ties_take_the_highest(spark):
    _, corpus = _vectors(spark, 5)
    labelled = spark.createDataFrame([("a", [1.0] * 8), ("b", [2.0] * 8)], "label string, vector array<double>")
    for block in (1024, 1):
        got = nearest_labels(corpus, labelled, block).collect()
        assert len(got) == 7 and {r.label for r in got} == {"b"}


def test_first_rows_of_a_hot_key_are_dealt_over_parts(spark, monkeypatch):
    from parley.operators import slices

    monkeypatch.setattr(slices, "PART_ROWS", 500)
    frame = spark.range(30_000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id").union(
        spark.createDataFrame([(None, 5), (None, 6)], "k int, id long")
    )
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    try:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
        found = slices.first_rows(frame, ["k"], [F.col("id").desc()], 4).collect()
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)
    want = {(1, r, 29_997 - 3 * (r - 1)) for r in (1, 2, 3, 4)} | {(0, r, i) for r, i in enumerate((29_999, 29_998, 29_996, 29_995), 1)}
    assert {(r.k, r["rank"], r.id) for r in found} == want | {(None, 1, 6), (None, 2, 5)}


def test_a_hot_hour_is_cut_by_itself_and_scanned_once(spark, tmp_path, monkeypatch):
    from parley.operators import slices

    folders = []
    monkeypatch.setattr(slices, "fresh_folder", lambda *_: folders.append(str(tmp_path / f"ordered{len(folders)}")) or folders[-1])
    draw = random.Random(12)
    start, rows = datetime(2024, 5, 1, 9), []
    for i in range(20_000):  # a third of the table is one conversation within an hour
        hot = i % 3 == 0
        at = start + timedelta(microseconds=draw.randrange(3_600_000_000) if hot else draw.randrange(10**12))
        rows.append((i, "hot" if hot else f"c{i % 50}" if i % 200 else None, draw.choice(["customer", "admin", "system"]), at, None if i % 7 else 3))
    path = str(tmp_path / "messages")
    frame = spark.createDataFrame(rows, "id long, conversation_id string, sender_type string, timestamp timestamp, response_time int")
    frame.repartition(6).write.parquet(path)
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share a task
        found = derive_response_time(spark.read.parquet(path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    got = {r.id: r.response_time for r in found.collect()}
    want, last = {}, {}
    for i, c, kind, at, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        asked = last.get(c)
        want[i] = int((at - asked[1]).total_seconds()) if kind == "admin" and asked and asked[0] == "customer" else None
        last[c] = (kind, at)
    assert got == want and found.columns == ["id", "conversation_id", "sender_type", "timestamp", "response_time"]
    looked = spark.read.parquet(folders[0])
    shares = {r["_part"]: r["count"] for r in looked.where("conversation_id = 'hot'").groupBy("_part").count().collect()}
    assert len(shares) >= 3 and max(shares.values()) < 0.6 * len(rows) / 3
    assert found._jdf.queryExecution().executedPlan().toString().count(path) == 0  # what is read is what the one scan has written
    sliced = derive_response_time(spark.read.parquet(path), "minute")
    assert {r.id: r.response_time for r in sliced.collect() if r.conversation_id} == {i: v for i, v in want.items() if rows[i][1]}
    assert derive_response_time(spark.read.parquet(path).limit(0)).count() == 0
