"""Indexed search against all pairs, and how many tiles it leaves out."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import similarity, vector_index

CORPUS = "id long, timestamp timestamp, embedding_vector array<double>"
QUERIES = "query_id long, vector array<double>"


def brute(corpus, queries, limit, least):
    out = set()
    for q, asked in queries:
        found = []
        for i, at, v in corpus:
            if asked is None or v is None or len(asked) != 8 or len(v) != 8 or None in v:  # the index is of one length
                continue
            scale = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in asked))
            if scale and (s := sum(x * y for x, y in zip(v, asked)) / scale) > least:
                found.append((-round(s, 9), -at.timestamp(), -i))
        out |= {(q, rank, -i, round(-s, 6)) for rank, (s, _, i) in enumerate(sorted(found)[:limit], 1)}
    return out


def clustered(seed, count, width=8, centres=6, spread=0.15):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, width))
    start = datetime(2024, 1, 1)
    return [
        (i, start + timedelta(minutes=i % 97), (middle[i % centres] * draw.uniform(0.2, 5) + spread * draw.normal(size=width)).tolist()) for i in range(count)
    ]


def search(spark, tmp_path, corpus, queries, limit, least, block, pivots=16):
    path = str(tmp_path / f"index-{len(corpus)}-{block}-{least}-{pivots}")
    frame = spark.createDataFrame(corpus, CORPUS).repartition(3)
    vector_index.build_index(frame, path, width=8, pivots=pivots)
    found = vector_index.similar_in_index(spark, path, spark.createDataFrame(queries, QUERIES), limit, least, block)
    return path, {(r.query_id, r.rank, r.id, round(r.similarity, 6)) for r in found.collect()}


def awkward(corpus):
    at = corpus[0][1]
    more = [None, [0.0] * 8, [1.0, 2.0], [None] + [1.0] * 7, []]
    copies = [(6000 + i, at, corpus[5][2]) for i in range(7)]  # ties: newest first, then the higher id
    return corpus + [(5000 + i, at, v) for i, v in enumerate(more)] + copies


@pytest.mark.parametrize("least", [0.0, 0.5, 0.9, 0.999])
def test_the_same_rows_as_all_pairs(spark, tmp_path, least):
    corpus = awkward(clustered(1, 400))
    queries = [(i, corpus[i * 9][2]) for i in range(40)] + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0]), (903, [-x for x in corpus[3][2]])]
    assert search(spark, tmp_path, corpus, queries, 5, least, 8)[1] == brute(corpus, queries, 5, least)


def test_blocks_that_cannot_hold_a_hit_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 16)
    corpus = clustered(2, 1200, centres=12, spread=0.05)
    queries = [(i, corpus[i][2]) for i in range(0, 120)]
    path, found = search(spark, tmp_path, corpus, queries, 3, 0.9, 10, pivots=24)
    assert found == brute(corpus, queries, 3, 0.9)
    blocks = vector_index.query_blocks(spark.createDataFrame(queries, QUERIES), vector_index._pivots(spark, path), 10)
    tiles = vector_index.paired(spark, path, blocks, 0.9).count()
    every = spark.read.parquet(f"{path}/blocks").count() * blocks.select("number").distinct().count()
    assert 0 < tiles < every / 4


def test_an_empty_index_and_no_queries(spark, tmp_path):
    corpus = clustered(3, 50)
    assert search(spark, tmp_path, corpus[:0] + [(1, corpus[0][1], None)], [(1, corpus[0][2])], 3, 0.5, 4)[1] == set()
    path, _ = search(spark, tmp_path, corpus, [(1, corpus[0][2])], 3, 0.5, 4)
    none = spark.createDataFrame([], QUERIES)
    assert vector_index.similar_in_index(spark, path, none).count() == 0
    with pytest.raises(ValueError):
        vector_index.similar_in_index(spark, path, none, min_similarity=-0.1)


def test_queries_beyond_the_broadcast_limit_have_no_hot_key(spark, tmp_path):
    """With a limit of nothing the queries are dealt over parts: no join key holds more than its share."""
    corpus = awkward(clustered(4, 300))
    queries = [(i, corpus[i * 7][2]) for i in range(30)]
    want = brute(corpus, queries, 4, 0.6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16b")
        frame, asked = spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(queries, QUERIES)
        found = similarity.similar_ids(frame.repartition(12), asked, 4, 0.6, 1024)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "part#" in plan
        assert {(r.query_id, r.rank, r.id, round(r.similarity, 6)) for r in found.collect()} == want
        packed = spark.range(4000).select(F.array("id").alias("id"), F.lit(0).alias("block"))
        grouped = spark.createDataFrame([(0, "queries")], "block int, asked string")
        dealt = similarity.beside(packed, grouped, "block", 10**9)
        assert dealt.count() == 4000
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shares = packed.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts))).count().collect()
        assert max(r["count"] for r in shares) < 2 * 4000 / parts
        assert search(spark, tmp_path, corpus, queries, 4, 0.6, 7)[1] == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks_of_queries_do_not_copy_the_rows(spark, tmp_path):
    """Dealt queries meet a row in the task that holds them: rows are shuffled once a group, however small the blocks of queries are."""
    corpus = awkward(clustered(5, 300))
    queries = [(i, corpus[i * 7][2]) for i in range(30)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16b")
        frame, asked = spark.createDataFrame(corpus, CORPUS).repartition(12), spark.createDataFrame(queries, QUERIES)
        found = similarity.similar_ids(frame, asked, 4, 0.6, 1)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.query_id, r.rank, r.id, round(r.similarity, 6)) for r in found.collect()} == brute(corpus, queries, 4, 0.6)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_task_emits_its_best_rows_only(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(similarity, "HELD_HITS", 5)
    asked = pa.array([{"query_id": q, "vector": [1.0, float(q)], "number": q % 2} for q in range(4)])
    hits = similarity.Hits(asked, 3, 0.1, 1)
    out = []
    for n in range(20):  # copies: the newest, then the highest id
        block = {"id": [2 * n, 2 * n + 1], "micros": [n // 2, None], "vector": [[1.0, 0.5]] * 2, "numbers": [1]}
        out += hits.meet({c: pa.scalar(v, pa.list_(pa.list_(pa.float64()) if c == "vector" else pa.int64())) for c, v in block.items()})
    out += hits.end()
    rows = [r for batch in out for r in batch.to_pylist()]
    assert [(r["query_id"], r["id"]) for r in rows] == [(q, i) for q in (1, 3) for i in (38, 36, 34)]
