"""Shards and mixtures against plain Python."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from parley.llm import mixing, sharding
from parley.llm.mixing_sql import mixture_sql

from . import tables


def test_shards(spark):
    found = sharding.shard_documents(tables.documents(spark), shards=5).collect()
    sizes = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in tables.rows()]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter(sizes)
    slots, total = defaultdict(list), sum(s[1] for s in sizes)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r)
    last = (-1, -1)
    for shard in sorted(slots):
        held = sorted(slots[shard], key=lambda r: r.slot)
        assert [r.slot for r in held] == list(range(len(held)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in held]
        assert ids == sorted(ids) and ids[0] >= last[0]  # contiguous in the order of ids
        last = (ids[-1], shard)
        widest = max(r["size"] for r in held)
        assert abs(sum(r["size"] for r in held) - total / 5) <= widest + max(s[1] for s in sizes)
    assert sharding.shard_documents(tables.empty(spark)).count() == 0


def test_balance_and_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    same = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("abc").alias("text"))
    found = sharding.shard_documents(same, shards=8).groupBy("shard").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")
    ).collect()
    assert len(found) == 8
    for r in found:
        assert r.bytes == 1500 and r.last + 1 == r.n == r.slots


LEVELS = ("domain", "lang", "source")


def test_mixture_agrees_with_sql(spark):
    frame = tables.documents(spark, extra=False).withColumn(
        "domain", F.when(F.col("source") == "src0", "a").when(F.col("source") == "src1", "b")
    ).where("doc_id <> 400 or doc_id is null").where("doc_id is not null or lang = 'en'")
    weights = ({"a": 3, "b": 2}, {"en": 5}, {"src2": 4})
    for share, epochs in ((0.3, 1), (0.6, 3), (1.0, 2), (2.5, 2)):
        found = mixing.mix_documents(frame, LEVELS, weights, share, epochs, seed=3).collect()
        documents = frame.toPandas().astype({"doc_id": "Int64"})  # noqa: F841  read by name below
        con = duckdb.connect()
        con.register("docs_in", documents)
        sql = mixture_sql("SELECT doc_id, text, domain, lang, source FROM docs_in", LEVELS, weights, share, epochs, 3)
        want = con.execute(sql).fetchall()
        plain = lambda row: tuple(None if v is None or v != v else v for v in row)
        assert sorted(map(repr, map(plain, found))) == sorted(map(repr, map(plain, want)))


def test_shortage_goes_to_siblings_first(spark):
    # a has two languages; its small one runs out, and the other takes over before b gets more
    rows = [(i, "w " * 10, "a", "x", "s") for i in range(2)]
    rows += [(10 + i, "w " * 10, "a", "y", "s") for i in range(40)]
    rows += [(100 + i, "w " * 10, "b", "x", "s") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    drawn = mixing.mix_documents(frame, LEVELS, ({}, {}, {}), share=0.5, epochs=1).groupBy("domain", "lang").agg(
        F.sum("n_taken").alias("n")
    ).collect()
    assert {(r.domain, r.lang): r.n for r in drawn} == {("a", "x"): 20, ("a", "y"): 185, ("b", "x"): 205}


def test_a_leaf_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), *[F.lit("v").alias(c) for c in LEVELS])
    found = mixing.mix_documents(frame, LEVELS, ({}, {}, {}), share=1.35, epochs=4, seed=1)
    taken = found.groupBy("epoch").agg(F.sum("n_taken").alias("n")).orderBy("epoch").collect()
    assert [r.n for r in taken] == [9000, 3150]
    other = mixing.mix_documents(frame, LEVELS, ({}, {}, {}), share=1.35, epochs=4, seed=2)
    assert other.where("epoch = 1").join(found.where("epoch = 1"), "doc_id").count() < 1050


def test_keep_drawn_and_empty(spark):
    frame = tables.documents(spark)
    kept = mixing.keep_drawn(frame, ("lang", "source"), ({"en": 2}, {}), share=0.5)
    assert kept.columns == frame.columns
    assert 0 < kept.count() < frame.count()
    assert mixing.mix_documents(tables.empty(spark), ("lang", "source"), ({}, {})).count() == 0
    assert mixing.keep_drawn(tables.empty(spark), ("lang", "source"), ({}, {})).count() == 0


@pytest.mark.parametrize("budget,want", [(30, [10, 10, 10]), (70, [10, 20, 40]), (100, [10, 20, 50])])
def test_filled(spark, budget, want):
    nodes = spark.createDataFrame(
        [("p", f"c{i}", c, budget, 1) for i, c in enumerate((10, 20, 50))], "parent string, node string, capacity long, budget long, weight int"
    )
    found = {r.node: r.given for r in mixing.filled(nodes, ["parent"]).collect()}
    assert [found[f"c{i}"] for i in range(3)] == want
