"""Ranked search against the scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from parley.llm import ranked_search

from . import tables

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(documents, items, k):
    held = [(doc, Counter(terms(text))) for doc, text in documents]
    lengths = [sum(c.values()) for _, c in held]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        wanted = sorted(set(terms(text)))
        scored = []
        for (doc, c), length in zip(held, lengths):
            score = 0
            for t in wanted:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + (50 * length * n) // total)))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def check(spark, documents, items, k=50):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = ranked_search.ranked_search(docs, asked, k=k).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in found) == brute(documents, items, k)


def corpus(seed, count):
    draw = random.Random(seed)
    words = [w + x for w in tables.WORDS for x in ("", "s", "é")]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 60)))) for i in range(count)]


def test_against_all_scores(spark):
    documents = corpus(1, 700)
    items = [(i, documents[i * 7][1]) for i in range(20)] + [(100, "ant"), (101, "Ant, ANT! bee/toadé"), (102, "unheard of")]
    check(spark, documents, items)
    check(spark, documents, items, k=3)


def test_blocks_carry_their_scores(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCUMENTS", 40)
    documents = corpus(2, 600)
    check(spark, documents, [(i, documents[i * 5][1]) for i in range(10)], k=5)


def test_chunks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERIES", 3)
    documents = corpus(3, 120)
    check(spark, documents, [(i, documents[i][1]) for i in range(8)], k=4)


def test_awkward_rows(spark):
    documents = [(r[0], r[1]) for r in tables.rows()]
    items = [(1, tables.prose(1, 120)), (2, None), (3, ""), (4, " \n- "), (None, "one"), (5, "ein Wort €🙂 più"), (6, "x" * 30_000), (7, "antbee"), (7, "antbee"),
             (8, tables.prose(9, 9000))]
    check(spark, documents, items)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", tables.F.lit(0)).withColumn("terms", tables.F.lit(0))
    found = ranked_search.ranked_search(tables.documents(spark), asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert found.count() == sum(brute(documents, items, 50).values())
    assert ranked_search.ranked_search(tables.empty(spark), asked).count() == 0
    assert ranked_search.ranked_search(tables.documents(spark), asked.limit(0)).count() == 0


def test_ties_at_the_last_rank(spark):
    documents = [(i, "ant bee" if i % 2 else "ant cat") for i in range(200, 0, -1)] + [(None, "ant bee"), (500, "dog " * 30)]
    check(spark, documents, [(1, "bee"), (2, "ant"), (3, "ant bee cat"), (4, "dog")])


def test_a_query_stops_before_the_end_of_its_lists():
    draw = np.random.default_rng(5)
    documents, listed = 20_000, 3
    lengths = draw.integers(20, 400, documents)
    has = draw.random((documents, listed)) < 0.3
    has[has.sum(axis=1) == 0, 0] = True
    terms_ = np.nonzero(has)[1].astype(np.int32)
    times = np.minimum(draw.zipf(1.7, len(terms_)), 400).astype(np.int32)
    block = ranked_search.Block(lengths, has.sum(axis=1), terms_, times, listed, documents, int(lengths.sum()))
    weights = np.array([7000, 900, 300])
    query = np.arange(listed)
    none = np.empty(0, dtype=np.int64)
    found, scores, looked = block.best(query, weights, 50, none)
    dense = np.zeros((documents, listed), dtype=np.int64)
    dense[has] = block.impact
    every = dense @ weights
    order = np.lexsort((np.arange(documents), -every))[:50]
    mine = found[np.lexsort((found, -scores))[:50]]
    assert mine.tolist() == order.tolist()
    assert looked < documents / 2
    # what an earlier block has found lets it stop at once, and nothing of the last query stays behind
    assert block.best(query, weights, 50, np.full(50, every[order[25]]))[2] <= looked
    assert block.best(query, weights, 50, np.full(50, 10**6 * weights.sum()))[2] == 0
    assert not block.seen.any() and not block.met.any() and not block.weight.any()
