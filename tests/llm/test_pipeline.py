"""The pipeline's stages on awkward rows: columns stay, decisions take effect, each equals its brute force."""

import corpus_pipeline as pipeline
from parley.llm import queries
from parley.llm.common import written

from . import tables
from .test_quality import counts
from .test_similar import brute_classes, brute_lines, grams


def test_stages(spark):
    docs = tables.documents(spark)
    held = {}
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, ""), "test-stage")
        held[name] = out
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    good = {(r.doc_id, r.text) for r in held["quality rules"].collect()}
    assert good == {(r[0], r[1]) for r in tables.rows() if not counts(r[1])[5]}  # too few rows for estimates
    lines = brute_lines(list(good))
    texts = sorted(t for t in lines.values() if grams(t))
    found = [r.text for r in held["line dedup"].distinct().collect()]
    assert sorted(found) == texts
    rows = held["line dedup"].collect()
    roots, _ = brute_classes([r.text for r in rows])
    assert held["near duplicates"].count() == len(set(roots))
    assert held["source mix"].count() <= held["near duplicates"].count()
    assert {r.doc_id for r in held["packing"].collect()} == {r.doc_id for r in held["source mix"].collect()}


def test_empty_table(spark):
    docs = tables.empty(spark)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
