"""Quality rules: counts against plain Python, robust estimates against numpy."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parley.llm import quality_rules as rules

from . import tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    word = WORD.findall(text)
    windows = [tuple(word[i: i + 5]) for i in range(len(word) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(word) < 10 or 100 * len(covered) > 20 * len(word)
    return len(word), sum(map(len, word)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_counts(spark):
    draw = random.Random(2)
    rows = tables.rows()
    rows += [(600 + i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 40))), "en", "src0", 0) for i in range(60)]
    rows += [(700 + i, "".join(draw.choice("a# \n\t\r\x0b\x85é🙂") for _ in range(30)), "en", "src0", 0) for i in range(40)]
    frame = spark.createDataFrame(rows, tables.SCHEMA).withColumn("n_words", F.lit("x"))
    found = Counter(tuple(r)[:7] for r in rules.quality_verdicts(frame).collect())
    assert found == Counter((r[0], *counts(r[1])) for r in rows)


def numpy_verdicts(rows, least_rows, share=0.75, steps=6):
    """The same estimate with numpy, for one cell of (statistics) rows."""
    x = np.array(rows, dtype=np.float64)
    floors = np.array([rules.SPREADS[s] * rules.SCALE for s in rules.STATISTICS])

    def quantile(values, q):
        return np.sort(values)[max(0, math.ceil(q * len(values)) - 1)]

    mean = np.array([quantile(c, 0.5) for c in x.T])
    wide = np.array([(quantile(c, 0.75) - quantile(c, 0.25)) / 1.349 for c in x.T])
    factor = np.diag(np.maximum(wide, floors))

    def classes():
        solved = np.linalg.solve(factor, (x - mean).T)
        return np.clip(np.floor(np.log2((solved**2).sum(axis=0) + 1e-9) * 8), rules.LOWEST, rules.HIGHEST)

    for _ in range(steps):
        c = classes()
        order = np.sort(c)
        inner = x[c <= order[math.ceil(len(x) * share) - 1]]
        mean = inner.mean(axis=0)
        cover = inner.T @ inner / len(inner) - np.outer(mean, mean)
        factor = np.linalg.cholesky(cover + np.diag(floors**2))
    middle = np.sort(classes())[(len(x) + 1) // 2 - 1]
    factor = factor * math.sqrt(max(2 ** ((middle + 0.5) / 8) / rules.CHI_MEDIAN, 1.0))
    return mean, (np.linalg.solve(factor, (x - mean).T) ** 2).sum(axis=0)


def test_robust_distances_agree_with_numpy(spark):
    draw = random.Random(4)
    rows = [(i, tables.prose(i, draw.randint(10, 200)), "en", "src0", 0) for i in range(300)]
    rows += [(1000 + i, tables.prose(i, 60).replace(" ", "%%% "), "en", "src0", 0) for i in range(30)]
    frame = spark.createDataFrame(rows, tables.SCHEMA)
    counted = rules.text_counts(frame.select("doc_id", "lang", "source", "text"))
    values = counted.where(~rules.base_failed()).select("doc_id", *rules.statistics()).orderBy("doc_id").collect()
    found = {r.doc_id: r for r in rules.quality_verdicts(frame, least_rows=50).collect()}
    _, far = numpy_verdicts([r[1:] for r in values], 50)
    for r, d in zip(values, far):
        assert math.isclose(found[r.doc_id].distance, d, rel_tol=1e-6, abs_tol=1e-6)
        assert found[r.doc_id].kept == (d <= rules.CUTOFF)
    assert not any(found[1000 + i].kept for i in range(30)) and sum(found[i].kept for i in range(300)) > 290


def test_words_are_counted_without_a_second_pass_over_the_text(spark):
    texts = [None, "", " ", "one", " \x0b one\ttwo\r\n three ", "a\x1cb \u3000 c\x85", "€🙂 più " * 3, "a b c d e " * 4]
    counted = rules.text_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "regexp_replace" not in counted._jdf.queryExecution().optimizedPlan().toString()
    for r in counted.collect():
        parts = [w for w in re.split("[ \t\n\x0b\x0c\r]+", r.text or "") if w]
        assert (r.n_words, r.word_chars) == (len(parts), sum(map(len, parts)))


def test_cells_pool_small_groups(spark):
    rows = [("en", "a")] * 10 + [("en", "b")] * 3 + [("en", None)] * 4 + [("de", "a")] * 2 + [(None, "a")] * 2
    frame = spark.createDataFrame(rows, "lang string, source string")
    found = {(r.lang, r.source): r.cell for r in rules.cells(frame, 5).collect()}
    assert found["en", "b"] == found["en", None] != found["en", "a"]
    assert found["de", "a"] == found[None, "a"] == "[]"


def test_keep_good(spark):
    frame = tables.documents(spark)
    kept = rules.keep_good(frame, least_rows=10)
    assert kept.columns == frame.columns
    verdicts = rules.quality_verdicts(frame, least_rows=10).collect()
    assert kept.count() == sum(r.kept for r in verdicts)
    assert rules.quality_verdicts(tables.empty(spark)).count() == 0
    assert rules.keep_good(tables.empty(spark)).count() == 0


def test_a_document_extreme_in_one_statistic_is_rejected(spark):
    """Everything else is ordinary, the base rules pass, and the group itself has no repeats, duplicates or symbols."""
    draw = random.Random(6)
    fresh = (f"w{i}abc" for i in range(10**6))  # words that occur once

    def text(words, per_line=12):
        held = [next(fresh) for _ in range(words)]
        return "\n".join(" ".join(held[i: i + per_line]) for i in range(0, words, per_line))

    passage = [next(fresh) for _ in range(57)]
    filler = [next(fresh) for _ in range(486)]
    extreme = {
        1000: text(40_000),  # length
        1001: text(130).replace("abc", "abc" * 20),  # word length
        1002: text(130).replace("abc", "a%%"),  # symbols
        1003: "\n".join(text(5) + "\nso it goes" for _ in range(30)),  # duplicate lines between unique ones
        1004: " ".join(passage + filler + passage),  # repeats just below a fifth
    }
    ordinary = {i: text(draw.randint(90, 180)) for i in range(300)}
    rows = [(i, t, "en", "src0", 0) for i, t in {**ordinary, **extreme}.items()]
    found = {r.doc_id: r for r in rules.quality_verdicts(spark.createDataFrame(rows, tables.SCHEMA)).collect()}
    assert not any(r.base_failed for r in found.values())
    assert {i for i, r in found.items() if not r.kept} == set(extreme)


def test_a_pool_that_is_too_small_is_judged_by_its_language_or_the_table(spark):
    junk = lambda i: tables.prose(i, 60).replace(" ", "%%% ")
    rows = [(i, tables.prose(i, 40 + i % 90), "en", "src0", 0) for i in range(120)]
    small = [("en", "src1"), ("fr", "src0"), (None, None)]
    for k, (lang, source) in enumerate(small):
        rows += [(1000 + 10 * k + i, tables.prose(900 + 10 * k + i, 60), lang, source, 0) for i in range(5)]
        rows.append((2000 + k, junk(k), lang, source, 0))
    found = {r.doc_id: r.kept for r in rules.quality_verdicts(spark.createDataFrame(rows, tables.SCHEMA), least_rows=50).collect()}
    assert [found[2000 + k] for k in range(len(small))] == [False] * len(small)
    assert all(kept for i, kept in found.items() if i < 2000)
