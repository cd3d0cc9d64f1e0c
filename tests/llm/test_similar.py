"""Similar documents and lines against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from parley.llm import line_dedup, ngram_join

from . import tables


def grams(text, n=5):
    parts = (text or "").lower().encode().split()
    n = min(n, len(parts))
    return {tuple(parts[i: i + n]) for i in range(len(parts) - n + 1)} if parts else set()


def brute_classes(texts):
    """Per row (index): links and the least row of its component."""
    sets = [grams(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], links


def check(spark, pairs, **settings):
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    found = ngram_join.similar_classes(frame, **settings).collect()
    roots, links = brute_classes([t for _, t in pairs])
    least = {}
    for (doc, _), r in zip(pairs, roots):
        ids = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(ids) if ids else None
    want = Counter((doc, least[r] if grams(t) else doc, n) for (doc, t), r, n in zip(pairs, roots, links))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == want


def test_classes_of_awkward_rows(spark):
    check(spark, [(r[0], r[1]) for r in tables.rows()])


def test_a_hot_group_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # the driver plans with it; tiles carry their blocks
    base = tables.prose(4, 90)
    pairs = [(i, tables.changed(base, i, i % 7)) for i in range(120)] + [(1000 + i, tables.prose(1000 + i, 60)) for i in range(40)]
    check(spark, pairs)


def test_keep_one(spark):
    frame = tables.documents(spark)
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    rows = [(r[0], r[1]) for r in tables.rows()]
    roots, _ = brute_classes([t for _, t in rows])
    classes = len({r for r, (_, t) in zip(roots, rows) if grams(t)})
    found = kept.collect()
    assert sum(bool(grams(r.text)) for r in found) == classes
    wordless = {(r[0], r[1]) for r in rows if not grams(r[1])}
    assert {(r.doc_id, r.text) for r in found if not grams(r.text)} == wordless
    assert 100 not in {r.doc_id for r in found} or 200 not in {r.doc_id for r in found}
    assert ngram_join.keep_one(tables.empty(spark)).count() == 0
    assert ngram_join.similar_classes(tables.empty(spark)).count() == 0


def test_band_plan_reaches_its_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.band_plan(threshold, 0.999)
        assert bands * rows <= 128 and 1 - (1 - threshold**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        ngram_join.band_plan(0.1, 0.9999, hashes=4)


def test_common_counts():
    draw = np.random.default_rng(2)
    sets = [np.unique(draw.integers(0, 60, 40).astype(np.uint64)) for _ in range(20)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = ngram_join.common_counts(sets, wide=7)
    assert all(got[i, j] == want[i][j] for i in range(20) for j in range(20) if i != j)


def shingle_set(line, width=12):
    return {line[i: i + width] for i in range(max(0, len(line) - width) + 1)}


def brute_lines(pairs):
    """The texts that stay, by all pairs of lines. ``pairs`` hold distinct documents."""
    places = {}
    ordered = sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0))
    for doc, text in ordered:
        for at, line in enumerate((text or "").split("\n")):
            if core := line.strip(" \t\r\x0b\x0c"):
                places.setdefault(core, []).append((doc, text, at))
    lines = list(places)
    sets, root = [shingle_set(x) for x in lines], list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups, drop = {}, set()
    for i, line in enumerate(lines):
        groups.setdefault(find(i), []).extend(places[line])
    for held in groups.values():
        held.sort(key=lambda p: (p[0] is None, p[0] or 0, p[2]))
        drop.update(held[1:])
    return {
        (doc, text): text and "\n".join(x for at, x in enumerate(text.split("\n")) if (doc, text, at) not in drop)
        for doc, text in pairs
    }


def test_lines_against_all_pairs(spark):
    draw = random.Random(8)
    base = [tables.prose(900 + i, 12) for i in range(30)]
    pairs = []
    for doc in range(60):
        held = [tables.changed(draw.choice(base), draw.randrange(10**6)) if draw.random() < 0.5 else draw.choice(base) for _ in range(4)]
        held += [tables.prose(5000 + doc, 14), "", "  Common line of all  ", "x"]
        pairs.append((doc, "\n".join(held)))
    pairs += [(90, None), (91, ""), (92, "\n\n"), (None, "Common line of all\nown line of none")]
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    found = line_dedup.dedup_lines(frame, counts=True).collect()
    want = brute_lines(pairs)
    originals = dict(pairs)
    wrong = [(r.doc_id, r.text, want[r.doc_id, originals[r.doc_id]]) for r in found if r.text != want[r.doc_id, originals[r.doc_id]]]
    assert not wrong, wrong[:2]
    assert len(found) == len(pairs)


def test_lines_of_awkward_rows(spark):
    frame = tables.documents(spark)
    out = line_dedup.dedup_lines(frame)
    assert out.columns == frame.columns
    found = out.collect()
    assert len(found) == len(tables.rows())
    same = {r.text for r in found if r.doc_id == 400}
    assert len(same) == 2  # equal rows alike, the other text of its own
    by_id = {r.doc_id: r for r in found}
    assert by_id[300].text is None and by_id[301].text == "" and by_id[302].text == " \n\t "
    assert by_id[502].text.count("same line here") == 1 and "€🙂" in by_id[502].text
    assert by_id[501].text == "x" * 30_000 and by_id[501].n_chars == 30_000
    assert [len(by_id[200 + i].text) for i in range(1, 6)] == [0] * 5
    assert line_dedup.dedup_lines(tables.empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    from parley.llm.common import components

    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(50)]
    draw = random.Random(1)
    edges = chain + star + [(7, 7)]
    draw.shuffle(edges)
    frame = spark.createDataFrame([(a, b) if draw.random() < 0.5 else (b, a) for a, b in edges], "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1051), 1000)}
    assert components(frame.limit(0)).count() == 0


def test_components_write_no_round_that_changes_nothing(spark, monkeypatch):
    from parley.llm import common

    kept, labels = common.written, []
    monkeypatch.setattr(common, "written", lambda frame, label, *rest: (labels.append(label), kept(frame, label, *rest))[1])
    stars = spark.createDataFrame([(5, 1), (1, 6), (9, 8)], "a long, b long")
    assert {tuple(r) for r in common.components(stars, "stars").collect()} == {(1, 1), (5, 1), (6, 1), (8, 8), (9, 8)}
    assert common.components(stars.where("a = 77"), "none").count() == 0
    assert labels == ["stars", "stars", "none"]


def test_signature_sees_every_part_of_a_long_line(spark):
    long = tables.prose(5, 4000).replace("\n", " ")
    near = tables.changed(long, 1, 5)
    frame = spark.createDataFrame([(1, long), (2, near)], "doc_id long, text string")
    assert [r.text for r in line_dedup.dedup_lines(frame).orderBy("doc_id").collect()] == [long, ""]


def test_key_filter_lets_no_partner_go(spark, monkeypatch):
    from pyspark.sql import functions as F

    from parley.llm import common

    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    rows = spark.range(3000).select("id", F.lit("x").alias("text"))
    for words in (common.FILTER_WORDS, 1):  # one word is full: everything may have a partner
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        found = common.likely_in(rows, [F.col("id")], keys, [F.col("k")])
        assert found.columns == ["id", "text", "_likely"]
        likely = {r.id for r in found.where("_likely").collect()}
        assert set(range(0, 3000, 3)) <= likely
        assert len(likely) < 1100 if words > 1 else len(likely) == 3000
    assert common.likely_in(rows, [F.col("id")], keys.limit(0), [F.col("k")]).where("_likely").count() == 0


def test_lines_with_a_full_filter(spark, monkeypatch):
    from parley.llm import common

    frame = spark.createDataFrame(tables.rows(), tables.SCHEMA)
    once = sorted(map(repr, line_dedup.dedup_lines(frame).collect()))
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    assert sorted(map(repr, line_dedup.dedup_lines(frame).collect())) == once


def test_short_lines_with_an_edit_against_all_pairs(spark):
    """An edit at the start, in the middle or at the end of lines of two to eight words, long ones and short ones."""
    draw = random.Random(3)
    lines = ["International cooperation requires patience", "International cooperation requires patience."]
    for words in range(2, 9):
        for least in (1, 3):
            for _ in range(6):
                line = " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(4, 6) * least)) for _ in range(words))
                middle = len(line) // 2
                lines += [line, "!" + line, line[1:], line[:middle] + "!" + line[middle + 1:], line + "!", line[:-1]]
    sets = [shingle_set(x) for x in lines]
    short = sum(len(a & b) >= 0.8 * len(a | b) for a, b, x in zip(sets, sets[1:], lines) if x.count(" ") < 4)
    assert short > 40
    pairs = list(enumerate(lines))
    want = brute_lines(pairs)
    found = line_dedup.dedup_lines(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    wrong = [(r.doc_id, lines[r.doc_id], r.text) for r in found if r.text != want[r.doc_id, lines[r.doc_id]]]
    assert len(found) == len(lines) and not wrong, wrong[:3]


def test_band_recall_is_that_of_drawn_orders():
    draw = np.random.default_rng(5)
    for similarity in (0.5, 0.8):
        shared = draw.random((100_000, 10)) < similarity
        assert abs((shared[:, 1:] & shared[:, :-1]).any(axis=1).mean() - line_dedup.band_recall(similarity, 10)) < 0.005
    assert line_dedup.band_recall(0.8, 10) > 0.998 and line_dedup.band_recall(0.9, 10) > 0.9999


def test_templates_are_found_in_proportion(spark, monkeypatch):
    """Lines of one template, none of them like another: they share bands in large groups and must not be compared in pairs."""
    monkeypatch.setattr(line_dedup, "SMALL", 64)
    compared = {}
    kept = line_dedup.open_pairs

    def counted(*arguments):
        found = kept(*arguments).cache()
        compared[len(compared)] = found.count()
        return found

    monkeypatch.setattr(line_dedup, "open_pairs", counted)
    draw = random.Random(11)
    template = "All rights reserved by the publisher, first issued in this form in the year"
    lines = [template + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(45)) for _ in range(20_000)]
    for size in (20_000,):
        rows = list(enumerate(lines[:size])) + [(90_000, lines[7] + "!"), (90_001, "!" + lines[9])]
        out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True)
        assert {r.doc_id for r in out.where("n_dropped > 0").collect()} == {90_000, 90_001}
    assert compared[0] < 20_000  # of 2 * 10^8


def test_groups_that_no_star_closes(spark, monkeypatch):
    """Small and large open bands: chains of lines, each like its neighbours only."""
    text = tables.prose(3, 900).replace("\n", " ")
    chain = [text[25 * i: 25 * i + 300] for i in range(150)]
    pairs = [(i, line) for i, line in enumerate(chain)] + [(1000 + i, tables.prose(50 + i, 12)) for i in range(40)]
    want = brute_lines(pairs)
    for small in (0, 4, 2048):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        found = line_dedup.dedup_lines(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
        assert {(r.doc_id, r.text) for r in found} == {(doc, want[doc, line]) for doc, line in pairs}


def test_a_pair_of_many_common_bands_is_made_once(spark):
    from pyspark.sql import functions as F

    base = tables.prose(2, 60).replace("\n", " ")
    lines = [tables.changed(base, i, 1 + i % 5) for i in range(40)] + [tables.prose(70 + i, 20).replace("\n", " ") for i in range(10)]
    frame = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "l1 long, l2 long, line string")
    texts = frame.withColumn("node", line_dedup.node_of())
    number = {r.node: r.l1 for r in texts.collect()}
    marks = line_dedup.marked(texts, 12)
    root = F.when(F.col("l1") < 4, F.lit(0)).otherwise(F.col("node")).cast("decimal(38,0)")  # four of one component, the largest
    few = texts.select(
        F.explode(F.array(*[F.lit(i).cast("long") for i in range(8)])).alias("band"), "node", root.alias("root"),
        F.lit(0).cast("decimal(38,0)").alias("major"),
    )
    found = Counter((number[r.a], number[r.b]) for r in line_dedup.direct_pairs(few, marks, 0.8).collect())
    sets = [shingle_set(x) for x in lines]
    similar = {
        (i, j) for i in range(len(lines)) for j in range(i) if i >= 4 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    }
    assert len(similar) > 50 and similar <= set(found) and max(found.values()) == 1


def test_verified_counts_no_set_again(spark):
    lines = ["short", "short", "x" * 30, "x" * 40, "a line of some words", "a line of some words!", "", "€🙂 più di dodici segni", "0123456789ab"]
    frame = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "l1 long, l2 long, line string")
    texts = frame.withColumn("node", line_dedup.node_of())
    number = {r.node: r.l1 for r in texts.collect()}
    got = {r.l1: set(r.s) for r in texts.select("l1", line_dedup.shingles(texts["line"], 12).alias("s")).collect()}
    assert [len(got[i]) for i in range(len(lines))] == [len(shingle_set(x)) for x in lines]
    nodes = sorted(number)
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes if a > b], "a decimal(38,0), b decimal(38,0)")
    met = line_dedup.may_meet(pairs, line_dedup.marked(texts, 12), 0.5)
    found = line_dedup.verified(spark.createDataFrame(met.collect(), met.schema), texts, 12, 0.5)
    assert "array_distinct" not in found._jdf.queryExecution().optimizedPlan().toString()  # sizes come with the sketches
    sets = {n: shingle_set(lines[number[n]]) for n in nodes}
    assert {(r.a, r.b) for r in found.collect()} == {
        (a, b) for a in nodes for b in nodes if a > b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])
    }


def test_prefixes_leave_no_similar_pair_out(spark):
    base = tables.prose(2, 60).replace("\n", " ")
    lines = [tables.changed(base, i, 1 + i % 5) for i in range(60)] + [base[:200] + tables.prose(70 + i, 20) for i in range(20)] + ["short", "shorts"]
    frame = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "node int, root int, line string")
    found = {(r.a, r.b) for r in line_dedup.prefix_pairs(frame, 12, 0.8).collect()}
    sets = [shingle_set(x) for x in lines]
    similar = {(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert similar and similar <= found


CLASHES = (
    "row d t d2 t2 places kept _word _bit _bits _likely l1 l2 node n1 n2 id leaf text_hash last taken full n_words n_lines cell distance "
    "base_failed of_words of_lines _model _cell_lang _cell_source word_chars n_symbols n_dup_lines n_repeat_words length repeats root copies a.b `c`"
).split()


def test_columns_of_the_caller_keep_their_values(spark):
    from pyspark.sql import functions as F

    from parley.llm import mixing, quality_rules

    frame = spark.createDataFrame([r for r in tables.rows() if r[0] is not None], tables.SCHEMA)
    for at, name in enumerate(CLASHES):
        frame = frame.withColumn(name, F.concat(F.lit(f"{at}:"), F.col("doc_id"), F.lit(" é")))
    for out in (
        line_dedup.dedup_lines(frame), ngram_join.keep_one(frame), quality_rules.keep_good(frame),
        mixing.keep_drawn(frame, ("lang", "source"), ({}, {}), share=0.7),
    ):
        assert out.columns == frame.columns
        rows = out.collect()
        assert rows
        for r in rows:
            assert [r[name] for name in CLASHES] == [f"{at}:{r.doc_id} é" for at in range(len(CLASHES))]
    counted = line_dedup.dedup_lines(frame, counts=True)
    assert counted.columns == [*frame.columns, "n_dropped"] and counted.where("n_lines >= 0").count() == frame.count()
