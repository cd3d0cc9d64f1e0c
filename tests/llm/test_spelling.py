"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from parley.llm import spelling

from . import tables


def brute_words(pairs):
    counts = Counter()
    for doc, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(pairs):
    counts = brute_words(pairs)
    near = {w: sorted((v for v in counts if one_edit(w, v)), key=lambda v: (-counts[v], v)) for w in counts}
    form = {w: next((v for v in near[w][:1] if counts[v] >= 5 * counts[w]), None) for w in counts}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), form[w] and counts[form[w]]) for w in counts}


def check(spark, pairs, **settings):
    found = spelling.group_variants(spark.createDataFrame(pairs, "doc_id long, text string"), **settings).collect()
    want = brute(pairs)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found} == want
    assert len(found) == len(want)
    return want


def misspelt(seed, times):
    """Words with frequent forms, their misspellings at every place, and misspellings of these."""
    draw = random.Random(seed)
    letters = "abcdeéüÿßçÀxyz"
    out = []
    for _ in range(25):
        word = "".join(draw.choice(letters) for _ in range(draw.randint(6, 11)))
        out += [word] * draw.choice((30, 150, times))
        for _ in range(6):
            at, kind = draw.randrange(len(word) + 1), draw.randrange(3)
            other = word[:at] + draw.choice(letters) * (kind < 2) + word[at + (kind != 0):]
            out += [other] * draw.choice((1, 5, 6, 30))
            out += [other[:3] + draw.choice(letters) + other[3:]] * draw.choice((4, 5))
    draw.shuffle(out)
    return out


def documents(seed, times=400, size=60):
    words = misspelt(seed, times)
    return [(i, " ".join(words[at: at + size])) for i, at in enumerate(range(0, len(words), size))]


def test_variants_against_all_pairs(spark):
    want = check(spark, documents(1))
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] and w[2] != w[1] for w in want)  # forms, and chains of them


@pytest.mark.parametrize("symbols", [1, 2, 7, 90])
def test_the_alphabet_does_not_change_the_result(spark, symbols):
    check(spark, documents(2, times=100), symbols=symbols)


def test_edits_at_every_place(spark):
    base = "wörterbüch"
    words = [base] * 40
    for i in range(len(base) + 1):
        words += [base[:i] + "q" + base[i:]] * 5 + ([base[:i] + base[i + 1:]] * 5 + [base[:i] + "z" + base[i + 1:]] * 6) * (i < len(base))
    check(spark, [(i, w) for i, w in enumerate(words)])


def test_ties_and_what_is_a_letter(spark):
    rows = ["aaaaaab"] * 5 + ["aaaaaac"] * 25 + ["aaaaaad"] * 25 + ["ÀAAAAAA"] * 5 + ["àaaaaaa"] * 30 + ["÷×÷×÷×"] * 6 + ["abcdeŁfghijk"] * 9
    check(spark, [(1, w) for w in rows] + [(None, "aaaaaab")])


def test_awkward_rows(spark):
    pairs = [(r[0], r[1]) for r in tables.rows()]
    check(spark, pairs)
    frame = tables.documents(spark).withColumn("word", tables.F.lit("w")).withColumn("n", tables.F.lit(1))
    found = spelling.group_variants(frame)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found.count() == len(brute(pairs))
    assert spelling.group_variants(tables.empty(spark)).count() == 0


def test_a_very_long_word(spark):
    long = "".join(random.Random(4).choice("abcdefgh") for _ in range(20_000))
    check(spark, [(i, long) for i in range(30)] + [(100 + i, long[:7000] + "z" + long[7000:]) for i in range(5)])


def test_neighbour_hashes_are_those_of_all_edits():
    for word in ("ABACAB", "A", "CCCCCCC"):
        places = range(len(word) + 1)
        near = {word} | {word[:i] + c + word[i:] for i in places for c in "ABC"}
        near |= {word[:i] + c + word[i + 1:] for i in places[:-1] for c in ("", "A", "B", "C")}
        assert set(spelling.neighbour_keys(word, 3).tolist()) == {spelling.word_key(w) for w in near}


def test_symbols_grow_with_the_vocabulary():
    assert [spelling.symbols_for(n) for n in (0, 1, 10_000, 10**6, 10**9)] == [4, 4, 4, 8, 20]


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 1, 2], "text": ["abcdef bcdefg", "cdefgh abcdef", "abcdef"]})
    parts = list(spelling.count_batches(6, 10**9)(iter([batch, batch])))
    total = Counter()
    for part in parts:
        total.update(dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist())))
    assert len(parts) == 2 and total == {"abcdef": 6, "bcdefg": 2, "cdefgh": 2}
