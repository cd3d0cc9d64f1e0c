"""One-permutation near-duplicates against all pairs of full shingle sets."""

from collections import Counter

import numpy as np
import pytest

from parley.llm import near_dedup

from . import tables


def shingle_set(text, n=4):
    parts = (text or "").encode().lower().split()
    width = min(n, len(parts))
    return {tuple(parts[i: i + width]) for i in range(len(parts) - width + 1)} if parts else set()


def brute(pairs, threshold=0.8):
    """Per row: shingles, the least id that links lead to, whether it stays."""
    sets = [shingle_set(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 100 * threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-7:
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (doc, _) in enumerate(pairs):
        members.setdefault(find(i), []).append(doc)
    out = Counter()
    for i, (doc, _) in enumerate(pairs):
        ids = [x for x in members[find(i)] if x is not None]
        component = (min(ids) if ids else None) if sets[i] else doc
        out[doc, len(sets[i]), component, component == doc] += 1
    return out


def check(spark, pairs, **settings):
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    found = near_dedup.near_duplicates(frame, **settings).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found) == brute(pairs)


def test_awkward_rows(spark):
    check(spark, [(r[0], r[1]) for r in tables.rows()])


def test_extra_columns_are_not_read_and_an_empty_table(spark):
    found = near_dedup.near_duplicates(tables.documents(spark))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found.count() == len(tables.rows())
    assert near_dedup.near_duplicates(tables.empty(spark)).count() == 0


def test_only_ascii_letters_lose_their_case(spark):
    check(spark, [(1, "Ein ÄRGER mehr am Ende"), (2, "ein Ärger MEHR am ende"), (3, "EIN ÄRGER MEHR AM ENDE"), (4, "ein ärger mehr am ende"),
                  (5, "a b c d"), (6, "a b c d"), (7, "three words only"), (8, "THREE Words\x0bonly")])


def test_large_groups_in_many_tiles(spark, monkeypatch):
    """Copies with edits, chains that no star closes, and passages shared by documents that are not similar."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base, shared = tables.prose(4, 90), tables.prose(6, 60)
    pairs = [(i, tables.changed(base, i, i % 6)) for i in range(100)]
    pairs += [(1000 + i, shared + " " + tables.prose(1000 + i, 35)) for i in range(60)]  # about half in common
    words = tables.prose(8, 400).split()
    pairs += [(2000 + i, " ".join(words[4 * i: 4 * i + 100])) for i in range(60)]  # each like its neighbours only
    pairs += [(3000 + i, base.upper()) for i in range(5)]
    check(spark, pairs)


def test_what_the_stars_leave_open_is_found(spark, monkeypatch):
    """With the heads' links withheld, the tiles alone must find every link."""
    kept = near_dedup._Links.likely
    monkeypatch.setattr(near_dedup._Links, "likely", lambda self, pairs: kept(self, pairs).limit(0))
    base = tables.prose(4, 90)
    check(spark, [(i, tables.changed(base, i, i % 6)) for i in range(60)] + [(100 + i, tables.prose(100 + i, 60)) for i in range(30)])


def test_a_signature_is_filled_and_agrees_as_often_as_sets_do():
    signer, draw = near_dedup.Signer(128, 4), np.random.default_rng(3)
    for common, own in ((4, 1), (40, 5), (400, 50)):  # few shingles leave most bins empty
        agree = []
        for _ in range(300):
            drawn = draw.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64) * np.uint64(2)
            left, right = np.unique(drawn[: common + own]), np.unique(np.r_[drawn[:common], drawn[common + own:]])
            agree.append((signer.signature(left) == signer.signature(right)).mean())
            assert set(signer.signature(left).tolist()) <= set(left.tolist())
        assert abs(np.mean(agree) - common / (common + 2 * own)) < 0.02
    assert near_dedup.band_recall(0.8, 128, 4) > 0.9999999
    with pytest.raises(ValueError):
        near_dedup.Signer(100, 4)


def test_bands_find_pairs_at_the_threshold():
    signer, draw = near_dedup.Signer(128, 4), np.random.default_rng(9)
    for common, own in ((8, 1), (80, 10), (800, 100)):  # a Jaccard similarity of 0.8
        for _ in range(1500):
            drawn = draw.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64) * np.uint64(2)
            left, right = np.unique(drawn[: common + own]), np.unique(np.r_[drawn[:common], drawn[common + own:]])
            assert (signer.bands(left) == signer.bands(right)).any()


def test_a_sketch_lets_no_similar_pair_go():
    draw = np.random.default_rng(4)
    for common, own in ((8, 1), (80, 10), (4000, 500)):
        drawn = draw.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64)
        left, right = drawn[: common + own], np.r_[drawn[:common], drawn[common + own:]]
        apart = np.bitwise_count((near_dedup.Signer.sketch(left) ^ near_dedup.Signer.sketch(right)).view(np.uint64)).sum()
        assert apart <= near_dedup.most_apart(0.8) * (len(left) + len(right)) + 1e-9
