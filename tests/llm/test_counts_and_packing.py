"""Token counts and packing against the tokenizer library and against exact search."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parley.llm import bpe, packing

from . import tables

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    draw = random.Random(3)
    code = [*range(0x250), 0x1680, 0x2000, 0x2028, 0x3000, 0x660, 0x967, 0x2160, 0x4E2D, 0x1F600, 0xBD]
    pool = [chr(i) for i in code] + list("    aeiouthe'sdmtlrv") * 20
    fixed = ["", "aaaa" * 20, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "'s 've 'LL I'll", "  \n\n  x  ", "abcabc" * 50, "x" * 5000]
    return fixed + ["".join(draw.choices(pool, k=draw.randint(1, 60))) for _ in range(1500)]


def test_counts_agree_with_the_library(library):
    texts = odd_texts()
    assert bpe.Counter(PATH).counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_do_not_depend_on_what_is_remembered(monkeypatch):
    texts = odd_texts()
    once = bpe.Counter(PATH).counts(texts)
    monkeypatch.setattr(bpe, "MEMO", 10)
    assert bpe.Counter(PATH).counts(texts, block_bytes=50) == once


def test_ids_agree_with_the_library(library):
    encode = packing.Encoder(PATH)
    for text in odd_texts():
        assert encode.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_count_query(spark, library):
    found = bpe.count_tokens(tables.documents(spark), PATH, limit=100).collect()
    texts = Counter((r[0], r[1] or "") for r in tables.rows())
    want = Counter()
    for (doc, text), n in texts.items():
        tokens = len(library.encode(text, add_special_tokens=False).ids)
        want[doc, len(text.encode()), tokens, tokens > 100] += n
    assert Counter(map(tuple, found)) == want
    assert bpe.count_tokens(tables.empty(spark), PATH).count() == 0


def optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[k] -= items[i]
            place(i + 1, rooms)
            rooms[k] += items[i]
        rooms.append(capacity - items[i])
        place(i + 1, rooms)
        rooms.pop()

    place(0, [])
    return best[0]


def test_reduction_never_costs_a_bin():
    draw = random.Random(5)
    for _ in range(250):
        capacity = draw.choice([10, 20, 50])
        items = [draw.randint(1, capacity) for _ in range(draw.randint(1, 10))]
        left = packing.Lengths(Counter(items))
        fixed = packing.reduce_instance(left, capacity)
        rest = [n for n, c in left.count.items() for _ in range(c)]
        best = optimum(items, capacity)
        assert sum(b for b, _ in fixed) + (optimum(rest, capacity) if rest else 0) == best
        plan = packing.packing_plan(Counter(items), capacity)
        assert int(plan[:, 3].max()) + 1 <= 11 * best // 9 + 1


def test_plan_is_small_and_tight_for_many_items():
    sizes = np.minimum(2048, np.maximum(1, np.random.default_rng(1).lognormal(6, 1, 200_000))).astype(int)
    counts = Counter(sizes.tolist())
    plan = packing.packing_plan(counts, 2048)
    assert len(plan) < 20_000
    assert plan[:, 3].max() < 1.001 * sizes.sum() / 2048 + 1


def test_packing(spark, library):
    found = packing.pack_documents(tables.documents(spark), PATH, capacity=256).collect()
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += [1]
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    want = Counter()
    for doc, text, *_ in tables.rows():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) if len(ids) <= 256 else len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert {k: len(v) for k, v in by_doc.items()} == dict(want)
    assert packing.pack_documents(tables.empty(spark), PATH).count() == 0
