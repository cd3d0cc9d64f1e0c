"""Spelling variants: words one edit apart, found over a reduced alphabet and grouped under their frequent form.

Letters are hashed to a few symbols. The full one-edit neighbourhood of every reduced word is generated and joined with
the reduced vocabulary; words whose reduced words meet are compared letter by letter. Reduced words travel as
polynomial hashes, of which every neighbour's is computed from prefix and suffix sums, so a word's
length never multiplies with its neighbourhood.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import written

#: The letters of a run; A-Z are lower-cased first.
LETTERS = bytes([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])
#: Bytes of Latin-1 to lower-case letters, or a blank where a run ends.
RUNS = bytes(b if b in LETTERS else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Distinct words that a task holds before it passes their counts on.
HELD = 1 << 18
#: Neighbours of one output batch.
ROWS = 1 << 17

BASE = 0x9E3779B97F4A7C15


def count_batches(least_length: int, modulus: int):
    """A ``mapInArrow`` function: ``doc_id, text`` -> ``word, n``, partial counts of a task."""

    def out(held: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = (text.as_py() or "").encode("latin-1", "replace").translate(RUNS).split()
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(runs).items():
                    if len(run) < least_length:
                        continue
                    drawn = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
                    if drawn % modulus == 0:
                        at = drawn % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < least_length:
                            continue
                    held[run] = held.get(run, 0) + n
                if len(held) >= 2 * HELD:  # not even the rest of the batch is waited for
                    yield out(held)
                    held = {}
            if len(held) >= HELD:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    return count


def vocabulary(documents: DataFrame, least_length: int = 6, least_count: int = 5, modulus: int = 199) -> DataFrame:
    """``word, n`` of the words that occur often enough; every ``modulus``-th (document, run) has lost a letter."""
    partial = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(count_batches(least_length, modulus), "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def symbols_for(words: int) -> int:
    """So many symbols that reduced words of seven letters are about as many as the vocabulary, four at least.

    Fewer would let unrelated words meet, more would only lengthen the neighbourhoods; the result is the same.
    """
    return min(len(LETTERS), max(4, math.ceil(max(words, 1) ** (1 / 7))))


def reduced(word: Column, symbols: int) -> Column:
    """The word in an alphabet of ``symbols`` letters; a letter's symbol is drawn by its hash."""
    letters = LETTERS.decode("latin-1")
    drawn = "".join(chr(ord("A") + zlib.crc32(letter.encode()) % symbols) for letter in letters)
    return F.translate(word, letters, drawn).alias("reduced")


def _powers(length: int) -> np.ndarray:
    factors = np.full(length + 1, BASE, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("latin-1"), dtype=np.uint8).astype(np.uint64) - np.uint64(ord("A") - 1)


def word_key(word: str) -> int:
    """The hash of a reduced word: its symbols as the coefficients of a polynomial, modulo 2^64."""
    codes = _codes(word)
    return int((codes * _powers(len(codes))[: len(codes)]).sum(dtype=np.uint64).astype(np.int64))


def neighbour_keys(word: str, symbols: int) -> np.ndarray:
    """The distinct hashes of all reduced words at most one edit away, its own among them."""
    codes = _codes(word)
    power = _powers(len(codes))
    terms = codes * power[: len(codes)]
    before = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
    total = before[-1]
    after = total - before
    shorter = np.uint64(pow(BASE, -1, 1 << 64))
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    deleted = before[:-1] + after[1:] * shorter
    changed = (total - terms)[:, None] + every * power[: len(codes), None]
    added = (before + after * np.uint64(BASE))[:, None] + every * power[: len(codes) + 1, None]
    return np.unique(np.concatenate([deleted, changed.ravel(), added.ravel()])).view(np.int64)


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A ``mapInArrow`` function: ``word, n, reduced`` -> ``word, n, key``."""
    for batch in batches:
        keys = [word_key(w) for w in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.int64())], names=["word", "n", "key"])


def neighbour_batches(symbols: int):
    """A ``mapInArrow`` function: ``reduced`` -> ``key, near``, each unordered pair at its lesser end."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nears, held = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nears))], names=["key", "near"])
            for at in range(0, table.num_rows, ROWS):
                yield table.slice(at, ROWS)

        for batch in batches:
            for word in batch.column(0).to_pylist():
                own = word_key(word)
                near = neighbour_keys(word, symbols)
                near = near[near >= own]
                keys.append(np.full(len(near), own))
                nears.append(near)
                held += len(near)
                if held >= ROWS:
                    yield from out()
                    keys, nears, held = [], [], 0
        if held:
            yield from out()

    return generate


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """``word, near, near_n`` for every two words exactly one edit apart, in both directions."""
    keyed = written(
        words.select("word", "n", reduced(F.col("word"), symbols)).mapInArrow(key_batches, "word string, n long, key long"), "spelling-keys"
    )
    neighbours = words.select(reduced(F.col("word"), symbols)).distinct().mapInArrow(
        neighbour_batches(symbols), "key long, near long"
    )
    there = keyed.select(F.col("key").alias("near")).distinct()
    meeting = written(neighbours.join(there, "near").select("key", "near").distinct(), "spelling-meeting")
    left = meeting.join(keyed, "key").select("near", "key", "word", "n")
    right = keyed.select(F.col("key").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    once = (F.col("key") != F.col("near")) | (F.col("word") < F.col("other"))
    pairs = written(
        left.join(right, "near").where(once & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n"),
        "spelling-pairs",
    )
    return pairs.select("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")).union(
        pairs.select("other", "word", "n")
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last word that forms lead to.

    Each round doubles the steps; a form occurs several times as often as its word, so there are few and no circles.
    """
    current = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        following = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = Observation()
        stepped = current.join(following, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further")
        current = written(stepped.observe(moved, F.count("further").alias("n")).drop("further"), "spelling-roots")
        if not moved.get["n"]:
            return current


def group_variants(
    documents: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, modulus: int = 199, symbols: int | None = None
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of the whole texts, only A-Z lower-cased. Where the unsigned CRC-32
    of ``<doc_id>:<run>`` (a NULL id is written as nothing) is a multiple of ``modulus``, a letter is taken out
    of the run. A word has ``least_length`` letters and ``least_count`` occurrences, ``n``, at least; ``n_near`` words are one
    inserted, deleted or replaced letter away. ``form`` is the most frequent of them (ties: the first in code-point
    order) if it occurs ``factor`` times as often as the word, else NULL; ``root`` is the last word that forms lead to.

    NULL and empty texts have no words. Repeated rows count each; extra columns are not read. ``symbols`` (by default chosen
    from the size of the vocabulary) changes the work, not the result.
    """
    words = written(vocabulary(documents, least_length, least_count, modulus), "spelling-words")
    near = near_words(words, symbols or symbols_for(words.count()))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    beside = near.groupBy("word").agg(F.count("*").alias("n_near"), best)
    formed = (-F.col("best.less")) >= factor * F.col("n")
    judged = written(words.join(beside, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
    ), "spelling-forms")
    roots = last_forms(judged.where("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
