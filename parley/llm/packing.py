"""Best-fit packing of token sequences after dominance reduction.

Tokens are made and cut where the documents are; only how many pieces there are of each length, at most
one number per length up to the capacity, reaches the driver. The plan made there says which ranks of
which length go where, and the pieces look up their own place.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import SPLIT, byte_alphabet
from .common import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Encoder:
    """Token ids as the tokenizers library gives them for a byte-level BPE file, about five times as fast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        byte = {c: b for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        ranks = {
            bytes(byte[c] for c in token): number
            for token, number in content["model"]["vocab"].items() if token not in self.special
        }
        self.core = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.core.encode_to_numpy(text).astype("<u4") if text else np.empty(0, dtype="<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; of a longer one only the first may be shorter."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


def piece_batches(path: str, capacity: int, end: int):
    """A ``mapInArrow`` function: ``doc_id, text`` -> pieces, numbered per length within the task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows, of = [], []
            for at, text in enumerate(batch.column(1)):
                ids = np.append(encode.ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
                raw = memoryview(ids.tobytes())
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((number, start, length, zlib.crc32(raw[4 * start: 4 * (start + length)]), seen[length]))
                    seen[length] += 1
                    of.append(at)
            number, start, length, crc, nth = (np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else [np.empty(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(number.astype(np.int32)), pa.array(start),
                 pa.array(length), pa.array(crc), pa.array(np.full(len(of), part, dtype=np.int32)), pa.array(nth)],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

    return pieces


class Lengths:
    """How many items there are of each length, with the lengths that occur in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c}
        self.order = sorted(self.count)

    def take(self, length: int, number: int) -> None:
        self.count[length] -= number
        if not self.count[length]:
            del self.count[length]
            del self.order[bisect_left(self.order, length)]

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int | None:
        """The greatest length up to ``most`` that is left when the items ``without`` are gone."""
        at = bisect_left(self.order, most + 1) - 1
        while at >= 0 and self.count[self.order[at]] <= without.count(self.order[at]):
            at -= 1
        return self.order[at] if at >= 0 else None

    def smallest(self, number: int, without: int) -> list[int]:
        """The ``number`` least items, one item of length ``without`` aside."""
        found: list[int] = []
        for n in self.order:
            found += [n] * min(number - len(found), self.count[n] - (n == without))
            if len(found) == number:
                break
        return found


def dominating(items: Lengths, j: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside an item of length ``j`` such that no other filling of its bin can be better.

    A filling dominates another if the other's items can be exchanged, group by group, for single
    items of the first that are at least as long. Proven cases: nothing fits; one item fills the bin;
    only one more item can fit, so the longest; at most two can, and the longest single item is as
    long as any pair, or a pair is at least as long as every other in both places.
    """
    room = capacity - j
    longest = items.largest(room, (j,))
    if longest is None:
        return ()
    if longest == room:
        return (longest,)
    least = items.smallest(3, j)
    if len(least) < 2 or least[0] + least[1] > room:
        return (longest,)
    if len(least) == 3 and sum(least) <= room:
        return None
    best, widest = 0, 0  # the greatest sum of a pair, the greatest shorter half
    for x in items.order:
        if x > room:
            break
        y = items.largest(min(x, room - x), (j, x))
        if y is not None and items.count[x] > (x == j):
            best, widest = max(best, x + y), max(widest, y)
    if longest >= best:
        return (longest,)
    beside = items.largest(room - longest, (j, longest))
    if beside is not None and beside >= widest:
        return (longest, beside)
    return None


def reduce_instance(items: Lengths, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Fixes dominating bins, longest items first, until none is left: ``(bins, lengths in a bin)``.

    A filling is fixed as often as its items last: with fewer items left there are only fewer rivals.
    """
    fixed: list[tuple[int, tuple[int, ...]]] = []
    moved = True
    while moved:
        moved = False
        for j in reversed(list(items.order)):
            while items.count.get(j):
                beside = dominating(items, j, capacity)
                if beside is None:
                    break
                bin_ = (j, *beside)
                bins = min(items.count[n] // bin_.count(n) for n in set(bin_))
                for n in set(bin_):
                    items.take(n, bins * bin_.count(n))
                fixed.append((bins, bin_))
                moved = True
    return fixed


def best_fit(items: Lengths, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing, whole classes of equal bins at once: ``(bins, ((length, items per bin), ...))``.

    A length fills the fullest bins it fits into, then new ones. Each length splits at most one class
    twice and opens at most two, so there are at most three classes per length, however many items.
    """
    open_: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {capacity: []}
    rooms = [capacity]

    def put(room: int, bins: int, content: tuple[tuple[int, int], ...]) -> None:
        if bins:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((bins, content))

    for length in reversed(items.order):
        left = items.count[length]
        while left:
            room = rooms[bisect_left(rooms, length)]
            each = room // length
            if room == capacity and not open_[capacity]:
                bins, content = -(-left // each), ()
            else:
                bins, content = open_[room].pop()
                if not open_[room] and room != capacity:
                    del open_[room]
                    del rooms[bisect_left(rooms, room)]
            full = min(bins, left // each)
            put(room - each * length, full, (*content, (length, each)))
            left -= full * each
            bins -= full
            if bins and left:
                put(room - left * length, 1, (*content, (length, left)))
                left, bins = 0, bins - 1
            if content:
                put(room, bins, content)
    return [c for room in rooms for c in open_[room] if c[1]]


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows ``(length, first rank, items per bin, first sequence, offset)``, sorted by length and rank."""
    items = Lengths(counts)
    plan = []
    for bins, lengths in reduce_instance(items, capacity):
        plan.append((bins, tuple((n, lengths.count(n)) for n in dict.fromkeys(lengths))))
    plan += best_fit(items, capacity)
    used: dict[int, int] = dict.fromkeys(counts, 0)
    sequence, rows = 0, []
    for bins, content in plan:
        offset = 0
        for length, each in content:
            rows.append((length, used[length], each, sequence, offset))
            used[length] += bins * each
            offset += length * each
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place_batches(plan: np.ndarray):
    """A ``mapInArrow`` function that looks every piece's sequence and offset up by length and rank."""
    keys = (plan[:, 0] << 48) + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                names=[f.split()[0] for f in PLACES.split(", ")],
            )

    return place


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Places for written pieces ``(..., length, part, nth)``, where ``nth`` counts a length's pieces in a part.

    The rank of a piece among all of its length is its part's offset plus ``nth``; offsets come from one
    row per part and length. No piece is moved for it: a length that a third of all pieces share is not gathered.
    """
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = written(offsets, "pack-offsets")
    # at most one row per length up to the capacity
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(offsets, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(place_batches(packing_plan(counts, capacity)), PLACES)


def pack_documents(documents: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens; one row per piece.

    A document is its ids by the tokenizer file at ``path`` plus the id ``end``; NULL and empty texts are that id
    alone. Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Rows that repeat
    an id are packed each; an empty table gives no rows; extra columns are not read.
    """
    source = documents.select(F.col("doc_id").cast("long"), "text")
    return pack(written(source.mapInArrow(piece_batches(path, capacity, end), PIECES), "pack-pieces"), capacity)
