"""Byte-pair counts by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie behind one another in one array of symbols. In each round every
sequence that can still merge applies its lowest-ranked pair, all sequences at once; sequences
without a mergeable pair leave. The symbols that are left are the tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of byte-level BPE: its split pattern, with white space spelled out (Unicode White_Space).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WHITE + r"\p{L}\p{N}]+|["
    + _WHITE + r"]+(?![^" + _WHITE + r"])|[" + _WHITE + r"]+"
)
#: The same for texts whose only characters are ASCII without separators 1C-1F, and Latin letters C0-24F but two signs.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]*")
_FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_FULL = regex.compile(SPLIT)

#: Pre-tokens whose counts a worker remembers before it starts afresh.
MEMO = 1 << 19


def pretokens(text: str) -> list[str]:
    """The pieces within which byte pairs merge."""
    return (_FAST if _PLAIN.fullmatch(text) else _FULL).findall(text)


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """The merge table of a byte-level BPE file: pair -> rank and merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        self.width = len(vocabulary) + 1
        left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order, merged
        self.symbols = np.array([vocabulary[c] for _, c in sorted(byte_alphabet().items())], dtype=np.int64)
        self.none = len(pairs)
        self.specials = [t["content"] for t in content.get("added_tokens", [])]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank; ``none`` where it cannot merge."""
        wanted = left * self.width + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)

    def sizes(self, pieces: list[str]) -> np.ndarray:
        """How many tokens each piece becomes."""
        result = np.zeros(len(pieces), dtype=np.int64)
        if not pieces:
            return result
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbol = self.symbols[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), length)
        ranks = self._pair_ranks(symbol, owner)
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, start)
            live = lowest < self.none
            size = np.diff(np.r_[start, len(symbol)])
            done = ~live
            result[owner[start[done]]] = size[done]
            if not live.any():
                break
            keep = np.repeat(live, size)
            symbol, owner, ranks = symbol[keep], owner[keep], ranks[keep]
            lowest = np.repeat(lowest[live], size[live])
            hit = ranks == lowest
            hit = self._apart(hit, symbol)
            at = np.flatnonzero(hit)
            symbol[at] = self.merged[ranks[at]]
            gone = np.zeros(len(symbol), dtype=bool)
            gone[at + 1] = True
            stay = ~gone
            before = np.flatnonzero(stay)
            symbol, owner, ranks = symbol[stay], owner[stay], ranks[stay]
            # a pair is new where its left or its right symbol is
            fresh = hit[before]
            fresh[:-1] |= fresh[1:]
            fresh = np.flatnonzero(fresh)
            ranks[fresh] = self._ranks_at(symbol, owner, fresh)
        return result

    def _pair_ranks(self, symbol: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self._ranks_at(symbol, owner, np.arange(len(symbol)))

    def _ranks_at(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at the given places."""
        after = np.minimum(at + 1, len(symbol) - 1)
        ranks = self.rank(symbol[at], symbol[after])
        ranks[(after == at) | (owner[after] != owner[at])] = self.none
        return ranks

    @staticmethod
    def _apart(hit: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of overlapping hits (a run of one symbol) every second one, from the left."""
        at = np.flatnonzero(hit)
        if not len(at):
            return hit
        first = np.r_[True, np.diff(at) > 1]
        begin = np.repeat(np.flatnonzero(first), np.diff(np.r_[np.flatnonzero(first), len(at)]))
        hit[at[(np.arange(len(at)) - begin) % 2 == 1]] = False
        return hit


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts tokens of texts; remembers the counts of up to ``MEMO`` pre-tokens."""

    def __init__(self, path: str):
        self.table = merges(path)
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str], block_bytes: int = 1 << 22) -> list[int]:
        """Tokens per text; whole texts, in blocks of about so many characters."""
        found: list[int] = []
        block: list[tuple[int, list[str]]] = []
        held = 0
        for text in texts:
            special, parts = 0, [text]
            if self.table.special is not None and any(s in text for s in self.table.specials):
                parts = self.table.special.split(text)
                special = len(parts) - 1
            pieces = pretokens(parts[0]) if len(parts) == 1 else [p for part in parts for p in pretokens(part)]
            block.append((special, pieces))
            held += len(text)
            if held >= block_bytes:
                found += self._resolve(block)
                block, held = [], 0
        return found + self._resolve(block)

    def _resolve(self, block: list[tuple[int, list[str]]]) -> list[int]:
        if len(self.known) > MEMO:
            self.known = {}
        new: set[str] = set()
        for _, pieces in block:
            new.update(pieces)
        fresh = [p for p in new if p not in self.known]
        self.known.update(zip(fresh, self.table.sizes(fresh).tolist()))
        lookup = self.known.__getitem__
        return [special + sum(map(lookup, pieces)) for special, pieces in block]


def count_batches(path: str, limit: int):
    """A ``mapInArrow`` function: ``doc_id, text`` -> ``doc_id, n_bytes, n_tokens, over_limit``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = np.array(counter.counts(texts), dtype=np.int64)
            size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return count


def count_tokens(documents: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Tokens of every whole text, as the tokenizer file at ``path`` gives them.

    Begin, end and other added tokens are not counted; a special token's string inside a text is one
    token, as the library's default has it. A NULL text is empty: no bytes, no tokens. One narrow pass
    over the input without a shuffle; repeated rows are counted each, extra columns are not read.
    """
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        count_batches(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
