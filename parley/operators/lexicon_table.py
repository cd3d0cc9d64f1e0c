"""Keyword matching for a lexicon that is a table: all keywords of a block are found in one pass over a text.

The lexicon is cut into blocks by the hash of the keyword, as many as keep a block's automaton (Aho-Corasick) within its bound; blocks of
messages meet every block of the lexicon. A task reads the entries of its block as rows and then builds one automaton, through which
the messages of its share pass. Nothing is collected on the driver but a count and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.similarity import beside_all, pack_rows
from parley.session import fresh_folder

#: Characters and keywords of a block at most, about: its automaton takes some fifty bytes for each character.
BLOCK_CHARACTERS, BLOCK_KEYWORDS = 2_000_000, 250_000
#: Rows of a batch that leaves a task, about.
MATCHES = 100_000


class Automaton:
    """Which of its entries occur in a lower-cased text, each once, whatever they overlap."""

    def __init__(self, keywords: list[str]):
        self.everywhere = [i for i, k in enumerate(keywords) if k == ""]  # the empty text is part of every text
        self.order = sorted((i for i, k in enumerate(keywords) if k), key=keywords.__getitem__)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.ends: list[int] = []  # where the entries of each distinct keyword end in that order
        for place, i in enumerate(self.order):
            if place and keywords[i] == keywords[self.order[place - 1]]:
                self.ends[-1] += 1
            else:
                self.machine.add_word(keywords[i], len(self.ends))
                self.ends.append(place + 1)
        if self.ends:
            self.machine.make_automaton()

    def met(self, text: str) -> list[int]:
        places = {n for _, n in self.machine.iter(text)} if self.ends else set()
        found = {i for n in places for i in self.order[self.ends[n - 1] if n else 0 : self.ends[n]]}
        return sorted(found.union(self.everywhere))


class Matches:
    """A row per message and entry met: of blocks of messages (``id``, ``text``) and the task's part of the lexicon."""

    def __init__(self, entries: pa.Array):
        self.entries, self.automaton = entries, Automaton(entries.field("keyword").to_pylist())

    def meet(self, block: dict) -> Iterator[pa.RecordBatch]:
        messages, met = [], []
        for at, text in enumerate(block["text"].values.to_pylist()):
            if text is not None:
                found = self.automaton.met(text.lower())
                messages += [at] * len(found)
                met += found
            if len(met) > MATCHES:
                yield self.out(block, messages, met)
                messages, met = [], []
        yield self.out(block, messages, met)

    def out(self, block: dict, messages: list[int], met: list[int]) -> pa.RecordBatch:
        taken = self.entries.take(pa.array(met, pa.int64()))
        names = ("label", "label_order", "keyword", "label_size")
        return pa.RecordBatch.from_arrays(
            [block["id"].values.take(pa.array(messages, pa.int64())), *(taken.field(n) for n in names)], names=["id", *names]
        )

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def match_lexicon_table(messages: DataFrame, lexicon: DataFrame, text: str = "message") -> DataFrame:
    """``id, label, label_order, keyword, label_size`` for every message and keyword that occurs in its lower-cased text.

    ``lexicon``: label, label_order, keyword; of repeated rows one counts. NULL texts and keywords meet nothing. A small
    lexicon is sent along, a larger one is dealt over parts.
    """
    rows = lexicon.where(F.col("keyword").isNotNull()).select("label", F.col("label_order").cast("int").alias("label_order"), "keyword").distinct()
    spark, path = lexicon.sparkSession, fresh_folder(lexicon.sparkSession, "lexicon")
    rows.write.parquet(path)  # read three times, found once
    rows = spark.read.schema(rows.schema).parquet(path)
    sizes = rows.groupBy("label", "label_order").agg(F.count("*").cast("int").alias("label_size"))
    sized = rows.join(sizes, ["label", "label_order"]).select("label", "label_order", "keyword", "label_size")
    count, characters = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("keyword")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_KEYWORDS), -(-characters // BLOCK_CHARACTERS))
    packed = pack_rows(messages.select("id", F.col(text).alias("text")))
    schema = T.StructType([
        messages.schema["id"], T.StructField("label", T.StringType()), T.StructField("label_order", T.IntegerType()),
        T.StructField("keyword", T.StringType()), T.StructField("label_size", T.IntegerType()),
    ])
    return beside_all(packed, sized, F.xxhash64("keyword"), 4 * characters + 40 * count, blocks, Matches, schema)
