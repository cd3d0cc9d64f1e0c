"""The corpus pipeline: quality rules, line dedup, near duplicates, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and gives the documents that go on, with the columns they came with;
the last gives the packed pieces. ``run`` writes every stage to the shared folder and reads it back,
so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from parley.llm.common import documents, written
from parley.llm.queries import with_domain

#: The stages cannot be said in SQL: robust estimates, signatures, a tokenizer, best fit. Tests hold them
#: against brute force instead.
ORACLE_SQL = None

MIX_WEIGHTS = ({"crawl": 3, "library": 5, "forum": 5}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {})


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no base rule and are no outlier of their language and source."""
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line, with those like it, once in the corpus; documents of which no word is left go."""
    return line_dedup.dedup_lines(docs, width=12, threshold=0.8, hashes=10).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, by five-word shingles and a similarity of 0.8."""
    return ngram_join.keep_one(docs, n=5, threshold=0.8, recall=0.999999)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the weights of domains, languages and sources; a document once at most."""
    name = "domain"
    while name in docs.columns:  # a name that no column of the documents has
        name += "_"
    return mixing.keep_drawn(
        with_domain(docs, name), (name, "lang", "source"), MIX_WEIGHTS, share=0.8, seed=7, columns=docs.columns
    )


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", fresh_lines),
    ("near duplicates", one_of_each),
    ("source mix", source_mix),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
