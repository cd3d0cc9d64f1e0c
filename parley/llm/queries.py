"""The registered queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, mixing, near_dedup, ngram_join, ordinal, packing, pii, quality_rules, ranked_search, sharding, spelling, topk
from .common import documents
from .mixing_sql import mixture_sql
from .queries_sql import BYTE_SHARDS, FUZZY_LINES, NEAR_DEDUP, NGRAM_JOIN, RANKED_SEARCH, SPELLING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


@query("op1_feistel_pseudonyms")
def op1_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    # a real run takes its key from a secret store; a fixed one keeps this query's result comparable
    return pii.pseudonymise_documents(documents(spark, folder), key=b"key of the registered query")


@query("op2_ngram_jaccard_join", NGRAM_JOIN)
def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    classes = ngram_join.similar_classes(documents(spark, folder), n=5, threshold=0.8, recall=0.999999)
    return classes.select("doc_id", "class_id", "n_links")


#: The mixture of the registered query: domains by source, then languages, then sources.
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = ({"crawl": 4, "library": 4, "forum": 2}, {"en": 5, "de": 2, "fr": 2, "es": 1}, {})
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 4, 7


def with_domain(frame: DataFrame, name: str = "domain") -> DataFrame:
    """``frame`` plus a domain: the large crawl, sources of one digit, the others."""
    domain = F.when(F.col("source") == "src0", "crawl").when(F.length("source") == 4, "library").otherwise("forum")
    return frame.withColumn(name, domain)


_DOMAIN_SQL = (
    "SELECT doc_id, text, CASE WHEN source = 'src0' THEN 'crawl' WHEN length(source) = 4 THEN 'library' "
    "ELSE 'forum' END AS domain, lang, source FROM documents"
)


@query("op3_mix_sources", mixture_sql(_DOMAIN_SQL, MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED))
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    source = with_domain(documents(spark, folder))
    return mixing.mix_documents(source, MIX_LEVELS, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


@query("op4_ordinal_quality")
def op4_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    source = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ratings = labels.select("doc_id", ordinal.label_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = ordinal.fit_documents(source, ratings, max_rows=20_000)
    return ordinal.grade_documents(source, model, good=2, least=0.5)


@query(
    "op5_exact_top_k",
    """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM whole),
scores AS (
    SELECT a.vec_id AS query_id, b.vec_id, sum(a.x * b.x)::BIGINT AS score
    FROM parts a JOIN parts b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
)
def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return topk.top_k(vectors, queries=F.col("vec_id") % 50 == 0, k=5, scale=256)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.count_tokens(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query("op7_robust_quality")
def op7_robust_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_verdicts(documents(spark, folder))


@query("op8_fuzzy_lines", FUZZY_LINES)
def op8_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    source = documents(spark, folder).select("doc_id", "text")
    return line_dedup.dedup_lines(source, width=12, threshold=0.8, hashes=10, counts=True)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


@query("op10_byte_shards", BYTE_SHARDS)
def op10_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, folder), shards=8)


@query("op11_minhash_near_dedup", NEAR_DEDUP)
def op11_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder), n=4, threshold=0.8, bins=128, rows=4)


@query("op12_spelling_variants", SPELLING)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(documents(spark, folder), least_length=6, least_count=5, factor=5, modulus=199)


@query("op13_ranked_search", RANKED_SEARCH)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), k=50)
