"""Vector similarity, search and encoding."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from parley.functions.vectors import cosine_similarity, decode_vector, encode_vector
from parley.operators import filters, similarity, vector_index
from parley.plans.oracle import CENTRES, MESSAGE_VIEW, cosine
from parley.plans.registry import query
from parley.session import fresh_folder
from parley.sources.fixtures import messages, table

THRESHOLD = 0.3


def _centres(spark, sf):
    """The mean vector of every label of the vector table."""
    vectors = table(spark, sf, "embeddings")
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return vectors.groupBy("label").agg(vector_to_array(mean).alias("vector"))


@query(
    "cosine_similarity",
    f"WITH {CENTRES} SELECT vec_id, round({cosine('embedding', 'centre')}, 5) AS similarity"
    " FROM embeddings JOIN centres USING (label)",
)
def _(spark, sf):
    joined = table(spark, sf, "embeddings").join(_centres(spark, sf), "label")
    return joined.select("vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("vector")), 5).alias("similarity"))


_NEAREST = f"""SELECT id, label, round(similarity, 6) AS similarity FROM (
      SELECT vec_id AS id, c.label, {cosine('embedding', 'centre')} AS similarity,
             row_number() OVER (PARTITION BY vec_id ORDER BY {cosine('embedding', 'centre')} DESC, c.label DESC) AS r
      FROM embeddings, centres c) WHERE r = 1"""


def _nearest(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embedding_vector"))
    return similarity.nearest_labels(rows, _centres(spark, sf))


@query("vector_cross", f"WITH {CENTRES} {_NEAREST}")
def _(spark, sf):
    return _nearest(spark, sf)


@query("filter_similarity", f"WITH {CENTRES} SELECT id, label FROM ({_NEAREST}) WHERE similarity > {THRESHOLD}::DOUBLE")
def _(spark, sf):
    return _nearest(spark, sf).filter(F.col("similarity") > THRESHOLD).select("id", "label")


_SIMILAR = f"""SELECT query_id, CAST(r AS INT) AS rank, id, conversation_id, round(similarity, 6) AS similarity FROM (
      SELECT q.query_id, v.id, v.conversation_id, {cosine('embedding', 'q.vector')} AS similarity,
             row_number() OVER (PARTITION BY q.query_id ORDER BY {cosine('embedding', 'q.vector')} DESC, "timestamp" DESC, id DESC) AS r
      FROM v JOIN embeddings ON vec_id = id, q
      WHERE sender_type = 'customer' AND {cosine('embedding', 'q.vector')} > {THRESHOLD}::DOUBLE) WHERE r <= 5"""


def _found(hits):
    return hits.select("query_id", "rank", "id", "conversation_id", F.round("similarity", 6).alias("similarity"))


@query(
    "similar_messages",
    f"WITH {MESSAGE_VIEW}, {CENTRES}, q AS (SELECT label AS query_id, centre AS vector FROM centres) {_SIMILAR}",
)
def _(spark, sf):
    queries = _centres(spark, sf).withColumnRenamed("label", "query_id")
    return _found(similarity.similar_messages(messages(spark, sf, vectors=True), queries, min_similarity=THRESHOLD))


@query(
    "similar_messages_indexed",
    f"""WITH {MESSAGE_VIEW}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 5 = 0) {_SIMILAR}""",
)
def _(spark, sf):
    rows, path = messages(spark, sf, vectors=True), fresh_folder(spark, "vectors")
    vector_index.build_index(filters.sender(rows, "customer").select("id", "timestamp", "embedding_vector"), path, width=64)
    asked = table(spark, sf, "embeddings").where("vec_id % 5 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    hits = vector_index.similar_in_index(spark, path, asked, min_similarity=THRESHOLD, block=32)
    return _found(rows.select("id", "conversation_id").join(hits, "id"))


@query(
    "similar_to_newest",
    f"""WITH {MESSAGE_VIEW}, q AS (SELECT id AS query_id, embedding::DOUBLE[] AS vector FROM v JOIN embeddings ON vec_id = id
        WHERE sender_type = 'customer' ORDER BY "timestamp" DESC, id DESC LIMIT 1) {_SIMILAR}""",
)
def _(spark, sf):
    rows = messages(spark, sf, vectors=True)
    stored = filters.sender(rows, "customer").filter(F.col("embedding_vector").isNotNull())
    asked = filters.newest(stored, 1).select(F.col("id").alias("query_id"), F.col("embedding_vector").alias("vector"))
    return _found(similarity.similar_messages(rows, asked, min_similarity=THRESHOLD))


@query(
    "decode_embedding",
    """SELECT 'vector' AS kind, vec_id AS id, CAST(len(embedding) AS INT) AS dims,
              round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings
       UNION ALL SELECT 'text', doc_id, NULL, NULL FROM documents""",
)
def _(spark, sf):
    good = table(spark, sf, "embeddings").select(
        F.lit("vector").alias("kind"),
        F.col("vec_id").alias("id"),
        encode_vector(F.col("embedding").cast("array<double>")).alias("json"),
    )
    bad = table(spark, sf, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("json"))
    decoded = good.unionByName(bad).withColumn("vector", decode_vector(F.col("json")))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return decoded.select("kind", "id", F.size("vector").alias("dims"), F.round(total, 4).alias("total"))


@query(
    "similar_messages_blocks",
    f"""WITH {MESSAGE_VIEW}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 5 = 0) {_SIMILAR}""",
)
def _(spark, sf):
    # more queries than a block holds
    asked = table(spark, sf, "embeddings").where("vec_id % 5 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return _found(similarity.similar_messages(messages(spark, sf, vectors=True), asked, min_similarity=THRESHOLD, block=32))


@query(
    "embed_messages",
    f"""WITH {MESSAGE_VIEW}, w AS (
          SELECT id, unnest(list_filter(regexp_split_to_array(lower(message), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS word FROM v),
        b AS (SELECT id, (('0x' || substr(md5(word), 1, 8))::UBIGINT % 64)::INTEGER AS pos, count(*)::DOUBLE AS n FROM w GROUP BY ALL)
        SELECT id, pos, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS x FROM b""",
)
def _(spark, sf):
    vectors = similarity.embed_messages(messages(spark, sf).select("id", "message"))
    placed = vectors.select("id", F.posexplode("embedding_vector").alias("pos", "x"))
    return placed.where("x <> 0").withColumn("x", F.round("x", 6))


@query("vector_groups", "SELECT vec_id AS id, true AS nearest FROM embeddings")
def _(spark, sf):
    """Every row belongs to the group whose centre is the most like it."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embedding_vector"))
    found = similarity.vector_groups(rows, 10)
    nearest = similarity.nearest_labels(rows, found.centres)
    return found.members.join(nearest, "id").select("id", (F.col("group") == F.col("label")).alias("nearest"))
