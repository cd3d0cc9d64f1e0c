"""Ranked lexical search by the Best Position Algorithm over impact lists.

Every task holds the impact lists of its own documents, a block at a time: per query term the documents by descending
impact. A query reads its lists from the top; each document it meets is looked up in all lists at once (direct access), and
the places found there count as seen. A list's best position is the end of its unbroken run of seen places, so
the impacts there bound every document not met yet, more tightly than the places last read. A query stops where that
bound lies strictly below the score of its kth document, which it carries from block to block. Only the
best of each task are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of UTF-8 to terms: digits, lower-cased ASCII letters and all that is not ASCII; a blank ends a term.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Documents and postings of a block at most (one document more, should it be long).
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 1 << 16, 1 << 21
#: Queries, and terms of theirs, that are answered in one pass over the documents.
QUERIES, QUERY_TERMS = 4096, 1 << 20
#: Places of each list that a query reads first; every further step reads twice as many.
FIRST_STEP = 32

POSTINGS = "doc_id long, n long, terms array<int>, times array<int>"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in their order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERMS).split()


def query_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A ``mapInArrow`` function: ``item_id, text`` -> ``item_id, terms`` (distinct)."""
    for batch in batches:
        terms = [sorted(set(terms_of(text.as_py()))) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])


def posting_batches(numbers: dict[bytes, int]):
    """A ``mapInArrow`` function: ``doc_id, text`` -> ``doc_id``, its length in terms, the query terms in it and how often."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, times = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py())
                counted = [(numbers[t], n) for t, n in Counter(found).items() if t in numbers]
                lengths.append(len(found))
                terms.append([t for t, _ in counted])
                times.append([n for _, n in counted])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.array(terms, ints), pa.array(times, ints)],
                names=["doc_id", "n", "terms", "times"],
            )

    return post


def impacts(times: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What a term that occurs so often counts in a document of such a length, before its weight."""
    values, back = np.unique(lengths, return_inverse=True)
    norm = np.array([100 - 50 + (50 * int(n) * documents) // total for n in values], dtype=np.int64)[back]
    times = times.astype(np.int64)
    return (1_000_000_000 * times) // (1000 * times + 20 * norm)


class Block:
    """The impact lists of some documents, and every document's places in them."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, times: np.ndarray, vocabulary: int, documents: int, total: int):
        self.first = np.concatenate([[0], np.cumsum(counts)])  # where a document's postings begin
        owner = np.repeat(np.arange(len(counts)), counts)
        self.term = terms
        self.impact = impacts(times, lengths[owner], documents, total)
        order = np.lexsort((-self.impact, terms))
        self.list_document, self.list_impact = owner[order], self.impact[order]
        self.place = np.empty(len(order), dtype=np.int64)  # of a posting, in the lists laid end to end
        self.place[order] = np.arange(len(order))
        self.begin = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.met = np.zeros(len(counts), dtype=bool)
        self.seen = np.zeros(len(order), dtype=bool)
        self.weight = np.zeros(vocabulary, dtype=np.int64)

    def look_up(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents' scores and their places in the lists of the query whose weights are set."""
        sizes = self.first[documents + 1] - self.first[documents]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.first[documents] - starts, sizes)
        weight = self.weight[self.term[at]]
        return np.add.reduceat(weight * self.impact[at], starts), self.place[at[weight > 0]]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """``documents, scores`` that may be among the k best, and how many were looked up; ``held``: k scores to beat at most."""
        here = (self.begin[terms] < self.begin[terms + 1]) & (weights > 0)
        terms, weights = terms[here], weights[here]
        self.weight[terms] = weights
        begin, end = self.begin[terms], self.begin[terms + 1]
        position = begin.copy()  # the end of each list's unbroken run of seen places
        found, scores, touched = [], [held], []
        read, step = 0, FIRST_STEP
        while len(terms):
            # a list seen to its end says that no other document holds the term
            reached = np.where(position < end, self.list_impact[np.maximum(position - 1, begin)], 0)
            bound = int((weights * reached).sum())
            known = np.concatenate(scores)
            if bound <= 0 or len(known) >= k and bound < np.partition(known, len(known) - k)[len(known) - k]:
                break
            cut = [self.list_document[b + read: min(b + read + step, e)] for b, e in zip(begin, end) if b + read < e]
            read, step = read + step, 2 * step
            met = np.unique(np.concatenate(cut)) if cut else np.empty(0, dtype=np.int64)
            met = met[~self.met[met]]
            if len(met):
                self.met[met] = True
                score, places = self.look_up(met)
                self.seen[places] = True
                found.append(met)
                scores.append(score)
                touched.append(places)
            for i in np.flatnonzero(position < end):
                rest = self.seen[position[i]: end[i]]
                gap = int(rest.argmin())
                position[i] = end[i] if rest[gap] else position[i] + gap
        self.weight[terms] = 0
        for places in touched:
            self.seen[places] = False
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
        documents, scores = np.concatenate(found), np.concatenate(scores[1:])
        self.met[documents] = False
        known = np.concatenate([held, scores])
        least = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else 1
        keep = (scores > 0) & (scores >= least)
        return documents[keep], scores[keep], len(documents)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    documents = postings = 0
    for batch in batches:
        held.append(batch)
        documents += batch.num_rows
        postings += len(batch.column(2).flatten())
        if documents >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held)
            held, documents, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def search_batches(queries: Sequence[np.ndarray], weights: np.ndarray, k: int, documents: int, total: int):
    """A ``mapInArrow`` function: postings -> ``query, doc_id, score``, the k best of the task's documents for each query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.int64)
        best = [(none, none.astype(bool), none)] * len(queries)  # ids, whether there is none, scores
        for table in _blocks(batches):
            ids = table.column("doc_id").combine_chunks()
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            terms, times = (table.column(c).combine_chunks() for c in ("terms", "times"))
            block = Block(
                table.column("n").to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(),
                times.flatten().to_numpy(), len(weights), documents, total,
            )
            for number, query in enumerate(queries):
                found, scores, _ = block.best(query, weights[query], k, best[number][2])
                if not len(found):
                    continue
                new = (ids[found], missing[found], scores)
                id_, without, score = (np.concatenate(pair) for pair in zip(best[number], new))
                order = np.lexsort((id_, without, -score))[:k]
                best[number] = (id_[order], without[order], score[order])
        for number, (id_, without, score) in enumerate(best):
            if len(id_):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(id_), number, dtype=np.int32)), pa.array(id_, mask=without), pa.array(score)],
                    names=["query", "doc_id", "score"],
                )

    return search


def query_chunks(items: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Item ids and their distinct terms, so many at a time that a chunk has a fixed bound (one item more, should it be long)."""
    ids, terms, held = [], [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").mapInArrow(query_batches, "item_id long, terms array<binary>").toLocalIterator():
        ids.append(row.item_id)
        terms.append([bytes(t) for t in row.terms])
        held += len(row.terms)
        if len(ids) >= QUERIES or held >= QUERY_TERMS:
            yield ids, terms
            ids, terms, held = [], [], 0
    if ids:
        yield ids, terms


def search_chunk(documents: DataFrame, ids: list, terms: list[list[bytes]], k: int) -> DataFrame:
    """``item_id, rank, doc_id, score`` of one chunk of queries."""
    spark = documents.sparkSession
    numbers = {t: i for i, t in enumerate(sorted({t for held in terms for t in held}))}
    postings = written(
        documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(posting_batches(numbers), POSTINGS), "search-postings"
    )
    held, total = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = {r[0]: r[1] for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row per query term
    weights = np.array(
        [math.floor(1000 * math.log((2 * held + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(numbers))], dtype=np.int64
    )
    queries = [np.array([numbers[t] for t in held_terms], dtype=np.int64) for held_terms in terms]
    found = written(
        postings.where(F.size("terms") > 0).mapInArrow(
            search_batches(queries, weights, k, held, total), "query int, doc_id long, score long"
        ), "search-best",
    )
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, item in enumerate(ids)], "query int, item_id long")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k documents of the highest score above 0, ties by doc_id.

    Terms are maximal runs of digits, ASCII letters and characters beyond ASCII, only A-Z lower-cased. A document's score is the sum, over
    the item's distinct terms, of the term's weight ``floor(1000 ln((2N + 2) / (2df + 1)))`` times its impact
    ``10^9 tf div (1000 tf + 20 m)`` with ``m = 100 - 50 + 50 n N div L``: N documents have terms, L in all, n of
    them in the document, df documents hold the term, tf times in this one.

    NULL or empty texts have no terms: as items they find nothing, as documents they are found by nothing and do not
    count. Rows that repeat are documents, and items, of their own; a NULL doc_id ranks behind equal scores. Extra
    columns are not read. Items are answered in chunks of ``QUERIES``, each with one pass over the documents.
    """
    out = None
    for ids, terms in query_chunks(items):
        ranked = search_chunk(documents, ids, terms, k)
        out = ranked if out is None else out.union(ranked)
    return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
