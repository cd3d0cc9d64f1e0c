"""Ordinal quality classifier: a cumulative-link model over hashed text.

One weight per hashed feature is shared by all grades; ordered thresholds cut the score into grades.
``P(grade <= k) = s(threshold_k - score)`` with the logistic function ``s`` gives the expected grade and the
probability of a grade in the tail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs that ordinary prose holds.
_ORDINARY = frozenset(".,;:!?'\"()-")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class _Buckets(dict):
    """Hash bucket of each feature; starts afresh when it has grown large."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        found = self[feature] = xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) % self.size
        return found


class Features:
    """A text's hashed features and their values.

    Words in lower case and runs of signs count by presence, less in texts with many different ones, so that chance
    does not add up in long texts; shapes of the whole count in full.
    """

    def __init__(self, size: int, full: int = 50):
        self.bucket, self.full = _Buckets(size), full

    def _buckets(self, names: set[str]) -> np.ndarray:
        return np.unique(np.fromiter(map(self.bucket.__getitem__, names), dtype=np.int64, count=len(names)))

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(text or "")
        n = len(tokens)
        if not n:
            return np.empty(0, dtype=np.int64), np.empty(0)
        present = set(map(str.lower, tokens))
        shape = {f"\0distinct {10 * len(present) // n}", f"\0length {n.bit_length()}"}
        counts = {
            "upper": sum(t.isupper() and len(t) > 1 for t in tokens),
            "odd": sum(not t[0].isalnum() and t[0] not in _ORDINARY for t in tokens),
            "again": sum(a == b for a, b in zip(tokens, tokens[1:])),
        }
        for name, count in counts.items():
            shape.update(f"\0{name} {least}" for least in range(1, 6) if count << (7 - least) >= n)
        words, shapes = self._buckets(present), self._buckets(shape)
        value = min(1.0, (self.full / len(present)) ** 0.5)
        return np.concatenate([words, shapes]), np.concatenate([np.full(len(words), value), np.ones(len(shapes))])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """Fitted weights and thresholds; ``tail`` is the first grade that counts as good."""

    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """Probability of every grade, one row per score."""
        upto = _logistic(self.thresholds[None, :] - scores[:, None])
        full = np.concatenate([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))], axis=1)
        return np.diff(full, axis=1)


def fit(
    features: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int, steps: int = 250, rate: float = 0.1,
    decay: float = 1e-4, least_rows: int = 20,
) -> OrdinalModel:
    """Maximum likelihood with a quadratic penalty, by full passes of Adam over the sample.

    A feature of fewer than ``least_rows`` rows keeps the weight 0: it cannot be told from chance. Thresholds are
    a first value and positive steps, so they stay ordered. Nothing is drawn at random.
    """
    levels = int(grades.max()) + 1 if len(grades) else 2
    levels = max(levels, 2)
    if not len(grades):
        return OrdinalModel(np.zeros(size, dtype=np.float32), np.zeros(levels - 1))
    index, value = (np.concatenate(part) for part in zip(*features))
    row = np.repeat(np.arange(len(features)), [len(i) for i, _ in features])
    common = np.bincount(index, minlength=size) >= least_rows
    keep = common[index]
    index, value, row = index[keep], value[keep], row[keep]
    used, index = np.unique(index, return_inverse=True)
    share = np.clip([np.mean(grades <= k) for k in range(levels - 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # parameters: weights, first threshold, logarithms of the steps between thresholds
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    state = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    first, second = np.zeros_like(state), np.zeros_like(state)
    n, d = len(grades), len(used)
    for step in range(1, steps + 1):
        weights, steps_up = state[:d], np.exp(state[d + 1:])
        thresholds = state[d] + np.r_[0.0, np.cumsum(steps_up)]
        scores = np.bincount(row, weights=weights[index] * value, minlength=n)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        high, low = _logistic(edges[grades + 1] - scores), _logistic(edges[grades] - scores)
        chance = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high) / chance, low * (1 - low) / chance
        by_score = (slope_high - slope_low) / n  # of the loss, by each row's score
        by_edge = np.zeros(levels + 1)
        np.add.at(by_edge, grades + 1, -slope_high / n)
        np.add.at(by_edge, grades, slope_low / n)
        by_threshold = by_edge[1:levels]
        gradient = np.concatenate([
            np.bincount(index, weights=by_score[row] * value, minlength=d) + decay * weights,
            [by_threshold.sum()],
            np.cumsum(by_threshold[::-1])[::-1][1:] * steps_up,
        ])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(size, dtype=np.float32)
    full[used] = state[:d]
    return OrdinalModel(full, state[d] + np.r_[0.0, np.cumsum(np.exp(state[d + 1:]))])


SAMPLE = "grade int, place long, text_hash long, n_words int, value double, features array<int>"


def feature_batches(size: int):
    """A ``mapInArrow`` function: ``grade, place, text_hash, text`` -> the same with features for the text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(size)
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(3)]
            words = [int((v < 1).sum()) for _, v in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(words, pa.int32()), pa.array([float(v[0]) if len(v) else 1.0 for _, v in found]),
                 pa.array([i for i, _ in found], pa.list_(pa.int32()))],
                names=[f.split()[0] for f in SAMPLE.split(", ")],
            )

    return extract


def fit_documents(
    documents: DataFrame, ratings: DataFrame, size: int = 1 << 18, max_rows: int = 20_000, **settings
) -> OrdinalModel:
    """Fits to at most ``max_rows`` rated documents (``ratings``: ``doc_id, grade``), those of least hashed id.

    The bound is what one machine fits in seconds; the sample is the same however the tables are split. The
    chosen ids, no more than the bound, go to the documents, so no text is shuffled. Rows whose grade or
    text is NULL are left out. Without any rated document every grade is as likely.
    """
    place = F.xxhash64(F.lit(4), "doc_id").alias("place")
    chosen = (
        ratings.where("grade is not null and doc_id is not null")
        .select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int").alias("grade"), place)
        .distinct().orderBy("place", "rated_id", "grade").limit(max_rows)
    )
    rated = documents.select("doc_id", "text").where("text is not null").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("rated_id")  # at most max_rows rows
    )
    sample = (
        rated.select("grade", "place", F.xxhash64("text").alias("text_hash"), "text")
        .mapInArrow(feature_batches(size), SAMPLE)
        .orderBy("place", "text_hash", "grade").limit(max_rows).toArrow()  # rows may repeat an id
    )
    rows = []
    for n, value, index in zip(*(sample.column(c).to_pylist() for c in ("n_words", "value", "features"))):
        values = np.ones(len(index))
        values[:n] = value
        rows.append((np.array(index, dtype=np.int64), values))
    return fit(rows, sample.column("grade").to_numpy().astype(np.int64), size, **settings)


def score_batches(model: OrdinalModel, good: int, least: float):
    """A ``mapInArrow`` function: ``doc_id, text`` -> ``doc_id, expected_grade, tail_probability, kept``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(model.weights))
        for batch in batches:
            found = (features(t.as_py()) for t in batch.column(1))
            scores = np.array([model.weights[i].astype(np.float64) @ v for i, v in found], dtype=np.float64)
            chances = model.chances(scores)
            expected = chances @ np.arange(chances.shape[1])
            tail = chances[:, good:].sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= least)],
                names=["doc_id", "expected_grade", "tail_probability", "kept"],
            )

    return score


def grade_documents(documents: DataFrame, model: OrdinalModel, good: int, least: float = 0.5) -> DataFrame:
    """``doc_id, expected_grade, tail_probability, kept`` for every document.

    ``tail_probability`` is that of grade ``good`` or better; ``kept`` says whether it reaches ``least``. One
    narrow pass over whole texts; the model's size is fixed by its number of hash buckets. NULL and empty texts have
    no features and get the thresholds' own probabilities; repeated rows are graded each.
    """
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score_batches(model, good, least), "doc_id long, expected_grade double, tail_probability double, kept boolean"
    )


def label_grade(quality: Column, toxic: Column) -> Column:
    """The grade of a labelled document: 0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)
