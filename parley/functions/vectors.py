"""Vector columns: similarity, JSON form, and the text-to-vector hook."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 for a zero vector or unequal lengths, NULL for NULL."""
    scale = norm(a) * norm(b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when((F.size(a) != F.size(b)) | (scale == 0), F.lit(0.0))
        .otherwise(F.try_divide(dot(a, b), scale))
    )


def decode_vector(text: Column) -> Column:
    """JSON array text to array<double>; text that is not one becomes NULL."""
    return F.from_json(text, "array<double>", {"mode": "PERMISSIVE"})


def encode_vector(vector: Column) -> Column:
    return F.to_json(vector)
