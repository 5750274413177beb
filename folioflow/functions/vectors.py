"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def hashed_embedding(text: Column, dimension: int) -> Column:
    """A repeatable stand-in for a model's vector: the bytes of the text's SHA-256 over 255, over and over."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255)
