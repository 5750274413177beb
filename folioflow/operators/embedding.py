"""Vectors for chunks: the text that is embedded, models as vectorised functions, only missing ones, bad ones apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T

#: Vector sizes of known models. Chat models are no embedding models.
DIMENSIONS = {"nomic-embed-text": 768, "mxbai-embed-large": 1024, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072}
CHAT_MARKS = ("gpt", "chat", "llama", "mistral", "instruct")
TEXTS_A_CALL = 64


def model_error(model: str, dimension: int) -> str | None:
    if any(m in model.lower() for m in CHAT_MARKS) and "embed" not in model.lower():
        return f"{model} is a chat model"
    known = DIMENSIONS.get(model.split(":")[0])
    return f"{model} has {known} dimensions, not {dimension}" if known not in (None, dimension) else None


def input_text(title: str, chunk: str, section: str | None = None, author: str | None = None, category: str | None = None, page_start: str | None = None, page_end: str | None = None) -> Column:
    """Labelled lines of context, then the chunk without page markers, control characters and its own title."""
    label = lambda name, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))) if c else None
    pages = F.when(F.col(page_start) > 0, F.concat(F.lit("Page: "), F.col(page_start).cast("string"), F.when(F.col(page_end) != F.col(page_start), F.concat(F.lit("-"), F.col(page_end).cast("string"))).otherwise(""))) if page_start else None
    lines = [c for c in (label("Title", title), label("Author", author), label("Category", category), label("Section", section), pages) if c is not None]
    clean = F.regexp_replace(F.regexp_replace(F.col(chunk), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), T.PAGE_MARKER, " ")
    name = T.stripped(F.coalesce(title, F.lit("")))
    own = F.regexp_replace(clean, F.concat(F.lit(r"(?i)\b\Q"), F.replace(name, F.lit(r"\E"), F.lit("")), F.lit(r"\E\b\s*\d*")), F.lit(" "))
    return T.stripped(F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), T.one_space(F.when(name == "", clean).otherwise(own))))


def hashed(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """The repeatable stand-in for a model: the bytes of SHA-256 over 255."""
    import hashlib

    return lambda texts: np.array([np.resize(np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8), dimension) / 255 for t in texts])


def embedded(chunks: DataFrame, model: Callable[[list[str]], np.ndarray], dimension: int, text: str = "text", size: int = TEXTS_A_CALL) -> DataFrame:
    """chunks with vector and error. A call that fails is tried again by halves, down to single texts, whose failure is a row."""

    def call(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            got = np.asarray(model(texts), np.float64)
            if got.shape != (len(texts), dimension):
                raise ValueError(f"{got.shape} instead of {(len(texts), dimension)}")
            return [(v.tolist(), None) for v in got]
        except Exception as e:  # noqa: BLE001  a failure is a result here
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(texts) // 2
            return call(texts[:half]) + call(texts[half:])

    @F.pandas_udf("vector array<double>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [r for i in range(0, len(texts), size) for r in call(texts.iloc[i : i + size].tolist())]
            yield pd.DataFrame(found, columns=["vector", "error"])

    return chunks.withColumn("__out", run(F.coalesce(F.col(text), F.lit("")))).select(*chunks.columns, "__out.vector", "__out.error")
