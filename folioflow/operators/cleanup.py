"""Clean-up of texts extracted from PDF pages, with counts of what was removed and repaired.

Pages and lines are rows: running headers are found by an aggregate over a document's lines, other lines by tests; then the text is put together
again by document. Unicode's compatibility form has no built-in function and is a vectorised UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions import text as T

HEADER_SHARE, LEAST_PAGES, HEADER_CHARS, HEADER_WORDS = 0.25, 3, 80, 8
# Lines of publishers, and words that lost their space.
BOILERPLATE_LINES = ("download free ebooks", "email newsletter", "free ebooks at planet ebook", "free ebooks blog", "planet ebook.com", "subscribe to our free ebooks")
JOINED = {"andpresented": "and presented", "hadwarned": "had warned", "threequarters": "three quarters"}
MARKER = r"(?i)^\[Page\s+\d+\]$"


@F.pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def joined_lines(text: Column) -> Column:
    """Hyphens at line ends and at wrapped words gone."""
    once = F.regexp_replace(text, r"([A-Za-z])-\s*\n\s*([a-z])", "$1$2")
    return F.regexp_replace(once, T.ascii_bounds(r"\b([A-Za-z]{3,})-\s+([a-z]{2,})\b"), "$1$2")


def drop_caps(text: Column) -> Column:
    """A capital alone on its line put before the small letters that follow."""
    return F.regexp_replace(text, r"(?m)(^|\n)([A-Z])\s*\n+\s*([a-z][^\n]*)", "$1$2$3")


def repaired(text: Column) -> tuple[Column, Column]:
    """(text, repairs) with joined words apart."""
    count = sum((F.regexp_count(text, F.lit(T.ascii_bounds(rf"\b{w}\b"))) for w in JOINED), F.lit(0))
    for wrong, right in JOINED.items():
        text = F.regexp_replace(text, T.ascii_bounds(rf"\b{wrong}\b"), right)
    return text, count


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, text, repeated_lines, boilerplate_lines, page_number_lines, joined_words)."""
    whole = docs.select(key, F.regexp_replace(compatibility_form(F.coalesce(F.col(text), F.lit(""))), "[\\uF000-\\uF8FF]", "").alias("t"))
    pages = F.filter(F.transform(F.split("t", r"(?im)(?=^\[Page\s+\d+\]$)"), T.stripped), lambda p: p != "")
    by_page = whole.select(key, F.size(pages).alias("pages"), F.posexplode_outer(pages).alias("page", "body"))
    rows = by_page.select(key, "pages", "page", F.posexplode_outer(T.lines("body")).alias("line", "text")).withColumn("line_key", T.line_key("text"))
    boiler = T.phrases_in("line_key", BOILERPLATE_LINES) > 0
    marker = F.col("text").rlike(MARKER)
    running = (F.col("line_key") != "") & ~marker & ~boiler & (F.length("line_key") <= HEADER_CHARS) & (F.size(T.words("line_key")) <= HEADER_WORDS)
    enough = F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("pages") * HEADER_SHARE))
    repeated = rows.where(running & (F.col("pages") >= LEAST_PAGES)).groupBy(key, "pages", "line_key").agg(F.count_distinct("page").alias("on")).where(F.col("on") >= enough).select(key, "line_key", F.lit(True).alias("repeated"))
    number = F.try_to_number(F.when(F.col("line_key").rlike(r"^\d{1,4}$"), F.col("line_key")), F.lit("9999")).cast("int")
    numbered = F.coalesce(number.between(1, F.greatest(F.col("pages") + 5, F.lit(10))), F.lit(False))
    told = rows.join(repeated, [key, "line_key"], "left").withColumn(
        "what", F.when((F.col("text") == "") | marker, "keep").when(F.coalesce("repeated", F.lit(False)), "repeated").when(boiler, "boilerplate").when(numbered, "number").otherwise("keep")
    )
    # A page's kept lines in order, blank ones single; then a document's pages.
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == "keep", F.struct("line", "text")))), lambda s: s["text"]), "\n")
    count = lambda what: F.count_if(F.col("what") == what)
    page = told.groupBy(key, "page").agg(T.stripped(F.regexp_replace(kept, "\n{3,}", "\n\n")).alias("body"), *(count(w).alias(w) for w in ("repeated", "boilerplate", "number")))
    body = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda s: s["body"]), lambda b: b != ""), "\n\n")
    doc = page.groupBy(key).agg(body.alias("t"), *(F.sum(w).alias(c) for w, c in (("repeated", "repeated_lines"), ("boilerplate", "boilerplate_lines"), ("number", "page_number_lines"))))
    fixed, repairs = repaired(drop_caps(joined_lines(F.col("t"))))
    return doc.select(key, T.stripped(fixed).alias("text"), "repeated_lines", "boilerplate_lines", "page_number_lines", repairs.alias("joined_words"))
