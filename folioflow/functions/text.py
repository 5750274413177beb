"""Text functions as column expressions: tokens, ratios, phrases, cleaning, snippets, names, similarities.

All stay in the JVM. Letters and digits are Unicode's; a token is a run of them or one other visible character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Text = str | Column

# Word lists and patterns that results depend on.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
LATIN_WORD = r"[A-Za-z0-9][A-Za-z0-9'-]*"
ROMAN = "ivxlcdmIVXLCDM"
PAGE_MARKER = r"(?i)\[Page\s+\d+\]"
#: What (?U)\s stands for.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
CODE_LIKE = r"\b[A-Z]{1,6}[-_/]?\d{2,}\b|\b\d+[A-Z]+[-_/]?\d*\b"
MOJIBAKE = ("Ãƒ", "Ã‚", "Ã¢Â€", "ï¿½")
SEPARATORS = ("|", "\t", "  ", ",", ";", ":")
STOP_WORDS = (
    "a", "about", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "give", "has", "have", "how", "in", "into", "is",
    "it", "me", "much", "novel", "of", "on", "or", "search", "show", "tell", "that", "the", "their", "there", "these", "this", "to", "was", "what", "when",
    "where", "who", "with",
)
ALIASES = {"bhagawat": "bhagavad", "bhagawad": "bhagavad", "brenton": "brunton", "christams": "christmas", "geetha": "gita", "githa": "gita", "ramayana": "ramayan"}


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def computed_once(df: DataFrame, fields: Column) -> DataFrame:
    """df with the fields of a struct as columns. What is filtered by one of them later isn't filtered, and so computed, below this step a second time:
    a filter on measures of measures would be written out in terms of the text itself, once for each time that they name it.
    """
    return df.select("*", F.inline(F.array(fields)))


def found(c: Text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with \b between ASCII letters, digits, underscores and all else, as SQL reads it; Java's \b takes letters of every script for a word's."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def occurrences(c: Text, piece: str) -> Column:
    """How often a piece stands in a text, without overlaps."""
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def token_count(c: Text) -> Column:
    # Of each token one character is left.
    return F.length(F.regexp_replace(col(c), r"([\p{L}\p{N}_])[\p{L}\p{N}_]++|\s++", "$1"))


def stripped(c: Text) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def one_space(c: Text) -> Column:
    """White space made single spaces, none at the ends."""
    # Spaces that stand alone match nothing, so most texts aren't built anew.
    return F.trim(F.regexp_replace(col(c), r"(?U)[\s&&[^ ]]\s*+| \s++", " "))


def words(c: Text) -> Column:
    """Words between white space; none of a blank text."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def lines(c: Text) -> Column:
    """Stripped lines, blank ones as empty texts."""
    return F.transform(F.split(col(c), LINE_BREAK), stripped)


def cleaned_chunk(c: Text) -> Column:
    """Page markers gone, spaces within lines single, blank lines dropped."""
    cut = F.split(F.regexp_replace(col(c), PAGE_MARKER, " "), LINE_BREAK)
    tidy = F.array_join(F.filter(F.transform(cut, one_space), lambda x: x != ""), "\n")
    # One line of single spaces without a marker has nothing to clean but its ends.
    return F.when(col(c).rlike(r"(?U)[\s\x1C-\x1E&&[^ ]]|  |\[[Pp]"), tidy).otherwise(F.trim(col(c)))


def display(c: Text) -> Column:
    return one_space(F.regexp_replace(F.coalesce(col(c), F.lit("")), PAGE_MARKER, " "))


def meaningful(c: Text) -> Column:
    """Latin words of three characters and more that are no Roman numerals."""
    return F.filter(found(c, LATIN_WORD), lambda w: (F.btrim(w, F.lit(ROMAN)) != "") & (F.length(F.btrim(w, F.lit("'-"))) >= 3))


def phrases_in(c: Text, phrases: tuple[str, ...] | list[str]) -> Column:
    """How many of the phrases stand in the text."""
    return reduce(Column.__add__, (col(c).contains(p).cast("int") for p in phrases))


def visible(c: Text) -> Column:
    return F.length(F.regexp_replace(F.replace(col(c), F.lit(" "), F.lit("")), r"(?U)\s++", ""))


def ratio(c: Text, other: str) -> Column:
    """Share of the visible characters that don't match a one-character pattern; null without any. All others are taken out in runs: one match for each character would cost far more."""
    return F.length(F.regexp_replace(col(c), f"{other}++", "")) / F.nullif(visible(c), F.lit(0))


def alpha_ratio(c: Text) -> Column:
    return ratio(c, r"\P{L}")


def digit_ratio(c: Text) -> Column:
    return ratio(c, r"\P{Nd}")


def mojibake_ratio(c: Text) -> Column:
    return reduce(Column.__add__, (occurrences(c, m) for m in MOJIBAKE)) / F.nullif(visible(c), F.lit(0))


def numeric_table(c: Text) -> Column:
    """Digits are a quarter of the visible characters, and separators or codes are there."""
    separators = reduce(Column.__add__, (occurrences(c, s) for s in SEPARATORS))
    return F.coalesce(digit_ratio(c) >= 0.25, F.lit(False)) & ((separators >= 3) | (F.regexp_count(col(c), F.lit(ascii_bounds(CODE_LIKE))) >= 2))


def line_key(c: Text) -> Column:
    return F.lower(one_space(c))


def page_range(c: Text) -> tuple[Column, Column]:
    """Least and greatest number of the page markers."""
    pages = F.transform(found(c, r"(?i)\[Page\s+(\d+)\]", 1), lambda p: p.cast("int"))
    return F.array_min(pages), F.array_max(pages)


def alias(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(names[c], c)


def search_terms(c: Text) -> Column:
    """Lower-cased words of three characters and more that are no stop words, by their alias, with repeats."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    cut = F.transform(found(c, LATIN_WORD), lambda w: F.lower(F.btrim(w, F.lit("'-"))))
    return F.transform(F.filter(cut, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)), alias)


def normalised(c: Text) -> Column:
    """Lower-cased words by their alias, with single spaces."""
    return F.array_join(F.transform(found(c, LATIN_WORD), lambda w: alias(F.lower(F.btrim(w, F.lit("'-"))))), " ")


def phrase_in(phrase: Text, text: Text) -> Column:
    """The normalised phrase is a part of the normalised text; an empty one never is."""
    p = normalised(phrase)
    return F.coalesce((p != "") & F.contains(normalised(text), p), F.lit(False))


def snippet(text: Text, query: Text, size: int = 320) -> Column:
    """At most `size` characters around the first word of the query, with dots where text is left out."""
    clean = one_space(text)
    asked = F.transform(F.filter(words(query), lambda w: F.length(w) > 2), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit("")), F.lit(r"\E")))
    pattern = F.concat(F.lit("(?i)"), F.array_join(asked, "|"))
    hit = F.when(F.size(asked) > 0, F.regexp_instr(clean, pattern)).otherwise(F.lit(0))
    start = F.greatest(hit - 1 - size // 3, F.lit(0))
    end = F.least(start + size, F.length(clean))
    middle = stripped(F.substring(clean, start + 1, end - start))
    around = F.concat(F.when(start > 0, "...").otherwise(""), middle, F.when(end < F.length(clean), "...").otherwise(""))
    head = F.concat(F.rtrim(F.substring(clean, 1, size - 3)), F.lit("..."))
    return F.when(F.length(clean) <= size, clean).when(hit > 0, around).otherwise(head)


def name_key(c: Text) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def type_key(c: Text, default: str) -> Column:
    key = F.btrim(F.regexp_replace(F.upper(stripped(c)), "[^A-Za-z0-9_]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(key, F.lit("")), F.lit(default))


def trigrams(c: Text) -> Column:
    """Distinct trigrams of lower-cased words, each padded by two spaces before it and one behind it."""
    padded = F.transform(F.filter(F.split(F.lower(col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of trigrams: shared ones over all of them; 0 without any."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def json_in(c: Text) -> Column:
    """The JSON a model's answer holds: a fenced block, else from the first brace or bracket to the last."""
    fenced = F.nullif(F.regexp_extract(col(c), r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(col(c), r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    return stripped(F.coalesce(fenced, braced, col(c)))


def trace_parent(c: Text) -> Column:
    """struct(version, trace_id, span_id, flags) of a traceparent header; null if it is none."""
    pattern = r"^([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    part = lambda i: F.regexp_extract(F.lower(F.trim(col(c))), pattern, i)
    valid = (part(2) != "") & (part(2) != "0" * 32) & (part(3) != "0" * 16)
    return F.when(valid, F.struct(part(1).alias("version"), part(2).alias("trace_id"), part(3).alias("span_id"), part(4).alias("flags")))
