"""Licence scans: an Aho-Corasick automaton over the words of whole texts, and licence expressions behind identifier tags.

A-Z are lower-cased and texts cut into words; the automaton runs over the words joined by single spaces, so a phrase is found
wherever its words stand consecutively, whatever stands between them. Behind an identifier tag, the rest of the line, up to the next tag, is
read as a licence expression: the shunting-yard algorithm orders its operators and a stack evaluates it. Names count as licences if LICENCES or
EXCEPTIONS knows them, with a version behind the family's name or none, or if they begin with LicenseRef-. A name that neither knows counts as an
unknown licence where an operator in capitals stands beside it, as an unknown exception if it says that it is one; an expression ends where another
word stands.

Every licence has a restriction from 0 (anything goes) to 1 (all rights reserved). `a OR b` leaves the choice: the lesser one; `a AND b`
binds to both: the greater one; `a WITH e` halves that of a, and e is a label too. A text's score is the greatest of its findings', 0 without any.

Cases: a null or empty text has no words and no findings; an expression that ends with an operator is read as far as it is whole, one with a
parenthesis that is never closed as all its names joined by AND; repeated rows give repeated result rows; a null id stays null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_table, map_arrow, utf8

DELIMITERS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TABLE = lower_table(DELIMITERS)

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TAG = "spdx license identifier"
WORD = re.compile(rb"[^\t-\r ]+")
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "released into the public domain": "public-domain",
    "no part of this publication may be reproduced": "reserved",
    "confidential and proprietary": "proprietary",
}
#: Restriction by a licence's family.
LICENCES = {
    "cc0": 0.0, "unlicense": 0.0, "public-domain": 0.0, "0bsd": 0.0, "wtfpl": 0.0, "pddl": 0.0,
    "mit": 0.1, "mit-0": 0.1, "bsd": 0.1, "isc": 0.1, "apache": 0.1, "boost": 0.1, "bsl": 0.1, "zlib": 0.1, "python": 0.1, "psf": 0.1, "ncsa": 0.1, "x11": 0.1,
    "postgresql": 0.1, "curl": 0.1, "openssl": 0.1, "artistic": 0.2, "cc-by": 0.2, "odc-by": 0.2, "ofl": 0.2, "afl": 0.2, "ms-pl": 0.2, "ecl": 0.2,
    "mpl": 0.4, "lgpl": 0.4, "epl": 0.4, "cddl": 0.4, "cpl": 0.4, "eupl": 0.4, "ms-rl": 0.4, "gfdl": 0.5, "cc-by-sa": 0.5, "odbl": 0.5, "osl": 0.5, "gpl": 0.6, "agpl": 0.7, "sspl": 0.8,
    "vim": 0.1, "ruby": 0.1, "upl": 0.1, "w3c": 0.1, "hpnd": 0.1, "blueoak": 0.1, "unicode-dfs": 0.1, "unicode-tou": 0.1, "unicode": 0.1, "json": 0.1, "beerware": 0.1, "libpng": 0.1, "libtiff": 0.1, "icu": 0.1, "bzip2": 0.1, "ntp": 0.1, "fsfap": 0.1,
    "tcl": 0.1, "xfree86": 0.1, "php": 0.1, "zpl": 0.1, "mulanpsl": 0.1, "naist": 0.1, "cecill-b": 0.1, "lppl": 0.2, "sleepycat": 0.4, "cecill-c": 0.4, "cecill": 0.6, "cpal": 0.5, "apsl": 0.4, "npl": 0.4, "spl": 0.4, "ipl": 0.4, "rpl": 0.6, "qpl": 0.6, "parity": 0.7, "elastic": 0.8,
    "cc-by-nd": 0.8, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.8, "busl": 0.9, "proprietary": 1.0, "reserved": 1.0,
}
#: Families of exceptions that follow WITH.
EXCEPTIONS = ("classpath-exception", "autoconf-exception", "bison-exception", "gcc-exception", "font-exception", "llvm-exception", "linux-syscall-note", "openssl-exception", "u-boot-exception", "swift-exception", "ocaml-lgpl-linking-exception", "lgpl-3.0-linking-exception", "mif-exception", "wxwindows-exception", "eclipse-public-license-exception")
REFERENCE, OF_REFERENCE = ("licenseref-", "documentref-"), 0.9
UNKNOWN = 0.9
#: Characters of a licence's name at most, references aside.
LONGEST = 64
#: What may follow a family's name: a version, its clauses or variant.
VERSION = re.compile(r"(?:-v?[0-9]+(?:\.[0-9]+)*[a-z]?(?:-[a-z]+)?)?(?:-clause(?:-[a-z]+)*|-only|-or-later|-universal)?\+?")

TOKEN = re.compile(rb"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*(?::[A-Za-z0-9.+-]+)?")
BEHIND_TAG = re.compile(rb"[\x20\t\r\f\v]*:?")
#: What an expression can be made of: another character ends it.
GAP = re.compile(rb"[\x20\t\r\f\v]*")
BINDS = {"or": 1, "and": 2, "with": 3}


@lru_cache(1 << 12)
def family(low: str, exception: bool = False) -> str | None:
    """The longest known name that a lower-cased one is, a version or variant aside."""
    return max((k for k in (EXCEPTIONS if exception else LICENCES) if low.startswith(k) and VERSION.fullmatch(low, len(k))), key=len, default=None)


def restriction(name: str) -> float:
    if name.lower().startswith(REFERENCE):
        return OF_REFERENCE
    found = family(name.lower())
    return UNKNOWN if found is None else LICENCES[found]


def is_name(token: str, exception: bool = False) -> bool:
    """Whether a token names a licence, or, behind WITH, an exception."""
    if token.lower().startswith(REFERENCE):
        return True
    return len(token) <= LONGEST and family(token.lower(), exception) is not None


#: A name that no list knows: with a capital letter or a digit, as identifiers have, unless it is the tag itself.
UNLISTED = re.compile(r"(?=[^A-Z0-9]*[A-Z0-9])[A-Za-z0-9][A-Za-z0-9.+-]*")
UNLISTED_EXCEPTION = re.compile(r"(?i)[a-z0-9][a-z0-9.+-]*(?:exception|note|linking)[a-z0-9.+-]*")
OPERATOR = re.compile(rb"[\x20\t\r\f\v]+(?:AND|OR|WITH)(?![A-Za-z0-9.+-])")
CAPITALS = ("AND", "OR", "WITH")


def is_unlisted(token: str, before: str | None, operator_behind: bool) -> bool:
    """Whether a token that no list knows is a name by what stands beside it."""
    if len(token) > LONGEST or token.lower() == TAG.replace(" ", "-") or token.lower() in BINDS:
        return False
    if before is not None and before.lower() == "with":
        return before == "WITH" and UNLISTED_EXCEPTION.fullmatch(token) is not None
    return (before in CAPITALS or operator_behind) and UNLISTED.fullmatch(token) is not None


def tokens_of(raw: bytes, start: int = 0, end: int | None = None) -> list[str]:
    """Tokens of the longest whole expression that raw[start:end] begins with, nothing but blanks between them.

    If a parenthesis is never closed, the names read so far joined by AND.
    """
    tokens: list[str] = []
    end = len(raw) if end is None else end
    depth, operand, whole, at = 0, False, 0, start
    while m := TOKEN.match(raw, GAP.match(raw, at, end).end(), end):
        token = m[0].decode("ascii").rstrip(".-")
        low = token.lower()
        if low in BINDS:
            if not operand or (low == "with" and tokens[-1] == ")"):
                break
            operand = False
        elif token == "(":
            if operand or (tokens and tokens[-1].lower() == "with"):
                break
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            depth -= 1
        elif operand:
            break
        elif not is_name(token, bool(tokens) and tokens[-1].lower() == "with") and not is_unlisted(token, tokens[-1] if tokens else None, OPERATOR.match(raw, m.end(), end) is not None):
            break
        else:
            operand = True
        tokens.append(token)
        at = m.end()
        if operand and not depth:
            whole = len(tokens)
        if len(m[0]) != len(token):  # a full stop behind a name ends the sentence
            break
    if depth:  # never closed
        return [x for t in tokens if t not in ("(", ")") and t.lower() not in BINDS for x in ("and", t)][1:]
    return tokens[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """A whole expression in postfix order, by the shunting-yard algorithm."""
    out: list[str] = []
    waiting: list[str] = []
    for token in tokens:
        low = token.lower()
        if low in BINDS:
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[low]:
                out.append(waiting.pop())
            waiting.append(low)
        elif token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
        else:
            out.append(token)
    return out + waiting[::-1]


def evaluate(text: bytes | str, start: int = 0, end: int | None = None) -> tuple[set[str], float] | None:
    """(names, restriction) of the licence expression that the text begins with; None if it begins with none."""
    tokens = tokens_of(text.encode() if isinstance(text, str) else text, start, end)
    if not tokens:
        return None
    names = {t.lower() for t in tokens if t not in ("(", ")") and t.lower() not in BINDS}
    stack: list[float] = []
    for token in postfix(tokens):
        if token not in BINDS:
            stack.append(restriction(token))
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left / 2 if token == "with" else min(left, right) if token == "or" else max(left, right))
    return names, stack[0]


class Scanner:
    def __init__(self):
        owners: dict[str, list[tuple[str, bool]]] = {}
        for phrases, base in ((BASE, True), (NOTICES, False)):
            for phrase, label in phrases.items():
                owners.setdefault(f" {phrase} ", []).append((label, base))
        owners.setdefault(f" {TAG} ", [])
        self.automaton = ahocorasick.Automaton()
        for phrase, labels in owners.items():
            self.automaton.add_word(phrase, (phrase, labels))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[str, bool, int]], float]:
        """(words, findings (label, base, first word), score)."""
        words = raw.translate(TABLE).split()
        text = f" {b' '.join(words).decode('latin-1')} " if words else ""
        findings, tags, score, counted, word = [], [], 0.0, 0, 0
        ends = None  # of the words in raw
        hits = sorted((last + 1 - len(phrase), phrase, labels) for last, (phrase, labels) in self.automaton.iter(text))
        for at, phrase, labels in hits:
            word += text.count(" ", counted, at)
            counted = at
            for label, base in labels:
                findings.append((label, base, word))
                score = max(score, restriction(label))
            if phrase.strip() == TAG:
                if ends is None:
                    ends = [m.end() for m in WORD.finditer(raw.translate(TABLE))]
                tags.append((word, ends[word + TAG.count(" ")]))
        for k, (word, end) in enumerate(tags):
            start = BEHIND_TAG.match(raw, end).end()
            stop = raw.find(b"\n", start, tags[k + 1][1] if k + 1 < len(tags) else len(raw))
            if stop < 0:
                stop = tags[k + 1][1] if k + 1 < len(tags) else len(raw)
            if found := evaluate(raw, start, stop):
                findings += [(name, False, word) for name in sorted(found[0])]
                score = max(score, found[1])
        return len(words), findings, score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, findings array<struct<label, base, word>>, score)."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("word", pa.int64())]))

    def make():
        scanner = Scanner()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [scanner.scan(t or b"") for t in utf8(batch.column(1))]
            n = pa.array([n for n, _, _ in found], pa.int64())
            findings = pa.array([[{"label": a, "base": b, "word": w} for a, b, w in f] for _, f, _ in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), n, findings, pa.array([s for _, _, s in found], pa.float64())], ["doc_id", "n_words", "findings", "score"])

        return each

    id_kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_kind}, n_words long, findings array<struct<label:string,base:boolean,word:long>>, score double"
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, schema)


def op4_aho_corasick(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.expr("filter(findings, f -> f.base)")
    labels = lambda fs: F.array_join(F.array_sort(F.array_distinct(F.transform(fs, lambda f: f["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("findings")).alias("labels"),
        "score",
    )


QUERIES = {"op4_aho_corasick": op4_aho_corasick}
ORACLES: dict[str, str] = {}
