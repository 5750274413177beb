"""Personal data: patterns for emails, addresses, cards and phones, and terms that disclose them by co-occurrence.

The patterns give the protected entities. All words of the documents that hold an entity are its candidate terms. They are counted twice,
by the words near its places and by whole documents; a term that discloses by either count is marked wherever it stands in every
document that holds the entity. Over the whole corpus, the
pointwise mutual information of term and entity, PMI = log(n(e,t) N / (n(e) df(t))), is held against the entity's own
information, IC = log(N / n(e)): a term whose PMI is at least DISCLOSES of the IC tells about as much as the entity itself. n(e) and
n(e,t) count different contexts, so that copies of one passage count once; df(t) counts documents. Terms met in one
context only tell nothing about the corpus and stay. Disclosing terms are generalised to a class, and removed from REMOVES on.

The corpus is read twice: for entities with their contexts, and for the df of all words; documents with an entity are stored and
read twice more. Fixed-size bit tables of hashes keep other words out of the shuffles; they only save work.

Cases: null and empty texts have no spans; repeated rows give repeated result rows and count as documents each; a null id
stays null; an empty table gives an empty result; other columns are ignored by find() and kept by sanitise().
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, pieces

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
NEAR_WORDS = 6
LEAST_CONTEXTS = 2
DISCLOSES, REMOVES = 0.75, 0.95
TABLE_BITS = 22
SEED = 42

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{2,}")
#: Letters of a word that counts towards NEAR_WORDS; shorter ones between are taken as well.
COUNTED = 3
#: Pairs of an entity and a word that are handed on at once.
PAIRS = 1 << 16
#: Words that a task counts before it hands its counts on.
COUNTED_WORDS = 1 << 18
NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with what stands before it, as far back as the last match, and a domain behind it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        at += 1
        if start < at - 1 and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            at = done = m.end()


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that hold what the kind asks for, by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def entity(text: str, span: Span) -> int:
    """A hash of what the span names, however it is written."""
    kind, start, end = span
    value = text[start:end].lower() if kind == "email" else text[start:end] if kind == "ip" else NOT_DIGITS.sub("", text[start:end])
    return xxhash.xxh64_intdigest(f"{kind}:{value}".encode(), SEED)


def words_outside(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words that don't lie in a span."""
    taken = sorted((a, b) for _, a, b in spans)
    words, k, reach = [], 0, 0
    for m in WORD.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][1])
            k += 1
        if m.start() >= reach:
            words.append((m[0].lower(), *m.span()))
    return words


def contexts(text: str, spans: list[Span]) -> list[tuple[int, int, int, list[str]]]:
    """(entity, hash of the context, hash of the entity's contexts in the document, words near it) of each span."""
    if not spans:
        return []
    words = words_outside(text, spans)
    starts = np.array([a for _, a, _ in words], np.int64)
    counted = np.array([i for i, (w, _, _) in enumerate(words) if len(w) >= COUNTED], np.int64)
    places = []
    for span in spans:
        at = int(np.searchsorted(counted, np.searchsorted(starts, span[1])))
        low = int(counted[at - NEAR_WORDS]) if at >= NEAR_WORDS else 0
        high = int(counted[at + NEAR_WORDS - 1]) + 1 if at + NEAR_WORDS <= len(counted) else len(words)
        near = [w for w, _, _ in words[low:high]]
        places.append((entity(text, span), xxhash.xxh64_intdigest(" ".join(near).encode(), SEED), near))
    own: dict[int, set[int]] = {}
    for e, c, _ in places:
        own.setdefault(e, set()).add(c)
    document = {e: xxhash.xxh64_intdigest(np.array(sorted(cs), np.uint64).tobytes(), SEED) for e, cs in own.items()}
    return [(e, c, document[e], near) for e, c, near in places]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


SPANS = "array<struct<kind:string,start:long,end:long>>"
CONTEXTS = "array<struct<entity:long,context:long,document:long,words:array<string>>>"


def _scanned(docs: DataFrame, text_col: str, with_clean: bool = True) -> DataFrame:
    """docs with __spans and __contexts added, the text null where there is no span; without with_clean only the rows that have one."""
    at = docs.columns.index(text_col)
    kinds = [pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("document", pa.int64()), ("words", pa.list_(pa.string()))]))]

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            spans = [base_spans(t) for t in texts]
            if not with_clean:
                keep = pa.array([bool(s) for s in spans], pa.bool_())
                batch, texts, spans = batch.filter(keep), [t for t, s in zip(texts, spans, strict=True) if s], [s for s in spans if s]
            near = [contexts(t, s) for t, s in zip(texts, spans, strict=True)]
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            around = [[{"entity": _signed(e), "context": _signed(c), "document": _signed(d), "words": ws} for e, c, d, ws in n] for n in near]
            columns = list(batch.columns)
            columns[at] = pa.array([t if s else None for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kinds[0]), pa.array(around, kinds[1])], [*batch.schema.names, "__spans", "__contexts"])

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, make, f"{schema}, __spans {SPANS}, __contexts {CONTEXTS}")


def _bit_table(rows: DataFrame, value: F.Column):
    """Broadcast of a table of 2 ** TABLE_BITS bits in which those of the values are set."""
    bit = F.pmod(value, F.lit(1 << TABLE_BITS))
    cells = rows.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    for r in cells.collect():  # at most 2 ** (TABLE_BITS - 6) rows
        table[r["cell"]] = r["bits"] % (1 << 64)
    return rows.sparkSession.sparkContext.broadcast(table.tobytes())


def _held(shared) -> bytes:
    """The broadcast table with a byte for each bit."""
    return np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").tobytes()


def _own_words(scanned: DataFrame, shared, placed: bool) -> DataFrame:
    """Words of the documents beside each of their entities, one row a document context and word, or placed: one row a place.

    shared: a bit table of entities, or, placed, of pairs of an entity and a term.
    """
    names = ["row", "entity", "document", "term", "start", "end"] if placed else ["entity", "document", "term"]

    def make():
        held, mask, digest = _held(shared), (1 << TABLE_BITS) - 1, xxhash.xxh64_intdigest

        def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
            for row, text, spans, around in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {c["entity"]: c["document"] for c in around}
                if not placed:
                    own = {e: d for e, d in own.items() if held[e & mask]}
                if not own:
                    continue
                words = words_outside(text, [(s["kind"], s["start"], s["end"]) for s in spans])
                if placed:
                    hashes = {w: digest(w.encode(), SEED) for w, _, _ in words}
                    for e, d in own.items():
                        hit = {w for w, h in hashes.items() if held[(e ^ h) & mask]}
                        yield from ((row, e, d, w, a, b) for w, a, b in words if w in hit) if hit else ()
                else:
                    distinct = sorted({w for w, _, _ in words})
                    yield from ((e, d, w) for e, d in own.items() for w in distinct)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = rows_of(batch)
            while some := list(islice(found, PAIRS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "term" else pa.int64()) for n, c in zip(names, zip(*some, strict=True), strict=True)], names)

        return each

    kinds = ", ".join(f"{n} {'string' if n == 'term' else 'long'}" for n in names)
    return map_arrow(scanned.select("__row", "__text", "__spans", F.transform("__contexts", lambda c: F.struct(c["entity"].alias("entity"), c["document"].alias("document"))).alias("around")), make, kinds)


def document_frequency(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows (term, df): documents of docs that hold each word.

    All words are counted, not only the candidate terms: the number of those grows faster than the corpus, that of a task's words doesn't.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "df"])

        for batch in batches:
            for piece in pieces(batch):
                for text in piece.column(0).to_pylist():
                    if text:
                        counts.update({w.lower() for w in WORD.findall(text)})
                    if len(counts) > COUNTED_WORDS:
                        yield counted()
                        counts.clear()
        if counts:
            yield counted()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, df long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(near: DataFrame, scanned: DataFrame, docs: DataFrame, text_col: str, total: int, scratch: Scratch) -> DataFrame:
    """Rows (entity, term, ratio) of the disclosing terms. near: rows (entity, whole, context, words)."""
    by_entity = near.groupBy("entity", "whole", "context").count().groupBy("entity", "whole").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= LEAST_CONTEXTS)
    by_entity = scratch.keep(by_entity)
    if by_entity.isEmpty():
        return by_entity.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("ratio"))
    whole = _own_words(scanned, _bit_table(by_entity.where("whole"), F.col("entity")), False)
    places = near.where("not whole").select("entity", "whole", "context", F.explode("words").alias("term"))
    places = places.unionByName(whole.select("entity", F.lit(True).alias("whole"), F.col("document").alias("context"), "term"))
    by_pair = places.distinct().groupBy("entity", "whole", "term").agg(F.count("*").alias("together")).where(F.col("together") >= LEAST_CONTEXTS)
    pairs = scratch.keep(by_pair.join(by_entity, ["entity", "whole"]))
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("ratio"))
    counted = pairs.join(document_frequency(docs, text_col), "term")
    # Logarithms of counts; an entity in every document tells nothing.
    information = F.log(F.lit(float(total)) / F.col("contexts"))
    pmi = F.log(F.col("together") * F.lit(float(total)) / (F.col("contexts") * F.col("df")))
    ratio = F.when(information > 0, pmi / information)
    found = counted.select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= DISCLOSES)
    return scratch.keep(found.groupBy("entity", "term").agg(F.max("ratio").alias("ratio")))


def _with_terms(scanned: DataFrame, docs: DataFrame, text_col: str, total: int, scratch: Scratch) -> DataFrame:
    """scanned, a stored table with __row and __text, with __terms added: array<struct<start, end, ratio>> of disclosing terms, or null."""
    near = scanned.select(F.explode("__contexts").alias("c")).select("c.*")
    # Twice: by the words near a place, and by the document.
    both = near.select("entity", F.explode(F.array(F.struct(F.lit(False).alias("whole"), "context", "words"), F.struct(F.lit(True).alias("whole"), F.col("document").alias("context"), F.array().cast("array<string>").alias("words")))).alias("x")).select("entity", "x.*")
    told = disclosing(both, scanned, docs, text_col, total, scratch)
    held = _bit_table(told, F.col("entity").bitwiseXOR(F.xxhash64("term")))
    marked = _own_words(scanned, held, True).withColumnRenamed("row", "__row").join(told, ["entity", "term"])
    # A row's own spans: no more of them than the row has words.
    spans = marked.groupBy("__row", "start", "end").agg(F.max("ratio").alias("ratio"))
    spans = spans.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "ratio"))).alias("__terms"))
    return scanned.join(spans, "__row", "left")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, spans, terms): base spans by kind, then start; disclosing terms with their ratio."""
    scratch = Scratch(docs.sparkSession, "pii")
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = scratch.keep(_scanned(given, "text").withColumnRenamed("text", "__text").withColumn("__row", F.monotonically_increasing_id()))
    has = F.size("__contexts") > 0
    found = _with_terms(scanned.where(has), given, "text", scanned.count(), scratch)
    empty = F.array().cast("array<struct<start:long,end:long,ratio:double>>")
    return found.select("doc_id", F.col("__spans").alias("spans"), F.coalesce("__terms", empty).alias("terms")).unionByName(
        scanned.where(~has).select("doc_id", F.col("__spans").alias("spans"), empty.alias("terms"))
    )


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every base span of the text replaced by its kind, disclosing terms generalised or removed."""
    scratch = Scratch(docs.sparkSession, "pii")
    plain = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col(text_col).alias("__text"))
    scanned = scratch.keep(_scanned(plain, "__text", with_clean=False).withColumn("__row", F.monotonically_increasing_id()))
    found = _with_terms(scanned, plain, "__text", plain.count(), scratch).drop("__row", "__contexts")
    columns, at = list(docs.columns), docs.columns.index(text_col)

    def make_clean():
        return lambda batch: [batch.filter(pa.array([not base_spans(t or "") for t in batch.column(at).to_pylist()], pa.bool_()))]

    def make_dirty():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            i = {name: k for k, name in enumerate(batch.schema.names)}
            texts = [
                replaced(t, [(s["kind"], s["start"], s["end"]) for s in spans], [(s["start"], s["end"], s["ratio"]) for s in terms or ()])
                for t, spans, terms in zip(*(batch.column(i[c]).to_pylist() for c in ("__text", "__spans", "__terms")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(i[f"c{k}"]) for k in range(len(columns))], columns)

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs, make_clean, schema).unionByName(map_arrow(found, make_dirty, schema))


def replaced(text: str, spans: list[Span], terms: list[tuple[int, int, float]]) -> str:
    """The text with its spans, united where they overlap, replaced by [KIND], and its terms by [NAME] or [TERM] or nothing."""
    marks = sorted([(a, -b, f"[{kind.upper()}]") for kind, a, b in spans] + [(a, -b, "" if r >= REMOVES else "[NAME]" if text[a].isupper() else "[TERM]") for a, b, r in terms])
    out, done, last = [], 0, -1
    for a, b, label in marks:
        if a < last:  # overlaps the one before: its label stands for both
            last = done = max(done, -b)
            continue
        out += [text[done:a], label]
        last = done = -b
    return "".join([*out, text[done:]])


def op8_pmi_sanitiser(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    terms = F.transform("terms", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("spans"), 256).alias("base_sha256"), joined(F.concat("spans", terms)).alias("spans"))


QUERIES = {"op8_pmi_sanitiser": op8_pmi_sanitiser}
ORACLES: dict[str, str] = {}
