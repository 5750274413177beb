"""Quality rules: counts of a text, and the likelihood ratio of its hashed n-grams between trusted texts and the whole corpus.

Words and pairs of words are hashed into BUCKETS. Over all documents their counts give the corpus's multinomial; over the trusted
ones that of the target. A document's score is the mean log ratio of the two over its n-grams. It passes if that is no less than the
threshold: the score that tells the labelled documents' two qualities apart best, a lost good one weighing GOOD_WEIGHT times a kept bad one.

Trusted are all labelled documents of quality 1 that aren't toxic; nothing is a sample.
Half of them, by a hash of the id, make the target; the other half, and all documents of quality 0, the threshold, since a text scores higher where its own
n-grams were counted. Without documents of quality 0 the threshold is the LEAST quantile of the good ones' scores.
Words, lines and windows are told apart exactly: by their bytes, or, in a text of more than HASH_BYTES, by 64-bit hashes of which the bytes
say that no two different ones are equal; if any are, another seed is taken. Such a text is gone through in parts of about HASH_BYTES.

Cases: null and empty texts have no words and fail; repeated rows give repeated result rows, each counted; a null id isn't trusted;
without trusted documents only the base rules count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xxhash import xxh64_intdigest as digest

from .common import Scratch, map_arrow, pieces, utf8

BUCKET_BITS = 16
GOOD_WEIGHT, LEAST, SEED = 3.0, 0.01, 5
TARGET, HELD, BAD = 1, 2, 3
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = b"#*$%&|<>"
#: Bytes of text that are worked on at once; a longer text stands alone.
HASH_BYTES = 1 << 20
#: Windows of words that are sorted at once, and n-grams that are counted at once.
SORTED, COUNTED = 1 << 21, 1 << 18
#: Buckets whose sums travel in one row.
SLOT = 1024
#: Bits of a place in the table of ids (8 MB, whatever the corpus), and of a place in one of its slices.
MARK_BITS, SLICE_BITS = 26, 20

MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
WORD, SPACES, NEWLINE = re.compile(rb"[^\x20\t-\r]+"), re.compile(rb"[\x20\t-\r]+"), re.compile(rb"\n")
SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
CHARS = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)]) & (np.arange(256) & 0xC0 != 0x80)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def parts(text: bytes, end: re.Pattern[bytes], size: int = HASH_BYTES) -> Iterator[tuple[int, int]]:
    """The text in parts of about `size` bytes, each ending where the pattern is found."""
    start = 0
    while start < len(text):
        m = end.search(text, start + size)
        stop = m.end() if m else len(text)
        yield start, stop
        start = stop


class Distinct:
    """Places of the distinct strings of each part of a text, by which equal hashes are confirmed."""

    def __init__(self):
        self.hashes, self.starts, self.sizes = array("Q"), array("q"), array("q")

    def add(self, digest: int, start: int, size: int) -> None:
        self.hashes.append(digest)
        self.starts.append(start)
        self.sizes.append(size)

    def count(self, text: bytes) -> int | None:
        """How many strings there are, or None if two different ones have the same hash."""
        hashes = np.frombuffer(self.hashes, np.uint64)
        if not len(hashes):
            return 0
        order = np.argsort(hashes, kind="stable")
        same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
        for k in range(0, len(same), COUNTED):
            for i, j in zip(order[same[k : k + COUNTED]].tolist(), order[same[k : k + COUNTED] + 1].tolist(), strict=True):
                a, b = self.starts[i], self.starts[j]
                if self.sizes[i] != self.sizes[j] or text[a : a + self.sizes[i]] != text[b : b + self.sizes[j]]:
                    return None
        return len(hashes) - len(same)


def word_hashes(text: bytes, seed: int = SEED) -> tuple[np.ndarray, bool]:
    """Hashes of a long text's words, and whether those of different words differ."""
    found, distinct = [], Distinct()
    for start, stop in parts(text, SPACES):
        places: dict[bytes, int] = {}
        ids = array("q")
        for m in WORD.finditer(text, start, stop):
            word = m[0]
            if (i := places.get(word)) is None:
                i = places[word] = len(places)
                distinct.add(digest(word, seed), m.start(), len(word))
            ids.append(i)
        if ids:
            table = np.frombuffer(distinct.hashes, np.uint64)[-len(places) :].copy()
            found.append(table[np.frombuffer(ids, np.int64)])
    return np.concatenate(found) if found else np.empty(0, np.uint64), distinct.count(text) is not None


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier one."""
    if b"\n" not in text:
        return 0
    if len(text) <= HASH_BYTES:
        lines = [line for line in text.split(b"\n") if line and not line.isspace()]
        return len(lines) - len(set(lines))
    for seed in count(SEED):
        total, distinct = 0, Distinct()
        for start, stop in parts(text, NEWLINE):
            seen: set[bytes] = set()
            while start < stop:
                end = text.find(b"\n", start, stop)
                end = stop if end < 0 else end
                line = text[start:end]
                if line and not line.isspace():
                    total += 1
                    if line not in seen:
                        seen.add(line)
                        distinct.add(digest(line, seed), start, end - start)
                start = end + 1
        if (different := distinct.count(text)) is not None:
            return total - different
    raise AssertionError("seeds are endless")


def in_repeated_windows(names: np.ndarray, whole: np.ndarray | None = None, size: int = WINDOW) -> np.ndarray:
    """Which words stand in a window of `size` words that is found at least twice. names: equal for equal words only.

    whole: which windows count, and from which on another text begins is told by `names` itself; None: all.
    """
    covered = np.zeros(len(names), bool)
    n = len(names) - size + 1
    if n <= 0:
        return covered
    passes = -(-n // SORTED)
    for factor in count(int(MULTIPLIER), 2):
        key = np.zeros(n, np.uint64)
        for i in range(size):
            key *= np.uint64(factor % (1 << 64))
            key += names[i : n + i]
        key = mixed(key) if passes == 1 else key
        shift = np.uint64(32)
        exact = True
        for p in range(passes):
            at = np.arange(n) if passes == 1 else np.flatnonzero((key >> shift) % np.uint64(passes) == p)
            if whole is not None:
                at = at[whole[at]]
            order = at[np.argsort(key[at], kind="stable")]
            same = key[order[1:]] == key[order[:-1]]
            one, two = order[:-1][same], order[1:][same]
            exact = all(np.array_equal(names[one + i], names[two + i]) for i in range(size))
            if not exact:
                break
            for i in range(size):
                covered[one + i] = True
                covered[two + i] = True
        if exact:
            return covered
        covered[:] = False
    raise AssertionError("factors are endless")


class Texts:
    """Some texts, together no more than HASH_BYTES, or a longer one alone."""

    def __init__(self, column: pa.Array):
        self.texts = [t or b"" for t in utf8(column)]
        self.n = len(self.texts)
        self.long = self.n == 1 and len(self.texts[0]) > HASH_BYTES
        if self.long:
            self.hashes, distinct = word_hashes(self.texts[0])
            self.names = self.hashes
            seed = SEED
            while not distinct:
                self.names, distinct = word_hashes(self.texts[0], seed := seed + 1)
            self.first = np.array([0, len(self.hashes)])
            return
        split = [t.split() for t in self.texts]
        self.first = np.concatenate([[0], np.cumsum([len(ws) for ws in split], dtype=np.int64)])
        places: dict[bytes, int] = {}
        ids = np.fromiter((places.setdefault(w, len(places)) for ws in split for w in ws), np.int64, self.first[-1])
        table = np.fromiter((digest(w, SEED) for w in places), np.uint64, len(places))
        self.hashes, self.names = table[ids] if len(table) else np.empty(0, np.uint64), ids.view(np.uint64)

    def words(self) -> np.ndarray:
        return np.diff(self.first)

    def totals(self, marks: np.ndarray) -> np.ndarray:
        """Bytes of each text that are marked in a table of 256."""
        if self.long:
            text = self.texts[0]
            return np.array([sum(int(marks[np.frombuffer(text, np.uint8, min(HASH_BYTES, len(text) - i), i)].sum()) for i in range(0, len(text), HASH_BYTES))])
        sums = np.concatenate([[0], np.cumsum(marks[np.frombuffer(b"".join(self.texts), np.uint8)])])
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in self.texts], dtype=np.int64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def word_chars(self) -> np.ndarray:
        return self.totals(CHARS)

    def symbols(self) -> np.ndarray:
        return self.totals(SYMBOL)

    def repeated_lines(self) -> np.ndarray:
        return np.array([repeated_lines(t) for t in self.texts], np.int64)

    def doc(self) -> np.ndarray:
        """Of each word, the place of its text."""
        return np.repeat(np.arange(self.n), self.words())

    def repeated_words(self, size: int = WINDOW) -> np.ndarray:
        """Of each text, words in windows of `size` words that it has at least twice."""
        if self.long:
            return np.array([in_repeated_windows(self.names, None, size).sum()], np.int64)
        doc, names, total = self.doc(), self.names, len(self.names)
        if total < size:
            return np.zeros(self.n, np.int64)
        # A word of another text has another name.
        names = names + doc.astype(np.uint64) * np.uint64(total + 1)
        covered = np.concatenate([[0], np.cumsum(in_repeated_windows(names, doc[size - 1 :] == doc[: total - size + 1], size))])
        return covered[self.first[1:]] - covered[self.first[:-1]]

    def ngrams(self, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of every word and of every pair of neighbours."""
        some = list(self.grams(bits))
        return tuple(np.concatenate(c) for c in zip(*some, strict=True)) if some else (np.empty(0, np.int64),) * 2

    def grams(self, bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same, some at a time."""
        shift = np.uint64(64 - bits)
        whole = self.doc() if not self.long else None
        for i in range(0, len(self.hashes), COUNTED):
            words = mixed(self.hashes[i : i + COUNTED + 1])
            doc = np.zeros(len(words), np.int64) if whole is None else whole[i : i + COUNTED + 1]
            pair = np.flatnonzero(doc[1:] == doc[:-1])
            pairs = mixed(words[pair] * MULTIPLIER + words[pair + 1])
            words, doc_of = words[:COUNTED], doc[:COUNTED]
            yield (np.concatenate([words * MULTIPLIER, pairs * MULTIPLIER]) >> shift).astype(np.int64), np.concatenate([doc_of, doc[pair]])


def labelled_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows (__id, __part) of all labelled documents that are trusted or of quality 0, the trusted ones halved by a hash of the id; an id stands once."""
    given = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    given = given.where("quality = 0 or quality = 1 and toxic = 0")
    part = F.when(F.col("quality") == 0, BAD).when(in_target(F.col("__id")), TARGET).otherwise(HELD)
    return given.select("__id", part.alias("__part"))


def in_target(key: Column) -> Column:
    """Whether a trusted document of that id makes the target."""
    return F.xxhash64(key.cast("string"), F.lit(SEED)) % 2 == 0


def mark(key: Column) -> Column:
    """The place of an id in the table of bits."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(SEED + 1)), F.lit(1 << MARK_BITS))


def marks_of(ids: DataFrame, key: str) -> np.ndarray:
    """A table of bits, packed, in which the places of the ids are set."""

    def packed(batches):
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(0).to_numpy()
            for k in np.unique(place >> SLICE_BITS).tolist():
                bits = slices.setdefault(k, np.zeros(1 << SLICE_BITS, np.uint8))
                bits[place[place >> SLICE_BITS == k] & ((1 << SLICE_BITS) - 1)] = 1
        yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), pa.array([np.packbits(b).tobytes() for b in slices.values()], pa.binary())], ["slice", "bits"])

    places = ids.select(mark(F.col(key)).alias("place"))
    table = np.zeros(1 << MARK_BITS - 3, np.uint8)
    size = 1 << SLICE_BITS - 3
    for r in places.repartition(F.shiftright("place", SLICE_BITS)).mapInArrow(packed, "slice int, bits binary").collect():
        table[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return table


def perhaps_among(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs (doc_id, text) without most of those whose id isn't among the ids: what is dropped surely isn't, so an exact join that follows shuffles fewer texts."""
    table = docs.sparkSession.sparkContext.broadcast(marks_of(ids, key))

    @F.pandas_udf("boolean")
    def is_set(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series((table.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    return docs.where(is_set(mark(F.col("doc_id"))))


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float | None:
    """The score that costs least: GOOD_WEIGHT times the share of good below it, and the share of bad from it on."""
    if not len(good):
        return None
    good, bad = np.sort(good), np.sort(bad)
    if not len(bad):
        return float(np.quantile(good, LEAST, method="lower"))
    cost = GOOD_WEIGHT * np.arange(len(good)) / len(good) + 1 - np.searchsorted(bad, good) / len(bad)
    return float(good[cost.argmin()])


def threshold_of(scores: DataFrame) -> float | None:
    """best_threshold() of a table (__part, score) of any size: equal scores are counted, then summed up along ranges of them."""
    per = scores.groupBy("score").agg(F.count_if(F.col("__part") == HELD).alias("good"), F.count_if(F.col("__part") == BAD).alias("bad"))
    dealt = Scratch(scores.sparkSession, "thresholds").keep(per.repartitionByRange("score").withColumn("__at", F.spark_partition_id()))
    # A row a range: no more than there are shuffle partitions.
    ahead = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__at").agg(F.sum("good").alias("goods"), F.sum("bad").alias("bads"))
    starts = ranges.select("__at", F.coalesce(F.sum("goods").over(ahead), F.lit(0)).alias("__good"), F.coalesce(F.sum("bads").over(ahead), F.lit(0)).alias("__bad"))
    all_good, all_bad = ranges.agg(F.sum("goods"), F.sum("bads")).first()
    if not all_good:
        return None
    before = Window.partitionBy("__at").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"__{c}")
    placed = dealt.join(F.broadcast(starts), "__at").select("score", "good", below("good").alias("lost"), below("bad").alias("stopped")).where("good > 0")
    if not all_bad:
        place = int(LEAST * (all_good - 1))
        return placed.where((F.col("lost") <= place) & (F.col("lost") + F.col("good") > place)).first()["score"]
    cost = F.lit(GOOD_WEIGHT) * F.col("lost") / F.lit(all_good) + 1 - F.col("stopped") / F.lit(all_bad)
    return placed.agg(F.min(F.struct(cost.alias("cost"), "score")).alias("best")).first()["best"]["score"]


def corpus_counts(docs: DataFrame, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts by bucket of all of docs (text, __part), and of those of the target."""

    def counted(batches):
        sums = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part in pieces(batch, HASH_BYTES):
                good = part.column(1).to_numpy(zero_copy_only=False) == TARGET
                for bucket, doc in Texts(part.column(0)).grams(bits):
                    sums[0] += np.bincount(bucket, minlength=1 << bits)
                    if good.any():
                        sums[1] += np.bincount(bucket[good[doc]], minlength=1 << bits)
        slots = (1 << bits) // SLOT
        blobs = [sums[:, k * SLOT : (k + 1) * SLOT].tobytes() for k in range(slots)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array(blobs, pa.binary())], ["slot", "sums"])

    def added(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = np.frombuffer(blob, np.int64)
                totals[slot] = totals[slot] + some if slot in totals else some
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["slot", "sums"])

    # One row of fixed size for each slot and task; a slot's rows are added up as they come.
    schema = "slot int, sums binary"
    rows = docs.select("text", "__part").mapInArrow(counted, schema).repartition("slot").mapInArrow(added, schema).collect()
    out = np.zeros((2, 1 << bits), np.int64)
    for r in rows:
        out[:, r["slot"] * SLOT : (r["slot"] + 1) * SLOT] += np.frombuffer(r["sums"], np.int64).reshape(2, SLOT)
    return out[0], out[1]


def measured(docs: DataFrame, ratios: np.ndarray | None, bits: int = BUCKET_BITS) -> DataFrame:
    """docs (doc_id, text, __part) as (doc_id, __part, counts, score): the mean of ratios over the n-grams, null without."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in pieces(batch, HASH_BYTES):
                texts = Texts(part.column(1))
                n = texts.words()
                columns = [n, texts.word_chars(), texts.symbols(), texts.repeated_lines(), texts.repeated_words()]
                score = np.full(texts.n, np.nan)
                if shared.value is not None:
                    grams, sums = np.zeros(texts.n), np.zeros(texts.n)
                    for bucket, doc in texts.grams(bits):
                        grams += np.bincount(doc, minlength=texts.n)
                        sums += np.bincount(doc, shared.value[bucket], texts.n)
                    score = np.where(grams > 0, sums / np.maximum(1, grams), np.nan)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(score, from_pandas=True)], ["doc_id", "__part", *names, "score"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text", "__part"), make, f"doc_id {kind}, __part int, {', '.join(f'{c} long' for c in names)}, score double")


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, kept)."""
    trusted = labelled_ids(labels, label_id_col)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Labels meet the texts for the target alone: of others few texts are shuffled, and none at all while the labels are small.
    target_ids = Scratch(docs.sparkSession, "target").keep(trusted.where(F.col("__part") == TARGET))
    meant = perhaps_among(given.where(in_target(F.col("doc_id"))), target_ids, "__id").join(target_ids, F.col("doc_id") == F.col("__id")).select("text", "__part")
    corpus, target = corpus_counts(given.withColumn("__part", F.lit(0)))[0], corpus_counts(meant)[1]
    ratios = None
    if target.sum():
        # One more than the target's count, and than the count expected at the corpus's rates: what is rare in both says little.
        ratios = np.log((target + 1) / (corpus * (target.sum() / corpus.sum()) + 1))
    found = Scratch(docs.sparkSession, "quality").keep(measured(given.withColumn("__part", F.lit(0)), ratios).drop("__part"))
    # One score an id, the least of its rows, however often an id is repeated.
    judged = trusted.where(F.col("__part") >= HELD)
    scored = found.where(F.col("score").isNotNull()).join(judged, F.col("doc_id") == F.col("__id")).groupBy("doc_id", "__part").agg(F.min("score").alias("score"))
    threshold = threshold_of(scored)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    passes = F.lit(True) if threshold is None else F.coalesce(F.col("score") >= threshold, F.lit(False))
    return found.withColumns({"base_failed": failed, "threshold": F.lit(threshold).cast("double"), "kept": ~failed & passes})


def op5_ngram_ratio(spark, sf_dir: str) -> DataFrame:
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op5_ngram_ratio": op5_ngram_ratio}
ORACLES: dict[str, str] = {}
