"""Two tokenizers' tokens of one text, aligned by byte ranges, and how often their ids are linked in the whole corpus.

Tokens of A stab a static index of B's ranges: B's tokens lie in order without overlap, so the index is the sorted arrays of
their starts and ends, and two bisections give the list of those that a token of A overlaps. A gap between two tokens of B
that no list spans, and that is an end of A's as well, becomes a boundary of groups. Bisections are vectorised over all tokens
of some texts that stand one behind the other.

Counts of id pairs need two passes: the first writes each document's distinct pairs with their numbers, in packed arrays,
beside its own counts; the second looks up what they count corpus-wide. The pairs met most often, at most HEAD of them, are broadcast;
the rest are met rarely by what HEAD means, and their links are joined by a shuffle, dealt out by pair, so no pair is hot.

Cases: a null or empty text, or one whose tokens of A or B don't spell a space and the text, has no tokens: zeros and an
empty digest column; repeated rows are kept, each counted; null ids stay null; ties for a B id's highest count are all best;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_letters, map_arrow

#: Pairs broadcast with their counts: 16 bytes each.
HEAD = 1 << 20
#: Pairs counted in a task before they are handed on; texts aligned together, in bytes.
PARTIAL, TOGETHER = 1 << 21, 1 << 20
#: A pair of ids as one number.
SHIFT = 32
#: Finer steps of the histogram of counts than powers of two.
STEPS = 8


class ByteBpe:
    """Ids of a byte-level BPE tokenizer's file, whose vocabulary in order of ids is its order of merges; special tokens are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        vocabulary = json.load(open(path))["model"]["vocab"]
        byte_of = byte_letters()
        special = {x["id"] for x in json.load(open(path))["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i not in special}
        self.encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.spelled[i] = token

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class Pieces:
    """Ids of a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i in range(n) for p in [self.model.id_to_piece(i)]]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def bounds(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ranges that lie one behind the other."""
    ends = np.cumsum(lengths)
    return ends - lengths, ends


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For A and B tokens of the same bytes: the first B token that each A token overlaps, how many, and the ends that both have.

    Tokens without bytes overlap nothing; they don't occur in either vocabulary.
    """
    a_starts, a_ends = bounds(a_lengths)
    b_starts, b_ends = bounds(b_lengths)
    first = np.searchsorted(b_ends, a_starts, "right")
    behind = np.searchsorted(b_starts, a_ends, "left")
    # Gap k lies between B tokens k and k + 1; a list from first to behind - 1 spans the gaps first .. behind - 2.
    spans = np.zeros(len(b_ends) + 1, np.int64)
    np.add.at(spans, first, 1)
    np.add.at(spans, np.maximum(behind - 1, first), -1)
    free = np.cumsum(spans)[: len(b_ends)] == 0
    return first, behind - first, b_ends[free]


class Aligner:
    """Aligns texts: per text its counts, its groups' digest, and its distinct id pairs with their numbers."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), Pieces(b_path)
        self.a_bytes, self.b_bytes = (np.array([len(x) for x in t.spelled], np.int64) for t in (self.a, self.b))
        self.a_shown, self.b_shown = ([str(i) for i in range(len(t.spelled))] for t in (self.a, self.b))

    def _spells(self, tokenizer, ids: list[int], text: str) -> bool:
        return b"".join(map(tokenizer.spelled.__getitem__, ids)) == b" " + text.encode("utf-8", "surrogatepass")

    def groups(self, a: list[int], b: list[int], a_to: list[int], b_to: list[int]) -> str:
        """`a1,a2|b1;a3|b2,b3` of groups that end behind a_to and b_to tokens."""
        a, b = list(map(self.a_shown.__getitem__, a)), list(map(self.b_shown.__getitem__, b))
        out, i, j = [], 0, 0
        for k, m in zip(a_to, b_to):
            out.append((a[i] if k == i + 1 else ",".join(a[i:k])) + "|" + (b[j] if m == j + 1 else ",".join(b[j:m])))
            i, j = k, m
        return ";".join(out)

    def __call__(self, texts: list[str | None]) -> list[tuple | None]:
        """For each text None, or (n_a, n_b, n_groups, n_links, digest, pairs, their numbers)."""
        out: list[tuple | None] = [None] * len(texts)
        at = [i for i, t in enumerate(texts) if t]
        whole = [texts[i] for i in at]
        rows = [(i, a, b) for i, t, a, b in zip(at, whole, self.a(whole), self.b(whole)) if self._spells(self.a, a, t) and self._spells(self.b, b, t)]
        if not rows:
            return out
        a_ids, b_ids = (np.fromiter((x for r in rows for x in r[k]), np.int64) for k in (1, 2))
        a_counts, b_counts = (np.array([len(r[k]) for r in rows], np.int64) for k in (1, 2))
        a_lengths, b_lengths = self.a_bytes[a_ids], self.b_bytes[b_ids]
        # Texts stand one behind the other; both tokenizers end at a text's end, so no list and no group reaches beyond it.
        first, number, cuts = overlaps(a_lengths, b_lengths)
        a_to = np.searchsorted(np.cumsum(a_lengths), cuts) + 1
        b_to = np.searchsorted(np.cumsum(b_lengths), cuts) + 1
        links = np.repeat(a_ids, number) << SHIFT
        links |= b_ids[np.repeat(first - (np.cumsum(number) - number), number) + np.arange(len(links))]
        a_stops, b_stops = np.cumsum(a_counts), np.cumsum(b_counts)
        group_stops = np.searchsorted(a_to, a_stops, "right")
        link_stops = np.cumsum(number)[a_stops - 1]
        g, k, a0, b0 = 0, 0, 0, 0
        for (i, a, b), a1, b1, g1, k1 in zip(rows, a_stops.tolist(), b_stops.tolist(), group_stops.tolist(), link_stops.tolist()):
            said = self.groups(a, b, (a_to[g:g1] - a0).tolist(), (b_to[g:g1] - b0).tolist())
            pairs, times = np.unique(links[k:k1], return_counts=True)
            out[i] = (len(a), len(b), g1 - g, k1 - k, hashlib.sha256(said.encode()).hexdigest(), pairs, times)
            g, k, a0, b0 = g1, k1, a1, b1
        return out


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_FIELDS = [pa.int64()] * 4 + [pa.string()]


def _together(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about TOGETHER characters."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= TOGETHER:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: id, COUNTS, and its pairs (little-endian 64-bit A id << 32 | B id) with their numbers (32 bits)."""
    schema = f"doc_id long, {COUNTS}, pairs binary, times binary"

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        align = Aligner(a_path, b_path)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = batch.column(1).to_pylist()
            for start, stop in _together([len(t or "") for t in texts]):
                found = [(*r[:5], r[5].astype("<i8").tobytes(), r[6].astype("<u4").tobytes()) if r else (0, 0, 0, 0, "", b"", b"") for r in align(texts[start:stop])]
                columns = [pa.array(c, k) for c, k in zip(zip(*found), [*_FIELDS, pa.binary(), pa.binary()])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns], [c.split()[0] for c in schema.split(", ")])

        return each

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, schema)


def _summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(where, np.concatenate(times), len(keys)).astype(np.int64)


def pair_counts(found: DataFrame) -> DataFrame:
    """Rows (pair, n): links of each pair of ids in all documents, summed in the tasks first."""

    def partial(batches):
        pairs, times, held = [], [], 0

        def out():
            keys, n = _summed(pairs, times)
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], ["pair", "n"])

        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs.append(np.frombuffer(p, "<i8"))
                times.append(np.frombuffer(t, "<u4"))
                held += len(pairs[-1])
                if held > PARTIAL:
                    keys, n = _summed(pairs, times)
                    pairs, times, held = [keys], [n], len(keys)
                    # Pairs that mostly differ are handed on, so that a task's memory stays bounded.
                    if held > PARTIAL // 2:
                        yield from out()
                        pairs, times, held = [], [], 0
        if pairs:
            yield from out()

    return found.select("pairs", "times").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_marked(counts: DataFrame) -> DataFrame:
    """Rows (pair, n, best): whether a pair's count is its B id's highest."""
    b_id = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    counts = counts.withColumn("b", b_id)
    # One row a B id: as many as B's vocabulary has.
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def head_of(marked: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, `most` of them at most, by a histogram of the counts' logarithms."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    total, least = 0, None
    for row in marked.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["step"]
    return marked.where(F.lit(False)) if least is None else marked.where(step >= least)


def with_counts(found: DataFrame, marked: DataFrame, scratch: Scratch, most: int = HEAD) -> DataFrame:
    """n_best and count_sum of each document of aligned(), which has a row number __row of its own."""
    head = head_of(marked, most).toArrow()
    order = np.argsort(head.column("pair").to_numpy())
    table = found.sparkSession.sparkContext.broadcast(
        (head.column("pair").to_numpy()[order], head.column("n").to_numpy()[order], head.column("best").combine_chunks().to_numpy(zero_copy_only=False)[order])
    )

    def look_up(batches):
        pairs, counts, best = table.value
        for batch in batches:
            out = {k: [] for k in ("__row", "n_best", "count_sum", "rest_pairs", "rest_times")}
            for row, p, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                mine, times = np.frombuffer(p, "<i8"), np.frombuffer(t, "<u4").astype(np.int64)
                at = np.searchsorted(pairs, mine)
                at[at == len(pairs)] = 0
                known = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
                hit, n = at[known], times[known]
                for k, v in zip(out, (row, int(n[best[hit]].sum()), int((n * counts[hit]).sum()), mine[~known], times[~known])):
                    out[k].append(v)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, lists if k.startswith("rest") else pa.int64()) for k, v in out.items()], list(out))

    lists = "rest_pairs array<bigint>, rest_times array<bigint>"
    known = scratch.keep(found.select("__row", "pairs", "times").mapInArrow(look_up, f"__row long, n_best long, count_sum long, {lists}"))
    # Each document's known part is one row, each rare pair of it another: added up by document.
    rest = known.select("__row", F.explode(F.arrays_zip("rest_pairs", "rest_times")).alias("r")).select("__row", F.col("r.rest_pairs").alias("pair"), F.col("r.rest_times").alias("times"))
    rare = rest.join(marked, "pair").select("__row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    summed = known.select("__row", "n_best", "count_sum").unionByName(rare).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return found.drop("pairs", "times").join(summed, "__row").drop("__row")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most: int = HEAD) -> DataFrame:
    """A row for every document: doc_id, COUNTS, n_best, count_sum."""
    import public_tokenizers

    a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    scratch = Scratch(docs.sparkSession, "alignment")
    found = scratch.keep(aligned(docs, a_path, b_path).withColumn("__row", F.monotonically_increasing_id()))
    marked = scratch.keep(best_marked(pair_counts(found)))
    return with_counts(found, marked, scratch, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_interval_index(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_interval_index": op12_interval_index}
ORACLES: dict[str, str] = {}
