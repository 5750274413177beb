"""Near-duplicate classes: SimHash fingerprints joined by a traversal of binary tries.

Two fingerprints at distance 2 or less agree on at least one of three blocks of their 64 bits, and, of what is left,
on at least one of three blocks again. So the tries are dealt out by nine keys of about 35 equal bits, and in each group of a
key the node pairs of a path-compressed binary trie are followed together until their differing bits exceed the
budget. Each group returns a spanning star of its links, so copies and dense groups never expand into all pairs.
Where a block's value is shared by more than HOT fingerprints, its groups are dealt out by a third block as well, which leaves 20 bits
open at most: no group is larger than the greater of HOT and 2 ** 20, however many documents resemble each other.

The pipeline's stage, one_of_each(), is for texts that differ by more: fingerprints of five-word shingles, tries dealt out by least hashes of these,
pairs ranked by an estimate, and every link that is used tested on the two texts' own shingles.

Cases: null and empty texts have fingerprint zero and link like any other; repeated rows give repeated result rows;
a null id stays null and takes part by its text only (component_id is the least id that isn't null); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lower_table, map_arrow, utf8
from .components import components

SEED = 42
BUDGET = 2
#: Rows whose shingle bits are counted at once.
COUNT_ROWS = 1 << 14
#: Node pairs followed at once; more wait on a stack.
FRONTIER = 1 << 19
#: Fingerprints of whole groups that are joined at once; a larger group is joined alone.
RUN = 1 << 17
#: Fingerprints that may share the value of a block before its groups are dealt out once more.
HOT = 1 << 16

# Of the pipeline's stage: words of a shingle, least hashes by which texts meet, bins of the sketch.
SHINGLE, LEASTS, BINS = 5, 4, 256
#: Least similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Differing bits of 64 up to which texts are compared further: at a similarity of 0.8 ten are expected.
FIRST_BITS = 18
#: Standard deviations by which an estimate may miss.
SURE = 2.5
#: Rows, and words in them, that may share a least hash before their group is split; rounds in which its rows are held against one of them.
CROWD, CROWD_WORDS, LEADERS = 4096, 1 << 24, 4
ODD = np.uint64(0xD6E8FEB86659FD93)


def fingerprint(words: list[bytes], size: int = 3) -> int:
    """SimHash of the word shingles: a bit is set if it is set in over half the XXH64 hashes."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(b" ".join(words), SEED)
    shingles = zip(*(words[i:] for i in range(size)), strict=False)
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNT_ROWS):
        part = hashes[i : i + COUNT_ROWS]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint's 64 bits as a long."""

    def make():
        lower = lower_table()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [fingerprint((text or b"").translate(lower).split(), size) for text in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, f"doc_id {kind}, fp long")


def _cut(value: F.Column, width: int, count: int = 3) -> list[tuple[F.Column, F.Column, int]]:
    """Blocks of the `width` low bits of value: (the block's bits, the other bits joined, how many those are)."""
    out, step = [], width // count
    for k in range(count):
        low, high = k * step, (k + 1) * step if k < count - 1 else width
        block = F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        above = F.shiftrightunsigned(value, high).bitwiseAND(F.lit((1 << (width - high)) - 1)) if high < width else F.lit(0).cast("long")
        below = value.bitwiseAND(F.lit((1 << low) - 1))
        out.append((block, F.shiftleft(above, low).bitwiseOR(below), width - (high - low)))
    return out


def _joined(*parts: tuple[F.Column, int]) -> F.Column:
    """One long of the parts, each with its width in bits."""
    out = F.lit(0).cast("long")
    for value, width in parts:
        out = F.shiftleft(out, width).bitwiseOR(value)
    return out


def _keys(block: int, deep: bool) -> list[F.Column]:
    """Keys of the groups in which a pair that agrees on this block meets; deep: by a third block too."""
    first, rest, width = _cut(F.col("fp"), 64)[block]
    out = []
    for k, (second, left, open_) in enumerate(_cut(rest, width)):
        number = F.lit(block * 3 + k)
        if deep:
            out += [_joined((first, 22), (second, 15), (third, 11), (F.lit(j + 1), 2), (number, 4)) for j, (third, _, _) in enumerate(_cut(left, open_))]
        else:
            out.append(_joined((first, 22), (second, 15), (number, 16)))
    return out


def _top_bit(x: np.ndarray) -> np.ndarray:
    """Number of the highest set bit, -1 for zero."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return np.bitwise_count(x).astype(np.int64) - 1


def _split(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For sorted runs that share all bits above `bit`: where that bit becomes set."""
    low, high = lo.copy(), hi.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        set_ = ((a[np.minimum(mid, len(a) - 1)] >> bit.astype(np.uint64)) & np.uint64(1)).astype(bool)
        high = np.where(open_ & set_, mid, high)
        low = np.where(open_ & ~set_, mid + 1, low)
    return low


def trie_links(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (i, j) in the same run [start, end) whose values differ in at most `budget` bits.

    a: uint64, ascending without repeats inside each run. A trie node is a range of a run whose values share a prefix.
    """
    pairs: list[tuple[np.ndarray, ...]] = []
    lo, hi = starts[ends - starts > 1], ends[ends - starts > 1]
    while len(lo):  # each node against itself: its two children, and the pair of them
        mid = _split(a, lo, hi, _top_bit(a[lo] ^ a[hi - 1]))
        pairs.append((lo, mid, mid, hi))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    while pairs:
        alo, ahi, blo, bhi = pairs.pop()
        if len(alo) > FRONTIER:
            pairs.append((alo[FRONTIER:], ahi[FRONTIER:], blo[FRONTIER:], bhi[FRONTIER:]))
            alo, ahi, blo, bhi = (x[:FRONTIER] for x in (alo, ahi, blo, bhi))
        va, vb = _top_bit(a[alo] ^ a[ahi - 1]), _top_bit(a[blo] ^ a[bhi - 1])
        open_ = np.maximum(va, vb)
        shared = (a[alo] ^ a[blo]) >> np.maximum(open_ + 1, 0).clip(0, 63).astype(np.uint64)
        shared[open_ == 63] = 0
        near = np.bitwise_count(shared) <= budget
        leaf = near & (open_ < 0)
        if leaf.any():
            yield alo[leaf], blo[leaf]
        more = near & (open_ >= 0)
        if more.any():
            alo, ahi, blo, bhi, va, vb = (x[more] for x in (alo, ahi, blo, bhi, va, vb))
            first = va >= vb
            slo, shi, bit = np.where(first, alo, blo), np.where(first, ahi, bhi), np.where(first, va, vb)
            olo, ohi = np.where(first, blo, alo), np.where(first, bhi, ahi)
            mid = _split(a, slo, shi, bit)
            pairs.append((np.concatenate([slo, mid]), np.concatenate([mid, shi]), np.concatenate([olo, olo]), np.concatenate([ohi, ohi])))


def _stars(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each position, the least position of its run that links reach."""
    root = np.arange(len(a))
    for i, j in trie_links(a, starts, ends, budget):
        while True:
            ri, rj = root[i], root[j]
            apart = ri != rj
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
            while (nxt := root[root]).tobytes() != root.tobytes():
                root = nxt
    return root


def _links(batches, budget: int = BUDGET) -> Iterator[pa.RecordBatch]:
    """Batches (key, fp) in which the rows of a key stand together: links (u, v) that join each group's classes."""

    def joined(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp = key[fresh], fp[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        root = _stars(fp, starts, np.append(starts[1:], len(key)))
        linked = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[root[linked]].view(np.int64))], ["u", "v"])

    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys) >= RUN:
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if last:
                yield joined(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield joined(keys, fps)


def links(prints: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """Links (u, v) between distinct values of fp that join all pairs at distance 2 or less into classes."""
    blocks = [_joined((first, 22), (F.lit(b), 2)) for b, (first, _, _) in enumerate(_cut(F.col("fp"), 64))]
    # Three blocks of 21 or 22 bits have 2 ** 23 values at most: counts are summed up before they are shuffled.
    sizes = prints.select(F.explode(F.array(*blocks)).alias("block")).groupBy("block").agg(F.count("*").alias("n"))
    shared = scratch.keep(sizes.where(F.col("n") > hot).select("block", F.lit(True).alias("hot")))
    if shared.isEmpty():
        keys = F.array(*(k for b in range(3) for k in _keys(b, False)))
        dealt = prints.select(F.explode(keys).alias("key"), "fp")
    else:
        marked = prints.select(F.explode(F.array(*blocks)).alias("block"), "fp").join(shared, "block", "left")
        of = lambda b: F.when(F.col("hot"), F.array(*_keys(b, True))).otherwise(F.array(*_keys(b, False)))
        number = F.col("block").bitwiseAND(F.lit(3))
        dealt = marked.select(F.explode(F.when(number == 0, of(0)).when(number == 1, of(1)).otherwise(of(2))).alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, id_col, text_col, size))
    values = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = components(links(values.select("fp"), scratch, hot), scratch).withColumnsRenamed({"node": "fp"})
    # The least id of each class, then of each fingerprint: copies are summed up before they meet.
    named = values.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    """Distinct shingles; fewer words than one has are one, and no words are one without words."""
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _rehashed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


class Sketch:
    """Of a text's distinct shingles: a digest of them all, SimHash, LEASTS least hashes, and in each of BINS bins a byte of the least hash."""

    def __init__(self, words: list[bytes], size: int = SHINGLE):
        digest = xxhash.xxh64_intdigest
        found = shingles(words, size)
        h = np.sort(np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found)))
        self.n = len(words)
        self.whole = xxhash.xxh3_128_digest(h.tobytes())
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), COUNT_ROWS):
            part = h[i : i + COUNT_ROWS]
            counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        self.fp = int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])
        self.least, again = [], h
        for _ in range(LEASTS):
            again = _rehashed(again)
            self.least.append(int(again.min()))
        h = np.unique(_rehashed(again))
        place = (h >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        bins = np.zeros(BINS, np.uint8)
        # Zero is an empty bin.
        bins[place[first]] = h[first] % np.uint64(255) + np.uint64(1)
        self.bins = bins.tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity by the bins of pairs (rows of a and b), and by how much it may miss at a similarity of 0.8."""
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return (same / used - 1 / 255) / (1 - 1 / 255), SURE * 0.4 / np.sqrt(used) + 1 / 255


def _sketches(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """Rows (rank, whole, n, f0, m0.., bins) of documents with a rank."""

    def make():
        lower = lower_table()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = [Sketch((t or b"").translate(lower).split(), size) for t in utf8(batch.column(1))]
            longs = np.array([[f.fp, *f.least] for f in found], np.uint64).view(np.int64)
            columns = [pa.array([f.whole for f in found], pa.binary()), pa.array([f.n for f in found], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in longs.T), pa.array([f.bins for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["rank", "whole", "n", "f0", *LEAST, "bins"])

        return each

    given = docs.select("rank", F.col(text_col).alias("text"))
    return map_arrow(given, make, f"rank {given.schema['rank'].dataType.simpleString()}, whole binary, n long, f0 long, {', '.join(f'{m} long' for m in LEAST)}, bins binary")


LEAST = [f"m{k}" for k in range(LEASTS)]
#: Sets of least hashes by which documents are dealt out: one of them, or, where many share one, two.
ONES = [(k,) for k in range(LEASTS)]
PAIRS = [(j, k) for j in range(LEASTS) for k in range(j + 1, LEASTS)]


def _key(part: tuple[int, ...]) -> F.Column:
    """A number of the group in which documents that share these least hashes meet."""
    return F.xxhash64(F.lit(sum(1 << k for k in part)), *(F.col(f"m{k}") for k in part))


def _forest(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links the spanning forest of greatest scores."""
    root: dict[int, int] = {}
    kept = []

    def top(x: int) -> int:
        path = []
        while (up := root.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            root[p] = x
        return x

    order = np.argsort(-score, kind="stable")
    for n, a, b in zip(order.tolist(), i[order].tolist(), j[order].tolist()):
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(n)
    return i[kept], j[kept], score[kept]


def _alike(first: int):
    """Batches (key, node, f0, bins, need) in which the rows of a key stand together: links (u, v) between nodes that may be similar.

    Of each group they are the spanning forest of greatest estimates: what is similar is joined by links that are most likely so. Only pairs
    of which one is in need are looked at.
    """
    def joined(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, node, fp, bins, need = columns
        fp = fp.view(np.uint64)
        order = np.lexsort((node, fp, key))
        key, node, fp, bins, need = (c[order] for c in (key, node, fp, bins, need))
        fresh = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
        at = np.flatnonzero(fresh)
        size = np.diff(np.r_[at, len(key)])
        starts = np.flatnonzero(np.r_[True, key[at][1:] != key[at][:-1]])
        kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

        def take(i: np.ndarray, j: np.ndarray, kept):
            """Rows i and j with equal or near fingerprints: tested by their bins, in bounded runs."""
            for k in range(0, len(i), 1 << 15):
                a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                some = need[a] | need[b]
                a, b = a[some], b[some]
                score, miss = estimated(bins[a], bins[b])
                some = score >= SIMILAR[0] / SIMILAR[1] - miss
                if some.any():
                    kept = _forest(*(np.concatenate([x, y]) for x, y in zip(kept, (a[some], b[some], score[some]))))
            return kept

        def spread(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """All pairs of the rows that have the fingerprints i and j."""
            n = size[i] * size[j]
            pair = np.repeat(np.arange(len(i)), n)
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return at[i[pair]] + inside // size[j[pair]], at[j[pair]] + inside % size[j[pair]]

        many = np.flatnonzero(size > 1)
        a, b = spread(many, many)
        kept = take(a[a < b], b[a < b], kept)
        for i, j in trie_links(fp[at], starts, np.append(starts[1:], len(at)), first):
            kept = take(*spread(i, j), kept)
        u, v = node[kept[0]], node[kept[1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        empty = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, BINS), np.uint8), np.empty(0, bool)]
        held = empty
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(batch.num_rows, BINS)
            given = [*(batch.column(k).to_numpy() for k in range(3)), raw, batch.column(4).to_numpy(zero_copy_only=False).astype(bool)]
            held = [np.concatenate([h, c]) for h, c in zip(held, given)]
            keys = held[0]
            if len(keys) >= RUN and keys[0] != keys[-1]:
                last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield joined([h[:last] for h in held])
                held = [h[last:] for h in held]
        if len(held[0]):
            yield joined(held)

    return run


def _met(dealt: DataFrame, first: int) -> DataFrame:
    need = F.col("need") if "need" in dealt.columns else F.lit(True)
    rows = dealt.select("key", "node", "f0", "bins", need.alias("need"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_alike(first), "u long, v long")


def _against(rows: DataFrame) -> DataFrame:
    """rows (key, node, bins, l_node, l_bins) with near (surely similar to the leader l) and fringe (perhaps, or to something that is)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, BINS) for k in (2, 4))
                score, miss = estimated(a, b)
                # Distances are a metric: what is similar to a member of a leader's class is at most twice as far from it.
                near, fringe = score >= 0.8 + miss, (score >= 0.6 - miss) & (score < 0.8 + miss)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(near), pa.array(fringe)], ["key", "node", "l_node", "near", "fringe"])

    return rows.select("key", "node", "bins", "l_node", "l_bins").mapInArrow(run, "key long, node long, l_node long, near boolean, fringe boolean")


def candidate_links(values: DataFrame, scratch: Scratch, first: int = FIRST_BITS, crowd: int = CROWD) -> DataFrame:
    """Links (u, v), u < v, between nodes of rows (node, n, f0, m0.., bins) that share a least hash and may be similar.

    A least hash that more than `crowd` rows, or rows of CROWD_WORDS words, share is that of a passage of many documents or of many near
    copies. All of its rows are held against one of them, LEADERS times; a row that is surely similar to a leader is linked to it. A row that is
    not (in need) may still be similar to another row in need, or to a row that a leader has linked; the latter only if it lies so near to that leader
    (fringe). So rows in need meet each other by two least hashes, and in pieces if still many share these; and those at a
    fringe meet the leader's linked rows in pieces of both. No row leaves without having met what it may be similar to.
    """
    columns = ["node", "n", "f0", *LEAST, "bins"]

    def keyed(rows: DataFrame, parts: list[tuple[int, ...]]) -> DataFrame:
        return rows.select(*columns, F.explode(F.array(*(_key(p) for p in parts))).alias("key"))

    def crowded(rows: DataFrame) -> DataFrame:
        return scratch.keep(rows.groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("words")).where((F.col("rows") > crowd) | (F.col("words") > CROWD_WORDS)).select("key", F.greatest(F.ceil(F.col("rows") / crowd), F.ceil(F.col("words") / CROWD_WORDS)).cast("int").alias("of")))

    dealt = keyed(values, ONES)
    many = crowded(dealt)
    if many.isEmpty():
        return _met(dealt, first)
    out = _met(dealt.join(many, "key", "left_anti"), first)
    rest = scratch.keep(dealt.join(many, "key"))
    told = None
    for turn in range(LEADERS):
        least = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "bins")).alias("l"))
        leaders = least.select("key", F.col("l.node").alias("l_node"), F.col("l.bins").alias("l_bins"))
        # A row a crowded key, at most rows / crowd of them; the other side's skew is the adaptive plan's to split.
        held = _against(rest.join(leaders, "key"))
        told = held if told is None else told.unionByName(held)
    told = scratch.keep(told.where("near or fringe"))
    linked = told.where("near and node <> l_node")
    out = out.unionByName(linked.select(F.least("node", "l_node").alias("u"), F.greatest("node", "l_node").alias("v")))
    # Leaders are near to themselves: they are members of their own classes.
    need = scratch.keep(rest.join(told.where("near").select("key", "node").distinct(), ["key", "node"], "left_anti"))
    second = scratch.keep(keyed(need.dropDuplicates(["node"]), PAIRS))
    more = crowded(second)
    out = out.unionByName(_met(second.join(more, "key", "left_anti"), first))
    if not more.isEmpty():
        pieces = second.join(more, "key").withColumn("of", 2 * F.col("of")).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
        both = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda k: F.xxhash64("key", F.least(k, F.col("piece")), F.greatest(k, F.col("piece"))))
        out = out.unionByName(_met(pieces.select("node", "f0", "bins", F.explode(both).alias("key")), first))
    at_fringe = told.where("fringe").join(need.select("key", "node"), ["key", "node"], "left_semi")
    sought = scratch.keep(at_fringe.select("key", "l_node").distinct())
    if not sought.isEmpty():
        asking = need.join(at_fringe.select("key", "node", "l_node"), ["key", "node"])
        members = rest.join(told.where("near").join(sought, ["key", "l_node"], "left_semi").select("key", "node", "l_node"), ["key", "node"])
        count = lambda rows, name: rows.groupBy("key", "l_node").agg(F.greatest(F.ceil(2 * F.count("*") / crowd), F.ceil(2 * F.sum("n") / CROWD_WORDS)).cast("int").alias(name))
        sizes = scratch.keep(count(asking, "a_of").join(count(members, "m_of"), ["key", "l_node"]))
        group = lambda a, m: F.xxhash64("key", "l_node", a, m)
        piece = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
        every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
        asked = asking.join(sizes, ["key", "l_node"]).select("node", "f0", "bins", F.lit(True).alias("need"), F.explode(F.transform(every("m_of"), lambda m: group(piece("a_of"), m))).alias("key"))
        given = members.join(sizes, ["key", "l_node"]).select("node", "f0", "bins", F.lit(False).alias("need"), F.explode(F.transform(every("a_of"), lambda a: group(a, piece("m_of")))).alias("key"))
        out = out.unionByName(_met(asked.unionByName(given), first))
    return out


def verified(candidates: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Of links (u, v) those whose texts' distinct shingles have a similarity of SIMILAR or more. texts: (row, text).

    Only texts with a link are moved: once to their links' ends, once to the links.
    """
    ends = candidates.select(F.explode(F.array("u", "v")).alias("row"), "u", "v")
    both = ends.join(texts.select("row", "text"), "row").select("u", "v", (F.col("row") == F.col("v")).alias("second"), "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        lower = lower_table()
        before: tuple = (None, None, None)
        for batch in batches:
            good = []
            for u, v, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(3))):
                mine = shingles((text or b"").translate(lower).split(), size)
                if before[:2] == (u, v):
                    shared = len(mine & before[2])
                    if SIMILAR[1] * shared >= SIMILAR[0] * (len(mine) + len(before[2]) - shared):
                        good.append((u, v))
                before = (u, v, mine)
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], ["u", "v"])

    return both.repartition("u", "v").sortWithinPartitions("u", "v", "second").mapInArrow(run, "u long, v long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, crowd: int = CROWD) -> DataFrame:
    """One row of each class of similar texts: that of the least id, null ids last; of several such rows, the first as they are read.

    Similar are texts whose distinct shingles of `size` words have a Jaccard similarity of 0.8 or more; a class is what such links join, so a
    row goes only if another row is similar to it. Candidates share one of LEASTS least hashes (at 0.8, 998 of 1,000 pairs do), are met in tries of
    their fingerprints and ranked by an estimate; each link used is tested on the texts themselves. Texts without a word are
    all alike. Columns may be of any type.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    # Ids may repeat or be null, so rows are told apart by a number stored beside them.
    given = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    stored = scratch.keep(given.withColumn("__row", F.monotonically_increasing_id()))
    id_, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rank = F.struct(F.col(id_).isNull().alias("unnamed"), F.col(id_).alias("id"), F.col("__row").alias("row"))
    prints = scratch.keep(_sketches(stored.withColumn("rank", rank), text, size))
    # Equal sets of shingles are one node, the row of least rank.
    same = prints.groupBy("whole").agg(F.min("rank").alias("least"), F.first(F.struct("n", "f0", *LEAST, "bins")).alias("s"))
    values = scratch.keep(same.select("least", F.col("least.row").alias("node"), "s.*"))
    candidates = scratch.keep(candidate_links(values, scratch, crowd=crowd).distinct())
    links = scratch.keep(verified(candidates, stored.select(F.col("__row").alias("row"), F.col(text).alias("text")), size))
    classes = components(links, scratch)
    named = values.select("least", "node").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("__row"))
    rows = stored.join(kept.hint("shuffle_hash"), "__row")
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op9_simhash_trie(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_trie": op9_simhash_trie}
ORACLES: dict[str, str] = {}
