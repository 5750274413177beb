"""Repeated strings of LENGTH bytes found by suffixes and cut out, whatever documents they stand in.

Every string of LENGTH bytes (a window) has an anchor: the Q bytes in it whose hash is least, the first of equal ones. Equal windows have
equal anchors at the same place, so suffixes need to meet only suffixes whose windows have the same anchor. Windows that
follow each other mostly share it: such a run of windows with the bytes that they cover is one record.

1. Runs with the same bytes are dealt out by their hashes; all but the first are repeats. Each task drops its own repeats
   before, so a passage that a third of all documents holds gives a task's piece one record.
2. Anchors of several different runs are live. They are counted exactly and written into a bit table of fixed size, whose
   false hits cost time only. Runs with live anchors come again with their bytes, dealt out by anchor, and their suffixes are
   sorted by bucket-pointer refinement: buckets of equal FIRST bytes, each refined by sorting its suffixes on the bucket numbers of the
   suffixes `depth` bytes further on, numbers renewed for the next and deeper refinement, until buckets agree in LENGTH bytes. Buckets of one
   suffix are done. Of every other bucket the first suffix stays, and the windows of the rest are repeats.
3. Anchors of more than CROWD different runs would make one group too large: their windows are dealt out one by one by
   a hash of their whole bytes, repeats of a task dropped before. So no group grows with the corpus but by one record a task's piece.

Documents are ordered by id, nulls last, then by a hash of the text: rows of one id with different texts are different
documents, rows of equal id and text are one document stated again and get the same result. A null or empty text has no
windows. An empty table gives an empty result; other columns are ignored. A text of any length is gone through in
overlapping parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pieces

LENGTH, Q = 100, 32
#: Bytes that the first buckets agree in.
FIRST = 8
#: Different runs of an anchor from which its windows are dealt out one by one.
CROWD = 4096
#: Bits of the table of live anchors, as a power of two: 8 MB. Slices of it that are made by one task each.
TABLE_BITS, SLICE_BITS = 26, 16
#: Bytes of text to a bucket of records, buckets at least and at most; bytes of runs that are sorted together.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS, SORTED_BYTES = 5 << 20, 32, 1 << 16, 2 << 20
#: Bytes of texts that are gone through together.
PART_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).max
#: The smallest unsigned type that holds a run's number of windows.
MANY = np.dtype("<u2")

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), "<u8")

#: What a record carries: hashes of its anchor and its bytes, document, second part of its place in the order, first window, windows.
RECORD = np.dtype([("anchor", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("at", "<u4"), ("many", MANY)])
#: A repeat inside a document: first window, windows.
REPEAT = np.dtype([("at", "<u4"), ("many", "<u4")])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q bytes (a power of two) from each place on."""
    h, width, factor = _BYTES[data], 1, np.uint64(0xD6E8FEB86659FD93)
    while width < q:
        with np.errstate(over="ignore"):
            h = h[:-width] * factor + h[width:]
            factor = factor * factor
        width *= 2
    return mixed(h)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of data with one anchor: first window, number of windows, the anchor's place and hash."""
    wide = LENGTH - Q + 1
    grams = gram_hashes(data)
    # The hash above, the place below: the least key is the first of the least hashes, and no two are equal.
    low = np.uint64((1 << 24) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= wide:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < wide:
        keys = np.minimum(keys[: len(keys) - (wide - width)], keys[wide - width :])
    place = (keys & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return first, np.diff(np.r_[first, len(place)]), place[first], grams[place[first]]


class Piece:
    """Texts of one batch one behind the other in the order of documents, and the runs of their windows."""

    def __init__(self, ids: list[int], subs: list[int], texts: list[bytes], starts: list[int]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i], subs[i], starts[i]))
        order = [i for k, i in enumerate(order) if not k or (ids[i], subs[i], starts[i]) != (ids[order[k - 1]], subs[order[k - 1]], starts[order[k - 1]])]
        self.data = b"".join(texts[i] for i in order)
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        begins = np.cumsum(sizes) - sizes
        whole = np.frombuffer(self.data, np.uint8)
        if len(whole) < LENGTH:
            self.first, self.many, self.hash, self.row = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        else:
            first, many, _, self.hash = anchors(whole)
            # Windows that reach from one text into the next are none: a run ends where they begin and begins where they end.
            row = np.searchsorted(begins, first, "right") - 1
            last = np.searchsorted(begins, first + many - 1, "right") - 1
            across = np.flatnonzero((last > row) | (first + many + LENGTH - 1 > (begins + sizes)[row]))
            keep = np.ones(len(first), bool)
            keep[across] = False
            cut = [(r, max(f, b), min(f + m, b + s - LENGTH + 1), h) for f, m, r0, r1, h in zip(first[across].tolist(), many[across].tolist(), row[across].tolist(), last[across].tolist(), self.hash[across].tolist()) for r in range(r0, r1 + 1) for b, s in [(int(begins[r]), int(sizes[r]))]]
            cut = [c for c in cut if c[1] < c[2]]
            self.first = np.r_[first[keep], np.array([c[1] for c in cut], np.int64)]
            self.many = np.r_[many[keep], np.array([c[2] - c[1] for c in cut], np.int64)]
            self.hash = np.r_[self.hash[keep], np.array([c[3] for c in cut], np.uint64)]
            self.row = np.r_[row[keep], np.array([c[0] for c in cut], np.int64)]
            again = np.argsort(self.first, kind="stable")
            self.first, self.many, self.hash, self.row = self.first[again], self.many[again], self.hash[again], self.row[again]
        self.ids, self.subs = np.array([ids[i] for i in order], np.int64), np.array([subs[i] for i in order], np.int64)
        self.at = np.array([starts[i] for i in order], np.int64) - begins

    def heads(self, runs: np.ndarray) -> np.ndarray:
        """Records of some runs, without the hash of their bytes."""
        out = np.zeros(len(runs), RECORD)
        row = self.row[runs]
        out["anchor"], out["many"] = self.hash[runs], self.many[runs]
        out["doc"], out["sub"], out["at"] = self.ids[row], self.subs[row], self.first[runs] + self.at[row]
        return out

    def records(self) -> np.ndarray:
        """A record for every run, in the order of documents."""
        out = self.heads(np.arange(len(self.first)))
        view, digest = memoryview(self.data), xxhash.xxh3_64_intdigest
        out["whole"] = np.fromiter((digest(view[a:b]) for a, b in zip(self.first.tolist(), (self.first + self.many + LENGTH - 1).tolist())), np.uint64, len(out))
        return out

    def windows(self, runs: np.ndarray) -> np.ndarray:
        """A record for every window of some runs, hashed by its whole bytes twice."""
        n = self.many[runs]
        starts = np.repeat(self.first[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row = np.repeat(self.row[runs], n)
        out = np.empty(len(starts), RECORD)
        view = memoryview(self.data)
        both = b"".join(xxhash.xxh3_128_digest(view[s : s + LENGTH]) for s in starts.tolist())
        out["anchor"], out["whole"] = np.frombuffer(both, "<u8")[::2], np.frombuffer(both, "<u8")[1::2]
        out["doc"], out["sub"], out["at"], out["many"] = self.ids[row], self.subs[row], starts + self.at[row], 1
        return out

    def bytes_of(self, run: int) -> bytes:
        return self.data[self.first[run] : self.first[run] + self.many[run] + LENGTH - 1]


def parts(batch: pa.RecordBatch) -> Iterator[Piece]:
    """Pieces of a batch (doc, sub, text): whole texts of about PART_BYTES together, longer ones in parts that overlap."""
    for some in pieces(batch, PART_BYTES):
        ids, subs, texts = some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).cast(pa.binary()).to_pylist()
        if some.num_rows == 1 and len(texts[0]) > PART_BYTES:
            for start in range(0, len(texts[0]) - LENGTH + 1, PART_BYTES):
                yield Piece(ids, subs, [texts[0][start : start + PART_BYTES + LENGTH - 1]], [start])
        else:
            yield Piece(ids, subs, texts, [0] * len(ids))


def first_of_each(records: np.ndarray) -> np.ndarray:
    """Which of the records, in the order of documents, are the first with their two hashes."""
    with np.errstate(over="ignore"):
        both = mixed(records["anchor"] * _MIX + records["whole"])
    # One 64-bit hash of both tells them apart inside a task's piece only; where many tasks' records meet, both are compared.
    first = np.zeros(len(records), bool)
    first[np.unique(both, return_index=True)[1]] = True
    return first


def repeats(records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Repeats of each document (doc, sub, packed ranges) of records, ranges that touch united."""
    if not len(records):
        return
    records = records[np.lexsort((records["at"], records["sub"], records["doc"]))]
    ends = records["at"].astype(np.int64) + records["many"]
    same = (records["doc"][1:] == records["doc"][:-1]) & (records["sub"][1:] == records["sub"][:-1])
    new = np.r_[True, ~same | (records["at"][1:] > ends[:-1])]
    heads = np.flatnonzero(new)
    spans = np.empty(len(heads), REPEAT)
    spans["at"] = records["at"][heads]
    spans["many"] = np.maximum.reduceat(ends, heads) - records["at"][heads]
    docs, subs = records["doc"][heads], records["sub"][heads]
    stops = np.flatnonzero(np.r_[(docs[1:] != docs[:-1]) | (subs[1:] != subs[:-1]), True]) + 1
    begin = 0
    for stop in stops.tolist():
        yield int(docs[begin]), int(subs[begin]), spans[begin:stop].tobytes()
        begin = stop


ROW = "kind int, bucket long, doc long, sub long, packed binary"
#: Kinds of rows: records of runs or windows; live anchors' runs with their bytes; repeats of a document; anchors and their numbers of runs.
RECORDS, BYTES, REPEATS, ANCHORS = range(4)
_NAMES = ["kind", "bucket", "doc", "sub", "packed"]
_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 4096]), _KINDS)], _NAMES)


def _repeat_rows(records: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of repeats; their buckets, dealt out by document, are numbers below zero."""
    return [(REPEATS, -1 - doc % buckets, doc, sub, packed) for doc, sub, packed in repeats(records)]


def _packed(records: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of records dealt out by both hashes, column behind column, since equal columns compress."""
    with np.errstate(over="ignore"):
        bucket = (mixed(records["whole"] ^ (records["anchor"] * _MIX)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    stops = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], len(bucket) > 0]) + 1
    begin = 0
    for stop in stops.tolist():
        some = records[begin:stop]
        yield RECORDS, int(bucket[begin]), None, None, b"".join(np.ascontiguousarray(some[c]).tobytes() for c in RECORD.names)
        begin = stop


def _unpacked(packed: Iterable[bytes]) -> np.ndarray:
    packed = list(packed)
    out = np.empty(sum(len(p) for p in packed) // RECORD.itemsize, RECORD)
    begin = 0
    for p in packed:
        n, at = len(p) // RECORD.itemsize, 0
        for c in RECORD.names:
            out[c][begin : begin + n] = np.frombuffer(p, RECORD[c], n, at)
            at += n * RECORD[c].itemsize
        begin += n
    return out


def _anchor_rows(hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Rows of anchors with their numbers of different runs, dealt out by slices of the bit table."""
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    part = (hashes >> np.uint64(64 - TABLE_BITS + SLICE_BITS)).astype(np.int64)
    stops = np.flatnonzero(np.r_[part[1:] != part[:-1], len(part) > 0]) + 1
    begin = 0
    for stop in stops.tolist():
        yield ANCHORS, int(part[begin]), None, None, hashes[begin:stop].tobytes() + np.minimum(counts[begin:stop], CROWD + 1).astype("<u4").tobytes()
        begin = stop


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows (doc, sub, packed) of one bucket after the other; batches are sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, *row in zip(*(batch.column(c).to_pylist() for c in _NAMES[1:])):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append(row)
    if held:
        yield now, held


def _in_buckets(rows: DataFrame, buckets: int, solve) -> DataFrame:
    """Rows of solve(bucket, its packed values) for each bucket; repeats that a piece found itself go on as they are."""

    def run(batches):
        for bucket, found in _grouped(batches):
            if bucket < 0:
                yield from _batches([(REPEATS, bucket, *row) for row in found])
            else:
                for out in solve(bucket, [packed for _, _, packed in found]):
                    yield from _batches(out)

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ROW)


def _run_rows(buckets: int):
    """Runs of all windows: those that a piece holds twice are repeats at once, the others go on."""

    def run(batches):
        for batch in batches:
            for piece in parts(batch):
                records = piece.records()
                first = first_of_each(records)
                yield from _batches([*_repeat_rows(records[~first], buckets), *_packed(records[first], buckets)])

    return run


def _first_marked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All records of a bucket, which are the first with their two hashes, and which are repeats: neither the first nor stated again."""
    records = _unpacked(packed)
    records = records[np.lexsort((records["at"], records["sub"], records["doc"], records["whole"], records["anchor"]))]
    first = np.r_[True, (records["anchor"][1:] != records["anchor"][:-1]) | (records["whole"][1:] != records["whole"][:-1])]
    heads = records[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return records, first, (records["doc"] != heads["doc"]) | (records["sub"] != heads["sub"]) | (records["at"] != heads["at"])


def _first_runs(buckets: int):
    """Of a bucket's runs those that are not the first with their bytes, as repeats; of the others the anchors' numbers."""

    def solve(bucket: int, packed: list[bytes]):
        records, first, repeated = _first_marked(packed)
        yield [*_repeat_rows(records[repeated], buckets), *_anchor_rows(*np.unique(records["anchor"][first], return_counts=True))]

    return solve


def _slices(batches):
    """A slice of each bit table: anchors of several runs, and of more than CROWD."""
    for part, rows in _grouped(batches):
        packed = [r[-1] for r in rows]
        counts = [np.frombuffer(p, "<u4", len(p) // 12, len(p) // 12 * 8) for p in packed]
        hashes, where = np.unique(np.concatenate([np.frombuffer(p, "<u8", len(p) // 12) for p in packed]), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts))
        place = ((hashes >> np.uint64(64 - TABLE_BITS)) & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)
        out = []
        for least in (2, CROWD + 1):
            bits = np.zeros(1 << SLICE_BITS, np.uint8)
            bits[place[total >= least]] = 1
            out.append(np.packbits(bits).tobytes() if bits.any() else b"")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([b], pa.binary()) for b in out)], ["part", "live", "crowded"])


def bit_tables(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The two tables of bits, live anchors and crowded ones: 8 MB each, whatever the corpus."""
    n = 1 << (TABLE_BITS - SLICE_BITS)
    tables = np.zeros((2, n, (1 << SLICE_BITS) // 8), np.uint8)
    dealt = rows.where(F.col("kind") == ANCHORS).repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_slices, "part long, live binary, crowded binary").toArrow()
    for part, *bits in zip(*(found.column(k).to_pylist() for k in range(3))):
        for k, b in enumerate(bits):
            if b:
                tables[k, part] = np.frombuffer(b, np.uint8)
    return tables[0].reshape(-1), tables[1].reshape(-1)


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


def _byte_rows(tables, buckets: int):
    """Runs with live anchors and their bytes; windows of crowded anchors one by one."""

    def run(batches):
        live, crowded = tables.value
        for batch in batches:
            for piece in parts(batch):
                many = _has(crowded, piece.hash)
                rows = []
                if many.any():
                    windows = piece.windows(np.flatnonzero(many))
                    first = first_of_each(windows)
                    rows += [*_repeat_rows(windows[~first], buckets), *_packed(windows[first], buckets)]
                # An equal run earlier in the piece stands for a later one, which step 1 found to be a repeat.
                seen: dict[bytes, int] = {}
                for r in np.flatnonzero(_has(live, piece.hash) & ~many).tolist():
                    seen.setdefault(piece.bytes_of(r), r)
                runs = np.fromiter(seen.values(), np.int64, len(seen))
                heads, texts = piece.heads(runs), list(seen)
                bucket = (piece.hash[runs] % np.uint64(buckets)).astype(np.int64)
                for b in np.unique(bucket).tolist():
                    some = np.flatnonzero(bucket == b)
                    # Numbers of buckets above those of records.
                    rows.append((BYTES, buckets + b, None, None, len(some).to_bytes(4, "little") + heads[some].tobytes() + b"".join(texts[i] for i in some.tolist())))
                yield from _batches(rows)

    return run


def refined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bucket numbers of the suffixes `starts` of data: equal where they agree in LENGTH bytes.

    data: stretches one behind the other that end at `ends`; each suffix has LENGTH bytes of its own. Bucket-pointer refinement: at each
    step two places with equal numbers agree in `depth` bytes, if their stretches are that long. Suffixes alone in their
    bucket are done.
    """
    words = np.zeros(len(data), np.uint64)
    for k in range(FIRST):
        words[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (FIRST - 1 - k))
    here = np.arange(len(data))
    left = ends[np.searchsorted(ends, here, "right")] - here
    active = np.flatnonzero(left >= FIRST)
    bucket = np.full(len(data), -1, np.int64)
    keys, depth, given = words[active], FIRST, 0
    while True:
        # Sorted on their keys, suffixes with equal ones lie together: these are the buckets.
        order = np.argsort(keys)
        active, keys = active[order], keys[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        # Their numbers lie above all that were given, and the next, deeper refinement sorts on them.
        bucket[active] = given + np.cumsum(new)
        given += int(new.sum())
        if depth >= LENGTH:
            return bucket[starts]
        step = min(depth, LENGTH - depth)
        alone = new & np.r_[new[1:], True]
        active = active[~alone & (left[active] >= depth + step)]
        keys = (bucket[active] << 32) | bucket[active + step]
        depth += step


def _window_repeats(runs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Records of the windows in runs (record, bytes), in any order, that an earlier window of these equals."""
    heads = np.frombuffer(b"".join(h for h, _ in runs), RECORD)
    order = np.lexsort((heads["at"], heads["sub"], heads["doc"]))
    heads = heads[order]
    data = np.frombuffer(b"".join(runs[i][1] for i in order.tolist()), np.uint8)
    sizes = heads["many"].astype(np.int64) + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    n = heads["many"].astype(np.int64)
    run = np.repeat(np.arange(len(heads)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    bucket = refined(data, begins[run] + inside, begins + sizes)
    first = np.zeros(len(run), bool)
    first[np.unique(bucket, return_index=True)[1]] = True
    out = np.empty(int((~first).sum()), RECORD)
    run, inside = run[~first], inside[~first]
    out["doc"], out["sub"], out["at"], out["many"] = heads["doc"][run], heads["sub"][run], heads["at"][run] + inside, 1
    return out


def _sorted_runs(packed: list[bytes]) -> Iterator[np.ndarray]:
    """Repeats in a bucket's runs: equal ones united, then the runs of some anchors sorted together."""
    least: dict[bytes, tuple] = {}
    for p in packed:
        n = int.from_bytes(p[:4], "little")
        at = 4 + n * RECORD.itemsize
        heads = np.frombuffer(p, RECORD, n, 4)
        for k, (place, many) in enumerate(zip(zip(heads["doc"].tolist(), heads["sub"].tolist(), heads["at"].tolist()), heads["many"].tolist())):
            # The anchor stands before its run's bytes, so that runs of one anchor follow each other below.
            key = p[4 + k * RECORD.itemsize : 12 + k * RECORD.itemsize] + p[at : at + many + LENGTH - 1]
            at += many + LENGTH - 1
            if key not in least or place < least[key][0]:
                least[key] = (place, p[4 + k * RECORD.itemsize : 4 + (k + 1) * RECORD.itemsize])
    some, held, now = [], 0, None
    for key in sorted(least):
        if held > SORTED_BYTES and key[:8] != now:
            yield _window_repeats(some)
            some, held = [], 0
        some.append((least[key][1], key[8:]))
        held += len(key)
        now = key[:8]
    if some:
        yield _window_repeats(some)


def _refined_runs(buckets: int):
    """Repeats among the windows of crowded anchors and among the runs of live ones."""

    def solve(bucket: int, packed: list[bytes]):
        if bucket < buckets:
            records, _, repeated = _first_marked(packed)
            yield _repeat_rows(records[repeated], buckets)
        else:
            for records in _sorted_runs(packed):
                yield _repeat_rows(records, buckets)

    return solve


def ordered_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents (doc, sub, text, doc_id): the id or the greatest number, a hash of the text, and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(id_col).cast("long")
    return docs.select(F.coalesce(number, F.lit(int(NO_ID))).alias("doc"), F.xxhash64(text).alias("sub"), text.alias("text"), number.alias("doc_id"))


def repeated_ranges(docs: DataFrame, scratch: Scratch, buckets: int | None = None) -> DataFrame:
    """Rows (doc, sub, packed): ranges of windows that are repeats, of ordered_texts()."""
    texts = docs.select("doc", "sub", "text")
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET_BYTES))
    runs = texts.mapInArrow(_run_rows(buckets), ROW)
    found = scratch.keep(_in_buckets(runs, buckets, _first_runs(buckets)))
    tables = docs.sparkSession.sparkContext.broadcast(bit_tables(found))
    more = _in_buckets(texts.mapInArrow(_byte_rows(tables, buckets), ROW), buckets, _refined_runs(buckets))
    return found.where(F.col("kind") == REPEATS).unionByName(more).select("doc", "sub", "packed")


def without(text: bytes, packed: list[bytes]) -> tuple[bytes, int]:
    """The text without the bytes of its repeats, and how many runs of bytes that leaves out."""
    change = np.zeros(len(text) + 1, np.int32)
    for p in packed:
        spans = np.frombuffer(p, REPEAT)
        begin = spans["at"].astype(np.int64)
        np.add.at(change, begin, 1)
        np.add.at(change, begin + spans["many"] + LENGTH - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows (doc_id, text binary, kept binary, n_spans): every document and what is left of its bytes."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    texts = ordered_texts(docs, id_col, text_col)
    ranges = repeated_ranges(texts, scratch, buckets).groupBy("doc", "sub").agg(F.collect_list("packed").alias("ranges"))

    def run(batches):
        for batch in batches:
            for some in pieces(batch):
                texts, ranges = some.column(1).cast(pa.binary()).to_pylist(), some.column(2).to_pylist()
                kept = [without(t, r) if r else (t, 0) for t, r in zip(texts, ranges)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.binary()), pa.array([k for k, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["doc_id", "text", "kept", "n_spans"])

    joined = texts.join(ranges.hint("shuffle_hash"), ["doc", "sub"], "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, text binary, kept binary, n_spans long")


def removals(docs: DataFrame, **names) -> DataFrame:
    """A row for every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    size, kept = F.octet_length("text").cast("long"), F.octet_length("kept").cast("long")
    return deduplicated(docs, **names).select("doc_id", size.alias("n_bytes"), (size - kept).alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_bucket_pointers(spark, sf_dir: str) -> DataFrame:
    return removals(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_bucket_pointers": op11_bucket_pointers}
ORACLES: dict[str, str] = {}
