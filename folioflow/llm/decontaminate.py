"""Benchmark decontamination: places in documents within an edit budget of a test item.

Texts and items are normalised: A-Z lower-cased, runs of ASCII white space and punctuation made one space, one space at
either end. An item of n bytes may be met with up to k = floor(RATE * n) edits. It is cut into k + 1 pieces: k edits leave one of them
whole. An Aho-Corasick automaton of all pieces finds the whole ones. Pieces are the leaves of a binary tree, in which budgets
k1 + k2 = k - 1 of the halves keep the same guarantee, so a hit is verified from small ranges to the whole item, by Myers's
bit-parallel distance, and most false hits end after a few steps. A text that repeats itself may hit an item's pieces at every turn: once an
item has been tried TRIES times in a text, the places of its other hits are united and each united range is gone through once.
Ranges of more than LONG bytes are verified in a band about the hit's diagonal that is widened until the edits found fit into it, and what was
found about a range at a diagonal is remembered for the text's other hits there.

The test items are taken in blocks of about BLOCK_BYTES, every block against all rows; only a block is broadcast.

Cases: null and empty texts match nothing, nor do items without a letter, digit or non-ASCII character; repeated rows give
repeated results; null ids stay null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_table, map_arrow, utf8

RATE = 0.1
BLOCK_BYTES = 2 << 20
#: Hits of an item in a text that are verified one by one; bits of a place that are left out where others are united.
TRIES, PLACE_BITS = 64, 6
#: Bytes of a range from which bands are used; their first half width, and columns that share a window of rows.
LONG, BAND, COLUMNS = 2048, 64, 1024
DELIMITERS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TABLE = lower_table(DELIMITERS)


def normalised(text: bytes) -> str:
    """One character a byte; empty if the text has no word."""
    words = text.translate(TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(where: dict[str, int], m: int, text: str, most: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits, at most `most`, that turn the pattern into a part of the text, and where that part first ends.

    where, m: bits() and length of the pattern. anchored: the part has to begin with the text. (most + 1, -1) if none.
    """
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, end = (score, 0) if score <= most else (most + 1, -1)
    for j, c in enumerate(text, 1):
        same = where.get(c, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | (~(across | plus) & mask)
        low = plus & across
        if up & high:
            score += 1
        elif low & high:
            score -= 1
            if score < best:
                best, end = score, j
        up = (up << 1 | anchored) & mask
        plus = (low << 1) & mask | (~(down | up) & mask)
        minus = up & down
    return best, end


def banded(where: dict[str, int], m: int, text: str, most: int, diagonal: int, anchored: bool = False) -> tuple[int, int]:
    """distance() of the ways that stay near a diagonal, on which row i meets column i + diagonal: exact for a way that touches it.

    A way of b edits stays within b of a diagonal that it touches, so a window of rows that moves with the columns is enough; what lies
    outside counts as worse. The band is widened until the edits found fit into it.
    """
    band = min(BAND, most)
    while True:
        found = _in_band(where, m, text, most, diagonal, band, anchored)
        if found[0] <= band or band >= most:
            return found
        band = min(4 * band, most)


def _in_band(where: dict[str, int], m: int, text: str, most: int, diagonal: int, band: int, anchored: bool) -> tuple[int, int]:
    best, end = (m, 0) if m <= most else (most + 1, -1)
    top, bottom, plus, minus, score = 0, 0, 0, 0, 0
    for begin in range(0, len(text), COLUMNS):
        columns = text[begin : begin + COLUMNS]
        low, high = begin + 1 - diagonal - band, begin + len(columns) - diagonal + band
        if high < 1:
            continue
        low, high = max(0, min(low, m) - 1), min(m, high)
        if low >= m:
            break
        # Rows above leave the window; those that enter below lie one more each.
        plus, minus = plus >> (low - top), minus >> (low - top)
        if bottom < low:
            score, bottom = score + low - bottom, low
        plus |= ((1 << (high - bottom)) - 1) << (bottom - low)
        score += high - bottom
        top, bottom = low, high
        size = high - low
        mask, last = (1 << size) - 1, 1 << (size - 1)
        into = anchored or low > 0
        here: dict[str, int] = {}
        for j, c in enumerate(columns, begin + 1):
            same = here.get(c)
            if same is None:
                same = here[c] = (where.get(c, 0) >> low) & mask
            down = same | minus
            across = (((same & plus) + plus) ^ plus) | same
            up = minus | (~(across | plus) & mask)
            left = plus & across
            if up & last:
                score += 1
            elif left & last:
                score -= 1
            if high == m and score < best:
                best, end = score, j
            up = (up << 1 | into) & mask
            plus = (left << 1) & mask | (~(down | up) & mask)
            minus = up & down
    return (best, end) if best <= most else (most + 1, -1)


class Item:
    """A normalised item with its tree of ranges: (start, end, budget, parent)."""

    def __init__(self, text: str, rate: float = RATE):
        self.text = text
        self.budget = min(int(rate * len(text)), len(text) - 1)
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves: list[int] = []
        self._grow(0, len(text), self.budget, -1)
        self._bits: dict[int, dict[str, int]] = {}
        self._back: dict[str, int] | None = None

    def _grow(self, start: int, end: int, budget: int, parent: int) -> None:
        me = len(self.nodes)
        self.nodes.append((start, end, budget, parent))
        if not budget:
            self.leaves.append(me)
            return
        left = (budget - 1) // 2
        middle = start + (end - start) * (left + 1) // (budget + 1)
        self._grow(start, middle, left, me)
        self._grow(middle, end, budget - 1 - left, me)

    def verify(self, leaf: int, text: str, at: int, known: dict[tuple[int, int], bool]) -> tuple[int, int, int] | None:
        """(distance, start, end) of the whole item around its leaf's hit at text[at:], or None.

        known: what was found out about long ranges of this item in this text; whatever is known there is not returned again.
        """
        origin = at - self.nodes[leaf][0]
        node = self.nodes[leaf][3]
        if node < 0:
            return 0, at, at + len(self.text)
        while True:
            start, end, budget, parent = self.nodes[node]
            first = max(0, origin + start - budget)
            long = end - start > LONG
            if not long or (node, origin) not in known:
                part = text[first : max(0, origin + end + budget)]
                if node not in self._bits:
                    self._bits[node] = bits(self.text[start:end])
                found, stop = banded(self._bits[node], end - start, part, budget, origin + start - first) if long else distance(self._bits[node], end - start, part, budget)
                if long:
                    known[node, origin] = found <= budget
                if found > budget:
                    return None
            elif parent < 0 or not known[node, origin]:
                return None
            if parent < 0:
                return self._placed(part, found, stop, first)
            node = parent

    def _placed(self, part: str, found: int, stop: int, first: int) -> tuple[int, int, int]:
        """(distance, start, end) of what ends at part[stop], part being text[first:]."""
        before = part[max(0, stop - len(self.text) - found) : stop][::-1]
        if self._back is None:
            self._back = bits(self.text[::-1])
        m = len(self.text)
        # Both begin at their ends, on one diagonal.
        _, back = banded(self._back, m, before, found, 0, True) if m > LONG else distance(self._back, m, before, found, anchored=True)
        return found, first + stop - back, first + stop

    def search(self, text: str, first: int, last: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best place that lies in text[first:last], or None."""
        part = text[first:last]
        if 0 not in self._bits:
            self._bits[0] = bits(self.text)
        found, stop = distance(self._bits[0], len(self.text), part, self.budget)
        return None if found > self.budget else self._placed(part, found, stop, first)


def ranges(places: dict[int, list[int]], before: int, behind: int, size: int) -> Iterator[tuple[int, int]]:
    """United ranges of a text of this size around hits: places holds, by the start of a piece in its item, where it was hit, in units of 2 ** PLACE_BITS."""
    around = sorted({((p << PLACE_BITS) - start - before, ((p + 1) << PLACE_BITS) - start + behind) for start, ps in places.items() for p in ps})
    low = high = None
    for a, b in around:
        if high is not None and a <= high:
            high = max(high, b)
            continue
        if high is not None:
            yield max(0, low), min(high, size)
        low, high = a, b
    if high is not None:
        yield max(0, low), min(high, size)


class Matcher:
    """All items of a block."""

    def __init__(self, texts: list[bytes | None], rate: float = RATE):
        self.items = [Item(n, rate) if (n := normalised(t or b"")) else None for t in texts]
        pieces: dict[str, dict[int, list[int]]] = {}  # of a piece, the items it is of, and which leaves
        for i, item in enumerate(self.items):
            for leaf in item.leaves if item else ():
                start, end, _, _ = item.nodes[leaf]
                pieces.setdefault(item.text[start:end], {}).setdefault(i, []).append(leaf)
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (piece, tuple(owners.items())))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, raw: bytes, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item's best place: fewest edits, then leftmost; code points of the text."""
        text = normalised(raw)
        if not text or not len(self.automaton):
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tries: dict[int, int] = {}
        later: dict[tuple[int, str], set[int]] = {}
        known: dict[int, dict[tuple[int, int], bool]] = {}
        for last, (piece, owners) in self.automaton.iter(text):
            at = last + 1 - len(piece)
            for i, leaves in owners:
                if i in best and best[i][0] == 0:
                    continue
                item = self.items[i]
                seen = known.setdefault(i, {})
                # Whole long items that were looked at on this diagonal are done with.
                leaves = [leaf for leaf in leaves if (0, at - item.nodes[leaf][0]) not in seen] if seen else leaves
                if not leaves:
                    continue
                if tries.get(i, 0) >= TRIES:
                    later.setdefault((i, piece), set()).add(at >> PLACE_BITS)
                    continue
                tries[i] = tries.get(i, 0) + len(leaves)
                for leaf in leaves:
                    found = item.verify(leaf, text, at, seen)
                    if found:
                        if first_only:
                            return [(i, *found)]
                        if i not in best or found < best[i]:
                            best[i] = found
        left: dict[int, dict[int, list[int]]] = {}
        for (i, piece), places in later.items():
            for leaf in dict(self.automaton.get(piece)[1])[i]:
                left.setdefault(i, {})[self.items[i].nodes[leaf][0]] = sorted(places)
        for i, places in left.items():
            item = self.items[i]
            for first, end in ranges(places, item.budget, len(item.text) + item.budget, len(text)):
                if i in best and best[i][0] == 0:
                    break
                found = item.search(text, first, end)
                if found:
                    if first_only:
                        return [(i, *found)]
                    if i not in best or found < best[i]:
                        best[i] = found
        if not best:
            return []
        # Normalised places to words, words to code points.
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", re.sub(rb"[\t-\r]", b" ", raw.translate(TABLE)))]
        out = []
        for i, (edits, start, end) in sorted(best.items()):
            word = max(0, text.count(" ", 0, start + 1) - 1)
            stop = max(word, text.count(" ", 0, max(end - 1, 0)) - 1)
            word, stop = min(word, len(spans) - 1), min(stop, len(spans) - 1)
            a = len(raw[: spans[word][0]].decode("utf-8", "replace"))
            b = a + len(raw[spans[word][0] : spans[stop][1]].decode("utf-8", "replace"))
            out.append((i, edits, a, b))
        return out


def blocks(items: DataFrame, id_col: str, text_col: str, size: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of about `size` bytes of text, one after the other at the driver."""
    given = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // size)
    for k in range(count):
        rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        if rows:
            yield sorted(((r["item_id"], r["text"].encode()) for r in rows), key=lambda r: (r[0] is not None, r[0], r[1]))


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, distance, start, end): each item's best place in each document that it is met in."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, distance int, start long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, item_id_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            ids = [i for i, _ in shared.value]
            matcher = Matcher([t for _, t in shared.value], rate)

            def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                found = [(row, *m) for row, text in enumerate(utf8(batch.column(1))) if text for m in matcher.matches(text)]
                rows, item, edits, start, end = zip(*found, strict=True) if found else ((), (), (), (), ())
                doc = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array([ids[i] for i in item]) if item else pa.nulls(0), pa.array(edits, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "item_id", "distance", "start", "end"])

            return lambda batch: (b for b in each(batch) if b.num_rows)

        out = out.unionByName(map_arrow(given, make, schema))
    return out


def without_matches(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, as they are, in which no item is met."""
    at = docs.columns.index(text_col)
    for block in blocks(items, item_id_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast([t for _, t in block])

        def make(shared=shared):
            matcher = Matcher(shared.value, rate)

            def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                clean = [not (text and matcher.matches(text, first_only=True)) for text in utf8(batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

            return each

        docs = map_arrow(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
    return docs


def op7_pigeonhole_myers(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_pigeonhole_myers": op7_pigeonhole_myers}
ORACLES: dict[str, str] = {}
