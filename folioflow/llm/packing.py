"""Packing token pieces into sequences by linear grouping, then best fit.

Lengths are whole numbers of 1..capacity, so a histogram of at most `capacity` counts says all about the corpus that the
packing needs, however large it is. On that histogram: large lengths are sorted and cut into groups of equal
cardinality, each rounded up to its largest length; column generation finds the configurations of these few sizes; the actual
lengths take the places of the rounded ones; what is left over and the small lengths then go best-fit into
the space left. Runs of equal sequences stand for themselves once, so the plan has a bounded size as well. Pieces
find their place by their rank among the pieces of their length.

Cases: a null or empty text is a document of one id, the end id; repeated rows are packed one by one; a null id stays null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, byte_letters, map_arrow, utf8

CAPACITY = 2048
END_ID = 0
#: Words, and half as many parts of words, kept with their ids by a Python worker, in some 300 MB; longer ones are not kept.
CACHE_WORDS, CACHE_WORD_BYTES = 800_000, 64
#: Fixed value: how the default tokenizer file splits words into parts.
TOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts encoded at once: few enough for their words to stay in the processor's caches.
ENCODE_TEXTS = 16
#: Lengths over this share of the capacity are large; groups of equal cardinality they are cut into.
LARGE, GROUPS = 1 / 8, 48
#: Pieces of one length are ranked in buckets of about this many, and in this many buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 32


class Recent:
    """A dict of about `most` entries: when half of them are new, the older half is forgotten."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def found(self, keys) -> dict:
        """Those of the keys that are kept."""
        new, old = self.new.get, self.old.get
        return {k: v for k in keys if (v := new(k) or old(k)) is not None}

    def update(self, more: dict) -> None:
        if len(self.new) + len(more) > self.half:
            self.old, self.new = self.new, {}
        self.new.update(more)


class WordIds:
    """Texts' ids as little-endian 32-bit numbers, by a tokenizer that splits at white space before anything else.

    Such a tokenizer's ids of a text are those of its words one after the other, and words recur: each is encoded once
    and kept. A new word of plain letters, digits and punctuation is first cut into the parts of which the tokenizer's own
    pattern makes it, since these recur more than words do; all others are encoded as they are.
    """

    #: Texts whose parts are known to be those of PARTS, unless a special token's mark `<|` is there: nothing that normalisation composes.
    PLAIN = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    #: The tokenizer file's own pattern over these characters, after lower-casing.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    SUFFIX = "</w>"

    def __init__(self, tokenizer_path: str, most_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(self.SUFFIX)]] = True
        model = json.loads(self.tokenizer.to_str())
        patterns = [p.get("pattern", {}).get("Regex") for p in (model.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.cuts = bool(self.ends.any()) and TOKEN_PATTERN in patterns
        self.fast = self._by_ranks(model["model"]) if self.cuts else None
        self.words, self.parts = Recent(most_words), Recent(most_words // 2)

    def _by_ranks(self, model: dict):
        """The same merges for tiktoken, five times as fast: a zero byte stands for the end of a word. None if the vocabulary isn't in the order of its merges."""
        vocabulary, merges, letters = model["vocab"], model["merges"], byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        first = len(vocabulary) - len(pairs)
        if any(vocabulary.get(a + b) != first + k for k, (a, b) in enumerate(pairs)):
            return None
        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            end = token.endswith(self.SUFFIX) and token != self.SUFFIX
            ranks[bytes(letters[c] for c in (token.removesuffix(self.SUFFIX) if end else token)) + b"\0" * end] = i
        if len(ranks) != len(vocabulary):
            return None
        import tiktoken

        return tiktoken.Encoding("parts", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts, encoded side by side and told apart by the mark of a part's last id."""
        out: list[bytes] = []
        for i in range(0, len(parts), 4096):
            some = parts[i : i + 4096]
            if self.fast:
                ids = np.array(self.fast.encode_ordinary("\0".join(some) + "\0"), "<u4")
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                out += self._each(some)
                continue
            raw, start = ids.tobytes(), 0
            for stop in (stops * 4).tolist():
                out.append(raw[start:stop])
                start = stop
        return out

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, cut = self.PLAIN.fullmatch, self.PARTS.findall
        cuts, other = {}, {}
        for w in words:
            t = w.decode("utf-8", "replace")
            if self.cuts and plain(t) and "<|" not in t:
                cuts[w] = cut(t.lower())
            else:
                other[w] = t
        found = dict(zip(other, self._each(list(other.values())), strict=True)) if other else {}
        asked = set(chain.from_iterable(cuts.values()))
        parts = self.parts.found(asked)
        new = [p for p in asked if p not in parts]
        encoded = dict(zip(new, self._parts(new), strict=True))
        kept = {p: i for p, i in parts.items() if p not in self.parts.new} | encoded
        self.parts.update({p: i for p, i in kept.items() if len(p) <= CACHE_WORD_BYTES})
        parts |= encoded
        get = parts.__getitem__
        for w, ps in cuts.items():
            found[w] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))
        return found

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        got = list(map(self.words.new.get, words))
        at = [k for k, g in enumerate(got) if g is None]
        if at:
            lost, old = {words[k] for k in at}, self.words.old
            fresh = {w: old[w] for w in lost if w in old} if old else {}
            fresh |= self._new([w for w in lost if w not in fresh] if fresh else list(lost))
            for k in at:
                got[k] = fresh[words[k]]
            self.words.update({w: i for w, i in fresh.items() if len(w) <= CACHE_WORD_BYTES})
        out, start = [], 0
        for ws in split:
            out.append(b"".join(got[start : start + len(ws)]))
            start += len(ws)
        return out


#: The encoder that this worker used last: workers outlive tasks.
_encoders: dict[tuple[str, int], WordIds] = {}


def word_ids(tokenizer_path: str, most_words: int = CACHE_WORDS) -> WordIds:
    if (tokenizer_path, most_words) not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_path, most_words] = WordIds(tokenizer_path, most_words)
    return _encoders[tokenizer_path, most_words]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and an end id, cut every `capacity` ids."""

    def make():
        encode, end = word_ids(tokenizer_path, cache_words), np.array([end_id], "<u4").tobytes()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            texts = [t or b"" for t in utf8(batch.column(1))]
            encoded = chain.from_iterable(encode(texts[i : i + ENCODE_TEXTS]) for i in range(0, len(texts), ENCODE_TEXTS))
            for row, found in enumerate(encoded):
                found += end
                for k, at in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional cover of the demand by configurations of the sizes, with as few sequences as possible.

    Column generation: the configuration worth most at the current prices joins the basis until none is worth more than 1.
    """
    sizes_, n = np.array(sizes), len(sizes)
    basis = np.diag(capacity // sizes_).astype(float)
    x = np.array(demand, float) / np.diag(basis)
    for _ in range(60 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes_.min()), capacity + 1):
            fits = np.flatnonzero(sizes_ <= room)
            gains = worth[room - sizes_[fits]] + price[fits]
            k = int(gains.argmax())
            if gains[k] > worth[room - 1] + 1e-12:
                worth[room], last[room] = gains[k], fits[k]
            else:
                worth[room] = worth[room - 1]
        if worth[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
                continue
            column[last[room]] += 1
            room -= sizes_[last[room]]
        change = np.linalg.solve(basis, column)
        ratios = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratios.argmin())
        x = x - ratios[out] * change
        x[out] = ratios[out]
        basis[:, out] = column
    return [(basis[:, k].round().astype(int), float(x[k])) for k in range(n) if x[k] > 1e-9]


@dataclass
class Run:
    """`count` sequences of equal contents: parts (length, how many) in the order of their places."""

    count: int
    left: int
    parts: list[tuple[int, int]] = field(default_factory=list)

    def put(self, length: int, many: int, count: int) -> Run:
        return Run(count, self.left - length * many, [*self.parts, (length, many)])


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[Run]:
    """Runs of sequences that hold counts[length] pieces of every length, in as few sequences as were found.

    Rounding up leaves space that small pieces may be too few to fill. So sequences in which more than `slack` is left are also
    dissolved, for several values of slack, their pieces being packed like small ones; of equal outcomes the one that keeps most counts.
    """
    configured, rest = _configured(counts, capacity, large, groups)
    best: list[Run] = []
    for slack in (capacity, *(capacity >> k for k in range(3, 12)), 0, -1):
        kept = [r for r in configured if r.left <= slack]
        loose = dict(rest)
        for r in configured:
            for k, n in r.parts if r.left > slack else ():
                loose[k] = loose.get(k, 0) + n * r.count
        runs = _best_fit(kept, loose, capacity)
        if not best or sum(r.count for r in runs) < sum(r.count for r in best):
            best = runs
    return best


def _configured(counts: dict[int, int], capacity: int, large: float, groups: int) -> tuple[list[Run], dict[int, int]]:
    """Runs of the large lengths by configurations of rounded ones, and the counts of what is left."""
    left = {k: v for k, v in counts.items() if v > 0}
    runs = []
    if full := left.pop(capacity, 0):
        runs.append(Run(full, 0, [(capacity, 1)]))
    descending = [k for k in sorted(left, reverse=True) if k > large * capacity]
    total = sum(left[k] for k in descending)
    if total:
        # Equal cardinality: the i-th group ends at the piece total * (i + 1) / groups of the descending order.
        members: list[list[list[int]]] = []
        queue = [[k, left[k]] for k in descending]
        taken = 0
        for i in range(groups):
            want = total * (i + 1) // groups - taken
            group: list[list[int]] = []
            while want:
                k, n = queue[0]
                use = min(n, want)
                group.append([k, use])
                want -= use
                taken += use
                queue[0][1] -= use
                if not queue[0][1]:
                    queue.pop(0)
            if not group:
                continue
            if members and members[-1][0][0] == group[0][0]:  # one size
                for k, n in group:
                    if members[-1][-1][0] == k:
                        members[-1][-1][1] += n
                    else:
                        members[-1].append([k, n])
            else:
                members.append(group)
        found = configurations([g[0][0] for g in members], [sum(n for _, n in g) for g in members], capacity)
        for config, x in sorted(found, key=lambda f: -f[1]):
            times = int(x + 1e-6)
            while times > 0:
                holds = {g: sum(n for _, n in members[g]) for g in np.flatnonzero(config)}
                times = min([times, *(h // config[g] for g, h in holds.items())])
                if times <= 0:
                    break
                same = min([times, *(max(1, members[g][0][1] // config[g]) for g in holds)])
                parts: list[tuple[int, int]] = []
                for g in holds:
                    need = int(config[g])
                    while need:
                        k, n = members[g][0]
                        each = min(need, n // same)
                        parts.append((k, each))
                        left[k] -= each * same
                        members[g][0][1] -= each * same
                        need -= each
                        if not members[g][0][1]:
                            members[g].pop(0)
                runs.append(Run(int(same), capacity - sum(k * n for k, n in parts), parts))
                times -= same
    return runs, left


def _best_fit(runs: list[Run], left: dict[int, int], capacity: int) -> list[Run]:
    """runs with the left lengths added, largest first, each where least space is left for it."""
    by_left: dict[int, list[Run]] = {}
    for run in runs:
        by_left.setdefault(run.left, []).append(run)
    spaces = np.zeros(capacity + 1, bool)
    spaces[[s for s in by_left]] = True
    for k in sorted((k for k, n in left.items() if n), reverse=True):
        n = left[k]
        while n:
            fitting = np.flatnonzero(spaces[k:])
            if len(fitting):
                run = by_left[space := int(fitting[0]) + k].pop()
                spaces[space] = bool(by_left[space])
            else:
                run = Run(-(-n // (capacity // k)), capacity)
            each = min(run.left // k, n)
            whole = min(run.count, n // each)
            done = [run.put(k, each, whole)]
            if run.count > whole:
                done.append(Run(run.count - whole, run.left, run.parts))
            n -= each * whole
            for r in done:
                if r.parts:
                    by_left.setdefault(r.left, []).append(r)
                    spaces[r.left] = True
                else:
                    assert n < each * r.count or not n
    return [r for rs in by_left.values() for r in rs]


def places(runs: list[Run]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go by rank: rows (length, rank from, pieces side by side, first sequence, offset)."""
    rows, sequence, ranks = [], 0, {}
    for run in runs:
        offset = 0
        for length, each in run.parts:
            start = ranks.get(length, 0)
            rows.append((length, start, each, sequence, offset))
            ranks[length] = start + each * run.count
            offset += length * each
        sequence += run.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


def pack(sized: DataFrame, capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS, order: tuple[str, ...] = ("doc_id", "piece"), row: str | None = None) -> DataFrame:
    """sized, a stored table with a column length of 1..capacity, with sequence_id and offset added.

    order: columns that tell the pieces of a length apart, if only by a number of the row: they are ranked in buckets of their hash.
    row: a column of distinct numbers from 0; if there is one, pieces that fill a sequence take a negative number made of it, and need no rank.
    """
    counts = {int(r["length"]): int(r["n"]) for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths must be 1..{capacity}")
    if row is not None:
        whole = sized.where(F.col("length") == capacity).withColumns({"sequence_id": (-1 - F.col(row)).cast("long"), "offset": F.lit(0).cast("long")})
        counts.pop(capacity, None)
        return _ranked(sized.where(F.col("length") < capacity), counts, capacity, large, groups, order).unionByName(whole)
    return _ranked(sized, counts, capacity, large, groups, order)


def _ranked(sized: DataFrame, counts: dict[int, int], capacity: int, large: float, groups: int, order: tuple[str, ...]) -> DataFrame:
    where = places(pack_histogram(counts, capacity, large, groups))
    # At most `capacity` rows, and of the bases no more than LEAST_BUCKETS times that and one for each BUCKET_ROWS pieces.
    buckets = sized.sparkSession.createDataFrame([(k, max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))) for k, n in counts.items()], "length long, __buckets long")
    dealt = sized.join(F.broadcast(buckets), "length")
    bucketed = dealt.select(*sized.columns, F.pmod(F.xxhash64(*order), F.col("__buckets")).cast("int").alias("__bucket"))
    sums = bucketed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__bucket").orderBy(*order)
    ranked = bucketed.withColumn("__in", F.row_number().over(inside)).join(F.broadcast(base), ["length", "__bucket"])
    ranked = ranked.select(*sized.columns, (F.col("__base") + F.col("__in") - 1).alias("__rank"))
    at_length, at_rank = sized.columns.index("length"), len(sized.columns)

    def run(batches):
        step = np.int64(1) << np.int64(48)
        keys = where["length"] * step + where["rank"]
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False)
            rank = batch.column(at_rank).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            nth = rank - where["rank"][at]
            sequence = where["sequence"][at] + nth // where["each"][at]
            offset = where["offset"][at] + nth % where["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_rank], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:at_rank], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all documents."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(docs.sparkSession, "packing")
    sized = token_pieces(docs, tokenizer_path, capacity, with_ids=with_ids, id_col=id_col, text_col=text_col, cache_words=cache_words)
    # The number of a row, stored with it, spreads the rows of an id that is repeated without end.
    numbered = scratch.keep(sized.withColumn("__row", F.monotonically_increasing_id()))
    return pack(numbered, capacity, order=("doc_id", "piece", "__row"), row="__row").drop("__row")


def op10_linear_grouping(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_linear_grouping": op10_linear_grouping}
ORACLES: dict[str, str] = {}
