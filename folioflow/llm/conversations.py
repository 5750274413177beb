"""Repair of conversations by the cheapest edits, found on a bidirectional graph of tight arcs.

A conversation's rows and the four states of the allowed roles `(s?(ua)+)?` make a graph: keep, rerole and delete go on to
the next row, insert stays at the row. Minimum costs from the start and from the end together tell which arcs lie on a
cheapest way (tight arcs); from the set of nodes reached so far the least letter among their tight arcs is taken, step by step.

Rows are dealt out by conversation once. Repeated role and text are found there by a window that may spill, then each row
comes twice in order: first all rows of a conversation without their texts (two bytes each decide the edits), then again with
them, for the digest of the repaired conversation. So no task holds a conversation's texts, only some 70 bytes a row; the
audit and the digest of one conversation are one value each and are made by the one task that goes through its rows.

Cases: a null id, role or text stands as one space where it is compared or written, and a null id is a conversation of its own;
null turns come first; of equal turns the lesser role, then text, is first; an empty or other role can't be kept unless its
first letter is s, u or a; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Letters of the edits, and what they cost.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: States: nothing yet, after system, after user, after assistant; in the first and the last a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Where a role's initial leads from each state.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a rerole or an insert gives in a state, and the state after it.
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL_PAIRS = ("su", "ua", "au")
#: What a row is to the edits: its initial, whether it must go, whether it is cut off.
INITIALS = "sua-"
FAR = 1 << 60
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n): the drill's damage by the id and turn; n is 2 for a repeated row."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    key, role, text = F.concat_ws(":", *said[:2]), said[2], said[3]
    fault = F.crc32(key.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    kept = rows.where(fault != 0)
    return kept.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("n"))


def row_codes(roles: Iterable[str], blank: Iterable[bool], repeated: Iterable[bool], cut: Iterable[bool]) -> bytes:
    """A byte a row: its initial, 4 if it must be deleted, 8 if it is truncated."""
    return bytes((INITIALS.find(r[:1]) % 4 if r else 3) | (4 if b or d else 0) | (8 if c and not (b or d) else 0) for r, b, d, c in zip(roles, blank, repeated, cut))


def arcs(code: int | None, state: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits at a row (None: behind the last) in a state: letter, cost, rows gone on, state after."""
    yield INSERT, COSTS[INSERT], 0, GIVEN[state][1]
    if code is None:
        return
    yield DELETE, COSTS[DELETE], 1, state
    if code & 4:
        return
    more = TRUNCATED_COST if code & 8 else 0
    yield REROLE, COSTS[REROLE] + more, 1, GIVEN[state][1]
    to = STEPS.get((state, INITIALS[code & 3]))
    if to is not None:
        yield KEEP, COSTS[KEEP] + more, 1, to


#: The arcs of each code and state, least letter first.
ARCS = {code: [sorted(arcs(code, s)) for s in range(4)] for code in [*range(16), None]}


def distances(codes: bytes) -> tuple[array, array]:
    """Least costs from the start to each node (row, state), and from each node to an end; four numbers a row."""
    n = len(codes)
    there, back = array("q", [FAR]) * (4 * n + 4), array("q", [FAR]) * (4 * n + 4)
    there[START] = 0
    for i in range(n + 1):
        table = ARCS[codes[i] if i < n else None]
        # Inserts stay at the row and cost something: two rounds settle them, since a third would go round in a circle.
        for inserts in (True, True, False):
            for s in range(4):
                so_far = there[4 * i + s]
                if so_far < FAR:
                    for _, cost, on, to in table[s]:
                        if on != inserts and so_far + cost < there[4 * (i + on) + to]:
                            there[4 * (i + on) + to] = so_far + cost
    for s in ENDS:
        back[4 * n + s] = 0
    for i in range(n, -1, -1):
        table = ARCS[codes[i] if i < n else None]
        for inserts in (False, True, True):
            for s in range(4):
                for _, cost, on, to in table[s]:
                    if on != inserts and cost + back[4 * (i + on) + to] < back[4 * i + s]:
                        back[4 * i + s] = cost + back[4 * (i + on) + to]
    return there, back


def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost of a conversation's edits, and the least audit among those that cost no more."""
    there, back = distances(codes)
    n, total = len(codes), back[START]
    frontier, audit = {(0, START)}, []
    while not any(i == n and s in ENDS for i, s in frontier):
        least, following = "~", set()
        for i, s in frontier:
            for letter, cost, on, to in ARCS[codes[i] if i < n else None][s]:
                if letter <= least and there[4 * i + s] + cost + back[4 * (i + on) + to] == total:
                    if letter < least:
                        least, following = letter, set()
                    following.add((i + on, to))
        audit.append(least)
        frontier = following
    return total, "".join(audit)


class Repair:
    """One conversation after the other: add() its codes' rows, then each row with its text; result() ends it."""

    def __init__(self):
        self.codes, self.counts, self.last = bytearray(), [0, 0, 0, 0], None
        self.audit, self.cost, self.at, self.state = None, 0, 0, START
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, roles: list[str], blank: list[bool], repeated: list[bool], cut: list[bool]) -> None:
        self.codes += row_codes(roles, blank, repeated, cut)
        for r, b, d, c in zip(roles, blank, repeated, cut):
            for k, yes in enumerate((b, d and not b, c and not (b or d))):
                self.counts[k] += yes
            self.counts[3] += self.last is not None and self.last + r[:1] not in LEGAL_PAIRS
            self.last = r[:1]

    def solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = cheapest(bytes(self.codes))

    def _write(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.lines += 1

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            role, self.state = GIVEN[self.state]
            self._write(role, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        """The next row with its text, written as its edit says."""
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = STEPS[self.state, role[:1]]
            self._write(role, text)
        elif edit == REROLE:
            given, self.state = GIVEN[self.state]
            self._write(given, text)

    def result(self) -> tuple:
        self.solve()
        self._inserted()
        return (*self.counts, self.cost, self.audit, self.digest.hexdigest())


RESULT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (conversation, phase, place): phase 0 has the marks, phase 1 the texts."""
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    names = [c.split()[0] for c in RESULT.split(", ")]
    now, repair, done = None, None, []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        done.clear()
        return batch

    for batch in batches:
        c = batch.to_pydict()
        for conv, phase, role, text, blank, repeated, cut in zip(*(c[k] for k in ("conv_id", "phase", "role", "text", "blank", "repeated", "cut"))):
            if repair is None or conv != now:
                if repair is not None:
                    done.append((now, *repair.result()))
                now, repair = conv, Repair()
            if phase == 0:
                repair.add([role], [blank], [repeated], [cut])
            else:
                repair.solve()
                repair.row(role, text)
        if len(done) >= 256:
            yield out()
    if repair is not None:
        done.append((now, *repair.result()))
    if done:
        yield out()


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired conversation for each conversation of rows (conv_id, turn, role, text, n)."""
    rows = rows.repartition("conv_id").withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    last = F.substring(F.rtrim(F.translate("text", WHITE[1:], " " * (len(WHITE) - 1))), -1, 1)
    marked = rows.select("conv_id", "turn", "role", "text", (last == "").alias("blank"), seen.alias("repeated"), (~last.isin(".", "!", "?")).alias("cut"))
    phases = marked.withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))
    ordered = phases.sortWithinPartitions(F.asc_nulls_first("conv_id"), "phase", F.asc_nulls_first("turn"), "role", "text")
    lean = ordered.withColumn("text", F.when(F.col("phase") == 1, F.col("text")))
    return lean.mapInArrow(_repaired, RESULT)


def repair_after_damage(rows: DataFrame) -> DataFrame:
    """A row for every conversation of rows (conv_id, turn, role, text): its gaps and faults after the drill's damage, and its repair."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    after = damaged(rows)
    turns = after.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    every = rows.select("conv_id").distinct()
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    wide = every.join(turns, every.conv_id.eqNullSafe(turns.conv_id), "left").select(every.conv_id, gaps.alias("gaps"))
    fixed = repaired(after)
    return wide.join(fixed, wide.conv_id.eqNullSafe(fixed.conv_id), "left").select(
        wide.conv_id,
        "gaps",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op13_tight_arcs(spark, sf_dir: str) -> DataFrame:
    return repair_after_damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op13_tight_arcs": op13_tight_arcs}
ORACLES: dict[str, str] = {}
