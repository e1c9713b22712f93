"""Conversation structure repair: the cheapest edits that give turns a legal order.

A repaired conversation's role initials read ``(s?(ua)+)?``: perhaps a system turn, then user and
assistant in turn.  Rows are kept, given another role, deleted, or empty rows are inserted.
The cheapest edits come from a dynamic programme over four states (start, after system,
after user, after assistant), as a secondary-sorted stream:

1. Rows are dealt by conversation and numbered by turn; each gets its fault (blank, duplicate of an earlier
   role and text, truncated).
2. Dealt by conversation again, last turn first, without texts: :func:`backpointers` carries the four states' costs
   from row to row and Arrow batch to batch.  What a row decides is one byte, two bits a state; every
   ``BLOCK`` rows the bytes leave the task as one row of a written table, so however long a
   conversation, a task holds one block.
3. First turn first, each block just before its rows: :func:`apply_moves` follows the bytes, which
   gives one edit per row and per insertion.  Of equally cheap edits the ones whose initials
   (Delete, Insert, Keep, Rerole) are least in ASCII order are taken, which the backward direction makes a
   choice per row.

A conversation is one stream, as its report's hash is; no step holds its rows at once.

Defined cases: null roles and texts are one space, so such a text is blank; a null conv_id is a
conversation of its own; rows of one turn are in order of role, then text (null turns first), repeated rows are
rows; conversations named in ``every`` without rows have no edits; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Table, text_key

#: Rows of a block of backpointers, one byte each.
BLOCK = 1 << 16
_WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state an inserted or reroled row leads to from each state, and the role that it has.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("user", "user", "assistant", "user")
#: What keeping a row of an initial leads to, by state.
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_LETTERS = "DIKR"
_FAULTS = (None, "blank", "duplicate", "truncated")
_INITIALS = ("s", "u", "a", "")
#: Adjacent initials of a legal order.
_LEGAL = ("su", "ua", "au")


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3  # of a truncated row that stays

    def __post_init__(self) -> None:
        if self.insert < 1 or min(self.rerole, self.delete, self.truncated) < 0:
            raise ValueError(f"an insertion must cost something, and nothing less than 0: {self}")


class Steps:
    """One row of the programme, remembered by the four costs (less their least) and the row's kind."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.known: dict[tuple, tuple[tuple[int, ...], int, int]] = {}
        i = costs.insert
        self.last = (0, 2 * i, i, 0)  # after the last row only insertions are left

    def before(self, after: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int, int]:
        """Costs before a row, what they grew by, and the row's byte.

        ``kind`` is 4 times the place in ``_INITIALS`` plus the place in ``_FAULTS``."""
        name = after, kind
        if name not in self.known:
            self.known[name] = self._before(after, _INITIALS[kind >> 2], _FAULTS[kind & 3])
        return self.known[name]

    def _before(self, after: tuple[int, ...], initial: str, fault: str | None) -> tuple[tuple[int, ...], int, int]:
        c = self.costs
        ways: list[dict[str, int]] = []
        for s in range(4):
            way = {"D": c.delete + after[s]}
            if fault not in ("blank", "duplicate"):
                stays = c.truncated if fault == "truncated" else 0
                if s in _KEEP.get(initial, {}):
                    way["K"] = stays + after[_KEEP[initial][s]]
                way["R"] = stays + c.rerole + after[_NEXT[s]]
            ways.append(way)
        plain = [min(w.values()) for w in ways]
        now = [0] * 4
        now[USER] = min(plain[USER], c.insert + plain[ASSISTANT])
        now[ASSISTANT] = min(plain[ASSISTANT], c.insert + plain[USER])
        for s in (START, SYSTEM):
            now[s] = min(plain[s], c.insert + now[USER])
        byte = 0
        for s in range(4):
            ways[s]["I"] = c.insert + now[_NEXT[s]]
            letter = min(x for x, cost in ways[s].items() if cost == now[s])
            byte |= _LETTERS.index(letter) << 2 * s
        least = min(now)
        return tuple(x - least for x in now), least, byte


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of conversations with seeded faults.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (which is still there, marked), 1 empties its text,
    2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.  Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return (rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                    (F.col("kind") == 0).alias("dropped"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
            .drop("copy"))


def place_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, pos (from 1, by turn) and kind (initial and first fault)."""
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    by_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    alike = Window.partitionBy("conv_id", "role", "key").orderBy("pos")  # dealt as by conversation: no further shuffle
    end = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = (F.when(end == "", 1).when(F.col("nth") > 1, 2)
             .when(~F.substring(end, -1, 1).isin(".", "!", "?"), 3).otherwise(0))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (given.withColumn("key", text_key(F.col("text")))
            .withColumn("pos", F.row_number().over(by_turn).cast("long"))
            .withColumn("nth", F.row_number().over(alike))
            .select("conv_id", "turn", "role", "text", "pos", (letter * 4 + fault).cast("int").alias("kind")))


def backpointers(batches: Iterator[pa.RecordBatch], costs: Costs, block: int) -> Iterator[pa.RecordBatch]:
    """conv_id, pos and moves (a byte a row from ``pos`` on) of each block, from rows (conv_id, pos, kind), last first."""
    steps, moves = Steps(costs), bytearray()
    state = steps.last
    current: object = ()  # of no conversation
    for batch in batches:
        ids, places, out = [], [], []
        for conv, pos, kind in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if conv != current:
                current, state = conv, steps.last
            state, _, byte = steps.before(state, kind)
            moves.append(byte)
            if (pos - 1) % block == 0:
                moves.reverse()
                ids.append(conv)
                places.append(pos)
                out.append(bytes(moves))
                moves.clear()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(out, pa.binary())], ["conv_id", "pos", "moves"])


EDITS = "conv_id long, place long, edit string, turn long, old_role string, role string, text string, fault string"
_EDIT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
_EDIT_NAMES = [c.split()[0] for c in EDITS.split(", ")]


def apply_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``EDITS`` from rows (conv_id, pos, moves, turn, role, text, kind), first row first, each block before its rows.

    A row at place 0 only names a conversation; one that has no others gives one row without an edit."""
    current: object = ()
    moves, first, state, place, out = b"", 1, START, 0, []

    def insert() -> None:
        nonlocal state, place
        place += 1
        out.append((current, place, "I", None, None, _ROLE[state], "", None))
        state = _NEXT[state]

    def finish() -> None:
        if current == ():
            return
        while state in (SYSTEM, USER):
            insert()
        if not place:
            out.append((current, 0, None, None, None, None, None, None))

    def flush() -> pa.RecordBatch:
        columns = zip(*out) if out else [()] * len(_EDIT_NAMES)
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _EDIT_TYPES)], _EDIT_NAMES)
        out.clear()
        return done

    for batch in batches:
        for conv, pos, block, turn, role, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != current:
                finish()
                current, state, place = conv, START, 0
            if not pos:
                continue
            if block is not None:
                moves, first = block, pos
                continue
            byte = moves[pos - first]
            while (letter := _LETTERS[byte >> 2 * state & 3]) == "I":
                insert()
            place += 1
            fault = _FAULTS[kind & 3]
            if letter == "D":
                out.append((conv, place, "D", turn, role, None, None, fault))
            elif letter == "K":
                state = _KEEP[role[0]][state]
                out.append((conv, place, "K", turn, role, role, text, fault))
            else:
                out.append((conv, place, "R", turn, role, _ROLE[state], text, fault))
                state = _NEXT[state]
        yield flush()
    finish()
    yield flush()


def repair(rows: DataFrame, every: DataFrame | None = None, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """The edits that repair conversations (conv_id, turn, role, text): one row per edit, in ``place`` order.

    ``edit`` is D, I, K or R; role and text are those of the repaired row (null if deleted), old_role and turn
    those of the row before (null if inserted), fault is the row's first.  Partitions hold whole conversations, in order.
    Each conv_id of ``every`` without rows gives one row with null ``edit`` and place 0."""
    placed = Table(place_rows(rows), "turns")
    backward = (placed.df.select("conv_id", "pos", "kind").repartition("conv_id")
                .sortWithinPartitions("conv_id", F.desc("pos")))
    blocks = Table(backward.mapInArrow(lambda b: backpointers(b, costs, block), "conv_id long, pos long, moves binary"), "moves")
    none = {"moves": "binary", "turn": "long", "role": "string", "text": "string", "kind": "int"}

    def padded(df: DataFrame, at: Column) -> DataFrame:
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), at.alias("pos"),
                         *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    parts = padded(placed.df, F.col("pos")).union(padded(blocks.df, F.col("pos")))
    if every is not None:
        parts = parts.union(padded(every.select("conv_id"), F.lit(0).cast("long")))
    # nulls come first, so a block (without a kind) is before the row of its place
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind").mapInArrow(apply_moves, EDITS)


REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          "audit string, repaired_sha256 string")


def report(edits: DataFrame, costs: Costs = Costs(), in_order: bool = False) -> DataFrame:
    """One row per conversation of ``edits``: turns missing between the first and the last, rows by first fault,
    adjacent rows with illegal initials, cost and initials of the edits, SHA-256 of the repaired ``role:text`` lines.

    ``in_order``: the edits are as :func:`repair` gives them, otherwise they are dealt and sorted first."""
    price = {"D": costs.delete, "I": costs.insert, "K": 0, "R": costs.rerole}
    names = [c.split()[0] for c in REPORT.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    class One:
        def __init__(self) -> None:
            self.faults = dict.fromkeys(_FAULTS, 0)
            self.cost = self.illegal = self.turns = 0
            self.audit, self.sha = bytearray(), hashlib.sha256()
            self.lines = 0
            self.initial = self.low = self.turn = None

        def add(self, edit: str, turn: int | None, old: str | None, role: str | None, text: str | None, fault: str | None) -> None:
            self.audit += edit.encode()
            self.cost += price[edit]
            if edit != "I":
                self.faults[fault] += 1
                self.illegal += self.initial is not None and self.initial + old[:1] not in _LEGAL
                self.initial = old[:1]
                if turn is not None and turn != self.turn:
                    self.low = turn if self.low is None else self.low
                    self.turn = turn
                    self.turns += 1
            if edit != "D":
                self.cost += costs.truncated if fault == "truncated" else 0
                self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1

        def row(self, conv: int | None) -> tuple:
            gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
            f = self.faults
            return (conv, gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = ()
        one, out = One(), []

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else [()] * len(names)
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            out.clear()
            return done

        for batch in batches:
            for conv, _, edit, turn, old, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current:
                    if current != ():
                        out.append(one.row(current))
                    current, one = conv, One()
                if edit is not None:
                    one.add(edit, turn, old, role, text, fault)
            yield flush()
        if current != ():
            out.append(one.row(current))
        yield flush()

    if not in_order:
        edits = edits.select(*_EDIT_NAMES).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return edits.mapInArrow(scan, REPORT)


def damaged_report(rows: DataFrame, **settings) -> DataFrame:
    """The report of :func:`repair` on :func:`damage`, for every conversation of ``rows``."""
    hurt = damage(rows)
    edits = repair(hurt.where(~F.col("dropped")), hurt.where("dropped"), **settings)
    return report(edits, settings.get("costs", Costs()), in_order=True)
