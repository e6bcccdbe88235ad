"""Repair of conversation structure: a dynamic program over the turns that are retained.

The roles of a repaired conversation have to read ``(s?(ua)+)?`` by their initials. A row may be kept, given another role,
or deleted, and empty turns may be inserted; blank and repeated rows have to go. A state is the role of the last retained
row (or none yet). From a row's end, the cheapest way to finish is known for each state; deleting adds the row's cost to
all states alike (a running sum), and a pair of roles determines which turns are inserted between them. Read forwards,
the first letter in ASCII order that still leads to the least cost is taken, which gives the least audit.

A conversation of up to ``LONG`` rows is repaired at once, in a stream of sorted rows. A longer one is cut into blocks by
ranges of its order, so that it lies in as many tasks as it needs: each block gives the cost from each state to each (a
matrix of minimal sums, which blocks of any number multiply up to), then the way from each state, then its edits.

Defined cases: nulls in role and text are one space; a null conversation id is a conversation of its own; rows are read by
turn, nulls first, then role and text, so repeated rows stand side by side; an empty table gives no edits; other columns
are ignored. A role that is neither of the three has to be replaced or deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import stored

LONG = 50_000
ROWS = 5_000  # rows of whole conversations that are repaired at once
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"

START, SYSTEM, USER, ASSISTANT = range(4)
_TO = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that comes next
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 60
END = [0, 2 * INSERT, INSERT, 0]  # what finishing costs from each state
NOTHING = [_NEVER] * 4


def _kept(state: int, initial: str) -> int | None:
    """The state after a row that is kept, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    to = _TO[state]
    return to if initial == ("u" if to == USER else "a") else None


def _here(state: int, row: tuple[str, bool, bool], after: list[int]) -> list[tuple[str, int, int]]:
    """The ways to deal with a row in a state: letter, cost up to the end, next state. row: initial, must go, truncated."""
    initial, forced, cut = row
    ways = [("D", DELETE + after[state], state)]
    if not forced:
        extra = TRUNCATED if cut else 0
        kept = _kept(state, initial)
        if kept is not None:
            ways.append(("K", extra + after[kept], kept))
        ways.append(("R", REROLE + extra + after[_TO[state]], _TO[state]))
    return ways


def _before(row: tuple[str, bool, bool], after: list[int]) -> list[int]:
    """Least costs to the end before a row, from those after it."""
    own = [min(cost for _, cost, _ in _here(s, row, after)) for s in range(4)]
    # two inserted turns at most lead to each state that can be reached
    return [min(own[s], INSERT + own[_TO[s]], 2 * INSERT + own[_TO[_TO[s]]]) for s in range(4)]


def suffixes(rows: list[tuple[str, bool, bool]], end: list[int]) -> list[list[int]]:
    """Least costs to the end before each row, and ``end`` after the last."""
    out = [end]
    for row in reversed(rows):
        out.append(_before(row, out[-1]))
    return out[::-1]


def walk(rows: list[tuple[str, bool, bool]], costs: list[list[int]], state: int, whole: bool) -> tuple[list[tuple[str, int | None, int]], int]:
    """The least audit of least cost from a state: (letter, row or None, state after) and the last state. whole: the conversation ends here."""
    out: list[tuple[str, int | None, int]] = []
    for i, row in enumerate(rows):
        while True:
            left = costs[i][state]
            ways = [w for w in _here(state, row, costs[i + 1]) if w[1] == left]
            to = _TO[state]
            if INSERT + costs[i][to] == left:
                ways.append(("I", left, to))
            letter, _, nxt = min(ways)
            out.append((letter, None if letter == "I" else i, nxt))
            state = nxt
            if letter != "I":
                break
    while whole and state in (SYSTEM, USER):
        state = _TO[state]
        out.append(("I", None, state))
    return out, state


def faults(role: Column, text: Column) -> tuple[Column, Column]:
    """(blank, truncated): no character but white space; the last other one doesn't end a sentence."""
    rest = F.rtrim(text, F.lit(SPACE))
    return rest == "", ~F.substring(rest, -1, 1).isin(".", "!", "?")


_FACTS = ["conv", "block", "turn", "role", "text", "digest", "blank", "cut", "again"]


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with the facts that edits rest on. again: the role and text stand in an earlier block."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    blank, cut = faults(F.col("role"), F.col("text"))
    return rows.select("conv", F.lit(0).alias("block"), "turn", "role", "text", F.md5("text").alias("digest"), blank.alias("blank"), cut.alias("cut"), F.lit(False).alias("again"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _long(rows: DataFrame, sizes: DataFrame, long: int) -> DataFrame:
    """The rows of long conversations with block and again; a block holds about ``long`` rows."""
    part = rows.join(F.broadcast(sizes), _same(rows, sizes, ["conv"]), "left_semi")
    # a range ends between rows that differ in what is looked at here, so equal rows share one
    blocks = -(-sizes.agg(F.sum("n")).first()[0] // long)
    part = stored(part.repartitionByRange(blocks, "conv", "turn", "role", F.substring("text", 1, 64)).withColumn("block", F.spark_partition_id()), "ranges")
    first = part.groupBy("conv", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("x"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select("conv", "role", "digest", F.col("x.turn").alias("first"), F.lit(True).alias("more")), "repeats")
    joined = part.join(first, _same(part, first, ["conv", "role", "digest"]), "left")
    again = F.coalesce(first["more"], F.lit(False)) & ~part["turn"].eqNullSafe(first["first"])
    return stored(joined.select(*(again.alias(c) if c == "again" else part[c] for c in _FACTS)), "blocks")


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups (rows with equal keys, in a row) with where each group starts."""
    held: list[pa.RecordBatch] = []
    n, need = 0, least

    def cut(last: bool) -> tuple[pa.Table, list[int]]:
        nonlocal held, n
        t = pa.Table.from_batches(held).combine_chunks()
        named = list(zip(*(t[k].to_pylist() for k in keys), strict=True))
        starts = [i for i in range(len(named)) if not i or named[i] != named[i - 1]]
        end = len(t) if last else starts[-1]
        held, n = t.slice(end).to_batches(), len(t) - end
        return t.slice(0, end), [s for s in starts if s < end]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= need:
            t, starts = cut(False)
            need = max(least, 2 * n)  # a long group isn't put together at each batch
            if len(t):
                yield t, starts
    if held:
        yield cut(True)


def _facts(t: pa.Table) -> tuple[list[tuple[str, bool, bool]], list[str | None]]:
    """Of one block: what its rows' edits rest on, and their first faults."""
    seen: set[tuple[str, str]] = set()
    rows, first = [], []
    for role, digest, blank, cut, again in zip(*(t[c].to_pylist() for c in ("role", "digest", "blank", "cut", "again")), strict=True):
        repeated = again or (role, digest) in seen
        seen.add((role, digest))
        rows.append((role[:1], blank or repeated, cut))
        first.append("blank" if blank else "duplicate" if repeated else "truncated" if cut else None)
    return rows, first


_EDITS = ["conv", "block", "place", "edit", "turn", "was", "role", "text", "fault", "cost"]


def _schema(turns: DataFrame, conv: str) -> str:
    return f"conv {turns.schema[conv].dataType.simpleString()}, block int, place bigint, edit string, turn bigint, was string, role string, text string, fault string, cost bigint"


def _edited(t: pa.Table, starts: list[int], ends: list[int], ways: list[list[tuple[str, int | None, int]]], faulty: list[str | None]) -> pa.RecordBatch:
    """The edits of several blocks as rows."""
    take, owner, place, letter, role_of, cost, fault = [], [], [], [], [], [], []
    for start, way in zip(starts, ways, strict=True):
        for k, (edit, i, state) in enumerate(way):
            at = None if i is None else start + i
            take.append(at)
            owner.append(start)
            place.append(k)
            letter.append(edit)
            role_of.append(_NAMES[state] if edit in "IR" else None)
            found = None if at is None else faulty[at]
            fault.append(found)
            cost.append({"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if found == "truncated" and edit in "KR" else 0))
    at = pa.array(take, pa.int64())
    own = t.take(pa.array(owner, pa.int64()))
    rows = t.select(["turn", "role", "text"]).take(at)
    letters = np.array(letter, dtype=object)
    was = rows["role"].combine_chunks()
    role = pa.array([r if r is not None else w if e == "K" else None for r, w, e in zip(role_of, was.to_pylist(), letter, strict=True)], pa.string())
    text = pc.if_else(pa.array(letters == "I"), pa.scalar("", pa.string()), pc.if_else(pa.array(letters == "D"), pa.scalar(None, pa.string()), rows["text"].combine_chunks().cast(pa.string())))
    columns = [own["conv"], own["block"], pa.array(place, pa.int64()), pa.array(letter, pa.string()), rows["turn"], was, role, text, pa.array(fault, pa.string()), pa.array(cost, pa.int64())]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, _EDITS)


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "role", "text").select(_FACTS)


def _at_once(rows: DataFrame, schema: str) -> DataFrame:
    """The edits of conversations of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _chunks(batches, ["conv"], ROWS):
            ends, ways, faulty = [*starts[1:], len(t)], [], []
            for a, b in zip(starts, ends, strict=True):
                facts, first = _facts(t.slice(a, b - a))
                ways.append(walk(facts, suffixes(facts, END), START, True)[0])
                faulty += first
            yield _edited(t, starts, ends, ways, faulty)

    return _sorted(rows).mapInArrow(run, schema)


def _by_blocks(rows: DataFrame, schema: str) -> DataFrame:
    """The edits of conversations that lie in blocks (stored)."""
    conv = schema.split(",")[0]

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _chunks(batches, ["conv", "block"], 1):
            for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
                facts = _facts(t.slice(a, b - a))[0]
                ends = [[0 if s == e else _NEVER for s in range(4)] for e in range(4)]
                table = [suffixes(facts, end)[0] for end in ends]  # [to][from]
                yield pa.RecordBatch.from_arrays([t["conv"].slice(a, 1).combine_chunks(), t["block"].slice(a, 1).combine_chunks(), pa.array([[min(table[e][s], _NEVER) for s in range(4) for e in range(4)]])], ["conv", "block", "costs"])

    blocks = stored(_sorted(rows).mapInArrow(costs, f"{conv}, block int, costs array<bigint>"), "costs")

    def backwards(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        end, out = END, []
        for c in reversed(g["costs"].tolist()):
            out.append(end)
            end = [min(int(c[4 * s + e]) + end[e] for e in range(4)) for s in range(4)]
        return g.assign(ends=out[::-1], whole=np.arange(len(g)) == len(g) - 1)[["conv", "block", "ends", "whole"]]

    # a few numbers for each block: the blocks of a conversation are as many as it has times ``long`` rows
    named = blocks.groupBy("conv")
    ends = stored(named.applyInPandas(backwards, f"{conv}, block int, ends array<bigint>, whole boolean"), "ends")

    def with_ends(more: DataFrame, columns: list[str]) -> DataFrame:
        joined = rows.join(F.broadcast(more), _same(rows, more, ["conv", "block"]))
        return joined.select(*(rows[c] for c in _FACTS), *(more[c] for c in columns)).repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "role", "text")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _chunks(batches, ["conv", "block"], 1):
            for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
                facts = _facts(t.slice(a, b - a))[0]
                found = suffixes(facts, t["ends"][a].as_py())
                to = [walk(facts, found, s, False)[1] if found[0][s] < _NEVER else s for s in range(4)]
                yield pa.RecordBatch.from_arrays([t["conv"].slice(a, 1).combine_chunks(), t["block"].slice(a, 1).combine_chunks(), pa.array([to], pa.list_(pa.int64()))], ["conv", "block", "to"])

    left = stored(with_ends(ends, ["ends"]).mapInArrow(exits, f"{conv}, block int, to array<bigint>"), "exits")

    def forwards(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        state, out = START, []
        for to in g["to"]:
            out.append(state)
            state = int(to[state])
        return g.assign(state=out)[["conv", "block", "state"]]

    states = left.groupBy("conv").applyInPandas(forwards, f"{conv}, block int, state int")
    known = stored(ends.alias("e").join(states.alias("s"), F.expr("e.conv <=> s.conv AND e.block = s.block")).select("e.conv", "e.block", "ends", "whole", "state"), "states")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _chunks(batches, ["conv", "block"], 1):
            for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
                part = t.slice(a, b - a).combine_chunks()
                facts, first = _facts(part)
                found = suffixes(facts, part["ends"][0].as_py())
                way = walk(facts, found, part["state"][0].as_py(), part["whole"][0].as_py())[0]
                yield _edited(part, [0], [len(part)], [way], first)

    return with_ends(known, ["ends", "whole", "state"]).mapInArrow(edits, schema)


def repair(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG) -> DataFrame:
    """The edits that repair each conversation, a row each, in the order of (block, place).

    conv; block, place; edit: K(eep), R(erole), D(elete) or I(nsert); turn and was: the row's turn and role (null for I);
    role, text: the repaired turn (null for D); fault: the row's first fault (blank, duplicate, truncated or null); cost.
    """
    rows, schema = _rows(turns, conv, turn, role, text), _schema(turns, conv)
    sizes = stored(turns.groupBy(F.col(conv).alias("conv")).agg(F.count("*").alias("n")).where(F.col("n") > long), "long")
    if not sizes.take(1):
        return _at_once(rows, schema)
    rest = rows.join(F.broadcast(sizes), _same(rows, sizes, ["conv"]), "left_anti")  # fewer than one in LONG rows
    return _at_once(rest, schema).unionByName(_by_blocks(_long(rows, sizes, long), schema))


class _Sum:
    """What one conversation's edits add up to, row by row; but for the audit, of constant size."""

    def __init__(self):
        self.count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.low = self.high = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.audit, self.hash, self.lines, self.before = bytearray(), hashlib.sha256(), 0, None

    def add(self, edit: str, turn: int | None, was: str | None, role: str | None, text: str | None, fault: str | None, cost: int) -> None:
        self.audit += edit.encode()
        self.cost += cost
        if fault:
            self.count[fault] += 1
        if edit != "I":
            if turn is not None and turn != self.last:
                self.low, self.high, self.last, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
            self.illegal += self.before is not None and self.before + was[:1] not in ("su", "ua", "au")
            self.before = was[:1]
        if edit != "D":
            self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.count.values(), self.illegal, self.cost, self.audit.decode(), self.hash.hexdigest()


_SUMS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def summaries(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``'s edits: faults, gaps in its turns, adjacent roles that don't fit, cost, audit and a digest.

    A digest is taken of all of a conversation in order, so its rows pass through one task, one at a time.
    """
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Sum | None = None
        last: list = []
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows = [(*c, *s) for c, s in done]
            done.clear()
            values = list(zip(*rows, strict=True)) if rows else [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(values[0], kind), *(pa.array(v, k) for v, k in zip(values[1:], kinds, strict=True))], ["conv", *_SUMS])

        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("conv").type
            for conv, *rest in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if held is None or last != [conv]:
                    if held:
                        done.append((tuple(last), held.row()))
                    held, last = _Sum(), [conv]
                held.add(*rest)
            if done:
                yield out()
        if held:
            done.append((tuple(last), held.row()))
            yield out()

    conv = edits.schema["conv"].dataType.simpleString()
    rows = edits.repartition("conv").sortWithinPartitions("conv", "block", "place").select("conv", "edit", "turn", "was", "role", "text", "fault", "cost")
    return rows.mapInArrow(run, f"conv {conv}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string")


def damage(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults, by a hash of id and turn: of twenty rows one goes, one loses its text, one its ends of
    sentences, one is repeated, and one says ``user``. Nulls of role and text are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    new = F.when(kind == 1, "").when(kind == 2, F.translate(said(text), ".!?", "")).otherwise(said(text))
    rows = turns.select(F.col(conv), F.col(turn), F.when(kind == 4, "user").otherwise(said(role)).alias(role), new.alias(text), kind.alias("__kind"))
    return rows.where("__kind <> 0").withColumn("__n", F.explode(F.when(F.col("__kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("__kind", "__n")


def audited(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", long: int = LONG) -> DataFrame:
    """Each conversation of turns after ``damage``, with what its repair says."""
    names = {"conv": conv, "turn": turn, "role": role, "text": text}
    found = summaries(repair(damage(turns, **names), **names, long=long))
    every = turns.select(conv).distinct()
    none = [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    joined = every.join(found, every[conv].eqNullSafe(found["conv"]), "left")
    return joined.select(every[conv], *(F.coalesce(found[c], F.lit(x)).alias(c) for c, x in zip(_SUMS, none, strict=True)))
