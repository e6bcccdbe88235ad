"""Sum-of-squares online packing of documents into sequences of a fixed number of tokens.

A document's ids are cut into full sequences and a rest; the rest goes to the fill level for which the sum of the squared
counts of partially filled sequences grows least (Csirik et al.), kept in an array of counts by level.

Two rounds. Each task packs the documents of its partition as they come, so texts are never shuffled, and gives the
sequences that it fills. Rests in sequences that are still open at its end are stored and packed again by the same rule
together with those of other tasks, in tasks of some ``ROUND`` tokens: few rests make poor company, and there are a
few per cent of the tokens in them. What is open at a task's end is taken apart and placed again, longest first, as long
as that fills more than one in ``AGAIN`` of the open sequences. What no such turn closes is *settled*: the emptiest open
sequences are cut up to fill the fullest, so that padding per task of the second round stays under one sequence however
the lengths fall; the column settled tells such pieces. A task of the first round holds ``OPEN`` open sequences at most;
beyond that the emptiest half of them is handed on early.

A sequence's id is its task's number times 2**32 plus its number there, with 2**62 added in the second round; a task that is
run again gives the same rows, and the first round's are stored.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; keys may be null; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tokens import Encoder, default_vocabulary
from docloom.session import stored

SIZE = 2048
END = 1
OPEN = 8192
ROUND = 1 << 23  # tokens of a task of the second round
AGAIN = 64
SECOND = 1 << 62
FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Pieces are (key, start, ids, tokens of the document); closed sequences come out as (number, pieces)."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most = size, most
        self.count = np.zeros(size + 1, np.int64)  # open sequences by fill level; 0 and size stay 0
        self.at: list[list[list]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def _closed(self, pieces: list) -> tuple[int, list]:
        self.made += 1
        return self.made - 1, pieces

    def add(self, key, ids: bytes) -> Iterator[tuple[int, list]]:
        """A document: its full sequences, and the one its rest fills."""
        n, size = len(ids) // 4, self.size
        for a in range(0, n - n % size, size):
            yield self._closed([(key, a, ids[4 * a : 4 * (a + size)], n)])
        if n % size:
            a = n - n % size
            yield from self.place((key, a, ids[4 * a :], n))

    def place(self, piece: tuple) -> Iterator[tuple[int, list]]:
        """A piece shorter than a sequence, where the sum of squares grows least."""
        s, size = len(piece[2]) // 4, self.size
        # moving a sequence from level h to h + s changes the sum of squares by 2 * (count[h + s] - count[h]) + 2, but
        # by -2 * count[h] + 1 where it becomes full and by 2 * count[s] + 1 for a new one
        levels = np.flatnonzero(self.count[1 : size - s + 1]) + 1
        best, cost = 0, 2 * int(self.count[s]) + 1
        if len(levels):
            change = 2 * (self.count[levels + s] - self.count[levels]) + 2
            if levels[-1] == size - s:
                change[-1] = 1 - 2 * self.count[size - s]
            i = len(change) - 1 - int(np.argmin(change[::-1]))  # of equals the fullest
            if change[i] <= cost:
                best = int(levels[i])
        yield from self._put(best, piece, s)

    def release(self, keep: int = 0) -> Iterator[tuple]:
        """The pieces of the emptiest open sequences, until ``keep`` are open."""
        for level in range(1, self.size):
            while self.at[level] and self.open > keep:
                yield from self.at[level].pop()
                self.count[level] -= 1
                self.open -= 1

    def _put(self, level: int, piece: tuple, s: int) -> Iterator[tuple[int, list]]:
        if level:
            pieces = self.at[level].pop()
            self.count[level] -= 1
            self.open -= 1
            pieces.append(piece)
        else:
            pieces = [piece]
        if level + s == self.size:
            yield self._closed(pieces)
        else:
            self.at[level + s].append(pieces)
            self.count[level + s] += 1
            self.open += 1

    def again(self) -> Iterator[tuple[int, list]]:
        """What is open, taken apart and placed anew by the rule, longest first, for as many turns as that closes enough."""
        while self.open:
            before, closed = self.open, 0
            for pieces in self.release_all():
                for done in self.place(pieces):
                    closed += 1
                    yield done
            if closed * AGAIN <= before:
                return

    def release_all(self) -> list[tuple]:
        return sorted(self.release(), key=lambda piece: -len(piece[2]))

    def settle(self) -> Iterator[tuple[int, list]]:
        """Cuts up the emptiest open sequences to fill the fullest until none are open; the last is closed as it is."""
        queue = [(level, p) for level in range(1, self.size) for p in self.at[level]]
        low, high = 0, len(queue) - 1
        while high > low:
            level, pieces = queue[high]
            rest, gap = queue[low][1], self.size - level
            while gap and rest:
                key, a, ids, n = rest.pop()
                cut = max(0, len(ids) // 4 - gap)
                pieces.append((key, a + cut, ids[4 * cut :], n))
                gap -= len(ids) // 4 - cut
                if cut:
                    rest.append((key, a, ids[: 4 * cut], n))
            if gap:
                queue[high] = (self.size - gap, pieces)
                low += 1
            else:
                yield self._closed(pieces)
                high -= 1
                queue[low] = (sum(len(x[2]) // 4 for x in rest), rest)
                if not rest:
                    low += 1
        self.count[:] = 0
        self.at = [[] for _ in range(self.size + 1)]
        self.open = 0
        for _, pieces in queue[low : high + 1]:
            if pieces:
                yield self._closed(pieces)


def _rows(closed: Iterator[tuple[int, list]], first: int, with_ids: bool, settled: bool) -> Iterator[tuple]:
    for number, pieces in closed:
        offset = 0
        for k, a, ids, n in pieces:
            yield (k, a, len(ids) // 4, zlib.crc32(ids), n, first + number, offset, settled, ids if with_ids else None)
            offset += len(ids) // 4


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, size: int = SIZE, end: int = END, with_ids: bool = True) -> DataFrame:
    """A row for each piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, settled, and its ids (little-endian unsigned 32-bit)."""
    path = vocabulary or default_vocabulary()
    tail = np.array([end], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    names = [key, *FIELDS, "settled", "ids"]
    schema = f"`{key}` {kind}, " + ", ".join(f"{f} bigint" for f in FIELDS) + ", settled boolean, ids binary"

    def batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        types = [key_type, *[pa.int64()] * len(FIELDS), pa.bool_(), pa.binary()]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(names)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, mine = Encoder(path), Packer(size), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        # a rest that is handed on has no sequence
        left = lambda pieces: [(k, a, len(ids) // 4, None, n, None, None, None, ids) for k, a, ids, n in pieces]
        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for k, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows.extend(_rows(packer.add(k, encoder.encode(body.as_py()) + tail), mine, with_ids, False))
                if packer.open > packer.most:
                    rows.extend(left(packer.release(packer.most // 2)))
                if len(rows) > 4000:
                    yield batch(rows, key_type)
        if key_type is not None:
            rows.extend(left(packer.release()))
            yield batch(rows, key_type)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, mine = Packer(size), SECOND | TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for k, a, n, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.extend(_rows(packer.place((k, a, ids, n)), mine, with_ids, False))
                if len(rows) > 4000:
                    yield batch(rows, key_type)
        if key_type is not None:
            rows.extend(_rows(packer.again(), mine, with_ids, False))
            rows.extend(_rows(packer.settle(), mine, with_ids, True))
            yield batch(rows, key_type)

    done = stored(docs.select(F.col(key), F.col(text)).mapInArrow(first, schema), "packed", "zstd")  # ids are half zeros
    rests = done.where("sequence_id IS NULL")
    total = rests.agg(F.sum("length").alias("n")).first()["n"] or 0
    # dealt and ordered by what a rest is, so that a repeated task meets the same rests in the same order
    order = F.xxhash64(F.col(key), "start", "doc_tokens", "ids")
    dealt = rests.repartition(max(1, -(-total // ROUND)), order).sortWithinPartitions(order, key, "start").select(key, "start", "doc_tokens", "ids")
    both = done.where("sequence_id IS NOT NULL").unionByName(dealt.mapInArrow(second, schema))
    return both if with_ids else both.drop("ids")
