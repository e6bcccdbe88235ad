"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores, for blocks of documents, the postings (word positions) of every benchmark word.
``search`` reads the stored blocks and, for each window of a benchmark item, intersects the offset-adjusted
postings from the rarest word to the commonest; what is left are exact phrase matches. Proximity matches
(the rarest words of an item near each other, in any order) come from the same lists.

Scale: documents are read once and never shuffled. A block holds at most ``BLOCK_WORDS`` words or one document.
The benchmark is searched in slices of at most ``SLICE_WORDS`` words, each broadcast; more slices mean more passes
over the stored index, and their matches are merged by (block, document) in a shuffle of matches only. Terms are
64-bit hashes of words. A benchmark with more distinct words than ``VOCABULARY`` isn't broadcast to the
indexing pass; that pass then stores postings of all words.

Defined cases: null or wordless texts have no words and no match; an item without words has no window; an
item shorter than the window is one window; a null item id counts as the empty string; rows with equal item ids
count as one item; repeated and null document keys give a row each. Other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.arrays import running
from docloom.session import stored

WINDOW = 13
SLOP = 20
RAREST = 3
BLOCK_WORDS = 1_000_000
SLICE_WORDS = 500_000  # at most as many windows: 60 MB in each Python worker
VOCABULARY = 2_000_000
CANDIDATES = 2_000_000
GAP = 64  # between the documents of a block, so that no match spans two

#: bytes outside words become spaces, A-Z become a-z
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _binary(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


INDEX = "block string, keys array<{key}>, words array<int>, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame, vocabulary: set[bytes] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each block: its documents' keys and word counts, and the postings of the vocabulary (None: all words)."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(None if vocabulary is None else {w: term(w) for w in vocabulary})
    schema = INDEX.format(key=docs.schema[key].dataType.simpleString())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, part, number = known.value, TaskContext.get().partitionId(), 0
        keys, lengths, terms, places, start = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            t = np.concatenate(terms) if terms else np.empty(0, np.uint64)
            p = np.concatenate(places) if places else np.empty(0, np.int32)
            order = np.argsort(t, kind="stable")  # positions stay ascending within a term
            names, counts = np.unique(t[order], return_counts=True)
            columns = [
                pa.array([f"{part}-{number}"]), pa.array([keys], key_type), pa.array([lengths], pa.list_(pa.int32())),
                *(pa.array([x.tobytes()], pa.binary()) for x in (names, counts.astype(np.int32), p[order])),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "keys", "words", "terms", "counts", "positions"])

        key_type = None
        for batch in batches:
            key_type = pa.list_(batch.schema.field(0).type)
            for k, raw in zip(batch.column(0).to_pylist(), _binary(batch.column(1)), strict=True):
                found = words_of(raw)
                if keys and start + len(found) > BLOCK_WORDS:
                    yield block()
                    keys, lengths, terms, places, start, number = [], [], [], [], 0, number + 1
                if lookup is None:
                    ids = np.fromiter(map(term, found), np.uint64, len(found))
                    at = np.arange(len(found), dtype=np.int32)
                else:
                    get = lookup.get
                    hit = [(i, h) for i, h in enumerate(map(get, found)) if h is not None]
                    at = np.fromiter((i for i, _ in hit), np.int32, len(hit))
                    ids = np.fromiter((h for _, h in hit), np.uint64, len(hit))
                keys.append(k)
                lengths.append(len(found))
                terms.append(ids)
                places.append(at + np.int32(start))
                start += len(found) + GAP
        if keys:
            yield block()

    return docs.select(F.col(key), F.col(text)).mapInArrow(index, schema)


class Queries:
    """The windows of some items, each with its words from the rarest to the commonest."""

    def __init__(self, items: list[tuple[str, list[bytes]]], frequency: dict[int, int], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        owners: dict[tuple[int, ...], set[int]] = {}
        near: set[tuple[int, tuple[int, ...]]] = set()
        often = lambda t: (frequency.get(t, 0), t)
        for name, found in items:
            ids = [term(w) for w in found]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(number[name])
            if ids:
                rarest = sorted(set(found), key=lambda w: (frequency.get(term(w), 0), w))[:RAREST]
                near.add((number[name], tuple(map(term, rarest))))
        windows = [w for w in owners if all(t in frequency for t in w)]
        self.size = np.array([len(w) for w in windows], np.int64)
        self.terms = np.zeros((len(windows), window), np.uint64)
        self.offsets = np.zeros((len(windows), window), np.int16)
        for i, w in enumerate(windows):
            order = sorted(range(len(w)), key=lambda j: often(w[j]))
            self.terms[i, : len(w)] = [w[j] for j in order]
            self.offsets[i, : len(w)] = order
        self.owners = [np.array(sorted(owners[w]), np.int64) for w in windows]
        self.near = [(i, np.array(t, np.uint64)) for i, t in sorted(near) if all(x in frequency for x in t)]


class Block:
    """The postings of one block, as one ascending array of (term, position)."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.terms, self.positions = terms, positions.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.all = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | self.positions

    def local(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return at.astype(np.int64), self.terms[at] == terms if len(self.terms) else np.zeros(terms.shape, bool)

    def has(self, at: np.ndarray, position: np.ndarray, upto: np.ndarray | None = None) -> np.ndarray:
        """Whether term ``at`` has a posting at position, or from position to upto."""
        want = (at << 32) | np.maximum(position, 0)
        i = np.searchsorted(self.all, want)
        i[i == len(self.all)] = len(self.all) - 1
        return ((self.all[i] == want) & (position >= 0)) if upto is None else ((self.all[i] >= want) & (self.all[i] <= ((at << 32) | upto)))

    def phrases(self, q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, starts) of the exact matches."""
        if not len(self.terms) or not len(q.size):
            return
        at, there = self.local(q.terms)
        rows = np.flatnonzero((there | (np.arange(at.shape[1]) >= q.size[:, None])).all(axis=1))
        counts = self.first[at[rows, 0] + 1] - self.first[at[rows, 0]]
        edges, total = [0], 0
        for i, c in enumerate(counts):  # groups of windows with a bounded number of candidates
            if total and total + c > CANDIDATES:
                edges.append(i)
                total = 0
            total += c
        for lo, hi in zip(edges, [*edges[1:], len(rows)], strict=True):
            part, n = rows[lo:hi], counts[lo:hi]
            w = np.repeat(part, n)
            within = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[self.first[at[w, 0]] + within] - q.offsets[w, 0]
            for j in range(1, at.shape[1]):
                keep = (q.size[w] <= j) | self.has(at[w, j], start + q.offsets[w, j])
                w, start = w[keep], start[keep]
            yield w, start

    def nearby(self, q: Queries) -> Iterator[tuple[int, np.ndarray]]:
        """(item, positions of its rarest word with the next rarest within SLOP words)."""
        for item, terms in q.near:
            at, there = self.local(terms)
            if not there.all():
                continue
            p = self.positions[self.first[at[0]] : self.first[at[0] + 1]]
            for t in at[1:]:
                p = p[self.has(np.full(len(p), t), p - SLOP, p + SLOP)]
            if len(p):
                yield item, p


def search(index: DataFrame, q: Queries) -> DataFrame:
    """A row for each document of the index: its word count, matched word positions as (start, end) runs, and the ids of the items matched exactly and by proximity."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(q)
    key = index.schema["keys"].dataType.elementType.simpleString()
    schema = f"block string, place int, key {key}, n_words bigint, runs array<int>, items array<string>, near array<string>"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            for row in range(batch.num_rows):
                one = {n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)}
                lengths = np.array(one["words"], np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths + GAP)])[:-1]
                postings = Block(*(np.frombuffer(one[n], t) for n, t in (("terms", np.uint64), ("counts", np.int32), ("positions", np.int32))))
                covered = np.zeros(int((lengths + GAP).sum()) + 1, np.int32)
                items: dict[int, set[int]] = {}
                near: dict[int, set[int]] = {}
                for w, s in postings.phrases(q):
                    np.add.at(covered, s, 1)
                    np.add.at(covered, s + q.size[w], -1)
                    doc = np.searchsorted(starts, s, side="right") - 1
                    for d, x in np.unique(np.stack([doc, w]), axis=1).T.tolist():
                        items.setdefault(d, set()).update(q.owners[x].tolist())
                for item, p in postings.nearby(q):
                    for d in np.unique(np.searchsorted(starts, p, side="right") - 1).tolist():
                        near.setdefault(d, set()).add(item)
                edge = np.flatnonzero(np.diff((np.cumsum(covered) > 0).astype(np.int8), prepend=0, append=0))
                runs: dict[int, list[int]] = {}
                for d, a, b in zip((np.searchsorted(starts, edge[::2], side="right") - 1).tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    runs.setdefault(d, []).extend((a - int(starts[d]), b - int(starts[d])))
                n = len(lengths)
                names = lambda found: pa.array([sorted(q.names[i] for i in found.get(d, ())) for d in range(n)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["block"]] * n), pa.array(range(n), pa.int32()), pa.array(one["keys"], key_type), pa.array(lengths), pa.array([runs.get(d, []) for d in range(n)], pa.list_(pa.int32())), names(items), names(near)],
                    ["block", "place", "key", "n_words", "runs", "items", "near"],
                )

    return index.mapInArrow(match, schema)


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The matches of several slices: runs are united, items gathered."""
    df = parts[0]
    for more in parts[1:]:
        df = df.unionByName(more)
    df = df.groupBy("block", "place", "key", "n_words").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), lambda i: F.struct(F.get("runs", i).alias("a"), F.get("runs", i + 1).alias("b"))))
    df = df.withColumn("__pairs", F.when(F.size("runs") > 0, pairs).otherwise(F.array().cast("array<struct<a:int,b:int>>")))
    df = running(df, {"__reach": F.transform("__pairs", lambda p: p.b)}, lambda x, y: F.greatest(x, y))
    # a run begins where all before it have ended; it goes on to where the next one's predecessors have ended
    first = F.zip_with("__pairs", F.slice("__reach", 1, F.size("__pairs")), lambda p, r: F.struct(p.a.alias("a"), r.alias("after")))
    df = df.withColumn("__first", F.filter(first, lambda x, i: (i == 0) | (x.a > x.after)))
    ends = F.concat(F.slice(F.transform("__first", lambda x: x.after), 2, F.greatest(F.size("__first") - 1, F.lit(0))), F.slice("__reach", -1, 1))
    joined = F.flatten(F.zip_with("__first", ends, lambda x, e: F.array(x.a, e)))
    return df.withColumn("runs", F.when(F.size("__pairs") > 0, joined).otherwise(F.col("runs"))).drop("__pairs", "__reach", "__first")


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """For each document: key, n_words, runs (flat start, end pairs of matched words), n_hit, items, near (item ids as strings)."""
    raw = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("name"), F.encode(F.coalesce(F.col(item_text).cast("string"), F.lit("")), "UTF-8").alias("body"))
    size = raw.agg(F.sum(F.length("body")).alias("bytes")).first()["bytes"] or 0
    n = max(1, -(-size // (4 * slice_words)))  # a word and its gap take some four bytes or more on average
    seen: set[bytes] | None = set()
    slices = [raw] if n == 1 else [raw.where(F.pmod(F.xxhash64("name", "body"), F.lit(n)) == i) for i in range(n)]
    read = lambda part: [(r["name"], words_of(bytes(r["body"]))) for r in part.toLocalIterator()]
    for part in slices:
        for _, found in read(part):
            seen.update(found)
        if len(seen) > vocabulary:
            seen = None
            break
    index = stored(build_index(docs, seen, key, text), "postings")
    results = []
    for part in slices:
        items = read(part)
        asked = {term(w) for _, found in items for w in found}
        q = Queries(items, _frequency(index, asked), window)
        results.append(search(index, q))
    found = results[0] if len(results) == 1 else _merged(results)
    count = F.aggregate(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), F.lit(0), lambda n, i: n + F.get("runs", i + 1) - F.get("runs", i))
    return found.select(F.col("key").alias(key), "n_words", "runs", F.when(F.size("runs") == 0, F.lit(0)).otherwise(count).cast("long").alias("n_hit"), "items", "near")


def _frequency(index: DataFrame, asked: set[int]) -> dict[int, int]:
    """Postings in the whole index of each term asked for that has any; as many as the slice has words at most."""
    shared = index.sparkSession.sparkContext.broadcast(np.array(sorted(asked), np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = shared.value
        total = np.zeros(len(want), np.int64)
        for batch in batches:
            for raw, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = np.frombuffer(raw, np.uint64)
                if len(want) and len(terms):
                    i = np.searchsorted(want, terms)
                    i[i == len(want)] = 0
                    mine = want[i] == terms
                    np.add.at(total, i[mine], np.frombuffer(counts, np.int32)[mine])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(want[some].view(np.int64)), pa.array(total[some])], ["term", "n"])

    rows = index.select("terms", "counts").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"] % 2**64: r["n"] for r in rows.toLocalIterator()}
