"""Near-duplicate groups of documents by SimHash fingerprints: pigeonhole blocks, a join on blocks, verified distances.

1. Each text becomes a fingerprint of 64 bits: a bit is set if more than half of the hashes of its word shingles
   (repeats included) have it. Equal fingerprints become one node, so copies never meet in pairs.
2. The bits are cut into ``apart + 2`` blocks. Two fingerprints that differ in ``apart`` bits at most agree in two blocks at
   least, so each pair of blocks is a bucket key, and close pairs share a bucket.
3. A bucket of more than ``BLOCK`` nodes is split by the same argument: the bits outside its key are cut into ``apart + 1``
   blocks, and each block makes the key longer. This goes on until ``LEFT`` bits are outside the key; then a bucket can't
   hold more than ``BLOCK`` nodes, whatever the table's size. No pair is lost, and none is tried in a large bucket.
4. In each bucket, distances are computed and the edges of a spanning forest are given, not all close pairs.
5. Components of those links.

Buckets are joined with their sizes in equi-joins that the adaptive planner may split; a task holds one bucket at a time.

Defined cases: a text without words (or null) has fingerprint zero and is linked like any other; with fewer words than a
shingle has, the whole sequence is the one shingle; a row with a null id takes the component of its fingerprint (null
if no row there has an id) and is kept; repeated rows stay; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.session import stored

SHINGLE = 3
APART = 2
SEED = 42
BITS = 64
LEFT = 10
BLOCK = 2**LEFT
HASHES = 100_000  # hashes whose bits are counted at once
ROWS = 8192  # rows of buckets that are compared at once


def hashes(raw: bytes | None, k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of k words, joined by a space; words between ASCII white space, A-Z lower-cased."""
    words = raw.lower().split() if raw else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined, size = b" ".join(words), min(k, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, n - size + 1)


def _ones(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes; zero for an empty one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ones = np.zeros((len(sets), BITS), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat, first = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for at in range(0, len(flat), HASHES):
            bits = _ones(flat[at : at + HASHES])
            a, b = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, at + len(bits), "left")
            ones[full[a:b]] += np.add.reduceat(bits, np.maximum(first[a:b] - at, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, print): the fingerprint of each row's text as a signed long with the same bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sets, total = [], [], 0
            for raw in batch.column(1).cast(pa.binary()):
                sets.append(hashes(raw.as_py(), shingle))
                total += len(sets[-1])
                if total >= HASHES:
                    prints.append(fingerprints(sets))
                    sets, total = [], 0
            prints.append(fingerprints(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], ["key", "print"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(sign, f"key {kind}, print bigint")


def _cut(bits: list[int], n: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits, int), n)]


def masks(apart: int = APART, left: int = LEFT) -> list[list[int]]:
    """Bucket masks level by level, as sets of bits: those of a level's i-th mask's parts are the next level's ``apart + 1`` from ``(apart + 1) * i``."""
    kept = [sorted(a + b) for a, b in combinations(_cut(list(range(BITS)), apart + 2), 2)]
    levels = [kept]
    while max(BITS - len(k) for k in kept) > left:
        kept = [k + part for k in kept for part in _cut([b for b in range(BITS) if b not in set(k)], apart + 1)]
        levels.append(kept)
    signed = lambda k: int(np.uint64(sum(1 << b for b in k)).astype(np.int64))
    return [[signed(k) for k in level] for level in levels]


def forest(bucket: np.ndarray, prints: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) that connect all rows of a bucket with at most ``apart`` differing bits, by fewer edges than rows. Buckets are runs."""
    root = np.arange(len(prints))
    for d in range(1, len(prints)):
        at = np.flatnonzero(bucket[d:] == bucket[:-d])
        if not len(at):
            break
        at = at[(np.bitwise_count(prints[at] ^ prints[at + d]) <= apart) & (root[at] != root[at + d])]
        for i in at.tolist():
            a, b = i, i + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while len(at) and (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(prints)))
    return root[rest], rest


def _verified(rows: DataFrame, apart: int) -> DataFrame:
    """Links (u, v) of rows (mask, part, print), each bucket of which is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def links(last: bool) -> pa.RecordBatch:
            """Of what is held, but for the last bucket, which may go on."""
            nonlocal held, total
            mask, part, prints = (np.concatenate(c) for c in zip(*held, strict=True))
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            end = len(mask) if last else int(new[-1]) if len(new) else 0
            bucket = np.zeros(end, np.int64)
            bucket[new[new < end]] = 1
            i, j = forest(np.cumsum(bucket), prints[:end].view(np.uint64), apart)
            held, total = [(mask[end:], part[end:], prints[end:])], len(mask) - end
            return pa.RecordBatch.from_arrays([pa.array(prints[i]), pa.array(prints[j])], ["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(tuple(batch.column(c).slice(at, ROWS).to_numpy() for c in range(3)))
                total += len(held[-1][0])
                if total >= ROWS:
                    yield links(False)
        if held:
            yield links(True)

    return rows.repartition("mask", "part").sortWithinPartitions("mask", "part", "print").mapInArrow(run, "u bigint, v bigint")


def close_pairs(prints: DataFrame, *, apart: int = APART, block: int = BLOCK) -> DataFrame:
    """Links (u, v) that connect all distinct ``print`` that differ in ``apart`` bits at most, stored."""
    levels = masks(apart)
    spread = lambda level, first, n: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((first + i).alias("mask"), F.element_at(F.array(*map(F.lit, level)), (first + i + 1).cast("int")).bitwiseAND(F.col("print")).alias("part"))))
    rows = prints.select("print", spread(levels[0], F.lit(0), len(levels[0])).alias("x")).select("x.*", "print")
    links: DataFrame | None = None
    for depth in range(len(levels)):
        last = depth + 1 == len(levels)
        sizes = stored(rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        sized = rows.join(sizes, ["mask", "part"])
        found = stored(_verified((sized if last else sized.where(F.col("n") <= block)).select("mask", "part", "print"), apart), "links")
        links = found if links is None else links.unionByName(found)
        if last or not sizes.where(F.col("n") > block).take(1):
            break
        large = stored(sized.where(F.col("n") > block).select("mask", "print"), "large")
        rows = large.select("print", spread(levels[depth + 1], F.col("mask") * (apart + 1), apart + 1).alias("x")).select("x.*", "print")
    return links


def as_hex(c: Column) -> Column:
    """A long as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, apart: int = APART) -> DataFrame:
    """For each row: key, fingerprint, component_id (smallest key of its group), kept (whether the key is that one)."""
    signed = stored(with_fingerprints(docs, key=key, text=text, shingle=shingle), "fingerprints")
    nodes = stored(signed.groupBy("print").agg(F.min("key").alias("first")), "prints")
    found = stored(components(close_pairs(nodes.select("print"), apart=apart)), "components")
    named = stored(nodes.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("component", "print").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = stored(named.join(least, "component").select("print", "component_id"), "classes")
    rows = signed.join(classes, "print").select(F.col("key").alias(key), as_hex(F.col("print")).alias("fingerprint"), "component_id")
    return rows.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
