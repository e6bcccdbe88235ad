"""Near-duplicate groups of documents by SetSketch registers, bands, a joint likelihood and full verification.

1. Each text becomes its set of word shingles, a 128-bit fingerprint of it, and SetSketch registers. Each distinct set is
   a node with a number of its own and one representative text, so copies never meet in pairs.
2. Bands of registers are bucket keys. In each bucket every member is paired with the one that shares most buckets, in
   all, with others: a star, not all pairs.
3. Pairs whose joint likelihood rules the threshold out are dropped; the rest are decided on the full sets of both texts.
4. In buckets whose members aren't all in one component yet, components are merged into clusters by plausible pairs, in
   blocks of registers; in each cluster, plausible pairs across components are decided on full sets, in blocks of texts.
   A pair is left out once its ends are connected, and a block gives the edges that connect it, not the pairs it tried.
5. Components of the links, by stars again.

Pairs are only joined on nodes and bucket keys, in joins that the adaptive planner can split; a hot group costs work in
proportion to its members unless they are mutually close but not linked, and then pairs are tried in blocks, which are
dealt to tasks by their number. Texts are shuffled once to find those of nodes with a partner, and those then to their pairs.

Defined cases: a text without words (or null) has an empty set, links with nothing and is its own component; with fewer
words than a shingle has, the whole sequence is the one shingle; a row with a null id takes the component of the rows
with its set (null without any) and is kept; rows with equal ids are judged each by its own text: keys name rows in the
result only, links are between sets. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import sketch as S
from docloom.llm.components import components
from docloom.session import stored

SHINGLE = 5
PERCENT = 80
SLICE_WORDS = 300_000
BLOCK = 1000  # rows of registers
TEXTS = 250  # rows of texts
WORD_CACHE = 400_000


def words_of(raw: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes.lower and bytes.split do just that)."""
    return raw.lower().split() if raw else []


def shingles(raw: bytes | None, k: int) -> set[tuple[bytes, ...]]:
    w = words_of(raw)
    return {tuple(w)} if 0 < len(w) < k else set(zip(*(w[i:] for i in range(k)), strict=False))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _hashed(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes of one text. 64 bits: two shingles of a text of a million words meet once in 37 million texts."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = S.mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[j : n - size + 1 + j])
    return np.unique(h)


def signatures(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, th (hash of the text), n (set size), print (fingerprint of the set) and registers of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        look = cache.__getitem__

        def out(keys: list, hashes: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            first: dict[bytes, int] = {}
            for i, p in enumerate(prints):
                first.setdefault(p, i)
            chosen = list(first.values())  # equal sets are sketched once
            row = {p: i for i, p in enumerate(first)}
            own = np.repeat(np.arange(len(chosen)), [len(sets[i]) for i in chosen])
            flat = np.concatenate([sets[i] for i in chosen]) if chosen else np.empty(0, np.uint64)
            registers = S.sketch(flat, own, len(chosen))
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([registers[row[p]].tobytes() for p in prints], pa.binary())],
                ["key", "th", "n", "print", "registers"],
            )

        for batch in batches:
            keys, hashes, sets, total = [], [], [], 0
            for key, th, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                w = words_of(raw)
                sets.append(_hashed(np.fromiter(map(look, w), np.uint64, len(w)), k))
                keys.append(key)
                hashes.append(th)
                total += len(w)
                if total > SLICE_WORDS:
                    yield out(keys, hashes, sets)
                    keys, hashes, sets, total = [], [], [], 0
            yield out(keys, hashes, sets)

    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text)).mapInArrow(sign, "key bigint, th bigint, n bigint, print binary, registers binary")


def _compared(df: DataFrame, threshold: float) -> DataFrame:
    """df (u, v, n_u, n_v, r_u, r_v) cut to pairs for which the threshold is plausible."""

    @F.pandas_udf("boolean")
    def likely(n_u: pd.Series, n_v: pd.Series, r_u: pd.Series, r_v: pd.Series) -> pd.Series:
        if not len(n_u):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(r), np.uint8).reshape(len(r), -1) for r in (r_u, r_v))
        return pd.Series(S.plausible((a > b).sum(axis=1), (a < b).sum(axis=1), n_u.to_numpy(), n_v.to_numpy(), threshold, a.shape[1]))

    return df.where(likely("n_u", "n_v", "r_u", "r_v"))


def _verified(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union, on the full sets of their texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            u, v, good = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (a, b) in enumerate(zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True)):
                if u[i] != last:
                    last, last_set = u[i], shingles(a.as_py(), k)
                other = shingles(b.as_py(), k)
                both = len(last_set & other)
                if 100 * both >= percent * (len(last_set) + len(other) - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([u[i] for i in good], pa.int64()), pa.array([v[i] for i in good], pa.int64())], ["u", "v"])

    v, u = (bodies.select(F.col("id").alias(x), F.col("body").alias(y)) for x, y in ("vb", "ua"))
    return stored(pairs.join(v, "v").join(u, "u").select("u", "v", "a", "b").mapInArrow(check, "u bigint, v bigint"), "links")


def _bodies(nodes: DataFrame, docs: DataFrame, key: str, text: str, repeats: bool) -> DataFrame:
    """(id, body) of nodes (id, key, th). Rows that repeat both key and text are reduced before they are shuffled."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("body"))
    rows = rows.groupBy("key", "th").agg(F.first("body").alias("body")) if repeats else rows
    return stored(rows.join(nodes, ["key", "th"]).select("id", "body"), "bodies")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of rows that are sorted by them; a run may go over several batches."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if pending and key != last:
                yield pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(start, end - start))
            last = key
    if pending:
        yield pa.Table.from_batches(pending)


class _Side:
    """The rows of one block: ids, set sizes, registers, and texts where they are there."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.id, self.n = t["id"].to_numpy(), t["n"].to_numpy()
        self.registers = np.frombuffer(b"".join(t["registers"].to_pylist()), np.uint8).reshape(len(t), -1)
        self.body = t["body"].cast(pa.binary()).to_pylist() if "body" in t.schema.names else None


class _Meeting:
    """Two sides of a block and the components that their rows are in so far."""

    def __init__(self, t: pa.Table):
        i, j, side, comp = t["i"][0].as_py(), t["j"][0].as_py(), t["side"].to_numpy(), t["comp"].to_numpy()
        self.same = i == j
        of = lambda x: _Side(t.take(pa.array(np.flatnonzero(side == x))))
        self.left = of(i)
        self.right = self.left if self.same else of(j)
        self.of_left = comp[side == i].copy()
        self.of_right = self.of_left if self.same else comp[side == j].copy()

    def merge(self, x: int, y: int) -> None:
        for labels in (self.of_left, self.of_right):
            labels[labels == max(x, y)] = min(x, y)

    def candidates(self, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each row of left with the plausible rows of right that are in another component so far. The caller merges."""
        least, regs, sizes = S.least_equal(threshold), self.right.registers, self.right.n
        for at, (n, mine) in enumerate(zip(self.left.n, self.left.registers, strict=True)):
            first = at + 1 if self.same else 0
            other = first + np.flatnonzero(self.of_right[first:] != self.of_left[at])
            if len(other):
                rest = other[S.equal(mine, regs[other]) >= least]
                if len(rest):
                    theirs = regs[rest]
                    yield at, rest[S.plausible((mine > theirs).sum(axis=1), (mine < theirs).sum(axis=1), np.full(len(rest), n), sizes[rest], threshold, regs.shape[1])]


def _met(rows: DataFrame, group: str, meet: Callable[[_Meeting], list[tuple[int, int]]]) -> DataFrame:
    """What ``meet`` finds in each pair of blocks: u, v. Rows are sorted and groups are read off one after the other, as most are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        take = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
        for t in _groups(batches, [group, "i", "j"]):
            out += meet(_Meeting(t))
            if len(out) > 10_000:
                yield take()
                out.clear()
        yield take()

    return rows.sortWithinPartitions(group, "i", "j").mapInArrow(run, "u bigint, v bigint")


def _blocked(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows (with comp and size, the rows of the group) dealt to pairs of blocks: columns i, j, side. Rows of a component larger
    than a block are in blocks of their own, which don't meet each other; i = j is a block with itself. There are as many
    tasks as the rows need, so the longest doesn't grow with them."""
    big = F.col("own") > block
    number = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.ceil(n / block), F.lit(1))).cast("long")
    sizes = stored(rows.groupBy(group, "comp").agg(F.count("*").alias("own")), "sizes")
    rows = rows.join(sizes, [group, "comp"]).withColumn("large", F.when(big, F.col("comp"))).withColumn("side", F.when(big, F.xxhash64("comp", number(F.col("own")))).otherwise(number(F.col("size"))))
    rows = stored(rows, "blocked")
    blocks = stored(rows.groupBy(group, "large", "side").agg(F.count("*").alias("n")), "blocks")
    one, two = (blocks.select(group, F.col("large").alias(f"large_{x}"), F.col("side").alias(x), F.col("n").alias(f"n_{x}")) for x in "ij")
    meets = one.join(two, group).where("(large_i IS NULL AND large_j IS NULL AND i <= j) OR (large_i IS NULL AND large_j IS NOT NULL) OR large_i < large_j")
    meets = stored(meets.select(group, "i", "j", (F.col("n_i") + F.col("n_j")).alias("n")), "meets")
    sides = meets.select(group, "i", "j", F.col("i").alias("side")).unionByName(meets.where("i <> j").select(group, "i", "j", F.col("j").alias("side")))
    total = meets.agg(F.sum("n").alias("n")).first()["n"] or 0
    tasks = max(1, total // block, min(total // 50, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return rows.drop("own", "large", "size").join(sides, [group, "side"]).repartition(tasks, group, "i", "j")


def _clusters(members: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs (u, v) of components within each bucket: as many as connect what is plausibly connected, and no more."""

    def meet(m: _Meeting) -> list[tuple[int, int]]:
        out = []
        for at, rest in m.candidates(threshold):
            for r in rest.tolist():
                if m.of_left[at] != m.of_right[r]:
                    out.append((int(m.of_left[at]), int(m.of_right[r])))
                    m.merge(*out[-1])
        return out

    return _met(_blocked(members, "bucket", BLOCK), "bucket", meet).distinct()


def _linked(members: DataFrame, threshold: float, k: int, percent: int) -> DataFrame:
    """Verified links (u, v) across components within each cluster: as many as connect what is linked, and no more."""

    def meet(m: _Meeting) -> list[tuple[int, int]]:
        out = []
        numbers: dict[tuple, int] = {}
        sets = lambda side: [{numbers.setdefault(x, len(numbers)) for x in shingles(t, k)} for t in side.body]
        left = sets(m.left)
        right = left if m.same else sets(m.right)
        for at, rest in m.candidates(threshold):
            mine = left[at]
            for r in rest.tolist():
                if m.of_left[at] != m.of_right[r]:
                    both = len(mine & right[r])
                    if 100 * both >= percent * (len(mine) + len(right[r]) - both):
                        m.merge(int(m.of_left[at]), int(m.of_right[r]))
                        out.append((int(m.left.id[at]), int(m.right.id[r])))
        return out

    return _met(_blocked(members, "cluster", TEXTS), "cluster", meet)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """For each row: key, n_shingles, component_id (smallest key of its group), kept (whether the key is that one)."""
    threshold = percent / 100
    signed = stored(signatures(docs, key, text, shingle), "signatures")
    one = signed.where("n > 0 AND key IS NOT NULL").groupBy("print").agg(F.min(F.struct("key", "th", "n", "registers")).alias("x"))
    reps = stored(one.select(F.monotonically_increasing_id().alias("id"), "print", "x.key", "x.th", "x.n", "x.registers"), "representatives")

    bands = S.REGISTERS // S.ROWS
    keys = F.array(*(F.xxhash64(F.lit(j), F.substring("registers", j * S.ROWS + 1, S.ROWS)) for j in range(bands)))
    placed = reps.select("id", F.explode(keys).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(placed.join(stored(sizes, "sizes"), "bucket"), "shared")
    # the text that its copies were made from shares more buckets with each of them than they do with each other
    central = stored(shared.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    heads = shared.join(central, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("x"))
    members = stored(shared.join(stored(heads.select("bucket", (-F.col("x.minus")).alias("head")), "heads"), "bucket"), "members")

    narrow = reps.select("id", "n", "registers")
    # a head outweighs its members, so a pair comes in one order only
    pairs = stored(members.where("id <> head").select(F.col("head").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    for x in "vu":
        pairs = pairs.join(narrow.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")), x)
    pairs = stored(_compared(pairs, threshold).select("u", "v"), "plausible")
    paired = stored(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "paired")
    names = reps.select("id", "key", "th")
    repeats = bool(signed.where("n > 0 AND key IS NOT NULL").groupBy("key", "th").agg(F.count("*").alias("n")).where("n > 1").take(1))
    links = _verified(pairs, _bodies(names.join(paired, "id"), docs, key, text, repeats), shingle, percent)
    found = stored(components(links), "components")

    labelled = members.where("size > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("comp"))
    labelled = stored(labelled, "labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("bucket")
    rest = labelled.join(stored(open_, "open"), "bucket").join(narrow, "id")
    edges = stored(_clusters(rest, threshold), "plausible")
    if edges.take(1):
        clusters = stored(components(edges), "clusters").select(F.col("node").alias("comp"), F.col("component").alias("cluster"))
        nodes = stored(rest.select("id", "comp", "n", "registers").distinct().join(clusters, "comp"), "nodes")
        sizes = stored(nodes.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
        bodies = _bodies(names.join(nodes.select("id"), "id"), docs, key, text, repeats).join(nodes.join(sizes, "cluster"), "id")
        more = stored(_linked(bodies, threshold, shingle, percent), "links")
        if more.take(1):
            found = stored(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "components")

    # nodes to keys: a component is named by its smallest key
    rep = stored(reps.select("id", "print", "key").join(found.withColumnRenamed("node", "id"), "id", "left").select("print", "key", F.coalesce("component", "id").alias("component")), "members")
    least = stored(rep.groupBy("component").agg(F.min("key").alias("component_id")), "names")
    classes = stored(rep.join(least, "component").select("print", "component_id"), "classes")
    rows = signed.select("key", "n", "print").join(classes, "print", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    rows = rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
