"""Collocations by contiguous pattern growth: occurrences projected per frequent prefix, phrases grown to the right.

1. Words are counted per language; each frequent word gets a 64-bit id. Pairs of neighbours are counted by their numbers
   (or hashes), and those that can't be frequent are left out of what follows (a filter only: counts are taken from the ids).
   Texts are kept as the words' numbers, so that they are taken apart twice in all.
   Three words in a row are counted in hash buckets next, where both their pairs can be frequent: a bucket below the least
   count has no frequent phrase of three words. A bucket counts to the least count in a task, so it takes a byte or two.
2. Each occurrence of three words that can be frequent becomes a pointer: the ids of the up to five words that start there, as
   far as three words in a row can be frequent and the piece goes. Equal pointers are added up in their task and again when they
   meet. Phrases of two words have their counts from the pairs; where those are hashes, pairs become pointers, too.
3. Pointers are projected per prefix. A prefix of at most a ``SHARE``-th of all pointers (but for the bounds ``POINTERS``) is
   one task's work: they lie there in order, and phrases grow depth-first, each longer prefix being a run of its parent's
   run. Of a larger one only the sum is taken, by a partial aggregation, and its longer prefixes are tasks of their own;
   at five words a prefix is one pointer.
4. Each phrase is cut at each place and scored by its parts' counts in decimal arithmetic; the best of each language are
   ranked within salts and then over all.

Ids and pair hashes are broadcast up to ``FEW``; beyond, words and pairs aren't filtered and the counts are the same. Two
of 10^8 frequent words share an id with probability 3 in 10^4.

Defined cases: a null text is empty, a null language is ``und``; texts without words give nothing; repeated rows count each;
an empty table gives an empty result; other columns are ignored; a phrase with equal words counts overlaps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.neardup import _groups
from docloom.llm.sketch import mix
from docloom.session import stored

LONGEST = 5
LEAST = 100
SHARE = 256
POINTERS = (1_000, 1_000_000)
FEW = 4_000_000
CHUNK = 1_000_000  # words counted at once
CACHE = 400_000
HELD = 2_000_000  # rows of at most six numbers that a task adds up
BUCKETS = (16, 27)  # least and most bits of a bucket's number
FILL = 8  # words for each bucket
BLOCKS = 4096  # of buckets, each a row of a task
RANKED = 100_000  # phrases ranked by one task
NO_LANG = "und"

BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 255 if 10 <= c <= 13 or chr(c) in ".,;:!?" else c for c in range(256))
_COLUMNS = [f"w{i + 1}" for i in range(LONGEST)]


def tokens(raw: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with BREAK between its pieces and after the last."""
    return ((raw or b"").translate(_FOLD) + BREAK).replace(BREAK, b" \xff ").split()


def word_id(lang: str, word: bytes) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) or 1).astype(np.int64).item()


class _Ids(dict):
    """Word to number: its place among the frequent ids (from 1), 0 for BREAK and words that aren't frequent; its id where those aren't given."""

    def __init__(self, lang: str, frequent: np.ndarray | None):
        self.lang, self.frequent = lang, frequent
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
            self[BREAK] = 0
        x = word_id(self.lang, word) if word != BREAK else 0
        if x and self.frequent is not None:
            x = int(np.searchsorted(self.frequent, x)) + 1 if _among(np.array([x]), self.frequent)[0] else 0
        self[word] = x
        return x


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is in known (sorted)."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    return known[np.minimum(at, len(known) - 1)] == x


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            yield lang.as_py(), tokens(text.as_py())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of docs (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items() if w != BREAK]
            counts.clear()
            lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "f"])

        total = 0
        for lang, found in _texts(batches):
            counts.setdefault(lang, Counter()).update(found)
            total += len(found)
            if total >= CHUNK:
                yield out()
                total = 0
        yield out()

    return docs.mapInArrow(count, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbers(docs: DataFrame, frequent) -> DataFrame:
    """(ids): the numbers of the words of many texts in a row, 0 where a phrase can't go on, in four bytes each (eight without ``frequent``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent and frequent.value
        kind = np.int64 if known is None else np.int32
        ids: dict[str, _Ids] = {}
        held: list[bytes] = []
        total = 0
        for lang, found in _texts(batches):
            if lang not in ids:
                if sum(map(len, ids.values())) > CACHE:
                    ids.clear()
                ids[lang] = _Ids(lang, known)
            held.append(np.fromiter(map(ids[lang].__getitem__, found), kind, len(found)).tobytes())
            total += len(found)
            if total >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], ["ids"])
                held, total = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], ["ids"])

    return docs.mapInArrow(run, "ids binary")


def _runs(batches: Iterator[pa.RecordBatch], dense: bool) -> Iterator[np.ndarray]:
    for batch in batches:
        for raw in batch.column(0):
            yield np.frombuffer(raw.as_buffer(), np.int32 if dense else np.int64).astype(np.int64)


def _pairs(ids: np.ndarray, dense: bool) -> np.ndarray:
    """A number for each pair of neighbours: both numbers side by side, or a hash of their ids."""
    if dense:
        return ids[:-1] << 32 | ids[1:]
    u = ids.view(np.uint64)
    return mix(u[:-1] * np.uint64(0x9E3779B97F4A7C15) + u[1:]).view(np.int64)


def _added(parts: Iterator[tuple[list[np.ndarray], np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Distinct rows of a task's parts (columns, counts) and the sums of their counts; up to ``HELD`` rows are held."""

    def once(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        h = columns[0] if len(columns) == 1 else np.zeros(len(n), np.uint64)
        for c in columns if len(columns) > 1 else []:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.view(np.uint64))
        order = np.argsort(h)
        columns = [c[order] for c in columns]
        new = np.ones(len(n), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        first = np.flatnonzero(new)
        return [c[first] for c in columns], np.add.reduceat(n[order], first) if len(first) else n

    held: list[tuple[list[np.ndarray], np.ndarray]] = []
    together = lambda: ([np.concatenate(c) for c in zip(*(x for x, _ in held), strict=True)], np.concatenate([n for _, n in held]))
    for columns, n in parts:
        held.append(once(columns, n))
        if len(held) > 1 and sum(len(n) for _, n in held) > HELD:
            held = [once(*together())]
            if len(held[0][1]) > HELD // 2:
                yield held.pop()
    if held:
        yield once(*together())


def pair_counts(runs: DataFrame, dense: bool) -> DataFrame:
    """(h, n): how often each pair of neighbours with frequent words occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            for ids in _runs(batches, dense):
                both = (ids[:-1] != 0) & (ids[1:] != 0)
                yield [_pairs(ids, dense)[both]], np.ones(int(both.sum()), np.int64)

        for (h,), n in _added(found()):
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    return runs.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _go_on(ids: np.ndarray, dense: bool, pairs) -> np.ndarray:
    """Whether each word and the next can be a frequent pair."""
    both = (ids[:-1] != 0) & (ids[1:] != 0)
    if pairs is not None:
        some = np.flatnonzero(both)
        both[some] = _among(_pairs(ids, dense)[some], pairs.value)
    return both


def _buckets(ids: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of the three words from each place on."""
    h = np.zeros(len(at), np.uint64)
    for d in range(3):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[at + d].view(np.uint64))
    return (h >> np.uint64(64 - bits)).view(np.int64)


def full_buckets(runs: DataFrame, frequent, pairs, least: int, words: int):
    """(bits, one bit for each bucket): whether three words whose pairs can be frequent occur in it least times in all; broadcast."""
    bits = min(max((max(words, 1) // FILL).bit_length(), BUCKETS[0]), BUCKETS[1])
    size = (1 << bits) // BLOCKS
    kind = np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, kind)
        for ids in _runs(batches, frequent is not None):
            goes_on = _go_on(ids, frequent is not None, pairs)
            bucket, n = np.unique(_buckets(ids, np.flatnonzero(goes_on[:-1] & goes_on[1:]), bits), return_counts=True)
            table[bucket] = np.minimum(table[bucket].astype(np.int64) + n, least)
        rows = [(b, at) for b in range(BLOCKS) if len(at := np.flatnonzero(table[b * size : (b + 1) * size]))]
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            found = [[b for b, _ in part], [at.astype(np.uint16).tobytes() for _, at in part], [table[b * size + at].tobytes() for b, at in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "at", "n"])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros(size, np.int64)
        take = lambda: pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["block", "full"])
        for batch in batches:
            for b, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    if block is not None:
                        yield take()
                    block, sums = b, np.zeros(size, np.int64)
                sums[np.frombuffer(at, np.uint16)] += np.frombuffer(n, kind)
        if block is not None:
            yield take()

    counted = runs.mapInArrow(count, "block int, at binary, n binary").repartition("block").sortWithinPartitions("block")
    found = stored(counted.mapInArrow(full, "block int, full binary"), "buckets")
    flags = np.zeros((BLOCKS, size // 8), np.uint8)
    for row in found.collect():
        flags[row["block"]] = np.frombuffer(row["full"], np.uint8)
    return runs.sparkSession.sparkContext.broadcast((bits, flags.ravel()))


def pointers(runs: DataFrame, frequent, pairs, full) -> DataFrame:
    """(w1 .. w5, n): the ids of words from each occurrence of three words that can be frequent on, 0 after its end, and how often they occur so.

    Without ``frequent``, of a pair that can be frequent, too.
    """

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None if frequent is None else np.concatenate([[0], frequent.value])

        def found() -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            bits, flags = full.value
            for ids in _runs(batches, frequent is not None):
                ids = np.concatenate([ids, np.zeros(LONGEST, np.int64)])
                goes_on = _go_on(ids, frequent is not None, pairs)
                three = np.zeros(len(ids), bool)
                some = np.flatnonzero(goes_on[:-1] & goes_on[1:])
                bucket = _buckets(ids, some, bits)
                three[some] = flags[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8) & 1
                at = np.flatnonzero(goes_on if frequent is None else three)
                columns, live = [ids[at], ids[at + 1]], np.ones(len(at), bool)
                for d in range(2, LONGEST):
                    live = live & three[at + d - 2]
                    columns.append(np.where(live, ids[at + d], 0))
                yield columns, np.ones(len(at), np.int64)

        for columns, n in _added(found()):
            columns = [c if names is None else names[c] for c in columns]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(n)], [*_COLUMNS, "n"])

    words = ", ".join(f"{c} bigint" for c in _COLUMNS)
    return runs.mapInArrow(project, f"{words}, n bigint").groupBy(*_COLUMNS).agg(F.sum("n").alias("n"))


def grown(columns: list[np.ndarray], n: np.ndarray, depth: int, least: int, shortest: int = 2) -> Iterator[tuple[list[int], int]]:
    """Phrases of ``shortest`` words or more with their counts, depth-first, from sorted pointers that share their first depth words."""
    stack = [(0, len(n), depth)]
    while stack:
        lo, hi, d = stack.pop()
        if d >= shortest:
            yield [int(c[lo]) for c in columns[:d]], int(n[lo:hi].sum())
        if d == len(columns):
            continue
        word = columns[d][lo:hi]
        first = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        enough = (np.add.reduceat(n[lo:hi], first) >= least) & (word[first] != 0)
        ends = np.concatenate([first[1:], [hi - lo]])
        stack += [(lo + a, lo + b, d + 1) for a, b in zip(first[enough].tolist(), ends[enough].tolist(), strict=True)]


def _grow(rows: DataFrame, least: int, shortest: int) -> DataFrame:
    """(ws, a) from pointers with the ``depth`` of the prefix whose task they belong to; a task holds a prefix's pointers at a time."""
    keys = [_COLUMNS[0], *(f"k{d}" for d in range(2, LONGEST + 1))]
    keyed = rows.select(*_COLUMNS, "n", "depth", *(F.when(F.col("depth") >= d, F.col(_COLUMNS[d - 1])).otherwise(0).alias(f"k{d}") for d in range(2, LONGEST + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, a = [], []
        take = lambda: pa.RecordBatch.from_arrays([pa.array(ws, pa.list_(pa.int64())), pa.array(a, pa.int64())], ["ws", "a"])
        for t in _groups(batches, keys):
            n = t["n"].to_numpy()
            if n.sum() >= least:
                for phrase, count in grown([t[c].to_numpy() for c in _COLUMNS], n, t["depth"][0].as_py(), least, shortest):
                    ws.append(phrase)
                    a.append(count)
            if len(a) > 10_000:
                yield take()
                ws, a = [], []
        yield take()

    return keyed.repartition(*keys).sortWithinPartitions(*_COLUMNS).mapInArrow(run, "ws array<bigint>, a bigint")


def _few(df: DataFrame, limit: int = 500_000) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def frequent_phrases(rows: DataFrame, *, least: int = LEAST, limit: int | None = None, shortest: int = 2) -> DataFrame:
    """(ws, a): phrases of ``shortest`` to 5 words that occur least times at least, from pointers (stored). limit: pointers that one task takes of a prefix."""
    limit = limit or min(max(rows.count() // SHARE, POINTERS[0]), POINTERS[1])
    sizes, found = rows.withColumn("pointers", F.lit(1)), []
    depth = F.lit(LONGEST)
    for d in range(LONGEST - 1, 0, -1):  # sums of longer prefixes add up to those of shorter ones
        prefix = _COLUMNS[:d]
        sizes = stored(sizes.where(F.col(prefix[-1]) != 0).groupBy(*prefix).agg(F.sum("pointers").alias("pointers"), F.sum("n").alias("n")), "sizes")
        hot = stored(sizes.where(F.col("pointers") > limit).select(*prefix, "n", F.lit(True).alias(f"hot{d}")), "hot")
        if d >= shortest:
            found.append(hot.where(F.col("n") >= least).select(F.array(*prefix).alias("ws"), F.col("n").alias("a")))
        rows = rows.join(_few(hot.drop("n")), prefix, "left")
        depth = F.when(F.col(f"hot{d}").isNull(), d).otherwise(depth)
    # a pointer that is no longer than its hot prefixes is counted with them
    length = sum((F.col(c) != 0).cast("int") for c in _COLUMNS)
    out = _grow(rows.withColumn("depth", depth).where(F.col("depth") <= length), least, shortest)
    for more in found:
        out = out.unionByName(more)
    return out


def _broadcast(ids: DataFrame, few: int):
    """The values of a stored column of longs, sorted, on all executors; None if there are more than ``few``."""
    if ids.count() > few:
        return None
    values = np.sort(ids.toPandas().iloc[:, 0].to_numpy(np.int64))
    return ids.sparkSession.sparkContext.broadcast(values)


def counted(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, limit: int | None = None, few: int = FEW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, id, f), frequent phrases (ws, a), and all words' number for each language (lang, n), all stored."""
    language = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)) if lang in docs.columns else F.lit(NO_LANG)
    docs = docs.select(language.alias("lang"), F.col(text).cast("string").alias("text"))
    every = stored(word_counts(docs), "words")
    totals = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [word_id(x, w) for x, w in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], ["lang", "word", "f", "id"])

    words = stored(every.where(F.col("f") >= least).mapInArrow(named, "lang string, word string, f bigint, id bigint"), "frequent")
    frequent = _broadcast(words.select("id"), few)
    runs = stored(numbers(docs, frequent), "numbers", compression="zstd")
    two = stored(pair_counts(runs, frequent is not None).where(F.col("n") >= least), "pairs")
    pairs = _broadcast(two.select("h"), few)
    full = full_buckets(runs, frequent, pairs, least, totals.agg(F.sum("n")).first()[0] or 0)
    rows = stored(pointers(runs, frequent, pairs, full), "pointers")
    if frequent is None:
        return words, stored(frequent_phrases(rows, least=least, limit=limit), "phrases"), totals

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            ws = np.stack([frequent.value[(h >> 32) - 1], frequent.value[(h & 0xFFFFFFFF) - 1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(list(ws), pa.list_(pa.int64())), b.column(1)], ["ws", "a"])

    phrases = frequent_phrases(rows, least=least, limit=limit, shortest=3).unionByName(two.mapInArrow(spelled, "ws array<bigint>, a bigint"))
    return words, stored(phrases, "phrases"), totals


def _score(a: Column, n: Column, c: Column) -> Column:
    """floor(1000 a n / (l r)) by decimals of 38 digits; the quotient is 10 n at most."""
    big = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(15,0)")).cast("decimal(19,0)") * big(n), big(c.l) * big(c.r))


def collocations(docs: DataFrame, *, top: int = 2000, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases by score, count and phrase. how: see ``counted``."""
    words, phrases, totals = counted(docs, **how)
    counts = phrases.select("ws", F.col("a").alias("c")).unionByName(words.select(F.array("id").alias("ws"), F.col("f").alias("c")))
    # a longer phrase with the same count has the words between on its way: one more word is enough
    inner = phrases.where(F.size("ws") > 2).select(F.explode(F.array(F.expr("slice(ws, 1, size(ws) - 1)"), F.expr("slice(ws, 2, size(ws) - 1)"))).alias("ws"), "a").distinct()
    kept = stored(phrases.join(inner, ["ws", "a"], "left_anti"), "kept")
    cuts = kept.select("ws", "a", F.explode(F.expr("sequence(1, size(ws) - 1)")).alias("k"))
    cuts = cuts.select("ws", "a", "k", F.expr("slice(ws, 1, k)").alias("left"), F.expr("slice(ws, k + 1, size(ws) - k)").alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(counts.select(F.col("ws").alias(side), F.col("c").alias(side[0])), side)
    cut = cuts.groupBy("ws", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    # names
    spelled = kept.select("ws", F.posexplode("ws").alias("i", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ws").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x.word), " ").alias("phrase"))
    rows = cut.join(spelled, "ws").join(_few(totals), "lang")
    best = F.array_min(F.transform("cuts", lambda c: F.struct(_score(F.col("a"), F.col("n"), c).cast("long").alias("score"), c.k.alias("k"), c.l.alias("l"), c.r.alias("r"))))
    rows = stored(rows.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = max(1, -(-rows.count() // RANKED))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt", "rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
