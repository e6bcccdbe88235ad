"""Vector, term and hybrid search over tables, exact, for many queries at once.

Queries are a table like the rows are. Scores are matrix products of Arrow batches of rows with the queries, and each batch
gives its k best rows for each query, so that what is shuffled to find the best of all is a small part of the rows,
whatever their number. The queries are broadcast while they are few and small (``FEW`` and ``BYTES``, checked); more of
them are broadcast in slices, past which the stored rows stream, and a task gives k rows for each query, whatever its batches.

Rows and queries without a vector or id are left out. Scores are rounded to 12 places, so that equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.functions.text import count_of
from docloom.session import stored

FEW = 10_000  # queries that are broadcast
BYTES = 64_000_000  # and what their vectors may take
BLOCK = 8192  # rows of a block
MANY = 256  # queries for which it pays to look for equal vectors
PAIRS = 4_000_000  # pairs of a task, where a result has a row for each: some 130 MB of Parquet with four scores


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank", offset: int = 0) -> DataFrame:
    """The first k rows of each group after an offset, with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name).between(offset + 1, offset + k))


def scores(metric: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The score of each row (first axis) with each query."""
    if metric in V.SIMILARITIES:
        out = rows @ queries.T
        if metric == "cosine":
            with np.errstate(all="ignore"):
                out = out / np.sqrt((rows * rows).sum(axis=1)[:, None] * (queries * queries).sum(axis=1)[None, :])
            out[~np.isfinite(out)] = 0.0  # a vector of zeros, or not a number
        return np.round(out, 12)
    each = {
        "l2": lambda d: np.sqrt((d * d).sum(axis=1)),
        "l1": lambda d: np.abs(d).sum(axis=1),
        "linf": lambda d: np.abs(d).max(axis=1),
        "hamming": lambda d: (d != 0).mean(axis=1),
    }[metric]
    return np.round(np.stack([each(rows - q) for q in queries], axis=1), 12) if len(queries) else np.empty((len(rows), 0))


def matrix(vectors: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Vectors of one width as rows of a matrix; another width is an error."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    found = set(pc.unique(pc.list_value_length(vectors)).to_pylist()) | ({width} if width is not None else set())
    if len(found) > 1:
        raise ValueError(f"vector widths differ: {sorted(map(str, found))}")
    return np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(len(vectors), next(iter(found), 0))


def _best(score: np.ndarray, order: np.ndarray, k: int, best_high: bool, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) of the k best rows of each query; ties by order."""
    value = -score if best_high else score
    if keep is not None:
        value = np.where(keep, value, np.inf)
    limit = np.partition(value, k - 1, axis=0)[k - 1] if k < len(value) else np.full(value.shape[1], np.inf)
    at, of = [], []
    for q in range(value.shape[1]):
        i = np.flatnonzero((value[:, q] <= limit[q]) & np.isfinite(value[:, q]))
        at.append(i[np.lexsort((order[i], value[i, q]))[:k]])
        of.append(np.full(len(at[-1]), q))
    return (np.concatenate(at), np.concatenate(of)) if at else (np.empty(0, int), np.empty(0, int))


def _scored(rows: pa.Array, vectors: np.ndarray, ids: pa.Array, asked: np.ndarray, k: int, metric: str, threshold: float | None, strict: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The k best of some rows for each query, some queries at a time."""
    high = metric in V.SIMILARITIES
    order = pc.rank(rows, tiebreaker="dense").to_numpy()
    for start in range(0, len(asked), 256):
        score = scores(metric, vectors, asked[start : start + 256])
        keep = None
        if threshold is not None:
            keep = (score > threshold if strict else score >= threshold) if high else (score < threshold if strict else score <= threshold)
        at, of = _best(score, order, k, high, keep)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of + start)), rows.take(pa.array(at)), pa.array(score[at, of], pa.float64())], names)


def few_vectors(df: DataFrame, key: str, vector: str) -> tuple[pa.Array, np.ndarray] | None:
    """Ids and vectors of a small table on the driver; None if it isn't small."""
    df = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    size = df.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("x")).first()
    if size["n"] > FEW or 8 * (size["x"] or 0) > BYTES:
        return None
    t = df.toArrow().combine_chunks()
    return pa.concat_arrays(t["id"].chunks) if t["id"].chunks else pa.array([], t.schema.field("id").type), matrix(t["v"])


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 4, row_id: str = "id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_embedding", metric: str = "cosine", where: Column | None = None, threshold: float | None = None, strict: bool = False, offset: int = 0) -> DataFrame:
    """For each query its k nearest rows: query_id, row_id, score, rank; ties by row id.

    where: a predicate on rows, applied before scoring (and pushed into the scan). threshold: the least score kept (more than
    it, if strict; for distances the most).
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    rows = (rows if where is None else rows.where(where)).select(F.col(row_id).alias("r"), F.col(vector).cast("array<double>").alias("v")).where("r IS NOT NULL AND v IS NOT NULL")
    names = [query_id, row_id, "score"]
    kinds = [queries.schema[query_id].dataType.simpleString(), rows.schema["r"].dataType.simpleString(), "double"]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True))
    most, few = k + offset, few_vectors(queries, query_id, query_vector)
    if few is None or len(few[1]) > MANY:
        rows = _first_of_equals(rows, most)
    if few is not None:
        shared = rows.sparkSession.sparkContext.broadcast(few)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            for b in batches:
                if len(b) and len(asked):
                    yield from _scored(b.column(0), matrix(b.column(1), asked.shape[1]), ids, asked, most, metric, threshold, strict, names)

        found = rows.mapInArrow(near, schema)
    else:
        rows = stored(rows.select("r", "v"), "vectors")
        found = reduce(DataFrame.unionByName, (_streamed(rows, part, most, metric, threshold, strict, names, schema) for part in slices(queries, query_id, query_vector)))
    best = F.desc("score") if metric in V.SIMILARITIES else F.asc("score")
    return ranked(found, [query_id], [best, F.col(row_id)], k, offset=offset)


def _first_of_equals(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors the k of least id, as only those can be hits; all rows where most vectors are distinct."""
    n = rows.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("distinct")).first()
    if 2 * k * n["distinct"] > n["n"]:
        return rows
    return stored(ranked(rows, ["v"], [F.col("r")], k).select("r", "v"), "distinct")


def _streamed(rows: DataFrame, part: tuple[pa.Array, np.ndarray], k: int, metric: str, threshold: float | None, strict: bool, names: list[str], schema: str) -> DataFrame:
    """The k best rows of each task for a slice of queries: batches stream past the queries, and a task holds k rows of each, whose worst is its next limit."""
    shared, high = rows.sparkSession.sparkContext.broadcast(part), metric in V.SIMILARITIES

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        limit = np.full(len(asked), np.inf)
        of, value, got = np.empty(0, np.int64), np.empty(0), None
        for b in batches:
            if not len(b) or not len(asked):
                continue
            mine, found = matrix(b.column(1), asked.shape[1]), [(of, value, np.empty(0, np.int64))]
            for start in range(0, len(asked), 256):
                score = scores(metric, mine, asked[start : start + 256])
                each = -score if high else score
                if threshold is not None:
                    least = -threshold if high else threshold
                    each = np.where(each < least if strict else each <= least, each, np.inf)
                most = limit[start : start + 256].copy()
                new = np.flatnonzero(np.isinf(most))
                if len(new) and k < len(each):
                    most[new] = np.partition(each[:, new], k - 1, axis=0)[k - 1]
                at, q = np.nonzero((each <= most) & np.isfinite(each))
                found.append((q + start, each[at, q], at))
            of, value, at = (np.concatenate(x) for x in zip(*found, strict=True))
            rest = b.column(0).take(pa.array(at))
            got = rest if got is None else pa.concat_arrays([got, rest])
            order = np.lexsort((pc.rank(got, tiebreaker="dense").to_numpy(), value, of))
            starts = np.searchsorted(of[order], np.arange(len(asked)))
            order = order[np.arange(len(order)) - starts[of[order]] < k]
            of, value, got = of[order], value[order], got.take(pa.array(order))
            last = np.full(len(asked), -np.inf)
            np.maximum.at(last, of, value)
            limit = np.where(np.bincount(of, minlength=len(asked)) >= k, last, np.inf)
        if got is not None:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), got, pa.array(-value if high else value)], names)

    return rows.mapInArrow(near, schema)


def _classes(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame, bool]:
    """Of ids and vectors (id, v): themselves with a key of the vector, a row for each vector (its first id and how many have it), both stored; whether a quarter are copies."""
    each = stored(df.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")), name)
    firsts = stored(each.groupBy("a", "b").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("*").alias("n")), f"{name}-distinct")
    return each, firsts, 4 * firsts.count() <= 3 * each.count()


def top_k_by_classes(rows: DataFrame, queries: DataFrame, *, k: int = 4, row_id: str = "id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_embedding", where: Column | None = None) -> DataFrame:
    """top_k for tables in which vectors may be copies: where a quarter or more are, each pair of distinct vectors is scored once, and the rows
    of the k nearest vectors are ranked at the end (the first rows of vectors before a hit's are hits, too). Row ids have to be unique."""
    mine, rows_once, many = _classes((rows if where is None else rows.where(where)).select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")), "rows")
    asking, queries_once, repeated = _classes(queries.select(F.col(query_id).alias("id"), F.col(query_vector).cast("array<double>").alias("v")), "queries")
    asked = queries_once if repeated else asking
    hits = top_k((rows_once if many else mine).select(F.col("id").alias("r"), "v"), asked.select(F.col("id").alias("q"), F.col("v").alias("w")), k=k, row_id="r", query_id="q", vector="v", query_vector="w")
    if many:
        several = rows_once.where("n > 1").select("a", "b", F.col("id").alias("r"))
        copies = ranked(mine.select("a", "b", F.col("id").alias("copy")).join(several, ["a", "b"]), ["r"], [F.col("copy")], k).select("r", "copy")
        each = hits.drop("rank").join(stored(copies, "copies"), "r", "left").withColumn("r", F.coalesce("copy", "r"))
        hits = ranked(each, ["q"], [F.desc("score"), F.col("r")], k)
    if repeated:
        names = asking.select("a", "b", F.col("id").alias("asked")).join(queries_once.select("a", "b", F.col("id").alias("q")), ["a", "b"]).select("q", "asked")
        hits = hits.join(names, "q").withColumn("q", F.col("asked"))
    return hits.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "score", "rank")


def slices(df: DataFrame, key: str, vector: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of a table of any size, as slices that can be broadcast: one, if it is small.

    A larger one is stored first, with a number for each row to slice by: ids may repeat, and what the table comes from is read once.
    """
    few = few_vectors(df, key, vector)
    if few is not None:
        yield few
        return
    if "__place" not in df.columns:
        df = stored(df.select(key, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull()).withColumn("__place", F.monotonically_increasing_id()), "asked")
    size = df.agg(F.count(key).alias("n"), F.sum(F.size(vector)).alias("x")).first()
    n = 2 * max(-(-size["n"] // FEW), -(-8 * (size["x"] or 0) // BYTES))
    for i in range(n):
        yield from slices(df.where(F.pmod(F.xxhash64(F.lit(n), "__place"), F.lit(n)) == i), key, vector)


def score_pairs(rows: DataFrame, queries: DataFrame, *, row_id: str = "id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_embedding", metrics: Sequence[str] = ("cosine",)) -> DataFrame:
    """Every row with every query and a column for each metric; the result has a row for each pair. More queries than can be broadcast are taken in slices.

    Rows are spread, once for all slices, so that a task has ``PAIRS`` pairs or so, however few files they lie in.
    """
    rows = rows.select(F.col(row_id).alias("r"), F.col(vector).alias("v")).where("r IS NOT NULL AND v IS NOT NULL")
    names = [query_id, row_id, *metrics]
    schema = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{row_id}` {rows.schema['r'].dataType.simpleString()}, " + ", ".join(f"`{x}` double" for x in metrics)
    context = rows.sparkSession.sparkContext
    parts = [(len(few[1]), context.broadcast(few)) for few in slices(queries, query_id, query_vector)]
    pairs = rows.count() * max(n for n, _ in parts)
    if pairs > PAIRS:
        rows = rows.repartition(max(-(-pairs // PAIRS), context.defaultParallelism))
    rows = rows.withColumn("v", F.col("v").cast("array<double>"))

    def paired(shared: Broadcast) -> DataFrame:
        def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            for b in (x.slice(i, 1024) for x in batches for i in range(0, len(x), 1024)):
                mine = matrix(b.column(1), asked.shape[1]) if len(asked) else None
                for start in range(0, len(asked), 64):
                    part = asked[start : start + 64]
                    of, at = np.meshgrid(np.arange(start, start + len(part)), np.arange(len(b)))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of.ravel())), b.column(0).take(pa.array(at.ravel())), *(pa.array(scores(x, mine, part).ravel()) for x in metrics)], names)

        return rows.mapInArrow(pair, schema)

    return reduce(DataFrame.unionByName, (paired(shared) for _, shared in parts))


def search_by_text(rows: DataFrame, queries: DataFrame, embed: Column, **how) -> DataFrame:
    """top_k for queries whose vector is made of their text by an embedder's column."""
    return top_k(rows, queries.withColumn("query_embedding", embed), **how)


def search_by_image(rows: DataFrame, files: DataFrame, embed: Column, *, query_id: str = "path", **how) -> DataFrame:
    """top_k for image files (path and content, as ``sources.tables.blobs`` reads them), whose vector is made of their content by an embedder's column."""
    return top_k(rows, files.select(query_id, embed.alias("query_embedding")), query_id=query_id, **how)


def mmr(candidates: DataFrame, *, k: int = 4, weight: float = 0.5, query_id: str = "query_id", row_id: str = "id", vector: str = "embedding", query_vector: str = "query_embedding") -> DataFrame:
    """Maximal marginal relevance among each query's candidates (its fetch_k nearest): query_id, row_id, position from 1.

    Greedy: the most similar first, then the largest weight * similarity - (1 - weight) * similarity to what is chosen; the
    lowest id wins ties. A group is the fetch_k candidates of one query.
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(row_id, kind="stable").reset_index(drop=True)
        m = np.stack([np.asarray(v, float) for v in group[vector]])
        q = np.asarray(group[query_vector].iloc[0], float)
        length = lambda x: np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
        m, q = m / length(m), q / length(q)
        near, most, taken = m @ q, np.full(len(m), -np.inf), []
        for _ in range(min(k, len(m))):
            value = near.copy() if not taken else weight * near - (1 - weight) * most
            value[taken] = -np.inf
            # equal up to rounding counts as a tie
            taken.append(int(np.flatnonzero(value >= value.max() - 1e-12)[0]))
            most = np.maximum(most, m @ m[taken[-1]])
        return pd.DataFrame({query_id: group[query_id].iloc[0], row_id: group[row_id].iloc[taken].to_numpy(), "position": range(1, len(taken) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy(query_id).applyInPandas(choose, f"{query_id} {kinds[query_id]}, {row_id} {kinds[row_id]}, position int")


HITS = 500_000  # hits that are broadcast


def few_hits(hits: DataFrame) -> DataFrame:
    """Hits, stored, to be joined with the table they come from: broadcast while they are few, so that the table isn't shuffled."""
    hits = stored(hits, "hits")
    return F.broadcast(hits) if hits.count() <= HITS else hits


def mmr_search(rows: DataFrame, queries: DataFrame, *, k: int = 4, fetch_k: int = 20, weight: float = 0.5, row_id: str = "id", query_id: str = "query_id", vector: str = "embedding", query_vector: str = "query_embedding", where: Column | None = None) -> DataFrame:
    near = top_k(rows, queries, k=fetch_k, row_id=row_id, query_id=query_id, vector=vector, query_vector=query_vector, where=where)
    full = rows.select(row_id, vector).join(few_hits(near.select(query_id, row_id)), row_id).join(queries.select(query_id, query_vector), query_id)
    return mmr(full, k=k, weight=weight, query_id=query_id, row_id=row_id, vector=vector, query_vector=query_vector)


def term_count_top_k(docs: DataFrame, term: str, *, k: int = 4, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The k rows in which a term occurs most (rows without it count 0), ties by id."""
    return docs.select(row_id, count_of(text, term).alias("n")).orderBy(F.desc("n"), row_id).limit(k)


def tokens(text: str | Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"[a-z0-9]+"), F.lit(0))


def bm25(docs: DataFrame, terms: list[str], *, text: str = "text", row_id: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """row_id and score of the rows with any of the terms: Okapi BM25 with idf = ln(1 + (N - n + 0.5) / (n + 0.5)).

    One pass over the texts gives each row's length and its counts of the terms, which are stored; corpus figures are one row.
    """
    words = docs.select(row_id, tokens(text).alias("w"))
    times = lambda t: F.size(F.filter("w", lambda x: x == t)).cast("double")
    counts = [times(t).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = stored(words.select(row_id, F.size("w").cast("double").alias("len"), *counts), "counts")
    facts = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))))
    idf = lambda i: F.log(1.0 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    joined = rows.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(facts))
    return joined.select(row_id, reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))]).alias("score"))


def near_vectors(rows: DataFrame, *, above: float = 0.95, row_id: str = "id", vector: str = "embedding") -> DataFrame:
    """Ids of rows that have a row of smaller id with a cosine above the limit, over the whole table and exactly.

    Rows are dealt by their id into blocks of about ``BLOCK``, and each pair of blocks is one group, which multiplies its
    matrices and returns ids, not pairs: a large group of alike vectors yields no more rows than a block has. Each row is
    shuffled once for each block.
    """
    rows = rows.select(F.col(row_id).alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    n = max(1, -(-rows.count() // BLOCK))
    each = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o"))
    pairs = each.select("id", "v", "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))

    def near(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        if len(set(pc.list_value_length(t["v"]).to_pylist())) > 1:
            raise ValueError("vector widths differ")
        m = np.asarray(pc.list_flatten(t["v"]).to_numpy(), float).reshape(len(t), -1)
        with np.errstate(all="ignore"):
            size = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m = m / size
        m[~np.isfinite(m).all(axis=1)] = 0.0  # as for cosine(): 0 where it isn't a number
        order = pc.rank(t["id"], tiebreaker="dense").to_numpy()
        k = t["k"].to_numpy()
        one, two = np.flatnonzero(k == t["i"][0].as_py()), np.flatnonzero(k == t["j"][0].as_py())
        found = np.zeros(len(t), bool)
        for start in range(0, len(one), 512):
            part = one[start : start + 512]
            alike = m[part] @ m[two].T > above
            less = order[part][:, None] < order[two][None, :]
            found[two] |= (alike & less).any(axis=0)
            found[part] |= (alike & (order[part][:, None] > order[two][None, :])).any(axis=1)
        return t.select(["id"]).filter(pa.array(found))

    return pairs.groupBy("i", "j").applyInArrow(near, f"id {kind}").distinct().withColumnRenamed("id", row_id)


def rerank(pairs: DataFrame, score: Column, *, n: int = 3, query_id: str = "query_id", row_id: str = "id") -> DataFrame:
    """The n best rows of each query by a pair score (a model's column), ties by id."""
    return ranked(pairs.withColumn("score", score), [query_id], [F.desc("score"), F.col(row_id)], n)


def ends_first(df: DataFrame, *, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Reordered for long contexts: the best at both ends, the worst in the middle. Adds position from 1."""
    w = Window.partitionBy(*(by or []))
    n = F.count("*").over(w)
    place = F.when(F.col(rank) % 2 == 1, (F.col(rank) + 1) / 2).otherwise(n - F.col(rank) / 2 + 1)
    return df.withColumn("position", place.cast("int"))


def centroids(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """The mean vector of each group, as rows (group, dim from 0, value)."""
    return rows.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x")).groupBy(by, "dim").agg(F.avg("x").alias("value"))


def weighted_mean_vectors(chunks: DataFrame, by: str, vector: str, weight: str) -> DataFrame:
    """The mean of each group's vectors by weight, at unit length."""
    long = chunks.select(by, F.col(weight).cast("double").alias("w"), F.posexplode(F.col(vector).cast("array<double>")).alias("d", "x"))
    mean = long.groupBy(by, "d").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    full = mean.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    return full.select(by, F.transform("v", lambda e: e["m"] / F.col("n")).alias(vector))


def fake_embedding(size: int):
    """A pandas UDF that embeds a text deterministically: normal values seeded by a hash of the text."""
    import hashlib

    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            seeds = (int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "big") % 10**8 for t in part)
            yield pd.Series([np.random.default_rng(s).normal(size=size).tolist() for s in seeds])

    return embed
