"""Approximate vector search: inverted lists around centroids. ``search.top_k`` is the exact way.

Centroids are fitted on at most ``SAMPLE`` rows (those of the smallest hashes of their ids); every row of the table is put
into the list of its nearest centroid. A query looks into the lists of its nearest ``probes`` centroids, and what it finds
there is scored exactly, so what is returned is right and something may be missing: ``recall`` says how much, and
``probes_for`` how many lists it takes for a share of the hits, which is nearly all of them where vectors form no groups.

A list is cut into parts of about ``PART`` rows, whatever its size, and a group of the scoring step is a part with some
``SLICE`` queries. Rows are shuffled once, when the index is made; a search moves queries and the parts they look into.
Cosines only; vectors of zeros are in a list of their own and are never found. Rows and queries without a vector or id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import matrix, ranked, scores, top_k
from docloom.session import fresh_path, stored

SAMPLE = 20_000
PART = 8192
SLICE = 1000
BYTES = 32_000_000  # of the centroids, which every task has
FEW = 500_000
TUNED = 200  # queries


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
    m[~np.isfinite(m).all(axis=1)] = 0.0
    return m


@dataclass(frozen=True)
class VectorIndex:
    """Lists in a folder (``list``, ``part``, id, vector, columns kept) and the centroids."""

    spark: SparkSession
    path: str
    row_id: str
    vector: str
    centroids: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, *, row_id: str = "id", vector: str = "embedding", keep: list[str] | None = None, lists: int | None = None, sample: int = SAMPLE, path: str | None = None, seed: int = 1) -> VectorIndex:
        """Makes an index. lists: how many (the root of the number of rows, as far as the sample and ``BYTES`` allow)."""
        spark = rows.sparkSession
        rows = rows.select(row_id, *(keep or []), F.col(vector).cast("array<double>").alias(vector)).where(F.col(row_id).isNotNull() & (F.size(vector) > 0))
        size = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
        n, width = size["n"], size["width"] or 0
        length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
        fitted = rows.select(row_id, F.transform(vector, lambda x: x / length).alias("u"), length.alias("l")).where("l > 0 AND NOT isnan(l)").orderBy(F.xxhash64(row_id), row_id).limit(sample)
        lists = max(1, min(lists or int(n**0.5), BYTES // (8 * max(width, 1)), sample // 8))
        data = stored(fitted.select(array_to_vector("u").alias("features")), "sample")
        model = KMeans(k=lists, seed=seed, maxIter=10).fit(data) if data.count() > lists > 1 else None
        centroids = _unit(np.stack(model.clusterCenters())) if model else np.zeros((1, width))
        out = cls(spark, path or fresh_path(spark, "lists"), row_id, vector, centroids)
        placed = stored(out._nearest(rows, row_id, vector, 1, rows.columns), "placed")
        parts = placed.groupBy("list").agg(F.greatest(F.ceil(F.count("*") / PART), F.lit(1)).alias("__parts"))
        dealt = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64(row_id), F.col("__parts")).cast("int")).drop("__parts")
        dealt.repartition("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{out.path}/rows")
        return out

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _nearest(self, df: DataFrame, key: str, vector: str, probes: int, columns: list[str]) -> DataFrame:
        """df's columns, once for each of the nearest lists of a row; -1 for a vector of zeros."""
        shared = self.spark.sparkContext.broadcast(self.centroids)
        at = columns.index(vector)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            most = min(probes, len(c))
            for b in batches:
                if not len(b):
                    continue
                m = _unit(matrix(b.column(at), c.shape[1] or None))  # an index without rows has no width
                m = m if c.shape[1] else m[:, :0]
                s = m @ c.T
                top = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < len(c) else np.tile(np.arange(len(c)), (len(b), 1))
                if most == 1:
                    top = s.argmax(axis=1)[:, None]
                top[~m.any(axis=1)] = -1
                whose = np.repeat(np.arange(len(b)), top.shape[1])
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(whose)) for x in b.columns), pa.array(top.ravel().astype(np.int32))], [*b.schema.names, "list"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(columns).schema)
        return df.select(columns).mapInArrow(near, f"{schema}, list int")

    def search(self, queries: DataFrame, *, k: int = 4, probes: int = 8, query_id: str = "query_id", query_vector: str = "query_embedding", where: Column | None = None, threshold: float | None = None) -> DataFrame:
        """Of each query the k best rows of the lists it looks into: query_id, row_id, score, rank; ties by row id."""
        q = queries.select(F.col(query_id).alias("query"), F.col(query_vector).cast("array<double>").alias("v")).where("query IS NOT NULL AND size(v) > 0")
        q = stored(self._nearest(q, "query", "v", probes, ["query", "v"]).where("list >= 0"), "probes")
        rows = self.rows if where is None else self.rows.where(where)
        sliced = q.withColumn("slice", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-q.count() // (SLICE * probes))))).cast("int"))
        parts = stored(rows.select("list", "part").distinct(), "parts")
        asked = stored(sliced.join(F.broadcast(parts), "list"), "asked")  # parts: PART rows each
        groups = stored(asked.select("list", "part", "slice").distinct(), "groups")
        groups = F.broadcast(groups) if groups.count() <= FEW else groups
        ids, kinds = self.rows.schema[self.row_id].dataType.simpleString(), q.schema["query"].dataType.simpleString()
        left = rows.join(groups, ["list", "part"]).select("list", "part", "slice", F.col(self.row_id).alias("r"), F.lit(None).cast(kinds).alias("query"), F.col(self.vector).alias("v"))
        right = asked.select("list", "part", "slice", F.lit(None).cast(ids).alias("r"), "query", "v")

        def best(t: pa.Table) -> pa.Table:
            mine, wanted = t.filter(pc.is_valid(t["r"])).combine_chunks(), t.filter(pc.is_valid(t["query"])).combine_chunks()
            at, of, got = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            if len(mine) and len(wanted):
                b = matrix(wanted["v"])
                order = pc.rank(mine["r"], tiebreaker="dense").to_numpy()
                for start in range(0, len(wanted), 128):
                    s = scores("cosine", matrix(mine["v"], b.shape[1]), b[start : start + 128])
                    for j in range(s.shape[1]):
                        v = s[:, j]
                        found = np.flatnonzero(v >= np.partition(v, len(v) - k)[len(v) - k]) if len(v) > k else np.arange(len(v))
                        found = found[np.lexsort((order[found], -v[found]))[:k]]
                        at.append(found)
                        of.append(np.full(len(found), start + j))
                        got.append(v[found])
            return pa.table([wanted["query"].take(pa.array(np.concatenate(of))), mine["r"].take(pa.array(np.concatenate(at))), pa.array(np.concatenate(got))], ["query", "r", "score"])

        found = left.unionByName(right).groupBy("list", "part", "slice").applyInArrow(best, f"query {kinds}, r {ids}, score double")
        if threshold is not None:
            found = found.where(F.col("score") >= threshold)
        hits = ranked(found, ["query"], [F.desc("score"), F.col("r")], k)
        return hits.select(F.col("query").alias(query_id), F.col("r").alias(self.row_id), "score", "rank")

    def probes_for(self, queries: DataFrame, *, share: float = 0.9, k: int = 10, sample: int = TUNED, query_id: str = "query_id", query_vector: str = "query_embedding", margin: float = 0.02) -> int:
        """How many lists queries have to look into to find that share (and a margin) of their k best rows: measured on at most ``sample`` of them, exactly."""
        some = stored(queries.where(F.col(query_id).isNotNull() & (F.size(query_vector) > 0)).orderBy(F.xxhash64(query_id), query_id).limit(sample).select(F.col(query_id).alias("query"), F.col(query_vector).alias("v")), "sample")
        hits = top_k(self.rows, some, k=k, row_id=self.row_id, query_id="query", vector=self.vector, query_vector="v").select("query", self.row_id)
        placed = self.rows.select(self.row_id, "list").join(F.broadcast(stored(hits, "hits")), self.row_id).select("query", "list").toArrow()  # k rows for a query
        asked = some.toArrow()
        order = np.argsort(np.argsort(-(_unit(matrix(asked["v"], self.centroids.shape[1])) @ self.centroids.T), axis=1, kind="stable"), axis=1)
        at = {q: i for i, q in enumerate(asked["query"].to_pylist())}
        needed = sorted(int(order[at[q], x]) + 1 for q, x in zip(placed["query"].to_pylist(), placed["list"].to_pylist(), strict=True) if x >= 0)
        return needed[min(len(needed) - 1, int(len(needed) * min(1.0, share + margin)))] if needed else 1


def recall(found: DataFrame, exact: DataFrame, *, query_id: str = "query_id", row_id: str = "id") -> float:
    """The share of exact hits that are found. A row as good as the last exact one counts, too, if it is found for it."""
    limit = exact.groupBy(query_id).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    good = found.join(limit, query_id).where(F.col("score") >= F.col("least") - 1e-9).groupBy(query_id).agg(F.count("*").alias("good"))
    row = limit.join(good, query_id, "left").agg(F.sum(F.least(F.coalesce("good", F.lit(0)), "n")).alias("good"), F.sum("n").alias("n")).first()
    return row["good"] / row["n"] if row["n"] else 1.0
