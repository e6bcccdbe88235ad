"""Combining ranked lists, rows by key, and rows over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.numbering import numbered


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reciprocal_rank_fusion(lists: DataFrame, weights: dict[int, float] | None = None, *, key: str = "key", list_id: str = "list_id", rank: str = "rank", constant: float = 60.0, by: list[str] | None = None) -> DataFrame:
    """key, score and position from 1: the sum of weight / (rank + constant) over the lists; ties by first appearance (list, rank)."""
    by = by or []
    weight = F.lit(1.0)
    if weights:
        weight = reduce(lambda c, w: c.when(F.col(list_id) == w[0], float(w[1])), weights.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    scored = lists.groupBy(*by, key).agg(F.sum(weight / (F.col(rank) + constant)).alias("score"), F.min(F.struct(list_id, rank)).alias("__first"))
    order = [F.desc("score"), F.col("__first")]
    if not by:
        return numbered(scored, order, "position").withColumn("position", (F.col("position") + 1).cast("int")).drop("__first")
    return scored.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).drop("__first")


def interleave(lists: DataFrame, *, list_id: str = "list_id", rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Round robin over ranked lists: position from 1, by rank, then list."""
    if not by:
        return numbered(lists, [rank, list_id], "position").withColumn("position", (F.col("position") + 1).cast("int"))
    return lists.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(rank, list_id)))


def hours_between(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 3600e6


def decayed_score(last_seen: Column, now: Column, decay: float = 0.01, relevance: Column | None = None, *others: Column) -> Column:
    """(1 - decay) to the hours since, plus relevance and other scores (null counts 0)."""
    score = F.pow(F.lit(1.0 - decay), hours_between(now, last_seen))
    for c in (relevance, *others):
        if c is not None:
            score = score + F.coalesce(c, F.lit(0.0))
    return score


def first_by_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. The smallest row is found by a partial aggregation, so one hot key shuffles a row per task.

    Rows are grouped by a 256-bit hash of string keys, so that a text that is a key is shuffled once, in its row.
    """
    names, kinds = df.columns, dict(df.dtypes)
    rank = F.struct(*(c if isinstance(c, Column) else F.col(c) for c in order))
    by = [(F.sha2(k, 256) if kinds.get(k) == "string" else F.col(k)).alias(f"__key{i}") for i, k in enumerate(keys)]
    row = df.select(*by, rank.alias("__rank"), F.struct(*names).alias("__row"))
    return row.groupBy(*(f"__key{i}" for i in range(len(keys)))).agg(F.min_by("__row", "__rank").alias("__row")).select("__row.*")


def parents(hits: DataFrame, store: DataFrame, *, parent: str = "parent_id", rank: str = "rank", k: int | None = None) -> DataFrame:
    """The distinct parents of ranked child hits in order of first appearance; parents that aren't stored are left out."""
    first = hits.groupBy(parent).agg(F.min(rank).alias("first_rank"))
    found = first.join(store, parent).orderBy("first_rank", parent)
    return found.limit(k) if k else found


def in_request_order(requests: DataFrame, store: DataFrame, key: str, *, missing: bool = True) -> DataFrame:
    """The store's row for each requested key; missing keys give nulls, or no row."""
    return requests.join(store, key, "left" if missing else "inner")


def exists_in(keys: DataFrame, store: DataFrame, key: str, name: str = "found") -> DataFrame:
    marks = store.select(key).distinct().withColumn(name, F.lit(True))
    return keys.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, *, by: list[str], time: str, values: list[str]) -> DataFrame:
    """For each left row the latest right values at or before its time: one sorted pass over the union of both."""
    l = left.withColumns({"__side": F.lit(1), **{f"__{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}})
    own = [c for c in left.columns if c not in (*by, time)]
    r = right.select(*by, time, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own), F.lit(0).alias("__side"), *(F.col(v).alias(f"__{v}") for v in values))
    w = Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r)
    return both.withColumns({v: F.last(f"__{v}", ignorenulls=True).over(w) for v in values}).where("__side = 1").drop("__side", *(f"__{v}" for v in values))


def nodes_like(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """First nodes (without an incoming edge) and last nodes (without an outgoing one): node, first, last."""
    ends = edges.select(F.col(source).alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col(target).alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg((F.sum("in") == 0).alias("first"), (F.sum("out") == 0).alias("last"))
