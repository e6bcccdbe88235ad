"""Graphs as node and edge tables: adding, removing, embedding, renaming, ends, and run trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.fusion import nodes_like
from docloom.session import stored


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some nodes (id) and the edges at them."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").join(ids.withColumnRenamed("id", "target"), "target", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(edges.columns)


def prefixed(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """The graph with prefix:id for each id, to be embedded in another."""
    name = lambda c: F.concat(F.lit(f"{prefix}:"), F.col(c).cast("string")).alias(c)
    return nodes.withColumn("id", name("id")), edges.withColumns({"source": name("source"), "target": name("target")})


def readable_ids(nodes: DataFrame, name: str = "name") -> DataFrame:
    """nodes with new_id: the name, numbered where several share it."""
    w = Window.partitionBy(name)
    number = F.row_number().over(w.orderBy("id"))
    return nodes.withColumn("new_id", F.when(F.count("*").over(w) > 1, F.concat(name, F.lit("_"), number.cast("string"))).otherwise(F.col(name)))


def single_end(edges: DataFrame, which: str) -> DataFrame:
    """The one first or last node; no row if there are none or several."""
    if which not in ("first", "last"):
        raise ValueError(f"no end {which!r}")
    ends = nodes_like(edges).where(which).select("node")
    return ends.crossJoin(F.broadcast(ends.agg(F.count("*").alias("__n")))).where("__n = 1").drop("__n")


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of JSON text; for graphs to look at."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(*edges.columns))).alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "edges")).alias("graph"))


def run_tree(runs: DataFrame, *, run: str = "run_id", parent: str = "parent_id", order: Column | str = "start", path: bool = True) -> DataFrame:
    """runs with trace_id (the root's id), depth and path: start times and ids from the root, to sort by.

    Level by level: each round joins the runs that have no place yet with the last level and stores those left, until a level is
    empty; so a run is read as often as it is deep, and no more. A run whose parent is missing is a root, and runs that are their
    own ancestors have no place. path: without it, start times aren't read.
    """
    key = (F.col(order) if isinstance(order, str) else order).cast("string")
    named = [F.concat_ws("", key, F.col(run).cast("string")).alias("__key")] if path else []
    rows = runs.select(F.col(run).alias("__child"), F.col(parent).alias("__run"), *named)
    known = runs.select(F.col(run).alias("__run"), F.lit(True).alias("__has"))
    marked = rows.where("__run IS NOT NULL").join(known, "__run", "left")
    marked = stored(marked.unionByName(rows.where("__run IS NULL").withColumn("__has", F.lit(None).cast("boolean"))), "marked")
    level = marked.where("__has IS NULL").select(F.col("__child").alias("__run"), F.col("__child").alias("trace_id"), F.lit(0).alias("depth"), *([F.col("__key").alias("path")] if path else []))
    left, levels = marked.where("__has").drop("__has"), []
    below = [F.concat_ws(".", "path", "__key").alias("path")] if path else []
    while level.take(1):
        levels.append(level)
        both = stored(left.join(level, "__run", "left"), "level")
        level = both.where("depth IS NOT NULL").select(F.col("__child").alias("__run"), "trace_id", (F.col("depth") + 1).alias("depth"), *below)
        left = both.where("depth IS NULL").select(left.columns)
    placed = reduce(DataFrame.unionByName, levels) if levels else level
    return runs.join(placed.withColumnRenamed("__run", run), run)


def trimmed(nodes: DataFrame, edges: DataFrame, which: str) -> tuple[DataFrame, DataFrame]:
    """The graph without its one first (or last) node, if just one edge is at it; else the graph as it is."""
    near, far = ("source", "target") if which == "first" else ("target", "source")
    end = single_end(edges, which).select(F.col("node").alias(near))
    once = edges.join(end, near, "left_semi").groupBy(near).agg(F.count(far).alias("__n")).where("__n = 1").select(F.col(near).alias("id"))
    return without_nodes(nodes, edges, once)
