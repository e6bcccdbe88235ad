"""Connected components of a graph held as rows, by alternating large-star and small-star steps.

Every step is a groupBy (with partial aggregation) and an equi-join of two stored tables, which the adaptive
planner may split where a node has very many edges. Each result is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, and that node none: then it is the smallest of its component."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 OR (down = 1 AND up = 1)").take(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node with an edge; edges: columns u, v of type long. component: the smallest node reachable.

    Self-loops, repeated and reversed edges are allowed; edges with a null end are ignored; no edges: no rows.
    """
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        joined = large.join(least, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = stored(small.where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
