"""Approximate search against the exact way, slices of queries, plans of what joins hits with their table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ivf, models, retrieval, search
from docloom.operators.ivf import VectorIndex

SF = "/root/testdata/sf0.1"


def test_recall_on_the_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    index = VectorIndex.of(e, row_id="vec_id", keep=["label"])
    assert index.rows.count() == e.count() and len(index.centroids) == int(e.count() ** 0.5)
    exact = search.top_k(e, q, row_id="vec_id", k=10)
    probes = index.probes_for(q, share=0.9, sample=50)
    assert probes < len(index.centroids)
    found = index.search(q, k=10, probes=probes)
    assert ivf.recall(found, exact, row_id="vec_id") >= 0.9
    assert ivf.recall(index.search(q, k=10, probes=1), exact, row_id="vec_id") < 1.0
    # all lists: the same as the exact way, with a filter too
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    where = F.col("label") == 1
    assert key(index.search(q, k=5, probes=10_000, where=where, threshold=0.1)) == key(search.top_k(e, q, row_id="vec_id", k=5, where=where, threshold=0.1))


def test_hot_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ivf, "PART", 20)
    monkeypatch.setattr(ivf, "SLICE", 3)
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 4))
    v[:200] = v[0]
    v[5] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, embedding array<double>").union(spark.createDataFrame([(None, [1.0, 0.0, 0.0, 0.0])], "id long, embedding array<double>"))
    index = VectorIndex.of(df, lists=6)
    assert index.rows.groupBy("list", "part").count().agg(F.max("count")).first()[0] <= 60 and index.rows.count() == 300
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 300, 9)], "query_id long, query_embedding array<double>")
    key = lambda df: {(r["query_id"], r["rank"], r["id"]) for r in df.where("score > 0").collect()}
    assert key(index.search(q, k=3, probes=6)) == key(search.top_k(df.where("id <> 5"), q, k=3))
    assert VectorIndex.of(df.limit(0)).search(q).collect() == []


@pytest.mark.parametrize("few", [10_000, 3])
def test_any_number_of_queries_and_routes(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    r = random.Random(2)
    rows = spark.createDataFrame([(i, [r.random(), r.random()]) for i in range(20)], "id long, embedding array<double>")
    asked = rows.where("id < 11").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    pairs = search.score_pairs(rows, asked, metrics=["cosine", "l2"])
    assert pairs.count() == 220 == pairs.select("id", "query_id").distinct().count()
    routes = rows.where("id < 11").select(F.col("id").alias("route_id"), "embedding").union(rows.where("id = 3").select(F.lit(30).cast("long"), "embedding"))
    got = {x["id"]: (x["route_id"], round(x["score"], 9)) for x in models.nearest_route(rows, routes).collect()}
    best = {}
    for x in sorted(pairs.collect(), key=lambda x: (-x["cosine"], x["query_id"])):
        best.setdefault(x["id"], (x["query_id"], round(x["cosine"], 9)))
    assert got == best


def test_hits_are_joined_without_a_shuffle_of_their_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("text", F.lit("t"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    hits = retrieval.Retriever(e, row_id="vec_id")(q)
    assert "BroadcastHashJoin" in plan(hits) and "hashpartitioning(vec_id" not in plan(hits)
    spread = search.mmr_search(e, q, row_id="vec_id")
    assert "BroadcastHashJoin" in plan(spread) and "hashpartitioning(vec_id" not in plan(spread)
