"""Searches of tables with copies: each distinct pair is scored once, and all copies are found."""

import random

import pytest
from pyspark.sql import functions as F
from test_terms import best

from docloom.operators import models, search, terms
from docloom.operators.terms import TermIndex


def copied(seed):
    """40 texts, six copies each, that differ in case, order and marks."""
    r = random.Random(seed)
    texts = [" ".join(r.choices([f"w{j}" for j in range(30)], k=r.choice([1, 4, 20]))) for _ in range(40)]
    docs = [(n * 100 + i, n % 3, (t.upper() + "!" if n % 2 else " ".join(reversed(t.split())))) for i, t in enumerate(texts) for n in range(6)]
    return docs, len({" ".join(sorted(t.split())) for t in texts})


def test_texts_of_the_same_words_are_scored_once(spark, monkeypatch):
    docs, distinct = copied(1)
    df = spark.createDataFrame(docs, "doc_id long, label int, text string").repartition(3)
    asked = [(i, t) for i, _, t in docs[::4]]
    seen = []
    real = terms._best_rows
    monkeypatch.setattr(terms, "_best_rows", lambda packed, asked, *x: seen.append((packed.agg(F.sum(F.size("docs"))).first()[0], asked.count())) or real(packed, asked, *x))
    index = TermIndex.of_texts(df, keep=["label"], block=16)
    queries = index.words(spark.createDataFrame(asked, "query_id long, text string"))
    line = lambda hits: {(x["query_id"], x["doc_id"], round(x["score"], 6), x["rank"]) for x in hits.collect()}
    assert line(index.search(queries, k=4)) == best(docs, asked, 4)
    assert seen[0][0] == distinct and seen[0][1] <= 40 < len(asked)
    hits = index.search(queries, k=3, where=F.col("label") == 1, select=["label"], threshold=1.0)
    assert line(hits) == best(docs, asked, 3, lambda x: x == 1, 1.0) and {x["label"] for x in hits.collect()} == {1}


@pytest.mark.parametrize("metric, threshold", [("ip", None), ("l2", 6.0)])
def test_many_queries_are_streamed(spark, monkeypatch, metric, threshold):
    """A task gives k rows for each query, however many batches it reads."""
    monkeypatch.setattr(search, "FEW", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        r = random.Random(3)
        rows = [(i, [float(r.randrange(9)), float(r.randrange(9))]) for i in range(200)]
        asked = [(q, [float(r.randrange(9)), float(r.randrange(9))]) for q in range(30)]
        seen = []
        real = search._streamed
        monkeypatch.setattr(search, "_streamed", lambda *x: seen.append(real(*x)) or seen[-1])
        df = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
        queries = spark.createDataFrame(asked, "query_id long, query_embedding array<double>")
        got = {(x["query_id"], x["id"], x["rank"]) for x in search.top_k(df, queries, k=3, metric=metric, threshold=threshold).collect()}
        value = lambda v, w: -(v[0] * w[0] + v[1] * w[1]) if metric == "ip" else ((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2) ** 0.5
        want = {(q, i, n) for q, v in asked for n, (_, i) in enumerate(sorted((value(v, w), i) for i, w in rows if value(v, w) <= (threshold or 1e9))[:3], 1)}
        assert got == want and sum(x.count() for x in seen) <= 3 * 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_vectors_of_hybrid_search_are_scored_once(spark, monkeypatch):
    r = random.Random(4)
    vectors = [[float(r.randrange(9)), 1.0] for _ in range(30)]
    rows = [(n * 100 + i, f"w{i % 7} w{i}", v) for i, v in enumerate(vectors) for n in range(4)]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    asked = df.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"), F.col("text").alias("query_text"))
    plain = search.top_k(df, asked, k=5).collect()
    assert sorted(search.top_k_by_classes(df, asked, k=5).collect()) == sorted(plain)
    seen = []
    real = search.top_k
    monkeypatch.setattr(search, "top_k", lambda rows, queries, **how: seen.append((rows.count(), queries.count())) or real(rows, queries, **how))
    assert models.hybrid(df, asked, row_id="id").count() == 4 * asked.count()
    n = len(set(map(tuple, vectors)))
    assert seen[0][0] == n and seen[0][1] <= n
