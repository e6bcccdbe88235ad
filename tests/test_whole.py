"""Queries that SQL can't express, or is too slow for, over whole tables on sf0.01, against brute force."""

import html
import json
import math
import re
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracles import QUERIES

from docloom.operators import merge, models, search

SF = "/root/testdata/sf0.01"
def test_near_vectors_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    v = np.random.default_rng(1).normal(size=(100, 4))
    v[7], v[50] = 0, v[3] * 2
    df = spark.createDataFrame([(f"{i:03d}", x.tolist()) for i, x in enumerate(v)], "id string, embedding array<double>")
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    want = {f"{j:03d}" for j in range(100) if (u[:j] @ u[j] > 0.9).any()}
    assert {r["id"] for r in search.near_vectors(df, above=0.9).collect()} == want and "050" in want


@pytest.mark.parametrize("name, table, key", [("vector_topk", "embeddings", "vec_id"), ("mmr_topk", "embeddings", "vec_id"), ("hybrid_search", "documents", "doc_id")])
def test_all_queries_are_answered(spark, name, table, key):
    ids = {r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").where(f"{key} % 20 = 0").select(key).collect()}
    got = QUERIES[name](spark, SF).collect()
    assert {r["query_id"] for r in got} == ids and len(got) == len(ids) * (10 if name == "vector_topk" else 4)


def test_vector_topk_by_brute_force(spark):
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    want = {(q, i) for q in e if q % 20 == 0 for i in sorted(e, key=lambda i: (-cosine(e[i], e[q]), i))[:10]}
    assert {(r["query_id"], r["vec_id"]) for r in QUERIES["vector_topk"](spark, SF).collect()} == want


def test_json_queries_take_all_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "props").collect()
    got = QUERIES["json_equality"](spark, SF).collect()
    assert {r["event_id"] for r in got} == {r["event_id"] for r in events} and len(got) == len(events)
    assert all(r["same"] for r in got)
    folded, want = {r["user_id"]: r["props"] and json.loads(r["props"]) for r in QUERIES["folded_json"](spark, SF).collect()}, {}
    for r in sorted(events, key=lambda r: r["event_id"]):
        want.setdefault(r["user_id"], []).append(r["props"])
    assert folded == {u: reduce(merge.deep_merge, map(json.loads, p)) for u, p in want.items()}


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2", "l1", "linf", "hamming"])
@pytest.mark.parametrize("few", [10_000, 3])
def test_top_k_by_brute_force(spark, monkeypatch, metric, few):
    """Broadcast queries and blocks of both sides give the same, with ties, zeros, nulls, a filter and a threshold."""
    monkeypatch.setattr(search, "FEW", few)
    monkeypatch.setattr(search, "BLOCK", 16)
    r = np.random.default_rng(2)
    v = r.integers(-2, 3, size=(90, 3)).astype(float)
    df = spark.createDataFrame([(f"{i:03d}", i % 7, x.tolist()) for i, x in enumerate(v)] + [("null", 1, None), (None, 1, [1.0, 2.0, 3.0])], "id string, label int, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(i, v[i * 5].tolist()) for i in range(12)] + [(99, None)], "query_id long, query_embedding array<double>")

    def score(a, b):
        if metric == "cosine":
            n = np.sqrt((a @ a) * (b @ b))
            return round(a @ b / n, 12) if n else 0.0
        d = a - b
        return {"ip": lambda: a @ b, "l2": lambda: round(np.sqrt(d @ d), 12), "l1": lambda: np.abs(d).sum(), "linf": lambda: np.abs(d).max(), "hamming": lambda: round((d != 0).mean(), 12)}[metric]()

    high = metric in ("cosine", "ip")
    got = search.top_k(df, q, k=3, offset=1, metric=metric, where=F.col("label") != 3, threshold=0.5).collect()
    want = set()
    for i in range(12):
        all_ = sorted(((-s if high else s), f"{j:03d}") for j in range(90) if j % 7 != 3 for s in [score(v[j], v[i * 5])] if (s >= 0.5 if high else s <= 0.5))
        want |= {(i, j, round(-s if high else s, 9), n) for n, (s, j) in enumerate(all_[:4], 1) if n > 1}
    assert {(x["query_id"], x["id"], round(x["score"], 9), x["rank"]) for x in got} == want
    assert search.top_k(df.limit(0), q, metric=metric).collect() == [] and search.top_k(df, q.limit(0), metric=metric).collect() == []


def test_nearest_route(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None)], "id int, embedding array<double>")
    routes = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 1.0])], "route_id string, embedding array<double>")
    assert {r["id"]: r["route_id"] for r in models.nearest_route(df, routes).collect()} == {1: "b", 2: "a", 3: "a"}
    with pytest.raises(Exception, match="widths differ"):
        models.nearest_route(df, spark.createDataFrame([("c", [1.0])], routes.schema)).collect()


def greedy(vectors, q, k, fetch, weight):
    """Maximal marginal relevance among the nearest rows, by its definition."""
    unit = lambda x: x / np.linalg.norm(x)
    near = sorted(vectors, key=lambda i: (-round(float(unit(vectors[i]) @ unit(q)), 12), i))[:fetch]
    taken = []
    while len(taken) < k:
        def value(i):
            s = float(unit(vectors[i]) @ unit(q))
            return s if not taken else weight * s - (1 - weight) * max(float(unit(vectors[i]) @ unit(vectors[j])) for j in taken)
        taken.append(max((i for i in near if i not in taken), key=lambda i: (round(value(i), 11), -i)))
    return taken


@pytest.mark.parametrize("name, place, k, fetch, weight", [("mmr_topk", "position", 4, 20, 0.5), ("retriever_mmr", "rank", 3, 12, 0.3)])
def test_mmr_by_brute_force(spark, name, place, k, fetch, weight):
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in QUERIES[name](spark, SF).collect():
        got.setdefault(r["query_id"], {})[r[place]] = r["vec_id"]
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == {q: greedy(e, e[q], k, fetch, weight) for q in e if q % 20 == 0}


def test_cluster_representatives_are_nearest(spark):
    e = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = models.cluster_representatives(spark.read.parquet(f"{SF}/embeddings.parquet"), 5, row_id="vec_id").collect()
    assert len({r["cluster"] for r in got}) == len(got) == 5 and len({r["vec_id"] for r in got}) == 5
    assert {r["cluster"] for r in QUERIES["cluster_representatives"](spark, SF).collect()} == set(range(5))
    near = {i: min(got, key=lambda r: np.linalg.norm(e[i] - e[r["vec_id"]]))["cluster"] for i in e}
    assert set(near.values()) == set(range(5))


def test_json_split_by_brute_force(spark):
    """Each chunk is JSON; together a row's chunks hold just its leaves."""
    leaves = lambda v, p=(): [x for k, y in v.items() for x in leaves(y, (*p, k))] if isinstance(v, dict) and v else [(*p, json.dumps(v))]
    events = {r["event_id"]: json.loads(r["props"]) for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "props").collect() if r["props"]}
    got = {}
    for r in QUERIES["json_split"](spark, SF).collect():
        got.setdefault(r["event_id"], []).append(json.loads(r["chunk"]))
    assert {i: sorted(x for c in got[i] for x in leaves(c)) for i in got} == {i: sorted(leaves(v)) for i, v in events.items() if v}


def test_links_and_pages_by_brute_force(spark):
    from urllib.parse import urldefrag, urljoin

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {}
    for r in QUERIES["absolute_links"](spark, SF).collect():
        got.setdefault(r["page_id"], set()).add(r["link"])
    for i, links in got.items():
        hrefs = {urldefrag(urljoin(pages[i]["url"], h))[0] for h in re.findall("href=[\"']([^\"']*)", pages[i]["html"])}
        assert links <= hrefs, i
    for r in QUERIES["page_markdown"](spark, SF).collect():
        words = re.sub(r"<!--.*?-->|<(script|style|noscript|title).*?</\1>", " ", pages[r["page_id"]]["html"] or "", flags=re.S)
        words = re.findall(r"\w{4,}", re.sub("<[^>]*>", " ", words))
        assert not words or sum(w in r["text"] for w in words) >= 0.9 * len(words)


@pytest.mark.parametrize("name, size", [("recursive_split", 1000), ("character_split", 500), ("sentence_split", 400)])
def test_splits_keep_the_text(spark, name, size):
    """Chunks in order lie one after the other in the text, with nothing but white space lost between them, and hold to the size where the text can be cut."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in QUERIES[name](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["text"] if "text" in r else r["chunk"]))
    squeeze = lambda t: "".join(t.split())
    for i, text in docs.items():
        whole, upto = squeeze(text), 0
        for _, chunk in sorted(got.get(i, [])):
            body = squeeze(chunk)
            at = whole.rfind(body, 0, upto + len(body))
            assert 0 <= at <= upto, (i, chunk[:50])
            upto = max(upto, at + len(body))
            assert len(chunk) <= size or "\n" not in chunk.strip() or name == "sentence_split"
        assert upto == len(whole), i


def test_sections_of_pages_hold_their_text(spark):
    rows = QUERIES["html_header_split"](spark, SF).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert rows and all(set(r["metadata"]) <= {"h1", "h2", "h3"} for r in rows)
    for r in rows:
        plain = re.sub("<[^>]*>", "", re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", pages[r["page_id"]], flags=re.S))
        assert "".join(r["content"].split()) in "".join(html.unescape(plain).split()), r["page_id"]
