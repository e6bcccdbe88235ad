"""Work that grows no faster than the rows: equal vectors, texts of a group, greedy pairs, run trees."""

import random

from pyspark.sql import functions as F

from docloom.operators import evaluate, graph, search, summaries


def test_of_equal_vectors_only_the_first_are_scored(spark, monkeypatch):
    """4000 rows of ten vectors: k of each can be hits, and just those are multiplied."""
    r = random.Random(2)
    rows = [(i, [float(r.randrange(10))]) for i in range(4000)]
    asked = [(q, [r.random() * 10]) for q in range(300)]
    seen = []
    first = search._first_of_equals
    monkeypatch.setattr(search, "_first_of_equals", lambda df, k: seen.append(first(df, k)) or seen[-1])
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id long, query_embedding array<double>")
    got = {(x["query_id"], x["id"], x["rank"]) for x in search.top_k(df, queries, k=3, metric="l2").collect()}
    want = {(q, i, n) for q, v in asked for n, (_, i) in enumerate(sorted((round(abs(w[0] - v[0]), 12), i) for i, w in rows)[:3], 1)}
    assert got == want and seen[0].count() == 30


def test_texts_of_a_group_are_read_as_a_stream(spark):
    rows = [(i, f"g{i % 3}" if i % 7 else None, None if i % 5 == 0 or i % 3 == 2 else f"t{i} ä") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(7)
    out = summaries.stuffed(df, by="lang", order="doc_id")
    got = {x["lang"]: x["body"] for x in out.collect()}
    want = {g: "\n\n".join(t for _, k, t in rows if k == g and t is not None) or None for g in ("g0", "g1", "g2", None)}
    assert got == want and got["g2"] is None
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_greedy_pairs_are_a_fold(spark):
    r = random.Random(4)
    rows = [(g, i, j, r.choice([0.2, 0.5, 0.5, 0.9, float("nan")])) for g in range(20) for i in range(4) for j in range(4)]
    want = set()
    for g in range(20):
        used = set()
        for i in range(4):
            free = [(-s, j) for k, a, j, s in rows if k == g and a == i and s >= 0.45 and j not in used]
            if free:
                s, j = min(free)
                used.add(j)
                want.add((g, i, j, -s))
    out = evaluate.greedy_pairs(spark.createDataFrame(rows, "g long, l long, r long, score double"), "g", 0.45, left_id="l", right_id="r")
    assert {tuple(x) for x in out.collect()} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_a_round_of_a_run_tree_reads_what_has_no_place(spark, monkeypatch):
    seen = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: seen.append(stored(df, name)) or seen[-1])
    runs = spark.createDataFrame([(i, i - 1 if i % 10 else None, i) for i in range(100)], "run_id long, parent_id long, start int")
    out = graph.run_tree(runs, path=False)
    assert {(x["run_id"], x["trace_id"], x["depth"]) for x in out.collect()} == {(i, i - i % 10, i % 10) for i in range(100)}
    assert [df.count() for df in seen] == [100, 90, 80, 70, 60, 50, 40, 30, 20, 10, 0]
    assert "start" not in seen[0].columns and "__key" not in seen[0].columns
    whole = graph.run_tree(runs).where(F.col("run_id") == 1).first()
    assert whole["path"] == "00.11"


def test_a_round_of_answers_shuffles_tokens_once(spark, monkeypatch):
    """What a round stores is read from one join of the open questions with their tokens."""
    from docloom.operators import flare

    seen = []
    stored = flare.stored
    monkeypatch.setattr(flare, "stored", lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join "))) or stored(df, name))
    questions = spark.createDataFrame([(i, f"q{i}") for i in range(6)], "query_id long, question string")

    def generate(now):
        token = lambda pos, text, prob: F.struct(F.lit(pos).alias("pos"), text.alias("token"), F.lit(prob).alias("prob"))
        low = F.when(F.col("query_id") % 2 == 0, 0.1).otherwise(0.9)
        return now.select("query_id", F.inline(F.array(token(0, F.lit("a"), 0.9), F.struct(F.lit(1).alias("pos"), F.lit("b").alias("token"), low.alias("prob")), token(2, F.lit(" FINISHED"), 0.9))))

    found = lambda asked: asked.select("query_id", "span_no", F.concat("asked", F.lit(" found FINISHED")).alias("text"))
    out = flare.answered(questions, generate, lambda q, r, s: F.concat(q, F.lit(":"), s), found, lambda q, r, c: c, pad=0)
    assert {(r["query_id"], r["response"], r["rounds"], r["done"]) for r in out.collect()} == {(i, "ab" if i % 2 else f"q{i}:b found", 1, True) for i in range(6)}
    assert seen == [("round", 0), ("said", 1), ("asked", 0), ("round", 1)]


def test_pairs_of_a_table_in_one_part_are_spread(spark, monkeypatch):
    """No task has more pairs than its share, whatever files the rows lie in, and rows are shuffled once for all slices of queries."""
    monkeypatch.setattr(search, "FEW", 6)
    monkeypatch.setattr(search, "PAIRS", 60)
    r = random.Random(6)
    vectors = [[r.randrange(64) / 64, r.randrange(64) / 64] for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<double>").coalesce(1)
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    out = search.score_pairs(rows, asked, metrics=["l1", "ip"]).withColumn("task", F.spark_partition_id())
    got = out.collect()
    want = {(q, i, abs(v[0] - w[0]) + abs(v[1] - w[1])) for i, v in enumerate(vectors) for q, w in enumerate(vectors) if q % 10 == 0}
    assert len(got) == 1440 and {(x["query_id"], x["id"], x["l1"]) for x in got} == want
    each = [sum(x["task"] == t for x in got) for t in {x["task"] for x in got}]
    assert max(each) <= 60 and len(each) >= 24
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == plan.count("MapInArrow") - 1 > 0


def test_slices_of_queries_that_share_an_id(spark, monkeypatch):
    """Rows are sliced by a number of their own; by id, a slice of one id never became smaller."""
    monkeypatch.setattr(search, "FEW", 6)
    asked = spark.createDataFrame([(7, [float(i // 2), 1.0]) for i in range(20)] + [(None, [0.0, 0.0]), (8, None)], "query_id long, query_embedding array<double>")
    found = list(search.slices(asked, "query_id", "query_embedding"))
    assert all(len(ids) == len(v) <= 6 for ids, v in found)
    assert sorted((i, *x) for ids, v in found for i, x in zip(ids.to_pylist(), v.tolist(), strict=True)) == [(7, float(i // 2), 1.0) for i in range(20)]
