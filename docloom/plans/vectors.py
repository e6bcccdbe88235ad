"""Queries on vectors and ranked lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import vectors as V
from docloom.operators import fusion, search
from docloom.plans.catalogue import query
from docloom.session import table

_Q = "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _queries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def _top(sql_where: str, score: str, k: int, order: str = "DESC") -> str:
    return f"""{_Q}, s AS (SELECT query_id, vec_id, {score} AS score FROM q, e {sql_where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"""{_Q}, s AS (SELECT query_id, vec_id, list_cosine_similarity(v, qv) AS score FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return _rounded(search.top_k(e, q, row_id="vec_id", k=10).drop("rank"))


@query(_top("", "list_cosine_similarity(v, qv)", 4))
def vector_topk_multi(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return _rounded(search.top_k(e, q, row_id="vec_id"))


@query(_top("WHERE label = 1", "list_cosine_similarity(v, qv)", 4))
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return _rounded(search.top_k(e, q, row_id="vec_id", where=F.col("label") == 1))


@query(_top("", "list_distance(v, qv)", 4, "ASC"))
def vector_topk_euclidean(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return _rounded(search.top_k(e, q, row_id="vec_id", metric="l2"))


@query(_top("", "list_inner_product(v, qv)", 4))
def vector_topk_inner_product(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return _rounded(search.top_k(e, q, row_id="vec_id", metric="ip"))


@query(_top("WHERE list_cosine_similarity(v, qv) >= 0.2", "list_cosine_similarity(v, qv)", 20))
def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return _rounded(search.top_k(e, q, row_id="vec_id", k=20, threshold=0.2))


@query(_top("WHERE list_cosine_similarity(v, qv) > 0.3", "list_cosine_similarity(v, qv)", 20))
def embeddings_filter(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return _rounded(search.top_k(e, q, row_id="vec_id", k=20, threshold=0.3, strict=True))


@query(f"""{_Q}, s AS (SELECT query_id, vec_id, list_cosine_similarity(v, qv) AS score FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank BETWEEN 6 AND 10""")
def offset_paging(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return _rounded(search.top_k(e, q, row_id="vec_id", k=5, offset=5))


@query(f"""{_Q} SELECT query_id, vec_id, round(list_distance(v, qv), 6) AS l2,
round(list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - qv[i]))), 6) AS l1,
round(list_max(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - qv[i]))), 6) AS linf,
round(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN v[i] <> qv[i] THEN 1e0 ELSE 0e0 END)) / len(v), 6) AS hamming,
round(list_inner_product(v, qv), 6) AS ip FROM q, e""")
def vector_distances(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    names = ("l2", "l1", "linf", "hamming", "ip")
    return search.score_pairs(e, q, row_id="vec_id", metrics=names).withColumns({n: F.round(n, 6) for n in names})


@query(f"""{_Q}, s AS (SELECT query_id, vec_id, list_distance(v, qv) AS l2, list_cosine_similarity(v, qv) AS c, list_inner_product(v, qv) AS ip FROM q, e)
SELECT query_id, vec_id, round(1 - l2 / sqrt(2e0), 6) AS from_l2, round(1 - (1 - c), 6) AS from_cosine,
round(CASE WHEN ip > 0 THEN 1 - ip ELSE -ip END, 6) AS from_ip, round((c + 1) / 2, 6) AS scaled FROM s""")
def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    rows = search.score_pairs(e, q, row_id="vec_id", metrics=("l2", "cosine", "ip"))
    made = {"from_l2": V.euclidean_relevance("l2"), "from_cosine": V.cosine_relevance(1 - F.col("cosine")), "from_ip": V.inner_product_relevance("ip"), "scaled": V.scaled_cosine_relevance("cosine")}
    return rows.select("query_id", "vec_id", *(F.round(c, 6).alias(n) for n, c in made.items()))


@query("""SELECT label, dim - 1 AS dim, round(avg(embedding[dim]::DOUBLE), 6) AS value
FROM embeddings, range(1, 1 + (SELECT max(len(embedding)) FROM embeddings)) t(dim) GROUP BY label, dim""")
def vector_centroids(spark: SparkSession, d: str) -> DataFrame:
    return search.centroids(table(spark, d, "embeddings"), "label").withColumn("value", F.round("value", 6))


def mmr_sql(k: int, fetch: int, weight: float) -> str:
    """CTEs up to pick (query_id, vec_id, label, position): the greedy choice, a step at a time."""
    steps = [f"""{_Q}, near AS (SELECT query_id, vec_id, label, v, round(list_cosine_similarity(v, qv), 12) AS sim FROM q, e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= {fetch}),
pick1 AS (SELECT query_id, vec_id, label, v, 1 AS position FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) = 1)"""]
    for i in range(2, k + 1):
        steps.append(f"""most{i} AS (SELECT n.query_id, n.vec_id, any_value(n.label) AS label, any_value(n.v) AS v, any_value(n.sim) AS sim, max(list_cosine_similarity(n.v, p.v)) AS most FROM near n JOIN pick{i - 1} p ON p.query_id = n.query_id
GROUP BY n.query_id, n.vec_id HAVING bool_and(p.vec_id <> n.vec_id)),
pick{i} AS (SELECT * FROM pick{i - 1} UNION ALL (SELECT query_id, vec_id, label, v, {i} FROM most{i} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round({weight}e0 * sim - {1 - weight}e0 * most, 11) DESC, vec_id) = 1))""")
    return ",\n".join(steps)


@query(f"{mmr_sql(4, 20, 0.5)} SELECT query_id, vec_id, position FROM pick4")
def mmr_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return search.mmr_search(e, q, row_id="vec_id")


@query("""SELECT DISTINCT b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.5""")
def redundant_vectors(spark: SparkSession, d: str) -> DataFrame:
    return search.near_vectors(table(spark, d, "embeddings"), above=0.5, row_id="vec_id")


@query(f"""{_Q}, s AS (SELECT query_id, vec_id, list_cosine_similarity(v, qv) AS score FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), t AS (SELECT * FROM r WHERE rank <= 7)
SELECT query_id, vec_id, rank, (CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE 7 - rank // 2 + 1 END)::INT AS position FROM t""")
def long_context_order(spark: SparkSession, d: str) -> DataFrame:
    e, q = _queries(spark, d)
    return search.ends_first(search.top_k(e, q, row_id="vec_id", k=7).drop("score"), by=["query_id"])


_LISTS = """WITH w AS (SELECT doc_id, text, (length(text) - length(replace(text, 'the', ''))) / 3 AS n FROM documents), l AS (
SELECT 1 AS list_id, doc_id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM w UNION ALL
SELECT 2 AS list_id, doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS rank FROM w), t AS (SELECT * FROM l WHERE rank <= 20)"""


def _ranked_lists(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    one = search.term_count_top_k(docs, "the", k=20).select("doc_id", F.col("n").alias("by"), F.lit(1).alias("list_id"))
    two = docs.select("doc_id", F.length("text").cast("long").alias("by"), F.lit(2).alias("list_id")).orderBy(F.desc("by"), "doc_id").limit(20)
    return search.ranked(one.unionByName(two), ["list_id"], [F.desc("by"), F.col("doc_id")], 20).select("list_id", "doc_id", "rank")


@query(_LISTS + """ SELECT doc_id, round(sum(1e0 / (rank + 60)), 8) AS score FROM t GROUP BY doc_id""")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(_ranked_lists(spark, d), key="doc_id").select("doc_id", F.round("score", 8).alias("score"))


@query(_LISTS + """, s AS (SELECT doc_id, sum(CASE list_id WHEN 1 THEN 0.7e0 ELSE 0.3e0 END / (rank + 60)) AS score, min(list_id * 1000 + rank) AS f FROM t GROUP BY doc_id)
SELECT doc_id, round(score, 8) AS score, row_number() OVER (ORDER BY score DESC, f) AS position FROM s""")
def weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(_ranked_lists(spark, d), {1: 0.7, 2: 0.3}, key="doc_id").withColumn("score", F.round("score", 8))


@query(_LISTS + " SELECT list_id, doc_id, rank, row_number() OVER (ORDER BY rank, list_id) AS position FROM t")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    return fusion.interleave(_ranked_lists(spark, d))


@query("""SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3)::BIGINT AS n FROM documents ORDER BY n DESC, doc_id LIMIT 4""")
def term_count_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.term_count_top_k(table(spark, d, "documents"), "the")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
r AS (SELECT doc_id, len(w)::DOUBLE AS len, len(list_filter(w, lambda x: x = 'thandedble'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'anea'))::DOUBLE AS b FROM w),
f AS (SELECT count(*) AS n, avg(len) AS avgdl, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM r)
SELECT doc_id, round(ln(1 + (n - da + 0.5e0) / (da + 0.5e0)) * a * 2.2e0 / (a + 1.2e0 * (0.25e0 + 0.75e0 * len / avgdl)) + ln(1 + (n - db + 0.5e0) / (db + 0.5e0)) * b * 2.2e0 / (b + 1.2e0 * (0.25e0 + 0.75e0 * len / avgdl)), 6) AS score
FROM r, f WHERE a > 0 OR b > 0""")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), ["thandedble", "anea"]).withColumn("score", F.round("score", 6))


@query("""SELECT event_id, round(pow(0.99e0, (epoch_us(TIMESTAMP '2025-01-01 00:00:00') - epoch_us(ts)) / 3600e6) + coalesce(value, 0e0), 8) AS score FROM events""")
def time_decay_rank(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.round(fusion.decayed_score(F.col("ts"), F.lit("2025-01-01 00:00:00").cast("timestamp"), 0.01, None, F.col("value")), 8).alias("score"))
