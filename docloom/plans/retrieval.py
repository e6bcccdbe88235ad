"""Queries of retrievers, reranking, parents and parts, routes and model-backed filters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import vectors as V
from docloom.operators import models, retrieval, search
from docloom.plans.catalogue import query
from docloom.plans.vectors import _Q, mmr_sql
from docloom.session import table

_RANKED = f"""{_Q}, s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(v, qv), 12) AS score FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))


def _retriever(spark: SparkSession, d: str, kind: str = "similarity", **how) -> tuple[retrieval.Retriever, DataFrame]:
    e, q = _asked(spark, d)
    return retrieval.Retriever(e.withColumn("text", F.concat(F.lit("row "), "vec_id")), kind, "vec_id", how=how), q


@query(f"{_RANKED} SELECT query_id, vec_id, label, rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def retriever_similarity(spark: SparkSession, d: str) -> DataFrame:
    r, q = _retriever(spark, d, k=5)
    return r(q).select("query_id", "vec_id", "label", "rank", F.round("score", 6).alias("score"))


@query(f"{_RANKED} SELECT query_id, vec_id, rank FROM r WHERE rank <= 6 AND score >= 0.25")
def retriever_threshold(spark: SparkSession, d: str) -> DataFrame:
    r, q = _retriever(spark, d, "similarity_score_threshold", k=6, score_threshold=0.25)
    return r(q).select("query_id", "vec_id", "rank")


@query(f"{mmr_sql(3, 12, 0.3)} SELECT query_id, vec_id, position AS rank, label FROM pick3")
def retriever_mmr(spark: SparkSession, d: str) -> DataFrame:
    r, q = _retriever(spark, d, "mmr", k=3, fetch_k=12, weight=0.3)
    return r(q).select("query_id", "vec_id", "rank", "label")


@query(f"{_RANKED} SELECT query_id, string_agg('row ' || vec_id, chr(10) || chr(10) ORDER BY rank) AS content, count(*)::INT AS n FROM r WHERE rank <= 4 GROUP BY query_id")
def retriever_as_tool(spark: SparkSession, d: str) -> DataFrame:
    r, q = _retriever(spark, d)
    return r.as_tool(q)


@query(f"""{_RANKED}, t AS (SELECT * FROM r WHERE rank <= 20 AND score >= 0.1), n AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY (vec_id * 7919) % 1009 DESC, vec_id) AS rank FROM t)
SELECT query_id, vec_id, rank FROM n WHERE rank <= 3""")
def compressed_retrieval(spark: SparkSession, d: str) -> DataFrame:
    r, q = _retriever(spark, d, k=20)
    best = retrieval.reranked_by((F.col("vec_id") * 7919 % 1009).cast("double"), 3, row_id="vec_id")
    return r.then(retrieval.at_least(0.1), best)(q).select("query_id", "vec_id", "rank")


@query(f"{_RANKED} SELECT query_id, vec_id, (6 - rank)::INT AS rank FROM r WHERE rank BETWEEN 3 AND 5")
def listwise_rerank(spark: SparkSession, d: str) -> DataFrame:
    r, q = _retriever(spark, d, k=5)
    backwards = lambda texts: F.transform(F.sequence(F.size(texts), F.lit(-1)), lambda i: i)  # noqa: E731  (with numbers out of range)
    return r.then(retrieval.listwise(backwards, 3))(q).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


@query("""WITH c AS (SELECT doc_id AS parent_id, lang, i::INT - 1 AS part_no, string_split(text, chr(10))[i] AS text FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i))
SELECT parent_id || ':' || part_no AS doc_id, parent_id, lang, part_no, text FROM c""")
def parent_parts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return retrieval.children(docs, F.split("text", "\n"))


@query("""WITH c AS (SELECT doc_id AS parent_id, i, string_split(text, chr(10))[i] AS t FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
h AS (SELECT *, row_number() OVER (ORDER BY length(t) DESC, parent_id, i) AS rank FROM c), f AS (SELECT parent_id, min(rank) AS rank FROM h WHERE rank <= 100 GROUP BY parent_id)
SELECT 0 AS query_id, f.parent_id, rank, source FROM f JOIN documents d ON d.doc_id = f.parent_id""")
def parents_of_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    parts = retrieval.children(docs.drop("source"), F.split("text", "\n")).withColumn("query_id", F.lit(0))
    hits = search.ranked(parts.orderBy(F.desc(F.length("text")), "parent_id", "part_no").limit(100), ["query_id"], [F.desc(F.length("text")), F.col("parent_id"), F.col("part_no")], 100)
    return retrieval.with_parents(hits, docs.select(F.col("doc_id").alias("parent_id"), "source")).select("query_id", "parent_id", "rank", "source")


@query("""WITH r AS (SELECT vec_id AS route_id, embedding::DOUBLE[] AS rv FROM embeddings ORDER BY vec_id LIMIT 7),
s AS (SELECT e.vec_id, route_id, round(list_cosine_similarity(e.embedding::DOUBLE[], rv), 12) AS score FROM embeddings e, r),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, route_id) AS n FROM s) SELECT vec_id, route_id, round(score, 6) AS score FROM b WHERE n = 1""")
def nearest_route(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    routes = e.orderBy("vec_id").limit(7).select(F.col("vec_id").alias("route_id"), "embedding")  # seven routes, whatever the rows
    return models.nearest_route(e, routes, row_id="vec_id").withColumn("score", F.round("score", 6))


@query("SELECT doc_id FROM documents WHERE contains(text, 'tion')")
def model_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text").where("text IS NOT NULL")
    return models.filtered(docs, "{text}", models.canned({"tion": "YES"}, "NO")).select("doc_id")


@query("SELECT doc_id, 'about ' || lang AS text FROM documents WHERE lang <> 'en'")
def model_extract(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    short = lambda prompt: F.when(prompt == "en", " ").otherwise(F.concat(F.lit("about "), prompt))
    return models.extracted(docs, "{lang}", short).select("doc_id", "text")


@query(f"""{_Q}, v AS (SELECT query_id, variant, CASE variant WHEN 0 THEN qv ELSE list_transform(qv, lambda x: -x) END AS qv FROM q, range(0, 2) t(variant)),
s AS (SELECT query_id, variant, vec_id, round(list_cosine_similarity(e.v, v.qv), 12) AS score FROM v, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id::VARCHAR AS query_id, vec_id, min(rank) AS rank FROM r WHERE rank <= 4 GROUP BY query_id, vec_id""")
def multi_query(spark: SparkSession, d: str) -> DataFrame:
    e, q = _asked(spark, d)
    variants = q.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    turned = F.when(F.col("variant") == 0, F.col("query_embedding").cast("array<double>")).otherwise(F.transform(F.col("query_embedding").cast("array<double>"), lambda x: -x))
    return models.multi_query(e, variants, turned, row_id="vec_id")


@query(f"{_RANKED} SELECT query_id, 'row ' || max(CASE WHEN rank = 1 THEN vec_id END) || chr(10) || chr(10) || 'row ' || max(CASE WHEN rank = 2 THEN vec_id END) || chr(10) || chr(10) || 'Question: q' || query_id AS answer FROM r WHERE rank <= 2 GROUP BY query_id")
def retrieval_answers(spark: SparkSession, d: str) -> DataFrame:
    r, q = _retriever(spark, d, k=2)
    return models.answered(q.select("query_id", F.concat(F.lit("q"), "query_id").alias("question")), r(q), models.echo()).select("query_id", "answer")


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 6), lambda i: CASE WHEN i % 2 = 1 THEN embedding[i]::DOUBLE * i ELSE 0e0 END)), 6) AS product FROM embeddings")
def sparse_products(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    sparse = lambda places, values: F.struct(F.array(*map(F.lit, places)).alias("indices"), values.alias("values"))
    own = F.slice(F.col("embedding").cast("array<double>"), 1, 5)
    df = e.select("vec_id", sparse([1, 2, 3, 4, 5], own).alias("a"), sparse([1, 3, 5, 9], F.array(*map(F.lit, (1.0, 3.0, 5.0, 9.0)))).alias("b"))
    return df.select("vec_id", F.round(V.sparse_dot("a", "b"), 6).alias("product"))


@query("""WITH p AS (SELECT p_partkey, p_type, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25), p_partkey) AS rank, p_brand AS query_id FROM part) SELECT query_id, p_partkey, rank FROM p WHERE rank <= 3""")
def cross_encoder_rerank(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "part").select(F.col("p_brand").alias("query_id"), "p_partkey", "p_size")
    return search.rerank(pairs, -F.abs(F.col("p_size") - 25), row_id="p_partkey").select("query_id", "p_partkey", "rank")




@query("SELECT n_name, 'Capital of ' || n_name || ' in ' || r_name || '?' AS prompt FROM nation JOIN region ON r_regionkey = n_regionkey")
def named_prompts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", X.template("Capital of {n_name} in {place}?", place="r_name").alias("prompt"))
