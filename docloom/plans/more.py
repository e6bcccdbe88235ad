"""Queries of merging, graphs, pages and models."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import web
from docloom.operators import algebra, graph, merge, models, search
from docloom.plans.catalogue import query
from docloom.session import table


@query("SELECT event_type, sum(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 10 END, 0))::BIGINT AS usage_input, sum(event_id % 7)::BIGINT AS usage_output FROM events GROUP BY event_type")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    usage = F.struct(F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 10).alias("input"), (F.col("event_id") % 7).alias("output"))
    return merge.usage_totals(e.select("event_type", usage.alias("usage")), ["event_type"], ["usage.input", "usage.output"])


@query("SELECT event_id, greatest(coalesce(event_id % 10, 0) - coalesce(event_id % 7, 0), 0)::BIGINT AS rest FROM events")
def usage_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", merge.usage_less(F.col("event_id") % 10, F.col("event_id") % 7).alias("rest"))


@query("""SELECT lang, key, string_agg(v, ', ' ORDER BY doc_id) AS value FROM (SELECT lang, doc_id, 'source' AS key, source AS v FROM documents UNION ALL SELECT lang, doc_id, 'n_chars', n_chars::VARCHAR FROM documents) GROUP BY lang, key""")
def collapsed_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("metadata", F.create_map(F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string")))
    return merge.collapsed_metadata(docs, ["lang"], "doc_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 9 = 0 UNION ALL SELECT 2000000, 'added'""")
def map_update(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    new = c.where("c_custkey % 9 = 0 OR c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, F.lit("new")).alias("c_name"))
    return merge.right_wins(c, new.unionByName(spark.createDataFrame([(2000000, "added")], "c_custkey long, c_name string")), "c_custkey", "c_name")


@query("""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) SELECT user_id, event_id, value FROM r WHERE n = 1""")
def map_rerank(spark: SparkSession, d: str) -> DataFrame:
    return merge.best_answer(table(spark, d, "events"), ["user_id"], "event_id", "value", "event_id")


@query("SELECT doc_id, n_chars, CASE WHEN n_chars % 2 = 0 THEN 'cached' ELSE 'computed' END AS origin FROM documents")
def cached_values(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    known = docs.where("n_chars % 2 = 0").select("n_chars").distinct().withColumn("origin", F.lit("cached"))
    return merge.cached(docs, known, ["n_chars"], "origin", lambda m: m.withColumn("origin", F.lit("computed")))[0].select("doc_id", "n_chars", "origin")


@query("""WITH RECURSIVE t AS (SELECT event_id, event_id AS trace_id, 0 AS depth FROM events WHERE event_id % 8 = 0
UNION ALL SELECT e.event_id, t.trace_id, t.depth + 1 FROM events e JOIN t ON t.event_id = (e.event_id - 1) WHERE e.event_id % 8 <> 0) SELECT event_id, trace_id, depth FROM t""")
def run_tree(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 8 != 0, F.col("event_id") - 1).alias("parent_id"), "ts")
    return graph.run_tree(e, run="event_id", parent="parent_id", order="ts", path=False).select("event_id", "trace_id", "depth")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) > 1 THEN p_brand || '_' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) ELSE p_brand END AS new_id FROM part")
def readable_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.readable_ids(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))).select(F.col("id").alias("p_partkey"), "new_id")


@query("SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_nationkey % 4 <> 0 AND b.n_nationkey % 4 <> 0")
def graph_without_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("source"), "n_regionkey", F.col("n_nationkey").alias("x")), n.select(F.col("n_name").alias("target"), "n_regionkey", F.col("n_nationkey").alias("y"))
    edges = a.join(b, "n_regionkey").where("x < y").select("source", "target")
    return graph.without_nodes(n.select(F.col("n_name").alias("id")), edges, n.where("n_nationkey % 4 = 0").select(F.col("n_name").alias("id")))[1]


@query()
def absolute_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(web.absolute_links_column("html", "url", outside=True)).alias("link"))


@query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", web.text_udf(web.to_markdown)("html").alias("text"))


@query()
def folded_json(spark: SparkSession, d: str) -> DataFrame:
    return merge.folded_json(table(spark, d, "events"), "user_id", "event_id", "props")


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, floor(epoch(ts))::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
f AS (SELECT event_id, user_id, sec, n, 1e0 AS rest, true AS allowed FROM r WHERE n = 1 UNION ALL
SELECT r.event_id, r.user_id, r.sec, r.n, h.have - CASE WHEN h.have >= 1 THEN 1 ELSE 0 END, h.have >= 1 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1, LATERAL (SELECT least(2e0, f.rest + (r.sec - f.sec) * (1 / 3600e0)) AS have) h)
SELECT event_id, allowed FROM f""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
    return merge.rate_limited(e.select("event_id", "user_id", "at"), 1 / 3600, 2, by="user_id", time="at", order="event_id").select("event_id", "allowed")


@query()
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    return models.cluster_representatives(table(spark, d, "embeddings"), 5, row_id="vec_id").select("cluster", "vec_id")


@query("SELECT event_id, event_type, CASE event_type WHEN 'click' THEN value * 2 WHEN 'view' THEN -value ELSE 0e0 END AS routed, try_cast(json_extract_string(props, '$.none') AS INT) IS NULL AS missing FROM events")
def route_by_key(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", algebra.route("event_type", {"click": F.col("value") * 2, "view": -F.col("value")}, F.lit(0.0)).alias("routed"), F.get_json_object("props", "$.none").isNull().alias("missing"))


@query("SELECT n_regionkey, n_nationkey, count(*)::BIGINT AS n, grouping(n_regionkey)::INT AS g FROM nation GROUP BY CUBE (n_regionkey, n_nationkey)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").cube("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"), F.grouping("n_regionkey").cast("int").alias("g"))
