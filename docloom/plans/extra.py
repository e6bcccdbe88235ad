"""Queries of parsing, keys, sets, memories and small scores."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import fusion, indexing, merge, messages, search
from docloom.plans.catalogue import query
from docloom.session import table
from docloom.streaming import events as E


@query("""WITH s AS (SELECT 'ns' || event_id % 2 AS namespace, event_id::VARCHAR AS key, event_type AS group_id, value AS updated_at FROM events)
SELECT key FROM s WHERE namespace = 'ns0' AND updated_at < 80 AND updated_at > 20 AND group_id IN ('click', 'view')""")
def list_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    state = e.select(F.concat(F.lit("ns"), (F.col("event_id") % 2).cast("string")).alias("namespace"), F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("group_id"), F.col("value").alias("updated_at"))
    return indexing.list_keys(state, "ns0", before=80.0, after=20.0, group_ids=["click", "view"])


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND (user_id % 3 = 0 OR user_id % 5 = 0)")
def filter_events(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("user_id") % 3 == 0, "three"), F.when(F.col("user_id") % 5 == 0, "five")))
    e = table(spark, d, "events").withColumn("tags", tags)
    return e.where(F.col("event_type").isin("click", "purchase") & F.arrays_overlap("tags", F.array(F.lit("three"), F.lit("five")))).select("event_id")


@query("""SELECT e.event_id, c.value AS answer FROM events e LEFT JOIN (SELECT user_id, event_type, max(value) AS value FROM events WHERE event_id % 2 = 0 GROUP BY user_id, event_type) c ON c.user_id = e.user_id AND c.event_type = e.event_type""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    cache = e.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max("value").alias("answer"))
    return e.select("event_id", "user_id", "event_type").join(cache, ["user_id", "event_type"], "left").select("event_id", "answer")


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, coalesce(b.s, a.s) AS s FROM (SELECT c_custkey, c_mktsegment AS s FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'new' END AS s FROM customer WHERE c_custkey % 3 = 0) b ON a.c_custkey = b.c_custkey""")
def merge_old_and_new(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("s"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 6 != 0, F.lit("new")).alias("s"))
    return merge.coalesced(old, new, ["c_custkey"])


@query("""WITH x AS (SELECT label, i - 1 AS dim, sum(embedding[i]::DOUBLE * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1) AS m FROM embeddings, range(1, 1 + (SELECT max(len(embedding)) FROM embeddings)) t(i) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(m * m)) AS n FROM x GROUP BY label) SELECT x.label, dim::INT AS dim, round(m / n, 6) AS value FROM x JOIN n ON n.label = x.label""")
def weighted_mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("w", F.col("vec_id") % 5 + 1)
    mean = search.weighted_mean_vectors(e, "label", "embedding", "w")
    return mean.select("label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("""WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(lower(p_type), ' '), lambda x: x <> '')) AS b FROM part)
SELECT p_partkey, CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE END AS overlap FROM w""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.token_overlap("p_name", "p_type").alias("overlap"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> ''), '|') AS words, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 1) AS name, regexp_extract(p_brand, '([A-Za-z]+)#?([0-9]*)', 2) AS number FROM part""")
def parsed_lists(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("f", X.regex_fields("p_brand", "([A-Za-z]+)#?([0-9]*)", ["name", "number"]))
    return p.select("p_partkey", F.array_join(X.comma_list(F.replace("p_type", F.lit(" "), F.lit(","))), "|").alias("words"), "f.name", "f.number")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS n_lines, 'ns' || sha256(text) AS cache_key FROM documents")
def lines_and_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(X.line_list("text")).alias("n_lines"), F.concat(F.lit("ns"), F.sha2("text", 256)).alias("cache_key"))


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS parsed, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("t", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", F.to_timestamp_ntz("t", F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("parsed"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 END AS grade, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS choice, (event_id % 10 + 1) / 10e0 AS score, least(pow(2e0, event_id % 9), 60e0) AS delay FROM events""")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    three = F.col("event_id") % 3
    grade = F.when(three == 0, "well. GRADE: CORRECT").when(three == 1, "no: INCORRECT").otherwise("?")
    choice = F.when(three == 0, "x [[A]]").when(three == 1, "[[A]] then [[B]]").otherwise("none")
    score = F.concat(F.lit("is [["), (F.col("event_id") % 10 + 1).cast("string"), F.lit("]]"))
    return e.select("event_id", X.grade(grade).alias("grade"), X.pairwise_choice(choice).alias("choice"), X.bracket_score(score, 10).alias("score"), X.backoff(F.col("event_id") % 9).alias("delay"))


@query("SELECT c_custkey, 'a' || c_custkey % 3 || ' ' || c_mktsegment AS text FROM customer")
def examples_to_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    m = F.create_map(F.lit("z"), F.col("c_mktsegment"), F.lit("b"), F.concat(F.lit("a"), (F.col("c_custkey") % 3).cast("string")))
    return c.select("c_custkey", X.values_by_key(m).alias("text"))


@query("SELECT user_id, min(ts) FILTER (WHERE event_type = 'click') AS started, min(ts) FILTER (WHERE event_type = 'purchase') AS ended, (epoch_us(min(ts) FILTER (WHERE event_type = 'purchase')) - epoch_us(min(ts) FILTER (WHERE event_type = 'click'))) / 1e6 AS seconds FROM events GROUP BY user_id")
def run_durations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("event", F.when(F.col("event_type") == "click", "x_start").when(F.col("event_type") == "purchase", "x_end").otherwise("x_stream"))
    return E.durations(e, run="user_id")


@query("""SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn DESC) > 1 THEN '[cleared]' ELSE text END AS text FROM conversations""")
def cleared_results(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")))
    out = messages.clear_old_tool_results(c, 1)
    return out.select("conv_id", "turn", F.when(F.col("role") == "tool", "assistant").otherwise(F.col("role")).alias("role"), "text")


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS call_id, text FROM conversations WHERE role = 'user'), r AS (SELECT conv_id * 1000 + turn - 1 AS call_id, text AS result FROM conversations WHERE role = 'assistant')
SELECT c.call_id, text, result FROM c LEFT JOIN r ON r.call_id = c.call_id""")
def paired_calls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    key = lambda less: (F.col("conv_id") * 1000 + F.col("turn") - less).alias("call_id")
    return messages.pair_calls(t.where("role = 'user'").select(key(0), "text"), t.where("role = 'assistant'").select(key(1), F.col("text").alias("result")))


@query("""WITH r AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS recent, row_number() OVER (ORDER BY value DESC, event_id) AS salient FROM events)
SELECT event_id, round(pow(0.99e0, (epoch_us(TIMESTAMP '2025-01-01 00:00:00') - epoch_us(ts)) / 3600e6) + CASE WHEN salient <= 10 THEN value ELSE 0e0 END, 6) AS score FROM r WHERE recent <= 10 OR salient <= 10""")
def recent_or_salient(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", "value")
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    salient = e.orderBy(F.desc("value"), "event_id").limit(10).withColumn("relevance", F.col("value"))
    recent = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).withColumn("relevance", F.lit(0.0))
    both = fusion.union_all(salient, recent).groupBy("event_id", "ts").agg(F.max("relevance").alias("relevance"))
    return both.select("event_id", F.round(fusion.decayed_score(F.col("ts"), now, 0.01, F.col("relevance")), 6).alias("score"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    by = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey")
    return by("F").intersect(by("O")).subtract(by("P"))
