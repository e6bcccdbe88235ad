"""Queries of structured answers to searches, examples, images, logs, decisions, to-do lists, generators and streamed XML."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.functions import web
from docloom.operators import agents, algebra, filters, messages, models, retrieval, split
from docloom.plans.catalogue import query
from docloom.plans.retrieval import _RANKED, _asked
from docloom.session import fresh_path, table
from docloom.sources import tables
from docloom.streaming import patches


@query(_RANKED.replace("FROM q, e)", "FROM q, e WHERE label IN (1, 2, 3))") + " SELECT query_id, vec_id, rank FROM r WHERE rank <= 3")
def self_query(spark: SparkSession, d: str) -> DataFrame:
    e, q = _asked(spark, d)
    asked = filters.from_answer('```json\n{"query": "", "filter": "in(\\"label\\", [1, 2, 3])", "limit": 3}\n```', e.columns)
    return filters.self_query(e, q, asked, k=10, row_id="vec_id").select("query_id", "vec_id", "rank")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS text FROM nation WHERE n_regionkey > 0 ORDER BY n_nationkey LIMIT 10 OFFSET 2")
def dataset_examples(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.struct(F.struct(F.col("n_name").alias("name")).alias("of"), "n_regionkey").alias("inputs"))
    return tables.examples(n, "inputs.of.name", key="n_nationkey", where=F.col("inputs.n_regionkey") > 0, limit=10, offset=2).select("id", "text")


@query("SELECT n_name AS content, 1 AS n FROM nation")
def image_rows(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "images")
    n = table(spark, d, "nation").select("n_name")
    n.repartitionByRange(n.count(), "n_name").write.text(path)
    rows = tables.images(spark, path, "*.txt").where("length(text) > 0").withColumn("content", F.explode(F.split(F.decode(F.unbase64("text"), "UTF-8"), "\n"))).where("content <> ''")
    return rows.groupBy("content").agg(F.count_distinct(F.element_at("metadata", F.lit("uri"))).cast("int").alias("n"))


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id % 3 <> 0")
def document_store(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))
    store = tables.document_store(tables.KeyedStore(spark, fresh_path(spark, "store"))).set(docs, "doc_id", ["text", "metadata"])
    store = store.delete(docs.where("doc_id % 3 = 0"), "doc_id")
    return store.get(docs.select("doc_id"), "doc_id").where("text IS NOT NULL").select("doc_id", "text", F.element_at("metadata", F.lit("lang")).alias("lang"))


@query("SELECT event_id::VARCHAR || ' ' || event_type || ' ' || user_id AS value FROM events")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "log")
    e = table(spark, d, "events").withColumn("data", F.lit(None).cast("string"))
    tables.write_log(e, path, time="event_id", event="event_type", run="user_id")
    return spark.read.text(path)


@query("SELECT doc_id, CASE WHEN contains(text, 'tion') THEN 'withheld' ELSE text END AS text FROM documents")
def moderated_texts(spark: SparkSession, d: str) -> DataFrame:
    return models.moderated(table(spark, d, "documents").select("doc_id", "text"), lambda t: F.contains(t, F.lit("tion")), message="withheld")


@query("""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN (SELECT string_agg(CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'AI' WHEN 'system' THEN 'System' ELSE role END || ': ' || text, chr(10) ORDER BY turn) FROM conversations b WHERE b.conv_id = a.conv_id) || chr(10) || 'Follow up: why ' || conv_id ELSE 'why ' || conv_id END AS question
FROM (SELECT DISTINCT conv_id FROM conversations) a""")
def standalone_questions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    asked = c.select("conv_id").distinct().withColumn("question", F.concat(F.lit("why "), F.col("conv_id").cast("string")))
    return models.standalone(asked, messages.transcript(c.where("conv_id % 2 = 0")), models.echo()).select("conv_id", "question")


@query(_RANKED + """, h AS (SELECT query_id, 'l' || label AS source, min(rank) AS r FROM r WHERE rank <= 4 GROUP BY 1, 2) SELECT query_id, 'a' AS answer, string_agg(source, ', ' ORDER BY r) AS sources FROM h GROUP BY query_id""")
def answers_with_sources(spark: SparkSession, d: str) -> DataFrame:
    e, q = _asked(spark, d)
    hits = retrieval.Retriever(e, row_id="vec_id")(q).withColumn("source", F.concat(F.lit("l"), F.col("label").cast("string")))
    return models.with_sources(q.select("query_id", F.lit("a").alias("answer")), hits)


@query(_RANKED + " SELECT query_id, string_agg(vec_id || ':' || label, ' ' ORDER BY rank) AS examples FROM r WHERE rank <= 3 GROUP BY query_id")
def chosen_examples(spark: SparkSession, d: str) -> DataFrame:
    e, q = _asked(spark, d)
    got = retrieval.chosen_examples(retrieval.Retriever(e, row_id="vec_id", how={"k": 3}), q, ["vec_id", "label"])
    return got.select("query_id", F.array_join(F.transform("examples", lambda x: F.concat_ws(":", x["vec_id"].cast("string"), x["label"].cast("string"))), " ").alias("examples"))


@query("""WITH p AS (SELECT doc_id || ':' || (i - 1) AS part, length(string_split(text, chr(10))[i]) AS n FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)),
q AS (SELECT doc_id AS query_id, length(text) // 10 AS n FROM documents WHERE doc_id % 20 = 0), r AS (SELECT query_id, part, row_number() OVER (PARTITION BY query_id ORDER BY abs(p.n - q.n), part) AS rank FROM p, q) SELECT query_id, part, rank FROM r WHERE rank <= 2""")
def indexed_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = retrieval.indexed(docs, F.split("text", "\n"), lambda t: F.array(F.length(t).cast("double")), k=2, metric="l2")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.array(F.floor(F.length("text") / 10).cast("double")).alias("query_embedding"))
    return index(asked).select("query_id", F.col("doc_id").alias("part"), "rank")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'find,ask' ELSE 'say,ask' END AS tools FROM events")
def selected_tools(spark: SparkSession, d: str) -> DataFrame:
    chosen = F.when(F.col("event_type") == "click", F.array(*map(F.lit, ("nothing", "find", "say")))).otherwise(F.array(*map(F.lit, ("say", "ask", "find"))))
    return agents.allowed_tools(table(spark, d, "events").select("event_id", "event_type"), chosen, ["find", "say", "ask"], 1, ("ask",)).select("event_id", F.array_join("tools", ",").alias("tools"))


@query("SELECT event_id AS call_id, CASE event_id % 4 WHEN 1 THEN 'new' ELSE event_type END AS args, event_id % 4 <> 2 AS run, CASE WHEN event_id % 4 = 2 THEN 'rejected' END AS message FROM events WHERE event_id % 4 <> 3")
def decided_calls(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    decision = F.when(F.col("event_id") % 4 == 0, "approve").when(F.col("event_id") % 4 == 1, "edit").otherwise("reject")
    decisions = e.where("event_id % 4 <> 3").select(F.col("event_id").alias("call_id"), decision.alias("decision"), F.lit("new").alias("args"), F.lit(None).cast("string").alias("message"))
    return agents.decided(e.select(F.col("event_id").alias("call_id"), F.col("event_type").alias("args")), decisions).select("call_id", "args", "run", "message")


@query("""WITH s AS (SELECT DISTINCT user_id AS run_id, event_type AS item FROM events), c AS (SELECT user_id AS run_id, event_type AS item, max_by(CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' ELSE 'completed' END, event_id) AS status FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2)
SELECT s.run_id, s.item, coalesce(c.status, 'pending') AS status FROM s LEFT JOIN c ON c.run_id = s.run_id AND c.item = s.item""")
def todo_lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("item"), F.col("event_id").alias("step"))
    status = F.when(F.col("step") % 3 == 0, "pending").when(F.col("step") % 3 == 1, "in_progress").otherwise("completed")
    return agents.todos(e.select("run_id", "item").distinct().withColumn("status", F.lit("pending")), e.where("step % 2 = 0").withColumn("status", status))


@query("SELECT n_nationkey, i::INT AS n, n_name || i AS name FROM nation, LATERAL (SELECT unnest(range(0, n_regionkey)) AS i)")
def generated_rows(spark: SparkSession, d: str) -> DataFrame:
    def some(row):
        for i in range(row["n_regionkey"]):
            yield {"n_nationkey": row["n_nationkey"], "n": i, "name": f"{row['n_name']}{i}"}

    return algebra.generator(some, "n_nationkey int, n int, name string")(table(spark, d, "nation"))


@query("SELECT n_nationkey, n_name || '-' || 3 AS v FROM nation")
def loaded_chain(spark: SparkSession, d: str) -> DataFrame:
    known = {"mark": lambda n: algebra.assign(v=F.concat("n_name", F.lit(f"-{n}")))}
    return algebra.loaded(algebra.dumped("mark", n=3), known)(table(spark, d, "nation")).select("n_nationkey", "v")


@query("SELECT n_nationkey AS run_id, 1 AS seq, 0 AS item_no, 'nation/name' AS path, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 2, 1, 'nation/in/region', n_regionkey::VARCHAR FROM nation")
def streamed_xml(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array(F.concat(F.lit("<nation><name>"), F.substring("n_name", 1, 2)), F.concat(F.expr("substring(n_name, 3)"), F.lit("</name><in><reg")), F.concat(F.lit("ion>"), F.col("n_regionkey").cast("string"), F.lit("</region></in><open>")))
    chunks = table(spark, d, "nation").select(F.col("n_nationkey").alias("run_id"), F.posexplode(parts).alias("seq", "text"))
    return patches.xml_elements(chunks)


@query("SELECT user_id AS run_id, count(*) AS n, min_by(event_type, ts) AS first FROM (SELECT user_id, event_type, epoch_us(ts)::VARCHAR || '-' || lpad(event_id::VARCHAR, 12, '0') AS ts FROM events) GROUP BY user_id")
def collected_runs(spark: SparkSession, d: str) -> DataFrame:
    order = F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), order.alias("ts"), "event_type")
    return patches.collected(e).select("run_id", "n", F.col("events")[0]["event_type"].alias("first"))


@query("SELECT n_nationkey, '<h1>' || n_name || '</h1><h2>sub</h2><p style=\"font-size: 9px\">text</p>' AS page FROM nation")
def headers_by_size(spark: SparkSession, d: str) -> DataFrame:
    page = X.template('<span style="color: red; font-size: 30px">{n_name}</span><div style="font-size:15pt">sub</div><p style="font-size: 9px">text</p>')
    return table(spark, d, "nation").select("n_nationkey", web.text_udf(web.headers_by_size)(page).alias("page"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+|\s+') AS w FROM documents), s AS (SELECT doc_id, w, i FROM t, LATERAL (SELECT unnest(range(0, greatest(len(w) - 5, 1), 35)) AS i) WHERE len(w) > 0)
SELECT doc_id, (i // 35)::INT AS chunk_no, array_to_string(w[i + 1:i + 40], '') AS chunk FROM s""")
def tokenizer_chunks(spark: SparkSession, d: str) -> DataFrame:
    import re

    cut = lambda t: split.by_tokens(t, lambda x: re.findall(r"\S+|\s+", x), "".join, 40, 5)
    return table(spark, d, "documents").select("doc_id", F.posexplode(split.split_column("text", cut)).alias("chunk_no", "chunk"))
