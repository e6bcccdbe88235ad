"""Queries of sources, stores, sinks, splitters of markup, graphs and contracts."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import personal, text as X, web
from docloom.operators import filters, graph, indexing, markup, split
from docloom.plans.catalogue import query
from docloom.sources.record_log import Records
from docloom.session import fresh_path, table
from docloom.sources import tables


def _written(df: DataFrame, kind: str, **options) -> str:
    path = fresh_path(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return path


@query("SELECT n_name AS line FROM nation")
def line_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.lines(spark, _written(table(spark, d, "nation").select("n_name"), "text")).select("line")


@query("SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS text, true AS sourced FROM nation GROUP BY n_regionkey")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n")
    path = _written(n.groupBy("n_regionkey").agg(parts.alias("t")).repartitionByRange(25, "n_regionkey").select("t"), "text")
    files = tables.text_files(spark, path, glob="*.txt").where("length(text) > 0")
    return files.select("text", F.contains(F.element_at("metadata", F.lit("source")), F.lit(".txt")).alias("sourced"))


@query("SELECT 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey AS text FROM nation")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return tables.csv_documents(spark, _written(n, "csv", header=True), n.schema).select("text")


@query("SELECT 'text/csv' AS mime_type, 'csv' AS extension, count(*) > 0 AS found FROM nation")
def blob_kinds(spark: SparkSession, d: str) -> DataFrame:
    blobs = tables.blobs(spark, _written(table(spark, d, "nation").coalesce(1), "csv"), glob="*.csv")
    known = blobs.where(tables.sniffed("content") == "unknown").select("mime_type", F.regexp_extract("path", r"\.(\w+)$", 1).alias("extension"))
    return known.groupBy("mime_type", "extension").agg((F.count("*") > 0).alias("found"))


@query("SELECT n_nationkey, n_name FROM nation")
def blob_text(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.encode("n_name", "UTF-16").alias("content"))
    return n.select("n_nationkey", tables.decoded("content", "UTF-16").alias("n_name"))


@query("SELECT n_name AS text FROM nation")
def json_scan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return tables.json_documents(spark, _written(n, "json"), "n_name", n.schema, multi_line=False).select("text")


@query("SELECT n_nationkey, n_name FROM nation")
def xml_scan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return tables.xml_rows(spark, _written(n, "xml", rowTag="nation"), "nation", n.schema)


@query("SELECT n_name AS text, n_regionkey::VARCHAR AS region, 'nations' AS source FROM nation")
def table_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.documents(table(spark, d, "nation"), "n_name", F.lit("nations"), "n_nationkey")
    return docs.select("text", F.element_at("metadata", F.lit("n_regionkey")).alias("region"), F.element_at("metadata", F.lit("source")).alias("source"))


@query("SELECT n_name AS line FROM nation WHERE regexp_matches(n_name, '^[A-M].*A$')")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return tables.grep(tables.lines(spark, _written(table(spark, d, "nation").select("n_name"), "text")), "^[A-M].*A$").select("line")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' || c_custkey ELSE c_name END AS value FROM customer WHERE c_custkey % 5 <> 0")
def keyed_store(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    row = lambda v: c.select(F.col("c_custkey").cast("string").alias("key"), F.encode(v, "UTF-8").alias("value"), "c_custkey")
    store = tables.KeyedStore(spark, fresh_path(spark, "store")).set(row(F.col("c_name")).drop("c_custkey"))
    store = store.set(row(F.concat(F.lit("new"), F.col("c_custkey").cast("string"))).where("c_custkey % 3 = 0").drop("c_custkey"))
    store = store.delete(row(F.col("c_name")).where("c_custkey % 5 = 0").select("key"))
    return store.rows().select(F.col("key").cast("long").alias("key"), F.decode("value", "UTF-8").alias("value"))


@query("SELECT c_custkey FROM customer WHERE starts_with(c_custkey::VARCHAR, '1')")
def store_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.encode("c_name", "UTF-8").alias("value"))
    return tables.KeyedStore(spark, fresh_path(spark, "store")).set(rows).keys("1").select(F.col("key").cast("long").alias("c_custkey"))


@query("SELECT o.o_orderkey, c_name, c_acctbal FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_custkey % 4 <> 0")
def encoded_store(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    store = tables.EncodedStore(tables.KeyedStore(spark, fresh_path(spark, "store")), "c_name string, c_acctbal double").set(c, "c_custkey", ["c_name", "c_acctbal"])
    store = store.delete(c.where("c_custkey % 4 = 0"), "c_custkey")
    return store.get(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "c_custkey").drop("c_custkey")


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_table_dump(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    path = fresh_path(spark, "vectors")
    tables.dump_vectors(e, path)
    got = tables.load_vectors(spark, path, e.schema)
    return got.select("vec_id", "label", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT 'old' AS side, count(*) AS n FROM customer UNION ALL SELECT 'fork', count(*) FROM customer WHERE c_custkey % 2 = 1")
def forked_collection(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    fork = tables.delete(tables.forked(c, fresh_path(spark, "fork")), c.where("c_custkey % 2 = 0"), "c_custkey")
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(c, "old").unionByName(count(fork, "fork"))


@query("SELECT n_nationkey, n_name AS plain, '{\"k\":' || n_nationkey || ',\"r\":' || n_regionkey || '}' AS nested, n_nationkey::VARCHAR AS number FROM nation")
def stringified(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("s", F.struct(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")))
    text = lambda c: tables.stringified(F.col(c), dict(n.dtypes)[c])
    return n.select("n_nationkey", text("n_name").alias("plain"), text("s").alias("nested"), text("n_nationkey").alias("number"))


@query("""SELECT '| ' || r_name || ' | ' || count(*) || ' |' AS value FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name UNION ALL SELECT * FROM (VALUES ('# Regions'), (''), ('| r_name | n |'), ('|---|---|'))""")
def written_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    path = fresh_path(spark, "report")
    tables.write_report(rows, path, "Regions")
    return spark.read.text(f"{path}/markdown")


@query("SELECT n_name, '<p>of ' || n_name || '</p>' || chr(10) || '<table><tr><th>key</th><th>region</th></tr><tr><td>' || n_nationkey || '</td><td>' || n_regionkey || '</td></tr></table>' AS html FROM nation")
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    page = X.template("of {n_name}\n| key | region |\n|---|---|\n| {n_nationkey} | {n_regionkey} |")
    return n.select("n_name", web.text_udf(web.table_html)(page).alias("html"))


@query("SELECT n_nationkey, json_object('nation', json_array(json_object('name', n_name), json_object('region', n_regionkey::VARCHAR))) AS value FROM nation")
def xml_values(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    value = web.text_udf(web.xml_to_json)(X.template("<nation><name>{n_name}</name><region>{n_regionkey}</region></nation>"))
    return n.select("n_nationkey", F.regexp_replace(value, r"(?<=[:,]) ", "").alias("value"))


@query("""SELECT n_nationkey, 0 AS part_no, 'intro' || chr(10) AS content, '' AS headers, '' AS code FROM nation UNION ALL
SELECT n_nationkey, 1, '  body ' || n_name || chr(10) || chr(10), 'Header 1=' || n_name, '' FROM nation UNION ALL SELECT n_nationkey, 2, '```sql' || chr(10) || 'SELECT ' || n_nationkey || chr(10) || '```' || chr(10), 'Header 1=' || n_name, 'sql' FROM nation UNION ALL
SELECT n_nationkey, 3, 'deep' || chr(10), 'Header 1=' || n_name || ';Header 3=sub', '' FROM nation UNION ALL SELECT n_nationkey, 4, 'after the rule', 'Header 1=' || n_name || ';Header 3=sub', '' FROM nation""")
def exact_markdown(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    page = X.template("intro\n# {n_name}\n  body {n_name}\n\n```sql\nSELECT {n_nationkey}\n```\n### sub\ndeep\n---\nafter the rule")
    parts = n.withColumn("page", page).select("n_nationkey", F.posexplode(split.sections_column("page", markup.exact_markdown)).alias("part_no", "s"))
    headers = F.map_filter("s.metadata", lambda k, v: k.startswith("Header"))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return parts.select("n_nationkey", "part_no", "s.content", joined.alias("headers"), F.coalesce(F.try_element_at("s.metadata", F.lit("Code")), F.lit("")).alias("code"))


@query("""SELECT n_nationkey, 'before ' || n_nationkey AS content, 'h1' AS tag, '#TITLE#' AS header FROM nation UNION ALL SELECT n_nationkey, n_name || ' text of it', 'h2', n_name FROM nation""")
def html_by_sections(spark: SparkSession, d: str) -> DataFrame:
    page = X.template("<html><body><p>before {n_nationkey}</p><h2>{n_name}</h2><div>text <i>of</i> it</div><script>no</script></body></html>")
    parts = table(spark, d, "nation").withColumn("page", page).select("n_nationkey", F.explode(split.sections_column("page", lambda t: markup.html_by_sections(t, {"h2": "h2"}))).alias("s"))
    return parts.select("n_nationkey", "s.content", F.map_keys("s.metadata")[0].alias("tag"), F.map_values("s.metadata")[0].alias("header"))


@query("""SELECT n_nationkey, 0 AS part_no, 'see [' || n_name || '](/n/' || n_nationkey || ')' AS content, NULL AS title FROM nation UNION ALL
SELECT n_nationkey, 1, '<table><tr><td>' || n_name || '</td></tr></table>', 'Top' FROM nation UNION ALL SELECT n_nationkey, 2, 'and what follows', 'Top' FROM nation""")
def html_by_meaning(spark: SparkSession, d: str) -> DataFrame:
    page = X.template('<p>see <a href="/n/{n_nationkey}">{n_name}</a></p><h1>Top</h1><table><tr><td>{n_name}</td></tr></table><p>and what follows</p><style>x</style>')
    cut = lambda t: split.by_separator(t, "\n", 16, 0)
    how = lambda t: markup.html_by_meaning(t, {"h1": "title"}, 10, cut, keep=("table",))
    parts = table(spark, d, "nation").withColumn("page", page).select("n_nationkey", F.posexplode(split.sections_column("page", how)).alias("part_no", "s"))
    return parts.select("n_nationkey", "part_no", "s.content", F.try_element_at("s.metadata", F.lit("title")).alias("title"))


@query("""SELECT n_nationkey, 0 AS part_no, 'a' AS content, 'h1=' || n_name AS headers FROM nation UNION ALL SELECT n_nationkey, 1, 'b', 'h1=' || n_name || ';h2=sub' FROM nation""")
def markdown_headers(spark: SparkSession, d: str) -> DataFrame:
    page = X.template("# {n_name}\n\na\n\n## sub\nb\n")
    how = lambda t: split.markdown_sections(t, {"#": "h1", "##": "h2"})
    parts = table(spark, d, "nation").withColumn("page", page).select("n_nationkey", F.posexplode(split.sections_column("page", how)).alias("part_no", "s"))
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("s.metadata")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return parts.select("n_nationkey", "part_no", "s.content", joined.alias("headers"))


@query("SELECT n_nationkey AS doc_id, 0 AS row_no, 'key' AS a, 'name' AS b FROM nation UNION ALL SELECT n_nationkey, 1, n_nationkey::VARCHAR, n_name FROM nation")
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), X.template("x\n| key | name |\n|---|---|\n| {n_nationkey} | {n_name} |").alias("text"))
    rows = split.table_rows(docs).withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no")) - 1)
    return rows.select("doc_id", F.col("n").alias("row_no"), F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 500 AND (source = 'src1' OR lang IN ('en', 'de'))")
def pruned_filter(spark: SparkSession, d: str) -> DataFrame:
    asked = filters.parse('and(gt("n_chars", 500), or(eq("source", "src1"), in("lang", ["en", "de"])), like("secret", "x%"))')
    kept = filters.prune(asked, attributes=["n_chars", "source", "lang"])
    return table(spark, d, "documents").where(filters.to_column(kept)).select("doc_id", "source", "n_chars")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '[REDACTED_MAC_ADDRESS] and [REDACTED_URL]' ELSE 'no ' || n_name END AS text FROM nation")
def pii_macs_and_urls(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    hexa = F.lpad(F.hex("n_nationkey"), 2, "0")
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("00:1b:44:11:3a:"), hexa, F.lit(" and https://e.example/"), "n_name")).otherwise(F.concat(F.lit("no "), "n_name"))
    return n.select("n_nationkey", personal.apply(personal.apply(text, "mac_address"), "url").alias("text"))


@query("SELECT n_nationkey, 'id [REDACTED_CODE] of ' || n_name AS text FROM nation")
def pii_own_pattern(spark: SparkSession, d: str) -> DataFrame:
    text = X.template("id N-{n_nationkey} of {n_name}")
    return table(spark, d, "nation").select("n_nationkey", personal.apply(text, "code", pattern="N-[0-9]+").alias("text"))


_EDGES = "(SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1)"


def _path_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, d, "nation")
    after = n.select(F.col("n_name").alias("target"), (F.col("n_nationkey") - 1).alias("n_nationkey"))
    return n.select(F.col("n_name").alias("id")), n.join(after, "n_nationkey").select(F.col("n_name").alias("source"), "target")


@query(f"SELECT source, target FROM {_EDGES} WHERE source <> (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) AND target <> (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1)")
def graph_trimmed(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph.trimmed(*_path_graph(spark, d), "first")
    return graph.trimmed(nodes, edges, "last")[1]


@query(f"SELECT 'sub:' || source AS source, 'sub:' || target AS target FROM {_EDGES}")
def graph_embedded(spark: SparkSession, d: str) -> DataFrame:
    return graph.prefixed(*_path_graph(spark, d), "sub")[1]


@query("SELECT count(*) AS nodes, count(*) - 1 AS edges FROM nation")
def graph_json(spark: SparkSession, d: str) -> DataFrame:
    value = F.from_json("graph", "nodes array<struct<id:string>>, edges array<struct<source:string,target:string>>")
    return graph.as_json(*_path_graph(spark, d)).select(value.alias("g")).select(F.size("g.nodes").alias("nodes"), F.size("g.edges").alias("edges"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey)) - 1) // 100 AS batch FROM orders")
def index_batches(spark: SparkSession, d: str) -> DataFrame:
    return indexing.batches(table(spark, d, "orders").select("o_orderkey"), 100, "o_orderkey")


@query("""WITH docs AS (SELECT doc_id, sha256(text) AS key FROM documents), m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM docs WHERE doc_id % 2 = 0), state AS (SELECT DISTINCT key FROM docs WHERE doc_id % 3 = 0)
SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN s.key IS NULL THEN 'added' ELSE 'updated' END AS action, count(*) AS n FROM m LEFT JOIN state s ON s.key = m.key GROUP BY 1""")
def index_forced(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    state = docs.where("doc_id % 3 = 0").select(F.lit("ns").alias("namespace"), "key").distinct().select("namespace", "key", F.lit(None).cast("string").alias("group_id"), F.lit(1.0).alias("updated_at"))
    return indexing.classify(docs.where("doc_id % 2 = 0"), state, "ns", force=True, order="doc_id").groupBy("action").agg(F.count("*").alias("n"))


@query("SELECT doc_id::VARCHAR AS key, source AS group_id, doc_id % 3 = 2 AS late FROM documents WHERE doc_id % 3 > 0")
def record_log(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the documents are indexed, then another two thirds with full cleanup, each as one version of a log."""
    records = Records(spark, fresh_path(spark, "records"), "documents", clock=iter((100.0, 200.0)).__next__)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "source", "doc_id")
    for part, how in (("doc_id % 3 < 2", {}), ("doc_id % 3 > 0", {"cleanup": "full"})):
        records.index(docs.where(part), lambda write, delete: None, source="source", order="doc_id", **how)
    first = records.state(1).select("key", F.lit(False).alias("late"))
    return records.state().join(first, "key", "left").select("key", "group_id", F.coalesce("late", F.lit(True)).alias("late"))
