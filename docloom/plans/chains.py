"""Queries of experiments, settings, memories, spreadsheets, contracts, and chains around models."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import algebra, contracts, evaluate, experiments, fusion, memory, messages, models, settings
from docloom.plans.catalogue import query
from docloom.session import table
from docloom.sources import sheets


def _examples(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("example_id"), F.col("p_name").alias("input"), F.col("p_type").alias("reference"))


def _chain(df: DataFrame) -> DataFrame:
    """Answers right for every second example, in lower case for the others."""
    return df.withColumn("prediction", F.when(F.col("example_id") % 2 == 0, F.col("reference")).otherwise(F.lower("reference")))


@query("""SELECT p_partkey AS example_id, k AS feedback_key, round(CASE k WHEN 'exact_match' THEN (p_partkey % 2 = 0)::INT WHEN 'contains' THEN (p_partkey % 2 = 0)::INT ELSE CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE levenshtein(lower(p_type), p_type) / length(p_type)::DOUBLE END END, 6) AS score
FROM part, (VALUES ('exact_match'), ('contains'), ('levenshtein')) t(k)""")
def experiment_results(spark: SparkSession, d: str) -> DataFrame:
    r = experiments.run(_examples(spark, d), _chain, experiments.load_evaluators(["exact_match", "contains", "levenshtein"]))
    return r.select("example_id", "feedback_key", F.round("score", 6).alias("score"))


@query("""SELECT p_partkey AS example_id, p_name AS input, p_type AS reference, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END AS prediction, (p_partkey % 2 = 0)::INT::DOUBLE AS "feedback.exact_match", (p_partkey % 2 = 0)::INT::DOUBLE AS "feedback.contains" FROM part""")
def experiment_wide(spark: SparkSession, d: str) -> DataFrame:
    r = experiments.run(_examples(spark, d), _chain, experiments.load_evaluators(["exact_match", "contains"]))
    return experiments.wide(r, ["exact_match", "contains"])


@query("""SELECT 'exact_match' AS feedback_key, count(*) AS count, round(avg((p_partkey % 2 = 0)::INT), 6) AS mean, max((p_partkey % 2 = 0)::INT)::DOUBLE AS max FROM part""")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    r = experiments.run(_examples(spark, d), _chain, experiments.load_evaluators(["exact_match"]))
    return experiments.summary(r).select("feedback_key", "count", F.round("mean", 6).alias("mean"), "max")


@query("SELECT p_partkey, p_name AS input, p_type AS prediction FROM part")
def run_mapping(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("q"), "p_name").alias("inputs"), F.create_map(F.lit("a"), "p_type", F.lit("b"), "p_brand").alias("outputs"))
    return p.select("p_partkey", experiments.single("inputs").alias("input"), experiments.single("outputs", "a").alias("prediction"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN upper(n_name) ELSE n_name || '!!' END AS v FROM nation")
def configured_chain(spark: SparkSession, d: str) -> DataFrame:
    """Two settings of one chain and two of its alternatives."""
    marked = settings.configurable(lambda mark, times: algebra.assign(v=F.concat("n_name", F.lit(mark * times))), settings.Field("mark", str, "?"), settings.Field("times", int, 1))
    chosen = settings.alternatives("how", "plain", plain=marked({"mark": "!", "times": 2}), loud=algebra.assign(v=F.upper("n_name")))
    n = table(spark, d, "nation")
    out = [settings.listened(chosen(c))(n.where(w)).select("n_nationkey", "v") for c, w in (({"how": "loud"}, "n_regionkey > 2"), ({}, "n_regionkey <= 2"))]
    return fusion.union_all(*out)


@query("SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS fact FROM conversations WHERE role = 'user' GROUP BY conv_id")
def entity_memory(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("entity"), F.col("text").alias("fact"), "turn")
    return memory.entities(facts).withColumnRenamed("entity", "conv_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE epoch_us(TIMESTAMP '2024-06-30 00:00:00') - epoch_us(ts) <= 1000000::BIGINT * 86400 * 90 AND value IS NOT NULL GROUP BY user_id, event_type")
def entity_memory_expiring(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-06-30 00:00:00").cast("timestamp")
    return memory.entities(table(spark, d, "events"), entity="event_type", fact="value", order="event_id", by="user_id", now=now, keep=86400 * 90, time="ts")


@query(r"""WITH w AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[^\pL\pN]+')) AS w FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(['Das', 'La', 'The', 'une'], lambda e: list_contains(w, lower(e)))), ',') AS entities FROM w""")
def mentioned_entities(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("The",), ("Das",), ("La",), ("une",)], "entity string")
    return memory.mentioned(table(spark, d, "documents").select("doc_id", "text"), names).select("doc_id", F.array_join("entities", ",").alias("entities"))


@query("""WITH s AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) > 300 AS out FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE NOT out) AS kept, count(*) FILTER (WHERE out) AS stored FROM s GROUP BY conv_id""")
def memory_overflow(spark: SparkSession, d: str) -> DataFrame:
    kept, out = memory.overflow(table(spark, d, "conversations"), 300, F.length("text"))
    count = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias(name))
    return memory.combined(count(kept, "kept"), count(out, "stored")).fillna(0, ["kept", "stored"])


@query("SELECT r_name, 'Nations of ' || r_name AS sheet, 'n_name' AS head, count(*) AS n, min(n_name) AS first FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def spreadsheets(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(F.lit("| "), x, F.lit(" | x |"))), "\n")
    md = n.groupBy("r_name").agg(F.concat(F.lit("# Nations of "), F.first("r_name"), F.lit("\n| n_name | b |\n|---|---|\n"), lines).alias("md"))

    @F.pandas_udf("sheet string, head string, n long, first string")
    def seen(x):
        import pandas as pd

        books = [sheets.read_workbook(bytes(b))[0] for b in x]
        return pd.DataFrame([(name, rows[0][0], len(rows) - 1, rows[1][0]) for name, rows in books], columns=["sheet", "head", "n", "first"])

    return md.select("r_name", seen(sheets.to_xlsx("md")).alias("s")).select("r_name", "s.*")


def _contracts(spark: SparkSession, d: str) -> DataFrame:
    """Nations as contracts of three clauses; labels and participants' findings about them."""
    n = table(spark, d, "nation")
    text = X.template("Contract of {n_name}\n1. {n_name} pays within {n_nationkey} days of the invoice\n2. Either side of {n_name} may end it with notice")
    pay, end = X.template("{n_name} pays within {n_nationkey} days of the invoice"), X.template("Either side of {n_name} may end it with notice")

    def risk(number: int, clause, status):
        return F.struct(F.lit(f"r{number}").alias("risk_id"), F.concat(F.lit(f"risk {number} of "), "n_name").alias("title"), clause.alias("clause_text"), F.lit("because").alias("explanation"), F.lit("change").alias("suggestion"), status.alias("status"))

    gold = F.explode(F.array(risk(1, pay, F.lit("accept")), risk(2, end, F.lit("reject")))).alias("r")
    found = F.explode(F.array(F.struct(F.lit("m").alias("participant"), risk(1, pay, F.lit("")).alias("r")), F.struct(F.lit("o").alias("participant"), risk(3, F.lit("zzz qqq"), F.lit("")).alias("r"))))
    key = F.concat(F.lit("c"), F.col("n_nationkey").cast("string")).alias("contract_id")
    labels = n.select(key, gold).select("contract_id", "r.*")
    results = n.select(key, found.alias("f")).select("contract_id", "f.participant", "f.r.*")
    return contracts.dataset(n.select(key, text.alias("full_contract_text")), labels, results)


@query("SELECT 'c' || n_nationkey AS contract_id, 2 AS labels, 'm,o' AS participants, 1 AS of_m FROM nation")
def contract_dataset(spark: SparkSession, d: str) -> DataFrame:
    c = _contracts(spark, d)
    return c.select("contract_id", F.size("labels").alias("labels"), F.array_join(F.array_sort(F.map_keys("participants")), ",").alias("participants"), F.size(F.element_at("participants", F.lit("m"))).alias("of_m"))


@query("""SELECT 'c' || n_nationkey AS contract_id, i::BIGINT AS clause_no, CASE i WHEN 0 THEN NULL WHEN 1 THEN 'Contract of ' || n_name ELSE '1. ' || n_name || ' pays within ' || n_nationkey || ' days of the invoice' END AS previous_head FROM nation, range(0, 3) t(i)""")
def contract_clauses(spark: SparkSession, d: str) -> DataFrame:
    return contracts.clauses(_contracts(spark, d)).select("contract_id", "clause_no", "previous_head")


@query("SELECT o AS origin, p AS policy, CASE WHEN o = 'm' THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN o = 'm' THEN k - n ELSE k END AS fn FROM (SELECT count(*) AS n FROM nation), (VALUES ('m'), ('o')) a(o), (VALUES ('all', 2), ('adopted', 1)) b(p, f), LATERAL (SELECT f * n AS k)")
def contract_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return contracts.evaluated(_contracts(spark, d)).select("origin", "policy", "tp", "fp", "fn")


@query("SELECT 'c' || n_nationkey AS contract_id, 'c' || n_nationkey || '#1' AS clause_id, 'risk 1 of ' || n_name AS label, 'risk 1 of ' || n_name AS m, '' AS o FROM nation UNION ALL SELECT 'c' || n_nationkey, 'c' || n_nationkey || '#2', 'risk 2 of ' || n_name, '', '' FROM nation")
def contract_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    c = _contracts(spark, d)
    return contracts.side_by_side(contracts.to_clauses(contracts.risks(c), contracts.clauses(c)), ["label", "m", "o"])


@query("""SELECT n_nationkey, 'risk ' || n_name AS title, CASE WHEN n_nationkey % 3 = 2 THEN '' ELSE 'clause' END AS clause_text, 1 AS n FROM nation""")
def answered_risks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    whole = X.template('<think>{{"risks": []}}</think> so {{"risks": [{{"title": "risk {n_name}", "clause_text": "clause"}}]}}')
    broken = X.template('{{"risks": [\n{{\n"title": "risk {n_name}",\n"clause_text": "clause",\n}},')
    short = X.template('```json\n{{"risks": [{{"title": " risk {n_name} "}}]}}\n```')
    three = F.col("n_nationkey") % 3
    items = contracts.risks_in(F.when(three == 0, whole).when(three == 1, broken).otherwise(short))
    return n.select("n_nationkey", items.alias("r")).select("n_nationkey", F.col("r")[0]["title"].alias("title"), F.col("r")[0]["clause_text"].alias("clause_text"), F.size("r").alias("n"))


@query("SELECT 'c' || n_regionkey AS contract_id, n_nationkey % 3 AS number, string_agg(n_name, ' | ' ORDER BY n_nationkey) AS note FROM nation WHERE n_nationkey % 4 <> 0 GROUP BY 1, 2")
def comment_notes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    anchor = F.when(F.col("n_nationkey") % 4 == 0, F.lit("no number")).otherwise(F.concat(F.lit(" "), (F.col("n_nationkey") % 3).cast("string"), F.lit("、 risk")))
    comments = n.select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("contract_id"), F.col("n_nationkey").alias("comment_id"), anchor.alias("anchor"), F.col("n_name").alias("text"))
    return contracts.comment_notes(comments)


@query("SELECT n_regionkey, n_nationkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name), n_name) AS r FROM nation) WHERE r = 1")
def chosen_files(spark: SparkSession, d: str) -> DataFrame:
    return contracts.chosen_file(table(spark, d, "nation"), ["n_regionkey"], [F.length("n_name"), F.col("n_name")])


@query("""SELECT conv_id, turn, CASE WHEN turn = (SELECT min(turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.role = 'user') THEN text || ' [note: first]' ELSE text END AS text FROM conversations a""")
def annotated_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("text", F.concat(F.lit("#"), F.col("turn").cast("string"), F.lit("# "), "text"))
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn")).join(c.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    notes = first.select("conv_id", F.col("text").alias("quoted"), F.lit("first").alias("note"))
    out = contracts.annotated(c, notes, by="conv_id", order="turn")
    return out.select("conv_id", "turn", F.regexp_replace("text", r"^#\d+# ", "").alias("text"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS destination, CASE event_type WHEN 'click' THEN 'c' || user_id WHEN 'view' THEN 'v' ELSE 'o' END AS answer FROM events")
def model_router(spark: SparkSession, d: str) -> DataFrame:
    routes = {"click": F.concat(F.lit("c"), F.col("user_id").cast("string")), "view": F.lit("v"), "other": F.lit("o")}
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return models.routed(e, models.echo(), "{event_type}", routes, "other").select("event_id", "destination", "answer")


@query("SELECT p_partkey, p_brand AS brand, p_size AS size FROM part")
def model_tagging(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return models.tagged(p, '{{"brand": "{p_brand}", "size": {p_size}}}', models.echo(), "brand string, size int").select("p_partkey", "brand", "size")


@query("SELECT n_nationkey, i::INT AS pair_no, CASE i WHEN 0 THEN 'Where?' ELSE 'Which?' END AS question, CASE i WHEN 0 THEN n_name ELSE n_regionkey::VARCHAR END AS answer FROM nation, range(0, 2) t(i)")
def model_questions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    made = models.questions(n, models.echo(), '[{{"question": "Where?", "answer": "{n_name}"}}, {{"question": "Which?", "answer": "{n_regionkey}"}}]')
    return made.select("n_nationkey", "pair_no", "question", "answer")


@query("SELECT n_nationkey, CASE WHEN length(n_name) > 6 THEN substr(n_name, 1, 6) || ' (short)' ELSE n_name END || '.' AS answer FROM nation")
def revised_answers(spark: SparkSession, d: str) -> DataFrame:
    short = (lambda a: F.when(F.length(a) > 6, "short"), lambda a, why: F.concat(F.substring(a, 1, 6), F.lit(" ("), why, F.lit(")")))
    dot = (lambda a: F.when(~F.endswith(a, F.lit(".")), "dot"), lambda a, why: F.concat(a, F.lit(".")))
    return models.revised(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("answer")), [short, dot])


@query("SELECT page_id, coalesce(regexp_extract(url, '^https?://([^/:?#]*)', 1), '') IN ('example.com', 'example.org') AS allowed FROM pages")
def allowed_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", models.allowed_url("url", ["example.com", "example.org"]).alias("allowed"))


@query("SELECT n_regionkey, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def map_reduced(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.col("n_name").alias("text"))
    return models.reduced(n, lambda t: t, F.length, 1000, by="n_regionkey", order="n_nationkey").select("n_regionkey", "text")


@query("SELECT p_partkey, p_size AS same, p_size * 2 AS twice, array_to_string(list_transform(string_split(p_type, ' '), lambda w: lower(w)), ' ') AS words FROM part")
def fanned_out(spark: SparkSession, d: str) -> DataFrame:
    branches = {"p_partkey": F.col("p_partkey"), "same": F.col("p_size"), "twice": F.col("p_size") * 2, "words": F.array_join(algebra.each(F.split("p_type", " "), F.lower), " ")}
    return algebra.pipe(lambda df: df, branches)(table(spark, d, "part"))


@query("SELECT p_partkey, coalesce(try_cast(CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS INT), -1) AS size FROM part")
def first_that_works(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", algebra.first_that_works(mixed.try_cast("int"), F.lit(-1)).alias("size"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS answer, p_size + length(p_brand) AS made FROM part")
def tools_and_fakes(spark: SparkSession, d: str) -> DataFrame:
    def made(size: int, brand: str) -> int:
        """The size and the length of the brand."""
        return size + len(brand)

    p = table(spark, d, "part")
    return p.select("p_partkey", algebra.cyclic_responses(["a", "b", "c"], F.col("p_partkey")).alias("answer"), algebra.tool(made)(F.col("p_size").cast("long"), "p_brand").alias("made"))


@query("SELECT n_name, 'n_name' AS first, n_nationkey + 1 AS next FROM nation")
def selected_only(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "nation").createOrReplaceTempView("docloom_nation")
    first = algebra.table_info(spark, ["docloom_nation"]).split("n_name")[1][:1]
    return algebra.select_only(spark, "WITH t AS (SELECT * FROM docloom_nation) SELECT n_name, n_nationkey + 1 AS next FROM t;").withColumn("first", F.lit("n_name" + first.strip()))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{\"n\": ' || event_id || ', \"t\": \"ab\"}' ELSE '{\"n\": ' || event_id || '}' END AS value FROM events")
def partial_values(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"n": '), e, F.lit(', "t": "ab'))).otherwise(F.concat(F.lit('{"n": '), e, F.lit(', "t')))
    return table(spark, d, "events").select("event_id", evaluate.parse_partial_json(text).alias("value"))


@query("SELECT n_nationkey, n_name AS said, 'x' || chr(10) || n_name AS clean, lower(substr(n_name, 1, 1)) AS kind FROM nation")
def cleaned_answers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    said = X.without_thoughts(F.concat(F.lit("<think>hm\nno</think>"), "n_name"))
    clean = X.without_nul(F.concat(F.lit("x\0\n"), "n_name"))
    kind = X.enum_value(F.concat(F.lower(F.substring("n_name", 1, 1)), F.lit(" ")), [chr(97 + i) for i in range(26)])
    return n.select("n_nationkey", F.trim(said).alias("said"), clean.alias("clean"), kind.alias("kind"))


@query("SELECT n_nationkey, 2 AS n, '合同' AS first FROM nation")
def han_words(spark: SparkSession, d: str) -> DataFrame:
    terms = X.han_terms(F.concat(F.lit("合同 of "), "n_name", F.lit("，付款期限。的")), stop=("的",))
    return table(spark, d, "nation").select("n_nationkey", F.size(terms).alias("n"), F.get(terms, F.lit(0)).alias("first"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'accept' WHEN n_nationkey % 3 = 1 THEN 'reject' ELSE 'partial' END AS status FROM nation")
def review_status(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("n_nationkey") % 3 == 0, "已采纳").when(F.col("n_nationkey") % 3 == 1, "不采纳").otherwise("部分采纳")
    return table(spark, d, "nation").select("n_nationkey", contracts.status(note).alias("status"))


@query("SELECT p_partkey, round(greatest(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END, 0), 4) AS similarity FROM part")
def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("####")
    return table(spark, d, "part").select("p_partkey", F.round(evaluate.text_similarity(F.col("p_name"), other), 4).alias("similarity"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 2")
def greedy_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's first two messages, each paired with itself."""
    c = messages.call_numbers(table(spark, d, "conversations").select("conv_id", "turn"), 2, by="conv_id", order="turn").where("NOT over_limit")
    scored = c.select("conv_id", F.col("turn").alias("left_id")).join(c.select("conv_id", F.col("turn").alias("right_id")), "conv_id").withColumn("score", F.when(F.col("left_id") == F.col("right_id"), 1.0).otherwise(0.2))
    return evaluate.greedy_pairs(scored, "conv_id", 0.45, left_id="left_id", right_id="right_id").select("conv_id", F.col("right_id").alias("turn"))
