"""Queries of parsed answers, prompts, agents' steps, folds with a model, and partial outputs."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import parsers as P
from docloom.functions import prompts, text as X
from docloom.operators import agents, algebra, evaluate, messages, summaries
from docloom.plans.catalogue import query
from docloom.session import table
from docloom.streaming import events as E
from docloom.streaming import patches


@query("""SELECT event_id, event_type AS name, event_id % 3 = 0 AS wrapped, CASE WHEN event_type = 'click' THEN event_id % 100 END AS x FROM events""")
def tool_calls_parsed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    args = F.concat(F.lit('{"x": '), (F.col("event_id") % 100).cast("string"), F.lit("}"))
    wrapped = F.to_json(F.struct(F.array(F.struct(F.lit("c1").alias("id"), F.struct(F.col("event_type").alias("name"), args.alias("arguments")).alias("function"))).alias("tool_calls")))
    plain = F.to_json(F.struct(F.array(F.struct(F.lit("c1").alias("id"), F.col("event_type").alias("name"), args.alias("args"))).alias("tool_calls")))
    calls = e.select("event_id", (F.col("event_id") % 3 == 0).alias("wrapped"), P.tool_calls(F.when(F.col("event_id") % 3 == 0, wrapped).otherwise(plain)).alias("calls"))
    return calls.select("event_id", F.get("calls", F.lit(0))["name"].alias("name"), "wrapped", P.first_args("calls", "click", "x long")["x"].alias("x"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS kind, CASE WHEN event_id % 4 < 2 THEN event_id % 10 END AS n FROM events")
def structured_answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("event_id") % 10).alias("n")))
    four = F.col("event_id") % 4
    answer = F.when(four == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n"))).when(four == 1, body).when(four == 2, '{"kind": "x"}').otherwise("no JSON")
    return e.select("event_id", P.structured(answer, {"kind": "string", "n": "long"}).alias("v")).select("event_id", "v.kind", "v.n")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 10 WHEN event_id % 3 = 0 THEN 7 END AS n FROM events")
def repaired_answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    answer = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"n": '), (F.col("event_id") % 10).cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 0, "fix me").otherwise("lost")
    fix = lambda a: F.when(a == "fix me", '{"n": 7}').otherwise(a)
    return e.select("event_id", P.repaired(answer, lambda a: P.structured(a, {"n": "long"}), fix, 2)["n"].alias("n"))


@query("SELECT n_nationkey, json_object('name', n_name, 'region', n_regionkey, 'tags', json_array(n_nationkey, 'x')) AS value FROM nation WHERE n_nationkey % 5 <> 4 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 5 = 4")
def yaml_answers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    good = F.concat(F.lit("```yaml\nname: "), "n_name", F.lit("\nregion: "), F.col("n_regionkey").cast("string"), F.lit("\ntags:\n  - "), F.col("n_nationkey").cast("string"), F.lit("\n  - x\n```"))
    value = P.yaml_to_json(F.when(F.col("n_nationkey") % 5 == 4, F.lit("a: 1\n   b: [")).otherwise(good))
    return n.select("n_nationkey", F.replace(F.replace(value, F.lit(": "), F.lit(":")), F.lit(", "), F.lit(",")).alias("value"))


_SCHEMA = {"$defs": {"small": {"type": "integer", "minimum": 0, "exclusiveMaximum": 50}}, "type": "object", "required": ["n", "kind"], "properties": {"n": {"$ref": "#/$defs/small"}, "kind": {"enum": ["click", "view"]}}, "additionalProperties": False}


@query("SELECT event_id, (event_id % 100 < 50 AND event_type IN ('click', 'view') AND event_id % 7 <> 0)::INT AS valid FROM events")
def schema_validation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    extra = F.when(F.col("event_id") % 7 == 0, F.lit(1))
    body = F.to_json(F.struct((F.col("event_id") % 100).alias("n"), F.col("event_type").alias("kind"), extra.alias("more")))
    return e.select("event_id", P.schema_valid(body, _SCHEMA).alias("valid"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'search' END AS action, CASE WHEN turn % 3 = 0 THEN 'turn ' || turn END AS input, CASE WHEN turn % 3 = 1 THEN 'the end ' || turn END AS final,
CASE WHEN turn % 3 = 2 AND turn % 2 = 0 THEN 'both a final answer and an action' WHEN turn % 3 = 2 THEN 'neither a final answer nor an action' END AS error FROM conversations""")
def react_steps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    t = F.col("turn").cast("string")
    act = F.concat(F.lit("I need to look.\nAction: search\nAction Input: \"turn "), t, F.lit('"'))
    end = F.concat(F.lit("I know.\nFinal Answer: the end "), t)
    three = F.col("turn") % 3
    answer = F.when(three == 0, act).when(three == 1, end).when(F.col("turn") % 2 == 0, F.concat(end, F.lit("\n"), act)).otherwise("hm")
    return c.select("conv_id", "turn", P.react_step(answer).alias("s")).select("conv_id", "turn", "s.*")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Who was it ' || turn || '?' END AS question, CASE WHEN turn % 3 = 1 THEN 'it' || turn END AS final, CASE WHEN turn % 3 = 2 THEN 'neither a follow-up nor a final answer' END AS error FROM conversations""")
def self_ask_steps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    t, three = F.col("turn").cast("string"), F.col("turn") % 3
    answer = F.when(three == 0, F.concat(F.lit("Yes.\nFollow up: Who was it "), t, F.lit("?"))).when(three == 1, F.concat(F.lit("x\nSo the final answer is: it"), t)).otherwise("Follow up: a?\nno")
    return c.select("conv_id", "turn", P.self_ask_step(answer).alias("s")).select("conv_id", "turn", "s.*")


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'find' END AS action, CASE WHEN turn % 2 = 0 THEN 'no ' || turn END AS input, CASE WHEN turn % 2 = 1 THEN 'done' END AS final FROM conversations""")
def tagged_steps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<tool>find</tool><tool_input>no "), F.col("turn").cast("string"))).otherwise("so <final_answer>done</final_answer>")
    return c.select("conv_id", "turn", P.tagged_step(answer).alias("s")).select("conv_id", "turn", "s.*")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'my_host' WHEN 1 THEN 'openai' WHEN 2 THEN 'anthropic' END AS provider, CASE p_partkey % 4 WHEN 0 THEN 'm:' || p_partkey WHEN 1 THEN 'gpt-' || p_partkey WHEN 2 THEN 'claude-' || p_partkey ELSE 'other' END AS model FROM part""")
def provider_models(spark: SparkSession, d: str) -> DataFrame:
    k, four = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    name = F.when(four == 0, F.concat(F.lit("my-host:m:"), k)).when(four == 1, F.concat(F.lit("gpt-"), k)).when(four == 2, F.concat(F.lit("claude-"), k)).otherwise("other")
    return table(spark, d, "part").select("p_partkey", P.provider_model(name).alias("m")).select("p_partkey", "m.provider", "m.model")


@query("SELECT o_orderkey, (o_orderkey % 100)::INT AS n, (o_orderkey % 100)::INT AS plain, NULL::INT AS none FROM orders")
def han_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 100
    return table(spark, d, "orders").select("o_orderkey", P.han_number(P.han_numeral(n)).cast("int").alias("n"), P.han_number(n.cast("string")).cast("int").alias("plain"), P.han_number(F.lit("百")).cast("int").alias("none"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'too ' || lang ELSE '' END AS reason, round(((length(text) > 1000)::INT + contains(text, 'a')::INT + (lang = 'en')::INT + 0) / 4e0, 4) AS score FROM documents")
def reasons_and_rubrics(spark: SparkSession, d: str) -> DataFrame:
    note = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("不采纳\n原因： too "), "lang", F.lit("\nend"))).otherwise("采纳")
    score = P.rubric(F.length("text") > 1000, F.contains("text", F.lit("a")), F.col("lang") == "en", F.lit(None).cast("boolean"))
    return table(spark, d, "documents").select("doc_id", P.reason_of(note).alias("reason"), F.round(score, 4).alias("score"))


@query("""SELECT doc_id, 'Hi ' || replace(replace(lang, '&', '&amp;'), '<', '&lt;') || '!' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- src ' || source || chr(10) || '- no ' || doc_id || chr(10) ELSE 'none' || chr(10) END || '<b>' AS prompt FROM documents""")
def mustache_prompt(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    items = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("src "), "source").alias("t")), F.struct(F.concat(F.lit("no "), F.col("doc_id").cast("string")).alias("t")))).otherwise(F.array().cast("array<struct<t:string>>"))
    values = F.struct(F.struct("lang").alias("doc"), items.alias("items"), F.lit("<b>").alias("raw"))
    return docs.select("doc_id", prompts.mustache("Hi {{doc.lang}}!{{! said once }}\n{{#items}}\n- {{t}}\n{{/items}}\n{{^items}}\nnone\n{{/items}}\n{{{raw}}}", values).alias("prompt"))


@query("""SELECT conv_id, count(*) + 2 AS n, 'system: You speak ' || conv_id || '.' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'user: And now?' AS prompt FROM conversations GROUP BY conv_id""")
def chat_prompt(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    rows = c.groupBy("conv_id").agg(history.alias("history")).select("conv_id", prompts.chat(("system", "You speak {conv_id}."), "history", ("user", "And now?")).alias("m"))
    return rows.select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("prompt"))


@query("""SELECT r_name, 'Name them.' || chr(10) || chr(10) || string_agg('Q: ' || n_nationkey || chr(10) || 'A: ' || n_name, chr(10) || chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || 'Q: ' || r_name AS prompt FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def few_shot_prompt(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("examples"))
    return rows.select("r_name", prompts.few_shot("examples", "Q: {n_nationkey}\nA: {n_name}", "Q: {r_name}", "Name them.").alias("prompt"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Each user message as a step, with the message after it as what was seen."""
    c = table(spark, d, "conversations")
    seen = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("observation"))
    return c.where("role = 'user'").join(seen, ["conv_id", "turn"], "left").select("conv_id", F.col("turn").alias("step"), F.lit("ask").alias("tool"), F.concat(F.lit("in "), F.col("turn").cast("string")).alias("input"), F.col("text").alias("log"), "observation")


_STEPS = "WITH s AS (SELECT a.conv_id, a.turn AS step, 'in ' || a.turn AS input, a.text AS log, coalesce(b.text, '') AS observation FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')"


@query(_STEPS + " SELECT conv_id, string_agg(log || chr(10) || 'Observation: ' || observation || chr(10) || 'Thought: ', '' ORDER BY step) AS scratchpad FROM s GROUP BY conv_id")
def agent_scratchpad(spark: SparkSession, d: str) -> DataFrame:
    return agents.scratchpad(_steps(spark, d), by="conv_id")


@query(_STEPS + " SELECT conv_id, string_agg('<tool>ask</tool><tool_input>' || input || '</tool_input><observation>' || observation || '</observation>', '' ORDER BY step) AS scratchpad FROM s GROUP BY conv_id")
def tagged_scratchpad(spark: SparkSession, d: str) -> DataFrame:
    return agents.tagged_scratchpad(_steps(spark, d), by="conv_id")


@query(_STEPS + " SELECT conv_id, 2 * step AS turn, 'assistant' AS role, log AS text FROM s UNION ALL SELECT conv_id, 2 * step + 1, 'user', observation FROM s")
def agent_messages(spark: SparkSession, d: str) -> DataFrame:
    return agents.step_messages(_steps(spark, d), by="conv_id")


@query(_STEPS + " SELECT conv_id, string_agg('Step ' || (step + 1) || ':' || chr(10) || 'Tool used: ask' || chr(10) || 'Tool input: ' || input || chr(10) || 'Tool output: ' || observation, chr(10) || chr(10) ORDER BY step) AS trajectory FROM s GROUP BY conv_id")
def agent_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return agents.trajectory(_steps(spark, d), by="conv_id")


@query("""SELECT p_partkey, 'after ' || (p_partkey % 4) || ' of item ' || p_partkey AS answer, (p_partkey % 4 + 1)::INT AS rounds FROM part WHERE p_partkey % 5 <> 0 UNION ALL
SELECT p_partkey, NULL, 4 FROM part WHERE p_partkey % 5 = 0""")
def agent_loop(spark: SparkSession, d: str) -> DataFrame:
    """Agents that look up as often as their question says, and some that never end."""
    tasks = table(spark, d, "part").select("p_partkey", F.concat(F.lit("item "), F.col("p_partkey").cast("string")).alias("question"))

    def model(prompt):
        number = F.regexp_extract(prompt, r"^item (\d+)", 1).cast("long")
        n = F.regexp_count(prompt, F.lit("Observation: "))
        act = F.concat(F.lit("look\nAction: find\nAction Input: "), n.cast("string"))
        return F.when((number % 5 == 0) | (n < number % 4), act).otherwise(F.concat(F.lit("Final Answer: after "), n.cast("string"), F.lit(" of item "), number.cast("string")))

    answers, _ = agents.loop(tasks, model, P.react_step, lambda tool, given: F.concat(tool, F.lit(" "), given), most=4, key="p_partkey")
    return answers.select(F.col("run_id").alias("p_partkey"), "answer", "rounds")


@query("SELECT r_name, string_agg(n_name, '+' ORDER BY n_nationkey) AS answer, count(*)::INT AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def refined_answers(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return summaries.refined(n, lambda t: t, lambda a, t: F.concat(a, F.lit("+"), t), by="r_name", order="n_nationkey", text="n_name")


@query("""WITH s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM conversations)
SELECT conv_id, 'SUM ' || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS summary, count(*)::INT AS n_dropped FROM s WHERE upto > 500 GROUP BY conv_id""")
def summary_buffer(spark: SparkSession, d: str) -> DataFrame:
    return summaries.summary_buffer(table(spark, d, "conversations"), 500, F.length("text"), lambda t: F.concat(F.lit("SUM "), t))[1]


@query("SELECT conv_id, string_agg('[' || length(text) || ']', '' ORDER BY turn) AS answer, count(*)::INT AS n FROM conversations GROUP BY conv_id")
def rolling_summary(spark: SparkSession, d: str) -> DataFrame:
    extend = lambda so_far, t: F.concat(so_far, F.lit("["), F.length(t).cast("string"), F.lit("]"))
    return summaries.rolling_summaries(table(spark, d, "conversations"), extend)


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, (i // 100)::INT AS slice_no, len(w[i + 1:i + 100])::INT AS n_tokens, array_to_string(w[i + 1:i + 100], ' ') AS tokens FROM t, LATERAL (SELECT unnest(range(0, len(w), 100)) AS i)""")
def token_slices(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return summaries.token_slices(docs, F.filter(F.split("text", r"\s+"), lambda x: x != ""), 100).withColumn("tokens", F.array_join("tokens", " "))


@query("""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'tion')) AS p FROM documents)
SELECT doc_id, len(p)::INT AS n_hits, i::INT AS hit_no, p[i] AS paragraph FROM p, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)""")
def paragraph_lookup(spark: SparkSession, d: str) -> DataFrame:
    return summaries.paragraphs_with(table(spark, d, "documents"), "TION", separator="\n")


@query("SELECT p_partkey, p_brand || coalesce(CASE WHEN p_size > 25 THEN p_type END, '') || p_name AS text, CASE WHEN p_size > 25 THEN 'a|' || p_brand || p_type || '|z' ELSE 'a|' || p_brand END AS blocks FROM part")
def merged_contents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    some = F.when(F.col("p_size") > 25, F.col("p_type"))
    blocks = summaries.merged_blocks(F.array(F.lit("a"), F.col("p_brand")), F.when(F.col("p_size") > 25, F.array(F.col("p_type"), F.lit("z"))))
    return p.select("p_partkey", summaries.merged_content(F.col("p_brand"), some, F.col("p_name")).alias("text"), F.array_join(blocks, "|").alias("blocks"))


@query("SELECT lang, round(avg((lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = lower(text))::INT), 6) AS rate FROM documents GROUP BY lang")
def overlap_rate(spark: SparkSession, d: str) -> DataFrame:
    return summaries.overlap_rate(table(spark, d, "documents"), F.lower(X.compact("text")), F.lower("text"), ["lang"]).withColumn("rate", F.round("rate", 6))


@query("SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations")
def cumulative_text(spark: SparkSession, d: str) -> DataFrame:
    return patches.cumulative_text(table(spark, d, "conversations"), run="conv_id", seq="turn").select("conv_id", "turn", "so_far")


@query("""SELECT conv_id, turn, '{"n":[' || string_agg(turn::VARCHAR, ',') OVER (PARTITION BY conv_id ORDER BY turn) || ']}' AS value FROM conversations""")
def cumulative_values(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    first = F.min("turn").over(Window.partitionBy("conv_id"))
    chunks = c.withColumn("part", F.when(F.col("turn") == first, F.concat(F.lit('{"n": ['), F.col("turn").cast("string"))).otherwise(F.concat(F.lit(", "), F.col("turn").cast("string"))))
    got = patches.cumulative_values(chunks, run="conv_id", seq="turn", text="part")
    return got.withColumn("value", F.regexp_replace("value", "\\s", ""))


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
l AS (SELECT user_id, max(event_type) FILTER (WHERE n = m) AS last, max(m) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM r) GROUP BY user_id)
SELECT user_id, '{"ids":[' || ids || '],"last":"' || last || '"}' AS state, n FROM l""")
def folded_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    first = F.min("event_id").over(Window.partitionBy("user_id"))
    op = lambda kind, path, value: F.concat(F.lit(f'{{"op": "{kind}", "path": "{path}", "value": '), value, F.lit("}"))
    add, last = op("add", "/ids/-", F.col("event_id").cast("string")), op("replace", "/last", F.concat(F.lit('"'), "event_type", F.lit('"')))
    start = F.when(F.col("event_id") == first, '{"op": "replace", "path": "", "value": {"ids": [], "last": null}}')
    logs = e.withColumn("ops", F.concat(F.lit("["), F.concat_ws(", ", start, add, last), F.lit("]")))
    return patches.folded_log(logs, run="user_id", seq="event_id").withColumn("state", F.regexp_replace("state", "\\s", ""))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    tags = F.array_compact(F.array(F.when(F.col("user_id") % 3 == 0, "three"), F.when(F.col("user_id") % 5 == 0, "five")))
    return e.select(F.col("event_id").alias("run_id"), F.lit(None).cast("long").alias("parent_id"), F.when(F.col("event_id") % 2 == 0, "tool").otherwise("llm").alias("kind"), F.col("event_type").alias("name"), F.col("ts").alias("started"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ended"), F.when(F.col("event_id") % 7 == 0, "boom").alias("error"), tags.alias("tags"))


_RUNS = """WITH r AS (SELECT event_id AS run_id, CASE WHEN event_id % 2 = 0 THEN 'tool' ELSE 'llm' END AS kind, event_type AS name, ts, event_id % 5 <> 0 AS done, CASE WHEN event_id % 7 = 0 THEN 'boom' END AS error, user_id FROM events),
e AS (SELECT ts, 'on_' || kind || '_start' AS event, run_id, name, NULL AS data, kind, user_id FROM r UNION ALL SELECT ts, 'on_' || kind || CASE WHEN error IS NULL THEN '_end' ELSE '_error' END, run_id, name, error, kind, user_id FROM r WHERE done)"""


@query(_RUNS + " SELECT ts, event, run_id, name, data FROM e")
def event_log(spark: SparkSession, d: str) -> DataFrame:
    return patches.event_log(_runs(spark, d)).select("ts", "event", "run_id", "name", "data")


@query(_RUNS + " SELECT event, run_id FROM e WHERE (kind = 'tool' OR user_id % 3 = 0) AND name <> 'view'")
def filtered_log(spark: SparkSession, d: str) -> DataFrame:
    return patches.wanted(patches.event_log(_runs(spark, d)), types=["tool"], tags=["three"], not_names=["view"]).select("event", "run_id")


@query("SELECT event_id, 'up' AS branch, upper(event_type) AS value FROM events UNION ALL SELECT event_id, 'user', user_id::VARCHAR FROM events")
def parallel_branches(spark: SparkSession, d: str) -> DataFrame:
    return patches.branches(table(spark, d, "events").select("event_id", "event_type", "user_id"), up=F.upper("event_type"), user=F.col("user_id")).select("event_id", "branch", "value")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'yes' WHEN p_partkey % 3 = 1 THEN 'no' END AS answer, CASE WHEN p_partkey % 3 = 2 THEN 'ValueError: two' END AS error, CASE WHEN p_partkey % 3 = 2 THEN 3 ELSE 1 END AS attempts FROM part")
def caught_errors(spark: SparkSession, d: str) -> DataFrame:
    def answer(k):
        if k % 3 == 2:
            raise ValueError("two")
        return "yes" if k % 3 == 0 else "no"

    tried = algebra.caught(answer, "string", attempts=3)("p_partkey")
    return table(spark, d, "part").withColumn("r", tried).select("p_partkey", F.col("r.value").alias("answer"), "r.error", "r.attempts")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN true ELSE false END AS yes, 'size_' || p_size AS name, p_size * 2 + 1 AS size FROM part")
def booleans_and_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("p_partkey") % 3 == 0, "Well, yes.").otherwise("NO, not \"yesterday\"")
    p = table(spark, d, "part").withColumn("camel", F.concat(F.lit("Size"), F.lit("_"), F.col("p_size").cast("string")))
    return p.select("p_partkey", X.yes_no(reply).alias("yes"), F.lower("camel").alias("name"), X.arithmetic("p_size * 2 + 1").cast("int").alias("size"))


@query("SELECT doc_id, len(regexp_extract_all(text, 'the')) > 0 AS found, CASE WHEN contains(text, 'the') THEN (instr(text, 'the') - 1)::INT END AS at FROM documents")
def fuzzy_quotes(spark: SparkSession, d: str) -> DataFrame:
    spans = evaluate.quoted_at(F.lit("the"), "text", 0)
    return table(spark, d, "documents").select("doc_id", spans.alias("s")).select("doc_id", (F.size("s") > 0).alias("found"), F.get("s", F.lit(0))["start"].alias("at"))


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS asked, max(turn) AS last FROM conversations GROUP BY conv_id")
def message_roles(spark: SparkSession, d: str) -> DataFrame:
    names = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "AI").otherwise(F.col("role"))
    c = table(spark, d, "conversations").withColumn("role", messages.role(names))
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_events(spark: SparkSession, d: str) -> DataFrame:
    return E.once(table(spark, d, "events"), ["user_id", "event_type"], ties="event_id").select("user_id", "event_id", "value")
