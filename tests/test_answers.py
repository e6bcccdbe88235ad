"""Parsers, prompts, patches, quotes, markup, settings, sheets, agents and retrievers on small fixtures."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import parsers as P
from docloom.functions import prompts
from docloom.operators import agents, algebra, evaluate, experiments, indexing, markup, memory, models, retrieval, settings
from docloom.sources import docx, sheets, tables
from docloom.streaming import patches


def test_yaml():
    assert P.yaml_value("a: 1\nb:\n  - x\n  - y: 2.5\n    z: true\n  -\n    - 'it''s'\nc: [1, \"q\"] \nd:\ne: ~ # note") == {"a": 1, "b": ["x", {"y": 2.5, "z": True}, ["it's"]], "c": [1, "q"], "d": None, "e": None}
    assert P.yaml_value("- 1\n- two") == [1, "two"] and P.yaml_value("plain words") == "plain words" and P.yaml_value("") is None
    for bad in ("a: &x 1", "a\nb", "a: 1\n   b: 2", "- 1\nb: 2"):
        with pytest.raises(ValueError):
            P.yaml_value(bad)


def test_schemas():
    schema = {"$defs": {"n": {"type": "integer", "minimum": 1}, "tree": {"properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/tree"}}}}}, "properties": {"a": {"$ref": "#/$defs/n"}, "t": {"$ref": "#/$defs/tree"}}}
    plain = P.resolved(schema)
    assert plain["properties"]["a"] == {"type": "integer", "minimum": 1} and "$defs" not in plain
    assert plain["properties"]["t"]["properties"]["kids"]["items"] == {"$ref": "#/$defs/tree"}
    with pytest.raises(ValueError):
        P.resolved({"$ref": "http://e.example/x"})
    good = [({"type": "integer"}, 2.0), ({"type": ["null", "string"]}, None), ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, 3), ({"uniqueItems": True}, [1, 2]), ({"not": {"type": "string"}}, 1), ({"multipleOf": 0.5}, 1.5), (True, 1), ({"pattern": "^a"}, "ab"), ({"additionalProperties": {"type": "string"}}, {"x": "y"})]
    bad = [({"type": "integer"}, True), ({"type": "string"}, 1), ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, 7), ({"uniqueItems": True}, [{"a": 1}, {"a": 1}]), ({"const": 1}, 2), ({"maxLength": 2}, "abc"), (False, 1), ({"required": ["a"]}, {}), ({"minItems": 1}, []), ({"exclusiveMinimum": 1}, 1), ({"anyOf": [{"const": 1}, {"const": 2}]}, 3)]
    assert all(P.fits(v, s) for s, v in good) and not any(P.fits(v, s) for s, v in bad)


def test_mustache(spark):
    show = lambda t, v: prompts.rendered(prompts.parsed_mustache(t), [v])
    assert show("{{a}} {{{a}}} {{& a}} {{b.c}} {{x}}|", {"a": "<&>", "b": {"c": 1}}) == "&lt;&amp;&gt; <&> <&> 1 |"
    assert show("{{#p}}{{.}},{{/p}}{{^p}}none{{/p}}{{#q}}{{n}}{{/q}}", {"p": ["x", "y"], "q": {"n": 2}}) == "x,y,2"
    assert show("a\n  {{#s}}\n b {{v}}\n  {{/s}}\nc", {"s": [{"v": 1}, {}], "v": 0}) == "a\n b 1\n b 0\nc"
    assert prompts.mustache_fields("{{a}}{{#b}}{{c}}{{/b}}{{a}}") == ["a", "b"]
    for bad in ("{{#a}}", "{{/a}}", "{{#a}}{{/b}}", "{{> other}}"):
        with pytest.raises(ValueError):
            prompts.parsed_mustache(bad)
    df = spark.createDataFrame([(1, None), (2, ("x",))], "id int, s struct<n:string>")
    assert [r[0] for r in df.orderBy("id").select(prompts.mustache("[{{n}}]", "s")).collect()] == ["[]", "[x]"]
    assert prompts.chat_fields(("system", "{a} {b}"), "history", ("user", "{a}")) == ["a", "b", "history"]


def test_patches_turn_one_value_into_another():
    r = random.Random(1)
    make = lambda n: {f"k{r.randrange(4)}/~{i}": r.choice([1, "x", None, True, 1.0, [r.randrange(3) for _ in range(r.randrange(4))], make(n - 1) if n else {}]) for i in range(r.randrange(4))}
    for _ in range(300):
        a, b = make(2), make(2)
        assert patches.patched(a, patches.difference(a, b)) == b
        assert patches.difference(b, json.loads(json.dumps(b))) == []
    for bad in ([{"op": "move", "path": "/a"}], [{"op": "remove", "path": "/z"}]):
        with pytest.raises((ValueError, KeyError)):
            patches.patched({"a": 1}, bad)


def test_cumulative_values_with_patches(spark):
    chunks = spark.createDataFrame([("r", i, t) for i, t in enumerate(['{"a": [1', ", 2", '], "b": "x', 'y"}', " "])], "run_id string, seq int, text string")
    got = [json.loads(r["value"]) for r in patches.cumulative_values(chunks).orderBy("seq").collect()]
    assert got == [{"a": [1]}, {"a": [1, 2]}, {"a": [1, 2], "b": "x"}, {"a": [1, 2], "b": "xy"}]
    state = None
    for r in patches.cumulative_values(chunks, diff=True).orderBy("seq").collect():
        state = patches.patched(state, json.loads(r["value"]))
    assert state == got[-1]


def test_streams_of_runs(spark, tmp_path):
    """Branches, event logs and filters run on a stream as they do on a table."""
    rows = [(1, None, "tool", "find", 1.0, 2.0, None, ["a"]), (2, 1, "llm", "say", 1.5, None, None, []), (3, 1, "tool", "sum", 1.6, 1.7, "boom", ["b"])]
    schema = "run_id long, parent_id long, kind string, name string, started double, ended double, error string, tags array<string>"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    make = lambda d: patches.wanted(patches.event_log(d), types=["tool"])
    stream = make(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("runs_seen").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["ts"], r["event"], r["run_id"], r["data"])
    assert sorted(map(key, spark.table("runs_seen").collect()), key=str) == sorted(map(key, make(df).collect()), key=str) and spark.table("runs_seen").count() == 4
    said = spark.createDataFrame([(2, 1.55, "hel"), (2, 1.56, "lo")], "run_id long, ts double, text string")
    log = [(r["event"], r["data"]) for r in patches.event_log(df, chunks=said).where("run_id = 2").orderBy("ts").collect()]
    assert log == [("on_llm_start", None), ("on_llm_stream", "hel"), ("on_llm_stream", "lo")]
    branches = patches.branches(df.select("run_id", "name"), up=F.upper("name"), id=F.col("run_id"))
    assert {(r["branch"], r["value"]) for r in branches.where("run_id = 1").collect()} == {("up", "FIND"), ("id", "1")}


def test_quotes_by_brute_force():
    r = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    for _ in range(200):
        q, c = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (5, 14))
        best = min(distance(q, c[i:j]) for i in range(len(c)) for j in range(i + 1, len(c) + 1))
        spans = evaluate.quote_spans(q, c)
        if best < len(q):
            assert spans and all(distance(q, c[a:b]) == best for a, b in spans), (q, c)
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        else:
            assert spans == []
    assert evaluate.quote_spans("abc", "xxabcxxabc") == [(2, 5), (7, 10)] and evaluate.quote_spans("abc", "xyz", 1) == []


def test_markup():
    text = "intro\n\n# A\n text \n```py\nx = 1\n```\nmore\n## B\n***\nend\n```\nopen"
    assert markup.exact_markdown(text) == [("intro\n\n", {}), (" text \n", {"Header 1": "A"}), ("```py\nx = 1\n```\n", {"Header 1": "A", "Code": "py"}), ("more\n", {"Header 1": "A"}), ("end\n", {"Header 1": "A", "Header 2": "B"})]
    assert markup.exact_markdown("# A\nb", keep_headers=True) == [("# A\nb", {"Header 1": "A"})]
    assert markup.exact_markdown("## B\nx\n# A\ny", {"#": "top"}) == [("## B\nx\n", {}), ("y", {"top": "A"})]
    page = "<h1>One</h1><p>a <b>b</b></p><h2>Two</h2>c<table><tr><td>long cell here</td></tr></table>d"
    assert markup.html_by_sections(page, {"h1": "first", "h2": "second"}) == [("One a b", {"first": "One"}), ("Two c long cell here d", {"second": "Two"})]
    got = markup.html_by_meaning(page, {"h1": "first", "h2": "second"}, 4, lambda t: t.split("\n"), keep=("table",), stop_words=frozenset({"a"}), lower=True)
    assert [m for _, m in got][0] == {"first": "One"} and any("<table><tr><td>long cell here</td></tr></table>" in t for t, _ in got) and got[0][0] == "b"
    assert markup.cut_sections([("a b", {"h": "x"})], str.split) == [("a", {"h": "x"}), ("b", {"h": "x"})]


def test_settings(spark):
    df = spark.range(3)
    build = settings.configurable(lambda by: algebra.assign(x=F.col("id") * by), settings.Field("by", int, 2))
    assert [r["x"] for r in build({})(df).collect()] == [0, 2, 4] and [r["x"] for r in build({"by": 3})(df).collect()] == [0, 3, 6]
    for bad in ({"by": "x"}, {"other": 1}):
        with pytest.raises(ValueError):
            build(bad)
    with pytest.raises(ValueError):
        settings.unique([settings.Field("a", int), settings.Field("a", str)])
    assert [f.id for f in settings.unique([settings.Field("b", int), settings.Field("a", int), settings.Field("b", int)])] == ["a", "b"]
    with pytest.raises(ValueError):
        settings.alternatives("how", "x", y=algebra.pick("id"))({})
    seen = []
    chain = settings.listened(algebra.pick("nothing"), on_start=lambda r: seen.append("start"), on_error=lambda r: seen.append(r["error"][:10]))
    with pytest.raises(ValueError):
        chain(df)
    assert seen == ["start", "ValueError"]
    assert settings.mermaid([("a", 'b"')]).split("\n")[1:] == ['  n0["a"];', '  n1["b#quot;"];', "  n0 --> n1;"] and "| a |" in settings.drawn([("a", "b"), ("a", "c")])


def test_sheets_and_comments(spark):
    md = "# One\n| a | b |\n|---|---|\n| 1 | x \\| y |\n\n# One\n| c |\n|---|\n| <&> |"
    assert sheets.read_workbook(sheets.workbook(sheets.markdown_tables(md))) == [("One", [["a", "b"], ["1", "x | y"]]), ("One 2", [["c"], ["<&>"]])]
    assert sheets.read_workbook(sheets.workbook([])) == [("Sheet", [])]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>pay </w:t></w:r><w:r><w:t>now</w:t></w:r></w:p><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>")
    df = spark.createDataFrame([("a", raw.getvalue(), [("pay now", "why"), ("absent", "no"), ("end", "when")]), ("b", b"no", [])], "path string, content binary, notes array<struct<quoted:string,note:string>>")
    out = df.select("path", sheets.with_comments("content", "notes").alias("x")).select("path", "x.content", "x.n")
    got = {r["path"]: (r["x"]["comments"], r["n"]) for r in out.select("path", "n", docx.extracted("content").alias("x")).collect()}
    assert [(c["text"], c["anchor"]) for c in map(lambda c: c.asDict(), got["a"][0])] == [("why", "pay now"), ("when", "end")] and got["a"][1] == 2 and got["b"][1] == 0


def test_agents_and_retrievers(spark):
    tasks = spark.createDataFrame([(1, "go"), (2, "broken"), (3, "never")], "run_id int, question string")
    model = lambda p: F.when(F.contains(p, F.lit("never")), "Action: x\nAction Input: y").when(F.contains(p, F.lit("neither")), "Final Answer: mended").when(F.contains(p, F.lit("broken")), "hm").otherwise("Final Answer: done")
    answers, steps = agents.loop(tasks, model, P.react_step, lambda t, i: F.lit(None).cast("string"), most=3)
    assert {r["run_id"]: (r["answer"], r["rounds"]) for r in answers.collect()} == {1: ("done", 1), 2: ("mended", 2), 3: (None, 3)}
    assert {(r["run_id"], r["step"]): r["observation"] for r in steps.collect()} == {(2, 0): "neither a final answer nor an action", **{(3, i): "no such tool" for i in range(3)}}
    rows = spark.createDataFrame([(i, [float(i), 1.0], f"t{i}") for i in range(5)], "id int, embedding array<double>, text string")
    for kind, how in (("nearest", {}), ("similarity_score_threshold", {}), ("similarity_score_threshold", {"score_threshold": 2})):
        with pytest.raises(ValueError):
            retrieval.Retriever(rows, kind, how=how)
    asked = spark.createDataFrame([(1, "x")], "query_id int, question string")
    hits = retrieval.Retriever(rows, how={"k": 1}).rephrased(asked, lambda q: F.concat(q, F.lit("!")), lambda t: F.array(F.length(t).cast("double") * 100, F.lit(1.0)))
    assert [r["id"] for r in hits.collect()] == [4]
    empty = retrieval.Retriever(rows.limit(0)).as_tool(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_embedding array<double>")).first()
    assert (empty["content"], empty["n"]) == ("", 0)


def test_experiments_memories_and_models(spark):
    with pytest.raises(ValueError):
        experiments.load_evaluators(["exact_match", "none"])
    with pytest.raises(ValueError):
        experiments.single("s", of=["a", "b"])
    a, b = (spark.createDataFrame([(1, 2)], f"conv_id int, {n} int") for n in ("x", "x"))
    with pytest.raises(ValueError):
        memory.combined(a, b)
    urls = spark.createDataFrame([("https://e.com/x", True), ("ftp://e.com/x", False), ("https://e.com.evil.com", False), ("nothing", False), (None, False)], "u string, want boolean")
    assert all(r["got"] == r["want"] for r in urls.withColumn("got", models.allowed_url("u", ["e.com"])).collect())
    assert spark.range(2).select(F.size(models.random_embedding(4, 7))).first()[0] == 4
    with pytest.raises(ValueError):
        models.routed(urls, models.echo(), "{u}", {}, "none")
    assert spark.createDataFrame([({"a": 1},)], "m map<string,int>").select(tables.stringified(F.col("m"), "map<string,int>")).first()[0] == '{"a":1}'


def test_incremental_cleanup_over_batches(spark):
    """Of a source that comes in several batches, incremental cleanup deletes what the first batch doesn't have; scoped_full only runs once all are in."""
    batch = lambda *rows: spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(rows)], "key string, source string, n int")
    start = indexing.step(batch(("a", "1"), ("b", "1"), ("c", "2")), spark.createDataFrame([], indexing.STATE), "ns", 1.0, source="source", order="n").state
    state, deleted = start, 0
    for part in (batch(("a", "1")), batch(("d", "1"))):
        s = indexing.step(part, state, "ns", 2.0, cleanup="incremental", source="source", order="n")
        state, deleted = s.state, deleted + s.counts["num_deleted"]
    assert {r["key"] for r in state.collect()} >= {"d", "c"} and deleted >= 1
    whole = indexing.step(batch(("a", "1"), ("d", "1")), start, "ns", 2.0, cleanup="scoped_full", source="source", order="n")
    assert {r["key"] for r in whole.state.collect()} == {"a", "d", "c"} and whole.counts["num_deleted"] == 1


def test_structured_answers():
    from docloom.operators import filters

    got = filters.from_answer('{"query": "", "filter": "NO_FILTER"}')
    assert got == filters.StructuredQuery(" ", None, None)
    assert filters.from_answer('x ```json\n{"query": "q", "filter": "eq(\\"a\\", 1)", "limit": "3"}\n```').limit == 3
    for bad in ("no JSON", '{"filter": "eq(\\"b\\", 1)"}'):
        with pytest.raises(ValueError):
            filters.from_answer(bad, ["a"])


def test_decisions_and_todos(spark):
    calls = spark.createDataFrame([(1, "x"), (2, "y")], "call_id int, args string")
    no = spark.createDataFrame([(1, "reject", None, None), (2, "reject", None, "why")], "call_id int, decision string, args string, message string")
    assert {r["call_id"]: (r["args"], r["run"], r["message"]) for r in agents.decided(calls, no).collect()} == {1: ("x", False, "rejected"), 2: ("y", False, "why")}
    with pytest.raises(Exception, match="no such decision"):
        agents.decided(calls, no.withColumn("decision", F.lit("maybe"))).collect()
    state = spark.createDataFrame([(1, "a", "pending")], "run_id int, item string, status string")
    with pytest.raises(Exception, match="no such status"):
        agents.todos(state, state.withColumn("status", F.lit("lost")).withColumn("step", F.lit(1))).collect()


def test_streamed_xml_ends_at_the_first_error(spark):
    chunks = spark.createDataFrame([(1, 0, "<a><b>x</b>"), (1, 1, "</c><d>y</d>"), (2, 0, "<!DOCTYPE a><a/>"), (3, 0, None), (3, 1, "<a/>")], "run_id int, seq int, text string")
    assert {(r["run_id"], r["path"], r["value"]) for r in patches.xml_elements(chunks).collect()} == {(1, "a/b", "x"), (3, "a", "")}


def test_loading_runs_nothing_unknown(spark):
    with pytest.raises(ValueError):
        algebra.loaded('{"node": "os.system", "how": {}}', {})
    with pytest.raises(TypeError):
        algebra.dumped("x", f=print)


def test_moderation_can_refuse(spark):
    df = spark.createDataFrame([("bad",), ("fine",), (None,)], "text string")
    flagged = lambda t: t == "bad"
    assert [r[0] for r in models.moderated(df, flagged, message="-").collect()] == ["-", "fine", None]
    with pytest.raises(Exception, match="flagged"):
        models.moderated(df, flagged, error=True).collect()


def test_providers_of_models(spark):
    from docloom.functions import parsers

    want = {"chatgpt-4o": ("openai", "chatgpt-4o"), "mixtral-8x7b": ("mistralai", "mixtral-8x7b"), "anthropic.claude-v2:1": ("bedrock", "anthropic.claude-v2:1"), "accounts/fireworks/x": ("fireworks", "accounts/fireworks/x"),
            "deepseek:chat": ("deepseek", "chat"), "mistral:7b": ("mistralai", "mistral:7b"), "Google-Vertexai:m:1": ("google_vertexai", "m:1"), "my-host:m": ("my_host", "m"), "text-davinci-3": ("openai", "text-davinci-3"), "other": (None, "other")}
    df = spark.createDataFrame([(k,) for k in want], "n string").select("n", parsers.provider_model("n").alias("m"))
    assert {r["n"]: (r["m"]["provider"], r["m"]["model"]) for r in df.collect()} == want
