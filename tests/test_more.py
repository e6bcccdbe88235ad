"""Merging, graphs, pages, Word files, contracts, models."""

import io
import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import web
from docloom.operators import contracts, evaluate, graph, merge, models
from docloom.sources import docx


def test_deep_merge():
    assert merge.deep_merge({"a": "x", "n": 1, "l": [{"index": 0, "t": "a"}]}, {"a": "y", "n": 2, "l": [{"index": 0, "t": "b"}, {"index": 1, "t": "c"}], "z": None}) == {"a": "xy", "n": 3, "l": [{"t": "ab", "index": 0}, {"index": 1, "t": "c"}], "z": None}
    with pytest.raises(TypeError):
        merge.deep_merge({"a": "x"}, {"a": 1})
    assert merge.deep_merge(None, 3) == 3 and merge.deep_merge([1], [2]) == [1, 2] and merge.deep_merge(True, True) is True


def test_folded_json_and_rate(spark):
    df = spark.createDataFrame([(1, 1, '{"t": "b"}'), (1, 0, '{"t": "a"}'), (2, 0, None)], "k int, o int, v string")
    assert {r["k"]: r["v"] and json.loads(r["v"]) for r in merge.folded_json(df, "k", "o", "v").collect()} == {1: {"t": "ab"}, 2: None}
    calls = spark.createDataFrame([("a", float(t)) for t in (0, 0, 0, 0.5, 1, 5)], "k string, t double")
    got = [r["allowed"] for r in merge.rate_limited(calls, 1.0, 2.0, by="k", time="t").orderBy("t").collect()]
    assert sorted(got[:3]) == [False, True, True] and got[3:] == [False, True, True]


def test_graph(spark):
    nodes = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "m")], "id string, name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    assert graph.single_end(edges, "first").collect() == [("a",)] and graph.single_end(edges, "last").collect() == [("c",)]
    assert graph.single_end(edges.union(spark.createDataFrame([("x", "c")], edges.schema)), "first").collect() == []
    assert [r["source"] for r in graph.prefixed(nodes, edges, "p")[1].collect()] == ["p:a", "p:b"]
    assert [r["new_id"] for r in graph.readable_ids(nodes).orderBy("id").collect()] == ["n_1", "n_2", "m"]
    assert '"source":"a"' in graph.as_json(nodes, edges).first()["graph"]


def test_pages():
    page = '<a href="/x#y">1</a><a href="http://other.com/p">2</a><a href="mailto:x">3</a><a href="z.png">4</a><a href="b">5</a><a href="/x">6</a>'
    assert web.absolute_links(page, "http://e.com/d/") == ["http://e.com/d/b"]
    assert web.absolute_links(page, "http://e.com/d/", base="http://e.com", exclude=("http://e.com/d/",)) == ["http://e.com/x"]
    assert "http://other.com/p" in web.absolute_links(page, "http://e.com/", outside=True)
    assert web.to_markdown('<div>a <a href="/u">l</a><img src="i.png"></div><script>x</script><table><tr><td>1</td></tr></table>', keep=("table",)) == "a [l](/u)![img:i.png](i.png)\n<table><tr><td>1</td></tr></table>"
    assert web.table_html("x\n| a | b |\n|---|---|\n| 1 | <2> |") == "<p>x</p>\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>&lt;2&gt;</td></tr></table>"
    assert json.loads(web.xml_to_json("<a><b>1</b><c/></a>")) == {"a": [{"b": "1"}, {"c": ""}]}
    assert web.xml_to_json("<!DOCTYPE x><a/>") is None and web.xml_to_json("<a>") is None


def test_word_files(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:commentRangeStart w:id="0"/><w:r><w:t>noted</w:t></w:r><w:commentRangeEnd w:id="0"/><w:r><w:t> rest</w:t></w:r></w:p><w:p/></w:body></w:document>'
    notes = f'<w:comments {w}><w:comment w:id="0" w:author="A"><w:p><w:r><w:t>why</w:t></w:r></w:p></w:comment></w:comments>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/comments.xml", notes)
    df = spark.createDataFrame([("a.docx", raw.getvalue()), ("b.docx", b"no")], "path string, content binary")
    got = {r["path"]: r["x"] for r in df.select("path", docx.extracted("content").alias("x")).collect()}
    assert [(p["text"], p["style"]) for p in got["a.docx"]["paragraphs"]] == [("Title", "Heading1"), ("noted rest", None)]
    assert [tuple(c) for c in got["a.docx"]["comments"]] == [("0", "A", "why", "noted")] and got["b.docx"]["paragraphs"] == []
    assert {r["path"]: r["text"] for r in docx.documents(df).collect()}["a.docx"] == "Title\nnoted rest"


def test_contracts(spark, tmp_path):
    risk = lambda i, text, status="accept": {"risk_id": i, "title": f"risk {text}", "clause_text": text, "explanation": "e", "suggestion": "s", "status": status}
    pay, end = "1. Payment is due within thirty days of the invoice", "2. Either party may end this contract with notice"
    data = [{"contract_id": "k", "full_contract_text": f"Contract\n{pay}\n{end}", "labels": [risk("g1", pay[3:]), risk("g2", end[3:], "reject")], "participants": {"m": [risk("p1", pay[3:]), risk("p2", "zzz unrelated words")]}}]
    (tmp_path / "c.json").write_text(json.dumps(data))
    c = contracts.read(spark, str(tmp_path / "c.json"))
    rows = contracts.clauses(c).orderBy("clause_no").collect()
    assert [r["clause_text"] for r in rows] == ["Contract", pay, end] and rows[1]["next_head"] == end
    got = {r["policy"]: (r["tp"], r["fp"], r["fn"]) for r in contracts.evaluated(c).collect()}
    assert got["all"] == (1, 0, 1) and got["adopted"] == (1, 0, 0)
    p = spark.createDataFrame([("k", 0, "Contract"), ("k", 1, pay)], "contract_id string, paragraph_no int, text string")
    assert contracts.anchors(p, contracts.clauses(c)).count() == 3
    assert [r[0] for r in spark.createDataFrame([("采纳",), ("不采纳",), ("部分采纳",), ("?",)], "t string").select(contracts.status("t")).collect()] == ["accept", "reject", "partial", "other"]


def test_models(spark):
    df = spark.createDataFrame([(1, "good text"), (2, "bad text")], "id int, text string")
    model = models.canned({"good": "YES", "bad": "NO"})
    assert [r["id"] for r in models.filtered(df, "Keep {text}?", model).collect()] == [1]
    assert models.extracted(df, "{text}", models.canned({"good": "g"})).count() == 1
    q = spark.createDataFrame([(1, "why")], "query_id int, question string")
    hits = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "query_id int, rank int, text string")
    assert models.answered(q, hits, models.echo()).first()["answer"] == "a\n\nb\n\nQuestion: why"
    texts = spark.createDataFrame([("g", i, "x" * 4) for i in range(5)], "k string, o int, text string")
    short = lambda p: F.substring(p, 1, 4)
    assert models.reduced(texts, short, F.length, 9, by="k", order="o").collect()[0]["text"] == "xxxx"


def test_json_evaluators(spark):
    df = spark.createDataFrame([('{"a": [2, 1]}', '{"a": [1, 2]}'), ("x", "x"), (None, "{}")], "p string, r string")
    assert [r[0] for r in df.select(evaluate.json_equal("p", "r")).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(evaluate.parse_partial_json("p")).collect()] == ['{"a": [2, 1]}', None, None]


def _old_partial(text):
    """By definition: the longest beginning that is JSON once its strings and brackets are closed."""
    body = text.strip()
    for end in range(len(body), 0, -1):
        stack, quoted, escaped = [], False, False
        for c in body[:end]:
            if quoted:
                quoted, escaped = (escaped or c != '"'), c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and (not stack or stack.pop() != c):
                return None
        try:
            return json.loads(body[:end] + '"' * quoted + "".join(reversed(stack)), strict=False)
        except ValueError:
            continue


def test_partial_json_by_definition_and_in_linear_time():
    whole = json.dumps({"a": [1, 2.5e3, -7, True, None, {"k": "v\\n\u00e9\"q"}], "long": "x" * 40, "e": {}, "z": [[], [False, ""]]})
    for text in (whole, whole.replace('"', '"', 1), '[1, 2.', '{"a": tru', '["\\u12', '{"a": 1,', "[1,,2", "]", "{]", "x", '"open', "12", "-"):
        for n in range(1, len(text) + 1):
            assert evaluate.partial_json(text[:n]) == _old_partial(text[:n]), text[:n]
    big = json.dumps([{"key": i, "text": "word " * 20} for i in range(5000)])
    began = time.time()
    assert len(evaluate.partial_json(big[: len(big) // 2])) >= 2499 and time.time() - began < 2


def test_reduced_goes_on_until_one_is_left_or_fails(spark):
    texts = spark.createDataFrame([("g", i, "abcd") for i in range(300)], "k string, o int, text string")
    cut = lambda p: F.substring(p, 1, 4)
    assert [r["text"] for r in models.reduced(texts, cut, F.length, 8, by="k", order="o").collect()] == ["abcd"]
    with pytest.raises(ValueError, match="too long"):
        models.reduced(texts, cut, F.length, 7, by="k", order="o")


def test_a_deep_run_tree(spark):
    runs = spark.createDataFrame([(i, i - 1 if i else None, i) for i in range(40)] + [(100, 101, 1), (101, 100, 1)], "run_id long, parent_id long, start int")
    got = {r["run_id"]: (r["trace_id"], r["depth"]) for r in graph.run_tree(runs).collect()}
    assert got == {i: (0, i) for i in range(40)}


def test_only_a_select_runs(spark):
    from docloom.operators import algebra

    spark.sql("CREATE OR REPLACE TEMPORARY VIEW v AS SELECT 1 AS a")
    spark.sql("CREATE TABLE IF NOT EXISTS only_select (a INT) USING parquet")
    try:
        assert algebra.select_only(spark, "WITH s AS (SELECT a FROM v) SELECT a + 1 AS b FROM s WHERE a IN (SELECT a FROM v);").first()["b"] == 2
        for bad in ("WITH s AS (SELECT 1 AS a) INSERT INTO only_select SELECT a FROM s", "SELECT 1; SELECT 2", "DROP TABLE only_select", "INSERT INTO only_select VALUES (1)", "WITH s AS (SELECT 1 AS a) FROM s INSERT INTO only_select SELECT a"):
            with pytest.raises(ValueError):
                algebra.select_only(spark, bad)
        assert spark.table("only_select").count() == 0
    finally:
        spark.sql("DROP TABLE only_select")


@pytest.mark.parametrize("one", [100_000, 100])
def test_numbers_of_all_rows(spark, monkeypatch, one):
    from docloom.operators import fusion, numbering
    from docloom.operators.numbering import numbered

    monkeypatch.setattr(numbering, "ONE", one)
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), F.lit("x").alias("v")).repartition(7)
    assert all(r["n"] == r["k"] for r in numbered(df, ["k"], "n").collect())
    lists = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "b")], "list_id int, rank int, key string")
    assert [(r["key"], r["position"]) for r in fusion.reciprocal_rank_fusion(lists).orderBy("position").collect()] == [("b", 1), ("a", 2)]


def test_sweep_deletes_what_is_stored(spark):
    from docloom import session

    session.sweep(spark)
    df = session.stored(spark.range(3), "x")
    assert df.count() == 3 and session.sweep(spark) == 1
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST"):
        session.stored(spark.range(3), "y").unionByName(df).count()


def test_scratch_deletes_what_is_stored_within(spark):
    from docloom import session

    outer = session.stored(spark.range(2), "x")
    with session.scratch(spark):
        inner = session.stored(spark.range(3), "y")
        assert inner.count() == 3
    assert outer.count() == 2
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST"):
        inner.count()


def test_a_made_statement_reads_what_it_may(spark, tmp_path):
    from docloom.operators import algebra

    spark.range(3).withColumnRenamed("id", "a").createOrReplaceTempView("may_read")
    spark.range(3).createOrReplaceTempView("may_not")
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert algebra.select_only(spark, "WITH c AS (SELECT a FROM MAY_READ) SELECT max(a) AS m FROM c WHERE a IN (SELECT a FROM may_read)", ["may_read"]).first()["m"] == 2
    for bad in (f"SELECT * FROM parquet.`{tmp_path}/t`", "SELECT * FROM may_not", "SELECT (SELECT max(id) FROM may_not)", "SELECT * FROM may_read WHERE EXISTS (SELECT 1 FROM may_not)", "SELECT * FROM range(3)",
                "WITH c AS (SELECT * FROM may_not) SELECT * FROM c", "SELECT a FROM may_read UNION SELECT id FROM may_not"):
        with pytest.raises(ValueError):
            algebra.select_only(spark, bad, ["may_read"])


def test_an_operator_as_a_tool(spark):
    from docloom.operators import algebra

    tool = algebra.ChainTool(lambda df: df.where("n > 0").withColumn("m", F.col("n") + F.size("tags")), "n int, tags array<string>, deep struct<a:double>", name="t", description="d", optional=("deep",))
    assert tool.schema() == {"name": "t", "description": "d", "parameters": {"type": "object", "properties": {"n": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}, "deep": {"type": "object", "properties": {"a": {"type": "number"}}}}, "required": ["n", "tags"]}}
    calls = [(1, '{"n": 2, "tags": ["a"]}'), (2, '{"n": 0, "tags": []}'), (3, None), (4, "no json"), (5, '{"tags": []}'), (6, '{"n": "x", "tags": []}'), (7, '{"n": 1, "tags": [], "deep": {"a": 1}, "more": 3}')]
    got = {r["call_id"]: (r["content"], r["error"]) for r in tool(spark.createDataFrame(calls, "call_id int, args string")).collect()}
    assert got == {1: ('{"m":3}', None), 2: (None, None), 3: (None, "the arguments aren't JSON"), 4: (None, "the arguments aren't JSON"), 5: (None, "n is missing"), 6: (None, "n is no int"), 7: ('{"m":1}', None)}
