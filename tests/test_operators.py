"""Operators on small fixtures: splitters, the filter language, indexing steps, the algebra, stores, streams."""

import datetime
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from docloom.functions import personal, text as X, vectors as V
from docloom.operators import algebra as A
from docloom.operators import evaluate, filters, fusion, indexing, messages, search, split
from docloom.sources import tables
from docloom.streaming import events as E


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


# splitting


def test_merge_carries_overlap():
    assert split.merged(["foo", "bar", "baz", "123"], " ", 7, 3) == ["foo bar", "bar baz", "baz 123"]
    assert split.merged(["a", "foo", "bar", "foo", "a", "a"], " ", 3, 0) == ["a", "foo", "bar", "foo", "a a"]
    assert split.merged(["toolong", "b"], " ", 3, 1) == ["toolong", "b"]


def test_character_and_recursive():
    assert split.by_separator("foo bar baz 123", " ", 7, 3) == ["foo bar", "bar baz", "baz 123"]
    assert split.by_separator("foo.bar.baz", r"\.", 1, 0, regex=True, keep="start") == ["foo", ".bar", ".baz"]
    text = "Hi.\n\nI'm Harrison.\n\nHow? Are? You?\nOkay then f f f f.\nThis is a weird text to write, but gotta test the splittingggg some how."
    got = split.recursive(text, 10, 0)
    assert all(len(c) <= 10 for c in got if " " in c) and "".join("".join(got).split()) == "".join(text.split())
    assert got[:4] == ["Hi.", "I'm", "Harrison.", "How? Are?"]
    r = random.Random(1)
    for _ in range(100):
        t = "".join(r.choice("ab \n") for _ in range(200))
        chunks = split.recursive(t, 12, 4)
        assert all(0 < len(c) <= 12 for c in chunks)


@pytest.mark.parametrize("language", [*split.LANGUAGES, *split.MARKUP])
def test_every_language_splits(language):
    seps = split.separators(language)
    assert seps[-4:] == split.PLAIN and len(set(seps)) == len(seps)
    assert split.recursive("x" + seps[0] + "y z" * 20, 20, 0, seps)


def test_python_code():
    code = "class A:\n\n    def f(self):\n        return 1\n\n    def g(self):\n        return 2\n\ndef h():\n    return 3"
    got = split.recursive(code, 50, 0, split.separators("python"))
    assert got[-1].startswith("def h") and any(c.startswith("def g") for c in got)
    with pytest.raises(ValueError):
        split.separators("klingon")
    with pytest.raises(ValueError):
        split.check_sizes(10, 11)


def test_start_index(spark):
    df = spark.createDataFrame([(1, "aa bb aa bb cc"), (2, None), (3, "")], "id int, text string")
    rows = split.split_documents(df, lambda t: split.by_separator(t, " ", 5, 2), overlap=2).orderBy("chunk_no").collect()
    assert all("aa bb aa bb cc"[r["start_index"] :].startswith(r["text"]) for r in rows) and {r["id"] for r in rows} == {1}


def test_token_windows(spark):
    assert one(spark, split.token_windows(F.array(*map(F.lit, "abcdefg")), 4, 1)) == [list("abcd"), list("defg")]
    assert one(spark, split.token_windows(F.array().cast("array<string>"), 4, 1)) == []
    with pytest.raises(ValueError):
        split.token_windows("t", 3, 3)


def test_markdown_sections():
    text = "# Foo\n\n## Bar\n\nHi this is Jim\nHi Joe\n\n### Boo\n\nHi Lance\n\n```\n# not a header\n```\n\n## Baz\n\nHi Molly"
    got = split.markdown_sections(text, {"#": "h1", "##": "h2", "###": "h3"})
    assert got == [
        ("Hi this is Jim  \nHi Joe", {"h1": "Foo", "h2": "Bar"}),
        ("Hi Lance  \n```  \n# not a header  \n```", {"h1": "Foo", "h2": "Bar", "h3": "Boo"}),
        ("Hi Molly", {"h1": "Foo", "h2": "Baz"}),
    ]


def test_html_sections():
    page = "<html><body><h1>Top</h1><p>one <b>two</b></p><div><h2>Sub</h2><p>three</p></div><script>no</script></body></html>"
    assert split.html_sections(page, {"h1": "h1", "h2": "h2"}) == [("Top", {"h1": "Top"}), ("one two", {"h1": "Top"}), ("Sub", {"h1": "Top", "h2": "Sub"}), ("three", {"h1": "Top", "h2": "Sub"})]


def test_json_chunks_keep_every_leaf():
    r = random.Random(2)
    grow = lambda n: {f"k{i}": grow(n - 1) if n and r.random() < 0.5 else "v" * r.randint(1, 20) for i in range(5)}
    leaves = lambda d, p=(): [x for k, v in d.items() for x in (leaves(v, (*p, k)) if isinstance(v, dict) and v else [(*p, k, json.dumps(v))])]
    for _ in range(20):
        data = grow(3)
        chunks = split.json_chunks(data, 200)
        assert sorted(x for c in chunks for x in leaves(c)) == sorted(leaves(data)) and all(len(json.dumps(c)) <= 200 * 1.2 for c in chunks)
    assert split.json_chunks({"a": [1, 2]}, 200, convert_lists=True) == [{"a": {"0": 1, "1": 2}}]


def test_blocks_and_tables(spark):
    df = spark.createDataFrame([(1, "intro\n1. one\nmore\n2. two\n| a | b |\n|---|---|\n| 1 | 2 |\n")], "doc_id int, text string")
    assert [r["block"] for r in split.numbered_blocks(df).orderBy("block_no").collect()][:2] == ["intro", "1. one\nmore"]
    assert [r["cells"] for r in split.table_rows(df).orderBy("row_no").collect()] == [["a", "b"], ["1", "2"]]


# filters


def test_filter_grammar():
    want = filters.Operation("and", (filters.Comparison("eq", "foo", "bar"), filters.Comparison("lt", "baz", 1995.25)))
    for text in ('and(eq("foo", "bar"), lt("baz", 1995.25))', "and(eq('foo', 'bar'),lt('baz',1995.25))", ' and ( eq ( "foo" , "bar" ) , lt( "baz" , 1995.25 ) ) '):
        assert filters.parse(text) == want
    assert filters.parse('in("a", ["x", 1, true, []])').value == ["x", 1, True, []]
    assert filters.parse('eq("d", 2020-01-02)').value == datetime.date(2020, 1, 2)
    assert filters.parse('and(eq("a", 1))') == filters.Comparison("eq", "a", 1)
    for bad in ('eq("a")', "foo(1)", 'eq("a", 1', 'eq("a", 1) x', "and()", "", 'not(eq("a",1), eq("b",2))'):
        with pytest.raises(ValueError):
            filters.parse(bad)
    with pytest.raises(ValueError):
        filters.parse('eq("a", 1)', attributes=["b"])
    assert filters.prune(want, comparators=["eq"]) == filters.Comparison("eq", "foo", "bar")
    assert filters.prune(want, attributes=[]) is None


def test_nested_dict_filter(spark):
    df = spark.createDataFrame([(1, (5, "x"), ["p", "q"]), (2, (6, "y"), ["q"])], "id int, m struct<n:int,s:string>, tags array<string>")
    assert [r["id"] for r in df.where(filters.from_dict({"m": {"n": 5}, "tags": ["p"]})).collect()] == [1]
    assert [r["id"] for r in df.where(filters.from_dict({"$not": {"m": {"s": "x"}}})).collect()] == [2]


def test_frame_query_errors(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "k int, v double")
    assert filters.frame_query(df, "mean:v[0,2]", "k").first()["mean"] == 2.5
    assert filters.frame_query(df, "row:1[v]", "k").collect() == [(2.0,)]
    for bad in ("nonsense", "mean:x", "row:1[z]", "explode:v"):
        with pytest.raises(ValueError):
            filters.frame_query(df, bad, "k")


# indexing


def test_index_steps(spark):
    batch = lambda *rows: spark.createDataFrame(rows, "key string, source string, n int")
    state = spark.createDataFrame([], indexing.STATE)
    s = indexing.step(batch(("a", "1", 0), ("b", "1", 1), ("b", "1", 2), ("c", "2", 3)), state, "ns", 1.0, cleanup="incremental", source="source", order="n")
    assert s.counts == {"num_added": 3, "num_updated": 0, "num_skipped": 1, "num_deleted": 0} and s.write.count() == 3
    s2 = indexing.step(batch(("a", "1", 0), ("d", "1", 1)), s.state, "ns", 2.0, cleanup="incremental", source="source", order="n")
    assert s2.counts == {"num_added": 1, "num_updated": 0, "num_skipped": 1, "num_deleted": 1}
    assert {r["key"] for r in s2.delete.collect()} == {"b"} and {r["key"] for r in s2.state.collect()} == {"a", "c", "d"}
    s3 = indexing.step(batch(("a", "1", 0)), s2.state, "ns", 3.0, cleanup="full", source="source", force=True)
    assert s3.counts == {"num_added": 0, "num_updated": 1, "num_skipped": 0, "num_deleted": 2}
    assert indexing.step(batch(("x", None, 0)), s2.state, "other", 3.0).counts["num_added"] == 1
    for how in ({"cleanup": "incremental"}, {"cleanup": "odd"}):
        with pytest.raises(ValueError):
            indexing.step(batch(("x", "1", 0)), state, "ns", 1.0, **how)
    with pytest.raises(ValueError):
        indexing.step(batch(("x", None, 0)), state, "ns", 1.0, cleanup="scoped_full", source="source")
    assert [r["key"] for r in indexing.list_keys(s2.state, "ns", after=1.5).orderBy("key").collect()] == ["a", "d"]
    with pytest.raises(ValueError):
        indexing.update_records(state, "ns", batch(("x", "1", 0)).select("key", F.col("source").alias("group_id")), 1.0, at_least=2.0)


def test_hashes(spark):
    df = spark.createDataFrame([("t", "m"), (None, None)], "t string, m string")
    for algorithm in ("sha256", "sha512", "blake2b", "sha1"):
        got = [r[0] for r in df.select(indexing.document_hash("t", "m", algorithm)).collect()]
        assert len(set(got)) == 2
        if algorithm == "sha1":
            assert all(uuid.UUID(g).version == 5 for g in got)
    assert one(spark, indexing.metadata_json(b=F.lit('q"'), a=F.lit(None).cast("string"))) == '{"a": null, "b": "q\\""}'


# algebra


def test_chain_is_one_plan(spark):
    chain = A.node(lambda d: d.where("id > 2")) | A.assign(y=F.col("id") * 2, id=F.col("id") + 1) | {"sum": F.col("id") + F.col("y"), "y": F.col("y")}
    assert [tuple(r) for r in chain(spark.range(5)).collect()] == [(10, 6), (13, 8)]
    assert chain.graph() == [("<lambda>", "assign"), ("assign", "fan_out")] and "sum" in chain.schema(spark.range(1))
    with pytest.raises(ValueError):
        A.pick("z")(spark.range(1))
    with pytest.raises(TypeError):
        A.node(3)


def test_branch_route_fallback(spark):
    df = spark.range(3)
    kind = A.branch((F.col("id") == 0, F.lit("zero")), (F.col("id") < 2, F.lit("one")), default=F.lit("many"))
    assert [r[0] for r in df.select(kind).collect()] == ["zero", "one", "many"]
    assert one(spark, A.route(F.lit("b"), {"a": F.lit(1), "b": F.lit(2)})) == 2
    with pytest.raises(Exception, match="no route"):
        one(spark, A.route(F.lit("z"), {"a": F.lit(1)}))
    assert one(spark, A.first_that_works(F.lit("x").try_cast("int"), F.lit(7))) == 7


def test_errors_are_kept(spark):
    def risky(x):
        if x == 1:
            raise ValueError("one")
        return x * 10

    rows = spark.range(3).select("id", A.caught(risky, "long")("id").alias("r"))
    assert [(r["id"], r["r"]["value"], r["r"]["error"]) for r in rows.orderBy("id").collect()] == [(0, 0, None), (1, None, "ValueError: one"), (2, 20, None)]
    assert rows.where(A.ok("r")).count() == 2
    r = spark.range(1, 2).select(A.caught(risky, "long", attempts=3, fallbacks=(lambda x: -x,))("id").alias("r")).first()["r"]
    assert (r["value"], r["error"], r["attempts"]) == (-1, None, 4)
    r = spark.range(1, 2).select(A.caught(risky, "long", attempts=3, retry_on=(KeyError,))("id").alias("r")).first()["r"]
    assert r["attempts"] == 1


def test_tools(spark):
    @A.tool
    def add(a: int, b: int = 1) -> int:
        """Adds."""
        return a + b

    assert add.schema()["parameters"] == {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "required": ["a"]}
    assert one(spark, add("a", "b"), a=2, b=3) == 5
    add.register(spark)
    assert spark.sql("SELECT add(1, 2)").first()[0] == 3
    assert A.select_only(spark, "SELECT 1 AS x;").first()[0] == 1
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            A.select_only(spark, bad)
    assert A.merged_config({"tags": ["b"], "metadata": {"x": 1}}, None, {"tags": ["a"], "metadata": {"y": 2}, "n": 3}) == {"tags": ["a", "b"], "metadata": {"x": 1, "y": 2}, "n": 3}


# vectors, fusion, messages


def test_vector_edges(spark):
    z = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, V.cosine(z(0, 0), z(1, 2))) == 0.0 and one(spark, V.cosine(z("nan", 1), z(1, 2))) == 0.0
    with pytest.raises(Exception, match="widths"):
        one(spark, V.cosine(z(1), z(1, 2)))
    sparse = lambda i, v: F.struct(F.array(*map(F.lit, i)).alias("indices"), F.array(*map(F.lit, v)).alias("values"))
    assert one(spark, V.sparse_dot(sparse([1, 5], [2.0, 3.0]), sparse([5, 7], [4.0, 1.0]))) == 12.0


def test_mmr_with_weight_one_is_top_k(spark):
    r = random.Random(1)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(40)], "id int, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.5, 0.0])], "query_id int, query_embedding array<double>")
    near = [x["id"] for x in search.top_k(rows, q, k=5).orderBy("rank").collect()]
    assert [x["id"] for x in search.mmr_search(rows, q, k=5, weight=1.0).orderBy("position").collect()] == near
    assert [x["id"] for x in search.mmr_search(rows, q, k=5, weight=0.2).orderBy("position").collect()][0] == near[0]


def test_tool_messages(spark):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("user", "b"), ("tool", "t1"), ("tool", "t2"), ("ai", "c")])], "conv_id int, turn int, role string, text string")
    assert [(r["role"], r["text"]) for r in messages.merge_runs(df).orderBy("turn").collect()] == [("user", "a\nb"), ("tool", "t1"), ("tool", "t2"), ("ai", "c")]
    assert [r["text"] for r in messages.clear_old_tool_results(df, 1).orderBy("turn").collect()] == ["a", "b", "[cleared]", "t2", "c"]
    with pytest.raises(Exception, match="unknown role"):
        one(spark, messages.role(F.lit("king")))
    with pytest.raises(Exception, match="longer"):
        messages.pack_consecutive(df, F.lit(9), 5, by="conv_id", order="turn").collect()


def test_first_by_key_and_matching(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "y")], "id int, k string, v string")
    assert sorted((r["id"] for r in fusion.first_by_key(df, ["k"], ["id"]).collect())) == [1, 3]
    scored = spark.createDataFrame([("c", 1, 10, 0.9), ("c", 2, 10, 0.95), ("c", 2, 11, 0.5), ("c", 3, 11, 0.2)], "g string, l int, r int, score double")
    got = evaluate.greedy_pairs(scored, "g", 0.45, left_id="l", right_id="r").orderBy("l").collect()
    assert [(x["l"], x["r"]) for x in got] == [(1, 10), (2, 11)]


def test_scores():
    assert evaluate.partial_json('{"a": [1, 2, {"b": "x') == {"a": [1, 2, {"b": "x"}]} and evaluate.partial_json("") is None and evaluate.partial_json("}") is None
    assert evaluate.edit_distance("ab", "ba", swaps=True) == 1 and evaluate.edit_distance("abc", "axc", replace=2) == 2 and evaluate.hamming("abc", "abd") == 1
    assert evaluate.canonical({"b": [2, 1], "a": 1}) == {"a": 1, "b": [1, 2]}
    assert round(evaluate.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611


# text and personal data


def test_text_functions(spark):
    assert one(spark, X.grade(F.lit("so GRADE: INCORRECT"))) == 0 and one(spark, X.verdict(F.lit("well\nY"))) == 1
    assert one(spark, X.pairwise_choice(F.lit("[[A]] or [[B]]"))) == "B" and one(spark, X.bracket_score(F.lit("is [[7]]"), 10)) == 0.7
    assert one(spark, X.comma_list(F.lit("a, b,,c"))) == ["a", "b", "c"] and one(spark, X.numbered_list(F.lit("1. x\n2. y"))) == ["x", "y"] and one(spark, X.bullet_list(F.lit("- x\n* y"))) == ["x", "y"]
    assert one(spark, X.fenced(F.lit("so ```json\n{}\n``` end"))) == "{}" and one(spark, X.json_valid(F.lit("{oops"))) == 0
    assert one(spark, X.without_thoughts(F.lit("<think>a</think>b<think>c"))) == "b" and one(spark, X.snake_case(F.lit("OneTwo"))) == "one_two"
    assert one(spark, X.template("{{x}} {a}", a=F.lit(1))) == "{x} 1" and X.template_fields("{a} {b} {a}") == ["a", "b"]
    for bad in ("{a.b}", "{a[0]}", "{"):
        with pytest.raises(ValueError):
            X.template(bad)
    with pytest.raises(ValueError):
        X.arithmetic("__import__('os')")
    assert one(spark, X.arithmetic("(1 + 2) * 3")) == 9.0 and one(spark, X.yes_no(F.lit("Yes."))) is True
    with pytest.raises(Exception, match="ambiguous"):
        one(spark, X.yes_no(F.lit("yes no")))
    assert one(spark, X.token_overlap(F.lit("a b c"), F.lit("b c d e"))) == 0.5


@pytest.mark.parametrize(
    ("kind", "strategy", "text", "want"),
    [
        ("email", "redact", "to a@b.co!", "to [REDACTED_EMAIL]!"),
        ("email", "mask", "to joe@mail.example.com", "to joe@****.com"),
        ("credit_card", "mask", "4111-1111-1111-1111 4111-1111-1111-1112", "****-****-****-1111 4111-1111-1111-1112"),
        ("credit_card", "redact", "4111 1111 1111 1111", "[REDACTED_CREDIT_CARD]"),
        ("ip", "mask", "at 10.0.0.25, 999.1.1.1", "at *.*.*.25, 999.1.1.1"),
        ("mac_address", "mask", "00:1A:2B:3C:4D:5E", "**:**:**:**:**:5E"),
        ("url", "mask", "see https://e.com/x", "see [MASKED_URL]"),
        ("email", "hash", "a@b.co", "<email_hash:" + __import__("hashlib").sha256(b"a@b.co").hexdigest()[:8] + ">"),
    ],
)
def test_personal(spark, kind, strategy, text, want):
    assert one(spark, personal.apply(F.lit(text), kind, strategy)) == want
    if strategy == "redact":
        with pytest.raises(Exception, match="found in text"):
            one(spark, personal.apply(F.lit(text), kind, "block"))
        with pytest.raises(ValueError):
            personal.apply("x", kind, "shred")


# sources


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    (tmp_path / "b.csv").write_text("x,y\n1,\"two\nlines\"\n")
    (tmp_path / "c.json").write_text('{"body": "t", "n": 1}')
    (tmp_path / "d.xml").write_text("<r><row><v>1</v></row><row><v>2</v></row></r>")
    (tmp_path / "e.docx").write_bytes(b"PK\x03\x04zip")
    assert tables.text_files(spark, str(tmp_path), glob="*.txt").first()["text"] == "hello\nworld"
    assert tables.csv_documents(spark, str(tmp_path / "b.csv"), "x int, y string").first()["text"] == "x: 1\ny: two\nlines"
    assert tables.json_documents(spark, str(tmp_path / "c.json"), "body").first()["text"] == "t"
    assert tables.xml_rows(spark, str(tmp_path / "d.xml"), "row").count() == 2
    blobs = {r["path"].rsplit("/")[-1]: r for r in tables.blobs(spark, str(tmp_path)).withColumn("kind", tables.sniffed("content")).collect()}
    assert blobs["a.txt"]["mime_type"] == "text/plain" and blobs["e.docx"]["kind"] == "docx"
    lines = tables.lines(spark, str(tmp_path / "a.txt"))
    assert tables.grep(lines, "^w", mode="count").first()["n"] == 1 and tables.grep(lines, "o", mode="files_with_matches").count() == 1
    assert tables.found_files(spark, str(tmp_path), "*.{txt,csv}").count() == 2
    d = tables.documents(spark.createDataFrame([("t", 1, None)], "t string, a int, b string"), "t", source=F.lit("s")).first()
    assert d["metadata"] == {"a": "1", "source": "s"}


def test_keyed_store(spark, tmp_path):
    s = tables.KeyedStore(spark, str(tmp_path / "kv"))
    s = s.set(spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, value binary"))
    s = s.set(spark.createDataFrame([("b", b"3"), ("c/d", b"4")], "key string, value binary")).delete(["a"])
    got = s.get(spark.createDataFrame([("b", 0), ("a", 1)], "key string, pos int")).orderBy("pos").collect()
    assert [r["value"] and bytes(r["value"]) for r in got] == [b"3", None] and s.keys("c").count() == 1
    for bad in ("../x", "/etc", "a b"):
        with pytest.raises(ValueError):
            tables.checked_key(bad)


def test_report(spark, tmp_path):
    tables.write_report(spark.createDataFrame([("a", 1)], "k string, n int"), str(tmp_path / "r"), "Title")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r/markdown")).collect()] == ["# Title", "", "| k | n |", "|---|---|", "| a | 1 |"]


# streams


def test_streams(spark, tmp_path):
    rows = [(f"c{i % 2}", i, "user" if i % 4 < 2 else "ai", f"m{i}", datetime.datetime(2024, 1, 1, 0, i)) for i in range(6)]
    schema = "conv_id string, turn int, role string, text string, ts timestamp"
    for i in range(0, 6, 2):
        spark.createDataFrame(rows[i : i + 2], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    got = run(E.chat_history(stream()), "history", "update")
    assert max((r for r in got if r["conv_id"] == "c0"), key=lambda r: r["n"])["transcript"] == "user: m0\nai: m2\nuser: m4"
    n = run(E.tumbling(stream(), "2 minutes", [], [F.count("*").alias("n")], late="1 minute"), "windows", "append")
    assert all(r["n"] == 2 for r in n) and n
    items = run(E.complete_items(stream().select(F.lit(1).alias("run_id"), F.col("turn").alias("seq"), F.concat("text", F.lit(",x")).alias("text"))), "items", "append")
    assert [r["item"] for r in sorted(items, key=lambda r: r["item_no"])][:2] == ["m0", "xm1"]
    assert len(run(E.once(stream(), ["conv_id"]), "once", "append")) == 2


def test_durations(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "chain_start", t), (1, "chain_end", t + datetime.timedelta(seconds=3)), (2, "llm_start", t)], "run_id int, event string, ts timestamp")
    assert {r["run_id"]: r["seconds"] for r in E.durations(df).collect()} == {1: 3.0, 2: None}
