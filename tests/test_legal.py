"""Contract texts: a second pass changes nothing, edges of the alignment, mixed layouts."""

from docloom.operators import legal

CONTRACT = """技术服务协议
- **不是章节**

**一、总则**
- **定义**
- **（一）范围**
3. first
    7. second

9. third
    indented text
    - bullet stays
text <!-- image --> here


**（二）其他**
1. again
**十九、附则**
- **末章**
- **再一章**
5. not below a subsection"""


def tidy(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r["text"] for r in legal.tidied(df).orderBy("doc_id").collect()]


def test_order_in_markdown(spark):
    one, empty, none, heading = tidy(spark, CONTRACT, "", None, "**一、总则**\n")
    assert one == "\n".join([
        "# 技术服务协议", "", "**不是章节**", "", "**一、总则**", "", "**二、定义**", "", "**（一）范围**", "", "1. first", "2. second", "", "3. third", "indented text", "    - bullet stays", "", "<!-- image -->", "",
        "**（二）其他**", "", "1. again", "", "**十九、附则**", "", "**二十、末章**", "", "**二十一、再一章**", "", "5. not below a subsection"])
    assert (empty, none, heading) == ("", None, "**一、总则**\n")
    assert tidy(spark, one, empty, none, heading) == [one, empty, none, heading]
    assert [legal.numeral(n) for n in (1, 10, 11, 20, 21, 99, 100, 0)] == ["一", "十", "十一", "二十", "二十一", "九十九", "100", "0"]


def restore(spark, lines, paragraphs):
    a = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_no int, line string")
    b = spark.createDataFrame([(1, i, x) for i, x in enumerate(paragraphs)], "doc_id int, pos int, paragraph string")
    return [(r["line"], r["how"]) for r in legal.restored(a, b).orderBy("line_no").collect()]


def test_lost_paragraphs(spark):
    source = ["Title", "1、alpha", "2、beta", "2.1 sub beta", "2.2 sub gamma", "3、delta", "no number", None, "4、delta"]
    assert restore(spark, ["Title", "**1、alpha**", "beta", ".1", "3、 delta", "extra"], source) == [
        ("Title", "kept"), ("**1、alpha**", "kept"), ("2、beta", "mended"), ("2.1 sub beta", "mended"), ("2.2 sub gamma", "inserted"), ("3、 delta", "kept"), ("4、delta", "inserted"), ("extra", "kept")]
    # ahead of the first known line, and nothing to go by
    assert [x for x, _ in restore(spark, ["2、beta"], source[:3])] == ["1、alpha", "2、beta"]
    assert restore(spark, ["other", None], source) == [("other", "kept"), ("", "kept")]
    # a line out of its order is no anchor
    assert [x for x, _ in restore(spark, ["3、delta", "1、alpha", "2.1 sub beta", "2.2 sub gamma"], source[1:6])] == ["3、delta", "1、alpha", "2、beta", "2.1 sub beta", "2.2 sub gamma", "3、delta"]


def test_mixed_layouts(spark):
    text = "**1. 风险 A**\n\n具体条款：c1\n\n风险说明：e1\n\n**2. nothing telling**\n\nbody\n\n3、问题 B\n说明\n修改建议：s3\nclause【批注#7/x: 违约 no split】 tail"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = {(r["layout"], r["item_no"], r["title"], r["clause_text"], r["explanation"], r["suggestion"]) for r in legal.risk_items(df).collect()}
    assert ("report", 1, "风险 A", "c1", "e1", "") in got and ("section", 3, "问题 B", "", "", "s3") in got
    assert ("comment", 1, "违约 no split", "clause tail", "违约 no split", "") in got
    assert not [x for x in got if x[0] == "section" and x[1] == 1]


def test_texts_are_tidied_where_they_lie(spark):
    """No line is shuffled, and rows that share a key or have none are texts of their own."""
    df = spark.createDataFrame([(1, CONTRACT), (1, "- **x**\r\n\r\n\r\ny"), (None, "**一、总则**")], "doc_id int, text string")
    out = legal.tidied(df)
    assert {(r["doc_id"], r["text"]) for r in out.collect()} >= {(None, "**一、总则**\n"), (1, "**x**\n\ny")}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_meet_their_places_at_the_end(spark, monkeypatch):
    """What the alignment stores and shuffles holds no text; lines without a key stay."""
    seen, stored = [], legal.stored
    monkeypatch.setattr(legal, "stored", lambda df, name: seen.append(df.columns) or stored(df, name))
    a = spark.createDataFrame([(1, 0, "1、alpha"), (None, 0, "lone"), (1, 1, "3、delta")], "doc_id int, line_no int, line string")
    b = spark.createDataFrame([(1, i, x) for i, x in enumerate(["1、alpha", "2、beta", "3、delta"])], "doc_id int, pos int, paragraph string")
    got = {tuple(r) for r in legal.restored(a, b).collect()}
    assert got == {(1, 0, "1、alpha", "kept"), (1, 1, "2、beta", "inserted"), (1, 2, "3、delta", "kept"), (None, 0, "lone", "kept")}
    assert seen and not {"line", "paragraph"} & {c for columns in seen for c in columns}
