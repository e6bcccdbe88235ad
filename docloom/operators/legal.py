"""Text of contracts in Markdown: headings and numbers put in order, paragraphs that a converter lost, risks that reviewers wrote down."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import compact, for_match
from docloom.operators import split
from docloom.operators.folds import folded
from docloom.session import stored

# Numerals, the word of a title, marks of fields and of risks, as contracts and reviewers write them.
DIGITS = "一二三四五六七八九十"
TITLE = "协议"
IMAGE = "<!-- image -->"
CLAUSE_WORDS, EXPLANATION_WORDS, SUGGESTION_WORDS = ("具体条款",), ("风险说明", "问题说明", "修改理由"), ("修改建议", "建议修改")
CLAUSE_HEADER, REASON_HEADER = "条款原文", "修改理由"
SIGNALS = ("风险", "问题", "瑕疵", "违约", "争议", "不明确", "缺失", "修改建议", "修改理由", "风险说明", "问题说明", "审查意见", "批注#")


def numeral(n: int) -> str:
    """1 to 99 in Chinese numerals; others in digits."""
    if not 1 <= n <= 99:
        return str(n)
    tens, ones = divmod(n, 10)
    return (DIGITS[tens - 1] if tens > 1 else "") + ("十" if tens else "") + (DIGITS[ones - 1] if ones else "")


_VALUES = {numeral(n): n for n in range(1, 100)}
_SECTION = re.compile(rf"\*\*([{DIGITS}]+)、[^*]+\*\*$")
_SUB = re.compile(rf"\*\*[（(][{DIGITS}]+[)）][^*]*\*\*$")
_BULLET = re.compile(r"-\s+\*\*([^*]+)\*\*$")
_ITEM = re.compile(r"(\d+)\.\s+(.*)$")


_BREAK = re.compile(r"\r?\n")


def _tidied(text: str) -> list[str]:
    """The lines of a document in order, in one pass."""
    section, sub, count = None, False, 0
    seen, titled, out = 0, False, []
    for line in _BREAK.split(text):
        s, indented = line.strip(), line.startswith("    ")
        heading = bullet = False
        if not s:
            if out and out[-1]:
                out.append("")
            continue
        seen += 1
        if s[0] == "-" and not indented and (m := _BULLET.match(s)):
            bullet, title = True, m[1].strip()
            s = f"**{title}**" if title.startswith("（") or section is None else f"**{numeral(section + 1)}、{title}**"
        bold = s.startswith("**")
        if bold and (m := _SECTION.match(s)):
            section, sub, heading = _VALUES.get(m[1], section), False, True
        elif bold and _SUB.match(s):
            sub, count, heading = True, 0, True
        elif m := _ITEM.match(s):
            if sub:
                count += 1
            s = f"{count if sub else m[1]}. {m[2].strip()}" if sub or indented else line.rstrip()
        elif indented and s.startswith(("- ", "* ", "|")):
            s = line.rstrip()
        elif IMAGE in s:
            s, heading = IMAGE, True
        elif not bullet and not indented:
            s = line.rstrip()
        if not titled:
            if seen <= 20 and TITLE in s:
                bare = s[2:-2].strip() if s.startswith("**") and s.endswith("**") and len(s) > 4 else s.strip()
                if TITLE in bare and len(bare) <= 50 and not bare.startswith("#") and not _SUB.match(s) and not _SECTION.match(s) and not _ITEM.match(s) and not s.startswith((" ", "|", "- ", "* ")):
                    s = f"# {bare}"
            titled = s.startswith("# ") or bool(_SECTION.match(s))
        if heading or s.startswith("# "):
            out += [*([""] if out and out[-1] else []), s, ""]
        else:
            out.append(s)
    return out


def tidied(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text: Markdown of contracts in order, in one pass over each document's lines, where its row lies; a second pass changes nothing.

    ``**三、..**`` are sections; a bold bullet after one is the next section, a bold bullet in brackets a subsection. Items
    below a subsection are numbered from 1. What an indent of four hides comes out, but for bullets and tables. A line with
    ``TITLE`` among the first twenty that aren't empty, before any section, is the title. Titles, sections, subsections and
    images stand between empty lines, and there are never two of those in a row. Null texts stay null.
    """
    schema = docs.select(key, F.col(text).cast("string").alias(text)).schema

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if t.as_py() is None else "\n".join(_tidied(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [key, text])

    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(tidy, schema)


class _Chain:
    """The longest run of pairs that ascends in both numbers; the pairs come in order of the first."""

    def __init__(self):
        self.pairs, self.tops, self.before = [], [], []

    def step(self, pos: int, line_no: int) -> list[tuple]:
        at = bisect_left(self.tops, line_no, key=lambda i: self.pairs[i][1])
        self.before.append(self.tops[at - 1] if at else None)
        self.pairs.append((pos, line_no))
        self.tops[at : at + 1] = [len(self.pairs) - 1]
        return []

    def end(self) -> list[tuple]:
        out, i = [], self.tops[-1] if self.tops else None
        while i is not None:
            out.append(self.pairs[i])
            i = self.before[i]
        return out[::-1]


_NUMBERED = rf"^(?:[{DIGITS}]+、|\d+、|\d+\.\d+|[（(][{DIGITS}0-9]+[)）])"


def restored(lines: DataFrame, source: DataFrame, *, by: str = "doc_id") -> DataFrame:
    """by, line_no (from 0), line and how (kept, mended or inserted): lines (by, line_no, line) with the numbered paragraphs of a source (by, pos, paragraph) that they lack.

    The k-th line of a text is the k-th paragraph of that text (marks and white space don't count), and of those pairs the
    longest run that ascends in both is taken. A paragraph that isn't among them, between the lines of its neighbours, is
    mended where its number or, failing that, its words stand alone, else inserted behind the line of the paragraph before it, or ahead of
    that of the one after it. Paragraphs without a number, and documents without any pair, are left as they are.
    """
    nth = lambda df, order: df.withColumn("nth", F.row_number().over(Window.partitionBy(by, "norm").orderBy(order)))
    # texts are compared by 16 bytes and meet their places at the end, so that each is shuffled once
    name = lambda norm: F.when(norm != "", F.unhex(F.md5(norm)))
    lines = lines.select(by, "line_no", F.coalesce("line", F.lit("")).alias("line"))
    source = source.where(F.col("paragraph").isNotNull()).select(by, "pos", F.trim("paragraph").alias("paragraph"))
    # a number or the words alone
    number = F.regexp_extract("paragraph", r"^(\d+、|\d+\.\d+)", 1)
    words = for_match(F.regexp_replace("paragraph", r"^(?:\d+、|\d+\.\d+\s*)", ""))
    kinds = F.array(*(F.struct(F.lit(i).alias("kind"), name(x).alias("norm")) for i, x in enumerate((for_match(number), for_match(F.regexp_replace(number, r"^\d+(?=\.)", "")), words))))
    l = stored(lines.select(by, "line_no", name(for_match("line")).alias("norm")), "lines")
    s = stored(source.select(by, "pos", name(for_match("paragraph")).alias("norm"), F.when(F.col("paragraph").rlike(_NUMBERED), kinds).alias("kinds")), "paragraphs")
    same = nth(s.where("norm IS NOT NULL").select(by, "norm", "pos"), "pos").join(nth(l.where("norm IS NOT NULL"), "line_no"), [by, "norm", "nth"]).select(by, "pos", "line_no")
    chain = stored(folded(same, _Chain, "pos int, line_no int", by=by, order=["pos"], values=["pos", "line_no"]), "chain")
    w = Window.partitionBy(by).orderBy("pos")
    placed = s.select(by, "pos", "kinds").join(chain, [by, "pos"], "left").withColumn("before", F.last("line_no", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first("line_no", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    lost = stored(placed.where("line_no IS NULL AND (before IS NOT NULL OR after IS NOT NULL) AND kinds IS NOT NULL").drop("line_no"), "lost")
    # on a line that no paragraph has
    marks = lost.select(by, "pos", "before", "after", F.inline("kinds")).where("norm IS NOT NULL")
    free = l.join(chain.select(by, "line_no"), [by, "line_no"], "left_anti").select(by, "norm", "line_no")
    found = marks.join(free, [by, "norm"]).where("(before IS NULL OR line_no > before) AND (after IS NULL OR line_no < after)")
    first = lambda of, order: F.row_number().over(Window.partitionBy(by, of).orderBy("kind", order))
    one = found.withColumn("i", first("pos", "line_no")).where("i = 1").withColumn("j", first("line_no", "pos")).where("j = 1")
    one = stored(one.select(by, "pos", "line_no"), "mended")
    # inserted behind what is before it, a mended line too
    known = s.select(by, "pos").join(chain.unionByName(one), [by, "pos"], "left").withColumn("behind", F.last("line_no", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("line_no IS NULL").select(by, "pos", "behind")
    new = lost.join(known, [by, "pos"]).select(by, F.coalesce("behind", "after").alias("line_no"), F.when(F.col("behind").isNull(), -1).otherwise(1).alias("side"), "pos", F.lit("inserted").alias("how"))
    old = l.select(by, "line_no").join(one, [by, "line_no"], "left").select(by, "line_no", F.lit(0).alias("side"), "pos", F.when(F.col("pos").isNull(), "kept").otherwise("mended").alias("how"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("line_no", "side", "pos")) - 1
    rows = stored(old.unionByName(new).withColumn("place", place), "places")

    def told(texts: DataFrame, at: str, text: str, which: Column) -> DataFrame:
        mine = rows.where(which).select(F.col(by).alias("__by"), F.col(at).alias("__at"), "place", "how")
        return texts.join(mine, F.col(by).eqNullSafe(F.col("__by")) & F.col(at).eqNullSafe(F.col("__at"))).select(by, F.col("place").alias("line_no"), F.col(text).alias("line"), "how")

    kept = F.col("how") == "kept"
    return told(lines, "line_no", "line", kept).unionByName(told(source, "pos", "paragraph", ~kept))


def _said(words: tuple[str, ...], body: Column | str, more: str = r".+?(?=\n\s*\n|\z)") -> Column:
    """What follows one of the words and a colon, up to an empty line."""
    return compact(F.regexp_extract(body, rf"(?s)(?:{'|'.join(words)})[:：]\s*({more})", 1))


def risk_items(docs: DataFrame, *, key: str = "doc_id", text: str = "text", signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """key, layout, item_no, title, clause_text, explanation and suggestion: the risks in reviewers' Markdown, in four layouts.

    ``report``: a bold numbered title and fields below it (``具体条款: ..``). ``section``: a numbered line and what is below it,
    with fields or, ``table``, a table of the clause and its new text, and of reasons. ``comment``: notes in a line
    (``【批注#1/name: ..】``, which may be split by ``【风险点】``, ``【说明】`` and ``【修改建议】``); the rest of the line is the clause.
    Items without any of the words that tell of a risk are left out. A text that reads in several layouts gives its items
    once: of those of the same number or the same four fields (their first letters), the first layout's stays.
    """
    docs = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__text"))
    telling = lambda *c: F.concat_ws(" ", *c).rlike("|".join(map(re.escape, signals)))
    fields = ["title", "clause_text", "explanation", "suggestion"]
    report = docs.select(key, F.explode(F.regexp_extract_all("__text", F.lit(r"(?s)\*\*\d+\.\s*[^*]+?\*\*.*?(?=\n\*\*\d+\.\s*|\z)"), F.lit(0))).alias("b"))
    report = report.select(
        key, F.lit("report").alias("layout"), F.regexp_extract("b", r"^\*\*(\d+)", 1).cast("int").alias("item_no"), compact(F.regexp_extract("b", r"^\*\*\d+\.\s*([^*]+?)\*\*", 1)).alias("title"),
        _said(CLAUSE_WORDS, "b").alias("clause_text"), _said(EXPLANATION_WORDS, "b").alias("explanation"), _said(SUGGESTION_WORDS, "b").alias("suggestion"), F.lit("").alias("rest"),
    )
    # one section for each numbered line, but those a report has
    blocks = split.numbered_blocks(docs, key=key, text="__text", start=r"^\s*(?:\*\*\s*)?\d+[、.]\s*\S").where("block_no > 0")
    blocks = blocks.withColumn("head", F.regexp_replace(F.trim(F.substring_index("block", "\n", 1)), r"^\*\*\s*|\s*\*\*$", "")).withColumn("item_no", F.regexp_extract("head", r"^(\d+)", 1).cast("int"))
    cells = split.table_rows(blocks.select(F.struct(key, "block_no").alias("__b"), "block"), key="__b", text="block").where("table_no = 1")
    clean = F.transform("cells", lambda c: compact(F.regexp_replace(c, r"<br\s*/?>|\*\*", " ")))
    cells = cells.select("__b", "row_no", clean.alias("cells"))
    after = Window.partitionBy("__b").orderBy("row_no")
    cells = cells.withColumn("next", F.lead("cells").over(after))
    longest = F.coalesce(F.element_at(F.array_sort(F.filter("next", lambda c: c != ""), lambda a, b: F.length(b) - F.length(a)), 1), F.lit(""))
    reasons = F.get("cells", F.lit(0)).contains(REASON_HEADER) & F.col("next").isNotNull()
    clause = (F.col("row_no") == 1) & F.array_join("cells", "").contains(CLAUSE_HEADER) & F.col("next").isNotNull()
    tables = cells.groupBy("__b").agg(F.max(F.when(clause, F.get("next", F.lit(0)))).alias("t_clause"), F.max(F.when(clause, F.get("next", F.lit(1)))).alias("t_new"), F.min_by(F.when(reasons, longest), F.when(reasons, F.col("row_no"))).alias("t_why"))
    joined = blocks.join(tables, (F.struct(blocks[key], blocks["block_no"]) == F.col("__b")), "left")
    or_said = lambda c, words: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(_said(words, "block", r"[^\n]+"))
    sections = joined.select(
        blocks[key], F.when(F.col("__b").isNull(), "section").otherwise("table").alias("layout"), "item_no", compact(F.regexp_replace("head", r"^\d+[、.]\s*", "")).alias("title"),
        F.coalesce("t_clause", F.lit("")).alias("clause_text"), or_said("t_why", EXPLANATION_WORDS).alias("explanation"), or_said("t_new", SUGGESTION_WORDS).alias("suggestion"), F.substring("block", 1, 120).alias("rest"),
    )
    note = r"【批注#\d+/[^:]+:\s*(.*?)】(?=【批注#|[^【】]*$|[^【】]*【批注#)"
    lines = docs.select(key, F.posexplode(F.split("__text", "\n")).alias("line_no", "line")).where(F.contains("line", F.lit("【批注#")))
    notes = lines.select(key, "line_no", compact(F.regexp_replace("line", note, "")).alias("clause_text"), F.posexplode(F.regexp_extract_all("line", F.lit(note), F.lit(1))).alias("i", "n")).withColumn("n", compact("n"))
    split_up = r"【风险点】(.*?)【说明】(.*?)(?:【修改建议】(.*))?$"
    is_split = F.col("n").rlike(split_up)
    part = lambda i: compact(F.regexp_extract("n", split_up, i))
    comments = notes.select(
        key, F.lit("comment").alias("layout"), F.row_number().over(Window.partitionBy(key).orderBy("line_no", "i")).alias("item_no"), F.when(is_split, part(1)).otherwise(F.substring("n", 1, 28)).alias("title"), "clause_text",
        F.when(is_split, part(2)).otherwise(F.col("n")).alias("explanation"), F.when(is_split, part(3)).otherwise("").alias("suggestion"), F.col("n").alias("rest"),
    )
    every = report.unionByName(sections).unionByName(comments).where(telling(*fields, "rest"))
    rank = F.when(F.col("layout") == "report", 0).when(F.col("layout") == "comment", 2).otherwise(1)
    alike = F.concat_ws("|", *(F.substring(f, 1, n) for f, n in zip(fields, (50, 60, 60, 60), strict=True)))
    every = every.withColumn("__rank", rank).withColumn("__same", F.when(F.col("__rank") < 2, F.concat(F.lit("#"), F.col("item_no"), F.lit("|"), F.col("title"))).otherwise(alike))
    for by in ("__same", "__alike"):
        every = every.withColumn("__alike", alike).withColumn("__n", F.row_number().over(Window.partitionBy(key, by).orderBy("__rank", "item_no"))).where("__n = 1")
    return every.select(key, "layout", "item_no", *fields)
