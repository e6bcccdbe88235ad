"""Spreadsheets and comments written: Markdown tables as XLSX, comments put into Word files. One file is one row's bytes."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_STAMP = (1980, 1, 1, 0, 0, 0)  # so that the same input gives the same bytes


def markdown_tables(text: str) -> list[tuple[str, list[list[str]]]]:
    """(title, rows) of the tables in Markdown; the title is the header above, or empty."""
    out, title, rows = [], "", []
    for line in [*text.split("\n"), ""]:
        stripped = line.strip()
        if stripped.startswith("|"):
            if not re.fullmatch(r"\|?[\s:|-]+\|?", stripped):
                rows.append([c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", stripped.strip("|"))])
            continue
        if rows:
            out.append((title, rows))
            rows = []
        if m := re.match(r"#+\s+(.*)", stripped):
            title = m[1]
    return out


def _name(n: int) -> str:
    letters = ""
    while n >= 0:
        letters, n = chr(65 + n % 26) + letters, n // 26 - 1
    return letters


def workbook(tables: list[tuple[str, list[list[str]]]]) -> bytes:
    """An XLSX file with a sheet of text cells for each table. Sheet names are cut to 31 letters and told apart by numbers."""
    names: list[str] = []
    for i, (title, _) in enumerate(tables or [("Sheet", [])], 1):
        base = re.sub(r"[\[\]:*?/\\']", " ", title).strip()[:28] or f"Sheet{i}"
        names.append(base if base.lower() not in map(str.lower, names) else f"{base[:25]} {i}")
    sheets = [rows for _, rows in tables] or [[]]

    def sheet(rows: list[list[str]]) -> str:
        cell = lambda r, c, v: f'<c r="{_name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
        return f'<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'

    n = range(1, len(sheets) + 1)
    part = lambda i: f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
    files = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(map(part, n))}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{"".join(f"""<sheet name="{escape(x, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>""" for i, x in zip(n, names, strict=True))}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(f"""<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>""" for i in n)}</Relationships>',
        **{f"xl/worksheets/sheet{i}.xml": sheet(rows) for i, rows in zip(n, sheets, strict=True)},
    }
    return _zipped({k: ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + v).encode() for k, v in files.items()})


def _zipped(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, _STAMP), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read_workbook(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """The sheets of a workbook that ``workbook`` wrote."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")]
        rows = lambda i: [[t.text or "" for t in r.iter(f"{{{_MAIN}}}t")] for r in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{{{_MAIN}}}row")]
        return [(n, rows(i)) for i, n in enumerate(names, 1)]


def to_xlsx(markdown: Column | str) -> Column:
    """Markdown texts' tables as XLSX bytes."""

    @F.pandas_udf("binary")
    def make(x: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else workbook(markdown_tables(t)) for t in x], dtype=object)

    return make(markdown)


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def commented(data: bytes, notes: list[tuple[str, str]], author: str) -> tuple[bytes, int]:
    """A Word file with comments (quoted text, note) at the first paragraph that has the quoted text; notes whose text isn't found are left out. Gives their number, too."""
    ET.register_namespace("w", _W)
    w = lambda tag: f"{{{_W}}}{tag}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = {n: z.read(n) for n in z.namelist()}
    body = ET.fromstring(files["word/document.xml"])
    old = ET.fromstring(files["word/comments.xml"]) if "word/comments.xml" in files else ET.Element(w("comments"))
    number = max([int(c.get(w("id"), -1)) for c in old.iter(w("comment"))], default=-1)
    squeeze = lambda t: "".join((t or "").split())
    paragraphs = [(p, squeeze("".join(t.text or "" for t in p.iter(w("t"))))) for p in body.iter(w("p"))]
    done = 0
    for quoted, note in notes:
        p = next((p for p, text in paragraphs if squeeze(quoted) and squeeze(quoted) in text), None)
        if p is None:
            continue
        number, done = number + 1, done + 1
        mark = {w("id"): str(number)}
        lead = 1 if len(p) and p[0].tag == w("pPr") else 0
        p.insert(lead, ET.Element(w("commentRangeStart"), mark))
        p.append(ET.Element(w("commentRangeEnd"), mark))
        ET.SubElement(ET.SubElement(p, w("r")), w("commentReference"), mark)
        comment = ET.SubElement(old, w("comment"), mark | {w("author"): author})
        ET.SubElement(ET.SubElement(ET.SubElement(comment, w("p")), w("r")), w("t")).text = note
    files["word/document.xml"], files["word/comments.xml"] = (ET.tostring(x, "utf-8", xml_declaration=True) for x in (body, old))
    kinds = files.get("[Content_Types].xml")
    if kinds and b"/word/comments.xml" not in kinds:
        files["[Content_Types].xml"] = kinds.replace(b"</Types>", b'<Override PartName="/word/comments.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"/></Types>')
    rels = files.get("word/_rels/document.xml.rels")
    if rels and b"comments.xml" not in rels:
        files["word/_rels/document.xml.rels"] = rels.replace(b"</Relationships>", f'<Relationship Id="rIdComments" Type="{_REL}/comments" Target="comments.xml"/></Relationships>'.encode())
    return _zipped(files), done


def with_comments(content: Column | str, notes: Column | str, author: str = "review") -> Column:
    """struct of content and n: Word files with notes (array of struct<quoted, note>) put in as comments; files that can't be read give null."""

    @F.pandas_udf("content binary, n int")
    def write(c: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for data, found in zip(c, n, strict=True):
            try:
                rows.append(commented(data, [(x["quoted"], x["note"]) for x in found], author))
            except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError):
                rows.append((None, 0))
        return pd.DataFrame(rows, columns=["content", "n"])

    return write(content, notes)
