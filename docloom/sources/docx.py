"""Word files: paragraphs, comments with their anchors, and styles, from the package's XML."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _part(data: bytes, name: str) -> ET.Element | None:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if name not in z.namelist():
                return None
            raw = z.read(name)
            return None if b"<!DOCTYPE" in raw[:1000] else ET.fromstring(raw)
    except (zipfile.BadZipFile, ET.ParseError):
        return None


def _text(node: ET.Element) -> str:
    return "".join("\t" if x.tag == W + "tab" else x.text or "" for x in node.iter() if x.tag in (W + "t", W + "tab"))


def paragraphs(data: bytes) -> list[dict]:
    """Visible paragraphs in order with their style; empty ones are left out."""
    root = _part(data, "word/document.xml")
    out = []
    for p in root.iter(W + "p") if root is not None else ():
        style = p.find(f"{W}pPr/{W}pStyle")
        bold = any(True for _ in p.iter(W + "b"))
        if text := _text(p).strip():
            out.append({"text": text, "style": style.get(W + "val") if style is not None else None, "bold": bold})
    return out


def comments(data: bytes) -> list[dict]:
    """Comments with author, text and the text they are anchored to."""
    notes, root = _part(data, "word/comments.xml"), _part(data, "word/document.xml")
    if notes is None or root is None:
        return []
    anchors: dict[str, str] = {}
    open_: set[str] = set()
    for x in root.iter():
        if x.tag == W + "commentRangeStart":
            open_.add(x.get(W + "id"))
        elif x.tag == W + "commentRangeEnd":
            open_.discard(x.get(W + "id"))
        elif x.tag == W + "t":
            for i in open_:
                anchors[i] = anchors.get(i, "") + (x.text or "")
    return [{"id": c.get(W + "id"), "author": c.get(W + "author"), "text": _text(c), "anchor": anchors.get(c.get(W + "id"), "")} for c in notes.iter(W + "comment")]


def extracted(content: Column | str) -> Column:
    """struct<paragraphs, comments> of a Word file's bytes; a file that isn't one gives empty lists."""

    @F.pandas_udf("paragraphs array<struct<text:string,style:string,bold:boolean>>, comments array<struct<id:string,author:string,text:string,anchor:string>>")
    def read(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"paragraphs": [paragraphs(b or b"") for b in x], "comments": [comments(b or b"") for b in x]})

    return read(content)


def documents(blobs: DataFrame) -> DataFrame:
    """path and text (paragraphs joined by line breaks) of Word files among blobs."""
    return blobs.where(F.lower("path").endswith(".docx")).select("path", F.array_join(F.transform(extracted("content")["paragraphs"], lambda p: p["text"]), "\n").alias("text"))
