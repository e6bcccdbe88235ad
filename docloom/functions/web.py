"""Pages: absolute links, sections, Markdown of pages, tables to HTML, XML to JSON."""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SKIP_PREFIXES, SKIP_SUFFIXES

_HREF = re.compile(r"""href=["']([^"'#]+)""")


def absolute_links(page: str | None, url: str, base: str | None = None, outside: bool = False, exclude: tuple[str, ...] = ()) -> list[str]:
    """Absolute links of a page in order, each once; those outside the base url, excluded, or to assets are left out."""
    base, out = base or url, []
    for raw in _HREF.findall(page or ""):
        if raw.startswith(SKIP_PREFIXES) or raw.split("?")[0].endswith(SKIP_SUFFIXES):
            continue
        link = urldefrag(urljoin(url, html.unescape(raw)))[0]
        kind = urlparse(link)
        inside = link.startswith(base) and kind.netloc == urlparse(base).netloc
        if kind.scheme in ("http", "https") and (outside or inside) and not link.startswith(exclude or ("\0",)):
            out.append(link)
    return list(dict.fromkeys(out))


def absolute_links_column(page: Column | str, url: Column | str, **how) -> Column:
    @F.pandas_udf("array<string>")
    def links(p: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([absolute_links(a, b, **how) if b else [] for a, b in zip(p, u, strict=True)], dtype=object)

    return links(page, url)


class _Markdown(HTMLParser):
    """Text of a page with links and media as Markdown, blocks as lines; denied elements are dropped, kept ones stay as markup."""

    BLOCKS = frozenset("p div section article ul ol li table tr h1 h2 h3 h4 h5 h6 blockquote pre br".split())

    def __init__(self, deny: frozenset[str], keep: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.deny, self.keep, self.skip, self.kept, self.href = deny, keep, 0, 0, []
        self.out: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip or tag in self.deny:
            self.skip += tag not in ("br", "img", "hr", "meta", "link", "input")
        elif tag in self.keep or self.kept:
            self.kept += tag not in ("br", "img", "hr")
            self.out.append(self.get_starttag_text())
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[")
        elif tag in ("img", "video", "audio"):
            self.out.append(f"![{tag}:{a.get('src') or ''}]({a.get('src') or ''})")
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.skip:
            self.skip -= 1
        elif self.kept:
            self.kept -= 1
            self.out.append(f"</{tag}>")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def to_markdown(page: str, deny: tuple[str, ...] = ("script", "style", "noscript"), keep: tuple[str, ...] = ()) -> str:
    p = _Markdown(frozenset(deny), frozenset(keep))
    p.feed(page)
    p.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.out).split("\n")) if x)


def table_html(markdown: str) -> str:
    """Markdown with its tables as HTML tables, other lines as paragraphs."""
    out, rows = [], []

    def flush() -> None:
        if rows:
            head, *body = [r for r in rows if not re.fullmatch(r"\|?[\s:|-]+\|?", r)]
            cells = lambda r, t: "".join(f"<{t}>{html.escape(c.strip())}</{t}>" for c in r.strip().strip("|").split("|"))
            out.append("<table><tr>" + cells(head, "th") + "</tr>" + "".join(f"<tr>{cells(r, 'td')}</tr>" for r in body) + "</table>")
            rows.clear()

    for line in markdown.split("\n"):
        if line.strip().startswith("|"):
            rows.append(line)
            continue
        flush()
        if line.strip():
            out.append(f"<p>{html.escape(line.strip())}</p>")
    flush()
    return "\n".join(out)


def xml_to_json(text: str | None) -> str | None:
    """XML as nested JSON: {tag: text} or {tag: [children]}; documents with a doctype are refused, broken ones give null."""
    if not text or "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None

    def value(node: ET.Element) -> object:
        return {node.tag: [value(x) for x in node] if len(node) else (node.text or "")}

    try:
        return json.dumps(value(ET.fromstring(text.strip())), ensure_ascii=False)
    except ET.ParseError:
        return None


def text_udf(f, returns: str = "string"):
    """A function of one text as a column function; null stays null."""

    @F.pandas_udf(returns)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t) for t in x], dtype=object)

    return run


def headers_by_size(page: str, sizes: dict[str, float] | None = None) -> str:
    """The page with elements that are headers by their style's font size (in px or pt, 4/3 of a px) as h1, h2, ... elements."""
    limits = sorted((sizes or {"h1": 24.0, "h2": 20.0}).items(), key=lambda x: -x[1])

    def change(m: re.Match) -> str:
        size = re.search(r"font-size:\s*([\d.]+)\s*(px|pt)", m[2], re.I)
        value = float(size[1]) * (4 / 3 if size[2].lower() == "pt" else 1) if size else 0.0
        tag = next((t for t, least in limits if value >= least), None)
        return f"<{tag}>{m[3]}</{tag}>" if tag else m[0]

    return re.sub(r"<(span|div|p|font)\b([^>]*)>((?:(?!<\1\b).)*?)</\1\s*>", change, page, flags=re.S | re.I)
