"""Splitters of Markdown that keep white space, and of HTML by sections and by meaning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from docloom.functions.web import to_markdown

HEADERS = {"#" * n: f"Header {n}" for n in range(1, 7)}
Sections = list[tuple[str, dict[str, str]]]
#: one alternative for each kind of line that ends what is before it; an open fence runs to the end and is dropped
_UNITS = re.compile(r"^(?P<code>(?:```|~~~)(?P<language>[^\n]*)(?:\n.*?^(?:```|~~~)[^\n]*|[\s\S]*\Z)(?:\n|\Z))|^(?P<rule>(?:\*{3,}|-{3,}|_{3,})\n)|^(?P<marks>#{1,6}) (?P<title>[^\n]*)(?:\n|\Z)", re.M | re.S)
_CLOSED = re.compile(r"\A(?:```|~~~)[^\n]*\n(?:.*\n)?(?:```|~~~)[^\n]*\n?\Z", re.S)


def exact_markdown(text: str, headers: dict[str, str] | None = None, keep_headers: bool = False) -> Sections:
    """(content, metadata) with white space as it stands: parts end at headers, rules and fences; a closed fence is a part of its own
    with its language as "Code"; metadata has the headers above. A fence that isn't closed is left out, as are blank parts."""
    names = HEADERS if headers is None else headers
    above: dict[int, str] = {}
    out: Sections = []
    pending = ""

    def close(content: str, **more: str) -> None:
        if content.strip():
            out.append((content, {names["#" * d]: t for d, t in sorted(above.items())} | more))

    at = 0
    for m in _UNITS.finditer(text):
        if m["marks"] and m["marks"] not in names:
            continue
        close(pending + text[at : m.start()])
        pending, at = "", m.end()
        if m["code"]:
            if _CLOSED.match(m["code"]):
                close(m["code"], Code=m["language"])
        elif m["marks"]:
            depth = len(m["marks"])
            above = {d: t for d, t in above.items() if d < depth} | {depth: m["title"]}
            pending = m[0] if keep_headers else ""
    close(pending + text[at:])
    return out


class _Sections(HTMLParser):
    """Texts by the last of some headers; what is before the first one has the title #TITLE#."""

    def __init__(self, tags: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.tags, self.off, self.inside = tags, 0, None
        self.found: list[dict] = [{"header": [], "tag": None, "texts": []}]

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")
        if tag in self.tags:
            self.inside = tag
            self.found.append({"header": [], "tag": tag, "texts": []})

    def handle_endtag(self, tag):
        self.off = max(0, self.off - (tag in ("script", "style")))
        self.inside = None if tag == self.inside else self.inside

    def handle_data(self, data):
        if not self.off:
            self.found[-1]["texts"].append(data)
            if self.inside:
                self.found[-1]["header"].append(data)


def html_by_sections(page: str, headers: dict[str, str]) -> Sections:
    """(text, {name of the header's tag: its text}) of a page's sections; the part before the first header is "#TITLE#" of h1."""
    p = _Sections(frozenset(headers))
    p.feed(page)
    p.close()
    out: Sections = []
    for s in p.found:
        content = " ".join(" ".join(s["texts"]).split())
        tag, header = (s["tag"], " ".join("".join(s["header"]).split())) if s["tag"] else ("h1", "#TITLE#")
        if content:
            out.append((content, {headers.get(tag, tag): header}))
    return out


def cut_sections(sections: Sections, cut: Callable[[str], list[str]]) -> Sections:
    """Each section's text cut by a splitter; the parts keep the section's metadata."""
    return [(part, meta) for text, meta in sections for part in cut(text)]


def _between(page: str, headers: dict[str, str]) -> Iterator[tuple[str, dict[str, str]]]:
    """(markup, headers above it) of the stretches between headers."""
    names = sorted(headers)
    pattern = re.compile(rf"<({'|'.join(names)})\b[^>]*>(.*?)</\1\s*>", re.S | re.I)
    above: dict[str, str] = {}
    at = 0
    for m in pattern.finditer(page):
        yield page[at : m.start()], dict(above)
        tag = m[1].lower()
        above = {t: v for t, v in above.items() if t < tag} | {tag: to_markdown(m[2])}
        at = m.end()
    yield page[at:], dict(above)


def html_by_meaning(page: str, headers: dict[str, str], size: int, cut: Callable[[str], list[str]], *, keep: tuple[str, ...] = (), deny: tuple[str, ...] = ("script", "style", "noscript"), stop_words: frozenset[str] = frozenset(), lower: bool = False) -> Sections:
    """(text, headers by name): links and media as Markdown, kept elements whole and as markup, other text cut to a size.

    A kept element stands in the text as a placeholder while it is cut, so none is cut in two; a part may be longer than the
    size by what it keeps. Stop words and case are changed outside kept elements only.
    """
    out: Sections = []
    for markup, above in _between(page, headers):
        kept: list[str] = []

        def hold(m: re.Match) -> str:
            kept.append(m[0])  # noqa: B023
            return f"\ue000{len(kept) - 1}\ue001"  # noqa: B023

        if keep:
            markup = re.sub(rf"<({'|'.join(map(re.escape, keep))})\b[^>]*>.*?</\1\s*>", hold, markup, flags=re.S | re.I)
        text = to_markdown(markup, deny=deny)
        text = text.lower() if lower else text
        if stop_words:
            text = re.sub(r"[^\W\d_]+", lambda m: "" if m[0].lower() in stop_words else m[0], text)
            text = "\n".join(" ".join(line.split()) for line in text.split("\n"))
        parts = [text] if len(text) <= size else cut(text)
        back = lambda p: re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m[1])], p)  # noqa: B023, E731
        meta = {headers[t]: v for t, v in above.items()}
        out += [(back(p), meta) for p in parts if p.strip()]
    return out
