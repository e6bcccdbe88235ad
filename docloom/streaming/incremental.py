"""Parsers of JSON and XML that comes in pieces: what is kept between pieces is the open brackets or tags and an unfinished tail."""

from __future__ import annotations

import json
import re

_PLAIN = re.compile(r'[^"\\]+')
_SPACE = " \t\n\r"
_MISSING = object()


def pointer(parts: list) -> str:
    """A JSON pointer (RFC 6901)."""
    return "".join("/" + str(p).replace("~", "~0").replace("/", "~1") for p in parts)


class JsonPieces:
    """JSON in pieces, as patches (RFC 6902): ``feed`` gives the operations that lead from the value before a piece to the one after it.

    A value that breaks off counts as far as it goes: open brackets are closed, a string or number is what is there of it, a name
    without a value and half an escape are left out. Each character is looked at once; a string or number that goes on is given
    anew in full. After an error, and after the end of the value, nothing more comes. Later members of the same name replace.
    """

    def __init__(self):
        self.frames: list[list] = []  # [is it a list, the name or number of the member at hand]
        self.mode, self.tail, self.last, self.shown = "value", "", None, False

    def dump(self) -> str:
        return json.dumps([self.frames, self.mode, self.tail, self.last, self.shown])

    @classmethod
    def load(cls, text: str) -> JsonPieces:
        new = cls()
        new.frames, new.mode, new.tail, new.last, new.shown = json.loads(text)
        return new

    def feed(self, text: str | None) -> list[dict]:
        self.ops: list[dict] = []
        self.fresh: list = [None] * len(self.frames)  # containers that this piece began
        i, text = 0, text or ""
        while i < len(text) and self.mode not in ("end", "bad"):
            i = self._in_string(text, i) if self.mode in ("string", "name") else self._outside(text, i)
        if self.mode in ("string", "scalar"):
            value = self._sofar()
            if value is not _MISSING:
                self._show(value)
        return self.ops

    def _sofar(self) -> object:
        for cut in range(min(7, len(self.tail) + 1)):
            part = self.tail[: len(self.tail) - cut]
            try:
                return json.loads(f'"{part}"' if self.mode == "string" else part, strict=False)
            except ValueError:
                continue
        return _MISSING

    def _show(self, value: object) -> None:
        """The value of the member at hand, a first time or anew."""
        if self.shown:
            if type(value) is not type(self.last) or value != self.last:
                self.ops.append({"op": "replace", "path": pointer([f[1] for f in self.frames]), "value": value})
        elif not self.frames:
            self.ops.append({"op": "replace", "path": "", "value": value})
        elif self.fresh[-1] is not None:
            holder, (is_list, name) = self.fresh[-1], self.frames[-1]
            holder.append(value) if is_list else holder.__setitem__(name, value)
        else:
            names = [f[1] for f in self.frames]
            self.ops.append({"op": "add", "path": pointer([*names[:-1], "-" if self.frames[-1][0] else names[-1]]), "value": value})
        self.shown, self.last = True, value

    def _closed(self) -> None:
        """The member at hand is whole."""
        self.tail, self.last, self.shown = "", None, False
        self.mode = "next" if self.frames else "end"

    def _whole(self, text: str) -> None:
        try:
            value = json.loads(text, strict=False)
        except ValueError:
            self.mode = "bad"
            return
        self._show(value)
        self._closed()

    def _in_string(self, text: str, i: int) -> int:
        if self.tail.endswith("\\") and (len(self.tail) - len(self.tail.rstrip("\\"))) % 2:
            self.tail += text[i]
            return i + 1
        m = _PLAIN.match(text, i)
        if m:
            self.tail += m.group()
            return m.end()
        if text[i] == "\\":
            self.tail += "\\"
            return i + 1
        if self.mode == "string":
            self._whole(f'"{self.tail}"')
        else:
            try:
                self.frames[-1][1] = json.loads(f'"{self.tail}"', strict=False)
            except ValueError:
                self.mode = "bad"
                return i
            self.tail, self.mode = "", "colon"
        return i + 1

    def _outside(self, text: str, i: int) -> int:
        c = text[i]
        if self.mode == "scalar":
            if c not in _SPACE + ",]}[{\":":
                self.tail += c
                return i + 1
            self._whole(self.tail)
            return i
        if c in _SPACE:
            return i + 1
        is_list = bool(self.frames) and self.frames[-1][0]
        if self.mode == "colon":
            self.mode = "value" if c == ":" else "bad"
        elif self.mode in ("first name", "another name") and c == '"':
            self.mode = "name"
        elif c in "]}" and self.frames and is_list == (c == "]") and self.mode in ("next", "first name", "first"):
            self.frames.pop()
            self.fresh.pop()
            self._closed()
        elif self.mode == "next" and c == ",":
            if is_list:
                self.frames[-1][1] += 1
            self.mode = "value" if is_list else "another name"
        elif self.mode in ("value", "first"):
            if c in "[{":
                new: list | dict = [] if c == "[" else {}
                self._show(new)
                self.frames.append([c == "[", 0 if c == "[" else None])
                self.fresh.append(new)
                self.tail, self.last, self.shown = "", None, False
                self.mode = "first" if c == "[" else "first name"
            elif c == '"':
                self.mode = "string"
            elif c in ",]}:":
                self.mode = "bad"
            else:
                self.mode, self.tail = "scalar", c
        else:
            self.mode = "bad"
        return i + 1


_TAG = re.compile(r"""<(/?)([^\W\d][\w:.-]*)((?:\s+[^\s=<>/"']+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*)\s*(/?)>""")
_OPEN = re.compile(r"""<(?:[^<>"']|"[^"<]*"|'[^'<]*')*(?:"[^"<]*|'[^'<]*)?$""")
_ENTITY = re.compile(r"&(?:#(\d{1,7})|#x([0-9a-fA-F]{1,6})|(lt|gt|amp|quot|apos));")
_HALF = re.compile(r"&[#\w]{0,8}$")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


class XmlPieces:
    """XML in pieces: ``feed`` gives (path, text) of the leaf elements that a piece closes. Reading ends at the first error;
    documents with a doctype, comments or CDATA have none."""

    def __init__(self):
        self.above: list[list] = []  # [tag, has it children]
        self.text = self.tail = ""
        self.ended = False

    def dump(self) -> str:
        return json.dumps([self.above, self.text, self.tail, self.ended])

    @classmethod
    def load(cls, text: str) -> XmlPieces:
        new = cls()
        new.above, new.text, new.tail, new.ended = json.loads(text)
        return new

    def feed(self, piece: str | None) -> list[tuple[str, str]]:
        data, at, out = self.tail + (piece or ""), 0, []
        self.tail = ""
        while at < len(data) and not self.ended:
            if data[at] != "<":
                end = data.find("<", at)
                part = data[at : end if end >= 0 else len(data)]
                keep = len(part)
                if end < 0:
                    half = _HALF.search(part)
                    keep = half.start() if half else keep - part.endswith("\r")
                self._read(part[:keep].replace("\r\n", "\n").replace("\r", "\n"))
                at += keep
                if keep < len(part):
                    self.tail = data[at:]
                    break
                continue
            if data.startswith("<?", at):
                end = data.find("?>", at)
                if end < 0:
                    self.tail = data[at:]
                    break
                at = end + 2
                continue
            m = _TAG.match(data, at)
            if not m:
                if _OPEN.match(data, at) and not data.startswith("<!", at):
                    self.tail = data[at:]
                else:
                    self.ended = True
                break
            at = m.end()
            closing, tag, _, alone = m.groups()
            if closing:
                if not self.above or self.above[-1][0] != tag or alone:
                    self.ended = True
                    break
                self._close(out)
            else:
                if self.above:
                    self.above[-1][1] = True
                self.above.append([tag, False])
                self.text = ""
                if alone:
                    self._close(out)
        return out

    def _close(self, out: list[tuple[str, str]]) -> None:
        if not self.above[-1][1]:
            out.append(("/".join(t for t, _ in self.above), self.text))
        self.above.pop()
        self.text = ""
        self.ended = not self.above

    def _read(self, part: str) -> None:
        plain = _ENTITY.sub("", part)
        if "&" in plain or (not self.above and part.strip(" \t\n")):
            self.ended = True
        elif self.above and not self.above[-1][1]:
            self.text += _ENTITY.sub(lambda m: chr(int(m[1])) if m[1] else chr(int(m[2], 16)) if m[2] else _NAMED[m[3]], part)
