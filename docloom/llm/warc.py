"""WARC derivatives: response records become linked metadata and plain-text conversion records (WARC 1.1, ISO 28500).

``read`` parses WARC files (plain or gzipped), each as a stream in one task, and gives their records as they stand;
``responses`` makes response records of a table of pages; ``derive`` gives two records for each response: *metadata* (application/warc-fields: title,
language, links, and the response's status, HTTP headers and digests) and *conversion* (text/plain). Both carry
WARC-Refers-To with the identifier, target URI and date of their response, and digests of their own blocks; identifiers
are name-based UUIDs of the response's identifier and the kind, so a repeated run gives the same records.

Each record is handled by itself; nothing is shuffled, and a task holds one batch of records.

Defined cases: a null url has no target URI; a null or empty page gives empty text; a response that isn't HTTP is taken
as its payload; other record types are passed over; broken markup is read as far as it goes; a digest that a
response states is carried as it is, an absent one computed; chunked and gzip or deflate bodies are decoded for their text
(as far as they go), while digests stay those of the bytes as sent; after a broken record, reading goes on at the next
version line; headers that come more than once are all kept.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.files import opened

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "warc.derivatives.invalid")
DATE = "2024-01-01T00:00:00Z"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
#: elements whose ends break a line
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, identifier: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identifier}>"), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in named if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


class Headers(dict):
    """The first value of each header by lower-case name; ``pairs`` has all of them as they come."""

    def __init__(self, lines: list[str]):
        self.pairs = [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines if x.strip())]
        super().__init__((n.lower(), v) for n, v in reversed(self.pairs))


_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")  # not only after a line's end: a record may be cut off
CHUNK = 1 << 20
MOST = 1 << 28  # bytes of a record, and of what its body unpacks to


def stream(read: Callable[[int], bytes], most: int = MOST) -> Iterator[tuple[Headers, bytes, bytes]]:
    """(headers, block, record) of each record that read(n) gives in uncompressed bytes. A record without a length, one that
    isn't followed by a line's end, and one said to be longer than ``most``, is broken; the search goes on behind its first
    line, for the next. Memory is that of a record, ``most`` at most, whatever its header says."""
    data, more = b"\n", True

    def fill(size: int) -> None:
        nonlocal data, more
        parts, have = [data], len(data)
        while more and have < size:
            part = read(CHUNK)
            more = bool(part)
            parts.append(part)
            have += len(part)
        data = b"".join(parts)

    at = 0
    while True:
        found = _VERSION.search(data, at)
        end = data.find(b"\r\n\r\n", found.start()) if found else -1
        if end < 0:
            if not more:
                if not found:
                    return
                at = found.end()
                continue
            data, at = data[found.start() - 1 if found else max(0, len(data) - 32) :], 0
            fill(len(data) + CHUNK)
            continue
        headers = Headers(data[found.end() : end].decode("utf-8", "replace").split("\r\n"))
        length = headers.get("content-length", "")
        if length.isdigit() and len(length) < 20 and int(length) <= most:
            whole = end + 4 + int(length) - found.start()
            if len(data) - found.start() < whole + 2:
                data = data[found.start() - 1 :]
                end, found = end - found.start() + 1, _VERSION.search(data)
                fill(1 + whole + 2)
            stop = found.start() + whole
            if stop <= len(data) and data[stop : stop + 2] in (b"\r\n", b"WA", b""):
                yield headers, data[end + 4 : stop], data[found.start() : stop] + b"\r\n\r\n"
                data, at = b"\n" + data[stop:], 0
                continue
        at = found.end()


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record in uncompressed bytes."""
    for headers, block, _ in stream(io.BytesIO(data).read):
        yield headers, block


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response; a block that isn't one is all payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)], payload


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer, as far as its chunks go; one that isn't chunked as it is."""
    at, out = 0, []
    while found := re.compile(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n").match(body, at):
        size = int(found[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[found.end() : found.end() + size])
        at = found.end() + size + 2
    return b"".join(out) if out else body


def inflated(body: bytes, most: int = MOST) -> bytes:
    """A gzip or zlib stream's content, as far as it goes and up to ``most`` bytes; other bytes as they are."""
    out, have = [], 0
    while body[:2] == b"\x1f\x8b" or (len(body) > 1 and body[0] & 15 == 8 and int.from_bytes(body[:2]) % 31 == 0):
        decoder = zlib.decompressobj(47)
        try:
            for i in range(0, len(body), CHUNK):
                out.append(decoder.decompress(body[i : i + CHUNK], most - have))
                have += len(out[-1])
                if have >= most:
                    return b"".join(out)
                if decoder.eof:
                    body = decoder.unused_data + body[i + CHUNK :]
                    break
            else:
                return b"".join(out)
        except zlib.error:
            return b"".join(out) or body
    return b"".join(out) if out else body


def decoded(fields: dict[str, str], payload: bytes) -> bytes:
    """The payload without its transfer and content encodings. Archives often keep the headers of bodies they have decoded."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        payload = unchunked(payload)
    if re.search("gzip|deflate", fields.get("content-encoding", ""), re.I):
        payload = inflated(payload)
    return payload


def plain_text(page: str) -> str:
    """The text of a page: no markup, comments or scripts; a line for each block element, single spaces."""

    def gap(m: re.Match) -> str:
        return "\n" if (m[3] or "").lower() in _BLOCKS else "" if m[3] else " "

    lines = html.unescape(_TOKEN.sub(gap, page)).split("\n")
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def derived(headers: Headers, block: bytes) -> list[tuple[str, str, bytes, bytes, str]]:
    """(type, identifier, block, record, payload digest of the source) of the two records made of a response."""
    status, fields, payload = http(block)
    kinds = {n.lower(): v for n, v in fields}
    charset, body = re.search(r"charset=[\"']?([\w-]+)", kinds.get("content-type", ""), re.I), decoded(kinds, payload)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source = headers.get("warc-record-id", "").strip("<>")
    paid = headers.get("warc-payload-digest") or digest(payload)
    title, lang = _TITLE.search(page), _LANG.search(page)
    links = dict.fromkeys(html.unescape(next(x for x in m if x)) for m in _HREF.findall(page) if any(m))
    one = lambda s: " ".join(html.unescape(s).split())
    meta = [("title", one(title[1]) if title else ""), ("language", lang[1] if lang else ""), ("source-record-id", source), ("source-status", status), *((f"source-header-{n.lower()}", v) for n, v in fields)]
    meta += [("source-block-digest", headers.get("warc-block-digest") or digest(block)), ("source-payload-digest", paid), ("source-payload-length", str(len(payload))), *(("outlink", one(x)) for x in links)]
    shared = [
        ("WARC-Date", headers.get("warc-date", DATE)), ("WARC-Target-URI", headers.get("warc-target-uri")), ("WARC-Refers-To", f"<{source}>"),
        ("WARC-Refers-To-Target-URI", headers.get("warc-target-uri")), ("WARC-Refers-To-Date", headers.get("warc-date")),
    ]
    out = []
    for kind, content, body in (("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in meta if v).encode()), ("conversion", "text/plain; charset=utf-8", plain_text(page).encode())):
        identifier = uuid.uuid5(NAMESPACE, f"{source}\n{kind}").urn
        out.append((kind, identifier, body, record(kind, identifier, [*shared, ("Content-Type", content)], body), paid))
    return out


def response(key: object, url: str | None, page: str | None) -> bytes:
    """A response record of a page."""
    payload = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload))]
    return record("response", uuid.uuid5(NAMESPACE, f"{key}\n{url}").urn, headers, block)


def responses(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key and warc (a response record's bytes) of each page."""
    kind = pages.schema[key].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([response(*r) for r in rows], pa.binary())], [key, "warc"])

    return pages.select(F.col(key), F.col(url), F.col(page)).mapInArrow(make, f"`{key}` {kind}, warc binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path and warc (one record's bytes, as they stand) of the records in WARC files.

    Files are listed by Spark's binary reader and each is read as a stream by one task (the format's guidelines have them at
    a gigabyte); a gzip stream is read as far as it goes.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(name: str, rows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(rows, pa.binary())], ["path", "warc"])

        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = opened(name)
                with fs.open_input_file(at) as f:
                    zipped = f.read(2) == b"\x1f\x8b"
                    f.seek(0)
                    rows, size = [], 0
                    for _, _, whole in stream(_unzipped(f.read) if zipped else f.read):
                        rows.append(whole)
                        size += len(whole)
                        if size > CHUNK:
                            yield batch(name, rows)
                            rows, size = [], 0
                    yield batch(name, rows)

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.repartition(files.count() or 1, "path").select("path").mapInArrow(split, "path string, warc binary")


def _unzipped(read: Callable[[int], bytes]) -> Callable[[int], bytes]:
    """A reader of all members of a gzip stream; ends at the first byte that can't be read."""
    decoder, rest = zlib.decompressobj(31), b""

    def take(size: int) -> bytes:
        nonlocal decoder, rest
        while True:
            if decoder.eof:
                rest, decoder = decoder.unused_data, zlib.decompressobj(31)
            raw = rest or decoder.unconsumed_tail or read(CHUNK)
            rest = b""
            if not raw:
                return b""
            try:
                out = decoder.decompress(raw, size)
            except zlib.error:
                return b""
            if out:
                return out

    return take


def derive(records: DataFrame, *, key: str = "page_id", warc: str = "warc") -> DataFrame:
    """Two rows for each response among the records: key, warc_type, record_id, refers_to, target_uri, block_digest, payload_digest, block, record."""
    kind = records.schema[key].dataType.simpleString()
    names = ["warc_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", "block", "record"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for headers, block in parse(raw.as_py() or b""):
                    if headers.get("warc-type") == "response":
                        rows += [(k, t, i, headers.get("warc-record-id", "").strip("<>"), headers.get("warc-target-uri"), digest(body), paid, body, whole) for t, i, body, whole, paid in derived(headers, block)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * (1 + len(names))
            types = [b.schema.field(0).type, *[pa.string()] * 6, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, *names])

    fields = ", ".join(f"{n} string" for n in names[:6])
    return records.select(F.col(key), F.col(warc)).mapInArrow(make, f"`{key}` {kind}, {fields}, block binary, record binary")
