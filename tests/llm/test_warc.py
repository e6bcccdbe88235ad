import gzip
import hashlib
import io
import re
import zlib
from base64 import b32encode
from html.parser import HTMLParser

import pytest

from docloom.llm import queries as Q
from docloom.llm import warc as W


def test_derivatives_link_back(spark, tmp_path):
    page = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; b</title><style>p{x}</style><script>var t="</p>";</script></head><body><!-- no --><p>One  two</p><div>three<br>four <a href="/x?a=1&amp;b">l</a></div></body></html>'
    pages = [(1, "http://e.example/p", page), (2, None, None), (3, "http://e.example/q", "<p>broken <b"), (1, "http://e.example/p", page), (None, "", "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, warc string")
    sources = W.responses(df)
    rows = W.derive(sources).collect()
    assert len(rows) == 2 * len(pages)
    by_id = {h["warc-record-id"].strip("<>"): (h, b) for r in sources.collect() for h, b in W.parse(bytes(r["warc"]))}
    for r in rows:
        ((headers, block),) = list(W.parse(bytes(r["record"])))
        source, _ = by_id[r["refers_to"]]
        assert headers["warc-refers-to"] == source["warc-record-id"] and headers["warc-type"] == r["warc_type"]
        assert headers.get("warc-refers-to-target-uri") == source.get("warc-target-uri") and headers["warc-refers-to-date"] == source["warc-date"]
        assert headers["warc-block-digest"] == W.digest(block) == r["block_digest"] and bytes(r["block"]) == block
        assert r["payload_digest"] == source["warc-payload-digest"]
        if r["warc_type"] == "metadata":
            assert f"source-payload-digest: {source['warc-payload-digest']}" in block.decode() and "source-header-content-type: text/html" in block.decode()
    one = {r["warc_type"]: bytes(r["block"]).decode() for r in rows if r["page_id"] == 1}
    assert one["conversion"] == "A & b\nOne two\nthree\nfour l"
    assert "title: A & b\r\n" in one["metadata"] and "outlink: /x?a=1&b\r\n" in one["metadata"] and "language: fr" in one["metadata"]
    assert {bytes(r["block"]) for r in rows if r["page_id"] == 3 and r["warc_type"] == "conversion"} == {b"broken <b"}
    assert W.derive(sources.limit(0)).collect() == []

    raw = b"".join(bytes(r["warc"]) for r in sources.collect())
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r["warc"])) for r in sources.collect()))
    again = W.derive(W.read(spark, str(tmp_path)), key="path").collect()
    assert sorted(bytes(r["block"]) for r in again) == sorted(2 * [bytes(r["block"]) for r in rows])


def test_odd_records():
    assert list(W.parse(b"")) == [] and list(W.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")) == []
    assert W.http(b"no http") == ("", [], b"no http")
    assert W.plain_text("<" * 20_000 + "a" * 20_000) and W.plain_text("<script>" * 3000) == ""


def sent(i, body, *fields, digest=None):
    head = "".join(f"{n}: {v}\r\n" for n, v in fields)
    return W.record("response", f"urn:uuid:{i}", [("WARC-Target-URI", f"http://e.example/{i}"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>"), ("WARC-Payload-Digest", digest)], b"HTTP/1.1 200 OK\r\n" + head.encode() + b"\r\n" + body)


def test_reading_goes_on_after_broken_records(spark, tmp_path):
    good = [sent(i, f"<p>text {i} WARC/1.0 in it</p>".encode() * (1 + 40_000 * (i == 2))) for i in range(4)]
    broken = [good[1].replace(b"Content-Length: ", b"Content-Length: 9"), b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", good[1][:-30], b"junk \x00\r\n\r\n", b"WARC/1.1\r\n"]
    data = broken[0] + good[0] + broken[1] + good[1] + broken[2] + good[2] + broken[3] + good[3] + broken[4]
    for size in (1, 7, 1 << 20):
        source = io.BytesIO(data)
        found = [(h["warc-record-id"], len(h.pairs), b, whole) for h, b, whole in W.stream(lambda n, s=size, f=source: f.read(s))] if size > 1 else None
        if found is not None:
            assert [x[0] for x in found] == [f"<urn:uuid:{i}>" for i in range(4)] and [x[3] for x in found] == good and found[0][1] == 7
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, [*broken[:3], *good])) + b"no member")
    got = sorted((r["path"].rsplit("/", 1)[1], bytes(r["warc"])) for r in W.read(spark, str(tmp_path)).collect())
    assert got == sorted([("a.warc", g) for g in good] + [("b.warc.gz", g) for g in good])


def test_encoded_bodies_and_stated_digests(spark):
    page = "<p>häuser &amp; more</p>"
    chunked = b"".join(b"%x;q=1\r\n%b\r\n" % (len(c), c) for c in (page.encode()[:5], page.encode()[5:])) + b"0\r\n\r\n"
    bodies = [
        (page.encode("latin-1"), [("Content-Type", "text/html; Charset=ISO-8859-1")]),
        (gzip.compress(page.encode()), [("Content-Encoding", "gzip")]),
        (zlib.compress(page.encode()), [("Content-Encoding", "deflate")]),
        (chunked, [("Transfer-Encoding", "chunked")]),
        (b"%x\r\n%b\r\n0\r\n\r\n" % (len(gzip.compress(page.encode())), gzip.compress(page.encode())), [("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")]),
        (page.encode(), [("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")]),
        (gzip.compress(page.encode() * 9000)[:-9], [("Content-Encoding", "gzip")]),
    ]
    df = spark.createDataFrame([(i, sent(i, b, *f, digest="sha1:STATED")) for i, (b, f) in enumerate(bodies)], "page_id long, warc binary")
    rows = W.derive(df).collect()
    text = {r["page_id"]: bytes(r["block"]).decode() for r in rows if r["warc_type"] == "conversion"}
    assert all(text[i] == "häuser & more" for i in range(6)) and text[6].startswith("häuser & more\nhäuser")
    assert {r["payload_digest"] for r in rows} == {"sha1:STATED"}
    stated = sent(1, b"x").replace(b"WARC-Block-Digest: ", b"WARC-Block-Digest: md5:X-")
    ((headers, block),) = list(W.parse(stated))
    assert f"source-block-digest: {headers['warc-block-digest']}".encode() in W.derived(headers, block)[0][2] and headers["warc-block-digest"].startswith("md5:X-")


class Plain(HTMLParser):
    """Text and links of a page by the standard library's parser."""

    BREAKS = W._BLOCKS

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.off = [], {}, 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in self.BREAKS else "")
        if dict(attrs).get("href") and not self.off:
            self.links[" ".join(dict(attrs)["href"].split())] = 1

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if tag in self.BREAKS else "")

    def handle_data(self, data):
        self.out.append(" " if self.off else data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, sf):
    """Every page of the table: text by the standard library's parser, digests and identifiers by their definition."""
    folder = f"/root/testdata/{sf}"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    made = {(r["page_id"], r["warc_type"]): r for r in W.derive(W.responses(spark.read.parquet(f"{folder}/pages.parquet"))).collect()}
    got = {(r["page_id"], r["warc_type"]): r for r in Q.op1_derivatives(spark, folder).collect()}
    assert set(got) == {(k, t) for k in pages for t in ("metadata", "conversion")} == set(made)
    sha = lambda b: "sha1:" + b32encode(hashlib.sha1(b).digest()).decode()
    for k, page in pages.items():
        body = (page["html"] or "").encode()
        parser = Plain()
        parser.feed(page["html"] or "")
        parser.close()
        want = "\n".join(x for x in (" ".join(line.split()) for line in "".join(parser.out).split("\n")) if x)
        assert bytes(made[k, "conversion"]["block"]).decode() == want, k
        meta = bytes(made[k, "metadata"]["block"]).decode()
        assert re.findall("^outlink: (.*)\r$", meta, re.M) == list(parser.links), k
        for kind in ("metadata", "conversion"):
            block, row = bytes(made[k, kind]["block"]), got[k, kind]
            assert row["payload_digest"] == sha(body) and row["block_digest"] == sha(block) and row["content_length"] == len(block) and row["target_uri"] == page["url"]
            assert row["record_crc32"] == zlib.crc32(bytes(made[k, kind]["record"])) and f"<{row['refers_to']}>".encode() in bytes(made[k, kind]["record"])


def test_a_false_length_reads_no_further():
    """A header that claims more than a record may have is broken, and nothing is read for it."""
    good = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    data = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9999999999\r\n\r\nhalf a block\r\n\r\n" + good + b"x" * 60_000_000
    asked, at = [], 0

    def read(n):
        nonlocal at
        at += n
        asked.append(at)
        return data[at - n : at]

    found = W.stream(read)
    assert next(found)[1] == b"body" and asked[-1] <= 4 * W.CHUNK
    long = b"WARC/1.0\r\nContent-Length: 50\r\n\r\n" + b"y" * 50 + b"\r\n\r\n"
    assert [b for _, b, _ in W.stream(io.BytesIO(long + good).read, most=20)] == [b"body"]


def test_bodies_that_unpack_without_end_are_cut():
    bomb = gzip.compress(gzip.compress(b"\0" * 5_000_000))
    assert len(W.inflated(gzip.compress(b"\0" * 5_000_000), most=1000)) == 1000 and len(W.inflated(bomb, most=1000)) <= 1000
    assert W.inflated(gzip.compress(b"abc") + gzip.compress(b"def")) == b"abcdef"
