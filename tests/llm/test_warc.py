import base64
import gzip
import hashlib
import random
import time
import uuid
from html.parser import HTMLParser

import pytest

from verbatlas.llm import warc

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><script>var t="</p>";</script></head><body>
<nav><a href="/x">menu</a></nav><!-- no --><p>One &lt;two&gt;<br>three</p><div>four <b>five</b> <a href="/y">six</a> <a href="/x">again</a></div><footer>end</footer></body></html>"""


def test_page():
    assert warc.read_page(PAGE) == ("A & B", "One <two>\nthree\nfour five six again", ["/x", "/y"])
    assert warc.read_page("") == ("", "", [])
    assert warc.read_page("plain <b>text")[1] == "plain text"


@pytest.mark.parametrize(
    ("page", "title", "text"),
    [
        ("<head><title>t</title><p>text", "t", "text"),
        ("<head><title>t</title>\n text <b>x</b>", "t", "text x"),
        ("<head><title>t<body><p>text", "t", "text"),
        ("<head><meta charset=x><script>no</script><noscript><p>no</noscript><h1>a</h1>b", "", "a\nb"),
        ("<head><noscript><img><body>a", "", "a"),
        ("<p>a</p><nav>menu<p>b</p>", "", "a\nmenu\nb"),
        ("<p>a</p><footer>c<p>b</p><footer>no</footer>", "", "a\nc\nb"),
        ("a<noscript>b<template>c<p>d", "", "abc\nd"),
        ("a<nav><noscript>no</nav>b<style>no</style>c", "", "a\nbc"),
        ("a<script>no<p>no", "", "a"),
    ],
)
def test_pages_with_tags_left_out(page, title, text):
    assert warc.read_page(page)[:2] == (title, text)


def test_records_round_trip():
    blocks = [b"", b"abc\r\n\r\ndef", "é".encode() * 1000]
    data = b"".join(warc.to_bytes([("WARC-Type", "resource"), ("X", "a\r\nb"), ("Empty", "")], b) for b in blocks)
    back = list(warc.parse_records(data))
    assert [b for _, b in back] == blocks
    assert all(f == {"warc-type": "resource", "x": "a b", "content-length": str(len(b))} for f, b in back)
    for bad in (b"junk", data[:-8], b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


def test_http():
    assert warc.split_http(b"HTTP/1.1 404 No\r\nContent-Type: text/plain\r\n\r\nx") == (404, {"content-type": "text/plain"}, b"x")
    assert warc.split_http(b"no head") == (0, {}, b"no head")


def test_links_and_digests(spark):
    rows = [(1, "http://a/", PAGE, "z"), (1, "http://a/", PAGE, "z"), (2, None, None, "z"), (3, "http://b/", "", "z"), (None, "http://c/", "<p>x" * 50_000, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, title string")
    responses = warc.pages_to_responses(pages)
    ids = [r.record_id for r in responses.collect()]
    assert len(ids) == 5 and len(set(ids)) == 4
    out = warc.derive(responses).collect()
    assert len(out) == 10
    for r in out:
        (fields, block), = warc.parse_records(bytes(r.warc))
        assert fields["warc-refers-to"] == r.refers_to and r.refers_to in ids
        assert fields["warc-type"] == r.kind and fields["warc-record-id"] == r.record_id
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert fields["warc-block-digest"] == r.block_digest == sha(block)
        source = next(h for i, _, h, _ in rows if i == r.page_id) or ""
        assert fields["warc-source-payload-digest"] == r.source_digest == sha(source.encode())
        if r.kind == "conversion":
            assert block.decode() == warc.read_page(source)[1]
        else:
            assert f"source-payload-digest: {r.source_digest}".encode() in block
    assert warc.derive(warc.pages_to_responses(pages.limit(0))).count() == 0


def test_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n\xe9"
    data = warc.to_bytes([("WARC-Type", "warcinfo")], b"") + warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://q/"), ("WARC-Date", "2020-02-02T00:00:00Z")], block)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    out = warc.derive(warc.read_responses(spark.read.format("binaryFile").load(str(tmp_path)))).collect()
    assert len(out) == 4
    for r in out:
        assert (r.refers_to, r.date, r.source_status, r.source_type) == ("<urn:x>", "2020-02-02T00:00:00Z", 200, "text/plain; charset=latin-1")
        if r.kind == "conversion":
            assert list(warc.parse_records(bytes(r.warc)))[0][1] == "é".encode()


def test_query_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.page_id, r.kind): r for r in warc.op6_warc(spark, sf).collect()}
    for p in spark.read.parquet(f"{sf}/pages.parquet").collect():
        title, text, links = warc.read_page(p.html)
        r = got[p.page_id, "conversion"]
        assert (r.n_chars, r.title, r.n_links, r.target_uri) == (len(text), title, len(links), p.url)
        assert got[p.page_id, "metadata"].refers_to == r.refers_to


@pytest.mark.parametrize(("page", "text"), [("a<![foo[x]]>b", "ab"), ("a<![ x", "a"), ("a<![CDATA[x]]>b", "ab"), ("a<![if IE]>b<![endif]>c", "abc"), ("a<!>b", "ab"), ("a<![", "a")])
def test_marked_sections_are_comments(page, text):
    assert warc.read_page(page)[1] == text


def test_any_markup_is_read():
    rng = random.Random(6)
    bits = ["<", ">", "!", "[", "]", "--", "a", " ", "/", "?", "&", ";", "#", "x", '"', "'", "=", "CDATA", "script", "nav", "title", "</", "<!", "<![", "]]>", "DOCTYPE", "\x00", "é", "\n"]
    for _ in range(4_000):
        title, text, links = warc.read_page("".join(rng.choice(bits) for _ in range(rng.randint(1, 25))))
        assert isinstance(text, str) and isinstance(title, str) and isinstance(links, list)


def _response(k: int) -> bytes:
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{k}>"), ("WARC-Payload-Digest", "sha1:SOURCE"), ("WARC-IP-Address", "1.2.3.4")]
    return warc.to_bytes(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nServer: s\r\n\r\n" + f"text {k}\r\n\r\nWARC/0 ".encode() * 3)


def test_damage_is_skipped(spark, tmp_path):
    good = [_response(k) for k in range(5)]
    bad_length = good[1].replace(b"Content-Length: ", b"Content-Length: 9")
    no_length = good[1].replace(b"Content-Length: ", b"Content-Length: x")
    files = {
        "a.warc": (good[0] + bad_length + good[2], {0, 2}),
        "b.warc": (b"junk\xff\xfe" + good[0] + no_length + good[3], {0, 3}),
        "c.warc": (good[0] + good[4][:-30], {0}),
        "d.warc.gz": (b"".join(map(gzip.compress, good)), {0, 1, 2, 3, 4}),
        "e.warc.gz": (gzip.compress(good[0]) + gzip.compress(good[1])[:-20] + b"\x00" * 20 + gzip.compress(good[2]), {0, 2}),
        "f.warc.gz": (gzip.compress(b"".join(good)), {0, 1, 2, 3, 4}),
        "g.warc": (b"", set()),
        "h.warc": (b"\r\n\r\n", set()),
    }
    for name, (data, want) in files.items():
        for size in (1, 7, 1 << 20):
            got = [f["warc-record-id"] for f, b in warc.scan_records(warc.file_chunks(data, size)) if f]
            found = {int(x[5:-1]) for x in got}
            assert want <= found <= want | {1} and len(got) == len(found), (name, size)
        (tmp_path / name).write_bytes(data)
    table = spark.read.format("binaryFile").load(str(tmp_path))
    rows = warc.read_responses(table)
    assert rows.count() >= sum(len(w) for _, w in files.values())
    assert {r.path[-6:] for r in warc.damaged(table).collect()} >= {"a.warc", "b.warc", "c.warc"}
    out = [r for r in warc.derive(rows).collect() if r.kind == "metadata"]
    for r in out:
        about = list(warc.parse_records(bytes(r.warc)))[0][1]
        assert b"source-warc-payload-digest: sha1:SOURCE" in about and b"source-warc-ip-address: 1.2.3.4" in about and b"source-http-server: s" in about and b"source-block-digest: sha1:" in about


@pytest.mark.parametrize("unit", ["<a ", "<a href='", '<a href="', "<!--", "<template>", "<nav>", "</nav", "<", "</", "<![", "<x y=\"'", "<p title='>", "&", "<head>", "<title>"])
def test_damaged_markup_takes_linear_time(unit):
    """1 MB of a tag that is never closed, with as many end tags where elements stay open."""
    page = "<html><body>" + unit * (1_000_000 // len(unit)) + ("</nav>" * 150_000 if unit in ("<template>", "<nav>") else "")
    start = time.process_time()
    warc.read_page(page)
    assert time.process_time() - start < 6


@pytest.mark.parametrize(
    ("page", "text", "links"),
    [
        ("<p>a <b <i>c", "a c", []),
        ('<a href="x>y">in</a> <a href=z>out', "in out", ["x>y", "z"]),
        ("<a href='u&amp;v' title=\"it's\">q</a>", "q", ["u&v"]),
        ('<a href="never closed>one<a href=two>t', "onet", ["two"]),
        ("1 < 2 &lt; 3 <4", "1 < 2 < 3 <4", []),
        ("a<!-- x > y --!> z -->b<!-->c<!--->d", "abcd", []),
        ("a<script>if (a < b) '</scr'</SCRIPT >b", "ab", []),
        ("a<?php x ?>b</ x>c</>d", "abcd", []),
        ("<DIV>A<BR/>B</DIV><A HREF=q>c</A>", "A\nB\nc", ["q"]),
    ],
)
def test_tags(page, text, links):
    assert warc.read_page(page)[1:] == (text, links)


def test_navigation_and_footers_stand_beside_the_text():
    title, text, aside, links = warc.read_whole_page(PAGE)
    assert (title, text, aside, links) == ("A & B", "One <two>\nthree\nfour five six again", "menu\nend", ["/x", "/y"])
    assert warc.read_whole_page("<footer>a<nav>b</nav>c</footer>d")[1:3] == ("d", "b\na\nc")
    assert "never" not in warc.read_whole_page("<template><nav>never shown</nav></template>x")[2]


class _Plain(HTMLParser):
    """Another reader, for pages that are well formed: what stands where is told by the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.title, self.links, self.seen = [], "", [], {"text": "", "aside": ""}

    def _to(self):
        if {"script", "style", "noscript", "template", "head"} & set(self.open):
            return None
        return "aside" if {"nav", "footer"} & set(self.open) else "text"

    def _cut(self, tag):
        if tag in ("p", "div", "br", "li", "ul", "ol", "tr", "table", "td", "th", "pre", "hr", "nav", "footer", "header", "form", "main", "section", "article", "aside", "blockquote") or (tag[0] == "h" and tag[1:].isdigit()):
            for k in self.seen:
                self.seen[k] += "\n"

    def handle_starttag(self, tag, attrs):
        self._cut(tag)
        if tag == "a" and dict(attrs).get("href") and dict(attrs)["href"].strip() not in self.links:
            self.links.append(dict(attrs)["href"].strip())
        if tag not in ("br", "hr", "img", "input", "meta", "link"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        self._cut(tag)
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_data(self, data):
        if "title" in self.open:
            self.title += data
        elif self._to():
            self.seen[self._to()] += data


def test_query_against_another_reader(spark):
    """Every record of the pages, from texts and digests that are made here."""
    sf = "/root/testdata/sf0.001"
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    urn = lambda *parts: f"<urn:uuid:{uuid.uuid5(space, chr(31).join(parts))}>"
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    got = {(r.page_id, r.kind): r for r in warc.op6_warc(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == 2 * len(pages) > 0
    for p in pages:
        reader = _Plain()
        reader.feed(p.html)
        reader.close()
        flat = lambda s: "\n".join(x for x in (" ".join(line.split()) for line in s.split("\n")) if x)
        text, aside = flat(reader.seen["text"]), flat(reader.seen["aside"])
        payload = p.html.encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        source = urn("response", str(p.page_id), p.url, sha(block))
        one, two = got[p.page_id, "conversion"], got[p.page_id, "metadata"]
        assert (one.n_chars, one.block_digest, one.aside_text, one.title) == (len(text), sha(text.encode()), aside, " ".join(reader.title.split()))
        assert one.n_links == two.n_links == len(reader.links)
        for r in (one, two):
            assert (r.refers_to, r.target_uri, r.source_digest, r.source_status, r.record_id) == (source, p.url, sha(payload), 200, urn(r.kind, source, p.url))
