"""WARC derivatives: metadata and plain-text conversion records linked with the responses they come from.

A response record is read from the bytes of a WARC file (`read_responses`) or made from a table of pages
(`pages_to_responses`). For each response `derive` gives two records:

* `metadata`: application/warc-fields, with the fetched status, the source's media type, length, block
  and payload digest, all other fields of its record's header (the digests that it came with too) and of
  its HTTP head, the title, and the outlinks in order of first appearance;
* `conversion`: text/plain, the visible text. What navigation and footers hold stands beside it in `aside_text`.

Both carry WARC-Refers-To with the response's record id, its target URI and date, a digest of their own
block, and the source's payload digest. Record ids are made from the source's id and the kind, so a job
that runs again gives the same records. `to_bytes` writes a record in the format of WARC 1.1, and
`parse_records` reads it back.

Defined cases: null html is an empty payload with an empty text; null URLs give records without target;
repeated pages give records of their own with equal ids; an empty table gives an empty table; extra
columns are ignored. A response whose HTTP head cannot be read is taken as all payload. Any markup is read
to its end; damaged parts of a file are skipped up to the next record.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatlas.llm.words import slices
from verbatlas.session import ship, table

#: The date of records from tables that have none.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HIDDEN = {"script", "style", "noscript", "template", "head", "nav", "footer"}
#: Tags that may stand in a head; any other one ends it.
_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main", "aside", "blockquote", "pre", "td", "th", "header", "form", "hr"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "param", "track"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the usual label of web archives


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


# -- records --------------------------------------------------------------------------------------
def to_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; values of headers lose line breaks."""
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in headers if v), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    """The fields of a record's header, names in lower case; lines that go on are joined."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed file; damage is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = header_fields(data[at:end])
        size = int(fields.get("content-length", "0"))
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError("a record is cut short")
        yield fields, block
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2


def scan_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """The records of a file that comes in pieces, as parse_records gives them; damage does not end the scan.

    What is no record (no WARC line, no length, a block that is cut short or does not end where it should) is
    skipped up to the next record, and given as None with the bytes that were skipped.
    """
    source, held = iter(chunks), bytearray()

    def more() -> bool:
        for piece in source:
            if piece:
                held.extend(piece)
                return True
        return False

    while held.strip(b"\r\n") or more():
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if not held:
            continue
        while (end := held.find(b"\r\n\r\n")) < 0 and len(held) < MOST_HEADER and more():
            pass
        if end >= 0 and held.startswith(b"WARC/"):
            fields = header_fields(bytes(held[:end]))
            length = fields.get("content-length", "")
            if length.isascii() and length.isdigit():
                stop = end + 4 + int(length)
                while len(held) < stop + 4 and more():
                    pass
                if len(held) >= stop and (len(held) == stop or bytes(held[stop : stop + 2]) == b"\r\n"):
                    yield fields, bytes(held[end + 4 : stop])
                    del held[:stop]
                    continue
        lost = bytearray()
        while (at := held.find(b"WARC/1.", 0 if lost else 1)) < 0:
            keep = max(1, len(held) - 6)  # the rest may begin the next record's first line
            lost += held[:keep]
            del held[:keep]
            if not more():
                at = len(held)
                break
        yield None, bytes(lost + held[:at])
        del held[:at]


def file_chunks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an uncompressed or gzipped file in pieces, member by member; a damaged member ends at its damage."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[k : k + size] for k in range(0, len(data), size))
        return
    at = 0
    while 0 <= at < len(data):
        member, k = zlib.decompressobj(31), at
        try:
            while k < len(data) and not member.eof:
                piece = member.decompress(data[k : k + size] if not member.unconsumed_tail else member.unconsumed_tail, 4 * size)
                if not member.unconsumed_tail:
                    k += size
                yield piece
            while member.unconsumed_tail and not member.eof:
                yield member.decompress(member.unconsumed_tail, 4 * size)
            at = min(k, len(data)) - len(member.unused_data) if member.eof else len(data)
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", at + 1)


def split_http(block: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, header fields and payload of an HTTP response; status 0 and all payload if it is none."""
    head, found, payload = block.partition(b"\r\n\r\n")
    m = re.match(rb"HTTP/\d(?:\.\d)? (\d{3})", head)
    if not found or not m:
        return 0, {}, block
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return int(m[1]), fields, payload


# -- text -----------------------------------------------------------------------------------------
_NAME = re.compile(r"[A-Za-z][^\s/><\x00]*")
#: The inside of a tag up to its end, a quote, or the next tag's beginning.
_INSIDE = re.compile(r"[^<>\"']*")
_ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*|))?")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE) for tag in ("script", "style")}


def scan_markup(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, inside) of the parts of a page, in one pass forward: kinds are text, start and end.

    A tag that does not end before the next `<` ends there. Comments, declarations and what scripts and styles hold
    are left out; one that is never closed takes the rest of the page.
    """
    at, n = 0, len(source)
    open_quote = {'"': True, "'": True}  # whether one may still be closed

    def tag_end(k: int) -> int:
        while True:
            k = _INSIDE.match(source, k).end()
            if k >= n or source[k] in "<>":
                return k
            quote = source[k]
            close = source.find(quote, k + 1) if open_quote[quote] else -1
            open_quote[quote] = close >= 0
            k = close + 1 if close >= 0 else k + 1

    while at < n:
        k = source.find("<", at)
        if k < 0:
            yield "text", html.unescape(source[at:]), ""
            return
        if k > at:
            yield "text", html.unescape(source[at:k]), ""
        if m := _NAME.match(source, k + 1):
            end = tag_end(m.end())
            tag = m[0].lower()
            yield "start", tag, source[m.end() : end]
            at = end + (end < n and source[end] == ">")
            if tag in _RAW_END:
                closed = _RAW_END[tag].search(source, at)
                if not closed:
                    return
                yield "end", tag, ""
                at = closed.end()
        elif source.startswith("</", k):
            m = _NAME.match(source, k + 2)
            end = tag_end(m.end()) if m else source.find(">", k + 2)
            if end < 0:
                return
            if m:
                yield "end", m[0].lower(), ""
            at = end + (end < n and source[end] == ">")
        elif source.startswith("<!--", k):
            end = 0 if source.startswith((">", "->"), k + 4) else source.find("-->", k + 4)
            if end < 0:
                return
            at = end + 3 if end else source.index(">", k) + 1
        elif source.startswith(("<!", "<?"), k):
            end = source.find(">", k + 2)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "<", ""
            at = k + 1


class _Page:
    """Title, visible text and outlinks. Hidden parts give no text; navigation and footers give theirs apart.

    What a hidden element holds is taken back at its end tag, so one that is never closed hides nothing
    (but for scripts and styles, whose rest is no text). A head ends at the first tag or text of a body too.
    """

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.aside: list[str] = []
        self.title: list[str] = []
        self.links: dict[str, None] = {}
        #: Open hidden elements, how many parts there were before each, and how many of them are open by name.
        self.hidden: list[tuple[str, int, int]] = []
        self.open: dict[str, int] = {}
        self.in_title = False

    def _end_hidden(self, tag: str) -> None:
        """Ends the last open hidden element of this name and those opened within it: their text goes."""
        while True:
            name, at, aside = self.hidden.pop()
            self.open[name] -= 1
            if name == tag:
                break
        if tag in ("nav", "footer"):
            self.aside += [*self.parts[at:], "\n"]
            del self.parts[at:]
            self.parts.append("\n")
        else:
            del self.parts[at:], self.aside[aside:]

    def start(self, tag: str, inside: str) -> None:
        if tag == "a":
            for name, value in _ATTRIBUTE.findall(inside):
                value = html.unescape(value[1:-1] if value[:1] in ('"', "'") and value[-1:] == value[:1] and len(value) > 1 else value)
                if name.lower() == "href" and value:
                    self.links.setdefault(value.strip())
        if tag not in _HEAD:
            self.in_title = False
        if self.hidden and self.hidden[0][0] == "head" and (tag == "body" or (len(self.hidden) == 1 and tag not in _HEAD)):
            while self.open.get("head"):
                self._end_hidden("head")
        if tag == "title":
            self.in_title = True
        elif tag in _HIDDEN:
            self.hidden.append((tag, len(self.parts), len(self.aside)))
            self.open[tag] = self.open.get(tag, 0) + 1
        if tag in _BLOCKS:
            self.parts.append("\n")

    def end(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif self.open.get(tag):
            self._end_hidden(tag)
        if tag in _BLOCKS:
            self.parts.append("\n")

    def text(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        else:
            if len(self.hidden) == 1 and self.hidden[0][0] == "head" and data.strip():
                self._end_hidden("head")
            self.parts.append(data)


def _lines(parts: list[str]) -> str:
    """A line for each block, white space collapsed."""
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line)


def read_whole_page(source: str) -> tuple[str, str, str, list[str]]:
    """Title, text, text of navigation and footers, and outlinks of a page, in time that grows with its length."""
    page = _Page()
    for kind, name, inside in scan_markup(source):
        if kind == "text":
            page.text(name)
        elif kind == "start":
            page.start(name, inside)
        else:
            page.end(name)
    return " ".join("".join(page.title).split()), _lines(page.parts), _lines(page.aside), list(page.links)


def read_page(source: str) -> tuple[str, str, list[str]]:
    """Title, text and outlinks of a page."""
    title, text, _, links = read_whole_page(source)
    return title, text, links


# -- tables ---------------------------------------------------------------------------------------
RESPONSE = "record_id string, target_uri string, date string, fields string, block binary"
_RESPONSE = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("fields", pa.string()), ("block", pa.binary())])
#: Header fields of a source that its derivatives have in another form, or that hold for its own bytes only.
_OWN = {"warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-length", "content-type"}
#: Bytes of a record's header at most, and of the blocks that are derived at once.
MOST_HEADER, BATCH_BYTES = 1 << 20, 4_000_000
DERIVED = (
    "page_id long, source_id string, kind string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "block_digest string, source_digest string, source_status int, source_type string, title string, n_links int, n_chars long, aside_text string, warc binary"
)


def response_block(source: str | None) -> bytes:
    payload = (source or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def pages_to_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id and the response record of each page."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [response_block(x.as_py()) for x in batch.column(2)]
            made = [record_id("response", str(i), u or "", digest(b)) for i, u, b in zip(ids, urls, blocks, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), batch.column(1), pa.array([DATE] * len(ids)), pa.nulls(len(ids), pa.string()), pa.array(blocks, pa.binary())], ["page_id", *_RESPONSE.names])

    return rows.mapInArrow(work, f"page_id long, {RESPONSE}")


def read_responses(files: DataFrame, content_col: str = "content") -> DataFrame:
    """The response records of whole uncompressed or gzipped WARC files, as Spark's binaryFile source reads them.

    page_id is null: it belongs to tables of pages. fields holds the record's header as JSON. Damaged parts are
    passed over; damaged() counts them.
    """
    ship(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for fields, block in scan_records(file_chunks(raw.as_py() or b"")):
                    if fields and fields.get("warc-type") == "response":
                        rows.append((None, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), json.dumps(fields), block))
                        held += len(block)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *_RESPONSE.types], strict=True)], ["page_id", *_RESPONSE.names])
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *_RESPONSE.types], strict=True)], ["page_id", *_RESPONSE.names])

    return files.select(F.col(content_col)).mapInArrow(work, f"page_id long, {RESPONSE}")


def damaged(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """path, parts, bytes: how many parts of each file were skipped as damaged, and their bytes; files without are left out."""
    ship(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):
                lost = [len(block) for fields, block in scan_records(file_chunks(raw.as_py() or b"")) if fields is None]
                if lost:
                    yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([len(lost)], pa.int64()), pa.array([sum(lost)], pa.int64())], ["path", "parts", "bytes"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(work, "path string, parts long, bytes long")


def _pair(page_id, source_id: str | None, uri: str | None, date: str | None, fields_json: str | None, block: bytes | None) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of DERIVED."""
    source_id, uri, date = source_id or "", uri or "", date or DATE
    status, fields, payload = split_http(block or b"")
    kind = fields.get("content-type", "")
    charset = re.search(r"charset=[\"']?([\w.-]+)", kind)
    try:
        source = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        source = payload.decode("utf-8", "replace")
    is_html = "html" in kind or not kind
    title, text, aside, links = read_whole_page(source) if is_html else ("", source, "", [])
    payload_digest, source_digest = digest(payload), digest(block or b"")
    source_fields = [(f"source-{k}", v) for k, v in json.loads(fields_json or "{}").items() if k not in _OWN]
    facts = [("source-status", str(status) if status else ""), ("source-content-type", kind), ("source-length", str(len(payload))), ("source-block-digest", source_digest), ("source-payload-digest", payload_digest)]
    facts += [*source_fields, *((f"source-http-{k}", v) for k, v in fields.items() if k != "content-type"), ("title", title)]
    about = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [*facts, *(("outlink", x) for x in links)] if v).encode()
    out = []
    for name, media, made in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text.encode())):
        own = record_id(name, source_id, uri)
        headers = [
            ("WARC-Type", name), ("WARC-Record-ID", own), ("WARC-Refers-To", source_id), ("WARC-Target-URI", uri), ("WARC-Date", date),
            ("WARC-Block-Digest", digest(made)), ("WARC-Source-Block-Digest", source_digest), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Source-Content-Type", kind), ("Content-Type", media),
        ]
        out.append((page_id, source_id, name, own, source_id, uri or None, date, media, digest(made), payload_digest, status, kind, title, len(links), len(made.decode()), aside if name == "conversion" else "", to_bytes(headers, made)))
    return out


def derive(responses: DataFrame) -> DataFrame:
    """Two rows of DERIVED for each response (page_id and the columns of RESPONSE): its metadata and its conversion record."""
    ship(responses.sparkSession)
    types = [pa.int64(), *[pa.string()] * 9, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(batch.num_columns - 1), BATCH_BYTES):
                part = batch.slice(lo, hi - lo)
                rows = [r for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in _pair(*x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return responses.select("page_id", *_RESPONSE.names).mapInArrow(work, DERIVED)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivatives of all pages, with the digest of each record's bytes in place of the bytes."""
    out = derive(pages_to_responses(table(spark, sf_dir, "pages")))
    return out.withColumn("warc_sha256", F.sha2("warc", 256)).withColumn("warc_bytes", F.octet_length("warc").cast("long")).drop("warc", "source_id")


QUERIES = {"op6_warc": op6_warc}
ORACLE_SQL: dict[str, str] = {}
