"""WARC derivatives: response records become linked metadata and plain-text conversion records.

For every response two records are derived. The ``metadata`` record is JSON
with the response's headers, its HTTP status and headers, digests, title and
links; the ``conversion`` record is its plain text. Both name the response in
WARC-Refers-To and carry its target URI and date, and their own identifiers
follow from it, so that a rerun makes the same records.

Plain text: comments, declarations and the content of script, style, template,
noscript and title go; block elements begin a line; cells are kept apart by a
space; entities are decoded; white space is collapsed and empty lines go. What
is not closed ends with the document.

Defined cases: a null body is empty and its conversion record has no content; a
null URL is left out of the headers; a response without an HTTP header block
(or a null status) has status 0; a body that isn't UTF-8 is read with
replacements while the digests stay those of its bytes; rows that repeat give
equal records; other columns are ignored; no rows give no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lodeframe:warc")
#: Elements whose content is no text, elements that begin a line, and cells. Fixed values of HTML.
SILENT = "script|style|template|noscript|title"
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody tfoot thead tr ul".split())
CELLS = frozenset(("td", "th"))
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?P<inside>.*?)(?:</(?P=silent)\s*>|\Z)"
    r"|</?(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[A-Za-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, headers string, block binary"


def parse_html(text: str) -> tuple[str, str, list[str]]:
    """Plain text, title and link targets."""
    out, links, title, at = [], [], None, 0
    for m in MARKUP.finditer(text):
        if m.start() > at:
            out.append(html.unescape(text[at : m.start()]).replace("\n", " "))
        at = m.end()
        name = (m["name"] or m["silent"] or "").lower()
        if m["silent"]:
            if name == "title" and title is None:
                title = " ".join(html.unescape(m["inside"]).split())
        elif name in BLOCKS:
            out.append("\n")
        elif name in CELLS:
            out.append(" ")
        elif name == "a" and m["attributes"] and (href := HREF.search(m["attributes"])):
            links.append(html.unescape(next(x for x in href.groups() if x is not None)))
    out.append(html.unescape(text[at:]).replace("\n", " "))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), title or "", links


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def header_lines(headers: list[tuple[str, str | None]]) -> str:
    """The named fields that have a value; line breaks inside values can't start another field."""
    return "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in headers if v is not None)


def make_record(kind: str, name: str, uri: str | None, date: str, content_type: str, block: bytes, refers_to: str | None = None, payload: bytes | None = None) -> dict:
    sums = digest(block), digest(payload) if payload is not None else None
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", content_type), ("WARC-Block-Digest", sums[0]), ("WARC-Payload-Digest", sums[1]), ("Content-Length", str(len(block)))]
    return {"warc_type": kind, "record_id": name, "refers_to": refers_to, "target_uri": uri, "date": date, "content_type": content_type, "block_digest": sums[0], "payload_digest": sums[1], "headers": "WARC/1.0\r\n" + header_lines(fields), "block": block}


def split_http(block: bytes) -> tuple[int, dict[str, str], bytes]:
    """Status, headers and payload of an HTTP response block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    first, *rest = head.decode("latin-1").split("\r\n")
    if not gap or not (m := re.match(r"HTTP/\d(?:\.\d)? (\d{3})", first)):
        return 0, {}, block
    return int(m[1]), {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}, payload


def derivatives(response: dict) -> tuple[dict, dict, dict]:
    """The metadata and the conversion record of a response, and what was found in it."""
    status, http, payload = split_http(response["block"] or b"")
    text, title, links = parse_html(payload.decode("utf-8", "replace"))
    name, uri, date = response["record_id"], response["target_uri"], response["date"]
    found = {"status": status, "title": title, "links": links, "text": text, "payload_digest": digest(payload)}
    source = dict(x.split(": ", 1) for x in (response["headers"] or "").split("\r\n")[1:] if ": " in x)
    envelope = {"warc-header": source, "http-status": status, "http-headers": http, "payload-length": len(payload), "payload-digest": found["payload_digest"], "title": title, "links": links}
    metadata = make_record("metadata", record_id(name, "metadata"), uri, date, "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode(), name)
    conversion = make_record("conversion", record_id(name, "conversion"), uri, date, "text/plain", text.encode(), name)
    return metadata, conversion, found


def _table(rows: list[dict]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], pa.binary() if k == "block" else pa.string()) for k in names], names)


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records; ``page`` is the identifier. ``date`` is when they were fetched, as pages don't say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, url, body in zip(*(b.column(k).to_pylist() for k in ("page", "url", "body")), strict=True):
                body = body or b""
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                rows.append(make_record("response", record_id(str(page), url or "", digest(body)), url, date, "application/http; msgtype=response", block, payload=body))
            out = _table(rows)
            yield pa.record_batch([b.column("page"), *out.columns], ["page", *out.schema.names])

    source = narrow(pages, page=id_col, url=url_col, body=html_col)
    return source.select(F.col("page").cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.col("body").cast("binary").alias("body")).mapInArrow(run, f"page long, {RECORD}")


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the response records among ``records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _table([x for r in b.to_pylist() for x in derivatives(r)[:2]])

    source = records.where("warc_type = 'response'").select("record_id", "target_uri", "date", "headers", "block")
    return source.mapInArrow(run, RECORD)


def derivative_digests(pages: DataFrame, **columns: str) -> DataFrame:
    """A row for each page: identifiers and digests of its response and of both derived records, and what they hold."""
    names = ["page_id long", "target_uri string", "response_id string", "metadata_id string", "metadata_refers_to string", "metadata_digest string", "conversion_id string", "conversion_refers_to string", "conversion_digest string", "payload_digest string", "source_digest string", "title string", "n_links long", "n_chars long", "text_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                metadata, conversion, found = derivatives(r)
                rows.append((r["page"], r["target_uri"], r["record_id"], metadata["record_id"], metadata["refers_to"], metadata["block_digest"], conversion["record_id"], conversion["refers_to"], conversion["block_digest"], found["payload_digest"], r["payload_digest"], found["title"], len(found["links"]), len(found["text"]), hashlib.sha256(conversion["block"]).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(x, pa.int64() if n.endswith("long") else pa.string()) for n, x in zip(names, columns, strict=True)], [n.split()[0] for n in names])

    return responses(pages, **columns).mapInArrow(run, ", ".join(names))


def record_bytes(headers: str, block: bytes) -> bytes:
    """A record as a gzip member; members in a row are a WARC file. The same record always gives the same bytes."""
    return gzip.compress(headers.encode() + b"\r\n" + block + b"\r\n\r\n", mtime=0)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as Parquet, each also as its gzip member, from which ``export_warc`` makes WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = [record_bytes(h, d) for h, d in zip(b.column("headers").to_pylist(), b.column("block").to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(members, pa.binary())], [*b.schema.names, "member"])

    names = [x.split()[0] for x in RECORD.split(", ")]
    records.select(*names).mapInArrow(run, f"{RECORD}, member binary").write.parquet(path)


def export_warc(spark: SparkSession, path: str, file: str) -> int:
    """Stream the members of a written table into one local .warc.gz; returns their number."""
    n = 0
    with open(file, "wb") as out:
        for row in spark.read.parquet(path).select("member").toLocalIterator():
            out.write(row.member)
            n += 1
    return n


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or with a gzip member for each record."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data) + member.flush())
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        head = data[at:end].decode("utf-8", "replace").lstrip("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
        size = int(fields.get("content-length") or 0)
        block = data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4
        yield {"warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "content_type": fields.get("content-type"), "block_digest": fields.get("warc-block-digest"), "payload_digest": fields.get("warc-payload-digest"), "headers": head + "\r\n", "block": block}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``; files are spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                yield _table(list(parse_warc(data.as_py())))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
