"""Bytes to text and documents to Markdown, in Arrow batches over the standard library.

A converter gets bytes and returns Markdown with ground truth (slides, sheet
names), or an error code; a bad file is a row with a code and never fails a job.
"""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
NOT_UTF8 = "File is not valid UTF-8; decoded as {}. Non-ASCII characters may be wrong."
#: What a member of an office file may unpack to.
MEMBER_LIMIT = 256 << 20


@dataclass
class Converted:
    markdown: str
    slides: int | None = None
    sheets: list[str] | None = None


def append(rows: DataFrame, kind: str, make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """``rows`` with the columns ``kind``, made batch by batch."""
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, *make(b)], [*b.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {kind}")


def decode(raw: bytes) -> tuple[str, str]:
    for encoding in ENCODINGS[:-1]:
        try:
            return raw.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1"), "latin-1"


def decode_texts(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds text, encoding and decode_warning. UTF-8 rows stay in the JVM; only others go to Python."""
    as_text = F.col(content).cast("string")
    valid = F.is_valid_utf8(as_text)
    plain = F.when(F.hex(F.substring(F.col(content), 1, 3)) == "EFBBBF", F.substring(F.col(content), F.lit(4), F.length(F.col(content))).cast("string")).otherwise(as_text)
    native = rows.where(valid).withColumns({"text": plain, "encoding": F.lit("utf-8-sig"), "decode_warning": F.lit(None).cast("string")})

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        found = [decode(x or b"") for x in b.column(b.schema.names.index(content)).to_pylist()]
        return [pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string()), pa.array([None if e.startswith("utf") else NOT_UTF8.format(e) for _, e in found], pa.string())]

    return native.unionByName(append(rows.where(~valid), "text string, encoding string, decode_warning string", make))


def compose(rows: DataFrame, column: str) -> DataFrame:
    """The column in Unicode's composed form; rows of ASCII alone stay in the JVM."""
    plain = F.coalesce(~F.col(column).rlike(r"[^\x00-\x7F]"), F.lit(True))

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([unicodedata.normalize("NFC", x) for x in b.column(b.schema.names.index(column)).to_pylist()], pa.string())]

    others = append(rows.where(~plain), "__composed string", make)
    return rows.where(plain).unionByName(others.withColumn(column, F.col("__composed")).drop("__composed"))


def table_markdown(rows: list[list[str]]) -> str:
    """A pipe table; the first row heads it and sets its width."""
    if not rows:
        return ""
    width = max(1, len(rows[0]))
    line = lambda r: "| " + " | ".join((c or "").replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * width][:width]) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


class _Markdown(HTMLParser):
    QUIET = frozenset(("script", "style", "template", "noscript", "title", "head"))
    BLOCKS = frozenset("p div section article main header footer nav aside ul ol table tr blockquote form figure".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.quiet: list[str] = []
        self.links: list[str | None] = []
        self.rows: list[list[str]] | None = None
        self.pre = False

    def handle_starttag(self, tag, attrs):
        if tag in self.QUIET:
            self.quiet.append(tag)
        elif tag == "body":
            self.quiet.clear()
        elif self.quiet:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[" if self.links[-1] else "")
        elif tag in ("b", "strong", "i", "em"):
            self.out.append("**" if tag in ("b", "strong") else "*")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
        elif tag in self.BLOCKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag):
        if tag in self.QUIET:
            if tag in self.quiet:
                del self.quiet[self.quiet.index(tag) :]
        elif self.quiet:
            return
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in ("b", "strong", "i", "em"):
            self.out.append("**" if tag in ("b", "strong") else "*")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "table" and self.rows is not None:
            self.out.append("\n\n" + table_markdown([r for r in self.rows if r]) + "\n\n")
            self.rows = None
        elif tag in self.BLOCKS or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.quiet:
            return
        text = data if self.pre else re.sub(r"\s+", " ", data)
        if self.rows and self.rows[-1]:
            self.rows[-1][-1] = (self.rows[-1][-1] + text).strip()
        else:
            self.out.append(text)


def html_markdown(raw: bytes) -> Converted:
    parser = _Markdown()
    parser.feed(decode(raw)[0])
    parser.close()
    if parser.rows:
        parser.handle_endtag("table")
    text = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return Converted(re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+(?=\S)", "\n", text)).strip())


def csv_markdown(raw: bytes, delimiter: str = ",") -> Converted:
    return Converted(table_markdown([r for r in csv.reader(io.StringIO(decode(raw)[0]), delimiter=delimiter) if r]))


def notebook_markdown(raw: bytes) -> Converted:
    out = []
    for cell in json.loads(decode(raw)[0]).get("cells", []):
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else source
        out.append(f"```python\n{source}\n```" if cell.get("cell_type") == "code" else source)
    return Converted("\n\n".join(x for x in out if x.strip()))


def _member(archive: zipfile.ZipFile, name: str) -> bytes:
    """A member's bytes, no more than the limit whatever its header says."""
    with archive.open(name) as f:
        data = f.read(MEMBER_LIMIT + 1)
    if len(data) > MEMBER_LIMIT:
        raise ValueError("a member is too large")
    return data


def _members(raw: bytes) -> tuple[zipfile.ZipFile, Callable[[str], ET.Element]]:
    archive = zipfile.ZipFile(io.BytesIO(raw))

    def xml(name: str) -> ET.Element:
        data = _member(archive, name)
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data[:4096]:
            raise ValueError("entities are not read")
        return ET.fromstring(data)

    return archive, xml


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ET.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def docx_markdown(raw: bytes) -> Converted:
    _, xml = _members(raw)
    body = next(x for x in xml("word/document.xml") if _local(x.tag) == "body")
    out = []
    for block in body:
        if _local(block.tag) == "tbl":
            out.append(table_markdown([[_texts(c) for c in row if _local(c.tag) == "tc"] for row in block if _local(row.tag) == "tr"]))
        elif _local(block.tag) == "p":
            style = next((v for x in block.iter() if _local(x.tag) == "pStyle" for v in x.attrib.values()), "")
            text = _texts(block)
            level = re.fullmatch(r"(?i)heading\s*([1-6])", style)
            out.append(("#" * int(level[1]) + " " if level else "- " if style.lower().startswith("list") else "") + text if text.strip() else "")
    return Converted("\n\n".join(x for x in out if x))


def _related(archive: zipfile.ZipFile, xml: Callable[[str], ET.Element], part: str) -> dict[str, str]:
    folder, name = part.rsplit("/", 1)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    return {r.attrib["Id"]: r.attrib["Target"].lstrip("/") if r.attrib["Target"].startswith("/") else f"{folder}/{r.attrib['Target']}" for r in xml(rels)}


def _listed(root: ET.Element, kind: str, links: dict[str, str]) -> list[tuple[str | None, str]]:
    found = []
    for node in root.iter():
        if _local(node.tag) == kind:
            target = next((links[v] for k, v in node.attrib.items() if k.endswith("}id") and v in links), None)
            if target:
                found.append((node.attrib.get("name"), target))
    return found


def pptx_markdown(raw: bytes) -> Converted:
    archive, xml = _members(raw)
    parts = _listed(xml("ppt/presentation.xml"), "sldId", _related(archive, xml, "ppt/presentation.xml"))
    out = []
    for n, (_, part) in enumerate(parts, 1):
        paragraphs = [_texts(p) for p in xml(part).iter() if _local(p.tag) == "p"]
        out.append(f"<!-- Slide number: {n} -->\n" + "\n".join(p for p in paragraphs if p.strip()))
    return Converted("\n\n".join(out), slides=len(parts))


def xlsx_markdown(raw: bytes) -> Converted:
    archive, xml = _members(raw)
    shared = [_texts(x) for x in xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in archive.namelist() else []
    sheets = _listed(xml("xl/workbook.xml"), "sheet", _related(archive, xml, "xl/workbook.xml"))
    out = []
    for name, part in sheets:
        rows = []
        for row in (x for x in xml(part).iter() if _local(x.tag) == "row"):
            cells: dict[int, str] = {}
            for at, cell in enumerate(row):
                letters = re.match("[A-Z]+", cell.attrib.get("r", ""))
                column = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters[0]))) - 1 if letters else at
                value = next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
                cells[column] = shared[int(value)] if cell.attrib.get("t") == "s" and value else _texts(cell) if cell.attrib.get("t") == "inlineStr" else value
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        out.append(f"## {name}\n\n" + table_markdown(rows))
    return Converted("\n\n".join(out), sheets=[n for n, _ in sheets])


def epub_markdown(raw: bytes) -> Converted:
    archive, xml = _members(raw)
    package = next(x.attrib["full-path"] for x in xml("META-INF/container.xml").iter() if _local(x.tag) == "rootfile")
    root, folder = xml(package), package.rsplit("/", 1)[0] + "/" if "/" in package else ""
    files = {x.attrib["id"]: x.attrib["href"] for x in root.iter() if _local(x.tag) == "item"}
    spine = [files[x.attrib["idref"]] for x in root.iter() if _local(x.tag) == "itemref" and x.attrib.get("idref") in files]
    return Converted("\n\n".join(html_markdown(_member(archive, folder + f)).markdown for f in spine))


CONVERTERS: dict[str, Callable[[bytes], Converted]] = {
    ".html": html_markdown, ".htm": html_markdown, ".xhtml": html_markdown, ".csv": csv_markdown, ".tsv": lambda raw: csv_markdown(raw, "\t"),
    ".ipynb": notebook_markdown, ".docx": docx_markdown, ".pptx": pptx_markdown, ".xlsx": xlsx_markdown, ".epub": epub_markdown,
}


def convert(rows: DataFrame, extra: dict[str, Callable[[bytes], Converted]] | None = None) -> DataFrame:
    """Adds markdown, slide_count, sheet_names and convert_error. ``rows`` has content and extension.

    ``extra`` adds converters for formats that the standard library cannot read
    (.xls and .msg have none here).
    """
    known = {**CONVERTERS, **(extra or {})}

    def one(extension: str, raw: bytes) -> tuple:
        if extension not in known:
            return None, None, None, "UNSUPPORTED_MEDIA_TYPE"
        try:
            c = known[extension](raw or b"")
            return c.markdown, c.slides, c.sheets, None
        except Exception:  # whatever a broken file makes a parser raise is that row's error
            return None, None, None, "DOCUMENT_CONVERSION_FAILED"

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        at = b.schema.names.index
        found = [one(e, c) for e, c in zip(b.column(at("extension")).to_pylist(), b.column(at("content")).to_pylist(), strict=True)]
        kinds = (pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
        return [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]

    return append(rows, "markdown string, slide_count int, sheet_names array<string>, convert_error string", make)
