"""What a file is: by its name, by its first bytes, and which of the two to believe."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OOXML = "application/vnd.openxmlformats-officedocument."
#: Extension -> (MIME type, category). Fixed values.
EXTENSIONS = {
    ".png": ("image/png", "image"), ".jpg": ("image/jpeg", "image"), ".jpeg": ("image/jpeg", "image"), ".webp": ("image/webp", "image"),
    ".bmp": ("image/bmp", "image"), ".tif": ("image/tiff", "image"), ".tiff": ("image/tiff", "image"), ".gif": ("image/gif", "image"),
    ".pdf": ("application/pdf", "pdf"),
    ".docx": (OOXML + "wordprocessingml.document", "office"), ".pptx": (OOXML + "presentationml.presentation", "office"),
    ".xlsx": (OOXML + "spreadsheetml.sheet", "office"), ".xls": ("application/vnd.ms-excel", "office"),
    ".csv": ("text/csv", "data"), ".tsv": ("text/tab-separated-values", "data"),
    ".json": ("application/json", "text"), ".txt": ("text/plain", "text"), ".md": ("text/markdown", "text"), ".markdown": ("text/markdown", "text"),
    ".rst": ("text/x-rst", "text"), ".log": ("text/plain", "text"),
    ".html": ("text/html", "html"), ".htm": ("text/html", "html"), ".xhtml": ("application/xhtml+xml", "html"),
    ".msg": ("application/vnd.ms-outlook", "email"), ".epub": ("application/epub+zip", "ebook"), ".ipynb": ("application/x-ipynb+json", "notebook"),
    ".mp3": ("audio/mpeg", "audio"), ".wav": ("audio/wav", "audio"), ".m4a": ("audio/mp4", "audio"), ".flac": ("audio/flac", "audio"),
    ".zip": ("application/zip", "archive"),
}
#: First bytes in hex -> (kind, MIME type), in this order. Fixed values.
SIGNATURES = (
    ("89504E470D0A1A0A", "png", "image/png"), ("FFD8FF", "jpeg", "image/jpeg"), ("474946383761", "gif", "image/gif"), ("474946383961", "gif", "image/gif"),
    ("424D", "bmp", "image/bmp"), ("49492A00", "tiff", "image/tiff"), ("4D4D002A", "tiff", "image/tiff"), ("255044462D", "pdf", "application/pdf"),
    ("D0CF11E0A1B11AE1", "ole2", "application/x-ole-storage"),
)
#: First folder of a zip's members -> MIME type, in this order. Fixed values.
MEMBERS = (("word/", OOXML + "wordprocessingml.document"), ("ppt/", OOXML + "presentationml.presentation"), ("xl/", OOXML + "spreadsheetml.sheet"))
CATEGORIES = ("image", "pdf", "office", "text", "html", "data", "email", "ebook", "notebook", "audio", "archive", "unknown")
#: Other extensions that a platform's table names; pinned, so that all executors agree.
PLATFORM = {".py": "text/x-python", ".c": "text/x-csrc", ".css": "text/css", ".xml": "text/xml", ".js": "text/javascript", ".svg": "image/svg+xml", ".ico": "image/vnd.microsoft.icon", ".mp4": "video/mp4", ".tar": "application/x-tar"}
REFUSED = {"archive": "Archives are not processed.", "audio": "Audio transcription is not implemented."}


def extension_table(spark: SparkSession) -> DataFrame:
    """A row for each known extension; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame([(e, m, c) for e, (m, c) in EXTENSIONS.items()], "extension string, ext_mime string, ext_category string")


def category_of(mime: Column) -> Column:
    return (
        F.when(mime.startswith("image/"), "image")
        .when(mime == "application/pdf", "pdf")
        .when(mime.startswith("audio/"), "audio")
        .when(mime == "application/zip", "archive")
        .when(mime == "application/epub+zip", "ebook")
        .when(mime.contains("officedocument") | (mime == "application/vnd.ms-excel"), "office")
        .when(mime.isin("text/html", "application/xhtml+xml"), "html")
        .when(mime.startswith("text/"), "text")
        .otherwise("unknown")
    )


def container_mime(members: Column) -> Column:
    """MIME type of a zip by (at most 200 of) its member names; null names are a broken zip."""
    starts = lambda folder: F.exists(members, lambda m: m.startswith(folder))
    out = F.lit("application/zip")
    for folder, mime in reversed(MEMBERS):
        out = F.when(starts(folder), mime).otherwise(out)
    return F.when(members.isNull(), "application/zip").when(F.exists(members, lambda m: m == "mimetype"), "application/epub+zip").otherwise(out)


def sniff(head: Column, members: Column | None = None) -> Column:
    """struct<kind, mime> from the first 16 bytes in hex; nulls where nothing is known."""
    members = F.lit(None).cast("array<string>") if members is None else members
    zip_mime = container_mime(members)
    zip_kind = F.when(zip_mime == "application/zip", "zip").when(zip_mime == "application/epub+zip", "epub").otherwise("ooxml")
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    kind, mime = F.when(head.startswith("504B"), zip_kind), F.when(head.startswith("504B"), zip_mime)
    for start, k, m in reversed(SIGNATURES):
        kind, mime = F.when(head.startswith(start), k).otherwise(kind), F.when(head.startswith(start), m).otherwise(mime)
    return F.struct(F.when(webp, "webp").otherwise(kind).alias("kind"), F.when(webp, "image/webp").otherwise(mime).alias("mime"))


def zip_members(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``members``: names in the central directory of zip files, null for others. Nothing is unpacked."""

    def names(data: bytes | None) -> list[str] | None:
        if not data or data[:2] != b"PK":
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                return archive.namelist()[:200]
        except (zipfile.BadZipFile, OSError, ValueError):
            return None

    at = files.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([names(x) for x in b.column(at).to_pylist()], pa.list_(pa.string()))], [*b.schema.names, "members"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{schema}, members array<string>")


def detect(files: DataFrame, head: Column, members: Column | None = None) -> DataFrame:
    """Adds mime_type, category and sniffed_type. ``files`` has ``extension`` (lower case, with its dot).

    The bytes win where they contradict the name, except that an OLE2 file
    keeps an office extension. What neither knows is looked up in the pinned
    platform table, and is else an octet stream.
    """
    known = files.join(F.broadcast(extension_table(files.sparkSession)), "extension", "left")
    marked = known.withColumn("__sniffed", sniff(head, members))
    named, seen = F.coalesce("ext_category", F.lit("unknown")), category_of(F.col("__sniffed.mime"))
    contradicts = F.col("__sniffed.mime").isNotNull() & ((named == "unknown") | ((seen != "unknown") & (seen != named)))
    trusted = contradicts & ~((F.col("__sniffed.kind") == "ole2") & (named == "office"))
    guess = F.lit(None).cast("string")
    for ext, mime in PLATFORM.items():
        guess = F.when(F.col("extension") == ext, mime).otherwise(guess)
    first = F.coalesce(F.when(trusted, F.col("__sniffed.mime")), F.col("ext_mime"))
    mime = F.coalesce(first, guess, F.lit("application/octet-stream"))
    category = F.when(trusted, seen).when(first.isNull() & guess.isNotNull(), category_of(guess)).otherwise(named)
    found = marked.withColumns({"mime_type": mime, "category": category, "sniffed_type": F.col("__sniffed.kind")})
    return found.drop("__sniffed", "ext_mime", "ext_category")


def refusal(category: Column) -> Column:
    """The reason why a category is not processed, null if it is."""
    out = F.when(category == "unknown", "Unrecognised file type.")
    for name, reason in REFUSED.items():
        out = F.when(category == name, reason).otherwise(out)
    return out
