"""Slides, sheets and headings of converted documents, in one row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind, excerpt, strip

#: Where a slide, a sheet and any heading begin. Fixed values of the converted format.
SLIDE, SHEET = r"(?m)^<!-- Slide number:\s*(\d+)\s*-->\s*$", r"(?m)^##\s+(.+?)\s*$"
HEADING_LINE = r"(?m)^(#{1,6}[ \t]+\S[^\n]*)$"
NONE = "array<struct<name:string,body:string>>"


def _pieces(markdown: Column, marker: str) -> Column:
    """struct<name, body> for each marker; what precedes the first is left out."""

    def cut(md: Column) -> Column:
        names = F.transform(F.regexp_extract_all(md, F.lit(marker), F.lit(1)), strip)
        bodies = F.slice(F.split(md, marker), 2, F.greatest(F.size(F.split(md, marker)) - 1, F.lit(1)))
        return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), strip(b).alias("body")))

    return bind(markdown, cut)


def split_slides(markdown: Column, expected: Column | None = None) -> Column:
    """Slides if their numbers are 1 to n (the true n, if it is known), else an empty array."""

    def trusted(pieces: Column) -> Column:
        n = F.size(pieces) if expected is None else F.coalesce(expected, F.size(pieces))
        numbers = F.transform(pieces, lambda p: p["name"].cast("int"))
        right = (F.size(pieces) > 0) & (F.size(pieces) == n) & (numbers == F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))))
        return F.when(right, pieces).otherwise(F.array().cast(NONE))

    return bind(_pieces(markdown, SLIDE), trusted)


def split_sheets(markdown: Column, expected: Column | None = None) -> Column:
    """Sheets if their names are the true ones in their order (where those are known), else an empty array."""

    def trusted(pieces: Column) -> Column:
        names = F.transform(pieces, lambda p: p["name"])
        right = F.size(pieces) > 0 if expected is None else (F.size(pieces) > 0) & F.coalesce(names == expected, expected.isNull())
        return F.when(right, pieces).otherwise(F.array().cast(NONE))

    return bind(_pieces(markdown, SHEET), trusted)


def outline(markdown: Column, limit: int = 12) -> Column:
    """The first headings, one space after their marks."""
    found = F.regexp_extract_all(markdown, F.lit(HEADING_LINE), F.lit(1))
    return F.slice(F.transform(found, lambda h: strip(F.regexp_replace(h, r"^(#+)[ \t]+", "$1 "))), 1, limit)


def rebuild_slides(slides: Column, pages: Column) -> Column:
    """Markdown of the chosen slides."""
    kept = F.filter(slides, lambda s: F.array_contains(pages, s["name"].cast("int")))
    return F.array_join(F.transform(kept, lambda s: F.concat(F.lit("### Slide "), s["name"], F.lit("\n\n"), F.when(s["body"] != "", s["body"]).otherwise("_(no text)_"))), "\n\n")


def section_evidence(sections: Column, kind: str, prefix: str = "") -> Column:
    return F.transform(sections, lambda s: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(prefix), s["name"]).alias("location"), F.when(excerpt(s["body"]) != "", excerpt(s["body"])).otherwise("(no text)").alias("content"), F.lit(None).cast("double").alias("confidence")))


def conversion_summary(label: Column, name: Column, markdown: Column, slides: Column, sheets: Column) -> Column:
    tops = F.transform(outline(markdown, 4), lambda h: F.regexp_replace(h, "^[# ]+", ""))
    parts = F.concat_ws(
        ". ",
        F.concat(label, F.lit(" document `"), name, F.lit("` converted to Markdown")),
        F.when(F.size(slides) > 0, F.concat(F.size(slides).cast("string"), F.lit(" slide(s)"))),
        F.when(F.size(sheets) > 0, F.concat(F.lit("sheets: "), F.array_join(F.transform(sheets, lambda s: s["name"]), ", "))),
        F.when((F.size(tops) > 0) & (F.size(sheets) == 0), F.concat(F.lit("top headings: "), F.array_join(tops, "; "))),
        F.concat(F.format_number(F.length(markdown), 0), F.lit(" characters of Markdown")),
    )
    return F.concat(parts, F.lit("."))
