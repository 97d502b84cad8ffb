"""Column functions over texts. All of them are native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends and separates words, and what ends a line. Fixed values.
BLANK = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Printable: letters, marks, numbers, punctuation, symbols, the space and three controls.
UNPRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \n\r\t]"
#: What a cut text ends with, and how far back a line's end is looked for. Fixed values of the output format.
CUT_NOTICE = "\n\n---\n**[Output truncated -- see the `truncation` field.]**"
CUT_WINDOW = 200
#: Fence language by extension. Fixed values of the output format.
FENCE_LANGUAGE = {".json": "json", ".log": "text", ".txt": "text", ".rst": "rst", ".tsv": "text"}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's included (Spark's trim only knows the space)."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){BLANK}+\z", "")


def occurrences(text: Column, part: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def line_count(text: Column) -> Column:
    """Line feeds, and one more for a last line that has none."""
    return (occurrences(text, "\n") + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def lines(text: Column) -> Column:
    """The lines without their ends; a text that ends with one has no empty last line."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(bind(F.split(text, LINE_END), cut))


def first_lines(text: Column, count: int) -> Column:
    """The first lines, and how many more there are."""

    def head(every: Column) -> Column:
        more = F.concat(F.lit("... ("), (F.size(every) - count).cast("string"), F.lit(" more lines)"))
        return F.array_join(F.when(F.size(every) > count, F.concat(F.slice(every, 1, count), F.array(more))).otherwise(every), "\n")

    return bind(lines(text), head)


def fence_length(text: Column) -> Column:
    """Three backticks, or one more than the longest run in the text."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    return F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def fenced(text: Column, language: Column | str = "text") -> Column:
    language = F.lit(language) if isinstance(language, str) else language
    return bind(F.repeat(F.lit("`"), fence_length(text)), lambda fence: F.concat(fence, language, F.lit("\n"), text, F.lit("\n"), fence))


def text_content(text: Column, extension: Column) -> Column:
    """Markdown as it is, anything else fenced in its language."""
    language = F.lit("text")
    for ext, name in FENCE_LANGUAGE.items():
        language = F.when(extension == ext, name).otherwise(language)
    return F.when(extension.isin(".md", ".markdown"), text).otherwise(fenced(text, language))


def text_summary(name: Column, text: Column, encoding: Column | str = "utf-8-sig") -> Column:
    encoding = F.lit(encoding) if isinstance(encoding, str) else encoding
    counted = bind(line_count(text), lambda n: F.concat(n.cast("string"), F.when(n == 1, " line, ").otherwise(" lines, ")))
    return F.concat(F.lit("Plain-text file `"), name, F.lit("` ("), counted, F.format_number(F.length(text), 0), F.lit(" characters, "), encoding, F.lit(")."))


def line_location(text: Column) -> Column:
    n = line_count(text)
    return F.when(n > 0, F.concat(F.lit("lines 1-"), n.cast("string"))).otherwise("empty file")


def printable_ratio(text: Column) -> Column:
    """The share of printable characters; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(F.regexp_replace(text, UNPRINTABLE, "")) / F.length(text))


def needs_fallback(chars: Column, ratio: Column, least_chars: int = 120, least_ratio: float = 0.60) -> Column:
    """A page whose text layer is too thin or too odd."""
    return (chars < least_chars) | (ratio < least_ratio)


def ocr_good_enough(chars: Column, confidence: Column) -> Column:
    return (chars >= 40) & (confidence.isNull() | (confidence >= 0.65))


def mean_confidence(words: Column) -> Column:
    """The mean of an array of word confidences (0 to 100, below 0: no word) as a share; null if no word has one."""
    sure = F.filter(words, lambda c: c >= 0)
    return F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.size(sure) / 100)


def excerpt(text: Column, limit: int = 400) -> Column:
    clean = strip(text)
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(rstrip(F.substring(clean, 1, limit)), F.lit(" ...")))


def cut_length(text: Column, limit: Column) -> Column:
    """Where a text over ``limit`` is cut: at the last line feed of the window before the limit, else at the limit."""
    start = F.greatest(limit - CUT_WINDOW, F.lit(0))
    window = F.reverse(F.substring(text, (start + 1).cast("int"), (limit - start).cast("int")))
    back = F.instr(window, "\n")
    return F.when(back > 0, limit - back).otherwise(limit)


def truncated(text: Column, limit: Column) -> Column:
    """struct<markdown, truncated, original_chars, returned_chars>."""
    short = F.length(text) <= limit
    cut = F.concat(rstrip(F.substring(text, F.lit(1), cut_length(text, limit).cast("int"))), F.lit(CUT_NOTICE))
    markdown = F.when(short, text).otherwise(cut)
    return F.struct(markdown.alias("markdown"), (~short).alias("truncated"), F.length(text).cast("long").alias("original_chars"), F.length(markdown).cast("long").alias("returned_chars"))


def ordered_union(*arrays: Column) -> Column:
    """Distinct entries in the order of their first occurrence."""
    return F.array_distinct(F.concat(*arrays))


def normalise_question(question: Column) -> Column:
    """Lower case, white space collapsed. Composition is ``sources.convert.compose``'s, for the rows that need it."""
    return F.coalesce(strip(F.regexp_replace(F.lower(question), rf"(?U){BLANK}+", " ")), F.lit(""))


def normalise_pages(pages: Column) -> Column:
    parts = F.filter(F.transform(F.split(pages, ","), strip), lambda p: p != "")
    return F.coalesce(F.array_join(parts, ","), F.lit(""))


def page_selection(expression: Column, total: Column, most: int) -> Column:
    """struct<pages array<int>, error string, asked int>: 1-based pages of '1-3,8', sorted, the first ``most`` of them, and how many there were.

    Bounds are checked before any range is made, so a huge range costs nothing.
    """
    far = F.lit(2**31)
    number = lambda c: F.least(F.coalesce(F.expr("null").cast("long"), F.try_to_number(c, F.lit("9" * 18)).cast("long"), far), far)
    tokens = F.filter(F.transform(F.split(expression, ","), strip), lambda t: t != "")

    def parse(token: Column) -> Column:
        low = number(F.regexp_extract(token, r"^([0-9]+)", 1))
        high = number(F.regexp_extract(token, r"([0-9]+)$", 1))
        ranged = token.contains("-")
        bad = F.when(ranged & ~token.rlike(r"(?U)^[0-9]+\s*-\s*[0-9]+$"), "MALFORMED_RANGE").when(~ranged & ~token.rlike("^[0-9]+$"), "NOT_A_NUMBER")
        return F.when(bad.isNotNull(), F.struct(far.alias("low"), far.alias("high"), bad.alias("error"))).otherwise(F.struct(low.alias("low"), high.alias("high"), F.when(low > high, "BACKWARDS").alias("error")))

    ranges = F.transform(tokens, parse)
    first_error = F.get(F.filter(F.transform(ranges, lambda r: r["error"]), lambda e: e.isNotNull()), 0)
    every = F.slice(F.sequence(F.lit(1), F.greatest(F.least(total, F.lit(most)), F.lit(1))), 1, most)
    inside = lambda r: F.sequence(F.greatest(r["low"], F.lit(1)).cast("int"), F.greatest(F.least(r["high"], total), F.greatest(r["low"], F.lit(1)), F.lit(1)).cast("int"))
    blank = expression.isNull() | (strip(expression) == "")
    error = (
        F.when(total <= 0, "ZERO_PAGES")
        .when(blank, F.lit(None).cast("string"))
        .when(first_error.isNotNull(), first_error)
        .when(F.size(tokens) == 0, "NOTHING_SELECTED")
        .when(F.array_min(F.transform(ranges, lambda r: r["low"])) < 1, "BELOW_ONE")
        .when(F.array_max(F.transform(ranges, lambda r: r["high"])) > total, "OUT_OF_RANGE")
    )
    named = F.array_distinct(F.flatten(F.transform(ranges, inside)))
    chosen = F.slice(F.array_sort(named), 1, most)
    pages = F.when(error.isNotNull(), F.lit(None).cast("array<int>")).when(blank, every).otherwise(chosen)
    asked = F.when(error.isNotNull(), F.lit(None).cast("int")).when(blank, total.cast("int")).otherwise(F.size(named))
    return F.struct(pages.alias("pages"), error.alias("error"), asked.alias("asked"))
