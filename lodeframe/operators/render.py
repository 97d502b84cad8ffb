"""From what a processor found to the bounded Markdown answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_union, strip, truncated

EVIDENCE = "array<struct<type:string,location:string,content:string,confidence:double>>"
#: Evidence items and characters by detail, and characters of content where there is nothing else. Fixed values.
COMPACT_ITEMS, COMPACT_CHARS, NORMAL_CHARS, COMPACT_CONTENT = 3, 400, 800, 1500
NO_ANSWER = "_No direct answer was produced; consult the extracted content and evidence below._"


def _clip(evidence: Column, chars: int) -> Column:
    return F.transform(evidence, lambda e: e.withField("content", F.substring(e["content"], 1, chars)))


def shaped_evidence(evidence: Column, detail: Column) -> Column:
    return F.when(detail == "full", evidence).when(detail == "compact", _clip(F.slice(evidence, 1, COMPACT_ITEMS), COMPACT_CHARS)).otherwise(_clip(evidence, NORMAL_CHARS))


def shaped_content(content: Column, summary: Column, answer: Column, detail: Column) -> Column:
    """Compact: the answer, else the summary, else the head of the content."""
    short = F.coalesce(F.when(answer != "", answer), F.when(summary != "", summary), F.substring(content, 1, COMPACT_CONTENT))
    return F.when(detail == "compact", short).otherwise(content)


def evidence_line(item: Column) -> Column:
    body = strip(item["content"])
    where = F.when(F.coalesce(item["location"], F.lit("")) != "", F.concat(F.lit(" ("), item["location"], F.lit(")"))).otherwise("")
    sure = F.when(item["confidence"].isNotNull(), F.format_string(" [confidence %.0f%%]", F.bround(item["confidence"] * 100, 0))).otherwise("")
    return F.concat(F.lit("- **"), item["type"], F.lit("**"), where, sure, F.when(body.contains("\n"), F.lit(":\n\n  ")).otherwise(": "), body)


def render(summary: Column, answer: Column, content: Column, evidence: Column, warnings: Column, question: Column) -> Column:
    """The Markdown body; sections without content are left out."""
    asked = F.coalesce(question, F.lit("")) != ""
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("## Summary\n\n"), summary),
        F.when(asked, F.concat(F.lit("## Answer to the requested question\n\n"), F.coalesce(F.when(answer != "", answer), F.lit(NO_ANSWER)))),
        F.when(strip(content) != "", F.concat(F.lit("## Extracted content\n\n"), content)),
        F.when(F.size(evidence) > 0, F.concat(F.lit("## Evidence\n\n"), F.array_join(F.transform(evidence, evidence_line), "\n"))),
        F.when(F.size(warnings) > 0, F.concat(F.lit("## Warnings\n\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n"))),
    )


def assemble(results: DataFrame) -> DataFrame:
    """Adds markdown, truncation, and the shaped evidence and warnings to processed rows.

    ``results`` has summary, answer, content_markdown, evidence, warnings,
    extra_warnings, question, detail and max_chars.
    """
    warnings = ordered_union(F.col("extra_warnings"), F.col("warnings"))
    staged = results.withColumns({"warnings": warnings, "__shown": shaped_evidence(F.col("evidence"), F.col("detail")), "__content": shaped_content(F.col("content_markdown"), F.col("summary"), F.col("answer"), F.col("detail"))})
    body = render(F.col("summary"), F.col("answer"), F.col("__content"), F.col("__shown"), F.col("warnings"), F.col("question"))
    # One step for each value that the next uses more than once: copied expressions multiply.
    cut = staged.withColumn("__body", body).withColumn("__cut", truncated(F.col("__body"), F.col("max_chars")))
    note = F.array(F.lit("Output was truncated; see the truncation field."))
    hint = F.lit("Ask for fewer pages, ask a narrower question, or raise max_chars.")
    truncation = F.when(F.col("__cut.truncated"), F.struct(F.lit(True).alias("truncated"), F.col("__cut.original_chars").alias("original_chars"), F.col("__cut.returned_chars").alias("returned_chars"), hint.alias("recovery_hint")))
    out = cut.withColumns({"markdown": F.col("__cut.markdown"), "truncation": truncation, "evidence": F.col("__shown"), "warnings": F.when(F.col("__cut.truncated"), F.concat("warnings", note)).otherwise(F.col("warnings"))})
    return out.drop("__shown", "__content", "__body", "__cut", "extra_warnings")
