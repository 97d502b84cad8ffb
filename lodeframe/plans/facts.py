"""Do answers hold the facts that they should? Cases are rows, and so are their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missed_facts(markdown: Column, facts: Column) -> Column:
    """The facts that a text does not contain, whatever their case."""
    return F.filter(facts, lambda f: ~F.contains(F.lower(markdown), F.lower(f)))


def verdicts(cases: DataFrame, answers: DataFrame, *, ocr: bool, vision: bool) -> DataFrame:
    """request_id, verdict (PASS, FAIL or SKIP) and missed for each case.

    ``cases`` has request_id, must_contain, needs_ocr and needs_vision; a case
    whose need isn't met is skipped.
    """
    held = cases.join(answers.select("request_id", "markdown", "success"), "request_id", "left")
    missed = missed_facts(F.coalesce("markdown", F.lit("")), F.col("must_contain"))
    skip = (F.col("needs_ocr") & F.lit(not ocr)) | (F.col("needs_vision") & F.lit(not vision))
    good = F.coalesce("success", F.lit(False)) & (F.size(missed) == 0)
    return held.select("request_id", F.when(skip, "SKIP").when(good, "PASS").otherwise("FAIL").alias("verdict"), missed.alias("missed"))
