"""Which processor takes a request. Decisions are expressions over mode, category, intent and three capabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("auto", "document", "ocr", "vision")
STRATEGIES = ("hybrid", "ocr_first", "vision_first")
#: What a request may name as its vision profile. Fixed values.
VISION_PROFILES = ("auto", "general", "ui_structure", "ui_alignment", "ui_grounding", "terminal", "chart", "diagram", "scanned_document")
CONVERTED = ("office", "html", "data", "email", "ebook", "notebook")
ROUTE = "struct<processor:string,plan:string,warned:boolean,error:string>"


def route(mode: Column, category: Column, ocr: Column, configured: Column, allowed: Column, strategy: Column, intent: Column) -> Column:
    """struct<processor, plan, warned, error>; exactly one of processor and error is set.

    ``warned``: the question needs eyes and only OCR is there.
    """
    usable = configured & allowed
    none = F.lit(None).cast("string")

    def to(processor: str, plan: Column | str, warned: Column | None = None) -> Column:
        plan = F.lit(plan) if isinstance(plan, str) else plan
        return F.struct(F.lit(processor).alias("processor"), plan.alias("plan"), (F.lit(False) if warned is None else warned).alias("warned"), none.alias("error"))

    def fail(code: Column | str) -> Column:
        code = F.lit(code) if isinstance(code, str) else code
        return F.struct(none.alias("processor"), none.alias("plan"), F.lit(False).alias("warned"), code.alias("error"))

    blind = fail(F.when(~configured, "VISION_NOT_CONFIGURED").otherwise("CLOUD_VISION_DISABLED"))
    never = fail("MODE_NOT_APPLICABLE")
    document = F.when(category == "text", to("text", "text")).when(category.isin(*CONVERTED), to("convert", "convert")).otherwise(never)
    by_ocr = F.when(usable, to("image", "hybrid")).otherwise(to("image", "ocr_only", intent == "visual_semantics"))
    image = (
        F.when(~ocr & ~usable, blind)
        .when((strategy == "ocr_first") | ~usable, F.when(ocr, by_ocr).otherwise(to("image", "vision")))
        .when(strategy == "vision_first", to("image", "vision"))
        .otherwise(to("image", "hybrid"))
    )
    is_image, is_pdf = category == "image", category == "pdf"
    return (
        F.when(mode == "document", F.when(is_image, never).when(is_pdf, to("pdf", "text")).otherwise(document))
        .when(mode == "ocr", F.when(~(is_image | is_pdf), never).when(~ocr, fail("OCR_NOT_CONFIGURED")).when(is_image, to("image", "ocr_only")).otherwise(to("pdf", "ocr")))
        .when(mode == "vision", F.when(~usable, blind).when(is_image, to("image", "vision")).when(is_pdf, to("pdf", "vision")).otherwise(never))
        .when(mode == "auto", F.when(is_image, image).when(is_pdf, to("pdf", "auto")).otherwise(document))
        .otherwise(fail("INVALID_ARGUMENT"))
    )


def resolution(plan: Column, ocr_ran: Column, usable: Column, intent: Column, good: Column) -> Column:
    """What an image with a plan gets: ocr, ocr_local, ocr_degraded, vision or error."""
    return (
        F.when(plan == "ocr_only", F.when(ocr_ran, "ocr").otherwise("error"))
        .when((plan != "vision") & ocr_ran & (intent == "text_extraction") & good, "ocr_local")
        .when(usable, "vision")
        .when(ocr_ran, "ocr_degraded")
        .otherwise("error")
    )


def weak_page_backend(plan: Column, ocr: Column, usable: Column, intent: Column) -> Column:
    """vision, ocr or neither for a page without a good text layer."""
    by_vision = (plan == "vision") | ((plan != "ocr") & usable & (~ocr | (intent == "visual_semantics")))
    return F.when(by_vision, "vision").when(ocr, "ocr").otherwise("neither")


def argument_error(mode: Column, detail: Column, vision_profile: Column) -> Column:
    """INVALID_ARGUMENT unless all three are among the known names; null is none of them."""
    known = mode.isin(*MODES) & detail.isin("compact", "normal", "full") & vision_profile.isin(*VISION_PROFILES)
    return F.when(~F.coalesce(known, F.lit(False)), "INVALID_ARGUMENT")


def budget(max_chars: Column, cap: int) -> Column:
    """The asked number of characters if it is positive, and never more than the cap."""
    return F.least(F.when(max_chars > 0, max_chars).otherwise(cap), F.lit(cap))
