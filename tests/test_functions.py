import random

import pytest
from pyspark.sql import functions as F

from lodeframe.functions import geometry, intent, provider, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def many(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}").select("k", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.k)]


TEXTS = ["", "\n", "a", "a\n", "a\nb", "\r\nx\r\n", "x\u2028y\x85z\x0b", " \u00a0pad\u3000\x1f", "``` and ````", "`" * 9, "é" * 300, "line\n" * 300, "long " * 400, "\x00\x01\x02 odd \u200b", "tab\tand\nfeed"]


def test_lines_and_strip_are_pythons(spark):
    assert many(spark, TEXTS, text.lines) == [t.splitlines() for t in TEXTS]
    assert many(spark, TEXTS, text.strip) == [t.strip() for t in TEXTS]
    assert many(spark, TEXTS, text.line_count) == [t.count("\n") + bool(t and not t.endswith("\n")) for t in TEXTS]
    assert many(spark, TEXTS, text.printable_ratio) == pytest.approx([sum(c.isprintable() or c in "\n\r\t" for c in t) / len(t) if t else 0 for t in TEXTS])


def test_a_fence_survives_its_text(spark):
    for t, made in zip(TEXTS, many(spark, TEXTS, text.fenced)):
        fence = "```"
        while fence in t:
            fence += "`"
        assert made == f"{fence}text\n{t}\n{fence}"


@pytest.mark.parametrize("limit", [1, 50, 200, 333, 1000])
def test_truncation(spark, limit):
    dice = random.Random(limit)
    texts = TEXTS + ["".join(dice.choices("ab \n", [5, 5, 2, dice.random()], k=dice.randrange(1500))) for _ in range(40)]
    for t, made in zip(texts, many(spark, texts, lambda c: text.truncated(c, F.lit(limit)))):
        if len(t) <= limit:
            assert made.markdown == t and not made.truncated
        else:
            cut = t.rfind("\n", max(0, limit - 200), limit)
            assert made.markdown == t[: limit if cut < 0 else cut].rstrip() + text.CUT_NOTICE
            assert made.original_chars == len(t) and made.returned_chars == len(made.markdown)


@pytest.mark.parametrize("expression,total,pages,error", [(None, 4, [1, 2, 3], None), ("2", 4, [2], None), ("3,1-2,2", 9, [1, 2, 3], None), ("5-9", 9, [5, 6, 7], None), ("", 2, [1, 2], None), ("1", 0, None, "ZERO_PAGES"), ("0", 3, None, "BELOW_ONE"), ("4", 3, None, "OUT_OF_RANGE"), ("3-1", 3, None, "BACKWARDS"), ("x", 3, None, "NOT_A_NUMBER"), ("²", 3, None, "NOT_A_NUMBER"), ("1-", 3, None, "MALFORMED_RANGE"), (",", 3, None, "NOTHING_SELECTED"), ("1-99999999999999999999999", 3, None, "OUT_OF_RANGE")])
def test_page_selection(spark, expression, total, pages, error):
    got = spark.createDataFrame([(expression, total)], "e string, n int").select(text.page_selection(F.col("e"), F.col("n"), 3).alias("s")).first().s
    assert (got.pages, got.error) == (pages, error)


def test_normal_forms(spark):
    assert many(spark, ["  Was\tIST \u00a0 das ", None, ""], text.normalise_question) == ["was ist das", "", ""]
    assert many(spark, [" 1, 3-5 ,,", None, "2"], text.normalise_pages) == ["1,3-5", "", "2"]
    assert one(spark, "x" * 500, text.excerpt) == "x" * 400 + " ..."


def test_intent_and_profile(spark):
    asks = ["Why is it grey?", "Read the exact text", "hello", None, "", "bread", "READ IT", "which big red button is", "misaligned edges"]
    assert many(spark, asks, intent.intent) == ["visual_semantics", "text_extraction", "unknown", "unknown", "unknown", "unknown", "text_extraction", "visual_semantics", "unknown"]
    asks = ["a stack trace", "the flow chart", "bar chart", "csv", "class", "the menu", "hello", None]
    assert many(spark, asks, intent.profile) == ["terminal_or_error", "diagram_or_flowchart", "chart", "table", "code_screenshot", "ui_screenshot", "general", "general"]
    assert many(spark, ["terminal", "ui_grounding", "nonsense"], lambda c: intent.profile(F.lit("hello"), c, F.lit(True))) == ["terminal_or_error", "ui_grounding", "scanned_document"]


def test_tiles_cover_the_image(spark):
    dice = random.Random(4)
    sizes = [(dice.randrange(1, 9000), dice.randrange(1, 16000)) for _ in range(200)] + [(4096, 4096), (100, 16192), (16192, 100), (1, 1)]
    rows = spark.createDataFrame(sizes, "w int, h int").select("w", "h", geometry.payload_plan(F.col("w"), F.col("h"), 4096).alias("p"), geometry.tiles(F.col("w"), F.col("h"), 4096).alias("t"), geometry.scaled(F.col("w"), F.col("h"), 4096).alias("s")).collect()
    for r in rows:
        assert (r.p == "as_is") == (max(r.w, r.h) <= 4096) and (r.p == "tiles") == bool(r.t)
        assert max(r.s.w, r.s.h) <= 4096 and len(r.t) <= 4
        if r.t:
            at = 0
            for t in r.t:
                start, size = (t.y, t.h) if r.h >= r.w else (t.x, t.w)
                assert start <= at and size <= 4096
                at = start + size
            assert at == max(r.w, r.h)
        if r.p == "downscale":
            scale = 4096 / max(r.w, r.h)
            assert (r.s.w, r.s.h) == (max(1, round(r.w * scale)), max(1, round(r.h * scale)))


def test_png_header(spark):
    head = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (860).to_bytes(4, "big") + (300).to_bytes(4, "big")
    assert tuple(one(spark, bytearray(head), geometry.png_size, "binary")) == (860, 300)
    assert one(spark, bytearray(b"GIF89a"), geometry.png_size, "binary") is None


REPLY = "Lead-in.\n\n## ANSWER\nIt is 42.\n\n**DIRECT OBSERVATIONS**\n- a\n- b\n\nEXACT TEXT:\n```\nx\n\ny\n```\n## INFERENCE -- beyond\nfirst\n\nsecond\n"


def test_replies(spark):
    got = one(spark, REPLY, provider.parse_reply)
    assert (got.structured, got.summary, got.answer) == (True, "It is 42.", "It is 42.")
    assert (got.observations, got.exact_text, got.inferences, got.uncertainties) == (["a", "b"], ["```\nx\n\ny\n```"], ["first", "second"], [])
    plain = one(spark, " Just prose.\n\nMore. ", provider.parse_reply)
    assert (plain.structured, plain.summary, plain.answer, plain.raw_text) == (False, "Just prose.", None, "Just prose.\n\nMore.")
    assert one(spark, "", provider.parse_reply).structured is False


def test_completions(spark):
    bodies = ['{"choices":[{"message":{"content":"hi"}}]}', '{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}}]}', '{"choices":[]}', "not json", '{"choices":[{"message":{"content":" "}}]}']
    assert [tuple(x) for x in many(spark, bodies, provider.parse_completion)] == [("hi", None), ("ab", None), (None, "VISION_INVALID_RESPONSE"), (None, "VISION_INVALID_RESPONSE"), (None, "VISION_EMPTY_RESPONSE")]


def test_provider_rules(spark):
    got = many(spark, [401, 429, 503, 408, 418], lambda c: provider.http_error(c, F.lit("slow")), "int")
    assert [tuple(x) for x in got] == [("VISION_AUTHENTICATION_FAILED", False), ("VISION_RATE_LIMITED", False), ("VISION_MODEL_UNAVAILABLE", True), ("VISION_PROVIDER_TIMEOUT", True), ("VISION_PROVIDER_ERROR", False)]
    assert many(spark, ["7", "soon", None], provider.retry_after) == [7, None, None]
    assert "sk-1" not in one(spark, "Authorization: Bearer sk-1 failed", provider.scrub_body)
    assert tuple(one(spark, 5, provider.retry_bounds, "int")) == (2.0, 4.0)
    assert one(spark, bytearray(b"abc"), lambda c: provider.data_url(F.lit("image/png"), c), "binary") == "data:image/png;base64,YWJj"
