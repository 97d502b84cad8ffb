import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeframe.functions.text import mean_confidence
from lodeframe.operators import images
from lodeframe.plans.engine import Engine, requests_for
from lodeframe.settings import Settings
from lodeframe.sources.backends import FakeOcr, FakePdf, FakeVision, TellingVision, within
from lodeframe.sources.files import read_files
from lodeframe.sources.imaging import FakeCodec, fitted
from lodeframe.sources.transport import FakeTransport, HttpTransport, HttpVision, Reply, converse, delay, vision_from

CLOUD = Settings(vision_base_url="https://v/", vision_api_key="hush", vision_model="m", allow_cloud_vision=True)


def png(w, h):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big")


def test_sizes_and_the_gate(spark):
    gif, bmp = b"GIF89a" + (300).to_bytes(2, "little") + (7).to_bytes(2, "little"), b"BM" + bytes(16) + (64).to_bytes(4, "little") + (-48).to_bytes(4, "little", signed=True)
    rows = [(0, png(860, 300)), (1, gif), (2, bmp), (3, b"\xff\xd8\xff jpeg"), (4, png(0, 5)), (5, png(9000, 9000)), (6, b"\x89PNG\r\n\x1a\n"), (7, b""), (8, None)]
    sized = spark.createDataFrame([(k, bytearray(x) if x is not None else None) for k, x in rows], "k int, c binary").withColumn("s", images.image_size(F.col("c")))
    got = {r.k: (tuple(r.s) if r.s else None, r.e) for r in sized.select("k", "s", images.pixel_error(F.col("s"), 40_000_000).alias("e")).collect()}
    assert got == {0: ((860, 300), None), 1: ((300, 7), None), 2: ((64, 48), None), 3: (None, None), 4: ((0, 5), "IMAGE_DECODE_FAILED"), 5: ((9000, 9000), "FILE_TOO_LARGE"), 6: (None, None), 7: (None, None), 8: (None, None)}


def test_encoding_policy():
    assert fitted(FakeCodec(), b"", None, (10, 10), "auto", 100)[0] == "image/png"
    assert fitted(FakeCodec(png=3, jpeg=0.5), b"", None, (10, 10), "auto", 100) == ("image/jpeg", b"jpeg  10x10".ljust(50, b"."))
    mime, data = fitted(FakeCodec(png=3, jpeg=2), b"", None, (100, 100), "auto", 5000)
    assert mime == "image/jpeg" and data.startswith(b"jpeg  48x48") and len(data) <= 5000  # round(100 * sqrt(5000 / 20000) * 0.95)
    assert fitted(FakeCodec(png=3, jpeg=2), b"", None, (100, 100), "png", 5000)[0] == "image/png"
    with pytest.raises(ValueError):
        fitted(FakeCodec(png=50), b"", None, (2, 2), "png", 10)


def ask(spark, folder, engine, rows, **more):
    files = read_files(spark, str(folder), engine.settings.max_file_bytes).withColumn("path", F.col("name"))
    asked = spark.createDataFrame(rows, "path string, question string")
    return {r.request_id: r for r in engine.analyze(requests_for(asked, **more), files, F.lit(datetime(2024, 5, 1))).collect()}


def test_what_needs_a_codec(spark, tmp_path):
    (tmp_path / "fits.png").write_bytes(png(800, 600))
    (tmp_path / "wide.png").write_bytes(png(6000, 4000))
    (tmp_path / "bomb.png").write_bytes(png(60_000, 60_000))
    rows = [(f"{n}.png", "Why?") for n in ("fits", "wide", "bomb")]
    bare = ask(spark, tmp_path, Engine(spark, CLOUD, vision=FakeVision()), rows, mode="vision", pages="2")
    assert {k: r.error and r.error.code for k, r in bare.items()} == {"fits.png": None, "wide.png": "IMAGE_DECODE_FAILED", "bomb.png": "FILE_TOO_LARGE"}
    assert bare["bomb.png"].markdown.startswith("## Error: FILE_TOO_LARGE") and "What to do" in bare["bomb.png"].markdown
    assert [w for w in bare["fits.png"].warnings if "'pages'" in w] and "### Exact text\n\nSave" in bare["fits.png"].markdown
    able = ask(spark, tmp_path, Engine(spark, CLOUD, vision=TellingVision(), codec=FakeCodec()), rows, mode="vision")
    assert able["wide.png"].summary == "png  4096x2731" and "scaled down from 6000x4000" in able["wide.png"].warnings[0]
    # An engine that would be asked about the bomb fails the test: the gate comes first.
    gated = ask(spark, tmp_path, Engine(spark, Settings(), ocr=FakeOcr(fails=True)), rows[2:], mode="ocr")
    assert gated["bomb.png"].error.code == "FILE_TOO_LARGE"


def test_supporting_ocr(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(80, 60))
    lost = ask(spark, tmp_path, Engine(spark, CLOUD, ocr=FakeOcr(fails=True), vision=FakeVision()), [("a.png", "Why?")])["a.png"]
    assert lost.success and "OCR failed (OCR_FAILED)" in lost.warnings[0]
    few = ask(spark, tmp_path, Engine(spark, Settings(ocr_languages="eng+deu"), ocr=FakeOcr(text=" ")), [("a.png", None)])["a.png"]
    assert "deu are not installed; eng was used" in few.markdown and "_(no text recognised)_" in few.markdown and "found no text" in few.markdown


def test_retries_and_delays(spark):
    waits: list = []
    rows = spark.range(1).repartition(1)

    def tell(body):
        state.append(body)
        return Reply(503) if len(state) % 2 else Reply(200, json.dumps({"choices": [{"message": {"content": "fine"}, "finish_reason": "length"}]}))

    state: list = []
    one = converse(rows, HttpVision(FakeTransport(tell), "m", wait=waits.append), F.lit("{}")).first()
    assert (one.reply, one.vision_error, one.served_by, one.attempts) == ("fine", None, "m", 2) and len(one.vision_notes) == 1
    for reply, code, attempts in ((Reply(503), "VISION_MODEL_UNAVAILABLE", 2), (Reply(401), "VISION_AUTHENTICATION_FAILED", 1), (Reply(429, "credit"), "VISION_QUOTA_EXCEEDED", 1), (Reply(None, failure="timeout"), "VISION_PROVIDER_TIMEOUT", 2), (Reply(200, "no json"), "VISION_INVALID_RESPONSE", 1)):
        got = converse(rows, HttpVision(FakeTransport(lambda body, r=reply: r), "m", wait=waits.append), F.lit("{}")).first()
        assert (got.vision_error, got.attempts, got.reply) == (code, attempts, None)
    assert [delay(k, None, 1) for k in (1, 2, 3, 9)] == [1, 2, 4, 4] and delay(1, None, 0) == 0.5 and delay(1, "7", 1) == 7 and delay(1, "x", 1) == 1


def test_the_provider_of_the_settings():
    assert vision_from(Settings()) is None
    made = vision_from(CLOUD)
    assert isinstance(made.transport, HttpTransport) and made.transport.address == "https://v" and made.model == "m" and "hush" not in repr(made)
    assert HttpTransport("http://127.0.0.1:9", "k").post("{}", 0.5).failure == "network"


def test_limits_of_time():
    assert within(None, len, "ab") == within(1, len, "ab") == 2
    with pytest.raises(TimeoutError):
        within(0.05, time.sleep, 1)
    with pytest.raises(TypeError):
        within(1, len, 3)


def test_pages_that_need_eyes(spark, tmp_path):
    (tmp_path / "scan.pdf").write_bytes(b"%PDF-1.7\nthin")
    seen = ask(spark, tmp_path, Engine(spark, CLOUD, ocr=FakeOcr(), vision=FakeVision(), pdf=FakePdf()), [("scan.pdf", "Why?")])["scan.pdf"]
    assert "### Page 1 (visual analysis)\n\n### Answer\n\nA settings screen." in seen.markdown and [(e.type, e.location, e.content) for e in seen.evidence] == [("visual", "page 1", "Save")]
    down = ask(spark, tmp_path, Engine(spark, CLOUD, vision=FakeVision(error="down"), pdf=FakePdf(), cache_path=f"{tmp_path}/cache"), [("scan.pdf", "Why?")])["scan.pdf"]
    assert down.error.code == "VISION_PROVIDER_ERROR" and spark.read.parquet(f"{tmp_path}/cache").count() == 0


def test_the_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a secret line\n")
    ask(spark, tmp_path / "in", Engine(spark, log_path=f"{tmp_path}/log"), [("a.txt", None), ("b.txt", None)])
    lines = {x["request_id"]: x for x in (json.loads(r.value) for r in spark.read.text(f"{tmp_path}/log").collect())}
    assert lines["a.txt"]["event"] == "request answered" and lines["a.txt"]["fields"]["processor"] == "text" and int(lines["a.txt"]["fields"]["duration_ms"]) > 0
    assert lines["b.txt"]["fields"]["error"] == "FILE_NOT_FOUND" and "secret" not in str(lines)


def test_arguments_and_settings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert ask(spark, tmp_path, Engine(spark), [("a.txt", None)], vision_profile="table")["a.txt"].error.code == "INVALID_ARGUMENT"
    (tmp_path / "f").write_text("")
    said = {(p["field"], p["fatal"]): p["message"] for p in Settings(allowed_roots=(str(tmp_path / "none"),), max_output_chars=100, vision_model="m", vision_base_url="https://v").problems()}
    assert "does not exist" in said["allowed_roots", False] and ("max_output_chars", False) in said and "vision_api_key" in said["vision_model", False]
    assert any("not a folder" in p["message"] for p in Settings(allowed_roots=(str(tmp_path / "f"),)).problems())
    shut = Settings(allowed_roots=("/",), vision_base_url="https://v", vision_api_key="k", vision_model="m").problems()
    assert [(p["field"], p["fatal"]) for p in shut] == [("allow_cloud_vision", False)]


def test_mean_confidence(spark):
    rows = spark.createDataFrame([([90.0, -1.0, 80.0],), ([-1.0],), ([],), (None,)], "c array<double>")
    assert [r.m for r in rows.select(mean_confidence(F.col("c")).alias("m")).collect()] == [0.85, None, None, None]
