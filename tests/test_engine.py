import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodeframe.plans.engine import Engine, requests_for
from lodeframe.settings import Settings
from lodeframe.sources import convert
from lodeframe.sources.backends import FakeOcr, FakePdf, FakeVision, installed_languages
from lodeframe.sources.files import file_listing, oversized, read_files
from lodeframe.streaming.windows import first_sightings, hot_folder, run_to_table

W = 'xmlns:w="w" xmlns:r="http://r" xmlns:a="a"'


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


def office():
    rel = lambda *targets: "<R>" + "".join(f'<x Id="r{k}" Target="{t}"/>' for k, t in enumerate(targets, 1)) + "</R>"
    docx = packed(word__document_xml=f'<d {W}><body><p><pPr><pStyle w:val="Heading1"/></pPr><r><t>Release Checklist</t></r></p><p><pPr><pStyle w:val="ListBullet"/></pPr><t>Ship it</t></p><tbl><tr><tc><t>Item</t></tc><tc><t>Owner</t></tc></tr><tr><tc><t>Export|crash</t></tc><tc><t>Mai</t></tc></tr></tbl></body></d>')
    slide = lambda *lines: f"<s {W}>" + "".join(f"<a:p><a:t>{x}</a:t></a:p>" for x in lines) + "</s>"
    pptx = packed(**{"ppt/presentation.xml": f'<p {W}><sldId r:id="r1"/><sldId r:id="r2"/></p>', "ppt/_rels/presentation.xml.rels": rel("slides/s1.xml", "slides/s2.xml"), "ppt/slides/s1.xml": slide("Quarterly Review", "up"), "ppt/slides/s2.xml": slide("Architecture")})
    xlsx = packed(**{"xl/workbook.xml": f'<w {W}><sheet name="Incidents" r:id="r1"/><sheet name="Budget" r:id="r2"/></w>', "xl/_rels/workbook.xml.rels": rel("a.xml", "b.xml"), "xl/sharedStrings.xml": "<s><si><t>Date</t></si><si><t>report-export</t></si></s>", "xl/a.xml": '<s><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c></row></s>', "xl/b.xml": '<s><row><c t="inlineStr"><is><t>Cost</t></is></c></row></s>'})
    epub = packed(**{"mimetype": "application/epub+zip", "META-INF/container.xml": '<c><rootfile full-path="O/p.opf"/></c>', "O/p.opf": '<p><item id="b" href="b.html"/><item id="a" href="a.html"/><itemref idref="a"/><itemref idref="b"/></p>', "O/a.html": "<h1>First</h1>", "O/b.html": "<p>Second</p>"})
    return docx, pptx, xlsx, epub


PDF = b"%PDF-1.7\n" + b"\f".join([b"Deployment needs Node.js 20 and TLS. " * 6, b"thin", b"Rollback Procedure, step by step. " * 6])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    docx, pptx, xlsx, epub = office()
    files = {"notes.txt": b"one\ntwo\n", "copy.txt": b"one\ntwo\n", "read.md": b"# Title\n", "metrics.csv": b"date,n\n2024,1|2\n", "page.html": b"<title>T</title><body><h1>Hi</h1><p>a <a href='/x'>link</a></p><ul><li>i</li></ul>", "legacy.txt": b"caf\xe9", "book.ipynb": json.dumps({"cells": [{"cell_type": "markdown", "source": ["# N"]}, {"cell_type": "code", "source": "x = 1"}]}).encode(), "doc.docx": docx, "deck.pptx": pptx, "sheet.xlsx": xlsx, "ebook.epub": epub, "bundle.zip": packed(a="x"), "real.txt": PDF, "report.pdf": PDF, "bad.docx": b"PK\x03\x04broken", "shot.png": b"\x89PNG\r\n\x1a\n....", "song.mp3": b"ID3", "empty.txt": b"", "big.log": b"x" * 5000}
    for name, data in files.items():
        (top / name).write_bytes(data)
    return top


def answers(engine, spark, folder, rows, **defaults):
    files = read_files(spark, str(folder), engine.settings.max_file_bytes).withColumn("path", F.col("name"))
    kind = ", ".join(f"{k} string" for k in ("path", *rows[0][1]))
    asked = spark.createDataFrame([(p, *o.values()) for p, o in rows], kind).withColumn("request_id", F.concat_ws("#", "path", *rows[0][1]))
    return {r.request_id: r for r in engine.analyze(requests_for(asked, **defaults), files, F.lit(datetime(2024, 5, 1))).collect()}


def test_every_format(spark, folder):
    got = answers(Engine(spark, pdf=FakePdf()), spark, folder, [(p.name, {}) for p in folder.iterdir()] + [("missing.txt", {})])
    code = {k: r.error.code if r.error else None for k, r in got.items()}
    assert {k: c for k, c in code.items() if c} == {"missing.txt": "FILE_NOT_FOUND", "bundle.zip": "UNSUPPORTED_MEDIA_TYPE", "bad.docx": "UNSUPPORTED_MEDIA_TYPE", "song.mp3": "UNSUPPORTED_MEDIA_TYPE", "shot.png": "VISION_NOT_CONFIGURED"}
    has = lambda name, *facts: all(f in got[name].markdown for f in facts)
    assert has("notes.txt", "`notes.txt` (2 lines, 8 characters", "```text\none\ntwo\n\n```") and has("copy.txt", "`copy.txt`")
    assert has("read.md", "# Title") and "```" not in got["read.md"].markdown and has("metrics.csv", "| 2024 | 1\\|2 |")
    assert has("page.html", "# Hi", "[link](/x)", "- i") and has("legacy.txt", "café", "not valid UTF-8") and has("book.ipynb", "```python\nx = 1")
    assert has("doc.docx", "# Release Checklist", "- Ship it", "| Export\\|crash | Mai |") and has("ebook.epub", "# First", "Second")
    assert has("deck.pptx", "### Slide 1", "Architecture", "2 slide(s)") and has("sheet.xlsx", "sheets: Incidents, Budget", "| Date |  | report-export |")
    assert has("real.txt", "### Page 1", "Node.js 20") and got["real.txt"].source.category == "pdf"
    assert [e.location for e in got["report.pdf"].evidence] == ["page 1", "page 3", "page 2"] and "no OCR or vision" in got["report.pdf"].markdown
    assert has("empty.txt", "empty file", "0 lines")


def test_pages_and_modes(spark, folder):
    rows = [("deck.pptx", {"pages": "1", "mode": "auto"}), ("deck.pptx", {"pages": "9", "mode": "auto"}), ("report.pdf", {"pages": "3", "mode": "document"}), ("report.pdf", {"pages": "0", "mode": "auto"}), ("notes.txt", {"pages": "1", "mode": "auto"}), ("notes.txt", {"pages": None, "mode": "vision"}), ("notes.txt", {"pages": None, "mode": "ocr"}), ("notes.txt", {"pages": None, "mode": "other"})]
    got = answers(Engine(spark, pdf=FakePdf()), spark, folder, rows)
    assert "Architecture" not in got["deck.pptx#1#auto"].markdown and got["deck.pptx#9#auto"].error.code == "INVALID_PAGE_SELECTION"
    assert "Rollback" in got["report.pdf#3#document"].markdown and "Node.js" not in got["report.pdf#3#document"].markdown
    assert got["report.pdf#0#auto"].error.code == "INVALID_PAGE_SELECTION" and "does not apply to plain-text" in got["notes.txt#1#auto"].markdown
    assert [got[f"notes.txt#{m}"].error.code for m in ("vision", "ocr", "other")] == ["VISION_NOT_CONFIGURED", "MODE_NOT_APPLICABLE", "INVALID_ARGUMENT"]


def test_a_cut_at_max_pages_is_said(spark, tmp_path):
    slides = range(1, 34)
    members = {"ppt/presentation.xml": f"<p {W}>" + "".join(f'<sldId r:id="r{k}"/>' for k in slides) + "</p>", "ppt/_rels/presentation.xml.rels": "<R>" + "".join(f'<x Id="r{k}" Target="slides/s{k}.xml"/>' for k in slides) + "</R>"}
    members |= {f"ppt/slides/s{k}.xml": f"<s {W}><a:p><a:t>Topic {k}.</a:t></a:p></s>" for k in slides}
    (tmp_path / "long.pptx").write_bytes(packed(**members))
    (tmp_path / "long.pdf").write_bytes(b"%PDF-1.7\n" + b"\f".join(b"Page %d says quite a lot. " % k * 8 for k in slides))
    got = answers(Engine(spark, pdf=FakePdf()), spark, tmp_path, [(f, {"pages": p}) for f in ("long.pptx", "long.pdf") for p in (None, "2-32", "2-31", "33")])
    said = lambda name: [w for w in got[name].warnings if "only the first" in w]
    for f, thing in (("long.pptx", "slide"), ("long.pdf", "page")):
        assert all(got[k].success for k in got if k.startswith(f))
        assert [f"has 33 {thing}s; only the first 30" in w for w in said(f)] == [True]
        assert [f"selects 31 {thing}s; only the first 30" in w for w in said(f"{f}#2-32")] == [True]
        assert said(f"{f}#2-31") == said(f"{f}#33") == []


CLOUD = dict(vision_base_url="https://v/", vision_api_key="k", vision_model="m")


def test_the_cloud_gate_and_ocr(spark, folder):
    ask = [("shot.png", {"question": "Read the exact text"}), ("shot.png", {"question": "Why is the button disabled?"}), ("report.pdf", {"question": "hello"})]
    shut = answers(Engine(spark, Settings(**CLOUD), ocr=FakeOcr(), vision=FakeVision(error="must not be called"), pdf=FakePdf()), spark, folder, ask)
    assert all(r.success and "told" not in r.markdown for r in shut.values())
    assert "transcription" in shut["shot.png#Why is the button disabled?"].markdown and "recognised text" in shut["report.pdf#hello"].markdown
    wide = answers(Engine(spark, Settings(**CLOUD, allow_cloud_vision=True), ocr=FakeOcr(), vision=FakeVision(), pdf=FakePdf()), spark, folder, ask)
    assert wide["shot.png#Read the exact text"].processing.model is None and "recognised text" in wide["shot.png#Read the exact text"].markdown
    seen = wide["shot.png#Why is the button disabled?"]
    assert seen.processing.model == "fake-vision" and seen.summary == "A settings screen." and {e.type for e in seen.evidence} == {"ocr", "visual"}
    bad = answers(Engine(spark, Settings(**CLOUD, allow_cloud_vision=True), ocr=FakeOcr(fails=True), vision=FakeVision(error="down")), spark, folder, ask[1:2])
    assert bad["shot.png#Why is the button disabled?"].error.code == "VISION_PROVIDER_ERROR"
    assert installed_languages("eng+xxx", ["eng", "vie"]) == ("eng", ["xxx"]) and installed_languages("deu", ["vie"]) == ("vie", ["deu"])


def test_the_cache(spark, folder, tmp_path):
    engine = Engine(spark, cache_path=f"{tmp_path}/cache")
    rows = [("notes.txt", {"question": "what?"}), ("copy.txt", {"question": " WHAT? "}), ("metrics.csv", {"question": None})]
    first, second = answers(engine, spark, folder, rows), answers(engine, spark, folder, rows)
    assert not any(r.processing.cached for r in first.values()) and all(r.processing.cached for r in second.values())
    assert {k: r.markdown for k, r in first.items()} == {k: r.markdown for k, r in second.items()}
    assert first["notes.txt#what?"].cache_key == first["copy.txt# WHAT? "].cache_key and spark.read.parquet(f"{tmp_path}/cache").count() == 2
    again = answers(engine, spark, folder, rows[:1], force_refresh=True)
    assert not again["notes.txt#what?"].processing.cached


def test_scans(spark, folder):
    assert oversized(spark, str(folder), 4096).select("name").first().name == "big.log"
    plan = file_listing(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert read_files(spark, str(folder), 4096).where("name = 'big.log'").isEmpty()


def test_composition_and_decoding(spark):
    rows = spark.createDataFrame([("e\u0301",), ("plain",), (None,)], "q string")
    assert sorted((r.q or "") for r in convert.compose(rows, "q").collect()) == ["", "plain", "é"]
    raw = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfx"),), (bytearray(b"caf\xe9 \x93"),), (bytearray(b"\x81"),)], "content binary")
    assert sorted((r.text, r.encoding) for r in convert.decode_texts(raw).collect()) == sorted([("x", "utf-8-sig"), ("café “", "cp1252"), ("\x81", "latin-1")])
    bomb = packed(**{"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><d>&a;</d>'})
    with pytest.raises(ValueError):
        convert.docx_markdown(bomb)


def test_settings():
    assert {p["field"] for p in Settings().problems()} == {"allowed_roots"}
    bad = Settings(allowed_roots=("rel",), vision_max_dimension=96, vision_base_url="ftp://x", auto_image_strategy="x")
    assert {"allowed_roots", "vision_max_dimension", "vision_base_url", "auto_image_strategy", "vision_model"} == {p["field"] for p in bad.problems()}
    assert Settings.roots_from('["/a", " /b "]') == Settings.roots_from("/a:/b") == ("/a", "/b")
    assert Settings(vision_api_key="k").redacted()["vision_api_key"] != "k" and Settings(ocr_languages=" eng + +vie ").languages == "eng+vie"


def test_hot_folder(spark, folder, tmp_path):
    got = run_to_table(first_sightings(hot_folder(spark, str(folder), "*.txt")).select("path", "sha256"), "sightings", f"{tmp_path}/c", "append")
    names = [r.path.rsplit("/", 1)[1] for r in got.collect()]
    assert len({"notes.txt", "copy.txt"} & set(names)) == 1 and "legacy.txt" in names
