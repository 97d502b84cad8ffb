import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import cache, detect, render, route, sandbox, sections
from lodeframe.settings import Settings

NOW = datetime(2024, 5, 1)


def test_bytes_win_where_they_contradict(spark):
    rows = [(".txt", "255044462D31", "application/pdf", "pdf"), (".png", "504B0304", "application/zip", "archive"), (".xls", "D0CF11E0A1B11AE1", "application/vnd.ms-excel", "office"), (".msg", "D0CF11E0A1B11AE1", "application/vnd.ms-outlook", "email"), (".doc", "D0CF11E0A1B11AE1", "application/x-ole-storage", "unknown"), (".py", "696D706F7274", "text/x-python", "text"), (".zzz", "00", "application/octet-stream", "unknown"), (".jpg", "5249464611223344574542505650", "image/jpeg", "image"), ("", "474946383961", "image/gif", "image"), (".md", "2320", "text/markdown", "text")]
    files = spark.createDataFrame([(e, h) for e, h, _, _ in rows], "extension string, head string")
    got = {(r.extension, r.head): (r.mime_type, r.category) for r in detect.detect(files, F.col("head")).collect()}
    assert got == {(e, h): (m, c) for e, h, m, c in rows}


def test_containers(spark):
    members = [["mimetype", "x"], ["[Content_Types].xml", "word/document.xml"], ["ppt/a"], ["xl/a"], ["a.txt"], [], None]
    rows = spark.createDataFrame([(k, m) for k, m in enumerate(members)], "k int, m array<string>").select("k", detect.sniff(F.lit("504B0304"), F.col("m")).alias("s")).collect()
    assert [r.s.kind for r in sorted(rows, key=lambda r: r.k)] == ["epub", "ooxml", "ooxml", "ooxml", "zip", "zip", "zip"]


def test_sandbox(spark, tmp_path):
    root, other = tmp_path / "ws", tmp_path / "ws-evil"
    root.mkdir(), other.mkdir()
    (root / "a.txt").write_text("a")
    (other / "b.txt").write_text("b")
    (root / "link").symlink_to(other / "b.txt")
    paths = {"a.txt": None, str(root / "a.txt"): None, f"{other}/b.txt": "PATH_NOT_ALLOWED", "link": "PATH_NOT_ALLOWED", "../ws-evil/b.txt": "PATH_NOT_ALLOWED", "../nowhere": "PATH_NOT_ALLOWED", "no.txt": "FILE_NOT_FOUND", ".": "NOT_A_REGULAR_FILE", "http://a/b": "INVALID_ARGUMENT", "": "INVALID_ARGUMENT", "a\x00b": "INVALID_ARGUMENT", "\\\\srv\\x": "PATH_NOT_ALLOWED", "D:\\x": "PATH_NOT_ALLOWED"}
    got = sandbox.resolve_local(spark.createDataFrame([(p,) for p in paths], "path string"), (str(root),)).collect()
    assert {r.path: r.path_error for r in got} == paths
    assert all((r.resolved == str(root / "a.txt")) == (r.path_error is None) for r in got)
    none = sandbox.resolve_local(spark.createDataFrame([("a",)], "path string"), ()).first()
    assert none.path_error == "CONFIGURATION_ERROR"
    advice = spark.createDataFrame([("C:\\x\\y.txt",)], "p string").select(sandbox.platform_advice(F.col("p")).alias("a")).first().a
    assert "/mnt/c/x/y.txt" in advice


def test_image_resolution(spark):
    cases = [("ocr_only", True, False, "unknown", False, "ocr"), ("hybrid", True, True, "text_extraction", True, "ocr_local"), ("hybrid", True, True, "text_extraction", False, "vision"), ("hybrid", True, True, "visual_semantics", True, "vision"), ("hybrid", True, False, "visual_semantics", True, "ocr_degraded"), ("vision", False, False, "unknown", False, "error"), ("vision", True, True, "text_extraction", True, "vision")]
    rows = spark.createDataFrame([c for c in cases], "p string, ran boolean, v boolean, i string, good boolean, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", route.resolution(*[F.col(c) for c in ("p", "ran", "v", "i", "good")])).collect())
    weak = spark.createDataFrame([("auto", True, True, "visual_semantics", "vision"), ("auto", True, True, "unknown", "ocr"), ("auto", False, True, "unknown", "vision"), ("auto", False, False, "unknown", "neither"), ("ocr", True, True, "visual_semantics", "ocr"), ("vision", True, True, "unknown", "vision")], "p string, o boolean, v boolean, i string, want string")
    assert all(r.got == r.want for r in weak.withColumn("got", route.weak_page_backend(*[F.col(c) for c in ("p", "o", "v", "i")])).collect())
    assert [r.b for r in spark.createDataFrame([(-1,), (0,), (50,), (900,)], "m int").select(route.budget(F.col("m"), 100).alias("b")).collect()] == [100, 100, 50, 100]


def entries(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, schema_version int, stored_at timestamp, last_access timestamp, size_bytes long, payload string")


def test_lookup_takes_the_latest_and_honours_age(spark):
    at = lambda days: NOW - timedelta(days=days)
    table = entries(spark, [("a", 2, at(5), at(5), 1, "old"), ("a", 2, at(1), at(1), 1, "new"), ("b", 2, at(40), at(1), 1, "gone"), ("c", 1, at(1), at(1), 1, "other schema")])
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "cache_key string")
    got = sorted((r.cache_key, r.cache_status, r.payload) for r in cache.lookup(asked, table, F.lit(NOW), 30).collect())
    assert got == [("a", "hit", "new"), ("a", "hit", "new"), ("b", "expired", None), ("c", "miss", None), ("d", "miss", None)]
    assert {r.cache_status for r in cache.lookup(asked.where("cache_key = 'b'"), table, F.lit(NOW), 0).collect()} == {"hit"}


@pytest.mark.parametrize("seed", range(4))
def test_eviction_is_the_loops(spark, seed):
    dice = random.Random(seed)
    rows = [(f"k{k}", 2, NOW, NOW - timedelta(seconds=dice.randrange(500)), dice.randrange(1, 50), "") for k in range(60)]
    budget = dice.randrange(1, 1500)
    left, gone = sum(r[4] for r in rows), set()
    for r in sorted(rows, key=lambda r: (r[3], r[4], r[0])):
        if left <= budget:
            break
        left -= r[4]
        gone.add(r[0])
    marked = cache.evict(entries(spark, rows), budget, slots=7).collect()
    assert {r.cache_key for r in marked if r.evicted} == gone
    old = entries(spark, rows + [("x", 2, NOW - timedelta(days=99), NOW, 10, "")])
    assert tuple(cache.cleanup(old, F.lit(NOW), 30, budget, slots=7).first()) == (1, len(gone), len(rows) - len(gone), left)


def test_keys_change_with_what_matters(spark):
    base = dict(sha256="s", mode="auto", profile="general", detail="normal", pages="1,2", question="What  is IT", processor="text", processor_version="1", extension=".txt")

    def key(settings=Settings(), **changes):
        return spark.range(1).select(cache.cache_key(settings, **{k: F.lit(v) for k, v in (base | changes).items()}).alias("k")).first().k

    assert key() == key(question=" what is it ", pages=" 1, 2") == key(Settings(max_output_chars=5, vision_api_key="secret"))
    others = [key(**{k: "z"}) for k in base] + [key(Settings(max_pages=3)), key(Settings(pdf_render_dpi=72)), key(Settings(allow_cloud_vision=True))]
    assert len({key(), *others}) == len(others) + 1 and all(len(k) == 64 for k in others)


def test_slides_and_sheets(spark):
    deck = "junk\n<!-- Slide number: 1 -->\nOne\n\n<!-- Slide number: 2 -->\n"
    rows = spark.createDataFrame([(deck, 2), (deck, 3), (deck, None), ("none", 1), (deck.replace("2", "7"), None)], "m string, n int")
    got = [[tuple(s) for s in r.s] for r in rows.select(sections.split_slides(F.col("m"), F.col("n")).alias("s")).collect()]
    assert got == [[("1", "One"), ("2", "")], [], [("1", "One"), ("2", "")], [], []]
    built = rows.limit(1).select(sections.rebuild_slides(sections.split_slides(F.col("m")), F.array(F.lit(2))).alias("b")).first().b
    assert built == "### Slide 2\n\n_(no text)_"
    book = "## A\n\n| 1 |\n\n##  B b  \n| 2 |"
    rows = spark.createDataFrame([(book, ["A", "B b"]), (book, ["B b", "A"]), (book, None)], "m string, n array<string>")
    assert [[s.name for s in r.s] for r in rows.select(sections.split_sheets(F.col("m"), F.col("n")).alias("s")).collect()] == [["A", "B b"], [], ["A", "B b"]]
    assert spark.createDataFrame([("# A \n####### no\n##  B\nx",)], "m string").select(sections.outline(F.col("m")).alias("o")).first().o == ["# A", "## B"]


def test_rendering(spark):
    kind = f"summary string, answer string, content_markdown string, evidence {render.EVIDENCE}, warnings array<string>, extra_warnings array<string>, question string, detail string, max_chars int"
    ev = [("ocr", "image", "two\nlines", 0.91), ("text", None, " x ", None)]
    rows = [("S", None, "C", ev, ["w", "v"], ["v"], "Q?", "normal", 10_000), ("S", "A", "", [], [], [], "Q?", "full", 10_000), ("S", "A", "C" * 2000, ev * 4, [], [], None, "compact", 10_000), ("S", None, "line\n" * 200, [], [], [], None, "full", 300)]
    out = render.assemble(spark.createDataFrame(rows, kind)).collect()
    assert out[0].markdown == f"## Summary\n\nS\n\n## Answer to the requested question\n\n{render.NO_ANSWER}\n\n## Extracted content\n\nC\n\n## Evidence\n\n- **ocr** (image) [confidence 91%]:\n\n  two\nlines\n- **text**: x\n\n## Warnings\n\n- v\n- w"
    assert out[1].markdown == "## Summary\n\nS\n\n## Answer to the requested question\n\nA"
    assert "## Extracted content\n\nA\n" in out[2].markdown and len(out[2].evidence) == 3
    assert out[3].truncation.original_chars > 300 and out[3].warnings == ["Output was truncated; see the truncation field."]


def test_upkeep_rewrites_the_table_and_survives_a_crash(spark, tmp_path):
    import datetime

    day = datetime.timedelta(days=1)
    path = f"{tmp_path}/cache"
    rows = [(f"{k:064x}", 2, NOW - k * day, NOW - k * day, 10, "{}") for k in range(8)]
    table = spark.createDataFrame(rows, "cache_key string, schema_version int, stored_at timestamp, last_access timestamp, size_bytes long, payload string")
    cache.put(table, path)
    cache.touch(spark.createDataFrame([(f"{5:064x}",)], "cache_key string"), F.lit(NOW), path)
    assert tuple(cache.upkeep(spark, path, F.lit(NOW), 6, 40).first()) == (1, 3, 4, 40)
    left = {int(r.cache_key, 16): r.last_access for r in spark.read.parquet(path).collect()}
    assert set(left) == {0, 1, 2, 5} and left[5] == left[0]
    (tmp_path / "cache").rename(tmp_path / "cache.old")
    cache.recover(spark, path)
    assert spark.read.parquet(path).count() == 4
    cache.clear(spark, path)
    assert spark.read.parquet(path).count() == 0
