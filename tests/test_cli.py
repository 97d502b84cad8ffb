import json

from pyspark.sql import functions as F

from lodeframe.__main__ import doctor, main, settings_from
from lodeframe.functions import geometry, provider
from lodeframe.settings import Settings
from lodeframe.sources.logs import log_lines, write_log


def test_settings_and_doctor(capsys, monkeypatch):
    s = settings_from({"LODEFRAME_MAX_PAGES": "3", "LODEFRAME_ALLOW_CLOUD_VISION": "true", "LODEFRAME_ALLOWED_ROOTS": "/tmp:/nowhere", "OTHER": "x"})
    assert (s.max_pages, s.allow_cloud_vision, s.allowed_roots) == (3, True, ("/tmp", "/nowhere"))
    assert {x["field"]: x["ok"] for x in doctor(s) if x["check"] == "root"} == {"/tmp": True, "/nowhere": False}
    monkeypatch.setenv("LODEFRAME_VISION_API_KEY", "hush")
    assert main(["show-config"]) == 0 and "hush" not in capsys.readouterr().out
    assert main(["doctor"]) == 1


def test_presets():
    s = Settings(vision_provider="huggingface", vision_api_key="k", vision_model="a/b", vision_route_policy="fast", vision_fallback_models="x, ,y")
    assert s.base_url.startswith("https://router.") and s.model == "a/b:fast" and s.fallback_models == ("x", "y") and s.vision_configured and not s.vision_usable
    assert Settings(vision_model="m", vision_route_policy="fast").model == "m"


def test_inspect_and_benchmark(spark, tmp_path, capsys):
    (tmp_path / "notes.txt").write_text("report export crash\n")
    assert main(["inspect", str(tmp_path / "notes.txt"), "--question", "what broke?"]) == 0
    assert "report export crash" in capsys.readouterr().out
    assert main(["inspect", str(tmp_path / "notes.txt"), "--mode", "vision", "--json"]) == 1
    assert json.loads(capsys.readouterr().out)["error"]["code"] == "VISION_NOT_CONFIGURED"
    cases = [{"path": "notes.txt", "must_contain": ["Export"], "needs_ocr": False, "needs_vision": False}, {"path": "gone.png", "must_contain": ["x"], "needs_ocr": True, "needs_vision": False}]
    (tmp_path / "cases.json").write_text("\n".join(map(json.dumps, cases)))
    assert main(["benchmark", str(tmp_path), str(tmp_path / "cases.json")]) == 0
    assert "PASS notes.txt" in (out := capsys.readouterr().out) and "SKIP gone.png" in out


def test_clear_cache(spark, tmp_path, monkeypatch):
    spark.range(3).write.parquet(f"{tmp_path}/cache")
    monkeypatch.setenv("LODEFRAME_CACHE_DIR", f"{tmp_path}/cache")
    assert main(["clear-cache"]) == 0 and spark.read.parquet(f"{tmp_path}/cache").count() == 0


def test_log_lines(spark, tmp_path):
    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS t, 'r1' AS r, map('api_key', 's3cret', 'mode', 'auto') AS f")
    write_log(log_lines(events, time=F.col("t"), level=F.lit("INFO"), event=F.lit("done"), request_id=F.col("r"), fields=F.col("f")), f"{tmp_path}/log")
    line = json.loads(spark.read.text(f"{tmp_path}/log").first().value)
    assert line == {"ts": "2024-01-01T00:00:00.000Z", "level": "INFO", "event": "done", "request_id": "r1", "fields": {"api_key": "***redacted***", "mode": "auto"}}


def test_payload_and_report(spark):
    kind = "array<struct<mime:string,content:binary,label:string,role:string,x:int,y:int,w:int,h:int,original_w:int,original_h:int>>"
    one = [("image/png", bytearray(b"a"), "", None, None, None, None, None, 1, 1)]
    two = [("image/png", bytearray(b"a"), "", "overview", None, None, None, None, 900, 9000), ("image/jpeg", bytearray(b"b"), "t", "detail", 0, 4000, 900, 4096, 900, 9000)]
    rows = spark.createDataFrame([(one, 'say "hi"'), (two, "x")], f"i {kind}, p string").select(provider.payload(F.lit("m"), F.col("p"), F.lit("sys"), F.col("i"), 7).alias("j")).collect()
    first, second = (json.loads(r.j) for r in rows)
    assert first["messages"][0] == {"role": "system", "content": "sys"} and first["messages"][1]["content"][0]["text"] == 'say "hi"' and len(first["messages"][1]["content"]) == 2
    kinds = [c["type"] for c in second["messages"][1]["content"]]
    assert kinds == ["text", "text", "image_url", "text", "image_url"] and "y=4000-8096" in second["messages"][1]["content"][3]["text"] and second["max_tokens"] == 7
    body = '{"model":"z","choices":[{"finish_reason":"stop"}],"usage":{"prompt_tokens":5,"completion_tokens":6}}'
    got = spark.createDataFrame([(body,)], "b string").select(provider.completion_report(F.col("b")).alias("r"), geometry.was_downscaled(F.lit(5), F.lit(5), F.lit(6), F.lit(5)).alias("d")).first()
    assert tuple(got.r) == ("z", None, "stop", 5, 6) and got.d


def test_inspect_keeps_to_the_roots(spark, tmp_path, capsys, monkeypatch):
    for name in ("ws", "ws-evil", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.txt").write_text(f"held in {name}\n")
    (tmp_path / "ws" / "link.txt").symlink_to(tmp_path / "other" / "a.txt")
    monkeypatch.setenv("LODEFRAME_ALLOWED_ROOTS", str(tmp_path / "ws"))

    def said(path):
        code = main(["inspect", path, "--json"])
        return code, json.loads(capsys.readouterr().out)

    assert said(str(tmp_path / "ws" / "a.txt"))[0] == 0 and said("a.txt")[1]["success"]
    for path in ("ws-evil/a.txt", "other/a.txt", "ws/../other/a.txt", "ws/link.txt", "other/none.txt"):
        code, out = said(f"{tmp_path}/{path}")
        assert code == 1 and out["error"]["code"] == "PATH_NOT_ALLOWED", path
    assert said(f"{tmp_path}/ws/none.txt")[1]["error"]["code"] == "FILE_NOT_FOUND"
    assert main(["benchmark", str(tmp_path / "other"), "cases.json"]) == 1
