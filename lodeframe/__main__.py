"""Command line: doctor, inspect, show-config, clear-cache and benchmark.

Settings come from LODEFRAME_* variables of this process alone.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.errors import ERRORS
from .operators import cache
from .operators.sandbox import resolve_local
from .plans.engine import Engine, requests_for
from .plans.facts import verdicts
from .settings import Settings
from .sources.backends import NoOcr
from .sources.files import read_files
from .sources.transport import vision_from


def settings_from(env: dict[str, str]) -> Settings:
    given = {}
    for f in fields(Settings):
        value = env.get(f"LODEFRAME_{f.name.upper()}")
        if value is not None:
            kind = type(f.default)
            given[f.name] = Settings.roots_from(value) if f.name == "allowed_roots" else value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return replace(Settings(), **given)


def doctor(settings: Settings) -> list[dict]:
    """What is there and what is wrong; no network is used."""
    found = [{"check": "settings", "field": p["field"], "ok": not p["fatal"], "message": p["message"]} for p in settings.problems()]
    found += [{"check": "root", "field": r, "ok": os.path.isdir(os.path.expanduser(r)), "message": ""} for r in settings.allowed_roots]
    found.append({"check": "ocr", "field": settings.ocr_backend, "ok": NoOcr().available(), "message": "no OCR engine is built in; give the engine a backend"})
    found.append({"check": "vision", "field": settings.model, "ok": settings.vision_usable, "message": "configured and allowed" if settings.vision_usable else "closed"})
    return found


def said(code: str) -> str:
    message, hint = ERRORS[code]
    return f"## Error: {code}\n\n{message}\n\n**What to do:** {hint}"


def session() -> SparkSession:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def inspect(settings: Settings, args: argparse.Namespace) -> int:
    spark = session()
    # Without roots in the settings the file's own folder is the root: whoever types the command names it.
    roots = settings.allowed_roots or (os.path.dirname(os.path.abspath(args.path)),)
    given = args.path if settings.allowed_roots else os.path.abspath(args.path)
    found = resolve_local(spark.createDataFrame([(given,)], "path string"), roots).first()
    if found.path_error:
        print(json.dumps({"success": False, "error": {"code": found.path_error}}) if args.json else said(found.path_error))
        return 1
    files = read_files(spark, found.resolved, settings.max_file_bytes).withColumn("path", F.col("name"))
    asked = spark.createDataFrame([(os.path.basename(found.resolved),)], "path string")
    settings = replace(settings, allowed_roots=())  # the path is resolved, and the request has the bare name
    extra = {k: v for k, v in {"question": args.question, "pages": args.pages, "mode": args.mode, "detail": args.detail, "vision_profile": args.profile, "max_chars": args.max_chars}.items() if v is not None}
    engine = Engine(spark, settings, vision=vision_from(settings), cache_path=settings.cache_dir or None)
    row = engine.analyze(requests_for(asked, **extra), files).first()
    print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) if args.json else row.markdown)
    return 0 if row.success else 1


def benchmark(settings: Settings, args: argparse.Namespace) -> int:
    """Cases are JSON lines with path, question, must_contain, needs_ocr and needs_vision beside the files."""
    spark = session()
    if settings.allowed_roots:
        folder = os.path.realpath(args.folder)
        if not any(os.path.commonpath([folder, r]) == r for r in map(os.path.realpath, settings.allowed_roots)):
            print(said("PATH_NOT_ALLOWED"))
            return 1
        settings = replace(settings, allowed_roots=())
    kind = "path string, question string, must_contain array<string>, needs_ocr boolean, needs_vision boolean"
    cases = requests_for(spark.read.schema(kind).json(args.cases))
    files = read_files(spark, args.folder, settings.max_file_bytes).withColumn("path", F.col("name"))
    answers = Engine(spark, settings, vision=vision_from(settings)).analyze(cases, files)
    rows = verdicts(cases, answers, ocr=False, vision=settings.vision_usable).collect()
    for r in rows:
        print(r.verdict, r.request_id, *r.missed)
    return int(any(r.verdict == "FAIL" for r in rows))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodeframe")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("doctor", "show-config", "clear-cache"):
        commands.add_parser(name)
    look = commands.add_parser("inspect")
    look.add_argument("path")
    for name in ("question", "pages", "mode", "detail", "profile"):
        look.add_argument(f"--{name}")
    look.add_argument("--max-chars", type=int)
    look.add_argument("--json", action="store_true")
    facts = commands.add_parser("benchmark")
    facts.add_argument("folder")
    facts.add_argument("cases")
    args = parser.parse_args(argv)
    settings = settings_from(dict(os.environ))
    if args.command == "doctor":
        found = doctor(settings)
        print(json.dumps(found, indent=1))
        return int(any(not x["ok"] for x in found if x["check"] in ("settings", "root")))
    if args.command == "show-config":
        print(json.dumps(settings.redacted(), indent=1, default=list))
        return 0
    if args.command == "clear-cache":
        if settings.cache_dir:
            cache.clear(session(), settings.cache_dir)
        return 0
    return inspect(settings, args) if args.command == "inspect" else benchmark(settings, args)


if __name__ == "__main__":
    sys.exit(main())
