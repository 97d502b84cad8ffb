"""The request pipeline: validate, detect, route, look up, process, store, render. Requests are a DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import provider
from ..functions.errors import error_markdown, error_struct
from ..functions.intent import intent, profile
from ..functions.text import excerpt, fenced, first_lines, line_location, needs_fallback, ocr_good_enough, page_selection, printable_ratio, rstrip, strip, text_content, text_summary
from ..operators import cache, images, sandbox
from ..operators.detect import detect, refusal, zip_members
from ..operators.render import EVIDENCE, assemble
from ..operators.route import argument_error, budget, resolution, route, weak_page_backend
from ..operators.sections import conversion_summary, rebuild_slides, section_evidence, split_sheets, split_slides
from ..settings import Settings
from ..staging import stage
from ..sources.backends import NoOcr, OcrBackend, PdfBackend, VisionBackend, installed_languages, look, recognise
from ..sources.convert import append, compose, convert, decode_texts
from ..sources.imaging import Codec, measured, prepare
from ..sources.logs import log_lines, write_log
from ..sources.transport import HttpVision, converse

PROMPT_VERSION = "2"
#: Stands for the file's name in what is stored: equal files share a result whatever they are called.
NAME = "\x1a"
VERSIONS = {"text": "1", "convert": "1", "pdf": "2", "image": "2"}
#: What every processor returns.
RESULT = f"summary string, answer string, content_markdown string, evidence {EVIDENCE}, warnings array<string>, fallbacks_used array<string>, model string, error string"
NAMES = [x.split()[0] for x in RESULT.replace(EVIDENCE, "x").split(", ")]


def nothing(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def cut_note(what: str, thing: str, verb: str, pages: Column, total: Column, asked: Column, kept: Column) -> Column:
    """Says that max_pages left out pages or slides; null if it did not."""
    number = lambda c: c.cast("string")
    some = F.concat(F.lit("The 'pages' parameter selects "), number(asked), F.lit(f" {thing}s; only the first "), number(kept), F.lit(f" of them were {verb}. Ask for the others in another request."))
    every = F.concat(F.lit(f"The {what} has "), number(total), F.lit(f" {thing}s; only the first "), number(kept), F.lit(f" were {verb}. Use the 'pages' parameter to reach later {thing}s."))
    return F.when(asked > kept, F.when(pages.isNull() | (strip(pages) == ""), every).otherwise(some))


def item(kind: str, location: Column, content: Column, confidence: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), location.alias("location"), content.alias("content"), (nothing("double") if confidence is None else confidence.cast("double")).alias("confidence"))


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


@dataclass
class Engine:
    """``analyze(requests, files)`` answers every request with one row, an error included.

    requests: request_id, path, question, mode, vision_profile, pages, detail,
    max_chars, force_refresh. files: path, name, extension, content,
    size_bytes, sha256, modified_at (``sources.files`` makes them).
    """

    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    ocr: OcrBackend = field(default_factory=NoOcr)
    vision: VisionBackend | HttpVision | None = None
    pdf: PdfBackend | None = None
    codec: Codec | None = None
    cache_path: str | None = None
    log_path: str | None = None

    @property
    def vision_usable(self) -> bool:
        """Without this gate no plan has a vision branch at all."""
        return self.vision is not None and self.settings.vision_usable

    def analyze(self, requests: DataFrame, files: DataFrame, now: Column | None = None) -> DataFrame:
        """Decisions are made on names, sizes and first bytes, and written; content is joined for the work that is left."""
        started = time.monotonic()
        now = self.spark.sql("SELECT current_timestamp()").first()[0] if now is None else now
        now = now if isinstance(now, Column) else F.lit(now)
        routed = stage(self.route(requests, files), "routed")
        good = routed.where("error IS NULL").drop("error")
        looked = self._cached(good, now)
        misses = looked.where("cache_status != 'hit'")
        # One piece of work for each key, however many requests share it.
        work = misses.dropDuplicates(["cache_key"]).join(files.select("path", "content"), "path").withColumn("name", F.lit(NAME))
        present = {r.processor for r in misses.select("processor").distinct().collect()}  # four values at most
        done = stage(self.process(work, present).select("cache_key", *NAMES), "processed")
        if self.cache_path and self.settings.cache_enabled:
            payload = F.to_json(F.struct(*NAMES), {"ignoreNullFields": "false"})
            cache.put(done.where("error IS NULL").select("cache_key", F.lit(cache.SCHEMA_VERSION).alias("schema_version"), now.alias("stored_at"), now.alias("last_access"), F.octet_length(payload).cast("long").alias("size_bytes"), payload.alias("payload")), self.cache_path)
            cache.touch(looked.where("cache_status = 'hit'"), now, self.cache_path)
        hits = looked.where("cache_status = 'hit'").withColumn("__r", F.from_json("payload", RESULT)).withColumns({n: F.col(f"__r.{n}") for n in NAMES}).drop("__r", "payload", "stored_at")
        fresh = misses.drop("payload", "stored_at").join(done, "cache_key")
        bad = routed.where("error IS NOT NULL").withColumns({"cache_status": F.lit("miss"), "summary": F.lit(""), "answer": nothing(), "content_markdown": F.lit(""), "evidence": none_of(EVIDENCE), "warnings": none_of("array<string>"), "fallbacks_used": none_of("array<string>"), "model": nothing()})
        answers = self.render(hits.unionByName(fresh).unionByName(bad), int((time.monotonic() - started) * 1000))
        if self.log_path:
            self._log(answers, now)
        return answers

    def _log(self, answers: DataFrame, now: Column) -> None:
        """One line for each request: what was done with it, how long its batch took, and no text of it."""
        said = {"processor": F.col("processing.processor"), "cache": F.when(F.col("processing.cached"), "hit").otherwise("miss"), "media_type": F.col("source.category"), "error": F.col("error.code"), "duration_ms": F.col("processing.duration_ms").cast("string")}
        fields = F.map_filter(F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
        write_log(log_lines(answers, time=now, level=F.when(F.col("success"), "INFO").otherwise("WARNING"), event=F.when(F.col("success"), "request answered").otherwise("request failed"), request_id=F.col("request_id"), fields=fields), self.log_path)

    def route(self, requests: DataFrame, files: DataFrame) -> DataFrame:
        """Requests with their file (without its content), its category, the chosen processor, the key and, if anything is wrong, an error."""
        s = self.settings
        heads = files.withColumn("head", F.hex(F.substring("content", 1, 16)))
        listed = (zip_members(heads.where("head LIKE '504B%'")).unionByName(heads.where("head NOT LIKE '504B%' OR head IS NULL").withColumn("members", nothing("array<string>")))).drop("content")
        asked = compose(requests, "question").withColumnRenamed("path", "asked_path")
        found = asked.join(listed, F.col("asked_path") == F.col("path"), "left").withColumn("extension", F.coalesce("extension", F.lit("")))
        seen = detect(found, F.coalesce("head", F.lit("")), F.col("members")).drop("members", "head")
        what = intent(F.col("question"))
        caps = [F.lit(self.ocr.available()), F.lit(s.vision_configured and self.vision is not None), F.lit(s.allow_cloud_vision), F.lit(s.auto_image_strategy)]
        chosen = seen.withColumns({"intent": what, "__route": route(F.col("mode"), F.col("category"), *caps, what), "profile": profile(F.col("question"), F.col("vision_profile"), F.col("category") == "pdf")})
        error = F.coalesce(
            argument_error(F.col("mode"), F.col("detail"), F.col("vision_profile")),
            self._refused(F.col("asked_path")),
            F.when(F.col("path").isNull(), "FILE_NOT_FOUND"),
            F.when(F.col("size_bytes") > s.max_file_bytes, "FILE_TOO_LARGE"),
            F.when(refusal(F.col("category")).isNotNull(), "UNSUPPORTED_MEDIA_TYPE"),
            F.col("__route.error"),
        )
        version = F.lit("")
        for name, number in VERSIONS.items():
            version = F.when(F.col("__route.processor") == name, number).otherwise(version)
        key = cache.cache_key(s, sha256=F.col("sha256"), mode=F.col("mode"), profile=F.col("profile"), detail=F.col("detail"), pages=F.col("pages"), question=F.col("question"), processor=F.col("__route.processor"), processor_version=version, extension=F.col("extension"), prompt_version=PROMPT_VERSION, ocr_version=self.ocr.version)
        blind = F.when(F.col("__route.warned"), F.array(F.lit("The question needs eyes, but only OCR is available: this is a transcription."))).otherwise(none_of("array<string>"))
        return chosen.withColumns({"processor": F.col("__route.processor"), "plan": F.col("__route.plan"), "extra_warnings": blind, "error": error, "processor_version": version, "cache_key": key, "max_chars": budget(F.col("max_chars"), s.max_output_chars)}).drop("__route", "path").withColumnRenamed("asked_path", "path")

    def _refused(self, path: Column) -> Column:
        """What is wrong with a request's path before any file is asked for: its syntax and, where roots are set, its place.

        Links are followed where files are opened (``sandbox.resolve_local``, which the command line uses).
        """
        roots = self.settings.allowed_roots
        if roots:
            return sandbox.textual_code(path, F.array(*[F.lit(r) for r in roots]))
        return F.coalesce(sandbox.syntax_error(path), F.when(sandbox.platform_advice(path).isNotNull(), "PATH_NOT_ALLOWED"))

    def _cached(self, rows: DataFrame, now: Column) -> DataFrame:
        """Adds cache_status, payload and stored_at; a forced refresh is never a hit."""
        none = rows.withColumns({"cache_status": F.lit("miss"), "payload": nothing(), "stored_at": nothing("timestamp")})
        if not (self.cache_path and self.settings.cache_enabled):
            return none
        cache.recover(self.spark, self.cache_path)
        try:
            entries = self.spark.read.parquet(self.cache_path)
        except Exception as error:  # no table yet: every request is a miss
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return none
        looked = cache.lookup(rows, entries, now, self.settings.cache_ttl_days)
        forced = F.coalesce("force_refresh", F.lit(False)) & (F.col("cache_status") == "hit")
        return looked.withColumn("cache_status", F.when(forced, "refresh").otherwise(F.col("cache_status")))

    def process(self, work: DataFrame, present: set[str] | None = None) -> DataFrame:
        """A branch for each processor that has work; the others are not planned at all."""
        makers = {"text": self._text, "convert": self._converted, "pdf": self._pdf, "image": self._image}
        branches = [make(work.where(F.col("processor") == name)) for name, make in makers.items() if present is None or name in present]
        if not branches:
            return self._failed(work, "INTERNAL_ERROR")  # no rows
        out = branches[0]
        for b in branches[1:]:
            out = out.unionByName(b)
        return out

    @staticmethod
    def _result(rows: DataFrame, **columns: Column) -> DataFrame:
        base = {"answer": nothing(), "warnings": none_of("array<string>"), "fallbacks_used": none_of("array<string>"), "model": nothing(), "error": nothing()}
        return rows.select("cache_key", *[(base | columns)[n].alias(n) for n in NAMES])

    def _text(self, rows: DataFrame) -> DataFrame:
        read = decode_texts(rows)
        text = F.col("text")
        ignored = F.when(F.col("pages").isNotNull(), "The 'pages' parameter does not apply to plain-text files and was ignored.")
        return self._result(
            read,
            summary=text_summary(F.col("name"), text, F.col("encoding")),
            content_markdown=text_content(text, F.col("extension")),
            evidence=F.array(item("text", line_location(text), first_lines(text, 12))),
            warnings=F.array_compact(F.array(F.col("decode_warning"), ignored)),
        )

    def _converted(self, rows: DataFrame) -> DataFrame:
        made = convert(rows).withColumn("markdown", F.coalesce("markdown", F.lit("")))
        none = none_of("array<struct<name:string,body:string>>")
        parts = made.withColumns({
            "__slides": F.when(F.col("extension") == ".pptx", split_slides(F.col("markdown"), F.col("slide_count"))).otherwise(none),
            "__sheets": F.when(F.col("extension").isin(".xlsx", ".xls"), split_sheets(F.col("markdown"), F.col("sheet_names"))).otherwise(none),
        })
        chosen = parts.withColumn("__pages", F.when(F.size("__slides") > 0, page_selection(F.col("pages"), F.size("__slides"), self.settings.max_pages)))
        kept = F.filter("__slides", lambda x: F.array_contains(F.col("__pages.pages"), x["name"].cast("int")))
        content = F.when(F.size("__slides") > 0, rebuild_slides(F.col("__slides"), F.col("__pages.pages"))).otherwise(F.col("markdown"))
        evidence = F.when(F.size("__slides") > 0, section_evidence(kept, "slide", "slide ")).when(F.size("__sheets") > 0, section_evidence(F.col("__sheets"), "sheet")).otherwise(F.array(item("text", F.col("name"), excerpt(F.col("markdown")))))
        ignored = F.when(F.col("pages").isNotNull() & (F.size("__slides") == 0), F.when(F.size("__sheets") > 0, "The 'pages' parameter does not apply to spreadsheets; all sheets were converted.").otherwise(F.concat(F.lit("The 'pages' parameter does not apply to "), F.col("extension"), F.lit(" files and was ignored."))))
        unsplit = F.when((F.size("__slides") == 0) & (F.col("extension") == ".pptx"), "Slide boundaries could not be verified; the content is one block.").when((F.size("__sheets") == 0) & (F.col("extension") == ".xlsx"), "Sheet headings did not match the workbook; the content is one block.")
        capped = cut_note("deck", "slide", "converted", F.col("pages"), F.size("__slides"), F.col("__pages.asked"), F.size("__pages.pages"))
        label = F.upper(F.regexp_replace("extension", r"^\.", ""))
        return self._result(
            chosen,
            summary=conversion_summary(label, F.col("name"), F.col("markdown"), F.col("__slides"), F.col("__sheets")),
            content_markdown=content,
            evidence=evidence,
            warnings=F.array_compact(F.array(ignored, unsplit, capped)),
            error=F.coalesce(F.col("convert_error"), F.when(F.col("__pages.error").isNotNull(), "INVALID_PAGE_SELECTION")),
        )

    def _failed(self, rows: DataFrame, code: str) -> DataFrame:
        return self._result(rows, summary=F.lit(""), content_markdown=F.lit(""), evidence=none_of(EVIDENCE), error=F.lit(code))

    def _pdf(self, rows: DataFrame) -> DataFrame:
        if self.pdf is None:
            return self._failed(rows, "DOCUMENT_CONVERSION_FAILED")
        import pyarrow as pa

        pdf, settings = self.pdf, self.settings

        def count(b: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for data in b.column(b.schema.names.index("content")).to_pylist():
                try:
                    out.append(pdf.count(data))
                except Exception:  # broken or locked files
                    out.append(None)
            return [pa.array(out, pa.int32())]

        def read(b: pa.RecordBatch) -> list[pa.Array]:
            at = b.schema.names.index
            pages = [pdf.pages(c, p) for c, p in zip(b.column(at("content")).to_pylist(), b.column(at("selected")).to_pylist(), strict=True)]
            return [pa.array([[{"page": p.number, "text": p.text} for p in x] for x in pages], pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())])))]

        def picture(b: pa.RecordBatch) -> list[pa.Array]:
            at = b.schema.names.index
            return [pa.array([pdf.image(c, n, settings.pdf_render_dpi) for c, n in zip(b.column(at("content")).to_pylist(), b.column(at("page")).to_pylist(), strict=True)], pa.binary())]

        counted = append(rows, "total_pages int", count).withColumn("__sel", page_selection(F.col("pages"), F.coalesce("total_pages", F.lit(0)), settings.max_pages))
        broken = F.when(F.col("total_pages").isNull(), "DOCUMENT_CONVERSION_FAILED").when(F.col("__sel.error").isNotNull(), "INVALID_PAGE_SELECTION")
        marked = counted.withColumns({"__error": broken, "selected": F.col("__sel.pages"), "asked": F.col("__sel.asked")}).drop("__sel")
        bad = self._result(marked.where("__error IS NOT NULL"), summary=F.lit(""), content_markdown=F.lit(""), evidence=none_of(EVIDENCE), error=F.col("__error"))
        opened = stage(append(marked.where("__error IS NULL"), "__pages array<struct<page:int,text:string>>", read), "opened")  # several branches read the pages
        paged = opened.select("cache_key", "name", "content", "pages", "plan", "intent", "profile", "question", "detail", "total_pages", "selected", "asked", F.explode("__pages").alias("__p")).select("*", "__p.page", "__p.text").drop("__p")
        clean = strip(F.col("text"))
        weak = F.col("plan").isin("ocr", "vision") | ((F.col("plan") != "text") & needs_fallback(F.length(clean), printable_ratio(clean), settings.pdf_min_chars_per_page))
        paged = paged.withColumns({"weak": weak, "backend": weak_page_backend(F.col("plan"), F.lit(self.ocr.available()), F.lit(self.vision_usable), F.col("intent"))})
        whole = rstrip(F.col("text"))
        head = F.concat(F.lit("### Page "), F.col("page").cast("string"), F.lit("\n\n"))
        where = F.concat(F.lit("page "), F.col("page").cast("string"))
        keep = ["cache_key", "name", "pages", "total_pages", "selected", "asked", "page", "weak"]
        failed = nothing().alias("failed")
        short = F.when(F.length(whole) > 400, F.concat(F.substring(whole, 1, 400), F.lit(" ..."))).when(whole == "", "(blank)").otherwise(whole)
        good = paged.where(~F.col("weak")).select(*keep, F.concat(head, F.when(whole != "", whole).otherwise("_(blank page)_")).alias("section"), F.array(item("page", where, short)).alias("ev"), nothing().alias("note"), failed)
        thin = paged.where("weak")
        found = good.unionByName(thin.where("backend = 'neither'").select(*keep, F.concat(head, F.when(whole != "", whole).otherwise("_(blank page)_")).alias("section"), F.array(item("page", where, short)).alias("ev"), F.lit("no fallback").alias("note"), failed))
        if self.ocr.available():
            seen = recognise(append(thin.where("backend = 'ocr'"), "image binary", picture), self.ocr, self._languages()[0], "image", settings.process_timeout_seconds)
            text = F.coalesce(rstrip(F.col("ocr_text")), F.lit(""))
            found = found.unionByName(seen.select(*keep, F.concat(head, F.when(strip(text) != "", text).otherwise("_(no text recognised)_")).alias("section"), F.array(item("ocr", where, F.when(strip(text) != "", F.substring(text, 1, 1500)).otherwise("(no text recognised)"), F.col("ocr_confidence"))).alias("ev"), F.coalesce("ocr_error", F.lit("ocr")).alias("note"), failed))
        if self.vision_usable:
            shown = append(thin.where("backend = 'vision'"), "image binary", picture)
            label, size, most = where, images.image_size(F.col("image")), settings.vision_max_dimension
            sized = measured(shown, self.codec, size, "image").withColumns({"shots": images.shots(F.col("size"), label, F.lit("scanned_document"), most), "plan_note": images.plan_note(F.col("size"), F.lit("scanned_document"), most)})
            if self.ocr.available() and settings.send_ocr_to_cloud:  # a guess for the provider to check; its failure is none of the page's
                sized = recognise(sized, self.ocr, self._languages()[0], "image", settings.process_timeout_seconds)
            guess = F.coalesce(F.col("ocr_text"), F.lit("")) if "ocr_text" in sized.columns else None
            asked = prepare(sized, self.codec, settings.vision_image_format, settings.vision_max_image_bytes, F.lit("image/png"), "image")
            replied = self._look(asked.withColumn("prompt", provider.prompt(F.col("profile"), F.col("question"), F.col("detail"), label, None, guess)))
            exact = F.transform("__a.exact_text", lambda x: item("visual", where, F.substring(x, 1, 1200)))
            seen = F.when(F.size(exact) > 0, exact).otherwise(F.array(item("visual", where, F.coalesce(F.col("__a.summary"), F.substring("reply", 1, 400)))))
            section = F.concat(F.lit("### Page "), F.col("page").cast("string"), F.lit(" (visual analysis)\n\n"), provider.vision_markdown(F.col("__a"), nothing()))
            found = found.unionByName(replied.select(*keep, section.alias("section"), seen.alias("ev"), F.lit("vision").alias("note"), F.coalesce("image_error", "vision_error").alias("failed")))
        # A document has max_pages pages at most, so what is gathered for one is bounded.
        gathered = found.groupBy("cache_key", "name", "pages", "total_pages", "selected", "asked").agg(
            F.array_sort(F.collect_list(F.struct("page", "section"))).alias("sections"),
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("weak", "page", "ev"))), lambda x: x["ev"])).alias("evidence"),
            F.array_sort(F.collect_set("note")).alias("notes"),
            F.count_if("weak").alias("thin"),
            F.min("failed").alias("failed"),  # a page that vision cannot read fails the request, and nothing is stored
        )
        n = F.size("selected")
        summary = F.concat(
            F.concat_ws("; ", F.concat(F.lit("PDF `"), F.col("name"), F.lit("`: "), F.col("total_pages").cast("string"), F.lit(" page(s), "), n.cast("string"), F.lit(" selected")), F.when(n > F.col("thin"), F.concat((n - F.col("thin")).cast("string"), F.lit(" read from the embedded text layer"))), F.when(F.col("thin") > 0, F.concat(F.col("thin").cast("string"), F.lit(f" below the text-density threshold ({settings.pdf_min_chars_per_page} chars/page) handled by fallback")))),
            F.lit("."),
        )
        capped = cut_note("document", "page", "processed", F.col("pages"), F.col("total_pages"), F.col("asked"), n)
        lost = F.when(F.array_contains("notes", "no fallback"), "Some pages have little text and no OCR or vision backend is available.")
        return bad.unionByName(self._result(gathered, summary=summary, content_markdown=F.array_join(F.transform("sections", lambda x: x["section"]), "\n\n"), evidence=F.col("evidence"), warnings=F.array_compact(F.array(capped, lost)), fallbacks_used=F.filter("notes", lambda x: x != "no fallback"), error=F.col("failed")))

    def _languages(self) -> tuple[str, list[str]]:
        return installed_languages(self.settings.languages, self.ocr.languages())

    def _look(self, asked: DataFrame) -> DataFrame:
        """Adds reply, vision_error, served_by, vision_notes and the parsed reply ``__a``; rows with an image_error are not sent."""
        s = self.settings
        if isinstance(self.vision, HttpVision):
            body = F.when(F.col("image_error").isNull(), provider.payload(F.lit(self.vision.model), F.col("prompt"), F.lit(provider.SYSTEM), F.col("images"), s.vision_max_output_tokens))
            replied = converse(asked, self.vision, body)
        else:
            replied = look(asked, self.vision, s.vision_max_output_tokens, seconds=s.vision_timeout_seconds).withColumns({"served_by": F.lit(self.vision.model), "vision_notes": none_of("array<string>")})
        return replied.withColumn("__a", provider.parse_reply(F.coalesce("reply", F.lit(""))))

    def _image(self, rows: DataFrame) -> DataFrame:
        """The pixel gate, then OCR where there is an engine, then what the plan and the reading ask for.

        Sizes come from headers (PNG, GIF, BMP; others from a codec). An image whose size nobody knows passes the gate.
        """
        s, none = self.settings, nothing()
        sized = measured(rows, self.codec, images.image_size(F.col("content")))
        gated = sized.withColumn("gate", images.pixel_error(F.col("size"), s.max_image_pixels))
        languages, missing = self._languages() if self.ocr.available() else (s.languages, [])
        if self.ocr.available():
            read = recognise(gated, self.ocr, languages, seconds=s.process_timeout_seconds, skip="gate")
        else:
            read = gated.withColumns({"ocr_text": none, "ocr_confidence": nothing("double"), "ocr_error": none})
        read = stage(read, "recognised")  # several branches read it
        ran = F.col("ocr_text").isNotNull()
        text = F.coalesce(rstrip(F.col("ocr_text")), F.lit(""))
        blank = strip(text) == ""
        way = resolution(F.col("plan"), ran, F.lit(self.vision_usable), F.col("intent"), F.coalesce(ocr_good_enough(F.length(text), F.col("ocr_confidence")), F.lit(False)))
        sent = read.withColumn("way", F.when(F.col("gate").isNotNull(), "gate").otherwise(way))
        evidence = item("ocr", F.col("name"), F.when(~blank, F.substring(text, 1, 1500)).otherwise("(no text recognised)"), F.col("ocr_confidence"))
        label = F.concat(F.lit(f"OCR ({self.ocr.name} {self.ocr.version}, languages {languages}) recovered "), F.format_number(F.length(text), 0), F.lit(" characters"), F.when(F.col("ocr_confidence").isNotNull(), F.format_string(", mean engine confidence %.0f%%", F.bround(F.col("ocr_confidence") * 100, 0))).otherwise(", confidence not reported by the engine"), F.lit("."))
        asked_in_vain = F.coalesce(F.col("question"), F.lit("")) != ""
        paged = F.when(F.coalesce("pages", F.lit("")) != "", "The 'pages' parameter does not apply to images and was ignored.")
        foreign = F.lit(f"The OCR languages {', '.join(missing)} are not installed; {languages} was used instead.") if missing else none
        scope = [
            F.lit("This is a transcription by OCR: it holds the characters that were recognised and nothing of what the image shows."),
            F.when(blank, "OCR found no text. If the image is a screen, a chart or a diagram, ask again in mode 'vision' (a provider and its permission are needed)."),
            F.when(asked_in_vain, "OCR answers no questions; the transcription is raw evidence for the one that was asked."),
        ]
        degraded = F.when(F.col("way") == "ocr_degraded", "The image was not looked at, because no vision backend may be used.")
        fallbacks = F.when(F.col("way") == "ocr_local", F.array(F.lit("ocr answered locally"))).when(F.col("way") == "ocr_degraded", F.array(F.lit("vision unavailable; degraded to OCR-only output"))).otherwise(none_of("array<string>"))
        local = self._result(
            sent.where("way IN ('ocr', 'ocr_local', 'ocr_degraded')"),
            summary=label, answer=F.when(F.col("way") == "ocr_local", text), content_markdown=F.when(blank, "_(no text recognised)_").otherwise(fenced(text)), evidence=F.array(evidence),
            warnings=F.array_compact(F.array(paged, foreign, *scope, degraded)), fallbacks_used=fallbacks,
        )
        out = local.unionByName(self._result(sent.where("way IN ('error', 'gate')"), summary=F.lit(""), content_markdown=F.lit(""), evidence=none_of(EVIDENCE), error=F.coalesce("gate", "ocr_error", F.lit("VISION_NOT_CONFIGURED"))))
        if not self.vision_usable:
            return out
        most = s.vision_max_dimension
        chosen = sent.where("way = 'vision'").withColumns({"shots": images.shots(F.col("size"), F.lit("image"), F.col("profile"), most), "plan_note": images.plan_note(F.col("size"), F.col("profile"), most)})
        ready = prepare(chosen, self.codec, s.vision_image_format, s.vision_max_image_bytes, F.col("mime_type"))
        candidate = F.when(~blank & F.lit(s.send_ocr_to_cloud), text)
        replied = self._look(ready.withColumn("prompt", provider.prompt(F.col("profile"), F.col("question"), F.col("detail"), None, None, F.coalesce(candidate, F.lit("")))))
        notes = [
            F.when(F.col("ocr_error").isNotNull(), F.concat(F.lit("OCR failed ("), F.col("ocr_error"), F.lit("); the reading rests on vision alone."))),
            F.when(~blank & ~F.lit(s.send_ocr_to_cloud), "The OCR text was not sent to the provider (send_ocr_to_cloud is off); it is given below."),
            F.when(~F.col("__a.structured"), "The reply does not have the sections that were asked for; what is seen and what is concluded may be mixed."),
        ]
        visual = F.transform("__a.exact_text", lambda x: item("visual", F.col("name"), F.substring(x, 1, 1500)))
        guesses = F.transform("__a.inferences", lambda x: item("inference", none, F.substring(x, 1, 800)))
        unsent = F.when(~F.lit(s.send_ocr_to_cloud), text).otherwise("")
        seen = self._result(
            replied,
            summary=F.col("__a.summary"), answer=F.col("__a.answer"), content_markdown=provider.vision_markdown(F.col("__a"), unsent),
            evidence=F.concat(F.array_compact(F.array(F.when(~blank, evidence))), visual, guesses), fallbacks_used=F.array(F.lit("vision")), model=F.col("served_by"),
            warnings=F.concat(F.array_compact(F.array(paged, F.col("plan_note"), *notes, F.when(~blank, foreign))), F.col("vision_notes")),
            error=F.coalesce("image_error", "vision_error", F.when(strip(F.coalesce("reply", F.lit(""))) == "", "VISION_EMPTY_RESPONSE")),
        )
        return out.unionByName(seen)

    def render(self, answered: DataFrame, elapsed_ms: int | None = None) -> DataFrame:
        """Answers as rows; ``elapsed_ms`` is the time of the whole batch, since requests are not processed one by one."""
        own = lambda c: F.replace(c, F.lit(NAME), F.coalesce("name", F.lit("")))
        named = answered.withColumns({"summary": own(F.col("summary")), "evidence": F.transform("evidence", lambda e: e.withField("location", own(e["location"])))})
        out = assemble(named).withColumn("error", error_struct(F.col("error"), refusal(F.col("category")), F.col("category")))
        return out.select(
            "request_id", F.col("error").isNull().alias("success"),
            F.struct("path", "name", "mime_type", "category", "size_bytes", "modified_at", "sha256").alias("source"),
            F.struct("question", "mode", "vision_profile", "pages", "detail", "max_chars").alias("request"),
            F.struct("processor", "processor_version", "model", (F.col("cache_status") == "hit").alias("cached"), "fallbacks_used", F.lit(elapsed_ms).cast("long").alias("duration_ms")).alias("processing"),
            "summary", F.when(F.col("error").isNull(), F.col("markdown")).otherwise(error_markdown(F.col("error"))).alias("markdown"),
            "evidence", "warnings", "truncation", "cache_key", "error",
        )


def requests_for(paths: DataFrame, **defaults) -> DataFrame:
    """Requests for a column ``path``; what isn't there gets its default."""
    base = {"question": nothing(), "mode": F.lit("auto"), "vision_profile": F.lit("auto"), "pages": nothing(), "detail": F.lit("normal"), "max_chars": F.lit(100_000), "force_refresh": F.lit(False)}
    columns = {k: defaults[k] if k in defaults else v for k, v in base.items()}
    rows = paths.withColumns({k: F.lit(v) if not isinstance(v, Column) else v for k, v in columns.items() if k not in paths.columns})
    return rows if "request_id" in paths.columns else rows.withColumn("request_id", F.col("path"))
