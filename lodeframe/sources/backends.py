"""Seams for what needs pixels or a network: PDF pages, OCR and vision. The engine is given objects; fakes serve tests."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from .convert import append


@dataclass
class Page:
    number: int
    text: str


@dataclass
class OcrText:
    text: str
    confidence: float | None = None
    engine: str = "none"
    version: str = ""


class PdfBackend(Protocol):
    def count(self, content: bytes) -> int: ...

    def pages(self, content: bytes, numbers: list[int]) -> list[Page]: ...

    def image(self, content: bytes, number: int, dpi: int) -> bytes: ...


class OcrBackend(Protocol):
    name: str
    version: str

    def available(self) -> bool: ...

    def languages(self) -> list[str]: ...

    def recognise(self, image: bytes, languages: str) -> OcrText: ...


class VisionBackend(Protocol):
    """Must bound its own retries, must not retry a cancelled request and must not log secrets."""

    model: str

    def analyze(self, images: list[bytes], prompt: str, max_tokens: int) -> str: ...


@dataclass
class NoOcr:
    name: str = "none"
    version: str = ""

    def available(self) -> bool:
        return False

    def languages(self) -> list[str]:
        return []

    def recognise(self, image: bytes, languages: str) -> OcrText:
        raise RuntimeError("no OCR backend")


@dataclass
class FakeOcr:
    """Says what it is told to say."""

    text: str = "recognised text of the image, long enough to be good"
    confidence: float | None = 0.91
    fails: bool = False
    name: str = "fake"
    version: str = "1"
    known: list[str] = field(default_factory=lambda: ["eng", "vie"])

    def available(self) -> bool:
        return True

    def languages(self) -> list[str]:
        return self.known

    def recognise(self, image: bytes, languages: str) -> OcrText:
        if self.fails:
            raise RuntimeError("told to fail")
        return OcrText(self.text, self.confidence, self.name, self.version)


@dataclass
class FakeVision:
    reply: str = "## ANSWER\nA settings screen.\n\n## DIRECT OBSERVATIONS\n- a Save button\n- an e-mail field\n\n## EXACT TEXT\n- Save\n"
    model: str = "fake-vision"
    error: str | None = None

    def analyze(self, images: list[bytes], prompt: str, max_tokens: int) -> str:
        if self.error:
            raise RuntimeError(self.error)
        return self.reply


@dataclass
class TellingVision:
    """Answers with what it was shown, one image after the other."""

    model: str = "telling-vision"

    def analyze(self, images: list[bytes], prompt: str, max_tokens: int) -> str:
        return "## ANSWER\n" + "; ".join(x.decode() for x in images)


@dataclass
class FakePdf:
    """A file of pages that are kept apart by form feeds, after a %PDF- header line."""

    def _split(self, content: bytes) -> list[str]:
        if not content.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        return content.split(b"\n", 1)[1].decode().split("\f")

    def count(self, content: bytes) -> int:
        return len(self._split(content))

    def pages(self, content: bytes, numbers: list[int]) -> list[Page]:
        every = self._split(content)
        return [Page(n, every[n - 1]) for n in numbers]

    def image(self, content: bytes, number: int, dpi: int) -> bytes:
        return b"\x89PNG" + self._split(content)[number - 1].encode()


def installed_languages(wanted: str, installed: list[str]) -> tuple[str, list[str]]:
    """The wanted languages that are there (else English, else the first), and those that are not."""
    asked = wanted.split("+")
    there = [x for x in asked if x in installed]
    return "+".join(there or [x for x in ("eng",) if x in installed] or installed[:1]), [x for x in asked if x not in installed]


def within(seconds: float | None, work: Callable, *args):
    """The result of ``work``, or TimeoutError. A call that hangs keeps its thread, but neither its row nor its task."""
    if seconds is None:
        return work(*args)
    box: list = []

    def run() -> None:
        try:
            box.append((work(*args), None))
        except Exception as error:  # raised again where it is waited for
            box.append((None, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError
    if box[0][1] is not None:
        raise box[0][1]
    return box[0][0]


def recognise(rows: DataFrame, ocr: OcrBackend, languages: str, image: str = "content", seconds: float | None = None, skip: str | None = None) -> DataFrame:
    """Adds ocr_text, ocr_confidence and ocr_error for a column of images.

    Rows whose column ``skip`` is not null are left alone; a call may take ``seconds``.
    """

    def one(data: bytes, passed: object) -> tuple:
        if passed is not None:
            return None, None, None
        try:
            found = within(seconds, ocr.recognise, data, languages)
            return found.text, found.confidence, None
        except TimeoutError:
            return None, None, "PROCESSING_TIMEOUT"
        except Exception:  # an engine's failure is that row's error
            return None, None, "OCR_FAILED"

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        at = b.schema.names.index
        passed = b.column(at(skip)).to_pylist() if skip else [None] * b.num_rows
        found = [one(x, p) for x, p in zip(b.column(at(image)).to_pylist(), passed, strict=True)]
        return [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.string()))]

    return append(rows, "ocr_text string, ocr_confidence double, ocr_error string", make)


def look(rows: DataFrame, vision: VisionBackend, max_tokens: int, images: str = "images", prompt: str = "prompt", seconds: float | None = None) -> DataFrame:
    """Adds reply and vision_error. Calls cost money: write the result before it is used twice, and leave speculation off.

    ``images`` is an array of structs with ``content``; a row without any is not asked about.
    """

    def one(shown: list[dict] | None, words: str) -> tuple:
        if not shown:
            return None, None
        try:
            return within(seconds, vision.analyze, [x["content"] for x in shown], words, max_tokens), None
        except TimeoutError:
            return None, "VISION_PROVIDER_TIMEOUT"
        except Exception:
            return None, "VISION_PROVIDER_ERROR"

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        at = b.schema.names.index
        found = [one(x, p) for x, p in zip(b.column(at(images)).to_pylist(), b.column(at(prompt)).to_pylist(), strict=True)]
        return [pa.array([f[k] for f in found], pa.string()) for k in range(2)]

    return append(rows, "reply string, vision_error string", make)
