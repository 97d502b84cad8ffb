"""A chat-completions provider behind a transport. Bodies are built and replies are read as expressions; here they only travel."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import provider
from ..settings import Settings
from .convert import append

#: Largest reply that is read, in bytes.
MOST_BYTES = 8 << 20
#: Codes of what fails before there is a status, and whether it is tried again.
UNANSWERED = {"timeout": "VISION_PROVIDER_TIMEOUT", "network": "VISION_PROVIDER_ERROR"}


@dataclass
class Reply:
    """A status and a body; or no status, and ``failure`` is timeout or network."""

    status: int | None
    body: str = ""
    retry_after: str | None = None
    failure: str | None = None


class Transport(Protocol):
    def post(self, body: str, timeout: float) -> Reply: ...


@dataclass
class HttpTransport:
    """POST to ``<address>/chat/completions``. The key is in no log, no plan and no repr; it travels inside the pickled task."""

    address: str
    key: str = field(repr=False)
    headers: dict[str, str] = field(default_factory=dict, repr=False)

    def post(self, body: str, timeout: float) -> Reply:
        import urllib.error
        import urllib.request

        asked = urllib.request.Request(f"{self.address}/chat/completions", body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}", **self.headers})
        try:
            with urllib.request.urlopen(asked, timeout=timeout) as got:
                return Reply(got.status, got.read(MOST_BYTES + 1).decode("utf-8", "replace"))
        except urllib.error.HTTPError as refused:
            return Reply(refused.code, refused.read(4096).decode("utf-8", "replace"), refused.headers.get("Retry-After"))
        except TimeoutError:
            return Reply(None, failure="timeout")
        except urllib.error.URLError as lost:
            return Reply(None, failure="timeout" if isinstance(lost.reason, TimeoutError) else "network")


@dataclass
class FakeTransport:
    """``answer(body)`` is the reply; nothing leaves the process."""

    answer: Callable[[str], Reply]

    def post(self, body: str, timeout: float) -> Reply:
        return self.answer(body)


@dataclass
class HttpVision:
    """A vision backend that the engine talks to by request bodies. ``wait`` sleeps between attempts."""

    transport: Transport
    model: str
    timeout: float = 60.0
    max_retries: int = 1
    wait: Callable[[float], None] = time.sleep


def vision_from(settings: Settings, transport: Transport | None = None) -> HttpVision | None:
    """The provider that the settings configure, None if they do not. Building it opens no connection."""
    if not settings.vision_configured:
        return None
    return HttpVision(transport or HttpTransport(settings.base_url, settings.vision_api_key), settings.model, settings.vision_timeout_seconds, settings.vision_max_retries)


def delay(attempt: int, retry_after: str | None, share: float) -> float:
    """Seconds before an attempt (from 1): what the provider asks for or 0.5 * 2 ** attempt, 4 at most; of that, half to all."""
    asked = retry_after if retry_after and retry_after.isascii() and retry_after.isdigit() and int(retry_after) else None
    return (float(asked) if asked else min(4.0, 0.5 * 2**attempt)) * (0.5 + share / 2)


def converse(rows: DataFrame, vision: HttpVision, body: Column) -> DataFrame:
    """Adds reply, vision_error, served_by and vision_notes.

    Only timeouts, lost connections and the statuses marked so in
    ``provider.STATUS`` are tried again, ``max_retries`` times at most. Calls
    cost money: the rows are written by the engine before they are used twice.
    """

    def again(reply: Reply) -> bool:
        return reply.status is None or provider.STATUS.get(reply.status, ("", False))[1]

    def one(words: str | None) -> tuple:
        if words is None:
            return None, None, None, 0
        attempt = 0
        while True:
            reply = vision.transport.post(words, vision.timeout)
            if not again(reply) or attempt >= vision.max_retries:
                break
            attempt += 1
            vision.wait(delay(attempt, reply.retry_after, random.random()))
        long = reply.status == 200 and len(reply.body.encode()) > MOST_BYTES
        failure = "VISION_INVALID_RESPONSE" if long else None if reply.status is not None else UNANSWERED.get(reply.failure or "", "VISION_PROVIDER_ERROR")
        return reply.status, None if long else reply.body, failure, attempt + 1

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        found = [one(x) for x in b.column(b.schema.names.index("__asked")).to_pylist()]
        return [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int32()))]

    posted = append(rows.withColumn("__asked", body), "__status int, __body string, __lost string, attempts int", make).drop("__asked")
    read = posted.withColumns({"__read": provider.parse_completion(F.col("__body")), "__report": provider.completion_report(F.col("__body"))})
    refused = F.when(F.col("__status") != 200, provider.http_error(F.col("__status"), F.col("__body"))["code"])
    short = F.when(F.col("__report.finish") == "length", "The model stopped at its limit of output tokens (vision_max_output_tokens); the reading is not complete.")
    error = F.coalesce(F.col("__lost"), refused, F.col("__read.error"))
    added = {"vision_error": error, "reply": F.when(error.isNull(), F.col("__read.text")), "served_by": F.coalesce("__report.model", F.lit(vision.model)), "vision_notes": F.array_compact(F.array(short)), "input_tokens": F.col("__report.input_tokens"), "output_tokens": F.col("__report.output_tokens")}
    return read.withColumns(added).drop("__status", "__body", "__lost", "__read", "__report")
