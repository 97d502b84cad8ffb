"""Pixels behind a seam: a codec cuts, scales and encodes; here is only the policy of formats and sizes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .convert import append

#: One image of a request, as ``functions.provider.payload`` takes it.
IMAGE = "struct<mime:string,content:binary,label:string,role:string,x:int,y:int,w:int,h:int,original_w:int,original_h:int>"
ARROW_IMAGE = pa.struct([("mime", pa.string()), ("content", pa.binary()), ("label", pa.string()), ("role", pa.string()), *[(k, pa.int32()) for k in ("x", "y", "w", "h", "original_w", "original_h")]])


class Codec(Protocol):
    def size(self, content: bytes) -> tuple[int, int]:
        """Width and height from the header; pixels are not decoded."""
        ...

    def encode(self, content: bytes, box: tuple[int, int, int, int] | None, size: tuple[int, int], form: str) -> bytes:
        """The part ``box`` (x, y, width, height; None: all) at ``size``, as ``png`` or ``jpeg``."""
        ...


@dataclass
class FakeCodec:
    """Says what it was asked for, padded to ``png`` or ``jpeg`` bytes a pixel."""

    png: float = 0.0
    jpeg: float = 0.0

    def size(self, content: bytes) -> tuple[int, int]:
        raise ValueError("only headers that the engine reads itself")

    def encode(self, content: bytes, box: tuple[int, int, int, int] | None, size: tuple[int, int], form: str) -> bytes:
        said = f"{form} {','.join(map(str, box or ()))} {size[0]}x{size[1]}".encode()
        return said.ljust(int(size[0] * size[1] * getattr(self, form)), b".")


def fitted(codec: Codec, content: bytes, box: tuple[int, int, int, int] | None, size: tuple[int, int], form: str, most: int) -> tuple[str, bytes]:
    """(MIME type, bytes) of at most ``most`` bytes.

    ``auto`` is PNG, or JPEG where PNG is too large; what is still too large
    shrinks by the square root of the excess, and a little more, until it fits.
    """
    while True:
        tried = "jpeg" if form == "jpeg" else "png"
        data = codec.encode(content, box, size, tried)
        if form == "auto" and len(data) > most:
            tried = "jpeg"
            data = codec.encode(content, box, size, tried)
        if len(data) <= most:
            return f"image/{tried}", data
        if size == (1, 1):
            raise ValueError("one pixel is over the limit")
        scale = (most / len(data)) ** 0.5 * 0.95
        size = max(1, round(size[0] * scale)), max(1, round(size[1] * scale))


def measured(rows: DataFrame, codec: Codec | None, size: Column, content: str = "content") -> DataFrame:
    """Adds ``size``: what the header says, else what the codec says, else null."""
    named = rows.withColumn("size", size)
    if codec is None:
        return named

    def ask(data: bytes | None, known: dict | None) -> dict | None:
        if known is not None or data is None:
            return known
        try:
            w, h = codec.size(data)
            return {"width": w, "height": h}
        except Exception:  # a format that the codec does not know
            return None

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        at = b.schema.names.index
        found = [ask(d, k) for d, k in zip(b.column(at(content)).to_pylist(), b.column(at("__known")).to_pylist(), strict=True)]
        return [pa.array(found, pa.struct([("width", pa.int64()), ("height", pa.int64())]))]

    return append(named.withColumnRenamed("size", "__known"), "size struct<width:bigint,height:bigint>", make).drop("__known")


def prepare(rows: DataFrame, codec: Codec | None, form: str, most: int, mime: Column, content: str = "content") -> DataFrame:
    """Adds ``images`` (array<IMAGE>) and ``image_error`` for the column ``shots``.

    Without a codec only what needs no work is sent: one shot at its own size
    and within the budget of bytes. The rest is IMAGE_DECODE_FAILED.
    """
    if codec is None:
        shot = F.get("shots", 0)
        kept = (F.size("shots") == 1) & (F.octet_length(content) <= most) & F.coalesce((shot["out_w"] == shot["original_w"]) & (shot["out_h"] == shot["original_h"]), F.lit(True))
        one = F.struct(mime.alias("mime"), F.col(content).alias("content"), *[shot[k].alias(k) for k in ("label", "role", "x", "y", "w", "h", "original_w", "original_h")]).cast(IMAGE)
        return rows.withColumns({"images": F.when(kept, F.array(one)).otherwise(F.array().cast(f"array<{IMAGE}>")), "image_error": F.when(~F.coalesce(kept, F.lit(False)), "IMAGE_DECODE_FAILED")})

    def encoded(data: bytes, kind: str, shot: dict) -> dict:
        own = {k: shot[k] for k in ("label", "role", "x", "y", "w", "h", "original_w", "original_h")}
        if shot["out_w"] is None:  # a size that nobody knows: the file as it is
            if len(data) > most:
                raise ValueError("too large, and of unknown size")
            return own | {"mime": kind, "content": data}
        box = None if shot["x"] is None else (shot["x"], shot["y"], shot["w"], shot["h"])
        got, body = fitted(codec, data, box, (shot["out_w"], shot["out_h"]), form, most)
        return own | {"mime": got, "content": body}

    def all_of(data: bytes, kind: str, wanted: list[dict]) -> tuple:
        try:
            return [encoded(data, kind, s) for s in wanted], None
        except Exception:  # a file that cannot be decoded is that row's error
            return [], "IMAGE_DECODE_FAILED"

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        at = b.schema.names.index
        found = [all_of(*x) for x in zip(*(b.column(at(n)).to_pylist() for n in (content, "__mime", "shots")), strict=True)]
        return [pa.array([f[0] for f in found], pa.list_(ARROW_IMAGE)), pa.array([f[1] for f in found], pa.string())]

    return append(rows.withColumn("__mime", mime), f"images array<{IMAGE}>, image_error string", make).drop("__mime")
