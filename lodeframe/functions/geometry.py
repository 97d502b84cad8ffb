"""How an image too large for a provider is cut or scaled. Numbers only; pixels are the backend's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tiles overlap by so many pixels, there are so many at most, and only long images are tiled.
OVERLAP, MOST_TILES, LONG_ASPECT = 96, 4, 2.5


def tile_count(width: Column, height: Column, limit: int) -> Column:
    """Tiles along the long axis; 0 where tiling doesn't help."""
    long, short = F.greatest(width, height), F.least(width, height)
    n = F.greatest(F.lit(1), F.ceil((long - OVERLAP) / (limit - OVERLAP)).cast("int"))
    return F.when((short > limit) | (n > MOST_TILES), 0).otherwise(n)


def is_long(width: Column, height: Column) -> Column:
    return F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height)) >= LONG_ASPECT


def payload_plan(width: Column, height: Column, limit: int) -> Column:
    """as_is, tiles or downscale."""
    n = tile_count(width, height, limit)
    return F.when(F.greatest(width, height) <= limit, "as_is").when(is_long(width, height) & (n > 0), "tiles").otherwise("downscale")


def tiles(width: Column, height: Column, limit: int) -> Column:
    """array<struct<tile, x, y, w, h>>, numbered from 1; an image that isn't tiled has none."""
    step = limit - OVERLAP
    vertical = height >= width
    long = F.greatest(width, height)

    def cut(k: Column) -> Column:
        start = k * step
        size = F.least(start + limit, long) - start
        return F.struct(
            (k + 1).cast("int").alias("tile"),
            F.when(vertical, 0).otherwise(start).cast("int").alias("x"),
            F.when(vertical, start).otherwise(0).cast("int").alias("y"),
            F.when(vertical, width).otherwise(size).cast("int").alias("w"),
            F.when(vertical, size).otherwise(height).cast("int").alias("h"),
        )

    n = F.when(payload_plan(width, height, limit) == "tiles", tile_count(width, height, limit)).otherwise(0)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), cut)).otherwise(F.array().cast("array<struct<tile:int,x:int,y:int,w:int,h:int>>"))


def scaled(width: Column, height: Column, limit: int) -> Column:
    """struct<w, h> with the longest side at the limit, rounded half to even."""
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(width, height))
    side = lambda c: F.greatest(F.lit(1), F.bround(c * scale).cast("int"))
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def multipass(width: Column, height: Column, limit: int) -> Column:
    """Images that a detailed reading sends: an overview and the tiles of a long and oversized image, else one."""
    many = is_long(width, height) & (F.greatest(width, height) > limit)
    return F.when(many, 1 + tile_count(width, height, limit)).otherwise(1)


def png_size(content: Column) -> Column:
    """struct<width, height> from a PNG's header; no pixel is decoded."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def was_downscaled(width: Column, height: Column, original_width: Column, original_height: Column) -> Column:
    return (F.coalesce(original_width, width) > width) | (F.coalesce(original_height, height) > height)
