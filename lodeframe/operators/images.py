"""What of an image goes to a vision provider: the pixel gate and the shots of a plan. Numbers only; pixels are the codec's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import is_long, payload_plan, png_size, scaled, tile_count, tiles

#: Profiles that read long screens in several passes. Fixed values.
UI_PROFILES = ("ui_screenshot", "ui_structure", "ui_alignment", "ui_grounding")
SHOT = "struct<role:string,label:string,x:int,y:int,w:int,h:int,out_w:int,out_h:int,original_w:int,original_h:int>"


def image_size(content: Column) -> Column:
    """struct<width, height> from the header of a PNG, GIF or BMP; null for other formats and for cut headers."""

    def little(at: int, length: int) -> Column:
        turned = F.concat(*[F.hex(F.substring(content, at + k, 1)) for k in reversed(range(length))])
        return F.conv(turned, 16, 10).cast("long")

    head = F.hex(F.substring(content, 1, 6))
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    whole = F.octet_length(content)
    gif = F.when(head.isin("474946383761", "474946383961") & (whole >= 10), size(little(7, 2), little(9, 2)))
    # A BMP's height is negative where its rows run from the top.
    signed = lambda c: F.abs(F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c))
    bmp = F.when(head.startswith("424D") & (whole >= 26), size(little(19, 4), signed(little(23, 4))))
    return F.coalesce(F.when(whole >= 24, png_size(content)), gif, bmp)


def pixel_error(size: Column, most: int) -> Column:
    """IMAGE_DECODE_FAILED for a size of nothing, FILE_TOO_LARGE beyond the gate, null otherwise and where the size is not known."""
    return F.when((size["width"] <= 0) | (size["height"] <= 0), "IMAGE_DECODE_FAILED").when(size["width"] * size["height"] > most, "FILE_TOO_LARGE")


def several_passes(profile: Column, width: Column, height: Column, limit: int) -> Column:
    """Whether an overview is sent before the tiles: a long, oversized screen that can be tiled."""
    return profile.isin(*UI_PROFILES) & (payload_plan(width, height, limit) == "tiles")


def shots(size: Column, label: Column, profile: Column, limit: int) -> Column:
    """array<SHOT>: the parts of an image that are sent, in order.

    An image of unknown size is one shot without numbers, which is sent as it is.
    """
    w, h = size["width"].cast("int"), size["height"].cast("int")
    none, number = F.lit(None).cast("string"), lambda c: c.cast("string")
    small = scaled(w, h, limit)
    part = lambda role, said, x, y, pw, ph, ow, oh: F.struct(role.alias("role"), said.alias("label"), x.alias("x"), y.alias("y"), pw.alias("w"), ph.alias("h"), ow.alias("out_w"), oh.alias("out_h"), w.alias("original_w"), h.alias("original_h")).cast(SHOT)
    nowhere = F.lit(None).cast("int")
    one = part(none, label, nowhere, nowhere, w, h, small["w"], small["h"])
    overview = part(F.lit("overview"), F.concat(label, F.lit(" [overview]")), F.lit(0), F.lit(0), w, h, small["w"], small["h"])
    n = number(tile_count(w, h, limit))

    def tile(t: Column) -> Column:
        along = F.when(h >= w, F.concat(F.lit("y="), number(t["y"]), F.lit("-"), number(t["y"] + t["h"]))).otherwise(F.concat(F.lit("x="), number(t["x"]), F.lit("-"), number(t["x"] + t["w"])))
        said = F.concat(label, F.lit(" [tile "), number(t["tile"]), F.lit("/"), n, F.lit(", "), along, F.lit("]"))
        return part(F.lit("detail"), said, t["x"], t["y"], t["w"], t["h"], t["w"], t["h"])

    cut = F.transform(tiles(w, h, limit), tile)
    return F.when(size.isNull() | (payload_plan(w, h, limit) != "tiles"), F.array(one)).when(several_passes(profile, w, h, limit), F.concat(F.array(overview), cut)).otherwise(cut)


def plan_note(size: Column, profile: Column, limit: int) -> Column:
    """What a reader has to know of an image that was not sent as it is; null otherwise."""
    w, h = size["width"].cast("int"), size["height"].cast("int")
    plan, small = payload_plan(w, h, limit), scaled(w, h, limit)
    cut = F.format_string(f"The image (%dx%d) is longer than {limit} pixels and was sent as %d overlapping tiles in full resolution, first to last", w, h, tile_count(w, h, limit))
    shrunk = F.format_string(f"The image was scaled down from %dx%d to %dx%d to fit {limit} pixels; very small text may be lost (mode 'ocr' reads the full resolution).", w, h, small["w"], small["h"])
    return F.when(plan == "tiles", F.concat(cut, F.when(several_passes(profile, w, h, limit), F.format_string(", after an overview of %dx%d.", small["w"], small["h"])).otherwise("."))).when(plan == "downscale", shrunk)
