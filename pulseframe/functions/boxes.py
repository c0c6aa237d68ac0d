"""Crop boxes: struct<left, top, right, bottom, method>, whole pixels, halves rounded to even.

Each step is a projection of plain columns that the next one reads, so nothing is computed twice and all of it is compiled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A face's box is enlarged by these factors, within these pixels.
WIDER, WIDTHS = 2.75, (390.0, 650.0)
HIGHER, HEIGHTS = 3.35, (470.0, 680.0)
ABOVE = 0.40  #: share of a box that lies above the face's centre
FALLBACK, DETECTED = "fallback_complete_visible_face", "opencv_haar"


def _whole(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def _clamped(df: DataFrame, to: str, left: str | Column, top: str | Column, width: str | Column, height: str | Column) -> DataFrame:
    """Adds {to}left, {to}top, {to}right and {to}bottom: the box within the image _w x _h, one pixel at least."""
    left, top, width, height = (F.col(x) if isinstance(x, str) else x for x in (left, top, width, height))
    df = df.withColumns({f"{to}{name}": _whole(F.greatest(F.lit(0.0), F.least(a, F.col(size) - 1.0))) for name, a, size in (("left", left, "_w"), ("top", top, "_h"))})
    ends = (("right", "left", left, width, "_w"), ("bottom", "top", top, height, "_h"))
    return df.withColumns({f"{to}{end}": _whole(F.greatest(F.col(f"{to}{start}") + 1.0, F.least(a + size, F.col(image)))) for end, start, a, size, image in ends})


def _box(prefix: str, method: Column) -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("left", "top", "right", "bottom")], method.alias("method"))


def _within(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """The image's size, and the box for images without a found face: most of the middle."""
    df = df.withColumns({"_w": width.cast("double"), "_h": height.cast("double")})
    return _clamped(df, "_n_", F.col("_w") * 0.5 - F.col("_w") * 0.56 / 2, F.col("_h") * 0.08, F.col("_w") * 0.56, F.col("_h") * 0.92)


def best_face(faces: Column, image_w: Column, image_h: Column) -> Column:
    """Of array<struct<x, y, w, h>>: the first of the best score (area less distance from the centre) among faces whose
    centre lies in the middle of the image; null without one."""
    cx, cy = (lambda f: f["x"] + f["w"] / 2), (lambda f: f["y"] + f["h"] / 2)
    central = F.filter(faces, lambda f: cx(f).between(image_w * 0.34, image_w * 0.74) & cy(f).between(image_h * 0.12, image_h * 0.78))
    score = lambda f: f["w"] * f["h"] - (F.abs(cx(f) - image_w * 0.50) * 90.0 + F.abs(cy(f) - image_h * 0.45) * 35.0)
    scored = F.transform(central, lambda f, i: F.struct(score(f).alias("score"), (-i).alias("first"), f.alias("face")))
    return F.array_max(scored)["face"]


def with_crop_box(df: DataFrame, faces: Column, width: Column, height: Column, name: str = "box") -> DataFrame:
    """Adds the crop box around the best of the faces: large enough for a whole face (42 % by 68 % of the image), down to 90 % of
    the image, and to its end if little is missing above 95 %; without a face the middle of the image."""
    kept = [c for c in df.columns if c != name]
    df = _within(df, width, height)
    df = df.withColumn("_f", best_face(faces, F.col("_w"), F.col("_h")))
    df = df.withColumns({"_fw": F.greatest(F.lit(WIDTHS[0]), F.least(F.lit(WIDTHS[1]), F.col("_f.w") * WIDER)), "_fh": F.greatest(F.lit(HEIGHTS[0]), F.least(F.lit(HEIGHTS[1]), F.col("_f.h") * HIGHER))})
    df = df.withColumns({"_fl": F.col("_f.x") + F.col("_f.w") / 2 - F.col("_fw") / 2, "_ft": F.col("_f.y") + F.col("_f.h") / 2 - F.col("_fh") * ABOVE})
    df = _clamped(df, "_a_", "_fl", "_ft", "_fw", "_fh")
    df = df.withColumns({"_ew": F.greatest(F.col("_a_right") - F.col("_a_left"), F.col("_w") * 0.42), "_eh": F.greatest(F.col("_a_bottom") - F.col("_a_top"), F.col("_h") * 0.68)})
    df = df.withColumns({"_el": (F.col("_a_left") + F.col("_a_right")) / 2 - F.col("_ew") / 2, "_et": (F.col("_a_top") + F.col("_a_bottom")) / 2 - F.col("_eh") * ABOVE})
    df = df.withColumn("_eb", F.greatest(F.col("_et") + F.col("_eh"), F.col("_h") * 0.90))
    df = df.withColumns({"_et": F.col("_et") - F.greatest(F.col("_eb") - F.col("_h"), F.lit(0.0)), "_eb": F.least("_eb", "_h")})
    df = _clamped(df, "_b_", "_el", "_et", "_ew", F.col("_eb") - F.col("_et"))
    df = _clamped(df, "_c_", F.col("_b_left").cast("double"), F.col("_b_top").cast("double"), (F.col("_b_right") - F.col("_b_left")).cast("double"), F.col("_h") - F.col("_b_top"))
    found = F.when(F.col("_b_bottom") < F.floor(F.col("_h") * 0.95), _box("_c_", F.lit(DETECTED))).otherwise(_box("_b_", F.lit(DETECTED)))
    return df.select(*kept, F.when(F.col("_f").isNotNull(), found).otherwise(_box("_n_", F.lit(FALLBACK))).alias(name))


def with_given_box(df: DataFrame, edges: dict[str, Column], width: Column, height: Column, method: Column, name: str = "box") -> DataFrame:
    """Adds the box of given left, top, right and bottom within the image; where left is null, the middle of the image."""
    kept = [c for c in df.columns if c != name]
    df = _within(df.withColumns({f"_g_{k}": c.cast("double") for k, c in edges.items()} | {"_method": method}), width, height)
    df = _clamped(df, "_a_", "_g_left", "_g_top", F.col("_g_right") - F.col("_g_left"), F.col("_g_bottom") - F.col("_g_top"))
    return df.select(*kept, F.when(F.col("_g_left").isNull(), _box("_n_", F.lit(FALLBACK))).otherwise(_box("_a_", F.col("_method"))).alias(name))
