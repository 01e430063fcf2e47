"""Box arithmetic as Spark Columns.

A box is anything with fields x, y, w, h (top-left origin). Every function
returns a Column and stays inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class ids of a detection, in id order.
CLASSES = ("bubble", "text_bubble", "text_free")


def trunc_int(value: Column) -> Column:
    """Cut toward zero, as CAST does in Spark."""
    return value.cast("int")


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The box inside a width x height image as a struct; null if nothing is left."""
    left, top = F.greatest(F.lit(0), trunc_int(x1)), F.greatest(F.lit(0), trunc_int(y1))
    right, bottom = F.least(width, trunc_int(x2)), F.least(height, trunc_int(y2))
    box = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))
    return F.when((right > left) & (bottom > top), box)


def iou_sql(a: str, b: str) -> str:
    """Intersection over union of two struct expressions, as SQL text for use inside lambdas."""
    ix = f"(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    iy = f"(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    inter = f"cast({ix} * {iy} as double)"
    return f"(case when {ix} <= 0 or {iy} <= 0 then 0.0D else {inter} / ({a}.w * {a}.h + {b}.w * {b}.h - {inter}) end)"


def iou(a: Column, b: Column) -> Column:
    ix = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    iy = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    inter = (ix * iy).cast("double")
    return F.when((ix <= 0) | (iy <= 0), F.lit(0.0)).otherwise(inter / (a.w * a.h + b.w * b.h - inter))


def overlaps(a: Column, b: Column, margin: int = 10) -> Column:
    """True if the boxes meet once each has grown by margin on all sides (so 2*margin of slack)."""
    slack = 2 * margin
    return (a.x < b.x + b.w + slack) & (b.x < a.x + a.w + slack) & (a.y < b.y + b.h + slack) & (b.y < a.y + a.h + slack)


def contains_sql(outer: str, inner: str, tol: int = 10) -> str:
    return (
        f"({inner}.x >= {outer}.x - {tol} and {inner}.y >= {outer}.y - {tol}"
        f" and {inner}.x + {inner}.w <= {outer}.x + {outer}.w + {tol}"
        f" and {inner}.y + {inner}.h <= {outer}.y + {outer}.h + {tol})"
    )


def sane_dpr(dpr: Column) -> Column:
    """Device pixel ratio: anything outside [1, 5] or missing becomes 2."""
    value = dpr.cast("double")
    return F.when(value.between(1, 5), value).otherwise(F.lit(2.0))


def crop_rect(rect: Column, dpr: Column, img_w: Column, img_h: Column) -> Column:
    """Crop in screenshot pixels; the whole image when the crop is missing, empty or at most 15 % of a side."""
    side = lambda field: trunc_int(rect[field] * dpr)
    left = F.greatest(F.lit(0), F.least(side("left"), img_w - 1))
    top = F.greatest(F.lit(0), F.least(side("top"), img_h - 1))
    width, height = F.least(side("width"), img_w - left), F.least(side("height"), img_h - top)
    usable = rect.isNotNull() & (rect["width"] != 0) & (rect["height"] != 0) & (width > img_w * 0.15) & (height > img_h * 0.15)
    fields = ("x", "y", "w", "h")
    crop = F.struct(*(c.alias(n) for n, c in zip(fields, (left, top, width, height), strict=True)))
    whole = F.struct(*(c.cast("int").alias(n) for n, c in zip(fields, (F.lit(0), F.lit(0), img_w, img_h), strict=True)))
    return F.when(usable, crop).otherwise(whole)


def px_to_css(px: Column, offset: Column, dpr: Column) -> Column:
    return F.bround((offset + px) / dpr, 1)


def css_to_px(css: Column, offset: Column, dpr: Column) -> Column:
    return trunc_int(css * dpr) - offset


def unit_to_px(bx: Column, by: Column, bw: Column, bh: Column, img_w: Column, img_h: Column) -> Column:
    """0-1 coordinates with a bottom-left origin to pixels with a top-left origin."""
    return F.struct(
        trunc_int(bx * img_w).alias("x"),
        trunc_int((F.lit(1.0) - by - bh) * img_h).alias("y"),
        trunc_int(bw * img_w).alias("w"),
        trunc_int(bh * img_h).alias("h"),
    )


def padded(box: Column, px: Column, py: Column, img_w: Column, img_h: Column) -> Column:
    """The box grown by px and py on each side, held inside the image."""
    left, top = F.greatest(F.lit(0), box.x - px), F.greatest(F.lit(0), box.y - py)
    right, bottom = F.least(img_w, box.x + box.w + px), F.least(img_h, box.y + box.h + py)
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def crop_pad(side: Column) -> Column:
    return F.greatest(F.lit(5), trunc_int(side * 0.05))


def roi_pad(w: Column, h: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(10), trunc_int(F.greatest(w, h) * 0.12)))


def free_text_pad(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(10), trunc_int(F.greatest(w, h) * 0.10))


def refined(box: Column, component: Column, dark: Column) -> Column:
    """Component box cut to the detection; the detection itself when the component is missing, dark or under 20 % of it."""
    left, top = F.greatest(box.x, component.x), F.greatest(box.y, component.y)
    right = F.least(box.x + box.w, component.x + component.w)
    bottom = F.least(box.y + box.h, component.y + component.h)
    ok = component.isNotNull() & ~dark & (right > left) & (bottom > top)
    ok = ok & (component.w * component.h >= 0.2 * box.w * box.h)
    cut = F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))
    return F.when(ok, cut).otherwise(F.struct(*(box[f].alias(f) for f in "xywh")))


def is_dark(intensity: Column) -> Column:
    return F.coalesce(intensity, F.lit(230)) < 128


def class_name(class_id: Column) -> Column:
    out = F.lit("unknown")
    for i, name in reversed(list(enumerate(CLASSES))):
        out = F.when(class_id == i, F.lit(name)).otherwise(out)
    return out


def object_fit_offset(fit: Column, w: Column, h: Column, nat_w: Column, nat_h: Column) -> Column:
    """Slack around an image that is fitted inside its element: struct dx, dy, scale."""
    scale = F.least(w / nat_w, h / nat_h)
    fitted = fit.isin("contain", "scale-down") & (nat_w > 0) & (nat_h > 0)
    return F.struct(
        F.when(fitted, (w - nat_w * scale) / 2).otherwise(0.0).alias("dx"),
        F.when(fitted, (h - nat_h * scale) / 2).otherwise(0.0).alias("dy"),
        F.when(fitted, scale).otherwise(1.0).alias("scale"),
    )


def aligned_overlap(a: Column, b: Column) -> Column:
    """Rectangle that two boxes share, null if none."""
    left, top = F.greatest(a.x, b.x), F.greatest(a.y, b.y)
    w, h = F.least(a.x + a.w, b.x + b.w) - left, F.least(a.y + a.h, b.y + b.h) - top
    return F.when((w > 0) & (h > 0), F.struct(left.alias("x"), top.alias("y"), w.alias("w"), h.alias("h")))
