"""Rectangles, colours and scales, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def box(x: Column | str, y: Column | str, w: Column | str, h: Column | str) -> Column:
    x, y, w, h = (F.col(c) if isinstance(c, str) else c for c in (x, y, w, h))
    return rect(x, y, x + w, y + h)


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def touches(a: Column, b: Column) -> Column:
    """Closed rectangles: touching edges intersect."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def overlaps(a: Column, b: Column) -> Column:
    """Open rectangles: a positive area is common."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without a positive overlap."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    both = w * h
    union = area(a) + area(b) - both
    return F.when((w > 0) & (h > 0) & (union > 0), both / union).otherwise(0.0)


def fraction_rect(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box in fractions of the page, in points."""
    return rect(x * width, y * height, (x + w) * width, (y + h) * height)


def highlight_rect(r: Column, width: Column, height: Column) -> Column:
    """Padded by 2 % of its width and 15 % of its height, 0.8 at least, within the page."""
    px = F.greatest(F.lit(0.8), 0.02 * (r["x1"] - r["x0"]))
    py = F.greatest(F.lit(0.8), 0.15 * (r["y1"] - r["y0"]))
    return rect(F.greatest(F.lit(0.0), r["x0"] - px), F.greatest(F.lit(0.0), r["y0"] - py), F.least(width, r["x1"] + px), F.least(height, r["y1"] + py))


def strike_y(r: Column) -> Column:
    return r["y0"] + 0.52 * (r["y1"] - r["y0"])


def line_thickness(r: Column) -> Column:
    return F.least(F.lit(2.5), F.greatest(F.lit(0.8), 0.12 * (r["y1"] - r["y0"])))


def underline_y(r: Column, height: Column, manual: Column) -> Column:
    """Below words, within the page; above the lower edge of a box drawn by hand."""
    return F.when(manual, r["y1"] - F.greatest(F.lit(1.0), 0.08 * (r["y1"] - r["y0"]))).otherwise(F.least(r["y1"] + 1.3, height - 1))


def color_hex(value: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFF)))), 6, "0"))


def hex_channels(c: Column) -> Column:
    """Red, green and blue from 0 to 1; white for what isn't six digits."""
    h = F.regexp_replace(F.trim(c), "^#", "")

    def part(i: int) -> Column:
        return F.round(F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("double") / 255, 6)

    ok = h.rlike("^[0-9A-Fa-f]{6}$")
    return F.when(ok, F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))).otherwise(F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("g"), F.lit(1.0).alias("b")))


def progress(done: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(done / F.greatest(F.lit(1), total) * 100))).cast("int")
