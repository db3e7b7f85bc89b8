"""Metadata, merged task records, and scales of boxes and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

METADATA = ("title", "author", "subject", "keywords")


def read_metadata(columns: tuple[str, ...] = METADATA) -> list[Column]:
    """The four fields, trimmed; what is missing is empty."""
    return [F.coalesce(strip(c), F.lit("")).alias(c) for c in columns]


def write_metadata(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Documents (doc_id, fields) with the fields of ``changes``, trimmed, in place of their own; others stay."""
    new = changes.select("doc_id", *[strip(c).alias(f"new_{c}") for c in METADATA])
    return docs.join(new, "doc_id", "left").select("doc_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in METADATA])


def merge_tasks(jobs: DataFrame, tasks: DataFrame, carried: list[str]) -> DataFrame:
    """Jobs with fields that their task rows already hold and they don't."""
    own = tasks.select("job_id", *[F.col(c).alias(f"old_{c}") for c in carried])
    return jobs.join(own, "job_id", "left").select(*[c for c in jobs.columns if c not in carried], *[F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) for c in carried])


def in_order(*frames: DataFrame) -> DataFrame:
    """A bag union that keeps the frames' order in ``part``."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("part", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def shown_images(images: DataFrame) -> DataFrame:
    """Images without embedded data are left out below 25 x 25 points."""
    small = (F.col("bbox.x1") - F.col("bbox.x0") < 25) & (F.col("bbox.y1") - F.col("bbox.y0") < 25)
    return images.where(~(small & ~F.coalesce(F.col("image_key").startswith("data:"), F.lit(False))))


def pixels(points: Column, dpi: Column | int) -> Column:
    return points * F.lit(dpi) / 72


def baseline(y: Column, height: Column) -> Column:
    """Where characters give none: 85 % down the box."""
    return y + 0.85 * height


def decoration(y: Column, size: Column) -> list[Column]:
    """Underline, strike line and their width around a baseline."""
    return [(y + 0.12 * size).alias("underline_y"), (y - 0.28 * size).alias("strike_y"), F.greatest(F.lit(0.8), 0.06 * size).alias("line_width")]


def ocr_font_size(word_heights: Column) -> Column:
    return 1.15 * F.array_max(word_heights)


def contrast(mean: Column, deviation: Column) -> Column:
    """How a page image is prepared: flat ones are stretched, dark ones levelled."""
    return F.when(deviation < 35, "enhance").when(mean < 100, "autocontrast").otherwise("none")


def preview_scale(width: Column, height: Column, dpi: int = 120, longest: int = 1600) -> Column:
    """Zoom of a preview: its resolution, or less where the longest edge would exceed its bound."""
    return F.least(F.lit(dpi / 72), F.lit(longest) / F.greatest(width, height))
