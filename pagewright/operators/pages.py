"""Page statistics, page classes and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PAGE_NUMBER, col, strip

PAGE = ["doc_id", "page_no"]


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """One row a key; the tables hold exact duplicates.

    Rows are placed by page first.  That suits the removal, and the page's joins, windows and groups behind
    it too, so they all share this one exchange.
    """
    if set(PAGE) <= set(keys):
        df = df.repartition(*PAGE)
    return df.dropDuplicates(list(keys))


def page_stats(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Every page with its element count and the parts of its area under text and images, at most 1, to six digits
    (a hair is added, so that sums in any order round alike).

    Image area isn't given in the tables; each image block counts as an eighth of the page.
    """
    area = F.greatest(F.lit(0.0), F.col("e.width") * F.col("e.height"))
    text = elements.alias("e").groupBy(*PAGE).agg(F.count("*").alias("n_elements"), F.sum(area).alias("text_area"))
    out = pages.join(text, PAGE, "left")
    whole = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    return out.select(
        *PAGE, "word_count", "image_block_count", F.coalesce("n_elements", F.lit(0)).cast("long").alias("n_elements"),
        F.round(F.least(F.lit(1.0), F.round(F.coalesce("text_area", F.lit(0.0)), 3) / whole + 1e-12), 6).alias("text_ratio"),
        F.least(F.lit(1.0), F.coalesce("image_block_count", F.lit(0)) / 8).alias("image_ratio"),
    )


def kind_by_area(words: Column, images: Column, image_ratio: Column, text_ratio: Column) -> Column:
    """blank, scanned, text or mixed; mixed needs much image area, or some beside some text."""
    mixed = ((image_ratio >= 0.5) & (text_ratio <= 0.12)) | ((image_ratio >= 0.15) & (text_ratio >= 0.01))
    return F.when((words == 0) & (images == 0), "blank").when(words == 0, "scanned").when(images == 0, "text").when(mixed, "mixed").otherwise("text")


def kind_by_count(words: Column, images: Column) -> Column:
    return F.when((words == 0) & (images == 0), "blank").when(words == 0, "scanned").when(images == 0, "text").otherwise("mixed")


def content_class(chars: Column, image_ratio: Column, text_ratio: Column) -> Column:
    """EMPTY, SCANNED, MIXED, NATIVE or UNCERTAIN; the image part isn't clamped."""
    return (
        F.when((chars == 0) & (image_ratio <= 0.05), "EMPTY")
        .when((chars < 15) & (image_ratio > 0.45), "SCANNED")
        .when((chars >= 15) & (image_ratio > 0.40) & (text_ratio * image_ratio > 0.10), "MIXED")
        .when(chars > 0, "NATIVE")
        .otherwise("UNCERTAIN")
    )


def base_font_size(elements: DataFrame) -> DataFrame:
    """Per document the size, to one digit, that most characters have; of equal ones the first seen; 10 where there are none."""
    counted = elements.select("doc_id", "size", F.length(strip("text")).alias("n"), F.struct("page_no", "element_no").alias("at"))
    counted = counted.withColumn("size", F.when((F.col("n") > 0) & F.col("size").isNotNull(), F.round("size", 1)))
    weights = counted.groupBy("doc_id", "size").agg(F.sum("n").alias("weight"), F.min("at").alias("first"))  # combined before the shuffle
    rank = F.when(F.col("size").isNotNull(), F.struct(-F.col("weight"), "first"))
    return weights.groupBy("doc_id").agg(F.coalesce(F.min_by("size", rank), F.lit(10.0)).alias("base_size"))


def bands(elements: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Elements with their stripped text and band: header in the top 8 %, else footer in the last 10 %.

    Without ``pages`` the elements have page_width and page_height themselves.
    """
    e = elements if pages is None else elements.join(pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height")), PAGE)
    band = F.when(F.col("y") + F.col("height") <= 0.08 * F.col("page_height"), "header").when(F.col("y") >= 0.90 * F.col("page_height"), "footer")
    return e.withColumn("band", band).withColumn("line", strip("text"))


def repeated_bands(banded: DataFrame) -> DataFrame:
    """(doc_id, band, line, n): band texts that stand twice or more in a document; blocks count, not pages."""
    return banded.where("band IS NOT NULL AND line <> ''").groupBy("doc_id", "band", "line").agg(F.count("*").alias("n")).where("n >= 2")


def watermark_score(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, rotated: Column, size: Column, base: Column, opacity: Column, repeated: Column) -> Column:
    """Seven signs' points; 3.5 make a watermark."""
    from ..functions.text import WATERMARKS

    up = F.upper(text)
    word = F.lit(False)
    for w in WATERMARKS:
        word = word | up.contains(w)
    cx, cy = (x0 + x1) / 2 / width, (y0 + y1) / 2 / height
    centred = cx.between(0.2, 0.8) & cy.between(0.25, 0.75)
    points = [(rotated, 2.0), (opacity < 0.6, 2.0), (word, 2.0), (size / base >= 1.4, 1.5), (centred, 1.5), (repeated, 2.0)]
    total = F.lit(0.0)
    for sign, value in points:
        total = total + F.when(sign, value).otherwise(0.0)
    return total


def content_roles(banded: DataFrame, repeated: DataFrame, base: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keys, role, columns to keep): watermark, header, page_number, footer or primary."""
    rep = repeated.select("doc_id", "band", "line", F.lit(True).alias("again"))
    rows = banded.join(rep, ["doc_id", "band", "line"], "left").join(base, "doc_id")
    again = F.coalesce("again", F.lit(False))
    score = watermark_score(
        F.coalesce("text", F.lit("")), col("x"), col("y"), col("x") + col("width"), col("y") + col("height"), col("page_width"), col("page_height"), F.lit(False), col("size"), col("base_size"), F.lit(1.0), F.lit(False)
    )
    role = (
        F.when(F.coalesce("line", F.lit("")) == "", "primary")
        .when(score >= 3.5, "watermark")
        .when((F.col("band") == "header") & again, "header")
        .when((F.col("band") == "footer") & F.col("line").rlike(PAGE_NUMBER), "page_number")
        .when((F.col("band") == "footer") & again, "footer")
        .otherwise("primary")
    )
    return rows.select("doc_id", "page_no", "element_no", role.alias("role"), *(keep or []))
