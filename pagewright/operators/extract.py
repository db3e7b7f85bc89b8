"""Extraction of the elements that an editor shows: native lines, or lines put together from OCR words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .layout import cluster_words, first_of_near
from .pages import kind_by_count
from .records import ocr_font_size
from .words import valid_word

PAGE = ["doc_id", "page_no"]
ELEMENT = ["element_no", "text", "x", "y", "width", "height", "size", "font", "text_color"]


def _distinct(rows: DataFrame) -> DataFrame:
    """Without repeated elements of a page."""
    return first_of_near(rows, [c for c in ELEMENT if c != "element_no"])


def native_elements(lines: DataFrame) -> DataFrame:
    """Elements of lines (line_no, text, x, y, width, height, size, font, text_color) that have text and an area."""
    rows = lines.withColumn("text", strip("text")).where("text <> '' AND width > 0 AND height > 0")
    size, font, color = F.round(F.coalesce("size", F.lit(9.5)), 1), F.coalesce("font", F.lit("sans-serif")), F.coalesce("text_color", F.lit("#000000"))
    return _distinct(rows.select(*PAGE, F.col("line_no").alias("element_no"), "text", "x", "y", "width", "height", size.alias("size"), font.alias("font"), color.alias("text_color")))


def ocr_elements(words: DataFrame) -> DataFrame:
    """Elements of OCR words (word_no, text, conf, x0, y0, x1, y1): valid words in lines three points wide and more.

    The size is that of the tallest word's em square.  Weight and colour would need the page's pixels.
    """
    kept = words.select(*PAGE, "word_no", "text", "conf", "x0", "y0", "x1", "y1").where((strip("text") != "") & valid_word(F.col("text"), F.col("conf")))
    rows = cluster_words(kept, ["text", "x0", "y0", "x1", "y1"]).groupBy(*PAGE, "line_no").agg(
        F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))).alias("ws"), F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max(F.col("y1") - F.col("y0")).alias("tall")
    )
    rows = rows.withColumn("text", strip(F.array_join(F.transform("ws", lambda w: w["text"]), " "))).withColumns({"width": F.col("x1") - F.col("x"), "height": F.col("y1") - F.col("y")})
    rows = rows.where("text <> '' AND width >= 3 AND height > 0")
    size = F.round(ocr_font_size(F.array("tall")), 1)
    return _distinct(rows.select(*PAGE, F.col("line_no").alias("element_no"), "text", "x", "y", "width", "height", size.alias("size"), F.lit("helv").alias("font"), F.lit("#000000").alias("text_color")))


def elements_of(lines: DataFrame, native_words: DataFrame, ocr_words: DataFrame) -> DataFrame:
    """(doc_id, page_no, element_no, ..., is_ocr): lines of the pages that have a native word, OCR words of the others; numbered anew."""
    native_pages = native_words.select(*PAGE).distinct()
    native = native_elements(lines.join(native_pages, PAGE, "left_semi")).withColumn("is_ocr", F.lit(False))
    rows = native.unionByName(ocr_elements(ocr_words.join(native_pages, PAGE, "left_anti")).withColumn("is_ocr", F.lit(True)))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("element_no")) - 1
    return rows.withColumn("element_no", place.cast("int"))


def page_records(pages: DataFrame, elements: DataFrame, native_words: DataFrame) -> DataFrame:
    """(doc_id, page_no, kind, is_ocr, has_selectable_text, word_count, text_block_count, image_block_count) of every page.

    ``elements`` are those of ``elements_of``.  A page without a native word counts as read by OCR: scanned if that gave an
    element, else blank, with counts of 0.
    """
    words = native_words.groupBy(*PAGE).agg(F.count("*").alias("n_words"))
    own = elements.groupBy(*PAGE).agg(F.count("*").alias("n_elements"))
    rows = pages.select(*PAGE, F.coalesce("image_block_count", F.lit(0)).alias("images")).join(words, PAGE, "left").join(own, PAGE, "left")
    native = F.col("n_words").isNotNull()
    kind = F.when(native, kind_by_count(F.col("n_words"), F.col("images"))).when(F.col("n_elements") > 0, "scanned").otherwise("blank")
    counts = {"word_count": F.col("n_words"), "text_block_count": F.coalesce("n_elements", F.lit(0)), "image_block_count": F.col("images")}
    return rows.select(*PAGE, kind.alias("kind"), (~native).alias("is_ocr"), native.alias("has_selectable_text"), *[F.when(native, c).otherwise(0).cast("int").alias(k) for k, c in counts.items()])
