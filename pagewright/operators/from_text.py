"""Markdown of plain documents: laid out on pages, classified, ordered as read, rendered.  Built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import rect
from ..functions.text import BULLET, NUMBERED_ITEM, glyphs, strip
from ..sources.readers import text_lines
from . import layout, pages, render

PAGE = ["doc_id", "page_no"]
WIDTH, HEIGHT = 600.0, 800.0
SPAN = "struct<text:string,is_bold:boolean,is_italic:boolean,is_code:boolean,font_size:double,font_name:string,link_url:string>"


def line_elements(documents: DataFrame) -> DataFrame:
    """The laid-out lines of texts as elements, with their pages' size."""
    rows = text_lines(documents)
    box = F.col("bbox")
    return rows.select(
        *PAGE, F.col("line_no").alias("element_no"), "text", "size", "bold", box["x0"].alias("x"), box["y0"].alias("y"), (box["x1"] - box["x0"]).alias("width"), (box["y1"] - box["y0"]).alias("height"), F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height")
    )


def classified_nodes(elements: DataFrame) -> DataFrame:
    """Elements as nodes: headings by size, weight and numbering, lists by their mark, else paragraphs; with roles by band and repetition."""
    banded = pages.bands(elements)
    rows = pages.content_roles(banded, pages.repeated_bands(banded), pages.base_font_size(elements), ["text", "size", "bold", "base_size", "x", "y", "width", "height", "page_width"])
    rows = rows.withColumn("t", strip(glyphs("text")))  # a column of its own, as it is asked many times
    text, bold = F.col("t"), F.coalesce("bold", F.lit(False))
    level = layout.heading_level(text, F.greatest(F.lit(10.0), F.col("size")), F.col("base_size"), bold, F.lit(True))
    rows = rows.withColumn("level", level)
    listed = text.rlike(BULLET) | text.rlike(NUMBERED_ITEM)
    kind = F.when(F.col("level").isNotNull(), "heading").when(listed, "list").otherwise("paragraph")
    none = F.lit(None).cast("string")
    spans = F.array(F.struct(text, bold, F.lit(False), F.lit(False), F.col("size"), F.lit("helv"), none)).cast(f"array<{SPAN}>")
    items = F.array(F.struct(spans.alias("spans"), F.lit(0).alias("level"), none.alias("marker")))
    empty = F.lit(None).cast(f"array<{SPAN}>")
    return rows.select(
        *PAGE, F.col("element_no").alias("node_no"), "page_width", kind.alias("kind"), "role", "level", text.rlike(NUMBERED_ITEM).alias("ordered"), spans.alias("spans"), items.alias("items"),
        rect(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")).alias("bbox"), *[empty.alias(c) for c in ("name_spans", "title_spans", "contact_spans")],
        F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("array<string>").alias("alignments"),
    )


def markdown_of_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, markdown) of (doc_id, text) in reading order, without running lines and page numbers.  Texts without a line give no row."""
    nodes = layout.reading_order(layout.columns(layout.regions(classified_nodes(line_elements(documents)))))
    return render.document_markdown(nodes, "reading_order")
