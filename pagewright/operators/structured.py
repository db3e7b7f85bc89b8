"""Markdown of pages as a reader takes them in: a header of name, title and contact, entries with what belongs to them, all else in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import list_markdown, spans_markdown, strip
from . import layout, render

PAGE = ["doc_id", "page_no"]


def structured_pages(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, markdown): a page's header first, then entries and single nodes in reading order.

    Within an entry stand its title, its metadata, its bodies, its lists.  Text of the first region, if that is full width,
    goes into the header where it is large, or names ways of contact; what has no text there is left out.  Roles
    hide single nodes only: what a header or an entry has taken is shown.
    """
    rows = layout.with_header_part(layout.reading_order(layout.columns(layout.regions(nodes, pages), grouper=True)))
    taken = F.coalesce(F.col("header_part").isin("name", "title", "contact"), F.lit(False))
    rows = rows.withColumn("in_header", taken).withColumn("found", F.max("in_header").over(Window.partitionBy(*PAGE)))
    first = (F.col("region_id") == 0) & F.col("is_full")
    rows = rows.where(~first | ~F.col("found") | F.col("header_part").isNotNull())
    # What the header takes stands in a region of its own, so that it is no part of any entry.
    rows = rows.withColumn("region_id", F.when(F.col("in_header"), -1).otherwise(F.col("region_id")))
    kept = ["reading_order", "kind", "role", "level", "ordered", "spans", "items", "headers", "rows", "alignments", "name_spans", "title_spans", "contact_spans", "in_header", "header_part"]
    rows = layout.group_entries(rows, keep=kept)
    inside = F.col("entry_no").isNotNull()
    entry = F.when(inside, F.min("reading_order").over(Window.partitionBy(*PAGE, "region_id", "col_no", "entry_no"))).otherwise(F.col("reading_order"))
    phase = F.when(F.col("part") == "metadata", 1).when(F.col("part") == "body", 2).when(F.col("part") == "bullet", 3).otherwise(0)
    text = spans_markdown("spans")
    shown = ~F.coalesce(F.col("role"), F.lit("")).isin(*render.HIDDEN, "annotation")
    chunk = (
        F.when(F.col("in_header"), "")
        .when(F.col("part") == "title", render.chunk(F.lit("### "), text))
        .when((F.col("part") == "metadata") & (text != ""), F.concat(F.lit("\n*"), text, F.lit("*\n")))
        .when(F.col("part") == "bullet", render.chunk(F.lit(""), F.coalesce(list_markdown("items", "ordered"), F.lit(""))))
        .when(inside, render.chunk(F.lit(""), text))
        .when(shown, render.node_markdown())
    )
    rows = rows.select(*PAGE, "in_header", "header_part", "reading_order", "spans", F.struct(entry.alias("entry"), phase.alias("phase"), F.col("reading_order").alias("own")).alias("at"), chunk.alias("chunk"))

    def spans(part: str) -> Column:
        own = F.sort_array(F.collect_list(F.when(F.col("in_header") & (F.col("header_part") == part), F.struct("reading_order", "spans"))))
        return F.flatten(F.transform(own, lambda x: x["spans"])).alias(part)  # bounded by a page's header

    body = F.sort_array(F.collect_list(F.when(F.col("chunk") != "", F.struct("at", "chunk"))))
    sheets = rows.groupBy(*PAGE).agg(*[spans(p) for p in ("name", "title", "contact")], F.transform(body, lambda x: x["chunk"]).alias("chunks"))
    name, title = (strip(F.replace(spans_markdown(p), F.lit("**"), F.lit(""))) for p in ("name", "title"))
    head = [render.chunk(F.lit("# "), name), render.chunk(F.lit("## "), title), render.chunk(F.lit(""), spans_markdown("contact"))]
    every = F.concat(F.filter(F.array(*head), lambda c: c != ""), F.col("chunks"))
    return sheets.where(F.size(every) > 0).select(*PAGE, F.array_join(every, "\n").alias("markdown"))


def structured_markdown(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown) of ``structured_pages``."""
    return render.documents_of(structured_pages(nodes, pages))
