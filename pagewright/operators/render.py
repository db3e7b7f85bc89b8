"""Markdown of nodes, pages and documents, and marked plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, list_markdown, spans_markdown, strip, table_markdown

HIDDEN = ("header", "footer", "page_number", "watermark")


def chunk(prefix: Column, text: Column) -> Column:
    """A chunk stands between line breaks; nothing stands for an empty text.  The text is worked out once."""
    some = F.get(F.filter(F.array(text), lambda t: t != ""), F.lit(0))
    return F.coalesce(F.concat(F.lit("\n"), prefix, some, F.lit("\n")), F.lit(""))


def joined(chunks: list[Column]) -> Column:
    """Chunks of one node, those that hold anything, joined by line breaks."""
    return F.array_join(F.filter(F.array(*chunks), lambda c: c != ""), "\n")


def node_markdown() -> Column:
    """A node's chunk by its kind."""
    text = spans_markdown("spans")
    marks = F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))))
    name, title = (strip(F.replace(spans_markdown(c), F.lit("**"), F.lit(""))) for c in ("name_spans", "title_spans"))
    header = joined([chunk(F.lit("# "), name), chunk(F.lit("## "), title), chunk(F.lit(""), spans_markdown("contact_spans"))])
    paragraph = F.when(F.col("role") == "annotation", chunk(F.lit("> **[Comment]**: "), text)).otherwise(chunk(F.lit(""), text))
    return (
        F.when(F.col("kind") == "header_semantic", header)
        .when(F.col("kind") == "heading", chunk(F.concat(marks, F.lit(" ")), text))
        .when(F.col("kind") == "list", chunk(F.lit(""), F.coalesce(list_markdown("items", "ordered"), F.lit(""))))
        .when(F.col("kind") == "table", chunk(F.lit(""), table_markdown("headers", "rows", "alignments")))
        .otherwise(paragraph)
    )


def visible(nodes: DataFrame, annotations: bool = False) -> DataFrame:
    hidden = HIDDEN if annotations else (*HIDDEN, "annotation")
    return nodes.where(~F.coalesce(F.col("role"), F.lit("")).isin(*hidden))


def pages_of(chunks: DataFrame) -> DataFrame:
    """(doc_id, page_no, markdown) of chunks (doc_id, page_no, at, chunk): in their order, joined by line breaks.  Bounded by a page."""
    return chunks.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "chunk"))), lambda x: x["chunk"]), "\n").alias("markdown"))


def documents_of(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown) of (doc_id, page_no, markdown): pages in their order, joined by line breaks, stripped, with one at the end.

    Pages are joined first and documents then.  A document becomes one value; where documents may be longer than
    a value should be, ``pages_of`` and the sink ``write_pages`` do without.
    """
    docs = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "markdown"))), lambda x: x["markdown"]), "\n").alias("text"))
    return docs.select("doc_id", F.concat(strip("text"), F.lit("\n")).alias("markdown"))


def _node_chunks(nodes: DataFrame, order: str) -> DataFrame:
    return visible(nodes).select("doc_id", "page_no", F.col(order).alias("at"), node_markdown().alias("chunk")).where("chunk <> ''")


def page_markdown(nodes: DataFrame, order: str = "node_no") -> DataFrame:
    return pages_of(_node_chunks(nodes, order))


def document_markdown(nodes: DataFrame, order: str = "node_no") -> DataFrame:
    """(doc_id, markdown) of nodes in page and node order."""
    return documents_of(page_markdown(nodes, order))


def marked_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, page_no, text): every page that isn't blank between markers with its number."""
    kept = pages.where(strip("text") != "")
    block = F.concat(F.lit("--- START OF PAGE "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.regexp_replace("text", f"[{SPACE}]+$", ""), F.lit("\n--- END OF PAGE ---\n\n"))
    rows = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", block.alias("b")))).alias("bs"))
    return rows.select("doc_id", F.array_join(F.transform("bs", lambda x: x["b"]), "").alias("text"))
