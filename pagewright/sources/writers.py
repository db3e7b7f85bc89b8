"""Sinks: Markdown, text, JSON, and objects with authenticated encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_suffix


def write_markdown(markdown: DataFrame, path: str) -> None:
    """One row a document, in text files partitioned by a hash of the document."""
    markdown.select(F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("part"), F.to_json(F.struct("doc_id", "markdown")).alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def write_pages(pages: DataFrame, path: str, column: str = "markdown") -> None:
    """Pages (doc_id, page_no, text) in files that hold ranges of documents in page order, so that a document is its pages read on."""
    rows = pages.repartitionByRange("doc_id", "page_no").sortWithinPartitions("doc_id", "page_no")
    rows.select(F.to_json(F.struct("doc_id", "page_no", F.col(column).alias("text"))).alias("value")).write.mode("overwrite").text(path)


def csv_rows(stacked: DataFrame, documents: DataFrame, message: str = "No tables found") -> DataFrame:
    """(doc_id, row_no, line): the rows of stacked tables as CSV lines without a header; a document without a table has one with a message."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = stacked.groupBy("doc_id", "row_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_no", quoted.alias("q")))), lambda c: c["q"]), ",").alias("line"))  # bounded by a row's cells
    empty = documents.select("doc_id").distinct().join(stacked.select("doc_id"), "doc_id", "left_anti")
    return lines.unionByName(empty.select("doc_id", F.lit(0).alias("row_no"), F.lit(f'"{message}"').alias("line")))


def layout_json(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, layout): pages with their elements as one JSON document, as an extraction's result is stored."""
    fields = [c for c in ("text", "original_text", "x", "y", "width", "height", "size", "font", "bg_color", "text_color", "style", "target_substring", "selection_start", "selection_end", "bold", "italic", "underline", "strikethrough") if c in elements.columns]
    own = elements.groupBy("doc_id", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("element_no", F.struct(*fields).alias("e")))), lambda x: x["e"]).alias("elements"))
    page = F.struct(F.col("page_no").alias("page_num"), "width", "height", "kind", "is_ocr", "elements")
    rows = pages.join(own, ["doc_id", "page_no"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", page.alias("p")))).alias("ps"))
    return rows.select("doc_id", F.to_json(F.struct(F.transform("ps", lambda x: x["p"]).alias("pages"))).alias("layout"))


def object_key(prefix: Column, name: Column) -> Column:
    return F.concat(prefix, F.lit("/"), F.replace(F.uuid(), F.lit("-"), F.lit("")), safe_suffix(name, ""))


def encrypted(content: Column, key: Column) -> Column:
    """AES-GCM: nonce, ciphertext and tag in one."""
    return F.aes_encrypt(content, key, F.lit("GCM"))


def decrypted(content: Column, key: Column) -> Column:
    return F.aes_decrypt(content, key, F.lit("GCM"))


def data_uri(ext: Column, content: Column) -> Column:
    return F.concat(F.lit("data:image/"), ext, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))
