"""Tables of nodes and of plain text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TABLE_SECTIONS, strip

PAGE = ["doc_id", "page_no"]


def cells_of(nodes: DataFrame) -> DataFrame:
    """(doc_id, page_no, table_no, row_no, col_no, text): table nodes' cells, the header as row 0."""
    rows = F.concat(F.array(F.coalesce("headers", F.array().cast("array<string>"))), F.coalesce("rows", F.array().cast("array<array<string>>")))
    t = nodes.where("kind = 'table'").select(*PAGE, F.col("node_no").alias("table_no"), F.posexplode(rows).alias("row_no", "cells"))
    return t.select(*PAGE, "table_no", "row_no", F.posexplode("cells").alias("col_no", "text"))


def valid_tables(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Table nodes that pass: on the page, not nearly all of it, two rows and columns, no section words, no prose in cells; the bbox is clamped."""
    rows = F.concat(F.array(F.coalesce("headers", F.array().cast("array<string>"))), F.coalesce("rows", F.array().cast("array<array<string>>")))
    t = tables.where("kind = 'table'").join(pages.select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph")), PAGE).withColumn("all_rows", rows)
    cells = F.flatten("all_rows")
    section = F.exists(cells, lambda c: F.coalesce(reduce(or_, [c.contains(w) for w in TABLE_SECTIONS]), F.lit(False)))
    prose = F.exists(cells, lambda c: F.coalesce((F.length(c) > 150) | (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) >= 3), F.lit(False)))
    b = F.col("bbox")
    outside = (b["x0"] < -5) | (b["y0"] < -5) | (b["x1"] > F.col("pw") + 10) | (b["y1"] > F.col("ph") + 10)
    whole = (b["x1"] - b["x0"] > 0.65 * F.col("pw")) & (b["y1"] - b["y0"] > 0.65 * F.col("ph"))
    width = F.array_max(F.transform("all_rows", lambda r: F.size(r)))
    ok = ~(outside | whole | section | prose) & (F.size("all_rows") >= 2) & (width >= 2)
    zero = F.lit(0.0)
    return t.where(ok).select(*PAGE, F.col("node_no").alias("table_no"), F.size("all_rows").alias("n_rows"), width.alias("n_cols"), F.greatest(zero, b["x0"]).alias("x0"), F.greatest(zero, b["y0"]).alias("y0"), F.least(F.col("pw"), b["x1"]).alias("x1"), F.least(F.col("ph"), b["y1"]).alias("y1"))


def candidate_pages(drawings: DataFrame) -> DataFrame:
    """Pages with two horizontal and two vertical lines at least, of drawings (doc_id, page_no, p1, p2): the cheap test before a search for tables."""
    dx, dy = F.abs(F.col("p2.x") - F.col("p1.x")), F.abs(F.col("p2.y") - F.col("p1.y"))
    counts = drawings.groupBy(*PAGE).agg(F.count_if((dy < 2) & (dx > 15)).alias("horizontal"), F.count_if((dx < 2) & (dy > 15)).alias("vertical"))
    return counts.where("horizontal >= 2 AND vertical >= 2")


def comma_rows(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines as cells: split at commas where there are any, without quoting; (keys, col_no, cell)."""
    t = strip("text")
    cells = F.when(t.contains(","), F.split(t, ",")).otherwise(F.array(t))
    rows = lines.where(t != "").select(*keys, F.posexplode(cells).alias("col_no", "cell"))
    return rows.select(*keys, "col_no", strip("cell").alias("cell"))


def cascade(candidates: DataFrame) -> DataFrame:
    """Candidate tables of the first stage a page has: (doc_id, page_no, stage, ...), lower stages first."""
    best = F.min("stage").over(Window.partitionBy(*PAGE))
    return candidates.withColumn("best", best).where("stage = best").drop("best")


def stacked(nodes: DataFrame) -> DataFrame:
    """(doc_id, row_no, col_no, text): all table nodes of a document one under the other, columns by position, rows numbered anew from 0.

    A table's rows are counted and summed up before its cells are unfolded.
    """
    rows = F.concat(F.array(F.coalesce("headers", F.array().cast("array<string>"))), F.coalesce("rows", F.array().cast("array<array<string>>")))
    t = nodes.where("kind = 'table'").select(*PAGE, "node_no", rows.alias("all_rows"))
    before = Window.partitionBy("doc_id").orderBy("page_no", "node_no").rowsBetween(Window.unboundedPreceding, -1)
    at = t.select(*PAGE, "node_no", F.coalesce(F.sum(F.size("all_rows")).over(before), F.lit(0)).alias("at"))
    cells = t.join(at, [*PAGE, "node_no"]).select("doc_id", "at", F.posexplode("all_rows").alias("i", "cells"))
    return cells.select("doc_id", (F.col("at") + F.col("i")).cast("int").alias("row_no"), F.posexplode("cells").alias("col_no", "text"))
