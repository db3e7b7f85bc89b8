"""Joins of rectangles, always within a page: an equality join first, the geometry as a residual condition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import iou, overlaps, touches
from ..functions.grouped import Columns, by_group
from ..functions.udf import at_least, exact_ratio

PAGE = ["doc_id", "page_no"]


def _named(df: DataFrame, suffix: str) -> DataFrame:
    """Columns other than the page's keys under names with a suffix."""
    return df.select(*PAGE, *[F.col(c).alias(c + suffix) for c in df.columns if c not in PAGE])


def outside_tables(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows (with bbox) that touch no table's bbox on their page."""
    t = tables.select(*[F.col(k).alias(f"t_{k}") for k in PAGE], F.col("bbox").alias("t_bbox"))
    same = (F.col("doc_id") == F.col("t_doc_id")) & (F.col("page_no") == F.col("t_page_no"))
    return rows.join(t, same & touches(F.col("bbox"), F.col("t_bbox")), "left_anti")


def first_link(spans: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Spans (with bbox and ``key``) with the url of the first link, in link order, that touches them."""
    pairs = spans.select(*PAGE, key, "bbox").join(links.select(*PAGE, "link_no", "url", F.col("bbox").alias("l_bbox")), PAGE).where(touches(F.col("bbox"), F.col("l_bbox")))
    best = pairs.groupBy(*PAGE, key).agg(F.min_by("url", "link_no").alias("url"))
    return spans.join(best, [*PAGE, key], "left")


def selected(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box columns, word columns) of the words that overlap a box."""
    w, b = _named(words, "_w"), _named(boxes, "_b")
    return w.join(b, PAGE).where(overlaps(F.col("bbox_w"), F.col("bbox_b")))


def smart_selection(boxes: DataFrame, native: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, page_no, box_no, source, x0, y0, x1, y1): native words in the box, else OCR words, else the box itself."""
    found = None
    for rank, (source, words) in enumerate((("native", native), ("ocr", ocr))):
        hit = selected(words.select(*PAGE, "bbox"), boxes.select(*PAGE, "box_no", "bbox")).select(*PAGE, F.col("box_no_b").alias("box_no"), F.lit(rank).alias("rank"), F.lit(source).alias("source"), F.col("bbox_w").alias("bbox"))
        found = hit if found is None else found.unionByName(hit)
    found = found.unionByName(boxes.select(*PAGE, "box_no", F.lit(2).alias("rank"), F.lit("geometry").alias("source"), "bbox"))
    best = Window.partitionBy(*PAGE, "box_no")
    return found.withColumn("best", F.min("rank").over(best)).where("rank = best").select(*PAGE, "box_no", "source", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


def overlap_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(doc_id, page_no, a, b, iou) of the pairs on a page with a positive overlap."""
    x = a.select(*PAGE, F.col(key).alias("a"), F.col("bbox").alias("a_box"))
    y = b.select(*PAGE, F.col(key).alias("b"), F.col("bbox").alias("b_box"))
    return x.join(y, PAGE).where(overlaps(F.col("a_box"), F.col("b_box"))).select(*PAGE, "a", "b", F.round(iou(F.col("a_box"), F.col("b_box")), 6).alias("iou"))


def reconciled(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, page_no, source, node_no): native nodes, and the OCR nodes that repeat no primary native one.

    An OCR node repeats it at a similarity of 0.70, or 0.40 with half the area in common.  Both
    inputs have node_no, role, text and bbox.  Similarity alone suffices, so all of a page are compared.
    """

    def merge(g: Columns) -> Iterator[tuple]:
        texts = g["text"]
        boxes = list(zip(g["x0"], g["y0"], g["x1"], g["y1"], strict=True))
        native = [s == "native" for s in g["source"]]
        primary = [i for i, own in enumerate(native) if own and g["role"][i] == "primary"]

        def area(b: tuple) -> float:
            return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])

        def common(a: tuple, b: tuple) -> float:
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0.0

        def repeats(i: int) -> bool:
            for p in primary:
                # Lengths and then the letters in common bound the ratio, and often settle it.
                n, m = len(texts[i]), len(texts[p])
                need = 0.40 if common(boxes[i], boxes[p]) >= 0.50 else 0.70
                if (not n + m or 2 * min(n, m) / (n + m) >= need) and at_least(texts[i], texts[p], need):
                    return True
            return False

        for i, own in enumerate(native):
            if own or not repeats(i):
                yield g["doc_id"][i], g["page_no"][i], g["source"][i], g["node_no"][i]

    def flat(df: DataFrame, source: str) -> DataFrame:
        text = F.trim(F.coalesce("text", F.lit("")))
        return df.select(*PAGE, F.lit(source).alias("source"), "node_no", "role", text.alias("text"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")

    return by_group(flat(native, "native").unionByName(flat(ocr, "ocr")), PAGE, ["source", "node_no"], merge, "doc_id string, page_no int, source string, node_no int")


def line_matches(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, element_no, line_no): the line of an element, by height and then by text.

    Lines whose top or middle lies within 4 points are candidates; of several the most similar;
    without any, a line that holds the text, or is held by it, or is more than 0.8 similar.  The first of equal ones.
    """

    def match(g: Columns) -> Iterator[tuple]:
        n = g["side"].count(0)  # lines come first
        text, tops, mids = g["text"], g["y"], [y + h / 2 for y, h in zip(g["y"], g["height"], strict=True)]
        for i in range(n, len(text)):
            near = [k for k in range(n) if abs(tops[k] - tops[i]) <= 4 or abs(mids[k] - mids[i]) <= 4]
            if not near and text[i]:
                near = [k for k in range(n) if text[i] in text[k] or text[k] in text[i] or exact_ratio(text[k], text[i]) > 0.8]
            best = near[0] if len(near) == 1 else max(near, key=lambda k: exact_ratio(text[k], text[i]), default=None)
            yield g["doc_id"][i], g["page_no"][i], g["no"][i], None if best is None else g["no"][best]

    def side(df: DataFrame, no: str, text: str, which: int) -> DataFrame:
        return df.select(*PAGE, F.lit(which).alias("side"), F.col(no).alias("no"), F.coalesce(text, F.lit("")).alias("text"), "y", "height")

    rows = side(lines, "line_no", "text", 0).unionByName(side(wanted, "element_no", "original_text", 1)).where("y IS NOT NULL AND height IS NOT NULL")
    return by_group(rows, PAGE, ["side", "no"], match, "doc_id string, page_no int, element_no int, line_no int")
