"""Mutations of documents as rows of operations: what to draw or cut where; a codec carries them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.text import font_variant, safe_suffix, strip

PAGE = ["doc_id", "page_no"]


def keyword_boxes(elements: DataFrame, keywords: DataFrame) -> DataFrame:
    """(doc_id, page_no, element_no, keyword, x0, y0, x1, y1): every element that holds a keyword, in any case.

    ``keywords`` is one row with the joined list ``keywords``, split on three bars; blank ones
    are left out.  The list is short and goes into the scan as an array, without a join.
    """
    words = [w.strip() for r in keywords.select("keywords").collect() for w in (r.keywords or "").split("|||") if w.strip()]  # one request's form field
    listed = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    hits = F.filter(listed, lambda w: F.lower("text").contains(F.lower(w)))
    rows = elements.where(F.col("text").isNotNull()).select(*PAGE, "element_no", F.explode(hits).alias("keyword"), G.box("x", "y", "width", "height").alias("b"))
    return rows.select(*PAGE, "element_no", "keyword", *[F.round(f"b.{k}", 6).alias(k) for k in ("x0", "y0", "x1", "y1")])


def redact_plan(matches: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, seq, reason, x0, y0, x1, y1): per page keyword matches, then boxes in fractions of the page; black fill, one apply a page."""
    m = matches.select(*PAGE, F.lit(0).alias("rank"), F.lit("keyword").alias("reason"), F.col("element_no").alias("no"), F.col("keyword").alias("sub"), "x0", "y0", "x1", "y1")
    b = boxes.join(pages.select(*PAGE, "width", "height"), PAGE)
    r = G.fraction_rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    b = b.select(*PAGE, F.lit(1).alias("rank"), F.lit("box").alias("reason"), F.col("box_no").alias("no"), F.lit("").alias("sub"), r.alias("r"))
    b = b.select(*PAGE, "rank", "reason", "no", "sub", *[F.round(f"r.{k}", 6).alias(k) for k in ("x0", "y0", "x1", "y1")])
    rows = m.unionByName(b)
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy("rank", "no", "sub"))
    return rows.select(*PAGE, seq.cast("int").alias("seq"), "reason", "x0", "y0", "x1", "y1")


def sign_plan(stamps: DataFrame, pages: DataFrame) -> DataFrame:
    """Stamps in points on the pages that exist; others are left out."""
    return stamps.join(pages.select(*PAGE), PAGE, "left_semi").select(*PAGE, "stamp_no", "x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))


def markup_plan(selection: DataFrame, pages: DataFrame, kind: str) -> DataFrame:
    """Rectangles or lines of a highlight, strikeout or underline over selected words or, without words, the box.

    ``selection`` is that of ``smart_selection``; boxes without width or height are left out.
    """
    rows = selection.join(pages.select(*PAGE, "width", "height"), PAGE).where("x1 > x0 AND y1 > y0")
    r = F.struct("x0", "y0", "x1", "y1")
    manual = F.col("source") == "geometry"
    if kind == "highlight":
        shape = G.highlight_rect(r, F.col("width"), F.col("height"))
        return rows.select(*PAGE, "box_no", F.lit(kind).alias("op"), shape.alias("s")).select(*PAGE, "box_no", "op", *[F.round(f"s.{k}", 6).alias(k) for k in ("x0", "y0", "x1", "y1")])
    y = G.strike_y(r) if kind == "strikeout" else G.underline_y(r, F.col("height"), manual)
    return rows.select(*PAGE, "box_no", F.lit(kind).alias("op"), F.round("x0", 6).alias("x0"), F.round(y, 6).alias("y"), F.round("x1", 6).alias("x1"), F.round(G.line_thickness(r), 6).alias("thickness"))


def compile_plan(targets: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, element_no, redactions, insertions): what a compile of the dirty elements draws.

    Elements that are dirty without a target are replaced as a whole.
    """
    from .editing import dirty

    n = targets.groupBy(*PAGE, "element_no").agg(F.count_if(F.col("operation") != "insert").alias("cut"), F.count("*").alias("n"))
    rows = elements.where(dirty()).select(*PAGE, "element_no").join(n, [*PAGE, "element_no"], "left")
    return rows.select(*PAGE, "element_no", F.coalesce("cut", F.lit(1)).cast("int").alias("redactions"), F.coalesce("n", F.lit(1)).cast("int").alias("insertions"))


def compile_ops(targets: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, seq, op, element_no, x0, y0, x1, y1, text, font, size, color): what a compile of the dirty elements draws, in order.

    All redactions of a page first, then one apply, then grounds, texts, and lines under or through them.
    Elements that are dirty without a target are replaced as a whole.
    """
    from .editing import dirty, effective_style
    from .records import baseline, decoration

    font = font_variant(F.col("font_family"), F.col("is_bold"), F.col("is_italic"))
    styled = elements.where(dirty()).select(*PAGE, "element_no", "x", "y", "width", "height", F.col("text").alias("whole"), *effective_style())
    styled = styled.withColumn("font", font).withColumn("ground", F.when(~F.lower("ground").isin("", "transparent", "none"), F.col("ground")))
    t = targets.select(*PAGE, "element_no", "target_no", "operation", "x0", "y0", "x1", "y1", "baseline", "insertion_x", "replacement")
    rows = styled.join(t, [*PAGE, "element_no"], "left")
    own = {"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + F.col("width"), "y1": F.col("y") + F.col("height")}
    alone = F.col("operation").isNull()
    rows = rows.withColumns({k: F.when(alone, v).otherwise(F.col(k)) for k, v in own.items()})
    rows = rows.withColumn("base", F.coalesce("baseline", baseline(F.col("y"), F.col("height")))).withColumn("left", F.coalesce("x0", "insertion_x", "x"))
    rows = rows.withColumn("new", F.when(alone, F.col("whole")).otherwise(F.col("replacement")))
    drawn = F.coalesce(F.col("new"), F.lit("")) != ""
    under, through, _ = decoration(F.col("base"), F.col("font_size"))
    none, whole = F.lit(None).cast("double"), ("x0", "y0", "x1", "y1")

    def op(phase: int, name: str, test: Column, box: list[Column], text: Column | None = None) -> Column:
        text = F.lit(None).cast("string") if text is None else text
        return F.when(test, F.struct(F.lit(phase).alias("phase"), F.lit(name).alias("op"), *[c.cast("double").alias(k) for k, c in zip(whole, box, strict=True)], text.alias("text")))

    cut, right = [F.col(k) for k in whole], F.coalesce("x1", "insertion_x")
    ops = F.array(
        op(0, "redact", F.col("x0").isNotNull(), cut), op(2, "background", F.col("ground").isNotNull() & F.col("x0").isNotNull(), [F.col("x0") - 1, F.col("y0") - 1, F.col("x1") + 1, F.col("y1") + 1]),
        op(3, "text", drawn, [F.col("left"), F.col("base"), none, none], F.col("new")), op(4, "underline", drawn & F.col("is_underline"), [F.col("left"), under, right, under]), op(4, "strikeout", drawn & F.col("is_strikethrough"), [F.col("left"), through, right, through]),
    )
    each = rows.select(*PAGE, "element_no", F.coalesce("target_no", F.lit(0)).alias("target_no"), "font", F.col("font_size").alias("size"), "color", F.explode(F.filter(ops, lambda o: o.isNotNull())).alias("o"))
    each = each.select(*PAGE, "element_no", "target_no", "o.*", *[F.when(F.col("o.op") == "text", F.col(c)).alias(c) for c in ("font", "size", "color")])
    apply = each.where("op = 'redact'").select(*PAGE).distinct().select(*PAGE, F.lit(1).alias("phase"), F.lit("apply").alias("op"))
    every = each.unionByName(apply, allowMissingColumns=True)
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy("phase", "element_no", "target_no", "op"))
    return every.select(*PAGE, seq.cast("int").alias("seq"), "op", "element_no", *[F.round(k, 6).alias(k) for k in whole], "text", "font", "size", "color")


def image_ops(elements: DataFrame, zoom: float = 2.0) -> DataFrame:
    """(doc_id, page_no, seq, op, element_no, x0, y0, x1, y1, text, color): what a compile draws on pages that were read by OCR.

    Each dirty element's ground is painted on the page's image, in its pixels and one wider on every side;
    the image takes the page's place; then the new texts are written, in points, at their base lines.
    """
    from .editing import dirty
    from .records import baseline

    rows = elements.where(dirty())
    ground = F.when(F.lower("bg_color") == "transparent", "#ffffff").otherwise(F.coalesce("bg_color", F.lit("#ffffff")))
    none = F.lit(None).cast("double")
    scaled = [F.col("x") * zoom - 1, F.col("y") * zoom - 1, (F.col("x") + F.col("width")) * zoom + 1, (F.col("y") + F.col("height")) * zoom + 1]
    names = ("x0", "y0", "x1", "y1")
    paint = rows.where("width > 0 AND height > 0").select(*PAGE, F.lit(0).alias("phase"), F.lit("paint").alias("op"), "element_no", *[c.alias(k) for k, c in zip(names, scaled, strict=True)], F.lit(None).cast("string").alias("text"), ground.alias("color"))
    image = rows.select(*PAGE).distinct().select(*PAGE, F.lit(1).alias("phase"), F.lit("image").alias("op"))
    at = [F.col("x"), baseline(F.col("y"), F.col("height")), none, none]
    text = rows.where("text <> ''").select(*PAGE, F.lit(2).alias("phase"), F.lit("text").alias("op"), "element_no", *[c.alias(k) for k, c in zip(names, at, strict=True)], "text", F.coalesce("text_color", F.lit("#000000")).alias("color"))
    every = paint.unionByName(text).unionByName(image, allowMissingColumns=True)
    seq = F.row_number().over(Window.partitionBy(*PAGE).orderBy("phase", "element_no"))
    return every.select(*PAGE, seq.cast("int").alias("seq"), "op", "element_no", *[F.round(k, 6).alias(k) for k in names], "text", "color")


def render_requests(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (request_id, doc_id, page, dpi) with zoom or, for a page or resolution that can't be, an error; ``documents`` have n_pages."""
    rows = requests.join(documents.select("doc_id", "n_pages"), "doc_id", "left")
    error = (
        F.when(F.col("n_pages").isNull(), "Empty file uploaded")
        .when(F.col("page") < 1, "Page number must be 1 or greater")
        .when(F.col("dpi") <= 0, "DPI must be greater than 0")
        .when(F.col("page") > F.col("n_pages"), F.concat(F.lit("Invalid page "), F.col("page").cast("string"), F.lit("; document has "), F.col("n_pages").cast("string"), F.lit(" pages")))
    )
    return rows.select("request_id", "doc_id", "page", error.alias("error"), F.when(error.isNull(), F.round(F.col("dpi") / 72, 6)).alias("zoom"))


def merge_plan(images: DataFrame) -> DataFrame:
    """(job_id, seq, key, local_name, error): a job's images (job_id, position, key, name) in their order, as pages of one document.

    Local names count from 001 and keep an allowed extension; an image without a key is an error.
    """
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("position", "key", "name"))
    rows = images.withColumn("seq", place).withColumn("key", strip(F.coalesce("key", F.lit(""))))
    number = F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0")).otherwise(F.col("seq").cast("string"))
    error = F.when(F.col("key") == "", F.concat(F.lit("missing object key for image #"), F.col("seq").cast("string")))
    return rows.select("job_id", "seq", "key", F.concat(F.lit("image-"), number, safe_suffix(F.coalesce("name", "key"), ".img")).alias("local_name"), error.alias("error"))
