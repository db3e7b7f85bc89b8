"""Readers that give documents in the relational model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import rect
from ..functions.text import strip
from ..schema import DOCS, LAYOUT_JSON


def text_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Plain texts laid out on pages of 600 x 800 points: five lines a page, one span a line.

    Line n stands on page n div 5 + 1 in slot n mod 5, 170 points apart.  The first line is large and
    bold, short ones are larger; short lines of odd number begin in a right-hand column.
    """
    lines = documents.select(F.col(key).cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("ln", "text"))
    slot = F.col("ln") % 5
    y0 = 50.0 + 170.0 * slot
    x0 = F.when((F.length("text") <= 45) & (F.col("ln") % 2 == 1), 330.0).otherwise(50.0)
    width = F.least(F.lit(500.0), 5.5 * F.length("text"))
    size = F.when(F.col("ln") == 0, 24.0).when(F.length("text") < 40, 14.0).otherwise(11.0)
    return lines.where(strip("text") != "").select(
        "doc_id", (F.floor(F.col("ln") / 5) + 1).cast("int").alias("page_no"), slot.cast("int").alias("line_no"), "text", size.alias("size"), (F.col("ln") == 0).alias("bold"), rect(x0, y0, x0 + width, y0 + 12.0).alias("bbox")
    )


def layout_elements(layouts: DataFrame, column: str = "layout") -> DataFrame:
    """Elements of layouts in JSON (doc_id, layout): one row an element with its page's fields; what isn't JSON gives none."""
    pages = layouts.select("doc_id", F.from_json(column, LAYOUT_JSON, {"mode": "PERMISSIVE"}).alias("l")).select("doc_id", F.explode("l.pages").alias("p"))
    return pages.select("doc_id", F.col("p.page_num").alias("page_no"), F.col("p.kind").alias("kind"), F.col("p.is_ocr").alias("is_ocr"), F.posexplode("p.elements").alias("element_no", "e")).select("doc_id", "page_no", "kind", "is_ocr", "element_no", "e.*")


def tsv_words(lines: DataFrame, column: str = "line") -> DataFrame:
    """Words of an OCR engine's TSV lines; lines with fewer than twelve fields or no number are left out."""
    f = F.split(column, "\t")
    rows = lines.where(F.size(f) >= 12).withColumn("f", F.split(column, "\t"))
    names = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")
    keep = [c for c in lines.columns if c != column]
    out = rows.select(*keep, *[F.get("f", F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(names)], F.get("f", F.lit(10)).try_cast("double").alias("conf"), F.get("f", F.lit(11)).alias("text"))
    return out.where(F.col("level").isNotNull())


DICT = "struct<text:array<string>,left:array<double>,top:array<double>,width:array<double>,height:array<double>,conf:array<string>>"


def dict_words(pages: DataFrame, column: str = "data", zoom: float = 2.0) -> DataFrame:
    """(other columns, word_no, text, conf, x0, y0, x1, y1) of OCR results that hold each field as one list a page.

    Boxes are scaled back by the zoom at which the page was read.  A confidence that is no number counts as -1;
    blank texts and words that are not valid are left out.
    """
    from ..operators.words import valid_word

    keep = [c for c in pages.columns if c != column]
    d = F.col(column)
    rows = pages.select(*keep, F.posexplode(F.arrays_zip(*[d[k].alias(k) for k in ("text", "left", "top", "width", "height", "conf")])).alias("word_no", "w"))
    rows = rows.select(*keep, "word_no", strip("w.text").alias("text"), F.coalesce(F.col("w.conf").try_cast("double"), F.lit(-1.0)).alias("conf"), *[(F.col(f"w.{k}") / zoom).alias(k) for k in ("left", "top", "width", "height")])
    rows = rows.where((F.coalesce("text", F.lit("")) != "") & valid_word(F.col("text"), F.col("conf")))
    return rows.select(*keep, "word_no", "text", "conf", F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))


def form_boxes(forms: DataFrame, column: str = "boxes") -> DataFrame:
    """(other columns, box_no, page, x, y, width, height) of JSON lists of boxes in forms; what is no such list gives none."""
    keep = [c for c in forms.columns if c != column]
    boxes = F.from_json(column, "array<struct<page:int,x:double,y:double,width:double,height:double>>", {"mode": "PERMISSIVE"})
    return forms.select(*keep, F.posexplode(boxes).alias("box_no", "b")).select(*keep, "box_no", "b.*").where("page IS NOT NULL")


def form_keywords(forms: DataFrame, column: str = "keywords") -> DataFrame:
    """(other columns, keyword_no, keyword) of lists split on three bars; blank ones are left out."""
    keep = [c for c in forms.columns if c != column]
    return forms.select(*keep, F.posexplode(F.split(column, r"\|\|\|")).alias("keyword_no", "keyword")).withColumn("keyword", strip("keyword")).where("keyword <> ''")


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of text files, each whole."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), r"\\", "/").alias("path"), F.col("value").alias("content"))


def pdf_documents(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    """Documents of PDF files.  Opening needs a codec library; without one each file's row says so instead of failing the job."""
    files = spark.read.format("binaryFile").load(path)

    def open_all(batches):
        import pandas as pd

        try:
            import fitz  # noqa: F401  (an optional codec)
        except ImportError:
            fitz = None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n, locked, status, error = None, None, "ok", None
                if fitz is None:
                    status, error = "error", "CodecMissing"
                else:
                    try:
                        d = fitz.open(stream=r.content, filetype="pdf")
                        locked = bool(d.needs_pass)
                        if locked and (not password or d.authenticate(password) <= 0):
                            status, error = "error", "AuthenticationError"
                        else:
                            n = d.page_count
                    except Exception as e:
                        status, error = "error", type(e).__name__
                rows.append((r.path, r.path, r.sha256, n, locked, status, error))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "sha256", "n_pages", "encrypted", "status", "error"]).astype({"n_pages": "Int32", "encrypted": "boolean"})

    return files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(open_all, DOCS)
