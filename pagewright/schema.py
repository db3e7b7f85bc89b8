"""Schemas of the relational document model."""

from __future__ import annotations

from pyspark.sql import types as T

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = "struct<text:string,is_bold:boolean,is_italic:boolean,is_code:boolean,font_size:double,font_name:string,link_url:string>"
STYLE = "struct<fontFamily:string,fontSize:double,color:string,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,background:string>"

DOCS = "doc_id string, path string, sha256 string, n_pages int, encrypted boolean, status string, error string"
PAGES = "doc_id string, page_no int, width double, height double"
BLOCKS = f"doc_id string, page_no int, block_no int, btype int, bbox {RECT}"
SPANS = f"doc_id string, page_no int, block_no int, line_no int, span_no int, text string, font string, size double, flags int, color int, bbox {RECT}"
CHARS = f"doc_id string, page_no int, block_no int, line_no int, char_no int, c string, bbox {RECT}, origin struct<x:double,y:double>, font string, size double, color string"
WORDS = f"doc_id string, page_no int, word_no int, bbox {RECT}, text string, conf double"
IMAGES = f"doc_id string, page_no int, image_no int, xref int, bbox {RECT}, ext string, content binary"
LINKS = f"doc_id string, page_no int, link_no int, url string, bbox {RECT}"
CELLS = f"doc_id string, page_no int, table_no int, row_no int, col_no int, text string, table_bbox {RECT}"
ELEMENT = f"text string, original_text string, x double, y double, width double, height double, size double, font string, bg_color string, text_color string, style {STYLE}, target_substring string, selection_start int, selection_end int, bold boolean, italic boolean, underline boolean, strikethrough boolean"
LAYOUT_JSON = f"struct<pages:array<struct<page_num:int,width:double,height:double,kind:string,is_ocr:boolean,elements:array<struct<{ELEMENT.replace(' ', ':').replace(',:', ',')}>>>>>"

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(fields: str) -> T.StructType:
    """A struct of plain fields, ``name kind, ...``; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (f.split() for f in fields.split(","))])
