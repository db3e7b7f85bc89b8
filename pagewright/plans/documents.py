"""Queries that compose operators: Markdown of plain documents, extraction for an editor, what a compile draws, forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udf as U
from ..operators import editing, extract, from_text, plans, structured, tables, words
from ..sources import readers, writers
from . import core
from . import sql as Q
from .core import query

# ---- Markdown of plain documents

_SPAN = "STRUCT(text VARCHAR, is_bold BOOLEAN, is_italic BOOLEAN, is_code BOOLEAN, font_size DOUBLE, font_name VARCHAR, link_url VARCHAR)"
_LAID_OUT = f"""d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(0, len(ls))) AS ln, ls FROM d), tl AS (SELECT doc_id, ln, ls[ln + 1] AS text FROM u),
  e AS (SELECT doc_id, CAST(ln // 5 + 1 AS INTEGER) AS page_no, CAST(ln % 5 AS INTEGER) AS element_no, text, CASE WHEN ln = 0 THEN 24.0 WHEN length(text) < 40 THEN 14.0 ELSE 11.0 END AS size, ln = 0 AS bold,
      CASE WHEN length(text) <= 45 AND ln % 2 = 1 THEN 330.0 ELSE 50.0 END AS x, 50.0 + 170.0 * (ln % 5) AS y, least(500.0, 5.5 * length(text)) AS width, 12.0 AS height FROM tl WHERE {Q.strip("text")} <> ''),
  p AS (SELECT DISTINCT doc_id, page_no, 600.0 AS width, 800.0 AS height FROM e), {core._ROLES},
  hd AS (SELECT e.*, role, {Q.strip(Q.glyphs("text"))} AS t, greatest(10.0, size) / base_size AS r FROM e JOIN roles USING (doc_id, page_no, element_no) JOIN base USING (doc_id)), hu AS (SELECT *, upper(t) = t AND lower(t) <> t AND length(t) >= 3 AS up FROM hd),
  hl AS (SELECT *, CAST({core._HEADING_SQL} AS INTEGER) AS level, [struct_pack(text := t, is_bold := bold, is_italic := false, is_code := false, font_size := CAST(size AS DOUBLE), font_name := 'helv', link_url := CAST(NULL AS VARCHAR))] AS spans FROM hu),
  n AS (SELECT doc_id, page_no, element_no AS node_no, role, level, CASE WHEN level IS NOT NULL THEN 'heading' WHEN regexp_matches(t, {Q.q(X.BULLET)}) OR regexp_matches(t, {Q.q(X.NUMBERED_ITEM)}) THEN 'list' ELSE 'paragraph' END AS kind,
      regexp_matches(t, {Q.q(X.NUMBERED_ITEM)}) AS ordered, spans, [struct_pack(spans := spans, level := 0, marker := CAST(NULL AS VARCHAR))] AS items, struct_pack(x0 := x, y0 := y, x1 := x + width, y1 := y + height) AS bbox,
      CAST(NULL AS {_SPAN}[]) AS name_spans, CAST(NULL AS {_SPAN}[]) AS title_spans, CAST(NULL AS {_SPAN}[]) AS contact_spans, CAST(NULL AS VARCHAR[]) AS headers, CAST(NULL AS VARCHAR[][]) AS rows, CAST(NULL AS VARCHAR[]) AS alignments FROM hl)"""


@query(
    f"""WITH {_LAID_OUT}, {Q.REGIONS}, {Q.columns(False)}, c AS (SELECT doc_id, page_no, reading_order, {Q.node()} AS chunk FROM ordered WHERE role NOT IN ('header', 'footer', 'page_number', 'watermark', 'annotation'))
    SELECT doc_id, {Q.strip("string_agg(chunk, chr(10) ORDER BY page_no, reading_order)")} || chr(10) AS markdown FROM c WHERE chunk <> '' GROUP BY doc_id"""
)
def layout_markdown(spark: SparkSession, d: str) -> DataFrame:
    """From plain text to Markdown: layout, base size, headings and lists, repeated bands, roles, regions, reading order, rendering."""
    return from_text.markdown_of_texts(core._t(spark, d, "documents"))


@query(f"WITH {_LAID_OUT} SELECT doc_id, page_no, node_no, kind, role, level FROM n")
def layout_nodes(spark: SparkSession, d: str) -> DataFrame:
    return from_text.classified_nodes(from_text.line_elements(core._t(spark, d, "documents"))).select("doc_id", "page_no", "node_no", "kind", "role", "level")


# ---- Markdown with headers and entries

_SIZES = "coalesce(list_max(list_transform(spans, lambda s: coalesce(s.font_size, 0))), 0)"
_PARTS = "CASE WHEN title THEN 'title' WHEN taken THEN 'metadata' WHEN NOT coalesce(opened > coalesce(ended, 0), false) THEN 'single' WHEN kind = 'list' THEN 'bullet' ELSE 'body' END"
_STRUCTURED = f"""{Q.REGIONS}, {Q.columns(True)}, hs AS (SELECT *, {Q.node_text()} AS ht, {_SIZES} AS top, region_id = 0 AND is_full AS first FROM ordered), hm AS (SELECT *, max(CASE WHEN first THEN top END) OVER (PARTITION BY doc_id, page_no) AS largest FROM hs),
  hp AS (SELECT *, CASE WHEN NOT first OR ht = '' THEN NULL WHEN top >= largest - 1 THEN 'name' WHEN regexp_matches(ht, {Q.q(X.CONTACT)}) OR contains(lower(ht), 'address') THEN 'contact' WHEN top >= largest - 6 AND bbox.y0 <= 150 THEN 'title' ELSE 'body' END AS hpart FROM hm),
  hf AS (SELECT *, coalesce(bool_or(hpart IN ('name', 'title', 'contact')) OVER (PARTITION BY doc_id, page_no), false) AS found FROM hp),
  hd2 AS (SELECT doc_id, page_no, {", ".join(f"coalesce(flatten(list(spans ORDER BY reading_order) FILTER (WHERE hpart = '{p}')), []) AS {p}" for p in ("name", "title", "contact"))} FROM hf WHERE hpart IN ('name', 'title', 'contact') GROUP BY ALL),
  head AS (SELECT doc_id, page_no, -1 AS a, 0 AS b, 0 AS c, {Q.joined(Q.chunk(Q.q("# "), Q.strip(f"replace({Q.spans('name')}, '**', '')")), Q.chunk(Q.q("## "), Q.strip(f"replace({Q.spans('title')}, '**', '')")), Q.chunk(Q.q(""), Q.spans("contact")))} AS chunk FROM hd2),
  kept AS (SELECT * EXCLUDE (ht, top, first, largest, found) FROM hf WHERE NOT first OR NOT found OR hpart = 'body'), {core._entries("kept")},
  pt AS (SELECT *, {_PARTS} AS part, CASE WHEN opened > coalesce(ended, 0) THEN entry END AS no FROM o), pe AS (SELECT *, CASE WHEN no IS NULL THEN reading_order ELSE min(reading_order) OVER (PARTITION BY doc_id, page_no, region_id, col_no, no) END AS a, {Q.spans("spans")} AS own FROM pt),
  body AS (SELECT doc_id, page_no, a, CASE part WHEN 'metadata' THEN 1 WHEN 'body' THEN 2 WHEN 'bullet' THEN 3 ELSE 0 END AS b, reading_order AS c, CASE WHEN part = 'title' THEN {Q.chunk(Q.q("### "), "own")} WHEN part = 'metadata' AND own <> '' THEN chr(10) || '*' || own || '*' || chr(10)
      WHEN part = 'bullet' THEN {Q.chunk(Q.q(""), Q.listed())} WHEN part IN ('metadata', 'body') THEN {Q.chunk(Q.q(""), "own")} WHEN coalesce(role, '') NOT IN ('header', 'footer', 'page_number', 'watermark', 'annotation') THEN {Q.node()} END AS chunk FROM pe),
  every AS (SELECT * FROM head UNION ALL SELECT * FROM body)
SELECT doc_id, {Q.strip("string_agg(chunk, chr(10) ORDER BY page_no, a, b, c)")} || chr(10) AS markdown FROM every WHERE chunk <> '' GROUP BY doc_id"""


@query(f"WITH {Q.N}, {Q.P}, {_STRUCTURED}")
def structured_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a header of name, title and contact, and entries with what belongs to them."""
    return structured.structured_markdown(core._nodes(spark, d), core._pages(spark, d))


@query(f"WITH {_LAID_OUT}, {_STRUCTURED}")
def layout_markdown_structured(spark: SparkSession, d: str) -> DataFrame:
    """The same from plain texts."""
    return structured.structured_markdown(from_text.classified_nodes(from_text.line_elements(core._t(spark, d, "documents"))))


# ---- extraction and compiling


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return core._pages(spark, d).select("doc_id", "page_no", F.coalesce("is_ocr", F.col("kind") == "scanned", F.lit(False)).alias("scanned"))


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(elements, native words): lines of native pages and words of scanned ones, from the given elements."""
    e = core._elements(spark, d).join(_scanned(spark, d), ["doc_id", "page_no"])
    lines, read = e.where("NOT scanned").withColumn("line_no", F.col("element_no")), e.where("scanned")
    native = words.words_of(lines)
    return extract.elements_of(lines, native, words.words_of(read)), native


@query()
def extracted_elements(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d)[0]


@query()
def extracted_pages(spark: SparkSession, d: str) -> DataFrame:
    elements, native = _extracted(spark, d)
    return extract.page_records(core._pages(spark, d), elements, native)


@query(
    f"""WITH {Q.E}, c AS (SELECT *, unnest(range(0, length(text))) AS i FROM e WHERE length(text) > 0)
    SELECT doc_id, page_no, element_no AS line_no, CAST(i AS INTEGER) AS char_no, substr(text, CAST(i + 1 AS INTEGER), 1) AS c, round(x + i * (width / length(text)) + 1e-9, 4) AS x0, round(x + i * (width / length(text)) + width / length(text) + 1e-9, 4) AS x1 FROM c"""
)
def char_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = editing.chars_of(core._elements(spark, d).withColumn("line_no", F.col("element_no")))
    rows = lines.select("doc_id", "page_no", "line_no", F.posexplode("chars").alias("char_no", "ch"))
    return rows.select("doc_id", "page_no", "line_no", "char_no", "ch.c", *[F.round(F.col(f"ch.{k}") + 1e-9, 4).alias(k) for k in ("x0", "x1")])


@query()
def compile_ops(spark: SparkSession, d: str) -> DataFrame:
    e = core._elements(spark, d)
    return plans.compile_ops(editing.edit_targets(e), e)


@query()
def text_similarity(spark: SparkSession, d: str) -> DataFrame:
    e = core._elements(spark, d).where("text <> original_text")
    return e.select("doc_id", "page_no", "element_no", F.round(U.sequence_ratio("text", "original_text"), 6).alias("similarity"))


# ---- fonts, tables, OCR results, forms


@query(
    f"""WITH {Q.N}, s AS (SELECT doc_id, page_no, node_no, unnest(range(0, len(spans))) AS i, spans FROM n), f AS (SELECT doc_id, page_no, node_no, i, lower(spans[i + 1].font_name) AS font, CASE WHEN spans[i + 1].is_bold THEN 2 ELSE 0 END + CASE WHEN spans[i + 1].is_italic THEN 1 ELSE 0 END AS flags FROM s)
    SELECT doc_id, page_no, node_no, CAST(i AS INTEGER) AS span_no, (flags & 2) <> 0 OR coalesce(regexp_matches(font, 'bold|black|heavy'), false) AS bold, (flags & 1) <> 0 OR coalesce(regexp_matches(font, 'italic|oblique'), false) AS italic FROM f"""
)
def font_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = core._nodes(spark, d).select("doc_id", "page_no", "node_no", F.posexplode("spans").alias("span_no", "s"))
    flags = F.when(F.col("s.is_bold"), 2).otherwise(0) + F.when(F.col("s.is_italic"), 1).otherwise(0)
    return rows.select("doc_id", "page_no", "node_no", "span_no", X.bold_font(F.col("s.font_name"), flags).alias("bold"), X.italic_font(F.col("s.font_name"), flags).alias("italic"))


@query(
    f"""WITH {Q.N}, r AS (SELECT doc_id, page_no, node_no, list_concat([coalesce(headers, [])], coalesce(rows, [])) AS rs FROM n WHERE kind = 'table'),
    a AS (SELECT doc_id, rs, coalesce(sum(len(rs)) OVER (PARTITION BY doc_id ORDER BY page_no, node_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM r),
    x AS (SELECT doc_id, above, unnest(range(0, len(rs))) AS i, rs FROM a), c AS (SELECT doc_id, CAST(above + i AS INTEGER) AS row_no, rs[i + 1] AS cells FROM x), y AS (SELECT *, unnest(range(0, len(cells))) AS k FROM c)
    SELECT doc_id, row_no, CAST(k AS INTEGER) AS col_no, cells[k + 1] AS text FROM y"""
)
def stacked_tables(spark: SparkSession, d: str) -> DataFrame:
    return tables.stacked(core._nodes(spark, d))


_STACK = f"""{Q.N}, r AS (SELECT doc_id, page_no, node_no, list_concat([coalesce(headers, [])], coalesce(rows, [])) AS rs FROM n WHERE kind = 'table'),
  a AS (SELECT doc_id, rs, coalesce(sum(len(rs)) OVER (PARTITION BY doc_id ORDER BY page_no, node_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM r), x AS (SELECT doc_id, above, unnest(range(0, len(rs))) AS i, rs FROM a)"""


@query(
    f"""WITH {_STACK} SELECT doc_id, CAST(above + i AS INTEGER) AS row_no, array_to_string(list_transform(rs[i + 1], lambda c: '"' || replace(coalesce(c, ''), '"', '""') || '"'), ',') AS line FROM x WHERE len(rs[i + 1]) > 0
    UNION ALL SELECT DISTINCT doc_id, 0, '"No tables found"' FROM n WHERE doc_id NOT IN (SELECT doc_id FROM x WHERE len(rs[i + 1]) > 0)"""
)
def table_csv(spark: SparkSession, d: str) -> DataFrame:
    n = core._nodes(spark, d)
    return writers.csv_rows(tables.stacked(n), n)


@query(
    f"""WITH {Q.P}, {Q.E}, s AS (SELECT e.* FROM e JOIN p USING (doc_id, page_no) WHERE coalesce(p.is_ocr, p.kind = 'scanned', false)), di AS (SELECT * FROM s WHERE {core._DIRTY}),
    ops AS (SELECT doc_id, page_no, 0 AS phase, 'paint' AS op, element_no, x * 2 - 1 AS x0, y * 2 - 1 AS y0, (x + width) * 2 + 1 AS x1, (y + height) * 2 + 1 AS y1, NULL AS text, CASE WHEN lower(bg_color) = 'transparent' THEN '#ffffff' ELSE coalesce(bg_color, '#ffffff') END AS color FROM di WHERE width > 0 AND height > 0
      UNION ALL SELECT DISTINCT doc_id, page_no, 1, 'image', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM di UNION ALL SELECT doc_id, page_no, 2, 'text', element_no, x, y + 0.85 * height, NULL, NULL, text, coalesce(text_color, '#000000') FROM di WHERE text <> '')
    SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY phase, element_no) AS INTEGER) AS seq, op, element_no, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, text, color FROM ops"""
)
def image_ops(spark: SparkSession, d: str) -> DataFrame:
    e = core._elements(spark, d).join(_scanned(spark, d).where("scanned").select("doc_id", "page_no"), ["doc_id", "page_no"])
    return plans.image_ops(e)


@query(
    f"""WITH {Q.P}, c AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_pages FROM p GROUP BY doc_id), r AS (SELECT doc_id || '/' || page_no AS request_id, doc_id, page_no - 1 + word_count % 3 AS page, CAST((word_count * 7) % 5 * 72 AS DOUBLE) AS dpi FROM p WHERE word_count IS NOT NULL),
    v AS (SELECT r.*, CASE WHEN page < 1 THEN 'Page number must be 1 or greater' WHEN dpi <= 0 THEN 'DPI must be greater than 0' WHEN page > n_pages THEN 'Invalid page ' || page || '; document has ' || n_pages || ' pages' END AS error FROM r JOIN c USING (doc_id))
    SELECT request_id, doc_id, page, error, CASE WHEN error IS NULL THEN round(dpi / 72, 6) END AS zoom FROM v"""
)
def render_requests(spark: SparkSession, d: str) -> DataFrame:
    p = core._pages(spark, d)
    n = F.col("word_count")
    requests = p.where(n.isNotNull()).select(F.concat_ws("/", "doc_id", "page_no").alias("request_id"), "doc_id", (F.col("page_no") - 1 + n % 3).alias("page"), ((n * 7) % 5 * 72).cast("double").alias("dpi"))
    return plans.render_requests(requests, p.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages")))


@query(
    """WITH i AS (SELECT DISTINCT task_id AS job_id, file_id AS position, CASE WHEN file_id % 11 = 0 THEN '  ' ELSE path END AS key, CASE WHEN file_id % 2 = 0 THEN path || '.PNG' END AS name FROM sources),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY job_id ORDER BY position, key, name) AS INTEGER) AS seq, regexp_replace(coalesce(key, ''), '^ +| +$', '', 'g') AS k FROM i), x AS (SELECT *, lower(regexp_extract(coalesce(name, k), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM o)
    SELECT job_id, seq, k AS key, 'image-' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END || CASE WHEN ext IN ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp', 'txt', 'json') THEN '.' || ext ELSE '.img' END AS local_name, CASE WHEN k = '' THEN 'missing object key for image #' || seq END AS error FROM x"""
)
def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    """Source files as images of their task; some have no key, others a name of their own."""
    i = F.col("file_id")
    rows = core._t(spark, d, "sources").select(F.col("task_id").alias("job_id"), i.alias("position"), F.when(i % 11 == 0, "  ").otherwise(F.col("path")).alias("key"), F.when(i % 2 == 0, F.concat("path", F.lit(".PNG"))).alias("name")).distinct()
    return plans.merge_plan(rows)


@query(
    f"""WITH {Q.E}, {Q.WORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY word_no) - 1 AS place FROM w)
    SELECT doc_id, page_no, CAST(place AS INTEGER) AS word_no, text, conf, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM k
    WHERE conf >= 30 AND NOT regexp_matches(text, '^[^\\p{{L}}\\p{{N}}]$') AND NOT regexp_matches(text, '^[-_|\\\\/.,;:''\"]+$')"""
)
def ocr_dict_words(spark: SparkSession, d: str) -> DataFrame:
    """Words packed as an engine gives them, one list a field, at a zoom of 2, and read again."""
    w = F.col("w")
    packed = words.words_of(core._elements(spark, d)).groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("word_no", "text", "conf", "x0", "y0", "x1", "y1"))).alias("w"))

    def field(of) -> object:
        return F.transform(w, of)

    data = F.struct(
        field(lambda x: x["text"]).alias("text"), field(lambda x: x["x0"] * 2).alias("left"), field(lambda x: x["y0"] * 2).alias("top"), field(lambda x: (x["x1"] - x["x0"]) * 2).alias("width"), field(lambda x: (x["y1"] - x["y0"]) * 2).alias("height"), field(lambda x: x["conf"].cast("string")).alias("conf")
    )
    rows = readers.dict_words(packed.select("doc_id", "page_no", data.alias("data")))
    return rows.select("doc_id", "page_no", "word_no", "text", "conf", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"WITH {Q.P} SELECT doc_id, page_no, CAST(i AS INTEGER) AS box_no, page_no + 1 AS page, width * 0.1 * (i + 1) AS x, height * 0.2 AS y, 0.3 AS width, 0.05 AS height FROM p, range(0, 2) r(i)")
def form_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a form as JSON, and read again."""
    box = [F.struct((F.col("page_no") + 1).alias("page"), (F.col("width") * 0.1 * (i + 1)).alias("x"), (F.col("height") * 0.2).alias("y"), F.lit(0.3).alias("width"), F.lit(0.05).alias("height")) for i in range(2)]
    return readers.form_boxes(core._pages(spark, d).select("doc_id", "page_no", F.to_json(F.array(*box)).alias("boxes")))


@query(f"WITH j AS (SELECT DISTINCT job_id, tool, owner FROM ocr_jobs), k AS (SELECT *, unnest([coalesce(tool, ''), ' ', coalesce(owner, ' ')]) AS word, generate_subscripts([1, 2, 3], 1) - 1 AS i FROM j) SELECT job_id, tool, owner, CAST(i AS INTEGER) AS keyword_no, {Q.strip('word')} AS keyword FROM k WHERE {Q.strip('word')} <> ''")
def form_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = core._t(spark, d, "ocr_jobs").select("job_id", "tool", "owner").distinct()
    return readers.form_keywords(rows.withColumn("keywords", F.concat_ws("|||", F.coalesce("tool", F.lit("")), F.lit(" "), F.coalesce("owner", F.lit(" ")))))
