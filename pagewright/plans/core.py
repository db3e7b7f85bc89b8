"""Queries of the document operators over whole tables, each beside the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import udf as U
from ..operators import editing, layout, pages, plans, records, render, service, source_facts, spatial, tables, words
from ..sources import readers, writers
from ..streaming import jobs
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return pages.unique(_t(spark, d, "elements"), "doc_id", "page_no", "element_no")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return pages.unique(_t(spark, d, "nodes"), "doc_id", "page_no", "node_no")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.unique(_t(spark, d, "extract_pages"), "doc_id", "page_no")


# ---- rendering


@query(
    f"""WITH {Q.N}, c AS (SELECT doc_id, page_no, node_no, {Q.node()} AS chunk FROM n WHERE coalesce(role, '') NOT IN ('header', 'footer', 'page_number', 'watermark', 'annotation'))
    SELECT doc_id, {Q.strip("string_agg(chunk, chr(10) ORDER BY page_no, node_no)")} || chr(10) AS markdown FROM c WHERE chunk <> '' GROUP BY doc_id"""
)
def doc_markdown(spark: SparkSession, d: str) -> DataFrame:
    return render.document_markdown(_nodes(spark, d))


@query(
    f"""WITH {Q.N}, c AS (SELECT doc_id, page_no, node_no, {Q.node()} AS chunk FROM n WHERE coalesce(role, '') NOT IN ('header', 'footer', 'page_number', 'watermark', 'annotation'))
    SELECT doc_id, page_no, string_agg(chunk, chr(10) ORDER BY node_no) AS markdown FROM c WHERE chunk <> '' GROUP BY doc_id, page_no"""
)
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return render.page_markdown(_nodes(spark, d))


@query(f"WITH {Q.N} SELECT doc_id, page_no, node_no, kind, {Q.node()} AS chunk FROM n")
def node_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("doc_id", "page_no", "node_no", "kind", render.node_markdown().alias("chunk"))


@query(f"WITH {Q.N} SELECT doc_id, page_no, node_no, {Q.table()} AS gfm FROM n WHERE kind = 'table'")
def table_gfm(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("kind = 'table'").select("doc_id", "page_no", "node_no", X.table_markdown("headers", "rows", "alignments").alias("gfm"))


@query(f"WITH {Q.N} SELECT doc_id, page_no, node_no, {Q.listed()} AS md FROM n WHERE kind = 'list'")
def list_md(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("kind = 'list'").select("doc_id", "page_no", "node_no", F.coalesce(X.list_markdown("items", "ordered"), F.lit("")).alias("md"))


@query(f"WITH {Q.E} SELECT doc_id, page_no, element_no, {Q.escape('text')} AS escaped, {Q.glyphs('text')} AS glyphs FROM e WHERE text IS NOT NULL")
def text_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).where("text IS NOT NULL").select("doc_id", "page_no", "element_no", X.markdown_escape("text").alias("escaped"), X.glyphs("text").alias("glyphs"))


@query(f"WITH {Q.N} SELECT doc_id, page_no, node_no, role FROM n WHERE coalesce(role, '') NOT IN ('header', 'footer', 'page_number', 'watermark', 'annotation')")
def visible_nodes(spark: SparkSession, d: str) -> DataFrame:
    return render.visible(_nodes(spark, d)).select("doc_id", "page_no", "node_no", "role")


_PAGE_TEXT = f"WITH {Q.E}, t AS (SELECT doc_id, page_no, string_agg(text, chr(10) ORDER BY y, element_no) AS text FROM e WHERE text IS NOT NULL GROUP BY ALL)"


def _page_text(spark: SparkSession, d: str) -> DataFrame:
    lines = _elements(spark, d).where("text IS NOT NULL").groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("y", "element_no", "text"))).alias("ls"))
    return lines.select("doc_id", "page_no", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text"))


@query(
    f"""{_PAGE_TEXT} SELECT doc_id, string_agg('--- START OF PAGE ' || page_no || ' ---' || chr(10) || regexp_replace(text, '[{X.SPACE}]+$', '') || chr(10) || '--- END OF PAGE ---' || chr(10) || chr(10), '' ORDER BY page_no) AS text
    FROM t WHERE {Q.strip("text")} <> '' GROUP BY doc_id"""
)
def text_with_page_markers(spark: SparkSession, d: str) -> DataFrame:
    return render.marked_text(_page_text(spark, d))


@query(
    f"""{_PAGE_TEXT}, {Q.P}, c AS (SELECT p.doc_id, p.page_no, length(coalesce({Q.strip("t.text")}, '')) AS n FROM p LEFT JOIN t USING (doc_id, page_no))
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_chars, count(*) AS n_pages, sum(n) < 50 * count(*) AS text_poor FROM c GROUP BY doc_id"""
)
def text_poor_docs(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("doc_id", "page_no").join(_page_text(spark, d), ["doc_id", "page_no"], "left")
    n = F.sum(F.length(F.coalesce(X.strip("text"), F.lit(""))))
    return rows.groupBy("doc_id").agg(n.alias("n_chars"), F.count("*").alias("n_pages"), (n < 50 * F.count("*")).alias("text_poor"))


@query(
    f"""WITH {Q.E}, {Q.P}, a AS (SELECT e.doc_id, e.page_no, {Q.strip("string_agg(text, chr(10) ORDER BY y, element_no) FILTER (WHERE NOT scanned)")} AS native, {Q.strip("string_agg(text, chr(10) ORDER BY y, element_no) FILTER (WHERE scanned)")} AS ocr
      FROM (SELECT e.*, coalesce(p.is_ocr, p.kind = 'scanned') AS scanned FROM e JOIN p USING (doc_id, page_no) WHERE text IS NOT NULL) e GROUP BY ALL)
    SELECT doc_id, page_no, coalesce(nullif(native, ''), ocr) AS text FROM a"""
)
def native_first_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _elements(spark, d).where("text IS NOT NULL").join(_pages(spark, d).select("doc_id", "page_no", F.coalesce("is_ocr", F.col("kind") == "scanned").alias("scanned")), ["doc_id", "page_no"])

    def text(test) -> object:
        return F.sort_array(F.collect_list(F.when(test, F.struct("y", "element_no", "text"))))

    def joined(c: str) -> object:
        return F.when(F.size(c) > 0, X.strip(F.array_join(F.transform(c, lambda x: x["text"]), "\n")))

    both = rows.groupBy("doc_id", "page_no").agg(text(~F.col("scanned")).alias("a"), text(F.col("scanned")).alias("b"))
    return both.select("doc_id", "page_no", F.coalesce(F.nullif(joined("a"), F.lit("")), joined("b")).alias("text"))


# ---- pages


_STATS = f"""WITH {Q.E}, {Q.P}, a AS (SELECT doc_id, page_no, count(*) AS n, sum(greatest(0, width * height)) AS t FROM e GROUP BY ALL),
  st AS (SELECT p.doc_id, p.page_no, p.word_count, p.image_block_count, coalesce(a.n, 0) AS n_elements, round(least(1.0, round(coalesce(a.t, 0.0), 3) / greatest(1.0, p.width * p.height) + 1e-12), 6) AS text_ratio, least(1.0, coalesce(p.image_block_count, 0) / 8) AS image_ratio FROM p LEFT JOIN a USING (doc_id, page_no))"""


@query(f"{_STATS} SELECT * FROM st")
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_stats(_pages(spark, d), _elements(spark, d))


@query(
    f"""{_STATS} SELECT doc_id, page_no,
    CASE WHEN word_count = 0 AND image_block_count = 0 THEN 'blank' WHEN word_count = 0 THEN 'scanned' WHEN image_block_count = 0 THEN 'text'
      WHEN (image_ratio >= 0.5 AND text_ratio <= 0.12) OR (image_ratio >= 0.15 AND text_ratio >= 0.01) THEN 'mixed' ELSE 'text' END AS by_area,
    CASE WHEN word_count = 0 AND image_block_count = 0 THEN 'blank' WHEN word_count = 0 THEN 'scanned' WHEN image_block_count = 0 THEN 'text' ELSE 'mixed' END AS by_count,
    CASE WHEN word_count = 0 AND image_ratio <= 0.05 THEN 'EMPTY' WHEN word_count < 15 AND image_ratio > 0.45 THEN 'SCANNED' WHEN word_count >= 15 AND image_ratio > 0.40 AND text_ratio * image_ratio > 0.10 THEN 'MIXED'
      WHEN word_count > 0 THEN 'NATIVE' ELSE 'UNCERTAIN' END AS by_content FROM st"""
)
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    st = pages.page_stats(_pages(spark, d), _elements(spark, d))
    return st.select(
        "doc_id", "page_no", pages.kind_by_area(c("word_count"), c("image_block_count"), c("image_ratio"), c("text_ratio")).alias("by_area"),
        pages.kind_by_count(c("word_count"), c("image_block_count")).alias("by_count"), pages.content_class(c("word_count"), c("image_ratio"), c("text_ratio")).alias("by_content"),
    )


_BASE = f"""z AS (SELECT doc_id, round(size, 1) AS size, length({Q.strip("text")}) AS k, page_no, element_no FROM e WHERE size IS NOT NULL AND length({Q.strip("text")}) > 0),
  zw AS (SELECT doc_id, size, sum(k) AS weight, min(page_no * 1000000 + element_no) AS first FROM z GROUP BY ALL),
  base AS (SELECT d.doc_id, coalesce(b.size, 10.0) AS base_size FROM (SELECT DISTINCT doc_id FROM e) d LEFT JOIN (SELECT doc_id, size FROM zw QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first) = 1) b USING (doc_id))"""


@query(f"WITH {Q.E}, {_BASE} SELECT * FROM base")
def base_font_size(spark: SparkSession, d: str) -> DataFrame:
    return pages.base_font_size(_elements(spark, d))


_BANDS = f"""b AS (SELECT e.*, p.width AS page_width, p.height AS page_height, {Q.strip("text")} AS line, CASE WHEN e.y + e.height <= 0.08 * p.height THEN 'header' WHEN e.y >= 0.90 * p.height THEN 'footer' END AS band FROM e JOIN p USING (doc_id, page_no)),
  rep AS (SELECT doc_id, band, line, count(*) AS n FROM b WHERE band IS NOT NULL AND line <> '' GROUP BY ALL HAVING count(*) >= 2)"""


@query(f"WITH {Q.E}, {Q.P}, {_BANDS} SELECT * FROM rep")
def repeated_bands(spark: SparkSession, d: str) -> DataFrame:
    return pages.repeated_bands(pages.bands(_elements(spark, d), _pages(spark, d)))


_MARK = " OR ".join(f"upper(coalesce(text, '')) LIKE '%{w}%'" for w in X.WATERMARKS)


_ROLES = f"""{_BANDS}, {_BASE}, m AS (SELECT b.*, rep.n IS NOT NULL AS again, CASE WHEN {_MARK} THEN 2.0 ELSE 0 END + CASE WHEN size / base_size >= 1.4 THEN 1.5 ELSE 0 END
      + CASE WHEN (x + x + width) / 2 / page_width BETWEEN 0.2 AND 0.8 AND (y + y + height) / 2 / page_height BETWEEN 0.25 AND 0.75 THEN 1.5 ELSE 0 END AS score
      FROM b LEFT JOIN rep USING (doc_id, band, line) JOIN base USING (doc_id)),
  roles AS (SELECT doc_id, page_no, element_no, CASE WHEN coalesce(line, '') = '' THEN 'primary' WHEN score >= 3.5 THEN 'watermark' WHEN band = 'header' AND again THEN 'header'
      WHEN band = 'footer' AND regexp_matches(line, {Q.q(X.PAGE_NUMBER)}) THEN 'page_number' WHEN band = 'footer' AND again THEN 'footer' ELSE 'primary' END AS role FROM m)"""


@query(f"WITH {Q.E}, {Q.P}, {_ROLES} SELECT * FROM roles")
def content_roles(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    banded = pages.bands(e, _pages(spark, d))
    return pages.content_roles(banded, pages.repeated_bands(banded), pages.base_font_size(e))


def _literal(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


@query(f"WITH {Q.E}, {Q.P}, {_ROLES} SELECT doc_id, page_no, element_no, score + CASE WHEN again THEN 2.0 ELSE 0 END AS score FROM m WHERE size IS NOT NULL AND text IS NOT NULL")
def watermark_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all elements; a line counts as repeated if it is so in its band."""
    c = F.col
    e = _elements(spark, d)
    banded = pages.bands(e, _pages(spark, d))
    rows = banded.join(pages.repeated_bands(banded).select("doc_id", "band", "line", F.lit(True).alias("again")), ["doc_id", "band", "line"], "left").join(pages.base_font_size(e), "doc_id").where("size IS NOT NULL AND text IS NOT NULL")
    score = pages.watermark_score(c("text"), c("x"), c("y"), c("x") + c("width"), c("y") + c("height"), c("page_width"), c("page_height"), F.lit(False), c("size"), c("base_size"), F.lit(1.0), F.coalesce("again", F.lit(False)))
    return rows.select("doc_id", "page_no", "element_no", score.alias("score"))


# ---- headings, lists, layout


_HEADING_SQL = f"""CASE WHEN t IS NULL OR t = '' OR regexp_matches(t, '[.,;]$') OR (contains(t, ':') AND length({Q.strip("split_part(t, ':', 1)")}) < 35 AND length(t) > length({Q.strip("split_part(t, ':', 1)")}) + 2) THEN NULL
  WHEN r >= 1.70 OR (r >= 1.45 AND (bold OR up)) THEN 1 WHEN r >= 1.35 OR (r >= 1.20 AND (bold OR up)) THEN 2 WHEN r >= 1.20 OR (r >= 1.12 AND bold AND up) THEN 3
  WHEN up AND bold AND length(t) < 40 THEN 2 WHEN regexp_matches(t, {Q.q(X.NUMBERED_HEADING)}) AND length(t) < 80 THEN 3 END"""


@query(
    f"""WITH {Q.E}, {_BASE}, h AS (SELECT doc_id, page_no, element_no, {Q.strip("text")} AS t, size / base_size AS r, coalesce(bold, false) AS bold FROM e JOIN base USING (doc_id)),
    u AS (SELECT *, upper(t) = t AND lower(t) <> t AND length(t) >= 3 AS up FROM h) SELECT doc_id, page_no, element_no, CAST({_HEADING_SQL} AS INTEGER) AS level FROM u"""
)
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    rows = e.join(pages.base_font_size(e), "doc_id").withColumn("t", X.strip("text"))
    return rows.select("doc_id", "page_no", "element_no", layout.heading_level(F.col("t"), F.col("size"), F.col("base_size"), F.coalesce("bold", F.lit(False)), F.lit(True)).alias("level"))


@query(
    f"""WITH {Q.E}, t AS (SELECT doc_id, page_no, element_no, {Q.strip("text")} AS t FROM e WHERE text IS NOT NULL)
    SELECT doc_id, page_no, element_no, regexp_matches(t, {Q.q(X.BULLET)}) AS bullet, regexp_matches(t, {Q.q(X.NUMBERED_ITEM)}) AS ordered, regexp_matches(t, {Q.q(X.METADATA)}) AS metadata, regexp_matches(t, {Q.q(X.CONTACT)}) AS contact, regexp_matches(t, {Q.q(X.PAGE_NUMBER)}) AS page_number FROM t"""
)
def line_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = _elements(spark, d).where("text IS NOT NULL").select("doc_id", "page_no", "element_no", X.strip("text").alias("t"))
    named = {"bullet": X.BULLET, "ordered": X.NUMBERED_ITEM, "metadata": X.METADATA, "contact": X.CONTACT, "page_number": X.PAGE_NUMBER}
    return rows.select("doc_id", "page_no", "element_no", *[F.col("t").rlike(p).alias(k) for k, p in named.items()])


def _regioned(spark: SparkSession, d: str) -> DataFrame:
    return layout.regions(_nodes(spark, d), _pages(spark, d))


@query(f"WITH {Q.N}, {Q.P}, {Q.REGIONS} SELECT doc_id, page_no, region_id, CASE WHEN bool_or(is_full) THEN 'full_width' ELSE 'multi_column' END AS region_kind, min(bbox.y0) AS y0, max(bbox.y1) AS y1, count(*) AS n FROM regioned GROUP BY ALL")
def layout_regions(spark: SparkSession, d: str) -> DataFrame:
    return layout.region_bounds(_regioned(spark, d))


@query(f"WITH {Q.N}, {Q.P}, {Q.REGIONS}, {Q.columns(False)} SELECT doc_id, page_no, node_no, region_id, col_no, reading_order FROM ordered")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(layout.columns(_regioned(spark, d))).select("doc_id", "page_no", "node_no", "region_id", "col_no", "reading_order")


@query(f"WITH {Q.N}, {Q.P}, {Q.REGIONS}, {Q.columns(True)} SELECT doc_id, page_no, node_no, region_id, col_no, gutter FROM columned")
def grouper_columns(spark: SparkSession, d: str) -> DataFrame:
    return layout.columns(_regioned(spark, d), grouper=True).select("doc_id", "page_no", "node_no", "region_id", "col_no", "gutter")


@query(
    f"""WITH {Q.N}, {Q.P}, {Q.REGIONS}, {Q.columns(False)}, t AS (SELECT *, {Q.node_text()} AS t, {Q.any_span("s.is_bold")} AS bold, {Q.any_span("s.is_italic")} AS italic FROM ordered),
    u AS (SELECT *, len({Q.words("t")}) AS k FROM t), v AS (SELECT *, (regexp_matches(t, {Q.q(X.METADATA)}) OR italic) AND k <= 16 AS meta FROM u),
    x AS (SELECT *, lead(meta) OVER w AS m1, lead(k, 2) OVER w AS k2 FROM v WINDOW w AS (PARTITION BY doc_id, page_no, region_id, col_no ORDER BY reading_order))
    SELECT doc_id, page_no, node_no, round(CASE WHEN t <> '' AND length(t) <= 120 AND NOT regexp_matches(t, '\\.$') AND k <= 12 THEN CASE WHEN bold THEN 0.35 ELSE 0 END + CASE WHEN spans[1].font_size >= 10 THEN 0.15 ELSE 0 END
      + CASE WHEN k <= 8 THEN 0.15 ELSE 0 END + CASE WHEN m1 THEN 0.25 ELSE 0 END + CASE WHEN k2 > 10 THEN 0.10 ELSE 0 END ELSE 0 END, 6) AS score FROM x"""
)
def entry_scores(spark: SparkSession, d: str) -> DataFrame:
    return layout.entry_scores(layout.reading_order(layout.columns(_regioned(spark, d))))


@query(
    f"""WITH {Q.N}, {Q.P}, {Q.REGIONS}, t AS (SELECT doc_id, page_no, node_no, bbox, {Q.node_text()} AS t, coalesce(list_max(list_transform(spans, lambda s: coalesce(s.font_size, 0))), 0) AS top FROM regioned WHERE region_id = 0 AND is_full),
    u AS (SELECT *, max(top) OVER (PARTITION BY doc_id, page_no) AS largest FROM t)
    SELECT doc_id, page_no, node_no, CASE WHEN top >= largest - 1 THEN 'name' WHEN regexp_matches(t, {Q.q(X.CONTACT)}) OR contains(lower(t), 'address') THEN 'contact' WHEN top >= largest - 6 AND bbox.y0 <= 150 THEN 'title' ELSE 'body' END AS part FROM u WHERE t <> ''"""
)
def header_parts(spark: SparkSession, d: str) -> DataFrame:
    return layout.header_parts(_regioned(spark, d))


def _entries(source: str) -> str:
    """Steps that end in ``o``: the rows of ``source`` with what opens, belongs to and ends an entry."""
    return f"""et AS (SELECT *, {Q.node_text()} AS t, {Q.any_span("s.is_bold")} AS bold, {Q.any_span("s.is_italic")} AS italic FROM {source}),
    eu AS (SELECT *, len({Q.words("t")}) AS k FROM et), ev AS (SELECT *, (regexp_matches(t, {Q.q(X.METADATA)}) OR italic) AND k <= 16 AS meta FROM eu),
    ex AS (SELECT *, lead(meta) OVER w AS m1, lead(k, 2) OVER w AS k2, row_number() OVER w AS place FROM ev WINDOW w AS (PARTITION BY doc_id, page_no, region_id, col_no ORDER BY reading_order)),
    sc AS (SELECT *, round(CASE WHEN t <> '' AND length(t) <= 120 AND NOT regexp_matches(t, '\\.$') AND k <= 12 THEN CASE WHEN bold THEN 0.35 ELSE 0 END + CASE WHEN spans[1].font_size >= 10 THEN 0.15 ELSE 0 END
      + CASE WHEN k <= 8 THEN 0.15 ELSE 0 END + CASE WHEN m1 THEN 0.25 ELSE 0 END + CASE WHEN k2 > 10 THEN 0.10 ELSE 0 END ELSE 0 END, 6) >= 0.6 AS high FROM ex),
    my AS (SELECT *, high AND kind NOT IN ('table', 'image', 'heading') AS may FROM sc), el AS (SELECT *, lag(may) OVER w AS before FROM my WINDOW w AS (PARTITION BY doc_id, page_no, region_id, col_no ORDER BY reading_order)),
    eb AS (SELECT *, max(CASE WHEN may AND NOT (meta AND coalesce(before, false)) THEN place END) OVER w AS begins FROM el WINDOW w AS (PARTITION BY doc_id, page_no, region_id, col_no ORDER BY reading_order)),
    ti AS (SELECT *, may AND (place - begins) % 2 = 0 AS title FROM eb), tk AS (SELECT *, coalesce(lag(title) OVER w, false) AND meta AS taken FROM ti WINDOW w AS (PARTITION BY doc_id, page_no, region_id, col_no ORDER BY reading_order)),
    o AS (SELECT *, max(CASE WHEN title THEN place END) OVER w AS opened, max(CASE WHEN NOT taken AND (kind IN ('table', 'heading') OR kind = 'image' AND high) THEN place END) OVER w AS ended, sum(CASE WHEN title THEN 1 ELSE 0 END) OVER w AS entry FROM tk WINDOW w AS (PARTITION BY doc_id, page_no, region_id, col_no ORDER BY reading_order))"""


@query(
    f"""WITH {Q.N}, {Q.P}, {Q.REGIONS}, {Q.columns(True)}, {_entries("ordered")}
    SELECT doc_id, page_no, node_no, CASE WHEN opened > coalesce(ended, 0) THEN CAST(entry AS INTEGER) END AS entry_no,
      CASE WHEN title THEN 'title' WHEN taken THEN 'metadata' WHEN NOT coalesce(opened > coalesce(ended, 0), false) THEN 'single' WHEN kind = 'list' THEN 'bullet' ELSE 'body' END AS part FROM o"""
)
def entry_groups(spark: SparkSession, d: str) -> DataFrame:
    return layout.group_entries(layout.reading_order(layout.columns(_regioned(spark, d), grouper=True)))


@query()
def word_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.cluster_words(words.words_of(_elements(spark, d)))


@query()
def first_of_near(spark: SparkSession, d: str) -> DataFrame:
    return layout.first_of_near(_elements(spark, d))


@query(
    f"""WITH {Q.E}, {Q.P}, l AS (SELECT e.doc_id, e.page_no, e.y, string_agg(text, ' ' ORDER BY x, element_no) AS text, max(size) AS size, bool_or(coalesce(bold, false)) AS bold, count(*) AS n FROM e WHERE text IS NOT NULL GROUP BY ALL)
    SELECT doc_id, page_no, y, {Q.strip("text")} AS text, greatest(10.0, coalesce(size, 10.0)) AS size, bold, n FROM l"""
)
def block_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = _elements(spark, d).where("text IS NOT NULL").groupBy("doc_id", "page_no", "y").agg(
        F.sort_array(F.collect_list(F.struct("x", "element_no", "text"))).alias("ls"), F.max("size").alias("size"), F.bool_or(F.coalesce("bold", F.lit(False))).alias("bold"), F.count("*").alias("n")
    )
    return rows.select("doc_id", "page_no", "y", X.strip(F.array_join(F.transform("ls", lambda x: x["text"]), " ")).alias("text"), F.greatest(F.lit(10.0), F.coalesce("size", F.lit(10.0))).alias("size"), "bold", "n")


@query(
    f"""WITH {Q.N}, s AS (SELECT doc_id, page_no, node_no, {Q.strip("array_to_string(list_transform(spans, lambda s: coalesce(s.text, '')), '')")} AS text, list_filter(spans, lambda s: s.font_name IS NOT NULL)[-1].font_name AS font, list_filter(spans, lambda s: s.font_size IS NOT NULL)[-1].font_size AS size FROM n WHERE len(spans) > 0)
    SELECT * FROM s"""
)
def line_rollup(spark: SparkSession, d: str) -> DataFrame:
    def last(field: str):
        return F.try_element_at(F.filter("spans", lambda s: s[field].isNotNull()), F.lit(-1))[field]

    text = X.strip(F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    return _nodes(spark, d).where(F.size("spans") > 0).select("doc_id", "page_no", "node_no", text.alias("text"), last("font_name").alias("font"), last("font_size").alias("size"))


@query(f"WITH {Q.N}, i AS (SELECT doc_id, page_no, node_no, unnest(list_transform(items, lambda x, i: struct_pack(no := i, md := {Q.spans('x.spans')}))) AS v FROM n WHERE kind = 'list') SELECT doc_id, page_no, node_no, CAST(v.no AS INTEGER) AS item_no, v.md AS text FROM i")
def list_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = _nodes(spark, d).where("kind = 'list'").select("doc_id", "page_no", "node_no", F.posexplode("items").alias("i", "x"))
    return rows.select("doc_id", "page_no", "node_no", (F.col("i") + 1).alias("item_no"), X.spans_markdown("x.spans").alias("text"))


@query(f"WITH {Q.P}, i AS (SELECT doc_id, page_no, unnest(range(1, image_block_count + 1)) AS figure_no FROM p) SELECT doc_id, page_no, CAST(figure_no AS INTEGER) AS figure_no, 'Figure ' || figure_no AS label FROM i")
def figure_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).where("image_block_count > 0").select("doc_id", "page_no", F.explode(F.sequence(F.lit(1), "image_block_count")).alias("figure_no"))
    return rows.select("doc_id", "page_no", "figure_no", F.concat(F.lit("Figure "), F.col("figure_no").cast("string")).alias("label"))


# ---- joins of rectangles


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """One box a page, over part of its upper left."""
    p = _pages(spark, d)
    return p.select("doc_id", "page_no", F.lit(1).alias("box_no"), G.rect(F.col("width") * 0.05, F.col("height") * 0.15, F.col("width") * 0.45, F.col("height") * 0.30).alias("bbox"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return words.words_of(_elements(spark, d))


def _word_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("doc_id", "page_no", "word_no", "conf", F.struct("x0", "y0", "x1", "y1").alias("bbox"))


@query(
    f"""WITH {Q.N}, t AS (SELECT doc_id, page_no, bbox FROM n WHERE kind = 'table')
    SELECT doc_id, page_no, node_no FROM n WHERE kind <> 'table' AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = n.doc_id AND t.page_no = n.page_no AND n.bbox.x0 <= t.bbox.x1 AND t.bbox.x0 <= n.bbox.x1 AND n.bbox.y0 <= t.bbox.y1 AND t.bbox.y0 <= n.bbox.y1)"""
)
def outside_tables(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return spatial.outside_tables(n.where("kind <> 'table'").select("doc_id", "page_no", "node_no", "bbox"), n.where("kind = 'table'")).select("doc_id", "page_no", "node_no")


_LINKS = r"(www\.[a-z0-9.-]+\.[a-z]+[^\s]*)"


@query(
    f"""WITH {Q.E}, l AS (SELECT doc_id, page_no, element_no AS link_no, regexp_extract(text, {Q.q(_LINKS)}, 1) AS url, x, y, width AS w, height AS h FROM e WHERE regexp_matches(text, {Q.q(_LINKS)})),
    m AS (SELECT e.doc_id, e.page_no, e.element_no, arg_min(l.url, l.link_no) AS url FROM e JOIN l ON e.doc_id = l.doc_id AND e.page_no = l.page_no AND e.x <= l.x + l.w AND l.x <= e.x + e.width AND e.y <= l.y + l.h AND l.y <= e.y + e.height GROUP BY ALL)
    SELECT e.doc_id, e.page_no, e.element_no, m.url FROM e LEFT JOIN m USING (doc_id, page_no, element_no)"""
)
def link_first_match(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).withColumn("bbox", G.box("x", "y", "width", "height"))
    links = e.where(F.col("text").rlike(_LINKS)).select("doc_id", "page_no", F.col("element_no").alias("link_no"), F.regexp_extract("text", _LINKS, 1).alias("url"), "bbox")
    return spatial.first_link(e.select("doc_id", "page_no", "element_no", "bbox"), links, "element_no").select("doc_id", "page_no", "element_no", "url")


_SELECTED = f"WITH {Q.E}, {Q.P}, {Q.WORDS}, {Q.BOXES}, sel AS (SELECT w.*, b.box_no FROM w JOIN boxes b ON w.doc_id = b.doc_id AND w.page_no = b.page_no AND w.x0 < b.x1 AND b.x0 < w.x1 AND w.y0 < b.y1 AND b.y0 < w.y1)"


@query(f"{_SELECTED} SELECT doc_id, page_no, box_no, word_no, text FROM sel")
def selected_words(spark: SparkSession, d: str) -> DataFrame:
    rows = spatial.selected(_words(spark, d).withColumn("bbox", F.struct("x0", "y0", "x1", "y1")).select("doc_id", "page_no", "word_no", "text", "bbox"), _boxes(spark, d))
    return rows.select("doc_id", "page_no", F.col("box_no_b").alias("box_no"), F.col("word_no_w").alias("word_no"), F.col("text_w").alias("text"))


_SMART = f"""{_SELECTED}, alls AS (SELECT doc_id, page_no, box_no, 0 AS rank, 'native' AS source, x0, y0, x1, y1 FROM sel WHERE conf >= 80 UNION ALL SELECT doc_id, page_no, box_no, 1, 'ocr', x0, y0, x1, y1 FROM sel WHERE conf < 80 AND conf >= 40
    UNION ALL SELECT doc_id, page_no, box_no, 2, 'geometry', x0, y0, x1, y1 FROM boxes), smart AS (SELECT * FROM alls QUALIFY rank = min(rank) OVER (PARTITION BY doc_id, page_no, box_no))"""


def _smart(spark: SparkSession, d: str) -> DataFrame:
    w = _word_boxes(spark, d)
    return spatial.smart_selection(_boxes(spark, d), w.where("conf >= 80"), w.where("conf < 80 AND conf >= 40"))


@query(f"{_SMART} SELECT doc_id, page_no, box_no, source, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM smart")
def smart_selection(spark: SparkSession, d: str) -> DataFrame:
    return _smart(spark, d).select("doc_id", "page_no", "box_no", "source", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_IOU = """least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h"""


@query(
    f"""WITH {Q.E}, a AS (SELECT doc_id, page_no, element_no, x AS x0, y AS y0, x + width AS x1, y + height AS y1 FROM e), b AS (SELECT doc_id, page_no, element_no, x0 + 3 AS x0, y0 + 2 AS y0, x1 + 3 AS x1, y1 + 2 AS y1 FROM a),
    m AS (SELECT a.doc_id, a.page_no, a.element_no AS a, b.element_no AS b, {_IOU}, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM a JOIN b USING (doc_id, page_no) WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
    SELECT doc_id, page_no, a, b, round(w * h / (sa + sb - w * h), 6) AS iou FROM m"""
)
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d).select("doc_id", "page_no", "element_no", G.box("x", "y", "width", "height").alias("bbox"))
    b = F.col("bbox")
    moved = e.select("doc_id", "page_no", "element_no", G.rect(b["x0"] + 3, b["y0"] + 2, b["x1"] + 3, b["y1"] + 2).alias("bbox"))
    return spatial.overlap_pairs(e, moved, "element_no")


@query()
def reconciled_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).withColumn("text", layout.node_text())
    return spatial.reconciled(n.where("source <> 'tesseract_ocr'"), n.where("source = 'tesseract_ocr'"))


@query()
def line_matches(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    return spatial.line_matches(e.where("original_text IS NOT NULL AND text <> original_text"), e.withColumn("line_no", F.col("element_no")))


@query(f"WITH {Q.P}, st AS (SELECT doc_id, page_no + 1 AS page_no, page_no AS stamp_no, width * 0.5 AS x, height * 0.8 AS y, 120.0 AS w, 40.0 AS h FROM p) SELECT st.doc_id, st.page_no, stamp_no, x, y, x + w AS x1, y + h AS y1 FROM st SEMI JOIN p USING (doc_id, page_no)")
def sign_plan(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    stamps = p.select("doc_id", (F.col("page_no") + 1).alias("page_no"), F.col("page_no").alias("stamp_no"), (F.col("width") * 0.5).alias("x"), (F.col("height") * 0.8).alias("y"), F.lit(120.0).alias("w"), F.lit(40.0).alias("h"))
    return plans.sign_plan(stamps, p)


_KEYWORDS = "museum|||  |||Muster|||faktur"


def _keyword_rows(spark: SparkSession, d: str) -> DataFrame:
    return plans.keyword_boxes(_elements(spark, d), _literal(spark, [(_KEYWORDS,)], "keywords string"))


_KEYWORD_SQL = f"""k AS (SELECT trim(unnest(string_split({Q.q(_KEYWORDS)}, '|||'))) AS keyword),
  km AS (SELECT doc_id, page_no, element_no, keyword, round(x, 6) AS x0, round(y, 6) AS y0, round(x + width, 6) AS x1, round(y + height, 6) AS y1 FROM e JOIN k ON keyword <> '' AND contains(lower(text), lower(keyword)))"""


@query(f"WITH {Q.E}, {_KEYWORD_SQL} SELECT * FROM km")
def keyword_matches(spark: SparkSession, d: str) -> DataFrame:
    return _keyword_rows(spark, d)


@query(
    f"""WITH {Q.E}, {Q.P}, {_KEYWORD_SQL}, al AS (SELECT doc_id, page_no, 0 AS rank, 'keyword' AS reason, element_no AS no, keyword AS sub, x0, y0, x1, y1 FROM km
      UNION ALL SELECT doc_id, page_no, 1, 'box', 1, '', round(0.1 * width, 6), round(0.2 * height, 6), round((0.1 + 0.3) * width, 6), round((0.2 + 0.05) * height, 6) FROM p)
    SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY rank, no, sub) AS INTEGER) AS seq, reason, x0, y0, x1, y1 FROM al"""
)
def redact_plan(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    boxes = p.select("doc_id", "page_no", F.lit(1).alias("box_no"), *[F.lit(v).alias(k) for k, v in (("x", 0.1), ("y", 0.2), ("w", 0.3), ("h", 0.05))])
    return plans.redact_plan(_keyword_rows(spark, d), boxes, p)


_MARKED = f"{_SMART}, mk AS (SELECT smart.*, p.width, p.height FROM smart JOIN p USING (doc_id, page_no) WHERE smart.x1 > smart.x0 AND smart.y1 > smart.y0)"


@query(
    f"""{_MARKED} SELECT doc_id, page_no, box_no, 'highlight' AS op, round(greatest(0.0, x0 - greatest(0.8, 0.02 * (x1 - x0))), 6) AS x0, round(greatest(0.0, y0 - greatest(0.8, 0.15 * (y1 - y0))), 6) AS y0,
    round(least(width, x1 + greatest(0.8, 0.02 * (x1 - x0))), 6) AS x1, round(least(height, y1 + greatest(0.8, 0.15 * (y1 - y0))), 6) AS y1 FROM mk"""
)
def highlight_plan(spark: SparkSession, d: str) -> DataFrame:
    return plans.markup_plan(_smart(spark, d), _pages(spark, d), "highlight")


_THICK = "round(least(2.5, greatest(0.8, 0.12 * (y1 - y0))), 6) AS thickness"


@query(f"{_MARKED} SELECT doc_id, page_no, box_no, 'strikeout' AS op, round(x0, 6) AS x0, round(y0 + 0.52 * (y1 - y0), 6) AS y, round(x1, 6) AS x1, {_THICK} FROM mk")
def strikeout_plan(spark: SparkSession, d: str) -> DataFrame:
    return plans.markup_plan(_smart(spark, d), _pages(spark, d), "strikeout")


@query(f"{_MARKED} SELECT doc_id, page_no, box_no, 'underline' AS op, round(x0, 6) AS x0, round(CASE WHEN source = 'geometry' THEN y1 - greatest(1.0, 0.08 * (y1 - y0)) ELSE least(y1 + 1.3, height - 1) END, 6) AS y, round(x1, 6) AS x1, {_THICK} FROM mk")
def underline_plan(spark: SparkSession, d: str) -> DataFrame:
    return plans.markup_plan(_smart(spark, d), _pages(spark, d), "underline")


# ---- words and languages


@query(f"WITH {Q.E}, {Q.WORDS} SELECT doc_id, page_no, word_no, text, conf >= 30 AND NOT regexp_matches(text, '^[^\\p{{L}}\\p{{N}}]$') AND NOT regexp_matches(text, '^[-_|\\\\/.,;:''\"]+$') AS valid, CAST(trunc(conf) AS INTEGER) > 25 AS engine FROM w")
def word_filters(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    return w.select("doc_id", "page_no", "word_no", "text", words.valid_word(F.col("text"), F.col("conf")).alias("valid"), words.engine_word(F.col("text"), F.col("conf")).alias("engine"))


@query(
    f"""WITH {Q.E}, {Q.WORDS} SELECT doc_id, page_no, line_no, string_agg(text, ' ' ORDER BY word_no) AS text, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, round(avg(conf) / 100, 6) AS confidence
    FROM w WHERE trunc(conf) > 25 GROUP BY ALL"""
)
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    return words.ocr_lines(_words(spark, d))


@query(f"WITH {Q.E}, {Q.WORDS} SELECT doc_id, page_no, round(coalesce(avg(conf) FILTER (WHERE conf >= 0), -1.0), 6) AS mean_conf FROM w GROUP BY ALL")
def ocr_mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    return words.mean_confidence(_words(spark, d))


@query(f"WITH {Q.E}, {Q.WORDS}, m AS (SELECT doc_id, page_no, round(median(greatest(1.0, y1 - y0)), 6) AS median_height FROM w GROUP BY ALL) SELECT *, round(greatest(3.0, 0.45 * median_height), 6) AS tolerance FROM m")
def word_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return words.word_tolerance(_words(spark, d))


@query(
    f"""WITH {Q.E}, c AS (SELECT doc_id, page_no, element_no, text, unnest(range(1, length(text) + 1)) AS i FROM e), h AS (SELECT *, NOT regexp_matches(substr(text, i, 1), '[{X.SPACE}]') AS solid, i = 1 OR regexp_matches(substr(text, i - 1, 1), '[{X.SPACE}]') AS opens FROM c),
    g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, element_no ORDER BY i) AS k FROM h WHERE solid)
    SELECT doc_id, page_no, element_no, CAST(min(i) - 1 AS INTEGER) AS start, CAST(max(i) AS INTEGER) AS "end", string_agg(substr(text, i, 1), '' ORDER BY i) AS word FROM g GROUP BY doc_id, page_no, element_no, k"""
)
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    return X.token_offsets(_elements(spark, d).where("text <> ''"), ["doc_id", "page_no", "element_no"])


@query(
    f"""WITH {Q.E}, t AS (SELECT doc_id, page_no, element_no, coalesce(text, '') AS t FROM e) SELECT doc_id, page_no, element_no, CASE WHEN t = '' THEN -50.0 ELSE round(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) + 0.2 * length(regexp_replace(t, '[^\\p{{Nd}}\\x{{B2}}\\x{{B3}}\\x{{B9}}\\x{{2070}}\\x{{2074}}-\\x{{2079}}\\x{{2460}}-\\x{{2468}}]', '', 'g'))
      + 0.05 * length(regexp_replace(t, '[^{X.SPACE}]', '', 'g')) + 0.8 * least(len({Q.words("t")}), 40) - 1.5 * length(regexp_replace(t, '[\\p{{L}}\\p{{N}}{X.SPACE}]', '', 'g')), 6) END AS quality FROM t"""
)
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("doc_id", "page_no", "element_no", X.text_quality(F.coalesce("text", F.lit(""))).alias("quality"))


_SPEC = f"""WITH j AS (SELECT job_id, arg_max(coalesce(lang, ''), received_at) AS lang FROM ocr_jobs GROUP BY job_id), l AS (SELECT job_id, lower({Q.strip("lang")}) AS low FROM j),
  sp AS (SELECT job_id, low, list_filter(string_split(regexp_replace(low, '%2b|%20|[\\s,+]+', ' ', 'g'), ' '), lambda x: x <> '') AS parts FROM l),
  dp AS (SELECT job_id, low, list_filter(parts, lambda x, i: list_position(parts, x) = i) AS parts FROM sp),
  spec AS (SELECT job_id, CASE WHEN low = '' THEN 'eng' WHEN low IN ('auto', 'automatic', 'detect') THEN 'auto' ELSE coalesce(nullif(array_to_string(parts, '+'), ''), 'eng') END AS spec FROM dp)"""


def _specs(spark: SparkSession, d: str) -> DataFrame:
    j = _t(spark, d, "ocr_jobs").groupBy("job_id").agg(F.max_by(F.coalesce("lang", F.lit("")), "received_at").alias("lang"))
    return j.select("job_id", X.language_spec("lang").alias("spec"))


@query(f"{_SPEC} SELECT * FROM spec")
def language_specs(spark: SparkSession, d: str) -> DataFrame:
    return _specs(spark, d)


@query(f"{_SPEC}, w AS (SELECT job_id, unnest(string_split(spec, '+')) AS code FROM spec) SELECT DISTINCT job_id, code FROM w WHERE code NOT IN (SELECT code FROM lang_codes)")
def missing_languages(spark: SparkSession, d: str) -> DataFrame:
    wanted = _specs(spark, d).select("job_id", F.explode(F.split("spec", r"\+")).alias("code")).distinct()
    return wanted.join(F.broadcast(_t(spark, d, "lang_codes").select("code")), "code", "left_anti").select("job_id", "code")  # eight fixed rows


@query(f"{_SPEC}, w AS (SELECT job_id, string_split(spec, '+')[1] AS code FROM spec) SELECT job_id, w.code, coalesce(l.name, 'English') AS name FROM w LEFT JOIN lang_codes l ON w.code = l.code")
def language_names(spark: SparkSession, d: str) -> DataFrame:
    first = _specs(spark, d).select("job_id", F.split("spec", r"\+")[0].alias("code"))
    return first.join(F.broadcast(_t(spark, d, "lang_codes")), "code", "left").select("job_id", "code", F.coalesce("name", F.lit("English")).alias("name"))  # eight fixed rows


_BUNDLES = ", ".join(Q.q(b) for b in words.BUNDLES)


@query(f"WITH b AS (SELECT unnest([{_BUNDLES}]) AS bundle), i AS (SELECT list(code) AS codes FROM lang_codes) SELECT bundle, array_to_string(list_filter(string_split(bundle, '+'), lambda c: list_contains(i.codes, c)), '+') AS usable, list_has_all(i.codes, string_split(bundle, '+')) AS whole FROM b, i")
def language_bundles(spark: SparkSession, d: str) -> DataFrame:
    codes = sorted(r.code for r in _t(spark, d, "lang_codes").select("code").distinct().collect())  # eight fixed rows
    rows = _literal(spark, [(b,) for b in words.BUNDLES], "bundle string").withColumn("codes", F.array(*[F.lit(c) for c in codes]).cast("array<string>"))
    parts = F.split("bundle", r"\+")
    return rows.select("bundle", F.array_join(F.array_intersect(parts, "codes"), "+").alias("usable"), (F.size(F.array_except(parts, "codes")) == 0).alias("whole"))


@query()
def scripts_and_languages(spark: SparkSession, d: str) -> DataFrame:
    texts = _nodes(spark, d).select(F.concat_ws("/", "doc_id", "page_no", "node_no").alias("id"), layout.node_text().alias("t"))
    return words.languages_of_scripts(U.scripts_by_frequency(texts, "id", "t"), _t(spark, d, "lang_codes"))


_TRIES = "SELECT doc_id, page_no, i AS try_no, ['eng', 'eng+deu', 'deu'][i + 1] AS spec, CAST((word_count * 37 + i * 29) % 101 AS DOUBLE) AS conf, CAST((word_count * 13 + i * 7) % 50 AS DOUBLE) AS quality, word_count * (i + 1) AS n_chars FROM p, range(0, 3) r(i) WHERE word_count IS NOT NULL"


@query(
    f"""WITH {Q.P}, t AS ({_TRIES}), s AS (SELECT *, min(CASE WHEN conf >= 88 AND n_chars >= 40 THEN try_no END) OVER (PARTITION BY doc_id, page_no) AS stop FROM t)
    SELECT doc_id, page_no, spec FROM s WHERE stop IS NULL OR try_no <= stop QUALIFY row_number() OVER (PARTITION BY doc_id, page_no ORDER BY conf DESC, quality DESC, len(string_split(spec, '+')), try_no) = 1"""
)
def best_language(spark: SparkSession, d: str) -> DataFrame:
    """Three tries a page; confidence and quality, which no table has, follow from the page's words."""
    n, i = F.col("word_count"), F.col("try_no")
    rows = _pages(spark, d).where("word_count IS NOT NULL").select("doc_id", "page_no", "word_count", F.posexplode(F.array(F.lit("eng"), F.lit("eng+deu"), F.lit("deu"))).alias("try_no", "spec"))
    return words.best_language(rows.select("doc_id", "page_no", "try_no", "spec", ((n * 37 + i * 29) % 101).cast("double").alias("conf"), ((n * 13 + i * 7) % 50).cast("double").alias("quality"), (n * (i + 1)).alias("n_chars")))


# ---- edits


_STYLE = " OR ".join(f"style.{k} IS NOT NULL" for k in editing.STYLE_KEYS)
_DIRTY = f"(coalesce(text, '') <> coalesce(original_text, '') OR coalesce({_STYLE}, false) OR coalesce(bold, false) OR coalesce(italic, false) OR coalesce(underline, false) OR coalesce(strikethrough, false) OR coalesce(lower(bg_color), '') NOT IN ('', 'transparent', 'none', '#ffffff'))"


@query(f"WITH {Q.E} SELECT doc_id, page_no, element_no, {_DIRTY} AS dirty FROM e")
def dirty_elements(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("doc_id", "page_no", "element_no", editing.dirty().alias("dirty"))


@query(
    f"""WITH {Q.E} SELECT doc_id, page_no, element_no, coalesce(nullif(style.fontFamily, 'original'), font) AS font_family, coalesce(style.fontSize, size) AS font_size, coalesce(nullif(style.color, 'original'), text_color) AS color,
    coalesce(style.bold, bold, false) AS is_bold, coalesce(style.italic, italic, false) AS is_italic, coalesce(style.underline, underline, false) AS is_underline, coalesce(style.strikethrough, strikethrough, false) AS is_strikethrough,
    coalesce(CASE WHEN style.background LIKE '{{%' THEN CASE WHEN style.background ->> '$.enabled' = 'true' THEN style.background ->> '$.color' END ELSE style.background END, bg_color) AS ground FROM e"""
)
def effective_style(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("doc_id", "page_no", "element_no", *editing.effective_style())


_FONT = """CASE WHEN contains(f, 'times') OR contains(f, 'serif') OR contains(f, 'tiro') THEN CASE WHEN b AND i THEN 'tibi' WHEN b THEN 'tibo' WHEN i THEN 'tiit' ELSE 'tiro' END
  WHEN contains(f, 'courier') OR contains(f, 'mono') OR contains(f, 'cour') THEN CASE WHEN b AND i THEN 'cobi' WHEN b THEN 'cobo' WHEN i THEN 'coit' ELSE 'cour' END ELSE CASE WHEN b AND i THEN 'hebi' WHEN b THEN 'hebo' WHEN i THEN 'heit' ELSE 'helv' END END"""


@query(f"WITH {Q.E}, t AS (SELECT doc_id, page_no, element_no, lower(coalesce(font, '')) AS f, coalesce(bold, false) AS b, coalesce(italic, false) AS i FROM e) SELECT doc_id, page_no, element_no, {_FONT} AS font_code FROM t")
def font_variants(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("doc_id", "page_no", "element_no", X.font_variant("font", "bold", "italic").alias("font_code"))


@query(
    f"""WITH {Q.E}, h AS (SELECT doc_id, page_no, element_no, text_color, regexp_replace(trim(text_color), '^#', '') AS h FROM e), v AS (SELECT *, coalesce(regexp_matches(h, '^[0-9A-Fa-f]{{6}}$'), false) AS ok FROM h)
    SELECT doc_id, page_no, element_no, {", ".join(f"CASE WHEN ok THEN round(CAST(CAST(('0x' || substr(h, {1 + 2 * i}, 2)) AS INTEGER) AS DOUBLE) / 255, 6) ELSE 1.0 END AS {c}" for i, c in enumerate("rgb"))},
    '#' || lower(lpad(to_hex((page_no * 65793 + element_no) & 16777215), 6, '0')) AS as_hex FROM v"""
)
def colors(spark: SparkSession, d: str) -> DataFrame:
    rows = _elements(spark, d).select("doc_id", "page_no", "element_no", G.hex_channels(F.col("text_color")).alias("c"), G.color_hex(F.col("page_no").cast("long") * 65793 + F.col("element_no")).alias("as_hex"))
    return rows.select("doc_id", "page_no", "element_no", "c.r", "c.g", "c.b", "as_hex")


@query()
def text_diffs(spark: SparkSession, d: str) -> DataFrame:
    return editing.diff_ops(_elements(spark, d), ["doc_id", "page_no", "element_no"])


@query()
def edit_targets(spark: SparkSession, d: str) -> DataFrame:
    return editing.edit_targets(_elements(spark, d))


@query()
def compile_plan(spark: SparkSession, d: str) -> DataFrame:
    e = _elements(spark, d)
    return plans.compile_plan(editing.edit_targets(e), e)


@query(
    f"""WITH {Q.E}, {Q.P}, t AS (SELECT e.doc_id, e.page_no, element_no, e.x, e.width AS w, e.size, p.width AS pw, e.width * 1.2 AS tw, lead(e.x) OVER (PARTITION BY e.doc_id, e.page_no, e.y ORDER BY e.x, element_no) AS nx FROM e JOIN p USING (doc_id, page_no)),
    r AS (SELECT *, CASE WHEN nx IS NOT NULL THEN greatest(0.0, nx - x - 2) WHEN w IS NOT NULL THEN greatest(w, pw - x - 20) ELSE 100.0 END AS room FROM t)
    SELECT doc_id, page_no, element_no, round(room, 6) AS room, CASE WHEN nx IS NOT NULL AND tw > room AND room / tw >= 0.70 THEN round(size * (room / tw), 6) ELSE size END AS fitted FROM r"""
)
def available_widths(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = _elements(spark, d).join(_pages(spark, d).select("doc_id", "page_no", F.col("width").alias("pw")), ["doc_id", "page_no"])
    nx = F.lead("x").over(Window.partitionBy("doc_id", "page_no", "y").orderBy("x", "element_no"))
    rows = e.withColumn("nx", nx).withColumn("room", editing.available_width(F.col("nx"), F.col("x"), F.col("width"), F.col("pw")))
    return rows.select("doc_id", "page_no", "element_no", F.round("room", 6).alias("room"), editing.fitted_size(F.col("size"), F.col("width") * 1.2, F.col("room"), F.col("nx")).alias("fitted"))


# ---- tables


@query(
    f"""WITH {Q.N}, r AS (SELECT doc_id, page_no, node_no AS table_no, list_concat([coalesce(headers, [])], coalesce(rows, [])) AS rs FROM n WHERE kind = 'table'), x AS (SELECT doc_id, page_no, table_no, unnest(range(0, len(rs))) AS row_no, rs FROM r),
    c AS (SELECT doc_id, page_no, table_no, row_no, rs[row_no + 1] AS cells FROM x), y AS (SELECT *, unnest(range(0, len(cells))) AS col_no FROM c) SELECT doc_id, page_no, table_no, CAST(row_no AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no, cells[col_no + 1] AS text FROM y"""
)
def table_cells(spark: SparkSession, d: str) -> DataFrame:
    return tables.cells_of(_nodes(spark, d))


_SECTIONS = " OR ".join(f"contains(c, {Q.q(w)})" for w in X.TABLE_SECTIONS)


@query(
    f"""WITH {Q.N}, {Q.P}, r AS (SELECT n.doc_id, n.page_no, node_no AS table_no, bbox, p.width AS pw, p.height AS ph, list_concat([coalesce(headers, [])], coalesce(rows, [])) AS rs FROM n JOIN p USING (doc_id, page_no) WHERE n.kind = 'table'),
    t AS (SELECT *, flatten(rs) AS cs, list_max(list_transform(rs, lambda x: len(x))) AS w FROM r)
    SELECT doc_id, page_no, table_no, CAST(len(rs) AS INTEGER) AS n_rows, CAST(w AS INTEGER) AS n_cols, greatest(0.0, bbox.x0) AS x0, greatest(0.0, bbox.y0) AS y0, least(pw, bbox.x1) AS x1, least(ph, bbox.y1) AS y1 FROM t
    WHERE NOT (bbox.x0 < -5 OR bbox.y0 < -5 OR bbox.x1 > pw + 10 OR bbox.y1 > ph + 10) AND NOT (bbox.x1 - bbox.x0 > 0.65 * pw AND bbox.y1 - bbox.y0 > 0.65 * ph) AND len(rs) >= 2 AND w >= 2
      AND len(list_filter(cs, lambda c: coalesce({_SECTIONS} OR length(c) > 150 OR length(c) - length(replace(c, chr(10), '')) >= 3, false))) = 0"""
)
def valid_tables(spark: SparkSession, d: str) -> DataFrame:
    return tables.valid_tables(_nodes(spark, d), _pages(spark, d))


@query(
    f"""WITH {Q.E}, t AS (SELECT doc_id, page_no, element_no, {Q.strip("text")} AS t FROM e), s AS (SELECT *, CASE WHEN contains(t, ',') THEN string_split(t, ',') ELSE [t] END AS cs FROM t WHERE t <> ''), u AS (SELECT *, unnest(range(0, len(cs))) AS i FROM s)
    SELECT doc_id, page_no, element_no, CAST(i AS INTEGER) AS col_no, {Q.strip("cs[i + 1]")} AS cell FROM u"""
)
def comma_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.comma_rows(_elements(spark, d), ["doc_id", "page_no", "element_no"])


@query(
    f"""WITH {Q.N}, {Q.E}, c AS (SELECT doc_id, page_no, 1 AS stage, node_no AS no FROM n WHERE kind = 'table' AND len(headers) > 1 UNION ALL SELECT doc_id, page_no, 2, node_no FROM n WHERE kind = 'list' UNION ALL SELECT doc_id, page_no, 3, node_no FROM n WHERE kind IN ('paragraph', 'heading'))
    SELECT doc_id, page_no, stage, no FROM c QUALIFY stage = min(stage) OVER (PARTITION BY doc_id, page_no)"""
)
def table_cascade(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    stages = [(1, "kind = 'table' AND size(headers) > 1"), (2, "kind = 'list'"), (3, "kind IN ('paragraph', 'heading')")]
    stage = F.lit(None).cast("int")
    for no, test in reversed(stages):
        stage = F.when(F.expr(test), no).otherwise(stage)
    return tables.cascade(n.select("doc_id", "page_no", stage.alias("stage"), F.col("node_no").alias("no")).where("stage IS NOT NULL"))


_LINES = "SELECT doc_id, page_no, x AS x1, y AS y1, CASE WHEN element_no % 2 = 0 THEN x + width ELSE x + 0.5 END AS x2, CASE WHEN element_no % 2 = 0 THEN y + 0.5 ELSE y + 20.0 END AS y2 FROM e"


@query(
    f"""WITH {Q.E}, l AS ({_LINES}), c AS (SELECT doc_id, page_no, count(*) FILTER (WHERE abs(y2 - y1) < 2 AND abs(x2 - x1) > 15) AS horizontal, count(*) FILTER (WHERE abs(x2 - x1) < 2 AND abs(y2 - y1) > 15) AS vertical FROM l GROUP BY ALL)
    SELECT * FROM c WHERE horizontal >= 2 AND vertical >= 2"""
)
def table_candidate_pages(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("element_no") % 2 == 0
    p1 = F.struct("x", "y")
    p2 = F.struct(F.when(even, F.col("x") + F.col("width")).otherwise(F.col("x") + 0.5).alias("x"), F.when(even, F.col("y") + 0.5).otherwise(F.col("y") + 20.0).alias("y"))
    return tables.candidate_pages(_elements(spark, d).select("doc_id", "page_no", p1.alias("p1"), p2.alias("p2")))


@query(
    f"""WITH {Q.P} SELECT doc_id, page_no, CASE WHEN word_count % 90 < 35 THEN 'enhance' WHEN word_count < 100 THEN 'autocontrast' ELSE 'none' END AS preparation, round(least(120 / 72.0, 1600 / greatest(width, height)), 6) AS scale FROM p"""
)
def page_previews(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _pages(spark, d).select("doc_id", "page_no", records.contrast(c("word_count"), c("word_count") % 90).alias("preparation"), F.round(records.preview_scale(c("width"), c("height")), 6).alias("scale"))


# ---- sources, sinks, service


@query(f"WITH {Q.E}, {Q.P} SELECT e.doc_id, e.page_no, p.kind, p.is_ocr, CAST(row_number() OVER (PARTITION BY e.doc_id, e.page_no ORDER BY element_no) - 1 AS INTEGER) AS element_no, text, original_text, x, y, size, style.color AS style_color, selection_start FROM e JOIN p USING (doc_id, page_no)")
def layout_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    layouts = writers.layout_json(_pages(spark, d), _elements(spark, d))
    return readers.layout_elements(layouts).select("doc_id", "page_no", "kind", "is_ocr", "element_no", "text", "original_text", "x", "y", "size", F.col("style.color").alias("style_color"), "selection_start")


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(0, len(ls))) AS ln, ls FROM d), t AS (SELECT doc_id, ln, ls[ln + 1] AS text FROM u)
    SELECT doc_id, CAST(ln // 5 + 1 AS INTEGER) AS page_no, CAST(ln % 5 AS INTEGER) AS line_no, text, CASE WHEN ln = 0 THEN 24.0 WHEN length(text) < 40 THEN 14.0 ELSE 11.0 END AS size, ln = 0 AS bold, CASE WHEN length(text) <= 45 AND ln % 2 = 1 THEN 330.0 ELSE 50.0 END AS x0, 50.0 + 170.0 * (ln % 5) AS y0
    FROM t WHERE """
    + Q.strip("text")
    + " <> ''"
)
def text_layout(spark: SparkSession, d: str) -> DataFrame:
    return readers.text_lines(_t(spark, d, "documents")).select("doc_id", "page_no", "line_no", "text", "size", "bold", F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"))


@query(f"WITH {Q.E}, {Q.WORDS} SELECT doc_id, page_no AS page_num, line_no AS line_num, CAST(word_no % 1000 AS INTEGER) AS word_num, conf, text FROM w")
def tsv_words(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    fields = [F.lit(5), F.col("page_no"), F.lit(1), F.lit(1), F.col("line_no"), F.col("word_no") % 1000, *[F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")], F.col("conf"), F.col("text")]
    lines = w.select("doc_id", F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("line"))
    return readers.tsv_words(lines).select("doc_id", "page_num", "line_num", "word_num", "conf", "text")


@query(f"WITH {Q.S} SELECT file_id, task_id, path, CAST(octet_length(encode(coalesce(content, ''))) AS INTEGER) AS n_bytes FROM f")
def source_scan(spark: SparkSession, d: str) -> DataFrame:
    return source_facts.latest(_t(spark, d, "sources")).select("file_id", "task_id", "path", F.octet_length(F.coalesce("content", F.lit(""))).alias("n_bytes"))


@query(f"WITH {Q.S}, r AS (SELECT task_id, count(*) AS n_files, CAST(sum(octet_length(encode(coalesce(content, '')))) AS BIGINT) AS n_bytes FROM f GROUP BY task_id) SELECT *, CASE WHEN n_files > 20 OR n_bytes > 10485760 THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM r")
def request_limits(spark: SparkSession, d: str) -> DataFrame:
    return source_facts.request_limits(_t(spark, d, "sources"))


@query("SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) + 28 AS stored FROM documents WHERE text IS NOT NULL")
def object_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key = F.lit("0123456789abcdef0123456789abcdef").cast("binary")
    rows = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", writers.encrypted(F.encode("text", "UTF-8"), key).alias("c"))
    return rows.select("doc_id", F.sha2(writers.decrypted(F.col("c"), key), 256).alias("digest"), F.octet_length("c").cast("long").alias("stored"))


@query("WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL) SELECT digest, min(doc_id) AS first_doc, count(*) AS n FROM h GROUP BY digest HAVING count(*) > 1")
def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1")


@query("SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS uri FROM documents WHERE text IS NOT NULL")
def data_uris(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", writers.data_uri(F.lit("png"), F.encode("text", "UTF-8")).alias("uri"))


_ACTIONS = ("redact", "edit", "markdown", "ocr", "sign", "highlight")
_STEM = "regexp_replace(regexp_extract(name, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1')"


@query(
    f"""WITH t AS (SELECT DISTINCT file_id, path AS name, [{", ".join(map(Q.q, _ACTIONS))}][file_id % 6 + 1] AS action FROM sources WHERE path IS NOT NULL)
    SELECT file_id, name, CASE WHEN lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp', 'txt', 'json') THEN '.' || lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) ELSE '.bin' END AS suffix,
    CASE action WHEN 'edit' THEN 'edited_' || {_STEM} || '.pdf' WHEN 'markdown' THEN {_STEM} || '.md' WHEN 'ocr' THEN {_STEM} || '_ocr.txt' ELSE action || '_' || {_STEM} || '.pdf' END AS download FROM t"""
)
def file_names(spark: SparkSession, d: str) -> DataFrame:
    action = F.element_at(F.array(*[F.lit(a) for a in _ACTIONS]), (F.col("file_id") % 6 + 1).cast("int"))
    rows = _t(spark, d, "sources").where("path IS NOT NULL").select("file_id", F.col("path").alias("name"), action.alias("action")).distinct()
    return rows.select("file_id", "name", X.safe_suffix("name").alias("suffix"), X.download_name("action", "name").alias("download"))


@query(
    """WITH t AS (SELECT event_id, CAST(event_id * 977 % 200000 AS BIGINT) AS s FROM events), u AS (SELECT event_id, s, s // 86400 AS d, s % 86400 // 3600 AS h, s % 3600 // 60 AS m FROM t)
    SELECT event_id, CASE WHEN d = 0 AND h = 0 AND m = 0 THEN (s % 60) || 's' ELSE concat_ws(' ', CASE WHEN d > 0 THEN d || 'd' END, CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 THEN m || 'm' END) END AS label FROM u"""
)
def uptime_labels(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", X.uptime_label(F.pmod(F.col("event_id") * 977, F.lit(200000))).alias("label"))


_PATHS = ("/", "/health/", "/health/", "/docs", "/api/v1/", "/home/", "/redocs")
_PATH = f"SELECT event_id, [{', '.join(map(Q.q, _PATHS))}][event_id % 7 + 1] || CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS path FROM events"


@query(f"WITH t AS ({_PATH}) SELECT event_id, path, CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END IN ({', '.join(Q.q(p) for p in service.PUBLIC)}) OR starts_with(regexp_replace(path, '/+$', ''), '/health') AS public FROM t")
def public_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a request to one of a few paths, or to one below it."""
    start = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("event_id") % 7 + 1).cast("int"))
    rows = _t(spark, d, "events").select("event_id", F.concat(start, F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("")).alias("path"))
    return rows.select("event_id", "path", service.public_path(F.col("path")).alias("public"))


@query(f"SELECT doc_id, starts_with(text, '{{') OR starts_with(text, '[') OR starts_with(text, '%PDF-') OR starts_with(text, 'RIFF') OR starts_with(text, 'GIF8') AS plain FROM documents WHERE text IS NOT NULL")
def plaintext_magic(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", service.plaintext(F.encode("text", "UTF-8")).alias("plain"))


@query(
    """SELECT job_id, received_at, total_bytes, total_bytes * 3 >= 5 * CAST(n_files AS BIGINT) * 100000 + 52428800 AS enough, CASE status WHEN 'queued' THEN 'QUEUED' WHEN 'running' THEN 'PROCESSING' WHEN 'succeeded' THEN 'COMPLETED' WHEN 'failed' THEN 'FAILED' WHEN 'cancelled' THEN 'CANCELLED' WHEN 'cancel_requested' THEN 'CANCELLED' END AS label FROM ocr_jobs"""
)
def job_labels(spark: SparkSession, d: str) -> DataFrame:
    j = _t(spark, d, "ocr_jobs")
    return j.select("job_id", "received_at", "total_bytes", service.enough_disk(F.col("total_bytes") * 3, F.col("n_files").cast("long") * 100000).alias("enough"), service.status_label(F.col("status")).alias("label"))


_PREFIXES = ("test", "config", "app")


@query(
    f"""WITH t AS (SELECT DISTINCT file_id, path, received_at, regexp_extract(path, '([^/\\\\]*)$', 1) AS name, CAST(epoch(TIMESTAMP '2031-07-01') - floor(epoch(received_at)) AS BIGINT) AS age, file_id % 10 = 0 AS is_link, repo IS NULL AS shared FROM sources WHERE path IS NOT NULL)
    SELECT file_id, path, received_at, (NOT shared OR {" OR ".join(f"starts_with(name, '{p}')" for p in _PREFIXES)}) AND (is_link OR age > 3600) AS gone FROM t"""
)
def expired_files(spark: SparkSession, d: str) -> DataFrame:
    """Source files as temporary ones: their age by their arrival, those without a repository in a shared folder."""
    age = F.unix_timestamp(F.lit("2031-07-01 00:00:00")) - F.unix_timestamp(F.col("received_at").cast("timestamp"))
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    gone = service.expired(name, age, F.col("file_id") % 10 == 0, F.col("repo").isNull(), _PREFIXES)
    return _t(spark, d, "sources").where("path IS NOT NULL").select("file_id", "path", "received_at", gone.alias("gone")).distinct()


_ERRORS = ("FileDataError", "EmptyFileError", "TimeoutError", "ValueError")


@query(f"WITH t AS (SELECT event_id, [{', '.join(map(Q.q, _ERRORS))}][event_id % 4 + 1] AS error FROM events) SELECT event_id, error NOT IN ('FileDataError', 'EmptyFileError') AS retry FROM t")
def retryable_errors(spark: SparkSession, d: str) -> DataFrame:
    error = F.element_at(F.array(*[F.lit(e) for e in _ERRORS]), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", service.retryable(error).alias("retry"))


_PAD = {k: "".join(f"{ord(c) ^ x:02x}" for c in "secret".ljust(64, "\0")) for k, x in (("inner", 0x36), ("outer", 0x5C))}
_REQUESTS = f"""r AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'post' ELSE 'GET' END AS method, '/api/v1/' || event_type AS path, CASE WHEN event_id % 2 = 0 THEN 'page=' || event_id % 9 ELSE '' END AS query, CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) AS stamp, CAST(event_id AS VARCHAR) AS nonce, CASE WHEN event_id % 3 = 0 THEN sha256(coalesce(props, '')) END AS body FROM events),
  m AS (SELECT *, upper(method) || chr(10) || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END || chr(10) || stamp || chr(10) || nonce || CASE WHEN body IS NULL THEN '' ELSE chr(10) || body END AS message FROM r),
  signed AS (SELECT *, sha256(from_hex('{_PAD["outer"]}') || from_hex(sha256(from_hex('{_PAD["inner"]}') || encode(message)))) AS signature FROM m)"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a request: method, path and query, time, nonce, and the hash of a body where there is one."""
    n = F.col("event_id")
    rows = _t(spark, d, "events").select(
        "event_id", F.when(n % 3 == 0, "post").otherwise("GET").alias("method"), F.concat(F.lit("/api/v1/"), "event_type").alias("path"), F.when(n % 2 == 0, F.concat(F.lit("page="), (n % 9).cast("string"))).otherwise("").alias("query"),
        F.unix_timestamp("ts").cast("string").alias("stamp"), n.cast("string").alias("nonce"), F.when(n % 3 == 0, F.sha2(F.coalesce("props", F.lit("")), 256)).alias("body"),
    )
    return rows.withColumn("message", U.signed_message("method", "path", "query", "stamp", "nonce", "body"))


@query(f"WITH {_REQUESTS} SELECT event_id, signature FROM signed")
def signed_requests(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("event_id", U.hmac_sha256(F.lit("secret"), F.col("message")).alias("signature"))


@query(f"WITH {_REQUESTS} SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM signed")
def verified_requests(spark: SparkSession, d: str) -> DataFrame:
    """Signatures in capitals hold; those of another path, and missing ones, don't."""
    rows = _requests(spark, d).withColumn("signature", F.upper(U.hmac_sha256(F.lit("secret"), F.when(F.col("event_id") % 5 == 0, F.concat("message", F.lit("/"))).otherwise(F.col("message")))))
    rows = rows.withColumn("signature", F.when(F.col("event_id") % 7 != 0, F.col("signature")))
    return rows.select("event_id", U.signature_holds(F.lit("secret"), F.col("message"), F.col("signature")).alias("valid"))


@query(
    f"""WITH d AS (SELECT doc_id, text AS title, source AS author, bundle_id AS subject, lang AS keywords FROM documents), n AS (SELECT doc_id, tgt_text AS title, CASE WHEN doc_id % 2 = 0 THEN ' ' || tgt_lang || chr(9) END AS author, CAST(NULL AS VARCHAR) AS subject, ' ' AS keywords FROM documents WHERE doc_id % 3 = 0)
    SELECT d.doc_id, {", ".join(f"coalesce({Q.strip(f'coalesce({Q.strip(f'n.{c}')}, d.{c})')}, '') AS {c}" for c in records.METADATA)} FROM d LEFT JOIN n USING (doc_id)"""
)
def metadata_write(spark: SparkSession, d: str) -> DataFrame:
    """Documents' fields as metadata, those of every third one written anew from its counterpart."""
    t = _t(spark, d, "documents")
    own = t.select("doc_id", F.col("text").alias("title"), F.col("source").alias("author"), F.col("bundle_id").alias("subject"), F.col("lang").alias("keywords"))
    new = t.where("doc_id % 3 = 0").select("doc_id", F.col("tgt_text").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), "tgt_lang", F.lit("\t"))).alias("author"), F.lit(None).cast("string").alias("subject"), F.lit(" ").alias("keywords"))
    return records.write_metadata(own, new).select("doc_id", *records.read_metadata())


@query(
    """WITH j AS (SELECT job_id, arg_max(struct_pack(s := status, o := owner, k := session_id), received_at) AS v, arg_min(struct_pack(o := owner, k := session_id), received_at) AS w FROM ocr_jobs GROUP BY job_id)
    SELECT job_id, v.s AS status, coalesce(v.o, w.o, 'none') AS owner, coalesce(v.k, w.k, 'none') AS session_id FROM j"""
)
def task_merge(spark: SparkSession, d: str) -> DataFrame:
    j = _t(spark, d, "ocr_jobs")
    new = j.groupBy("job_id").agg(F.max_by(F.struct("status", "owner", "session_id"), "received_at").alias("v")).select("job_id", "v.*")
    old = j.groupBy("job_id").agg(F.min_by(F.struct("owner", "session_id"), "received_at").alias("w")).select("job_id", "w.*")
    return records.merge_tasks(new, old, ["owner", "session_id"]).na.fill("none", ["owner", "session_id"])


@query(f"WITH {Q.N} SELECT doc_id, page_no, node_no, CASE kind WHEN 'table' THEN 1 WHEN 'list' THEN 2 ELSE 0 END AS part FROM n")
def node_concat(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return records.in_order(n.where("kind NOT IN ('table', 'list')"), n.where("kind = 'table'"), n.where("kind = 'list'")).select("doc_id", "page_no", "node_no", "part")


@query(
    f"""WITH {Q.E} SELECT doc_id, page_no, element_no, round(x * 300 / 72, 6) AS px, round(y + 0.85 * height, 6) AS base_y, round(y + 0.85 * height + 0.12 * size, 6) AS underline_y, round(y + 0.85 * height - 0.28 * size, 6) AS strike_y, round(greatest(0.8, 0.06 * size), 6) AS line_width FROM e"""
)
def scaled_lines(spark: SparkSession, d: str) -> DataFrame:
    base = records.baseline(F.col("y"), F.col("height"))
    rows = _elements(spark, d).select("doc_id", "page_no", "element_no", records.pixels(F.col("x"), 300).alias("px"), base.alias("base_y"), *records.decoration(base, F.col("size")))
    return rows.select("doc_id", "page_no", "element_no", *[F.round(c, 6).alias(c) for c in ("px", "base_y", "underline_y", "strike_y", "line_width")])


@query(f"WITH {Q.E}, {Q.WORDS} SELECT doc_id, page_no, word_no, lead(x0) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY word_no) AS next_x FROM w")
def next_words(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("word_no")
    return _words(spark, d).select("doc_id", "page_no", "word_no", F.lead("x0").over(order).alias("next_x"))


@query(
    f"""WITH {Q.N} SELECT doc_id, page_no, node_no FROM n WHERE NOT (bbox.x1 / 8 - bbox.x0 / 8 < 25 AND bbox.y1 / 8 - bbox.y0 / 8 < 25 AND node_no % 3 <> 0)"""
)
def shown_images(spark: SparkSession, d: str) -> DataFrame:
    """Nodes' boxes, an eighth as large, as images; every third one has its data with it."""
    b = F.col("bbox")
    key = F.when(F.col("node_no") % 3 == 0, "data:image/png;base64,AA").otherwise("k")
    rows = _nodes(spark, d).select("doc_id", "page_no", "node_no", G.rect(b["x0"] / 8, b["y0"] / 8, b["x1"] / 8, b["y1"] / 8).alias("bbox"), key.alias("image_key"))
    return records.shown_images(rows).select("doc_id", "page_no", "node_no")


# ---- state: jobs, leases, sessions, nonces


_STATUS = "CASE WHEN event_id % 50 = 7 THEN 'cancel_requested' WHEN event_id % 17 = 3 THEN 'failed' WHEN event_id % 13 = 5 THEN 'succeeded' WHEN event_id % 11 = 2 THEN 'cancelled' WHEN event_id % 7 = 1 THEN 'queued' ELSE 'running' END"


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("job_id"), "ts", F.col("event_id").alias("event_no"), F.expr(_STATUS).alias("status"), F.pmod(F.col("event_id") * 37, F.lit(130)).cast("int").alias("progress"))


@query(
    f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, {_STATUS} AS s, CAST(least(100, event_id * 37 % 130) AS INTEGER) AS p FROM events),
    g AS (SELECT *, min(CASE WHEN s IN ('succeeded', 'failed', 'cancelled') THEN rn END) OVER w AS f, min(CASE WHEN s = 'cancel_requested' THEN rn END) OVER w AS k FROM e WINDOW w AS (PARTITION BY job_id)),
    h AS (SELECT *, coalesce(k < coalesce(f, k + 1), false) AS c, max(CASE WHEN rn = f THEN s END) OVER (PARTITION BY job_id) AS sf FROM g),
    m AS (SELECT *, min(CASE WHEN c AND s = 'cancelled' AND rn > k THEN rn END) OVER (PARTITION BY job_id) AS m FROM h),
    x AS (SELECT *, CASE WHEN c THEN m IS NULL OR rn <= m OR s = 'cancelled' ELSE f IS NULL OR rn <= f OR s = sf END AS ok FROM m),
    y AS (SELECT *, max(CASE WHEN s <> 'running' THEN rn END) OVER (PARTITION BY job_id) AS other FROM x),
    z AS (SELECT job_id, bool_or(c) AS c, max(m) AS m, max(sf) AS sf, arg_max(s, rn) AS last, CAST(count(*) FILTER (WHERE ok) AS INTEGER) AS updates, arg_max(p, rn) FILTER (WHERE ok) AS p, max(p) FILTER (WHERE rn > coalesce(other, 0)) AS risen FROM y GROUP BY job_id)
    SELECT job_id, CASE WHEN c THEN CASE WHEN m IS NULL THEN 'cancel_requested' ELSE 'cancelled' END ELSE coalesce(sf, last) END AS status, CASE WHEN NOT c AND sf IS NULL AND last = 'running' THEN risen ELSE p END AS progress, c AS cancel_requested, updates FROM z"""
)
def job_fold(spark: SparkSession, d: str) -> DataFrame:
    return jobs.fold_jobs(_job_events(spark, d))


@query(
    f"""WITH j AS (SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max({_STATUS}, struct_pack(a := ts, b := event_id)) AS last_status, max(ts) AS updated_at FROM events GROUP BY user_id)
    SELECT job_id, CASE WHEN last_status = 'running' AND (SELECT max(ts) FROM events) - INTERVAL 20 MINUTE > updated_at THEN 'failed' ELSE last_status END AS status FROM j"""
)
def job_stuck(spark: SparkSession, d: str) -> DataFrame:
    e = _job_events(spark, d)
    now = e.agg(F.max("ts")).first()[0]  # one value
    rows = e.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_no")).alias("status"), F.max("ts").alias("updated_at"))
    return jobs.stuck(rows, str(now)).select("job_id", "status")


@query("WITH j AS (SELECT job_id, max(created_at) AS created_at FROM ocr_jobs GROUP BY job_id) SELECT job_id, created_at FROM j ORDER BY created_at DESC, job_id LIMIT 50")
def jobs_recent(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the newest jobs."""
    return jobs.recent(_t(spark, d, "ocr_jobs").groupBy("job_id").agg(F.max("created_at").alias("created_at")), 50)


@query("WITH j AS (SELECT job_id, max(created_at) AS created_at FROM ocr_jobs GROUP BY job_id) SELECT job_id, created_at FROM j WHERE epoch(created_at) // 1 > epoch(TIMESTAMP '2031-07-01') - 86400 * 30")
def index_prune(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "ocr_jobs").groupBy("job_id").agg(F.max("created_at").alias("created_at"))
    return jobs.live_index(rows, "2031-07-01 00:00:00", 86400 * 30)


def _seconds() -> object:
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


@query()
def lease_outcomes(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_id") % 5 == 0, "release").when(F.col("event_id") % 7 == 0, "renew").otherwise("acquire")
    e = _t(spark, d, "events").select(F.col("event_id").alias("event_no"), _seconds().alias("ts"), action.alias("action"), F.concat(F.lit("t"), F.pmod("user_id", F.lit(40)).cast("string")).alias("task_id"), F.concat(F.lit("i"), F.pmod("user_id", F.lit(6)).cast("string")).alias("identity_id"), F.pmod("user_id", F.lit(64)).alias("pool"))
    return jobs.lease_outcomes(e)


@query()
def session_outcomes(spark: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_id") % 9 == 0, "delete").when(F.col("event_id") % 2 == 0, "get").when(F.col("event_id") % 5 == 0, "page").otherwise("create")
    page, dpi = F.pmod("event_id", F.lit(3)).alias("page"), F.lit(120.0).alias("dpi")
    e = _t(spark, d, "events").select(F.col("event_id").alias("event_no"), _seconds().alias("ts"), action.alias("action"), F.sha2(F.col("user_id").cast("string"), 256).alias("sha256"), page, dpi, F.pmod("user_id", F.lit(64)).alias("shard"))
    return jobs.session_outcomes(e)


@query(
    """WITH n AS (SELECT event_id, ts, user_id % 500 AS nonce, CAST(event_id * 7919 % 500 AS BIGINT) <= 300 AS fresh FROM events)
    SELECT event_id AS event_no, fresh AND row_number() OVER (PARTITION BY nonce, fresh ORDER BY epoch(ts) // 1, event_id) = 1 AS accepted FROM n"""
)
def nonce_first_use(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("event_id").alias("event_no"), _seconds().alias("ts"), F.pmod("user_id", F.lit(500)).alias("nonce"), (_seconds() - F.pmod(F.col("event_id") * 7919, F.lit(500))).alias("request_ts"))
    return jobs.accepted_requests(e)


@query("SELECT event_id, least(100, greatest(0, CAST(floor(CAST(event_id % 90 AS DOUBLE) / greatest(1, event_id % 70) * 100) AS INTEGER))) AS progress FROM events")
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", G.progress(F.col("event_id") % 90, F.col("event_id") % 70).alias("progress"))


# ---- source facts


def _facts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return source_facts.source_facts(_t(spark, d, "sources")).where(F.col("kind") == kind).drop("kind")


@query()
def source_routes(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "route").select(F.col("name").alias("method"), F.col("detail").alias("path_pattern"), "path", "line_number", F.col("owner").alias("handler"), F.col("flag").alias("auth_required"), "framework")


@query()
def source_models(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "model").select("name", "path", "line_number", "framework")


@query()
def source_fields(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "field").select(F.col("owner").alias("model"), "name", F.col("detail").alias("type"), F.col("flag").alias("required"), "path", "line_number")


@query()
def source_env_refs(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "env_ref").select("task_id", "name", "path", "line_number", F.col("detail").alias("access_mechanism"))


@query()
def source_imports(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "import").select("path", F.lit("source_import").alias("rule_type"), "detail", "line_number", X.technology("name").alias("technology"))


@query()
def source_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d, "diagnostic").select("task_id", "path", F.col("name").alias("code"), F.col("detail").alias("message"), F.col("framework").alias("severity"))


@query()
def source_totals(spark: SparkSession, d: str) -> DataFrame:
    return source_facts.totals(source_facts.source_facts(_t(spark, d, "sources")))


@query()
def source_answer_order(spark: SparkSession, d: str) -> DataFrame:
    """Where each fact stands in its task's answer."""
    return source_facts.placed(source_facts.source_facts(_t(spark, d, "sources"))).select("task_id", "kind", "place", "path", "name", "line_number")
