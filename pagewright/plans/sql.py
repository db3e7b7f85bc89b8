"""Pieces of SQL for the statements that check queries."""

from __future__ import annotations

from ..functions.text import CONTACT, GLYPHS, METADATA, SPACE

E = "e AS (SELECT DISTINCT ON (doc_id, page_no, element_no) * FROM elements)"
N = "n AS (SELECT DISTINCT ON (doc_id, page_no, node_no) * FROM nodes)"
P = "p AS (SELECT DISTINCT ON (doc_id, page_no) * FROM extract_pages)"
S = "s AS (SELECT file_id, arg_max(struct_pack(task_id := task_id, repo := repo, path := replace(path, '\\', '/'), content := content), struct_pack(a := received_at, b := submitted_at, c := content)) AS f FROM sources GROUP BY file_id), f AS (SELECT file_id, s.f.task_id AS task_id, s.f.repo AS repo, s.f.path AS path, s.f.content AS content FROM s)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{SPACE}]+')"


def glyphs(x: str) -> str:
    for a, b in GLYPHS:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def escape(x: str) -> str:
    return f"regexp_replace({x}, '([\\\\*_#\\[\\]`|])', '\\\\\\1', 'g')"


def span(s: str) -> str:
    t = escape(f"{s}.text")
    b, i, c = (f"coalesce({s}.{k}, false)" for k in ("is_bold", "is_italic", "is_code"))
    marked = f"CASE WHEN {c} THEN '`' || {t} || '`' WHEN {b} AND {i} THEN '***' || {t} || '***' WHEN {b} THEN '**' || {t} || '**' WHEN {i} THEN '*' || {t} || '*' ELSE {t} END"
    return f"CASE WHEN coalesce({s}.link_url, '') <> '' THEN '[' || ({marked}) || '](' || {s}.link_url || ')' ELSE {marked} END"


def spans(x: str) -> str:
    return f"coalesce({strip(f'''array_to_string(list_transform(list_filter({x}, lambda s: coalesce(s.text, '') <> ''), lambda s: {span('s')}), ' ')''')}, '')"


def table() -> str:
    h, r, a = "coalesce(headers, [])", "coalesce(rows, [])", "coalesce(alignments, [])"
    w = f"greatest(len({h}), coalesce(list_max(list_transform({r}, lambda x: len(x))), 0))"

    def line(cells: str) -> str:
        return f"'| ' || array_to_string(list_concat({cells}, list_transform(range(0, {w} - len({cells})), lambda i: '')), ' | ') || ' |'"

    head = line(f"list_transform({h}, lambda c: replace(coalesce(c, ''), chr(10), '<br>'))")
    marks = f"'| ' || array_to_string(list_transform(range(1, {w} + 1), lambda i: CASE WHEN {a}[i] = 'center' THEN ':---:' WHEN {a}[i] = 'right' THEN '---:' ELSE ':---' END), ' | ') || ' |'"
    cells = "list_transform(x, lambda c: replace(replace(coalesce(c, ''), chr(10), '<br>'), '|', '\\|'))"
    body = f"list_transform({r}, lambda x: {line(cells)})"
    return f"CASE WHEN {w} > 0 THEN array_to_string(list_concat([{head}, {marks}], {body}), chr(10)) ELSE '' END"


def listed() -> str:
    mark = "CASE WHEN coalesce(ordered, false) THEN CAST(i AS VARCHAR) || '. ' ELSE '- ' END"
    return f"coalesce(array_to_string(list_transform(items, lambda x, i: repeat('  ', coalesce(x.level, 0)) || {mark} || {spans('x.spans')}), chr(10)), '')"


def chunk(prefix: str, x: str) -> str:
    return f"CASE WHEN ({x}) <> '' THEN chr(10) || {prefix} || ({x}) || chr(10) ELSE '' END"


def joined(*chunks: str) -> str:
    return f"array_to_string(list_filter([{', '.join(chunks)}], lambda c: c <> ''), chr(10))"


def node() -> str:
    name, title = (strip(f"replace({spans(c)}, '**', '')") for c in ("name_spans", "title_spans"))
    header = joined(chunk(q("# "), name), chunk(q("## "), title), chunk(q(""), spans("contact_spans")))
    marks = "repeat('#', greatest(1, least(6, coalesce(level, 1)))) || ' '"
    return f"""CASE WHEN kind = 'header_semantic' THEN {header} WHEN kind = 'heading' THEN {chunk(marks, spans("spans"))} WHEN kind = 'list' THEN {chunk(q(""), listed())}
      WHEN kind = 'table' THEN {chunk(q(""), table())} WHEN role = 'annotation' THEN {chunk(q("> **[Comment]**: "), spans("spans"))} ELSE {chunk(q(""), spans("spans"))} END"""


def node_text(x: str = "spans") -> str:
    return f"coalesce({strip(f'''array_to_string(list_transform({x}, lambda s: coalesce(s.text, '')), ' ')''')}, '')"


def any_span(test: str) -> str:
    return f"coalesce(list_bool_or(list_transform(spans, lambda s: coalesce({test}, false))), false)"


REGIONS = f"""
sized AS (SELECT n.*, p.width AS page_width, coalesce(n.bbox.x1 - n.bbox.x0 > 0.6 * p.width OR ({any_span("s.font_size >= 14")} AND n.bbox.y0 <= 150) OR n.kind IN ('table', 'page_break'), false) AS is_full FROM n JOIN p USING (doc_id, page_no)),
flips AS (SELECT *, CASE WHEN is_full <> lag(is_full) OVER w THEN 1 ELSE 0 END AS flip FROM sized WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY round(bbox.y0, 1), round(bbox.x0, 1), node_no)),
regioned AS (SELECT *, CAST(sum(flip) OVER (PARTITION BY doc_id, page_no ORDER BY round(bbox.y0, 1), round(bbox.x0, 1), node_no) AS INTEGER) AS region_id FROM flips)"""


def columns(grouper: bool) -> str:
    rest = "bbox.x0 < page_width - bbox.x1" if grouper else "bbox.x0 < gutter"
    return f"""
guttered AS (SELECT *, coalesce((max(CASE WHEN bbox.x1 < 0.48 * page_width THEN bbox.x1 END) OVER w + min(CASE WHEN bbox.x0 > 0.35 * page_width THEN bbox.x0 END) OVER w) / 2, 0.5 * page_width) AS gutter
  FROM regioned WINDOW w AS (PARTITION BY doc_id, page_no, region_id)),
columned AS (SELECT *, CASE WHEN is_full OR bbox.x1 <= gutter + 15 THEN 0 WHEN bbox.x0 >= gutter - 15 THEN 1 WHEN {rest} THEN 0 ELSE 1 END AS col_no FROM guttered),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY region_id, col_no, round(bbox.y0, 1), round(bbox.x0, 1), node_no) - 1 AS INTEGER) AS reading_order FROM columned)"""


WORDS = f"""
parts AS (SELECT doc_id, page_no, element_no AS line_no, x, y, width, height, {words("text")} AS ws FROM e),
ws AS (SELECT *, unnest(range(0, len(ws))) AS i FROM parts WHERE len(ws) > 0),
w AS (SELECT doc_id, page_no, CAST(line_no * 1000 + i AS INTEGER) AS word_no, line_no, ws[i + 1] AS text, CAST(((line_no * 7 + i) * 37 + page_no) % 101 - 1 AS DOUBLE) AS conf,
  x + i * (width / len(ws)) AS x0, y AS y0, x + i * (width / len(ws)) + (width / len(ws)) * 0.9 AS x1, y + height AS y1 FROM ws)"""

BOXES = "boxes AS (SELECT doc_id, page_no, 1 AS box_no, width * 0.05 AS x0, height * 0.15 AS y0, width * 0.45 AS x1, height * 0.30 AS y1 FROM p)"
METADATA_RE, CONTACT_RE = METADATA, CONTACT
