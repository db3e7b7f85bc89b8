"""Queries of the text operators over whole tables, and SQL for those that SQL can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import encoding, language, lookalike, mixture, parsing, personal, scanned, secrets, shared_spans, tokens
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *names: str) -> Query:
    """A query that gives whole tables to an operator."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(table(spark, sf_dir, n) for n in names))

    return query


def _mixture(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """A mixture sized by the corpus, in which short sources stop at their caps."""
    return mixture.mixture(docs, targets, mixture.CORPUS)


def _mixture_shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    return mixture.shares(_mixture(docs, targets), targets)


QUERIES: dict[str, Query] = {
    "p1_found": _over(lookalike.same_reading, "elements", "nodes"),
    "p1_edits": _over(lookalike.real_edits, "elements", "nodes"),
    "p1_consistent": _over(lookalike.consistent, "elements", "nodes"),
    "p2_found": _over(parsing.found, "sources"),
    "p2_dialects": _over(parsing.by_dialect, "sources"),
    "p2_rates": _over(parsing.rates, "sources"),
    "p2_diagnostics": _over(parsing.against_diagnostics, "sources", "diagnostics"),
    "p3_found": _over(language.mislabelled_spans, "nodes", "ocr_jobs", "documents", "lang_codes"),
    "p3_spans": _over(language.span_languages, "nodes", "ocr_jobs", "documents", "lang_codes"),
    "p3_documents": _over(language.document_languages, "nodes", "ocr_jobs", "documents", "lang_codes", "elements"),
    "p3_segments": _over(language.segments, "nodes", "ocr_jobs", "documents", "lang_codes"),
    "p4_found": _over(secrets.found, "sources", "env_refs"),
    "p4_redacted": _over(secrets.redacted, "sources", "env_refs"),
    "p5_found": _over(personal.found, "elements", "nodes", "given_names"),
    "p5_redacted": _over(personal.redacted, "elements", "nodes", "given_names"),
    "p6_found": _over(scanned.found, "elements", "nodes", "extract_pages"),
    "p6_text": _over(scanned.paragraphs, "elements", "nodes", "extract_pages"),
    "p7_found": _over(encoding.found, "elements"),
    "p7_restored": _over(encoding.restored, "elements"),
    "p8_ids": _over(tokens.encoded, "documents"),
    "p9_mixture": _over(_mixture, "documents", "mix_targets"),
    "p9_shares": _over(_mixture_shares, "documents", "mix_targets"),
    "p9_budget_shares": _over(_mixture_shares, "documents", "mix_targets"),
    "p10_found": _over(shared_spans.shared_spans, "documents"),
    "p10_report": _over(shared_spans.shared_report, "documents"),
    "p10_units": _over(shared_spans.unit_report, "documents"),
    "p10_text": _over(shared_spans.without_repeats, "documents"),
}

# Written apart from the operator: sign by sign, by ranges of code points.
_SAME_READING = r"""
WITH pairs AS (SELECT DISTINCT 'elements' AS tbl, doc_id, page_no, element_no AS item_no, text AS a, original_text AS b FROM elements WHERE text <> original_text
  UNION SELECT 'nodes', doc_id, page_no, node_no, array_to_string(list_transform(spans, lambda s: coalesce(s.text, '')), ''), raw_text FROM nodes),
numbered AS (SELECT row_number() OVER () AS k, * FROM pairs WHERE a <> b),
texts AS (SELECT k, side, regexp_replace(t, chr(173) || '([ \t]*)(\n|$)', '-\1\2', 'g') AS t FROM (SELECT k, 0 AS side, a AS t FROM numbered UNION ALL SELECT k, 1, b FROM numbered)),
signs AS (SELECT k, side, i, unicode(substr(t, CAST(i AS INTEGER), 1)) AS u FROM (SELECT k, side, t, unnest(range(1, length(t) + 1)) AS i FROM texts)),
plain AS (SELECT k, side, i, CASE
  WHEN u IN (173, 847, 1564, 4447, 4448, 6068, 6069, 65279) OR u BETWEEN 6155 AND 6158 OR u BETWEEN 8203 AND 8207 OR u BETWEEN 8234 AND 8238 OR u BETWEEN 8288 AND 8292 OR u BETWEEN 8294 AND 8303 OR u BETWEEN 65024 AND 65039 THEN ''
  WHEN u IN (160, 5760, 8239, 8287, 12288) OR u BETWEEN 8192 AND 8202 THEN ' '
  WHEN u IN (8208, 8209, 65123, 65293) THEN '-'
  WHEN u BETWEEN 65281 AND 65374 THEN chr(u - 65248)
  WHEN u BETWEEN 65504 AND 65510 AND u <> 65507 THEN substr('¢£¬ ¦¥₩', u - 65503, 1)
  WHEN u BETWEEN 119808 AND 120483 THEN chr(CASE WHEN (u - 119808) % 52 < 26 THEN 65 + (u - 119808) % 52 ELSE 71 + (u - 119808) % 52 END)
  WHEN u BETWEEN 120782 AND 120831 THEN chr(48 + (u - 120782) % 10)
  WHEN u = 64256 THEN 'ff' WHEN u = 64257 THEN 'fi' WHEN u = 64258 THEN 'fl' WHEN u = 64259 THEN 'ffi' WHEN u = 64260 THEN 'ffl' WHEN u IN (64261, 64262) THEN 'st'
  WHEN u = 306 THEN 'IJ' WHEN u = 307 THEN 'ij' WHEN u = 455 THEN 'LJ' WHEN u = 456 THEN 'Lj' WHEN u = 457 THEN 'lj' WHEN u = 458 THEN 'NJ' WHEN u = 459 THEN 'Nj' WHEN u = 460 THEN 'nj'
  ELSE chr(u) END AS c FROM signs),
composed AS (SELECT k, side, nfc_normalize(string_agg(c, '' ORDER BY i)) AS t FROM plain GROUP BY k, side),
again AS (SELECT k, side, t, unnest(range(1, length(t) + 1)) AS i FROM composed),
twins AS (SELECT k, side, i, substr(t, CAST(i AS INTEGER), 1) AS c, strpos('АВЕЅІЈКМНОРСТУХҮԌԚԜҺаеорсухѕіјһԁԛԝүЁЇёїΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαικνορυϲɑɡӏӀµ', substr(t, CAST(i AS INTEGER), 1)) AS place FROM again),
forms AS (SELECT k, side, nfc_normalize(string_agg(CASE WHEN place > 0 THEN substr('ABESIJKMHOPCTYXYGQWHaeopcyxsijhdqwyËÏëïABEZHIKMNOPTYXCjaikvopucaglIμ', CAST(place AS INTEGER), 1) ELSE c END, '' ORDER BY i)) AS t FROM twins GROUP BY k, side)
SELECT DISTINCT tbl, doc_id, page_no, item_no FROM numbered n WHERE coalesce((SELECT t FROM forms f WHERE f.k = n.k AND side = 0), '') = coalesce((SELECT t FROM forms f WHERE f.k = n.k AND side = 1), '')"""

_WINDOWS = f"""
windows AS (SELECT doc_id, unnest(range(0, length(text) - {shared_spans.LENGTH - 1})) AS s, text FROM documents WHERE length(text) >= {shared_spans.LENGTH}),
hashed AS (SELECT doc_id, s, substr(text, s + 1, {shared_spans.LENGTH}) AS g FROM windows),
common AS (SELECT g FROM hashed GROUP BY g HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT doc_id, s FROM hashed JOIN common USING (g)),
opens AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {shared_spans.LENGTH} THEN 0 ELSE 1 END AS o FROM starts),
runs AS (SELECT doc_id, s, sum(o) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM opens),
spans AS (SELECT doc_id, CAST(min(s) AS INTEGER) AS span_start, CAST(max(s) + {shared_spans.LENGTH} AS INTEGER) AS span_end FROM runs GROUP BY doc_id, r)"""

_UNITS = rf"""
listed AS (SELECT doc_id, regexp_extract_all(text, '{shared_spans.UNIT}') AS units FROM documents WHERE length(text) > 0),
cells AS (SELECT doc_id, unnest(units) AS unit, CAST(generate_subscripts(units, 1) - 1 AS INTEGER) AS unit_no FROM listed),
placed AS (SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY unit_no) AS span_end FROM cells),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(unit), '[ \t\r\n\f]+', ' ', 'g'), ' ') ORDER BY doc_id, span_end) AS place FROM placed WHERE length(unit) >= {shared_spans.LEAST_UNIT})"""

SQL: dict[str, str] = {
    "p1_found": _SAME_READING,
    "p10_found": f"WITH {_WINDOWS} SELECT doc_id, span_start, span_end FROM spans",
    "p10_report": f"""WITH {_WINDOWS}, sums AS (SELECT doc_id, CAST(sum(span_end - span_start) AS BIGINT) AS c FROM spans GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INTEGER) AS n_chars, coalesce(c, 0) AS shared_chars,
               CASE WHEN length(d.text) > 0 THEN CAST(coalesce(c, 0) AS DOUBLE) / length(d.text) ELSE 0.0 END AS shared_part
        FROM documents d LEFT JOIN sums USING (doc_id)""",
    "p10_units": rf"""WITH {_UNITS}
        SELECT doc_id, unit_no, CAST(span_end - length(unit) AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end, place = 1 AS kept FROM ranked""",
    "p10_text": rf"""WITH {_UNITS}, gone AS (SELECT doc_id, list(unit_no) AS nos, list({{'span_start': CAST(span_end - length(unit) AS INTEGER), 'span_end': CAST(span_end AS INTEGER)}} ORDER BY span_end) AS removed FROM ranked WHERE place > 1 GROUP BY doc_id),
        kept AS (SELECT u.doc_id, string_agg(CASE WHEN list_contains(nos, unit_no) THEN '' ELSE unit END, '' ORDER BY unit_no) AS text FROM placed u JOIN gone USING (doc_id) GROUP BY u.doc_id)
        SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.text END AS text, coalesce(removed, []) AS removed FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN gone g ON g.doc_id = d.doc_id""",
}
