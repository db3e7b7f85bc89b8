"""Operators on small inputs with known results."""

import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.functions import udf as U
from pagewright.operators import editing, extract, from_text, layout, pages, plans, render, service, source_facts, spatial, structured, tables
from pagewright.schema import SPAN
from pagewright.sources import readers, store, writers

NODE = f"doc_id string, page_no int, node_no int, kind string, bbox struct<x0:double,y0:double,x1:double,y1:double>, role string, source string, level int, ordered boolean, spans array<{SPAN}>, items array<struct<spans:array<{SPAN}>,level:int,marker:string>>, headers array<string>, rows array<array<string>>, alignments array<string>, raw_text string, name_spans array<{SPAN}>, title_spans array<{SPAN}>, contact_spans array<{SPAN}>"


def node(no, box, text="t", kind="paragraph", role="primary", page=1, size=11.0, bold=False, **more):
    row = dict.fromkeys([f.split(" ")[0] for f in NODE.split(", ")])
    return row | {"doc_id": "d", "page_no": page, "node_no": no, "kind": kind, "bbox": tuple(map(float, box)), "role": role, "source": "n", "spans": [(text, bold, False, False, size, "helv", None)]} | more


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODE)


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([("d", 1, 600.0, 800.0)], "doc_id string, page_no int, width double, height double")


def ordered(spark, rows, page):
    out = layout.reading_order(layout.columns(layout.regions(nodes(spark, rows), page)))
    return [r.node_no for r in out.orderBy("reading_order").collect()]


def test_two_columns_read_left_first(spark, page):
    assert ordered(spark, [node(0, (350, 100, 550, 150)), node(1, (50, 100, 250, 150))], page) == [1, 0]


def test_mixed_regions(spark, page):
    rows = [node(0, (50, 40, 550, 80)), node(1, (50, 120, 250, 200)), node(2, (350, 120, 550, 200)), node(3, (50, 250, 550, 400), kind="table"), node(4, (50, 750, 550, 780))]
    assert ordered(spark, rows, page) == [0, 1, 2, 3, 4]
    assert layout.region_bounds(layout.regions(nodes(spark, rows), page)).count() >= 3


@settings(max_examples=8, deadline=None)
@given(boxes=st.lists(st.tuples(st.integers(0, 500), st.integers(0, 700), st.integers(10, 500)), min_size=1, max_size=12))
def test_reading_order_is_a_permutation(spark, page, boxes):
    rows = [node(i, (x, y, x + w, y + 12)) for i, (x, y, w) in enumerate(boxes)]
    assert sorted(ordered(spark, rows, page)) == list(range(len(rows)))


def test_running_roles_are_not_rendered(spark):
    rows = [node(0, (50, 10, 550, 30), "head", role="header"), node(1, (50, 100, 550, 150), "Body *x*"), node(2, (50, 780, 550, 795), "foot", role="footer")]
    assert render.document_markdown(nodes(spark, rows)).first().markdown == "Body \\*x\\*\n"


@pytest.mark.parametrize(("size", "bold", "text", "level"), [(24, False, "Title", 1), (18, False, "Part", 2), (11, False, "plain", None), (24, False, "Ends.", None), (11, True, "SHORT", 2), (11, False, "1.2 Intro", 3), (24, False, "Frontend: JavaScript and more", None), (13.5, False, "x", 3)])
def test_heading_levels(spark, size, bold, text, level):
    row = spark.range(1).select(layout.heading_level(F.lit(text), F.lit(float(size)), F.lit(11.0), F.lit(bold), F.lit(True)).alias("v")).first()
    assert row.v == level


@pytest.mark.parametrize(
    ("original", "edited", "out"),
    [
        ("Hello beautiful world", "Hello wonderful world", ("replace", 6, 15, "beautiful", "wonderful", False)),
        ("Built a production-ready PDF platform", "Built a production-grade PDF platform", ("replace", 8, 24, "production-ready", "production-grade", False)),
        ("Hello wonderful world", "Hello world", ("delete", 6, 15, "wonderful", "", False)),
        ("Java Java Java", "Java Python Java", ("replace", 5, 9, "Java", "Python", False)),
        ("Developer", "Dev", ("replace", 0, 9, "Developer", "Dev", False)),
        ("beautiful", "beautyful", ("replace", 0, 9, "beautiful", "beautyful", False)),
        ("Engineer.", "Engineer,", ("replace", 8, 9, ".", ",", True)),
    ],
)
def test_diffs(original, edited, out):
    (op,) = editing.diff(original, edited)
    assert (op[0], op[1], op[2], op[3], op[6], op[7]) == out


def test_insertions_may_end_before_they_start():
    assert editing.diff("Hello world", "Hello wonderful world")[0][:3] == ("insert", 6, 5)
    assert editing.diff("Developer", "Senior Developer")[0][:2] == ("insert", 0)


@given(st.lists(st.sampled_from(["a", "b", "cc", "d."]), min_size=1, max_size=8), st.lists(st.sampled_from(["a", "b", "cc", "d,"]), min_size=1, max_size=8))
def test_replaced_words_give_the_edited_text(a, b):
    x, y = " ".join(a), " ".join(b)
    if len(a) != len(b):
        return
    for op in reversed(editing.diff(x, y)):
        x = x[: op[1]] + op[6] + x[op[2] :]
    assert x == y


ELEMENT = "doc_id string, page_no int, element_no int, text string, original_text string, x double, y double, width double, height double, size double, font string, bg_color string, text_color string, target_substring string, selection_start int, selection_end int, bold boolean, italic boolean, underline boolean, strikethrough boolean, style struct<fontFamily:string,fontSize:double,color:string,bold:boolean,italic:boolean,underline:boolean,strikethrough:boolean,background:string>"


def elements(spark, *rows):
    names = [f.strip().split(" ")[0] for f in ELEMENT.split(", style")[0].split(", ")] + ["style"]
    base = {"doc_id": "d", "page_no": 1, "x": 0.0, "y": 0.0, "width": 100.0, "height": 10.0, "size": 10.0, "font": "helv"}
    return spark.createDataFrame([tuple((base | {"element_no": i} | r).get(n) for n in names) for i, r in enumerate(rows)], ELEMENT)


def targets(spark, *rows):
    return editing.edit_targets(elements(spark, *rows)).orderBy("element_no", "target_no").collect()


def both(text, **more):
    return {"text": text, "original_text": text} | more


def test_targets_of_style_edits(spark):
    assert targets(spark, both("Hello", target_substring="absent", bold=True)) == []
    (t,) = targets(spark, both("Hello world, world, world", target_substring="world", selection_start=13, selection_end=18, bold=True))
    assert (t.original_start, t.original_end, t.granularity, t.confidence) == (13, 18, "word", "exact") and 0 < t.x0 < t.x1 < 100
    (t,) = targets(spark, both("Hello world", target_substring="world", selection_start=3, selection_end=99, bold=True))
    assert (t.original_start, t.original_end) == (6, 11)
    (t,) = targets(spark, both("Hello world", italic=True))
    assert (t.original_start, t.original_end, t.n_chars) == (0, 11, 11) and t.neighbour_x is None
    assert targets(spark, both("Hello world")) == []


def test_targets_of_insertions_and_punctuation(spark):
    (t,) = targets(spark, {"text": "a b c", "original_text": "a c"})
    assert t.operation == "insert" and t.x0 is None and t.granularity == "insertion_point" and t.insertion_x > 0
    (t,) = targets(spark, {"text": "Senior Dev", "original_text": "Dev"})
    assert t.insertion_x == 0.0 and t.confidence == "exact"
    (t,) = targets(spark, {"text": "Engineer, x", "original_text": "Engineer. x"})
    assert t.granularity == "character" and t.n_chars == 1 and t.neighbour_x > t.x1
    (t,) = targets(spark, {"text": "a  b", "original_text": "a b"})  # only blanks differ: the whole text
    assert (t.original_start, t.original_end, t.replacement) == (0, 3, "a  b")


def test_targets_take_the_most_similar_line_or_fall_back(spark):
    e = elements(spark, {"text": "alpha gamma", "original_text": "alpha beta"})
    lines = elements(spark, both("other beta"), both("alpha beta", x=50.0)).withColumn("line_no", F.col("element_no"))
    (t,) = editing.edit_targets(e, editing.chars_of(lines)).collect()
    assert t.x0 == 110.0 and t.confidence == "exact"
    far = editing.chars_of(elements(spark, both("something else", y=500.0)).withColumn("line_no", F.col("element_no")))
    (t,) = editing.edit_targets(e, far).collect()
    assert (t.confidence, t.granularity, t.x0, t.x1, t.baseline) == ("line_fallback", "line", 0.0, 100.0, 8.5)


def test_one_changed_line_is_cut_and_written_once(spark):
    e = elements(spark, both("one"), {"text": "two words new", "original_text": "two words old", "y": 20.0}, both("three", y=40.0))
    ops = plans.compile_ops(editing.edit_targets(e), e).orderBy("seq").collect()
    assert [(o.op, o.element_no, o.text) for o in ops] == [("redact", 1, None), ("apply", None, None), ("text", 1, "new")]
    assert plans.compile_ops(editing.edit_targets(elements(spark, both("one"))), elements(spark, both("one"))).count() == 0


def test_styles_are_drawn_in_order(spark):
    style = ("helv", 14.0, "#FF0000", True, True, True, True, '{"enabled": true, "color": "#FFFF00"}')
    e = elements(spark, both("Styled", style=style), both("absent", target_substring="zzz", bold=True, y=30.0))
    ops = plans.compile_ops(editing.edit_targets(e), e).orderBy("seq").collect()
    assert [o.op for o in ops] == ["redact", "redact", "apply", "background", "text", "text", "strikeout", "underline"]
    text = next(o for o in ops if o.op == "text" and o.element_no == 0)
    assert (text.font, text.size, text.color) == ("hebi", 14.0, "#FF0000") and {o.element_no for o in ops if o.op == "redact"} == {0, 1}


def entries(spark, page, *rows):
    out = layout.group_entries(layout.reading_order(layout.columns(layout.regions(nodes(spark, [node(i, (50, 100 + 20 * i, 250, 110 + 20 * i), **r) for i, r in enumerate(rows)]), page), grouper=True)))
    return [(r.entry_no, r.part) for r in out.orderBy("node_no").collect()]


def test_entries(spark, page):
    title, meta, long = {"text": "Senior Engineer", "bold": True}, {"text": "2019, Berlin"}, {"text": "word " * 14}
    assert entries(spark, page, title, meta, long) == [(1, "title"), (1, "metadata"), (1, "body")]
    assert entries(spark, page, long, title, meta, {"text": "x", "kind": "list"}, {"text": "Head", "kind": "heading"}, long) == [(None, "single"), (1, "title"), (1, "metadata"), (1, "bullet"), (None, "single"), (None, "single")]
    dated = {"text": "Role, 2020", "bold": True}  # could be a title, and reads like metadata
    assert [p for _, p in entries(spark, page, dated, dated, dated, dated, long)] == ["title", "metadata", "title", "metadata", "body"]


def test_structured_pages(spark, page):
    rows = [
        node(0, (50, 40, 550, 70), "Jane Doe", size=24.0, bold=True), node(1, (50, 75, 550, 90), "jane@post.test"), node(2, (50, 92, 550, 99), "", kind="table", headers=["lost"], spans=[]), node(3, (50, 200, 250, 210), "Senior Engineer", bold=True), node(4, (50, 220, 250, 230), "2019, Berlin"),
        node(5, (50, 240, 250, 250), "x", kind="list", items=[([("Did this", False, False, False, 11.0, "helv", None)], 0, None)]), node(6, (50, 260, 250, 270), "word " * 14), node(7, (350, 200, 550, 210), "Aside", role="footer"), node(8, (350, 220, 550, 230), "Note. Stays."),
    ]
    (row,) = structured.structured_markdown(nodes(spark, rows), page).collect()
    words = ("word " * 14).strip()
    assert row.markdown == f"# Jane Doe\n\n\njane@post.test\n\n\n### **Senior Engineer**\n\n\n*2019, Berlin*\n\n\n{words}\n\n\n- Did this\n\n\nNote. Stays.\n"


def test_extraction_takes_native_lines_or_words(spark):
    line = "doc_id string, page_no int, line_no int, text string, x double, y double, width double, height double, size double, font string, text_color string"
    lines = spark.createDataFrame([("d", 1, 0, " Native ", 1.0, 1.0, 50.0, 10.0, 11.26, None, None), ("d", 1, 1, "Native", 1.0, 1.5, 50.0, 10.0, None, "f", "#111111"), ("d", 1, 2, "flat", 1.0, 40.0, 50.0, 0.0, 9.0, "f", None), ("d", 2, 0, "hidden", 1.0, 1.0, 5.0, 5.0, 9.0, "f", None)], line)
    word = "doc_id string, page_no int, word_no int, text string, conf double, x0 double, y0 double, x1 double, y1 double"
    native = spark.createDataFrame([("d", 1, 0, "Native", None, 1.0, 1.0, 2.0, 2.0)], word)
    ocr = spark.createDataFrame([("d", 2, 0, "two", 90.0, 10.0, 10.0, 30.0, 20.0), ("d", 2, 1, "words", 80.0, 35.0, 10.0, 70.0, 22.0), ("d", 2, 2, "weak", 10.0, 75.0, 10.0, 90.0, 20.0), ("d", 2, 3, "i", 90.0, 10.0, 60.0, 12.0, 70.0), ("d", 1, 9, "ignored", 90.0, 1.0, 60.0, 22.0, 70.0)], word)
    got = extract.elements_of(lines, native, ocr)
    assert [(r.page_no, r.element_no, r.text, r.size, r.font, r.is_ocr) for r in got.orderBy("page_no", "element_no").collect()] == [(1, 0, "Native", 11.3, "sans-serif", False), (2, 0, "two words", 13.8, "helv", True)]
    sheets = spark.createDataFrame([("d", 1, 2), ("d", 2, 1), ("d", 3, None)], "doc_id string, page_no int, image_block_count int")
    records = {r.page_no: (r.kind, r.is_ocr, r.word_count, r.text_block_count, r.image_block_count) for r in extract.page_records(sheets, got, native).collect()}
    assert records == {1: ("mixed", False, 1, 1, 2), 2: ("scanned", True, 0, 0, 0), 3: ("blank", True, 0, 0, 0)}


def test_markdown_of_texts(spark):
    plain, listed = "some plain line of text that is long enough to stay a paragraph here", "- bullet that is long enough to be no heading by its size"
    docs = spark.createDataFrame([(1, f"Main Title\n{plain}\n{listed}\n1. {plain}"), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r.markdown for r in from_text.markdown_of_texts(docs).collect()}
    assert rows == {"1": f"# **Main Title**\n\n\n{plain}\n\n\n- {listed}\n\n\n1. 1. {plain}\n"}  # the mark stays in the text


def test_stacked_tables_number_rows_on(spark):
    rows = [node(i, (0, 0, 9, 9), kind="table", page=p, headers=["h"], rows=[["a", "b"], []]) for i, p in ((0, 2), (1, 1))]
    got = {(r.row_no, r.col_no): r.text for r in tables.stacked(nodes(spark, rows)).collect()}
    assert got == {(0, 0): "h", (1, 0): "a", (1, 1): "b", (3, 0): "h", (4, 0): "a", (4, 1): "b"}


def test_forms(spark):
    forms = spark.createDataFrame([(1, '[{"page": 1, "x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}, {"page": 2}]', "a||| |||b c"), (2, "no json", None), (3, None, "")], "id int, boxes string, keywords string")
    assert [(r.id, r.box_no, r.page, r.height) for r in readers.form_boxes(forms.drop("keywords")).orderBy("box_no").collect()] == [(1, 0, 1, 0.4), (1, 1, 2, None)]
    assert [(r.id, r.keyword) for r in readers.form_keywords(forms.drop("boxes")).orderBy("keyword_no").collect()] == [(1, "a"), (1, "b c")]


def test_files_without_a_codec_are_rows_with_an_error(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 no real document")
    (row,) = readers.pdf_documents(spark, str(tmp_path)).collect()
    assert row.status == "error" and row.error and row.n_pages is None


def test_markdown_sink_and_object_keys(spark, tmp_path):
    writers.write_markdown(spark.createDataFrame([("a", "# x\n"), ("b", "y\n")], "doc_id string, markdown string"), str(tmp_path / "out"))
    back = spark.read.json(spark.read.text(str(tmp_path / "out")).select("value").rdd.map(lambda r: r.value))
    assert {(r.doc_id, r.markdown) for r in back.collect()} == {("a", "# x\n"), ("b", "y\n")}
    keys = [r.k for r in spark.range(2).select(writers.object_key(F.lit("in"), F.lit("scan.PDF")).alias("k")).collect()]
    assert keys[0] != keys[1] and all(len(k) == 3 + 32 + 4 and k.startswith("in/") and k.endswith(".pdf") for k in keys)


def test_pages_are_written_in_order(spark, tmp_path):
    rows = [("b", 2, "b2"), ("a", 10, "a10"), ("a", 2, "a2"), ("b", 1, "b1")]
    writers.write_pages(spark.createDataFrame(rows, "doc_id string, page_no int, markdown string"), str(tmp_path / "out"))
    read = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert [json.loads(x)["text"] for x in read] == ["a2", "a10", "b1", "b2"]


def test_object_store(spark, tmp_path):
    secret, folder = F.lit("0123456789abcdef0123456789abcdef").cast("binary"), str(tmp_path / "store")
    rows = spark.createDataFrame([("scan.PDF", bytearray(b"one")), ("notes.xyz", bytearray(b"")), ("a.json", bytearray(b"{}"))], "name string, content binary")
    keys = store.put(rows, folder, secret)
    got = {r.name: (r.kind, bytes(r.content)) for r in store.get(spark, folder, secret).collect()}
    assert got == {"scan.PDF": ("application/pdf", b"one"), "notes.xyz": ("application/octet-stream", b""), "a.json": ("application/json", b"{}")}
    assert [r.name for r in store.get(spark, folder, secret, keys.where("name = 'a.json'")).collect()] == ["a.json"]
    assert all(bytes(r.content) not in (b"one", b"{}") for r in spark.read.parquet(folder).collect())


def test_scanned_pages_are_painted(spark):
    e = elements(spark, both("same"), {"text": "new", "original_text": "old", "bg_color": "#EEEEEE", "x": 5.0, "y": 7.0}, {"text": "", "original_text": "gone", "bg_color": "transparent", "y": 40.0})
    ops = plans.image_ops(e).orderBy("seq").collect()
    assert [(o.op, o.element_no, o.color) for o in ops] == [("paint", 1, "#EEEEEE"), ("paint", 2, "#ffffff"), ("image", None, None), ("text", 1, "#000000")]
    assert (ops[0].x0, ops[0].y0, ops[0].x1, ops[0].y1) == (9.0, 13.0, 211.0, 35.0) and (ops[3].x0, ops[3].y0) == (5.0, 15.5)


def test_merged_images_need_a_key(spark):
    rows = spark.createDataFrame([("j", 2, " k2 ", "b.PNG"), ("j", 1, "in/a.jpg", None), ("j", 3, " ", "c.exe")], "job_id string, position int, key string, name string")
    got = [(r.seq, r.key, r.local_name, r.error) for r in plans.merge_plan(rows).orderBy("seq").collect()]
    assert got == [(1, "in/a.jpg", "image-001.jpg", None), (2, "k2", "image-002.png", None), (3, "", "image-003.img", "missing object key for image #3")]


def test_signatures(spark):
    rows = spark.createDataFrame([("get", "/a", "x=1", "5", "n", None), ("POST", "/a", None, "5", "n", "ab")], "method string, path string, query string, stamp string, nonce string, body string")
    rows = rows.withColumn("m", U.signed_message("method", "path", "query", "stamp", "nonce", "body")).withColumn("s", U.hmac_sha256(F.lit("k"), F.col("m")))
    assert [r.m for r in rows.collect()] == ["GET\n/a?x=1\n5\nn", "POST\n/a\n5\nn\nab"]
    ok = rows.select(*[U.signature_holds(F.lit(k), F.col("m"), s).alias(n) for n, k, s in (("right", "k", F.upper("s")), ("secret", "x", F.col("s")), ("missing", "k", F.lit(None).cast("string")))]).collect()
    assert [tuple(r) for r in ok] == [(True, False, False)] * 2


def test_font_marks(spark):
    def marks(font, flags):
        return tuple(spark.range(1).select(X.bold_font(F.lit(font), F.lit(flags)), X.italic_font(F.lit(font), F.lit(flags))).first())

    assert [marks(*a) for a in (("Arial-Black", 0), ("x", 2), ("x", 1), ("Foo-BoldOblique", 0), ("x", 4), (None, 0))] == [(True, False), (True, False), (False, True), (True, True), (False, False), (False, False)]


def test_reconciliation(spark):
    def pair(role, text, box):
        return nodes(spark, [node(0, box, text, role=role)]).withColumn("text", layout.node_text())

    def kept(a, b):
        return spatial.reconciled(a, b).count()

    assert kept(pair("primary", "Exact Native Paragraph Text", (50, 100, 500, 150)), pair("primary", "Exact Native Paragraph Text", (52, 102, 498, 148))) == 1
    assert kept(pair("watermark", "WATERMARK DRAFT", (100, 200, 500, 600)), pair("primary", "Scanned Document Body Paragraph", (150, 300, 450, 350))) == 2
    assert kept(pair("header", "Page Header Text", (50, 10, 550, 30)), pair("primary", "Page Header Text", (50, 10, 550, 30))) == 2


def test_near_duplicates_are_compared_with_kept_ones(spark):
    rows = [("d", 1, 0, "a", 0.0, 0.0, 10.0, 5.0), ("d", 1, 1, "a", 100.0, 1.0, 10.0, 5.0), ("d", 1, 2, "a", 200.0, 2.0, 10.0, 5.0), ("d", 1, 3, "b", 0.0, 0.0, 10.0, 5.0)]
    e = spark.createDataFrame(rows, "doc_id string, page_no int, element_no int, text string, x double, y double, width double, height double")
    assert {r.element_no for r in layout.first_of_near(e).collect()} == {0, 2, 3}


def test_watermarks(spark):
    def score(*v):
        return spark.range(1).select(pages.watermark_score(*[F.lit(x) for x in v]).alias("s")).first().s

    assert score("CONFIDENTIAL", 200.0, 300.0, 400.0, 500.0, 600.0, 800.0, True, 28.0, 10.0, 0.4, False) >= 3.5
    assert score("Vertical Table Header Text", 50.0, 100.0, 100.0, 400.0, 600.0, 800.0, True, 10.0, 10.0, 1.0, False) < 3.5
    assert score("the first draft of it", 50.0, 600.0, 500.0, 620.0, 600.0, 800.0, False, 10.0, 10.0, 1.0, False) < 3.5


def test_comma_rows(spark):
    e = spark.createDataFrame([(1, "a, b,c"), (2, "plain"), (3, " "), (4, None)], "id int, text string")
    assert [(r.id, r.col_no, r.cell) for r in tables.comma_rows(e, ["id"]).orderBy("id", "col_no").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "plain")]


def test_stamps_off_the_document_are_left_out(spark, page):
    stamps = spark.createDataFrame([("d", 1, 1, 1.0, 1.0, 1.0, 1.0), ("d", 9, 2, 1.0, 1.0, 1.0, 1.0)], "doc_id string, page_no int, stamp_no int, x double, y double, w double, h double")
    assert [r.stamp_no for r in plans.sign_plan(stamps, page).collect()] == [1]


def test_public_paths(spark):
    f = lambda p: spark.range(1).select(service.public_path(F.lit(p)).alias("v")).first().v
    assert f("/health/x") and f("/") and not f("/api")


FASTAPI = '''
import os
from fastapi import APIRouter, Depends
from pydantic import BaseModel
router = APIRouter()
class Item(BaseModel):
    name: str
    size: int = 3
    note: Optional[str] = None
@router.get("/items")
def items(): return os.getenv("A_KEY")
@router.post("/items", dependencies=[Depends(x)])
async def create(): return os.environ["B_KEY"]
'''


def test_source_facts():
    got = source_facts.facts(FASTAPI)
    kinds = {k: [f for f in got if f[0] == k] for k in ("route", "model", "field", "env_ref", "import")}
    assert [(f[1], f[2], f[5]) for f in kinds["route"]] == [("GET", "/items", False), ("POST", "/items", True)]
    assert [(f[1], f[3]) for f in kinds["model"]] == [("Item", "pydantic")]
    assert [(f[1], f[5]) for f in kinds["field"]] == [("name", True), ("size", True), ("note", False)]
    assert {f[1] for f in kinds["env_ref"]} == {"A_KEY", "B_KEY"}
    assert len(kinds["import"]) == 2


def test_flask_and_columns():
    got = source_facts.facts('@app.route("/x", methods=["GET", "head"])\ndef f(): pass\nclass User(Base):\n    id = Column(Integer)\n    n = db.Column(String(3))\npath("users/", views.users)\n')
    assert [(f[1], f[2], f[3]) for f in got if f[0] == "route"] == [("GET", "/x", "flask"), ("HEAD", "/x", "flask"), ("GET", "/users/", "django")]
    assert [f[1] for f in got if f[0] == "field"] == ["id", "n"]


def test_bad_sources_are_isolated_and_nothing_runs():
    assert source_facts.facts("def broken(")[0][1] == "PARSE_SYNTAX_ERROR"
    assert source_facts.facts("raise RuntimeError('boom')\n")[-1][0] == "nodes"
    assert source_facts.facts("x = " + "-" * 80 + "1")[0][1] == "MAX_DEPTH_EXCEEDED"
    assert source_facts.facts(None) == []


def test_request_with_too_many_files_is_an_error(spark):
    rows = [(i, "t", "r", f"f{i}.py", "", datetime(2031, 1, 1), datetime(2031, 1, 1)) for i in range(25)]
    s = spark.createDataFrame(rows, "file_id long, task_id string, repo string, path string, content string, submitted_at timestamp_ntz, received_at timestamp_ntz")
    assert source_facts.request_limits(s).first().status == "ERROR"
    assert source_facts.source_facts(s).count() == 0  # and gives no facts


def test_answers_are_ordered_and_summed_up(spark):
    rows = [(i, "t", "r", p, FASTAPI, datetime(2031, 1, 1), datetime(2031, 1, 1)) for i, p in enumerate(("b.py", "a.py"))]
    s = spark.createDataFrame(rows, "file_id long, task_id string, repo string, path string, content string, submitted_at timestamp_ntz, received_at timestamp_ntz")
    facts = source_facts.source_facts(s)
    routes = source_facts.placed(facts).where("kind = 'route'").orderBy("place").collect()
    assert [(r.place, r.name, r.path) for r in routes] == [(0, "GET", "a.py"), (1, "GET", "b.py"), (2, "POST", "a.py"), (3, "POST", "b.py")]
    (total,) = source_facts.totals(facts).collect()
    assert total.n_files == 2 and total.n_nodes == 2 * int(next(f for f in source_facts.facts(FASTAPI) if f[0] == "nodes")[1])


def test_scripts_by_frequency(spark):
    rows = spark.createDataFrame([(1, "абв ab 1"), (2, ""), (3, None), (4, "a б")], "id int, t string")
    assert {r.id: r.scripts for r in U.scripts_by_frequency(rows, "id", "t").collect()} == {1: ["CYRILLIC", "LATIN"], 2: [], 3: [], 4: ["LATIN", "CYRILLIC"]}


def test_cancelling_and_progress(spark):
    import threading
    import time

    from pagewright.streaming import control

    rows, percent = control.observed(spark.range(50), "seen")
    rows.collect()
    assert percent(200) == 25 and percent(0) == 100
    ended = []

    def work():
        try:
            control.tagged(spark, "slow", lambda: spark.range(4).repartition(4).rdd.map(lambda r: time.sleep(60)).count())
        except Exception as e:
            ended.append(e)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(40):
        time.sleep(0.5)
        control.cancel(spark, "slow")
        if ended:
            break
    t.join(5)
    assert ended
