"""Column functions against known values."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry as G
from pagewright.functions import text as X
from pagewright.functions import udf as U


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_strip_takes_every_white_space(spark):
    assert one(spark, X.strip(F.lit(" \t a b 　\n"))) == "a b"


def test_glyphs(spark):
    assert one(spark, X.glyphs(F.lit("(cid:127) Bullet – point (cid:133)"))) == "• Bullet - point …"


def test_markdown_escape(spark):
    assert one(spark, X.markdown_escape(F.lit("User *bold* _italic_ #tag [link]"))) == r"User \*bold\* \_italic\_ \#tag \[link\]"


def test_spans(spark):
    span = "named_struct('text', {!r}, 'is_bold', {}, 'is_italic', {}, 'is_code', {}, 'link_url', {})"
    spans = F.expr(f"array({span.format('a', 'true', 'true', 'false', 'null')}, {span.format('', 'true', 'true', 'false', 'null')}, {span.format('b', 'false', 'false', 'true', '\"u\"')})")
    assert one(spark, X.spans_markdown(spans)) == "***a*** [`b`](u)"


def test_table_pads_rows_and_escapes_body_cells_only(spark):
    t = X.table_markdown(F.expr("array('a|b')"), F.expr("array(array('x|y', 'l\\nm'))"), F.expr("array('center')"))
    assert one(spark, t) == "| a|b |  |\n| :---: | :--- |\n| x\\|y | l<br>m |"


@pytest.mark.parametrize(("spec", "out"), [(None, "eng"), (" ", "eng"), ("AUTO", "auto"), ("Eng%2bDEU,eng", "eng+deu"), ("fra spa", "fra+spa"), ("+", "eng")])
def test_language_spec(spark, spec, out):
    assert one(spark, X.language_spec(F.lit(spec).cast("string"))) == out


@pytest.mark.parametrize(("family", "bold", "italic", "out"), [("helvetica", False, False, "helv"), ("Times New Roman", True, True, "tibi"), ("courier", False, True, "coit"), ("sans-serif", True, False, "tibo"), (None, False, False, "helv")])
def test_font_variant(spark, family, bold, italic, out):
    assert one(spark, X.font_variant(F.lit(family).cast("string"), F.lit(bold), F.lit(italic))) == out


@pytest.mark.parametrize(("seconds", "out"), [(0, "0s"), (59, "59s"), (60, "1m"), (90061, "1d 1h 1m"), (86400, "1d")])
def test_uptime(spark, seconds, out):
    assert one(spark, X.uptime_label(F.lit(seconds))) == out


def test_token_offsets(spark):
    rows = spark.createDataFrame([(1, " ab  c"), (2, ""), (3, None), (4, " \u00a0 ")], "id int, text string")
    assert [tuple(t) for t in X.token_offsets(rows, ["id"]).orderBy("id", "start").collect()] == [(1, 1, 3, "ab"), (1, 5, 6, "c")]


def test_touching_edges_intersect_only_closed_rectangles(spark):
    a, b = F.expr("named_struct('x0', 0.0D, 'y0', 0.0D, 'x1', 1.0D, 'y1', 1.0D)"), F.expr("named_struct('x0', 1.0D, 'y0', 0.0D, 'x1', 2.0D, 'y1', 1.0D)")
    assert one(spark, G.touches(a, b)) and not one(spark, G.overlaps(a, b)) and one(spark, G.iou(a, b)) == 0.0 and one(spark, G.iou(a, a)) == 1.0


def test_colors(spark):
    assert one(spark, G.color_hex(F.lit(0x1FF8000))) == "#ff8000"
    assert tuple(one(spark, G.hex_channels(F.lit("#FF0000")))) == (1.0, 0.0, 0.0)
    assert tuple(one(spark, G.hex_channels(F.lit("#F00")))) == (1.0, 1.0, 1.0)


def test_similarity_keeps_the_order_of_its_arguments():
    assert U.ratio(" Exact ", "exact") == 1.0 and U.ratio(None, "") == 1.0


def test_scripts():
    assert U.script_of("ж") == "CYRILLIC" and U.script_of("中") == "CJK" and U.script_of("5") is None


def test_hmac(spark):
    import hashlib
    import hmac

    assert one(spark, U.hmac_sha256(F.lit("k"), F.lit("m"))) == hmac.new(b"k", b"m", hashlib.sha256).hexdigest()
