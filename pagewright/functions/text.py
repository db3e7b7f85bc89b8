"""String functions of the document model, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as white space, inside a character class.
SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}"
WORD = f"[^{SPACE}]+"

# Patterns of the page model.
BULLET = r"^(?:[\x{2022}\x{25CF}\x{25CB}\x{25A0}\x{2013}\x{2014}*-]|\(cid:[0-9]+\))"
NUMBERED_ITEM = r"^(?:(?:[0-9]+|[a-zA-Z]|[ivxIVX]+)[.)]|\([0-9]+\))\s+"
NUMBERED_HEADING = r"^(?:[0-9]+(?:\.[0-9]+)*|(?:SECTION|CHAPTER)\s+[A-Z0-9]+)\.?\s+[A-Z]"
PAGE_NUMBER = r"(?i)^(?:page [0-9]+(?: of [0-9]+)?|[0-9]+/[0-9]+|[0-9]+)$"
CONTACT = r"(?i)\+?[0-9][0-9\s()-]{7,}|[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+|linkedin\.com|github\.com|https?://|www\.|[0-9]+,\s*[\p{L}\p{N}_\s]+,\s*[\p{L}\p{N}_\s]+"
METADATA = r"[\x{2022}|/,\x{2013}\x{2014}-]|\b(?:19|20)[0-9]{2}\b"
GLYPHS = [("•", "•"), ("●", "•"), ("○", "•"), ("■", "•"), ("–", "-"), ("—", "-"), ("(cid:127)", "•"), ("(cid:128)", "•"), ("(cid:133)", "…")]
WATERMARKS = ("CONFIDENTIAL", "DRAFT", "SAMPLE", "COPY", "INTERNAL USE ONLY", "VOID", "WATERMARK")
TABLE_SECTIONS = ("SUMMARY", "EDUCATION", "SKILLS", "PROJECTS", "EXPERIENCE", "WORK EXPERIENCE", "LEADERSHIP", "LANGUAGES")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(WORD), F.lit(0))


def is_upper(c: Column | str) -> Column:
    """At least one cased letter and none in lower case."""
    return (F.upper(col(c)) == col(c)) & (F.lower(col(c)) != col(c))


def glyphs(c: Column | str) -> Column:
    """Bullets, dashes and undecoded glyph ids in one form, replaced in order."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), GLYPHS, col(c))


def markdown_escape(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"([\\*_#\[\]`|])", r"\\$1")


def span_markdown(s: Column) -> Column:
    """A span as Markdown: code, else bold and italic marks; then the link."""
    t = markdown_escape(s["text"])
    bold, italic = F.coalesce(s["is_bold"], F.lit(False)), F.coalesce(s["is_italic"], F.lit(False))
    marked = (
        F.when(F.coalesce(s["is_code"], F.lit(False)), F.concat(F.lit("`"), t, F.lit("`")))
        .when(bold & italic, F.concat(F.lit("***"), t, F.lit("***")))
        .when(bold, F.concat(F.lit("**"), t, F.lit("**")))
        .when(italic, F.concat(F.lit("*"), t, F.lit("*")))
        .otherwise(t)
    )
    linked = F.coalesce(s["link_url"], F.lit("")) != ""
    return F.when(linked, F.concat(F.lit("["), marked, F.lit("]("), s["link_url"], F.lit(")"))).otherwise(marked)


def spans_markdown(spans: Column | str) -> Column:
    """Non-empty spans as Markdown, joined by spaces and stripped."""
    kept = F.filter(col(spans), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    return F.coalesce(strip(F.array_join(F.transform(kept, span_markdown), " ")), F.lit(""))


def table_markdown(headers: Column | str, rows: Column | str, alignments: Column | str) -> Column:
    """A table as GFM; rows are padded to the widest, line breaks in cells become <br>, pipes are escaped in body cells only."""
    h, r, a = F.coalesce(col(headers), F.array().cast("array<string>")), F.coalesce(col(rows), F.array().cast("array<array<string>>")), F.coalesce(col(alignments), F.array().cast("array<string>"))
    width = F.greatest(F.size(h), F.coalesce(F.array_max(F.transform(r, lambda x: F.size(x))), F.lit(0)))

    def padded(cells: Column) -> Column:
        return F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def cell(x: Column, body: bool) -> Column:
        t = F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit("<br>"))
        return F.replace(t, F.lit("|"), F.lit("\\|")) if body else t

    marks = F.transform(F.sequence(F.lit(1), width), lambda i: F.when(F.get(a, i - 1) == "center", ":---:").when(F.get(a, i - 1) == "right", "---:").otherwise(":---"))
    head = line(padded(F.transform(h, lambda x: cell(x, False))))
    body = F.transform(r, lambda x: line(padded(F.transform(x, lambda y: cell(y, True)))))
    return F.when(width > 0, F.array_join(F.concat(F.array(head, line(marks)), body), "\n")).otherwise("")


def list_markdown(items: Column | str, ordered: Column | str) -> Column:
    """Items as lines: two spaces a level, a dash or a number."""

    def item(x: Column, i: Column) -> Column:
        indent = F.repeat(F.lit("  "), F.coalesce(x["level"], F.lit(0)))
        mark = F.when(F.coalesce(col(ordered), F.lit(False)), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("- ")
        return F.concat(indent, mark, spans_markdown(x["spans"]))

    return F.array_join(F.transform(col(items), item), "\n")


def text_quality(c: Column | str) -> Column:
    """Letters + 0.2 digits + 0.05 spaces + 0.8 a word up to 40 - 1.5 a sign that is none of these; an empty text has -50."""
    t = col(c)

    def count(kind: str) -> Column:
        return F.length(F.regexp_replace(t, f"[^{kind}]", ""))

    signs = F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}{SPACE}]", ""))
    score = count(r"\p{L}") + 0.2 * count(r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2460}-\x{2468}") + 0.05 * count(SPACE) + 0.8 * F.least(F.size(words(t)), F.lit(40)) - 1.5 * signs
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(-50.0)).otherwise(F.round(score, 6))


def language_spec(c: Column | str) -> Column:
    """A client's languages: blank is eng, the names of automatic choice are auto, others split, distinct in order, joined by +."""
    low = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    parts = F.array_distinct(F.filter(F.split(F.regexp_replace(low, r"%2b|%20|[\s,+]+", " "), " "), lambda x: x != ""))
    return F.when(low == "", "eng").when(low.isin("auto", "automatic", "detect"), "auto").otherwise(F.coalesce(F.nullif(F.array_join(parts, "+"), F.lit("")), F.lit("eng")))


def token_offsets(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, start, end, word) of every word of the texts of ``rows``, which have their ``keys`` once; the end is exclusive.

    Words are taken with the blanks before them, so that their lengths add up to their ends.
    """
    parts = rows.select(*keys, F.posexplode(F.regexp_extract_all(col(text), F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))).alias("i", "part"))
    parts = parts.withColumn("word", F.regexp_replace("part", f"^[{SPACE}]+", ""))
    end = F.sum(F.length("part")).over(Window.partitionBy(*keys).orderBy("i"))
    return parts.select(*keys, (end - F.length("word")).cast("int").alias("start"), end.cast("int").alias("end"), "word")


def safe_suffix(name: Column | str, fallback: str = ".bin") -> Column:
    """The name's extension if it is allowed, else the fallback."""
    ext = F.lower(F.regexp_extract(col(name), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "txt", "json"), F.concat(F.lit("."), ext)).otherwise(fallback)


def stem(name: Column | str) -> Column:
    base = F.regexp_extract(col(name), r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def download_name(action: Column | str, name: Column | str) -> Column:
    a, s = col(action), stem(name)
    return F.when(a == "edit", F.concat(F.lit("edited_"), s, F.lit(".pdf"))).when(a == "markdown", F.concat(s, F.lit(".md"))).when(a == "ocr", F.concat(s, F.lit("_ocr.txt"))).otherwise(F.concat(a, F.lit("_"), s, F.lit(".pdf")))


def uptime_label(seconds: Column | str) -> Column:
    """Days, hours, minutes; seconds only if there is nothing else."""
    s = col(seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    parts = F.concat_ws(" ", F.when(d > 0, F.concat(d, F.lit("d"))), F.when(h > 0, F.concat(h, F.lit("h"))), F.when(m > 0, F.concat(m, F.lit("m"))))
    return F.when(parts == "", F.concat(s % 60, F.lit("s"))).otherwise(parts)


def bold_font(font: Column | str, flags: Column) -> Column:
    """Bit 2 of the flags, or a name that says so."""
    return (flags.bitwiseAND(2) != 0) | F.coalesce(F.lower(col(font)).rlike("bold|black|heavy"), F.lit(False))


def italic_font(font: Column | str, flags: Column) -> Column:
    """Bit 1 of the flags, or a name that says so."""
    return (flags.bitwiseAND(1) != 0) | F.coalesce(F.lower(col(font)).rlike("italic|oblique"), F.lit(False))


def technology(module: Column | str) -> Column:
    """The first framework whose name the module's contains."""
    low = F.lower(col(module))
    out = F.lit(None).cast("string")
    for t in ("tortoise", "sqlalchemy", "pydantic", "django", "flask", "fastapi"):
        out = F.when(low.contains(t), t).otherwise(out)
    return out


def font_variant(family: Column | str, bold: Column | str, italic: Column | str) -> Column:
    """One of twelve base fonts by family, weight and slope; a family with ``serif`` counts as Times, sans-serif too."""
    low = F.lower(F.coalesce(col(family), F.lit("")))
    b, i = F.coalesce(col(bold), F.lit(False)), F.coalesce(col(italic), F.lit(False))

    def four(plain: str, bold_: str, italic_: str, both: str) -> Column:
        return F.when(b & i, both).when(b, bold_).when(i, italic_).otherwise(plain)

    times = low.contains("times") | low.contains("serif") | low.contains("tiro")
    mono = low.contains("courier") | low.contains("mono") | low.contains("cour")
    return F.when(times, four("tiro", "tibo", "tiit", "tibi")).when(mono, four("cour", "cobo", "coit", "cobi")).otherwise(four("helv", "hebo", "heit", "hebi"))
