"""Edits of page elements: what changed, where, and how it will look."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from itertools import groupby
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import struct

PAGE = ["doc_id", "page_no"]
STYLE_KEYS = ("fontFamily", "fontSize", "color", "bold", "italic", "underline", "strikethrough", "background")
FLAGS = ("bold", "italic", "underline", "strikethrough")


def dirty() -> Column:
    """Whether an element must be redrawn: other text, any style override, a true flag or a background."""
    text = F.coalesce("text", F.lit("")) != F.coalesce("original_text", F.lit(""))
    style = F.lit(False)
    for k in STYLE_KEYS:
        style = style | F.col(f"style.{k}").isNotNull()
    flags = F.lit(False)
    for k in FLAGS:
        flags = flags | F.coalesce(k, F.lit(False))
    ground = F.coalesce(F.lower("bg_color"), F.lit(""))
    return text | F.coalesce(style, F.lit(False)) | flags | ~ground.isin("", "transparent", "none", "#ffffff")


def effective_style() -> list[Column]:
    """A style override, else the element's own value; ``original`` stands for the element's."""

    def pick(key: str, own: Column) -> Column:
        over = F.col(f"style.{key}")
        return F.coalesce(F.when(over.cast("string") != "original", over), own)

    ground = F.col("style.background")
    parsed = F.when(ground.startswith("{"), F.when(F.get_json_object(ground, "$.enabled") == "true", F.get_json_object(ground, "$.color"))).otherwise(ground)
    return [
        pick("fontFamily", F.col("font")).alias("font_family"), pick("fontSize", F.col("size")).alias("font_size"), pick("color", F.col("text_color")).alias("color"),
        *[F.coalesce(F.col(f"style.{k}"), F.col(k), F.lit(False)).alias(f"is_{k}") for k in FLAGS], F.coalesce(parsed, F.col("bg_color")).alias("ground"),
    ]


Word = tuple[int, int, str]
Block = tuple[str, int, int, int, int]


def _words(text: str) -> list[Word]:
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text)]


def _blocks(x: list[Word], y: list[Word]) -> list[Block]:
    """(operation, words from, to, other words from, to) of what differs: by place where both have as many words, else aligned."""
    a, b = [w[2] for w in x], [w[2] for w in y]
    if a and len(a) == len(b):
        runs = [list(run) for differs, run in groupby(range(len(a)), lambda i: a[i] != b[i]) if differs]
        return [("replace", run[0], run[-1] + 1, run[0], run[-1] + 1) for run in runs]
    return [block for block in SequenceMatcher(None, a, b).get_opcodes() if block[0] != "equal"]


def _extent(words: list[Word], first: int, past: int) -> tuple[int, int]:
    """Characters of words ``first`` to ``past``; nothing lies at the next word or behind the last.

    Of no words before the first one the end is that of the word before, which may lie left of the start.
    """
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    at = (starts + ends[-1:] + [0])[first] if first <= len(words) else 0
    return at, ends[past - 1] if 0 < past <= len(words) else at


def _other_tail(word: str, other: str) -> int:
    """Where the words' unlike tails begin if the tails have no sign in common and the first is not all letters and digits; else 0."""
    n = len(commonprefix((word, other)))
    a, b = word[n:], other[n:]
    return n if n and a and b and len(word) > 1 and set(a).isdisjoint(b) and not a.isalnum() else 0


def diff(original: str | None, edited: str | None) -> list[tuple[str, int, int, str, int, int, str, bool]]:
    """Word-first differences: (operation, start, end, piece, start, end, piece, punctuation only).

    Equal numbers of words are compared place by place, runs of changed words together; a single
    changed word whose tail of signs alone differs gives that tail.  Else words are aligned.
    """
    texts = (original or "", edited or "")
    sides = tuple(map(_words, texts))
    by_place = len(sides[0]) == len(sides[1])
    out = []
    for operation, *ranges in _blocks(*sides):
        tail = 0
        if by_place and ranges[1] - ranges[0] == 1:
            tail = _other_tail(sides[0][ranges[0]][2], sides[1][ranges[2]][2])
        row: list = [operation]
        for text, words, first, past in zip(texts, sides, ranges[::2], ranges[1::2], strict=True):
            start, end = _extent(words, first, past)
            row += [start + tail, end, text[start + tail : end] if past > first else ""]
        out.append((*row, tail > 0))
    return out


DIFF_SCHEMA = "operation string, original_start int, original_end int, original_substring string, edited_start int, edited_end int, replacement_substring string, sub_word_punctuation boolean"


@F.pandas_udf(T.ArrayType(struct(DIFF_SCHEMA)))
def diff_udf(original: pd.Series, edited: pd.Series) -> pd.Series:
    names = [f.split(" ")[0] for f in DIFF_SCHEMA.split(", ")]
    return pd.Series([[] if a is b is None else [dict(zip(names, d, strict=True)) for d in diff(a, b)] for a, b in zip(original, edited, strict=True)])


def diff_ops(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a difference of (original_text, text); equal texts never reach Python."""
    changed = rows.where(F.coalesce("text", F.lit("")) != F.coalesce("original_text", F.lit("")))
    ops = changed.select(*keys, F.posexplode(diff_udf("original_text", "text")).alias("op_no", "op"))
    return ops.select(*keys, "op_no", "op.*")


CHANGE = "array<struct<operation:string,original_start:int,original_end:int,original_substring:string,edited_start:int,edited_end:int,replacement_substring:string,sub_word_punctuation:boolean>>"


def changes(elements: DataFrame) -> DataFrame:
    """The dirty elements with ``changes``: their differences, or what a change of style alone applies to.

    That is the given part, at a selection within the text or at its first place; nothing where the part
    isn't there; the whole text where no part is given.  Only changed texts are compared in Python.
    """
    rows = elements.where(dirty())
    original, edited, part = (F.coalesce(c, F.lit("")) for c in ("original_text", "text", "target_substring"))
    n = F.length(original)
    chosen = F.coalesce(F.col("selection_start").between(0, n) & (F.col("selection_end") <= n), F.lit(False))
    at = F.position(part, original) - 1
    start = F.when(chosen, F.col("selection_start")).otherwise(at)
    end = F.when(chosen, F.col("selection_end")).otherwise(at + F.length(part))

    def one(start: Column, end: Column, old: Column, edited_end: Column, new: Column) -> Column:
        return F.array(F.struct(F.lit("replace"), start, end, old, start, edited_end, new, F.lit(False))).cast(CHANGE)

    style = F.when(part == "", one(F.lit(0), n, original, F.length(edited), edited)).when(at >= 0, one(start, end, part, end, part)).otherwise(F.array().cast(CHANGE))
    # Equal texts reach Python as nulls.
    differ = original != edited
    rows = rows.withColumn("changes", diff_udf(F.when(differ, original), F.when(differ, edited)).cast(CHANGE))
    return rows.withColumn("changes", F.when(F.size("changes") > 0, F.col("changes")).otherwise(style))


def spread_chars(line: str = "") -> Column:
    """The characters of a line (text, x, y, width, height, font, size; columns, or fields of a struct), spread evenly over it.

    Each has its box, its base at 85 % of the height, and the line's font and size.  For pages whose characters have no boxes.
    """
    at = {k: F.col(f"{line}.{k}" if line else k) for k in ("text", "x", "y", "width", "height", "font", "size")}
    step = at["width"] / F.greatest(F.length(at["text"]), F.lit(1))

    def char(c: Column, i: Column) -> Column:
        x0 = at["x"] + i * step
        return F.struct(c.alias("c"), x0.alias("x0"), at["y"].alias("y0"), (x0 + step).alias("x1"), (at["y"] + at["height"]).alias("y1"), (at["y"] + 0.85 * at["height"]).alias("base"), at["font"].alias("font"), at["size"].alias("size"))

    return F.transform(F.split(at["text"], ""), char)


def chars_of(lines: DataFrame) -> DataFrame:
    """Lines that hold text, with ``chars``."""
    return lines.where(F.length("text") > 0).withColumn("chars", spread_chars())


def edit_targets(elements: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One row a change of every dirty element: which characters of which line it concerns.

    ``lines`` have ``chars``, as those of ``chars_of``; without ``lines`` the elements' own originals are the lines.  A change
    is ``exact`` where its characters are found in the matched line; an insertion lies behind the character
    before it.  Else the whole element stands for it (``line_fallback``).
    """
    from .spatial import line_matches

    spread = lines is None
    if spread:
        lines = elements.select(*PAGE, F.col("element_no").alias("line_no"), F.coalesce("original_text", "text").alias("text"), "x", "y", "width", "height", "font", "size").where(F.length("text") > 0)
    own = line_matches(elements.where(dirty()), lines)
    # A matched line's characters are made for its changes only.
    named = lines.select(*PAGE, "line_no", F.struct(*[F.col(c) for c in lines.columns if c not in (*PAGE, "line_no")]).alias("line"))
    ops = changes(elements).select(*PAGE, "element_no", "x", "y", "width", "height", "font", "size", F.posexplode("changes").alias("target_no", "op"))
    ops = ops.join(own.where("line_no IS NOT NULL").join(named, [*PAGE, "line_no"]), [*PAGE, "element_no"], "left").withColumn("chars", spread_chars("line") if spread else F.col("line.chars"))
    chars, n = F.col("chars"), F.coalesce(F.size("chars"), F.lit(0))
    first, past, insert = F.col("op.original_start"), F.col("op.original_end"), F.col("op.operation") == "insert"
    found = F.col("chars").isNotNull() & (n > 0)
    inside = found & ~insert & (first >= 0) & (first < past) & (past <= n)
    mine = F.when(inside, F.slice(chars, first + 1, F.greatest(past - first, F.lit(1))))
    anchor = F.when(insert & found & (first > 0) & (first <= n), F.get(chars, first - 1)).when(insert & found & (first == 0), F.get(chars, F.lit(0)))
    behind = F.when(found & (past >= 0) & (past < n), F.get(F.filter(F.slice(chars, past + 1, F.greatest(n - past, F.lit(1))), lambda c: F.trim(F.regexp_replace(c["c"], r"\s", "")) != ""), F.lit(0)))

    def side(f: str, of, whole: Column) -> Column:
        return F.when(inside, of(F.transform(mine, lambda c: c[f]))).when(~insert, whole)

    base = F.col("y") + 0.85 * F.col("height")
    mean = F.aggregate(F.transform(mine, lambda c: c["base"]), F.lit(0.0), lambda a, b: a + b) / F.size(mine)
    exact = inside | insert & found
    lead = F.coalesce(F.get(mine, F.lit(0)), anchor)
    return ops.select(
        *PAGE, "element_no", "target_no", "op.operation", "op.original_start", "op.original_end", F.col("op.original_substring").alias("target"), F.col("op.replacement_substring").alias("replacement"),
        F.when(~exact, "line").when(insert, "insertion_point").when(F.col("op.sub_word_punctuation"), "character").otherwise("word").alias("granularity"),
        side("x0", F.array_min, F.col("x")).alias("x0"), side("y0", F.array_min, F.col("y")).alias("y0"), side("x1", F.array_max, F.col("x") + F.col("width")).alias("x1"), side("y1", F.array_max, F.col("y") + F.col("height")).alias("y1"),
        F.coalesce(mean, anchor["base"], base).alias("baseline"), F.when(insert, F.coalesce(F.when(first > 0, anchor["x1"]).otherwise(anchor["x0"]), F.col("x"))).alias("insertion_x"),
        F.when(exact, behind["x0"]).alias("neighbour_x"), F.coalesce(lead["font"], F.col("font")).alias("font"), F.coalesce(lead["size"], F.col("size")).alias("size"),
        F.when(inside, F.size(mine)).when(exact, 0).otherwise(F.length("op.original_substring")).alias("n_chars"), F.when(exact, "exact").otherwise("line_fallback").alias("confidence"),
    )


def available_width(neighbour: Column, x: Column, box_width: Column, page_width: Column) -> Column:
    """Room for a replacement: up to the next word, or to the page's edge."""
    return F.when(neighbour.isNotNull(), F.greatest(F.lit(0.0), neighbour - x - 2)).when(box_width.isNotNull(), F.greatest(box_width, page_width - x - 20)).otherwise(F.greatest(box_width, F.lit(100.0)))


def fitted_size(size: Column, text_width: Column, room: Column, neighbour: Column) -> Column:
    """The size scaled down to the room if 70 % suffice; else it stays and overlaps."""
    r = room / text_width
    return F.when(neighbour.isNotNull() & (text_width > room) & (r >= 0.70), F.round(size * r, 6)).otherwise(size)
