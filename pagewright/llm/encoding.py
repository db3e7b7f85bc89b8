"""Problem 7: text that was decoded with the wrong character encoding.

1. Characters are mapped back to the bytes of a legacy code page; an automaton over the bytes'
   structure finds the maximal spans that are well-formed multibyte sequences; those spans
   only are decoded.  Repeated until nothing changes, as texts are garbled several times over; every round
   shortens the text.  Any assigned character may come out.  Those of scripts that are not in use need evidence, as
   right text holds a chance sequence now and then: two of their letters in a row, here or elsewhere in the text, or
   signs that follow no letter.
2. A single-byte page read as another leaves no multibyte structure.  For those, the same byte
   map is applied to the corpus' vocabulary: a rare word whose bytes, read in another page, give
   a word that is many times as frequent is garbled.  This runs over distinct words, by joins.
3. Replacement characters and C1 controls are damage that may be beyond repair.

Null and blank texts are no cases and stay as they are.  Symbol-font glyphs (private use), legitimate
accented words and look-alikes are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Code pages through which UTF-8 is misread, most common first.
MULTIBYTE_PAGES = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "cp1254", "cp1257")
# Single-byte pages that are mistaken for each other.
SINGLE_PAGES = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "cp1253", "mac_latin2", "mac_cyrillic", "cp1257")

#: A vocabulary word is garbled if its reading in another page is so many times as frequent.
RATIO = 3
#: Garbled words that are joined by broadcast, at most.
BROADCAST_WORDS = 100_000


@cache
def byte_map(page: str) -> dict[int, int]:
    """Code point -> byte of a page.  Undefined bytes are the C1 controls that decoders leave for them."""
    out: dict[int, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(page))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    if page in ("cp1252", "cp1254", "iso8859_15"):  # such texts mix with plain Latin-1
        for b in range(0x80, 0x100):
            out.setdefault(b, b)
    return out


@cache
def reading(page: str) -> dict[int, int]:
    """Byte -> code point."""
    return {b: c for c, b in byte_map(page).items()}


# Ranges of characters that need no evidence.
_EXPECTED = ((0xA0, 0x17F), (0x218, 0x21B), (0x300, 0x36F), (0x400, 0x45F), (0x490, 0x491), (0x200B, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2116), (0x2122, 0x2122), (0x2190, 0x2193), (0x2260, 0x2265), (0xF000, 0xF0FF), (0xFB00, 0xFB06))
# Signs that follow a letter in right text.
_FOLLOWING = frozenset("\u00a0\u00ad«»“”‘’‚„‹›–—…•·™®©°ºª¡¿")


@cache
def _kind(ch: str) -> str:
    """``plain``; the script of a rare letter; ``sign``; or nothing for what no text holds."""
    c = ord(ch)
    if 0x80 <= c < 0xA0 or any(low <= c <= high for low, high in _EXPECTED):  # C1 is an inner round's byte
        return "plain"
    category = unicodedata.category(ch)
    if category[0] == "C" and category != "Cf":
        return ""
    script = unicodedata.name(ch, " ").split(" ")[0]
    return ("han" if script in ("CJK", "HIRAGANA", "KATAKANA") else script.lower()) if category[0] in "LM" else "sign"


@cache
def _script(ch: str) -> str:
    return unicodedata.name(ch, " ").split(" ")[0] if ch.isalpha() else ""


def _doubtful(text: str, start: int, decoded: list[tuple[str, int]]) -> tuple[set[str], set[str]] | None:
    """(kinds that the span which begins at ``start`` needs evidence for, kinds that it is evidence of); None if it is chance."""
    kinds = []
    at = start
    end = start + sum(size for _, size in decoded)
    in_word = any(side.isascii() and side.isalpha() for side in (text[start - 1 : start], text[end : end + 1]))
    for ch, size in decoded:
        kind = _kind(ch)
        if kind == "plain" and _script(ch) == "LATIN" and not in_word and all(_script(c) == "CYRILLIC" for c in text[at : at + size]):
            kind = "latin"  # a word of Cyrillic letters
        kinds.append(kind)
        at += size
    ends = (decoded[0][0], text[start - 1 : start]), (decoded[-1][0], text[end : end + 1])
    if any(ord(ch) >= 0x370 and ch.isalpha() and side.isascii() and side.isalpha() for ch, side in ends):
        return None  # letters of two scripts side by side
    needs: set[str] = set()
    sure = {"latin"} if any(k == "plain" and _script(ch) == "LATIN" for k, (ch, _) in zip(kinds, decoded, strict=True)) else set()
    at = start
    for i, (ch, size) in enumerate(decoded):
        kind, lead, rest = kinds[i], text[at], text[at + 1 : at + size]
        at += size
        if kind == "plain" or ord(ch) > 0xFFFF:
            continue
        odd = [c not in _FOLLOWING and not c.isalpha() for c in rest]
        if kind != "sign" and kind in (kinds[i - 1] if i else "", kinds[i + 1] if i + 1 < len(kinds) else ""):
            sure.add(kind)
        elif size == 2 or not (all(odd) or kind == "sign" and (lead == "â" or not lead.isalpha() or any(odd))):
            needs.add(kind)
    return needs, sure


# The automaton: lead byte -> (continuations, least and greatest first continuation).
def _lead(b: int) -> tuple[int, int, int] | None:
    if 0xC2 <= b <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= b <= 0xEF:
        return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
    if 0xF0 <= b <= 0xF4:
        return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
    return None


_LEADS = {b: _lead(b) for b in range(0x80, 0x100)}


@cache
def _opening(page: str) -> re.Pattern:
    """A lead byte's character before a continuation's, which every garbled text holds."""
    table = byte_map(page)
    leads, rest = ("".join(re.escape(chr(c)) for c, b in table.items() if low <= b <= high) for low, high in ((0xC2, 0xF4), (0x80, 0xBF)))
    return re.compile(f"[{leads}][{rest}]")


def well_formed_spans(text: str, page: str) -> list[tuple[int, int, str]]:
    """Maximal stretches of well-formed multibyte sequences: (start, end, decoded)."""
    table, n, spans = byte_map(page), len(text), []
    sure: set[str] = set()
    opening = _opening(page)
    m = opening.search(text)
    while m:
        i = start = m.start()
        out: list[tuple[str, int]] = []
        while i < n:
            b = table.get(ord(text[i]))
            lead = _LEADS.get(b) if b is not None else None
            if lead is None or i + lead[0] >= n:
                break
            more, low, high = lead
            rest = [table.get(ord(c)) for c in text[i + 1 : i + 1 + more]]
            if None in rest or not low <= rest[0] <= high or not all(0x80 <= r <= 0xBF for r in rest[1:]):
                break
            ch = bytes((b, *rest)).decode("utf-8")
            if not _kind(ch):
                break
            out.append((ch, 1 + more))
            i += 1 + more
        if not out:
            i = start + 1
        elif not (_foreign(text, start - 1) or _foreign(text, i)) and (doubt := _doubtful(text, start, out)):  # in garbled text every such letter is part of a sequence
            spans.append((start, i, "".join(ch for ch, _ in out), doubt[0]))
            sure |= doubt[1]
        m = opening.search(text, i)
    return [(a, b, decoded) for a, b, decoded, needs in spans if needs <= sure]


def _foreign(text: str, at: int) -> bool:
    return 0 <= at < len(text) and ord(text[at]) > 0x7F and text[at].isalpha()


def undo_multibyte(text: str) -> str:
    """Decode the well-formed spans, in the page that explains most characters, until no page explains any."""
    while not text.isascii():
        best, gain = None, 0.0
        for page in MULTIBYTE_PAGES:
            spans = well_formed_spans(text, page)
            # A rare character counts half, so that of two pages the one of likelier characters wins.
            if (g := sum(e - s - len(d) - 0.5 * sum(_kind(c) != "plain" for c in d) for s, e, d in spans)) > gain:
                best, gain = spans, g
        if best is None:
            break
        parts, at = [], 0
        for s, e, d in best:
            parts += (text[at:s], d)
            at = e
        text = "".join(parts) + text[at:]
    return text


# Punctuation and signs that belong to readable words.
TYPOGRAPHIC = "–—“”‘’„…€"


@cache
def _pairs() -> list[tuple[str, str, frozenset[str], dict[int, int]]]:
    """(read, right, characters that have a readable counterpart, the counterparts) of each pair of pages."""
    out = []
    for read in SINGLE_PAGES:
        for right in SINGLE_PAGES:
            if read != right:
                back = reading(right)
                table = {c: back[b] for c, b in byte_map(read).items() if c >= 0x80 and (chr(back[b]).isalpha() or back[b] < 0x80 or chr(back[b]) in TYPOGRAPHIC)}
                out.append((read, right, frozenset(map(chr, table)), table))
    return out


def other_readings(word: str) -> list[tuple[str, str, str]]:
    """(read, right, other) for each pair of single-byte pages in which the word has another reading."""
    odd = {c for c in word if ord(c) >= 0x80}
    out, seen = [], {word}
    for read, right, readable, table in _pairs():
        if odd <= readable and (other := word.translate(table)) not in seen:
            seen.add(other)
            out.append((read, right, other))
    return out


def reread(text: str, read: str, right: str) -> str:
    """A text's words in another page; a word that the page can't have stays."""
    table, back = byte_map(read), reading(right)

    def word(w: str) -> str:
        if w.isascii() or not all(ord(c) < 0x80 or ord(c) in table for c in w):
            return w
        other = "".join(c if ord(c) < 0x80 else chr(back[table[ord(c)]]) for c in w)
        return other if all(c.isalpha() or ord(c) < 0x80 or c in TYPOGRAPHIC or c in "§°±µ£©®™«»º" for c in other) else w

    return " ".join(map(word, text.split(" ")))


# Signs that stand alone in right text.
SIGNS = frozenset("×÷½¼¾±µ·°§–—€£¥¢©®™«»“”„‘’‚…•→←↑↓≤≥≠№¿¡ºª")


def _testable(word: str) -> bool:
    """Signs and single Cyrillic letters stand alone, which chance takes for another page's."""
    return not (len(word) == 1 and word in SIGNS) and (len(word) > 2 or not any(0x400 <= ord(c) < 0x530 for c in word))


# What parts words: ASCII spaces and punctuation.  Digits stay, and every character beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEYOND_ASCII = r"[^\x00-\x7F]"


def odd_words(text: Column) -> Column:
    """The words that hold a character beyond ASCII, each once."""
    return F.array_distinct(F.filter(F.split(text, BETWEEN), lambda w: w.rlike(BEYOND_ASCII)))


def garbled_words(texts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, read, right) of the vocabulary's garbled words; ``texts`` has a column ``text``."""
    words = texts.where(F.col("text").rlike(BEYOND_ASCII)).select(F.explode(odd_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = cut(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, n, *r) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True) if _testable(w) for r in other_readings(w)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["word", "n", "read", "right", "other"])

    readings = words.select("word", "n").mapInArrow(run, "word string, n long, read string, right string, other string")
    found = readings.join(words.select(F.col("word").alias("other"), F.col("n").alias("others")), "other").where(F.col("others") >= F.col("n") * ratio)
    return found.groupBy("word").agg(F.max_by(F.struct("read", "right"), F.struct("others", "read", "right")).alias("pages")).select("word", "pages.read", "pages.right")


KEYS = ["doc_id", "page_no", "element_no"]


def _examined(elements: DataFrame) -> DataFrame:
    """(keys, text, restored, garbled) of the elements whose text is not ASCII, repeated rows too; ASCII text is never garbled."""
    rows = elements.select(*KEYS, "text").where(F.col("text").rlike(BEYOND_ASCII))

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed = [undo_multibyte(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fixed, pa.string())], names=[*b.schema.names, "fixed"])

    done = cut(rows.mapInArrow(undo, _schema(rows) + ", fixed string").withColumn("row", F.monotonically_increasing_id()))
    words = cut(garbled_words(done.select(F.col("fixed").alias("text"))))
    if words.count() <= BROADCAST_WORDS:
        words = F.broadcast(words)
    # Every text's garbled words; of their page pairs the most frequent counts for the text.
    each = done.where(F.col("fixed").rlike(BEYOND_ASCII)).select("row", F.explode(odd_words(F.col("fixed"))).alias("word")).join(words, "word")
    pages = each.groupBy("row", "read", "right").agg(F.count("*").alias("n")).groupBy("row").agg(F.max_by(F.struct("read", "right"), F.struct("n", "read", "right")).alias("pages"))
    out = done.join(pages, "row", "left").select(*KEYS, "text", "fixed", "pages")

    def page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, pairs = b.column("fixed").to_pylist(), b.column("pages").to_pylist()
            result = [t if p is None else undo_multibyte(reread(t, p["read"], p["right"])) for t, p in zip(texts, pairs, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(result, pa.string())], names=[*b.schema.names, "restored"])

    plain = out.where("pages IS NULL").withColumn("restored", F.col("fixed"))
    out = out.where("pages IS NOT NULL").mapInArrow(page, _schema(out) + ", restored string").unionByName(plain)
    damage = F.col("text").rlike(r"[\x{FFFD}\x{0080}-\x{0084}\x{0086}-\x{009F}]|[a-z]Ã ")
    return out.select(*KEYS, "text", "restored", F.coalesce(damage | (F.col("restored") != F.col("text")), F.lit(False)).alias("garbled"))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def restored(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, element_no, text, restored, garbled) of every element, exact duplicates once."""
    plain = elements.select(*KEYS, "text").where(F.col("text").isNull() | ~F.col("text").rlike(BEYOND_ASCII))
    return _examined(elements).unionByName(plain.select("*", F.col("text").alias("restored"), F.lit(False).alias("garbled"))).distinct()


def found(elements: DataFrame) -> DataFrame:
    """Keys of the elements that are garbled in whole or part."""
    return _examined(elements).where("garbled").select(*KEYS).distinct()
