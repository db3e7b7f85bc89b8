"""Problem 1: one consistent form for texts that a reader cannot tell apart.

Arrow partitions are handed to an embedded DuckDB, which normalises with ``nfc_normalize``,
``translate`` and regular expressions.  Two forms come out of one pass:

* ``skeleton``: every look-alike letter becomes its Latin twin, for comparing;
* ``normal``: a readable form in which look-alikes follow the script of their word.

Null gives null, the empty text the empty text.  Letter case, accents, kinds of quote, dashes,
raised or circled digits and the number of spaces are kept, as they are real differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import span_text

# Characters without any width, and soft hyphens inside a line.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
SOFT_BREAK = r"\x{00AD}([ \t]*)(\n|$)"

# Kinds of single space, kinds of hyphen.
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011, 0xFE63, 0xFF0D]

# Several letters drawn as one sign, and the sign's spelling.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "Ĳ": "IJ", "ĳ": "ij", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
}

# Cyrillic and Greek letters drawn as a Latin one, and that one.
CYRILLIC_TWINS = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜҺаеорсухѕіјһԁԛԝүЁЇёї", "ABESIJKMHOPCTYXYGQWHaeopcyxsijhdqwyËÏëï", strict=True))
GREEK_TWINS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαικνορυϲ", "ABEZHIKMNOPTYXCjaiκvopuc".replace("κ", "k"), strict=True))
OTHER_TWINS = {"ɑ": "a", "ɡ": "g", "ӏ": "l", "Ӏ": "I", "µ": "μ"}


def _width_pairs() -> dict[str, str]:
    full = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F) if c != 0xFF0D}
    signs = dict(zip("￠￡￢￤￥￦", "¢£¬¦¥₩", strict=True))
    return full | signs


def _math_pairs() -> dict[str, str]:
    """Letters and digits of the mathematical alphabets, which differ in style only."""
    import unicodedata

    out = {}
    for c in range(0x1D400, 0x1D800):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain != chr(c) and ord(plain) < 0x80:
            out[chr(c)] = plain
    return out


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _translate(expr: str, pairs: dict[str, str]) -> str:
    return f"translate({expr}, {_quote(''.join(pairs))}, {_quote(''.join(pairs.values()))})"


def _plain_sql(col: str) -> str:
    """Width, spaces, hyphens, invisible signs, ligatures and composition."""
    x = f"regexp_replace({col}, '{SOFT_BREAK}', '-\\1\\2', 'g')"
    x = f"regexp_replace({x}, '{INVISIBLE}', '', 'g')"
    x = _translate(x, _width_pairs() | {chr(c): " " for c in SPACES} | {chr(c): "-" for c in HYPHENS} | _math_pairs())
    for sign, letters in LIGATURES.items():
        x = f"replace({x}, {_quote(sign)}, {_quote(letters)})"
    return f"nfc_normalize({x})"


def _sql() -> str:
    twins = CYRILLIC_TWINS | GREEK_TWINS | OTHER_TWINS
    back = {latin: own for own, latin in CYRILLIC_TWINS.items()}
    to_latin = f"nfc_normalize({_translate('w', twins)})"
    to_cyrillic = f"nfc_normalize({_translate('w', back)})"
    only_latin = "[A-Za-zÀ-ɏ]"
    only_cyrillic = "[БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюя]"
    sure_latin = "[DFGJLNQRUVWZbdfghklmnqrtuvwzÀ-ɏ]"
    word = f"""CASE WHEN regexp_matches(w, '{only_cyrillic}') AND NOT regexp_matches(w, '{sure_latin}') THEN {to_cyrillic}
                    WHEN regexp_matches(w, '{only_latin}') THEN {to_latin}
                    WHEN latin_text AND NOT regexp_matches(w, '{only_cyrillic}') THEN {to_latin} ELSE w END"""
    return f"""
    WITH plain AS (SELECT n, {_plain_sql("t")} AS p FROM batch),
    seen AS (SELECT n, p, regexp_matches(p, '[Ͱ-ӿԀ-ԯµɑɡ]') AS foreign_letters, regexp_matches(p, '{only_latin}') AS latin_text FROM plain)
    SELECT n,
      CASE WHEN foreign_letters THEN nfc_normalize({_translate("p", twins)}) ELSE p END AS skeleton,
      CASE WHEN foreign_letters AND latin_text
           THEN array_to_string(list_transform(regexp_extract_all(p, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {word}), '')
           ELSE p END AS normal
    FROM seen ORDER BY n"""


class Normaliser:
    """An embedded DuckDB of one thread; kept for the life of a partition."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        self.sql = _sql()

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        batch = pa.table({"n": pa.array(range(len(texts)), pa.int64()), "t": texts.cast(pa.string())})
        self.con.register("batch", batch)
        out = self.con.sql(self.sql).to_arrow_table()
        self.con.unregister("batch")
        return out.column("skeleton").combine_chunks(), out.column("normal").combine_chunks()


def normalised(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``<c>_skeleton`` and ``<c>_normal`` for each text column, made inside Arrow partitions.

    Without a shuffle; other columns pass through.  A clash with an existing column of such a
    name is resolved in favour of the new one.
    """
    new = [f"{c}_{k}" for c in columns for k in ("skeleton", "normal")]
    df = df.drop(*[c for c in new if c in df.columns])
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = None
        for b in batches:
            norm = norm or Normaliser()
            arrays, names = list(b.columns), list(b.schema.names)
            for c in columns:
                for kind, a in zip(("skeleton", "normal"), norm(b.column(names.index(c))), strict=True):
                    arrays.append(a)
                    names.append(f"{c}_{kind}")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def compared(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both sides of every record that has two readings: (tbl, doc_id, page_no, item_no, a, b)."""
    e = elements.select(F.lit("elements").alias("tbl"), "doc_id", "page_no", F.col("element_no").alias("item_no"), F.col("text").alias("a"), F.col("original_text").alias("b"))
    n = nodes.select(F.lit("nodes").alias("tbl"), "doc_id", "page_no", F.col("node_no").alias("item_no"), span_text().alias("a"), F.col("raw_text").alias("b"))
    return e.unionByName(n)


def same_reading(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Records whose two readings differ in characters and yet read the same; one row per key."""
    differ = compared(elements, nodes).where("a <> b")  # null on either side is no case
    return normalised(differ, ["a", "b"]).where("a_skeleton = b_skeleton").select("tbl", "doc_id", "page_no", "item_no").distinct()


def real_edits(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Records that still differ in their consistent form."""
    differ = compared(elements, nodes).where("a <> b")
    return normalised(differ, ["a", "b"]).where("a_skeleton <> b_skeleton").select("tbl", "doc_id", "page_no", "item_no", F.col("a_normal").alias("text"), F.col("b_normal").alias("original")).distinct()


def consistent(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every record's text in its consistent form, exact duplicates once."""
    rows = compared(elements, nodes).drop("b")
    return normalised(rows, ["a"]).select("tbl", "doc_id", "page_no", "item_no", F.col("a_normal").alias("text"), F.col("a_skeleton").alias("skeleton")).distinct()
