"""Words, lines and confidences of OCR results, and the choice of languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.text import words as split_words

# Bundles of languages in the order they are tried, and a script's languages.
BUNDLES = (
    "eng+sin+tam eng+sin eng+tam sin+tam eng+deu+fra+spa eng+deu eng+fra eng+spa eng+ita eng+por eng+nld eng+rus eng+ara eng+hin eng+ben eng+chi_sim+chi_tra eng+chi_sim eng+chi_tra eng+jpn eng+kor"
).split()
SCRIPTS = {
    "SINHALA": "sin,eng", "TAMIL": "tam,eng", "LATIN": "eng,deu,fra,spa", "DEVANAGARI": "hin,eng", "BENGALI": "ben,eng", "CYRILLIC": "rus,eng",
    "ARABIC": "ara,eng", "HAN": "chi_sim,chi_tra,eng", "HIRAGANA": "jpn,eng", "KATAKANA": "jpn,eng", "HANGUL": "kor,eng",
}


def words_of(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, word_no, line_no, text, conf, x0, y0, x1, y1): elements' words, spread evenly over their line.

    Confidences aren't given in the tables: -1, 0 ... 99, from the key.
    """
    parts = elements.select("doc_id", "page_no", F.col("element_no").alias("line_no"), "x", "y", "width", "height", split_words("text").alias("ws")).where(F.size("ws") > 0)
    rows = parts.select("*", F.posexplode("ws").alias("i", "text"))
    step = F.col("width") / F.size("ws")
    return rows.select(
        "doc_id", "page_no", (F.col("line_no") * 1000 + F.col("i")).cast("int").alias("word_no"), "line_no", "text",
        (F.pmod((F.col("line_no") * 7 + F.col("i")) * 37 + F.col("page_no"), F.lit(101)) - 1).cast("double").alias("conf"),
        (F.col("x") + F.col("i") * step).alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("i") * step + step * 0.9).alias("x1"), (F.col("y") + F.col("height")).alias("y1"),
    )


def valid_word(text: Column, conf: Column) -> Column:
    """At least 30, no single sign, no mere punctuation."""
    return (conf >= 30) & ~((F.length(text) == 1) & text.rlike(r"^[^\p{L}\p{N}]$")) & ~text.rlike(r"""^[-_|\\/.,;:'"]+$""")


def engine_word(text: Column, conf: Column) -> Column:
    return (strip(text) != "") & (conf.cast("int") > 25)


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of the engine's words: text in word order, bounds, mean confidence from 0 to 1."""
    kept = words.where(engine_word(F.col("text"), F.col("conf")))
    rows = kept.groupBy("doc_id", "page_no", "line_no").agg(
        F.sort_array(F.collect_list(F.struct("word_no", "text"))).alias("ws"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("conf").alias("c")
    )
    return rows.select("doc_id", "page_no", "line_no", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"), *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], F.round(F.col("c") / 100, 6).alias("confidence"))


def mean_confidence(words: DataFrame) -> DataFrame:
    """Per page the mean of the confidences from 0 on, -1 without any."""
    return words.groupBy("doc_id", "page_no").agg(F.round(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(-1.0)), 6).alias("mean_conf"))


def word_tolerance(words: DataFrame) -> DataFrame:
    """Per page the median word height, 1 at least, and the tolerance of a line."""
    return words.groupBy("doc_id", "page_no").agg(F.round(F.median(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))), 6).alias("median_height")).withColumn("tolerance", F.round(F.greatest(F.lit(3.0), 0.45 * F.col("median_height")), 6))


def best_language(tries: DataFrame, confident: float = 88.0, enough: int = 40) -> DataFrame:
    """(doc_id, page_no, spec) of tries (try_no, spec, conf, quality, n_chars): the first confident and long one, else the highest by confidence, quality, fewer languages, order."""
    n = F.size(F.split("spec", r"\+"))
    stop = F.when((F.col("conf") >= confident) & (F.col("n_chars") >= enough), F.col("try_no"))
    rows = tries.withColumn("stop", F.min(stop).over(Window.partitionBy("doc_id", "page_no")))
    tried = rows.where("stop IS NULL OR try_no <= stop")
    return tried.groupBy("doc_id", "page_no").agg(F.max_by("spec", F.struct("conf", "quality", -n, -F.col("try_no"))).alias("spec"))


def languages_of_scripts(scripts: DataFrame, installed: DataFrame) -> DataFrame:
    """(id, langs) of (id, scripts): the scripts' languages in order that are installed, each once, joined by +."""
    spark = scripts.sparkSession
    table = spark.createDataFrame([(s, i, c) for s, cs in SCRIPTS.items() for i, c in enumerate(cs.split(","))], "script string, code_no int, code string")
    rows = scripts.select("id", F.posexplode("scripts").alias("script_no", "script")).join(F.broadcast(table), "script").join(installed.select("code"), "code", "left_semi")
    first = rows.groupBy("id", "code").agg(F.min(F.struct("script_no", "code_no")).alias("at"))
    return first.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "+").alias("langs"))
