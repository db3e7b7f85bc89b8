"""Problem 3: the language of documents and of their text spans, with a confidence.

Nearest-centroid classification.  Vectors are normalised TF-IDF weights of hashed character
n-grams (1 to 4, with word boundaries).  Each language has several centroids, from spherical
k-means over its own training rows.  A text goes to the centroid of the highest cosine; it is
rejected (null) when that lies below a distance bound learnt from the training rows.

Training rows are a bounded sample of labelled ``documents``: at most ``TRAIN_ROWS`` different texts a language,
of 60 characters and more, whole, the ones of least hash.  Labels are partly wrong, so the training is repeated after rows nearer to another
language's centroids have been set aside.  All spans of all documents are classified.

Empty texts and texts without letters have no language.  Job labels are read as any case,
separated by blanks, commas, ``+``, ``%2b`` or ``%20``; a null or blank label names no language.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import span_text
from .lookalike import CYRILLIC_TWINS, GREEK_TWINS

#: Different labelled texts a language in the training sample, at most.
TRAIN_ROWS = 500
BUCKETS = 1 << 13
CENTROIDS = 6
#: Spans of fewer letters get no verdict in the found query.
LEAST_LETTERS = 40
#: Length of the pieces in which a span is searched for a second language.
SEGMENT = re.compile(r"[^.!?\n]+[.!?\n]*\s*")


_TWINS = str.maketrans(CYRILLIC_TWINS | GREEK_TWINS)
_UNSEEN = re.compile("[\u00ad\u034f\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_SURE_LATIN = re.compile("[bdfghklmnqrtuvwz]", re.I)
_SURE_CYRILLIC = re.compile("[бгджзийклмнптфцчшщъыьэюя]", re.I)


def folded(text: str) -> str:
    """Lower case without disguises: width, invisible signs, look-alikes of another script."""
    if text.isascii():
        return text.lower()
    text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    if re.search("[\u0370-\u052f]", text) and len(_SURE_LATIN.findall(text)) > len(_SURE_CYRILLIC.findall(text)):
        text = text.translate(_TWINS)
    return text.lower()


class Grams:
    """Hashed n-gram counts.  A gram's bucket is remembered, as texts repeat their grams."""

    def __init__(self) -> None:
        self.bucket: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        """Buckets of one word's grams; the word carries its boundaries."""
        if (known := self.bucket.get(w)) is None:
            known = [zlib.crc32(w[i : i + n].encode("utf-8", "replace")) % BUCKETS for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
            if len(self.bucket) < 200_000:
                self.bucket[w] = known
        return known

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts as (row, bucket, count)."""
        rows, cols = [], []
        for i, t in enumerate(texts):
            own: list[int] = []
            for w in re.findall(r"[^\W\d_]+", folded(t)):
                own += self.word(f" {w} ")
            rows.append(np.full(len(own), i, np.int64))
            cols.append(np.array(own, np.int64))
        if not rows:
            return (np.empty(0, np.int64),) * 3
        key, n = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(cols), return_counts=True)
        return key // BUCKETS, key % BUCKETS, n


def _weights(rows: np.ndarray, cols: np.ndarray, n: np.ndarray, idf: np.ndarray, size: int) -> np.ndarray:
    w = (1 + np.log(n)) * idf[cols]
    norm = np.sqrt(np.bincount(rows, w * w, size))
    return (w / np.maximum(norm[rows], 1e-12)).astype(np.float32)


class Centroids:
    """The trained model: a few megabytes, whatever the corpus' size."""

    def __init__(self, idf: np.ndarray, centres: np.ndarray, langs: list[str], bound: float) -> None:
        self.idf, self.centres, self.langs, self.bound = idf, centres, langs, bound
        self.names = sorted(set(langs))
        self.of = np.array([self.names.index(x) for x in langs])
        self.grams: Grams | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"grams": None}

    def scores(self, texts: list[str]) -> np.ndarray:
        """Highest cosine to each language's centroids, one row a text."""
        self.grams = self.grams or Grams()
        rows, cols, n = self.grams.rows(texts)
        best = np.zeros((len(texts), len(self.names)), np.float32)
        if len(rows):
            w = _weights(rows, cols, n, self.idf, len(texts))
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            cos = np.add.reduceat(self.centres[cols] * w[:, None], starts, axis=0)
            for k in range(len(self.names)):
                best[rows[starts], k] = cos[:, self.of == k].max(axis=1)
        return best

    def verdict(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of each text.  The confidence is the winner's lead over the runner-up in odds."""
        out: list[tuple[str | None, float]] = []
        if not self.names:
            return [(None, 0.0)] * len(texts)
        for at in range(0, len(texts), 256):
            s = self.scores(texts[at : at + 256])
            first = s.argmax(axis=1)
            e = np.exp(25.0 * (s - s.max(axis=1, keepdims=True)))
            p = e[np.arange(len(s)), first] / e.sum(axis=1)
            out += [(self.names[k], round(float(q), 4)) if s[i, k] >= self.bound else (None, 0.0) for i, (k, q) in enumerate(zip(first, p, strict=True))]
        return out


def _kmeans(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means with farthest-first seeds."""
    centres = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[np.max(x @ np.array(centres).T, axis=1).argmin()])
    c = np.array(centres)
    for _ in range(steps):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(rows: list[tuple[str, str]], rounds: int = 3) -> Centroids:
    """Train on (text, label); without rows nothing is ever classified."""
    if not rows:
        return Centroids(np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, 0), np.float32), [], np.inf)
    texts, labels = [t for t, _ in rows], np.array([x for _, x in rows])
    r, c, n = Grams().rows(texts)
    df = np.bincount(c, minlength=BUCKETS)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    idf[df == 0] = 0
    x = np.zeros((len(texts), BUCKETS), np.float32)
    x[r, c] = _weights(r, c, n, idf, len(texts))
    keep = np.ones(len(texts), bool)
    names = sorted(set(labels))
    for turn in range(rounds):
        parts = [(a, _kmeans(x[keep & (labels == a)], 1 if turn == 0 else CENTROIDS)) for a in names if (keep & (labels == a)).any()]
        centres, of = np.concatenate([p for _, p in parts]), np.concatenate([[a] * len(p) for a, p in parts])
        cos = x @ centres.T
        keep = of[cos.argmax(axis=1)] == labels
    own = cos.max(axis=1)[keep]
    bound = float(np.quantile(own, 0.001) * 0.5) if len(own) else 0.0
    return Centroids(idf.astype(np.float32), np.ascontiguousarray(centres.T.astype(np.float32)), list(of), bound)


def train(documents: DataFrame, codes: list[str]) -> Centroids:
    """Fit on the bounded sample of labelled documents."""
    lang = F.lower(F.trim("lang"))
    rows = documents.where(lang.isin(codes) & (F.length("text") >= 60)).select(lang.alias("lang"), "text", F.xxhash64("text").alias("h"))
    if not codes:
        return fit([])
    # Equal texts count once; only their hashes are exchanged, and each partition sends on its least.
    least = Window.partitionBy("lang").orderBy("h")
    sample = rows.select("lang", "h").distinct().withColumn("place", F.row_number().over(least)).where(F.col("place") <= TRAIN_ROWS).select("lang", "h")
    chosen = rows.join(F.broadcast(sample), ["lang", "h"]).dropDuplicates(["lang", "text"])  # bounded by TRAIN_ROWS
    return fit([(r.text, r.lang) for r in sorted(chosen.collect(), key=lambda r: (r.lang, r.h, r.text))])


def label_codes(col: Column) -> Column:
    """The codes that a client's label names."""
    spaced = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"%2b|%20|[\s,+]", " ")
    return F.array_distinct(F.filter(F.split(spaced, " "), lambda x: x != ""))


def letters(col: Column) -> Column:
    return F.length(F.regexp_replace(col, r"[^\p{L}]", ""))


def classified(df: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """``df`` with its text column replaced by ``lang`` and ``confidence``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x centroids
    keep = [c for c in df.columns if c not in (text, "lang", "confidence")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", lang string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.verdict([t or "" for t in b.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], names=[*keep, "lang", "confidence"])

    return df.select(*keep, text).mapInArrow(run, schema)


def _codes(lang_codes: DataFrame) -> list[str]:
    return sorted(r.code for r in lang_codes.where("code IS NOT NULL").select("code").distinct().collect())  # the languages in use, a handful


def job_labels(jobs: DataFrame) -> DataFrame:
    """(doc_id, codes) of every document with a job; redelivered rows give the latest label."""
    return jobs.groupBy("doc_id").agg(F.max_by("lang", F.struct("received_at", "job_id")).alias("label")).select("doc_id", label_codes(F.col("label")).alias("codes"))


def spans_of(nodes: DataFrame) -> DataFrame:
    """(doc_id, page_no, node_no, span_no, text) of every span, exact duplicates once."""
    rows = nodes.select("doc_id", "page_no", "node_no", F.posexplode("spans").alias("span_no", "s"))
    return rows.select("doc_id", "page_no", "node_no", "span_no", F.col("s.text").alias("text")).distinct()


def span_languages(nodes: DataFrame, jobs: DataFrame, documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """Language and confidence of every span of a document that has a job."""
    model = train(documents, _codes(lang_codes))
    spans = spans_of(nodes).join(job_labels(jobs), "doc_id").withColumn("n_letters", letters(F.coalesce("text", F.lit(""))))
    return classified(spans, model)


def mislabelled_spans(nodes: DataFrame, jobs: DataFrame, documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """Spans of enough letters whose language their job's label doesn't name."""
    model = train(documents, _codes(lang_codes))
    spans = spans_of(nodes).where(letters(F.coalesce("text", F.lit(""))) >= LEAST_LETTERS).join(job_labels(jobs), "doc_id")
    out = classified(spans, model).where("lang IS NOT NULL").where(~F.array_contains("codes", F.col("lang")))
    return out.select("doc_id", "page_no", "node_no", "span_no", "lang")


def document_languages(nodes: DataFrame, jobs: DataFrame, documents: DataFrame, lang_codes: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, n_langs, label_ok) of every document with a job, by the letters of its spans.

    Where no span has a letter, the texts of the document's elements count.  A document without
    letters in either has no language, confidence 0 and a label that is not right.
    """
    model = train(documents, _codes(lang_codes))
    labels = job_labels(jobs.where("doc_id IS NOT NULL"))
    spans = spans_of(nodes).select("doc_id", F.lit(0).alias("place"), "text")
    lines = elements.select("doc_id", "page_no", "element_no", "text").distinct().select("doc_id", F.lit(1).alias("place"), "text")
    texts = spans.unionByName(lines).withColumn("n_letters", letters(F.coalesce("text", F.lit("")))).where("n_letters > 0")
    # Documents are joined after their texts are summed up, so that a huge one is many tasks.
    each = classified(texts, model).groupBy("doc_id", "place", "lang").agg(F.sum("n_letters").alias("n"), F.sum(F.col("confidence") * F.col("n_letters")).alias("c"))
    docs = each.groupBy("doc_id", "place").agg(
        F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max_by(F.col("c"), F.struct("n", "lang")).alias("c"), F.sum("n").alias("n"), F.count("lang").alias("n_langs")
    )
    docs = docs.groupBy("doc_id").agg(F.min_by(F.struct("lang", "c", "n", "n_langs"), "place").alias("d")).select("doc_id", "d.*")
    docs = labels.join(docs, "doc_id", "left").withColumn("n_langs", F.coalesce("n_langs", F.lit(0).cast("long")))
    return docs.select("doc_id", "lang", F.when(F.col("n") > 0, F.round(F.col("c") / F.col("n"), 4)).otherwise(0.0).alias("confidence"), "n_langs", F.coalesce(F.array_contains("codes", F.col("lang")), F.lit(False)).alias("label_ok"))


def segments(nodes: DataFrame, jobs: DataFrame, documents: DataFrame, lang_codes: DataFrame) -> DataFrame:
    """Language of every sentence of the nodes: (doc_id, page_no, node_no, segment_no, lang, confidence)."""
    model = train(documents, _codes(lang_codes))
    rows = nodes.select("doc_id", "page_no", "node_no", span_text().alias("t")).distinct().join(job_labels(jobs).select("doc_id"), "doc_id")
    rows = rows.select("doc_id", "page_no", "node_no", F.posexplode(F.regexp_extract_all("t", F.lit(SEGMENT.pattern), F.lit(0))).alias("segment_no", "text"))
    return classified(rows.where(letters(F.col("text")) > 0), model)
