"""Problem 10: long exact spans that records share.

Lines and sentences (units) are normalised and hashed, and their digests are grouped globally.

* ``unit_report`` keeps the earliest ranked occurrence of each digest and marks the rest, with original
  offsets retained; ``without_repeats`` removes them.
* ``shared_spans`` gives the exact code points that lie in ``length`` code points standing in another record.
  Of equal texts, found by the digest of the whole, only the one of least doc_id goes on.  Every window
  of ``length`` code points has a mark: the digest of the longest unit that lies in it with both its bounds.  A
  window that holds no unit has a gram chosen by its hash in place of one (winnowing).  A mark
  depends on nothing outside its window, so equal windows have equal marks.  Only windows whose mark stands
  in two different texts are hashed whole, at 128 bits, and grouped once more.

No group is collected: groupings keep the least and the greatest key of a digest, which
combine before the shuffle; digests that hold a large part of all rows are joined by broadcast.  Null, empty
and shorter texts have no spans, nor have rows without a doc_id.  A text's own repetitions are no sharing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, semi_join

#: Code points from which a common stretch counts.
LENGTH = 200

#: Code points of the shortest unit that is compared.
LEAST_UNIT = 20

# What ends a unit, and the white space that goes with it.
UNIT_END = r"[\n.!?]+[ \t\r\n\f]*"
UNIT = rf"[^\n.!?]*{UNIT_END}|[^\n.!?]+"
_UNIT_END, _BLANKS = re.compile(UNIT_END), re.compile(r"[ \t\r\n\f]+")

#: Long texts are hashed in pieces of so many code points, which overlap by ``length`` - 1.
PIECE = 1 << 20

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that hashes order like random numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, n: int, inverse: bool) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept and grown as texts need."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = max(n, 4096)
        a = np.full(size, step, np.uint64)
        a[0] = 1
        have = _powers[base, inverse] = np.multiply.accumulate(a)
    return have[:n]


def gram_hashes(points: np.ndarray, k: int, base: int = _ODD[0]) -> np.ndarray:
    """Hash of every k consecutive code points."""
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        terms = _mix(points.astype(np.uint64) + np.uint64(base)) * _power(base, n, False)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        return _mix((sums[k:] - sums[:-k]) * _power(base, n - k + 1, True))


def selected(points: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``length`` code points the place of its selected gram, and the grams' hashes."""
    k = length - length // 2
    h = gram_hashes(points, k)
    w = length - k + 1
    view = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.arange(len(view)) + (w - 1 - view.argmin(axis=1)), h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(points: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(1, len(points) - length + 1), PIECE):
        yield at, points[at : at + PIECE + length - 1]


def digest(unit: str) -> bytes:
    """128 bits of a unit without case and kinds of white space."""
    return hashlib.md5(_BLANKS.sub(" ", unit.lower()).strip(" ").encode("utf-8", "surrogatepass")).digest()


def _cuts(text: str) -> list[tuple[int, int]]:
    """(place, place of the sign that shows it) of every bound between two units."""
    return [(m.end(), m.start() + len(m[0].rstrip(" \t\r\f")) - 1) for m in _UNIT_END.finditer(text) if m.end() < len(text)]


def marks(text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's mark, and whether it is a unit's."""
    points = _points(text)
    mark, by_unit = np.zeros(len(points) - length + 1, np.uint64), np.zeros(len(points) - length + 1, bool)
    cuts = _cuts(text)
    units = []
    for (start, shown), (end, _) in zip(cuts, cuts[1:], strict=False):
        if LEAST_UNIT <= end - start and end - shown < length:
            units.append((end - start, int.from_bytes(digest(text[start:end])[:8], "little"), shown, end))
    for _, m, shown, end in sorted(units):  # the longest is written last
        first = max(0, end + 1 - length)
        mark[first : shown + 1], by_unit[first : shown + 1] = m, True
    gaps = np.flatnonzero(np.diff(np.concatenate(([True], by_unit, [True])).astype(np.int8)))
    for a, b in zip(gaps[::2], gaps[1::2], strict=True):
        for at, piece in _pieces(points[a : b + length - 1], length):
            place, h = selected(piece, length)
            mark[a + at : a + at + len(place)] = h[place]
    return mark, by_unit


def _marks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, out = [], [], []
            for doc, key, text in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = np.unique(marks(text, length)[0])
                out.append(own.view(np.int64))
                ids.append(np.full(len(own), doc, np.int64))
                keys.append(np.full(len(own), key, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, out)], names=["doc_id", "key", "mark"])

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, shared in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("marks").to_pylist(), strict=True):
                use = np.flatnonzero(np.isin(marks(text, length)[0], np.array(shared, np.int64).view(np.uint64)))
                if not len(use):
                    continue
                points = _points(text)
                one, two = (gram_hashes(points, length, base)[use].view(np.int64) for base in _ODD)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), doc, np.int64)), pa.array(use.astype(np.int32)), pa.array(one), pa.array(two)], names=["doc_id", "start", "h1", "h2"])

    return run


def _copies(long: DataFrame) -> DataFrame:
    """(doc_id, first, n_chars) of the records whose whole text stands in another; ``first`` has the least doc_id."""
    rows = long.select("doc_id", F.unhex(F.md5("text")).alias("whole"), F.length("text").alias("n_chars"))
    groups = cut(rows.groupBy("whole").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.max("doc_id").alias("last")).where("least <> last").drop("last"))
    rows = semi_join(rows, groups, ["whole"], ["least"])
    return rows.select("doc_id", (F.col("doc_id") == F.col("least")).alias("first"), "n_chars").distinct()


def shared_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, span_start, span_end): maximal runs of code points shared with another doc_id."""
    long = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.length("text") >= length) & F.col("doc_id").isNotNull())
    copies = cut(_copies(long))
    found = cut(long.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_marks(length), "doc_id long, key long, mark long"))
    common = cut(found.groupBy("mark").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("n")).where("a <> b").select("mark", "n"))
    # The marks of one text are bounded by its length, so this list is no group of texts.
    per_doc = semi_join(found.select("doc_id", "mark"), common, ["mark"]).groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    per_doc = per_doc.join(copies.where("NOT first").select("doc_id"), "doc_id", "left_anti")
    windows = cut(long.join(per_doc, "doc_id").mapInArrow(_windows(length), "doc_id long, start int, h1 long, h2 long"))
    twice = cut(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a <> b").select("h1", "h2", "n"))
    starts = semi_join(windows, twice, ["h1", "h2"]).select("doc_id", "start").join(copies.select("doc_id"), "doc_id", "left_anti")
    w = Window.partitionBy("doc_id").orderBy("start")
    runs = starts.withColumn("opens", F.coalesce(F.col("start") - F.lag("start").over(w) > length, F.lit(True)))
    runs = runs.withColumn("run", F.sum(F.col("opens").cast("int")).over(w))
    parts = runs.groupBy("doc_id", "run").agg(F.min("start").alias("span_start"), (F.max("start") + F.lit(length)).cast("int").alias("span_end")).drop("run")
    return parts.unionByName(copies.select("doc_id", F.lit(0).alias("span_start"), F.col("n_chars").alias("span_end")))


def shared_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """For every record how much of it stands elsewhere: (doc_id, n_chars, shared_chars, shared_part)."""
    spans = shared_spans(docs, length).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    n = F.coalesce(F.length("text"), F.lit(0))
    every = docs.select("doc_id", n.alias("n_chars")).join(spans, "doc_id", "left")
    shared = F.coalesce("shared_chars", F.lit(0))
    return every.select("doc_id", "n_chars", shared.cast("long").alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_part"))


def _units(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, no, start, end, digests = [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                bounds = [0, *(p for p, _ in _cuts(text)), len(text)]
                for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if y - x >= least:
                        doc.append(k)
                        no.append(i)
                        start.append(x)
                        end.append(y)
                        digests.append(digest(text[x:y]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int32()) for x in (no, start, end)), pa.array(digests, pa.binary())], names=["doc_id", "unit_no", "span_start", "span_end", "digest"]
            )

    return run


def unit_report(docs: DataFrame, least: int = LEAST_UNIT) -> DataFrame:
    """Every sentence or line of at least ``least`` code points: (doc_id, unit_no, span_start, span_end, kept).

    Units are compared lower-cased, with white space squeezed; of equal ones the earliest by
    (doc_id, offset) is kept.
    """
    texts = docs.where(F.length("text") > 0).select("doc_id", "text")
    rows = cut(texts.mapInArrow(_units(least), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, unit_no int, span_start int, span_end int, digest binary"))
    groups = cut(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "span_start")).alias("first"), F.count("*").alias("n")))
    again = semi_join(rows, groups.where("n > 1"), ["digest"], ["first"]).withColumn("kept", F.struct("doc_id", "span_start") == F.col("first"))
    once = semi_join(rows, groups.where("n = 1"), ["digest"]).withColumn("kept", F.lit(True))
    return once.select("doc_id", "unit_no", "span_start", "span_end", "kept").unionByName(again.select("doc_id", "unit_no", "span_start", "span_end", "kept"))


def without_repeats(docs: DataFrame, least: int = LEAST_UNIT) -> DataFrame:
    """(doc_id, text, removed array<struct<span_start, span_end>>): repeated units are gone, ``removed`` has their original places.

    A null text stays null; a text of repeats only becomes empty.
    """
    gone = unit_report(docs, least).where("NOT kept").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias("removed"))  # bounded by a record's text
    rows = docs.select("doc_id", "text").join(gone, "doc_id", "left")
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r: r["span_end"]))
    ends = F.concat(F.transform("removed", lambda r: r["span_start"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    none = F.array().cast("array<struct<span_start:int,span_end:int>>")
    return rows.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce("removed", none).alias("removed"))
