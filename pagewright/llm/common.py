"""Shared plumbing of the text operators: table access, keys, checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_KEY = ["doc_id", "page_no"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_text(col: Column | str = "spans") -> Column:
    """A node's text: its spans' texts put together without a separator; null where there is no span array."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda s: F.coalesce(s["text"], F.lit(""))), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset, one machine (tests) takes a temporary folder; a cluster must name one that all executors share.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagewright-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys that are broadcast, at most: each holds more than a ``HOT_KEYS``-th of all rows.
HOT_KEYS = 10_000


def semi_join(rows: DataFrame, keys: DataFrame, on: list[str], more: list[str] | None = None) -> DataFrame:
    """``rows`` whose ``on`` stands in ``keys``, with the columns ``more`` of it.

    ``keys`` has every key once, and in ``n`` how many rows hold it.  Keys of so many rows that there can't be more
    than ``HOT_KEYS`` of them are joined by broadcast, all others by a shuffle in which no key is hot.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0  # one value
    hot, kept = F.col("n") > total / HOT_KEYS, [*on, *(more or [])]
    many, few = keys.where(hot).select(*kept), keys.where(~hot).select(*kept)
    cold = rows.join(F.broadcast(many.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(many), on).select(*rows.columns, *(more or [])).unionByName(cold.join(few, on).select(*rows.columns, *(more or [])))


def tokenizer_dir() -> str:
    """Folder of the public tokenizer files; the PAGEWRIGHT_TOKENIZERS variable names another."""
    return os.environ.get("PAGEWRIGHT_TOKENIZERS", "/opt/tokenizers")
