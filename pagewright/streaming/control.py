"""Cancelling and following work: tags for jobs, observed counts for progress."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def tagged(spark: SparkSession, tag: str, work: Callable[[], T]) -> T:
    """Run ``work`` so that ``cancel`` with its tag, from another thread, ends its Spark jobs."""
    sc = spark.sparkContext
    sc.addJobTag(tag)
    try:
        return work()
    finally:
        sc.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[int], int]]:
    """``df`` that counts its rows on the way, and a function from the expected count to the percentage done, once an action has ended."""
    seen = Observation(name)

    def percent(total: int) -> int:
        return max(0, min(100, int(seen.get["rows"] * 100 / max(1, total))))

    return df.observe(seen, F.count(F.lit(1)).alias("rows")), percent
