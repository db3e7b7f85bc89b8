"""Predicates and labels of the service around the documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUBLIC = ("/", "/health", "/health/live", "/health/ready", "/home", "/docs", "/openapi.json", "/redoc")
MAGIC = ("255044462D", "7B", "5B", "FFD8FF", "89504E470D0A1A0A", "52494646", "47494638", "49492A00", "4D4D002A")
PERMANENT = ("FileDataError", "EmptyFileError")
STATUS = {"queued": "QUEUED", "running": "PROCESSING", "succeeded": "COMPLETED", "failed": "FAILED", "cancelled": "CANCELLED", "cancel_requested": "CANCELLED"}


def public_path(path: Column) -> Column:
    trimmed = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    trimmed = F.when(trimmed == "", "/").otherwise(trimmed)
    return trimmed.isin(*PUBLIC) | trimmed.startswith("/health")


def plaintext(content: Column) -> Column:
    """Whether bytes begin as a known format does, and so aren't encrypted."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(False)
    for m in MAGIC:
        out = out | head.startswith(m)
    return out


def retryable(error: Column) -> Column:
    return ~error.isin(*PERMANENT)


def enough_disk(free: Column, size: Column) -> Column:
    return free >= 5 * size + 50 * 1024 * 1024


def expired(name: Column, age: Column, is_link: Column, shared: Column, prefixes: tuple[str, ...], ttl: int = 3600) -> Column:
    """Whether a temporary file goes: links always, old ones, in shared folders only with one of the service's ``prefixes``."""
    known = F.lit(False)
    for p in prefixes:
        known = known | name.startswith(p)
    return (~shared | known) & (is_link | (age > ttl))


def status_label(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STATUS.items():
        out = F.when(status == k, v).otherwise(out)
    return out
