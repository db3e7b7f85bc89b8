"""An object store in any folder that Spark reaches: objects are encrypted, and kept as rows (key, kind, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import decrypted, encrypted, object_key

# Kinds of content by extension, as files are handed out.
KINDS = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "bmp": "image/bmp", "webp": "image/webp", "txt": "text/plain", "json": "application/json", "md": "text/markdown"}


def content_kind(name: Column) -> Column:
    """The kind of content that a name's extension stands for; bytes for any other."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for k, v in KINDS.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def put(objects: DataFrame, folder: str, secret: Column, prefix: str = "objects") -> DataFrame:
    """Add objects (name, content) to the store; gives (name, key).  Keys are new for every object."""
    rows = objects.select("name", object_key(F.lit(prefix), F.col("name")).alias("key"), content_kind(F.col("name")).alias("kind"), encrypted(F.col("content"), secret).alias("content"))
    rows.write.mode("append").partitionBy("kind").parquet(folder)
    return objects.sparkSession.read.parquet(folder).select("name", "key")


def get(spark: SparkSession, folder: str, secret: Column, keys: DataFrame | None = None) -> DataFrame:
    """(key, name, kind, content) of the stored objects, or of those whose ``key`` stands in ``keys``; only theirs are decrypted."""
    rows = spark.read.parquet(folder)
    if keys is not None:
        rows = rows.join(keys.select("key"), "key", "left_semi")
    return rows.select("key", "name", "kind", decrypted(F.col("content"), secret).alias("content"))
