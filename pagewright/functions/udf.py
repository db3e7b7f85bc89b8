"""Vectorised Python functions for what no built-in expresses."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from difflib import SequenceMatcher
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=100_000)
def ratio(a: str | None, b: str | None) -> float:
    """Similarity of two texts without case and outer white space; the order of the texts matters."""
    return SequenceMatcher(None, (a or "").strip().lower(), (b or "").strip().lower()).ratio()


def at_least(a: str, b: str, bound: float) -> bool:
    """Whether ``ratio`` reaches the bound; cheaper upper bounds come first."""
    m = SequenceMatcher(None, a.strip().lower(), b.strip().lower())
    return m.real_quick_ratio() >= bound and m.quick_ratio() >= bound and ratio(a, b) >= bound


@lru_cache(maxsize=100_000)
def exact_ratio(a: str, b: str) -> float:
    """Similarity of two texts as they are."""
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@cache
def script_of(ch: str) -> str | None:
    """First word of a character's Unicode name; None for spaces, digits and what can't be printed."""
    if not ch.isprintable() or ch.isspace() or ch.isdigit():
        return None
    return unicodedata.name(ch, "").split(" ")[0] or None


@F.pandas_udf(T.ArrayType(T.StringType()))
def scripts_of(signs: pd.Series) -> pd.Series:
    """The script of each of the signs, or nothing."""
    return signs.map(lambda x: None if x is None else [script_of(ch) for ch in x])


def scripts_by_frequency(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, scripts): the scripts of each text, most frequent first; of equal ones the one that stands first.

    Signs are counted where the text lies; Python names the script of each different sign only.
    """
    signs = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda x: x != "")
    rows = texts.select(key, signs.alias("signs"), F.array_distinct(signs).alias("kinds")).withColumn("scripts", scripts_of("kinds"))
    # (sign count, first place) by sign, then by script; arrays of a text's different signs.
    each = F.transform("kinds", lambda c, i: F.struct(F.get("scripts", i).alias("script"), F.size(F.filter("signs", lambda x: x == c)).alias("n"), F.array_position("signs", c).alias("at")))
    named = rows.select(key, F.filter(each, lambda x: x["script"].isNotNull()).alias("each"))
    flat = named.select(key, F.explode_outer("each").alias("e")).groupBy(key, "e.script").agg(F.sum("e.n").alias("n"), F.min("e.at").alias("at"))
    order = F.array_sort(F.collect_list(F.when(F.col("script").isNotNull(), F.struct(-F.col("n"), "at", "script"))))
    return flat.groupBy(key).agg(F.transform(order, lambda x: x["script"]).alias("scripts"))


@F.pandas_udf(T.StringType())
def hmac_sha256(secret: pd.Series, message: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or m is None else hmac.new(s.encode(), m.encode(), hashlib.sha256).hexdigest() for s, m in zip(secret, message, strict=True)], dtype="object")


def signed_message(method: str, path: str, query: str, timestamp: str, nonce: str, body_hash: str | None = None):
    """What a request's signature is made of: lines of method, path with its query, time, nonce and, where there is a body, its hash; column names."""
    target = F.concat(F.col(path), F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), F.col(query))).otherwise(""))
    parts = [F.upper(method), target, F.col(timestamp), F.col(nonce)]
    return F.concat_ws("\n", *parts, *([F.col(body_hash)] if body_hash else []))  # a null hash leaves its line out


def signature_holds(secret, message, signature):
    """Whether the signature is the message's, whatever its case; a missing one never is."""
    return F.coalesce(hmac_sha256(secret, message) == F.lower(signature), F.lit(False))
