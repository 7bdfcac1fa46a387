"""Deciding whether a fetched text differs from the stored one.

The ratio is that of the standard library's sequence matcher on the texts without
digits, old text first. Cheap upper bounds settle most rows; the rest is matched exactly.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagewell.functions.text import strip_digits
from pagewell.session import stage

KEY = "url_md5"


def length_bound(len_a: Column, len_b: Column) -> Column:
    """Largest ratio that two texts of these lengths can reach."""
    total = len_a + len_b
    return F.when(total == 0, 1.0).otherwise(2.0 * F.least(len_a, len_b) / total)


def character_bound(a: Column, b: Column) -> Column:
    """Largest ratio that two texts with these characters, in any order, can reach."""
    shared = F.aggregate(
        F.array_distinct(F.split(a, "")),
        F.lit(0),
        lambda acc, c: acc
        + F.least(
            F.length(a) - F.length(F.replace(a, c, F.lit(""))),
            F.length(b) - F.length(F.replace(b, c, F.lit(""))),
        ),
    )
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


@F.pandas_udf(DoubleType())
def same_ratio(old: pd.Series, new: pd.Series) -> pd.Series:
    """Exact ratio; null where either text is null."""

    def one(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        return difflib.SequenceMatcher(None, a, b).ratio()

    return pd.Series([one(a, b) for a, b in zip(old, new)], dtype="float64")


def _signature(texts: DataFrame, prefix: str, *extra: str) -> DataFrame:
    bare = strip_digits(F.col("text"))
    return texts.select(
        KEY,
        *extra,
        F.lit(True).alias(f"{prefix}_found"),
        F.md5(bare).alias(f"{prefix}_md5"),
        F.length(bare).alias(f"{prefix}_len"),
    )


def change_bounds(old: DataFrame, new: DataFrame) -> DataFrame:
    """``url_md5, same_text, length_bound, character_bound`` of texts present on both sides."""
    a = old.select(KEY, strip_digits(F.col("text")).alias("a"))
    b = new.select(KEY, strip_digits(F.col("text")).alias("b"))
    return a.join(b, KEY).select(
        KEY,
        (F.md5("a") == F.md5("b")).alias("same_text"),
        length_bound(F.length("a"), F.length("b")).alias("length_bound"),
        character_bound(F.col("a"), F.col("b")).alias("character_bound"),
    )


def change_detect(
    old: DataFrame,
    new: DataFrame,
    seen: DataFrame,
    threshold: float = 0.998,
) -> DataFrame:
    """``url_md5, outcome`` of every fetch in ``new(url_md5, text, status)``.

    ``old(url_md5, text)`` are the stored texts and ``seen(url_md5)`` the URLs with visit
    state. An outcome is ``first`` (no stored text or never visited), ``unchanged`` or
    ``changed``; a fetch with status ``error`` is ``unchanged`` when its URL was visited and
    ``first`` otherwise. Only digests and lengths go through the join on all rows; whole
    texts are moved for the few rows that no bound settles.
    """
    known = seen.select(KEY, F.lit(True).alias("visited"))
    fetched = _signature(new, "new", "status")
    paired = fetched.join(_signature(old, "old"), KEY, "left").join(known, KEY, "left")
    error = F.coalesce(F.col("status") == "error", F.lit(False))
    visited = F.coalesce("visited", F.lit(False))
    too_long = length_bound(F.col("old_len"), F.col("new_len")) <= threshold
    outcome = (
        F.when(error & visited, "unchanged")
        .when(error, "first")
        .when(F.col("old_found").isNull() | ~visited, "first")
        .when(F.col("old_md5") == F.col("new_md5"), "unchanged")
        .when(too_long, "changed")
    )
    # Narrow rows, written once: both text scans below start from them.
    judged = stage(paired.select(KEY, outcome.alias("outcome")), "judged")
    open_keys = judged.filter(F.col("outcome").isNull()).select(KEY)
    a = old.join(open_keys, KEY, "left_semi").select(KEY, strip_digits(F.col("text")).alias("a"))
    b = new.join(open_keys, KEY, "left_semi").select(KEY, strip_digits(F.col("text")).alias("b"))
    bounded = a.join(b, KEY).withColumn(
        "maybe", character_bound(F.col("a"), F.col("b")) > threshold
    )
    ratio = same_ratio(F.when(F.col("maybe"), F.col("a")), F.when(F.col("maybe"), F.col("b")))
    matched = bounded.withColumn("ratio", ratio).select(
        KEY,
        F.when(F.col("maybe") & (F.col("ratio") > threshold), "unchanged")
        .otherwise("changed")
        .alias("outcome"),
    )
    return judged.filter(F.col("outcome").isNotNull()).unionByName(matched)
