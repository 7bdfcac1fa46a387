"""Joins of a large table with one that is usually small, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.session import scratch_path

# Rows of the lookup tables are a few words and numbers: this many are about 100 MB.
BROADCAST_ROWS = 500_000
# Rows that may be held by the driver.
PIN_ROWS = 20_000
SALTS = 32


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    salt_on: list[str],
    how: str = "inner",
    max_rows: int | None = None,
) -> DataFrame:
    """Join ``big`` with a lookup side whose size is checked first.

    ``max_rows`` is a size the caller has proven for ``small``; without a proof within the
    bound its rows are counted. A side within the bound is broadcast. Beyond it both sides
    are salted, so that a key with a large share of ``big`` is spread over ``SALTS`` tasks;
    ``salt_on`` names columns of ``big`` that vary within a key.
    """
    proven = max_rows is not None and max_rows <= BROADCAST_ROWS
    if proven or fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def pin(df: DataFrame, maybe_large: bool = False) -> tuple[DataFrame, list | None]:
    """Compute a table once: kept as literal rows when it is small, written when it is large.

    A table that may well be large is written at once, so that it is not begun twice.
    """
    spark = df.sparkSession
    if not maybe_large:
        rows = df.limit(PIN_ROWS + 1).collect()
        if len(rows) <= PIN_ROWS:
            return spark.createDataFrame(rows, df.schema), rows
    path = scratch_path(spark, "pinned")
    df.write.parquet(path)
    written = spark.read.parquet(path)
    if maybe_large and written.count() <= PIN_ROWS:
        rows = written.collect()
        return spark.createDataFrame(rows, df.schema), rows
    return written, None
