"""Writers for documents, pages, files and hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewell.sources.store import KeyedStore


def sink_documents(
    rows: DataFrame,
    path: str,
    order_by: str,
    key: tuple[str, ...] = ("job_id", "url_md5"),
    version: int | None = None,
) -> int:
    """Replace the stored rows of the keys in ``rows`` and keep all others; returns the version written.

    A write adds its own keys to the folders of those keys (:class:`pagewell.sources.store.KeyedStore`), so
    its cost follows the change and not the store. Of several rows for a key the last by ``order_by`` counts. A
    given ``version`` that was written before is replaced, so a repeated write leaves one copy.
    """
    return KeyedStore(rows.sparkSession, path, key).write(rows, version, order_by=order_by)


def stored_documents(
    spark: SparkSession, path: str, key: tuple[str, ...] = ("job_id", "url_md5"), keys: DataFrame | None = None
) -> DataFrame:
    """Stored rows, the newest of each key; those of the given ``keys`` are read from their folders alone."""
    return KeyedStore(spark, path, key).rows(keys)


def compact_documents(spark: SparkSession, path: str, key: tuple[str, ...] = ("job_id", "url_md5")) -> int:
    """Write the stored rows as one version, from which reads then start."""
    return KeyedStore(spark, path, key).compact()


def sink_files(rows: DataFrame, path: str, order_by: str) -> int:
    """Store file bodies ``job_id, url_md5, ext, body``; the last body per key is kept."""
    return sink_documents(rows, path, order_by, ("job_id", "url_md5", "ext"))


def sink_hits(hits: DataFrame, path: str) -> None:
    """Write ranked hits as a parquet table."""
    hits.write.mode("overwrite").parquet(path)
