"""Streaming jobs over the given tables, cut into files that arrive one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.catalog import inputs as I
from pagewell.catalog.crawl import SQL_FOLD
from pagewell.catalog.registry import query
from pagewell.operators.frontier import extract_links, links_valid
from pagewell.operators.index import read_index
from pagewell.session import scratch_path
from pagewell.sources.tables import stream_table
from pagewell.streaming import incremental


def arriving(df: DataFrame, order: str, drain: Callable[[DataFrame], DataFrame | None], parts: int = 3) -> DataFrame | None:
    """What ``drain`` returns after the last of ``parts`` slices of ``df``, which arrive one after the other in ``order``.

    A slice is written by the tasks that hold its rows, as files beside those of the slices before, and drained as one
    micro-batch from where the checkpoint stands. Rows without an order come first.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "arrived")
    low, high = df.agg(F.min(order), F.max(order)).first()
    schema = ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
    bounds = [] if low is None else [low + (high - low) / parts * n for n in range(1, parts)]
    out = None
    for n in range(len(bounds) + 1):
        above = F.col(order) >= bounds[n - 1] if n else F.lit(True)
        below = F.coalesce(F.col(order) < bounds[n], F.lit(n == 0)) if n < len(bounds) else F.lit(True)
        df.filter(above & below).write.mode("append").parquet(path)
        out = drain(stream_table(spark, path, schema))
    return out


@query(
    "stream_revisit_state",
    f"WITH RECURSIVE {SQL_FOLD} SELECT *, CAST(0 AS BIGINT) AS n_late FROM folded",
)
def _stream_revisit_state(spark: SparkSession, folder: str) -> DataFrame:
    visits = I.visit_log(spark, folder).select("url_md5", "ts", "id", "outcome")
    path, checkpoint = scratch_path(spark, "revisit"), scratch_path(spark, "checkpoint")
    return arriving(visits, "ts", lambda s: incremental.run_revisit_state(s, I.CONFIG, path, checkpoint))


@query("stream_revisit_table", f"WITH RECURSIVE {SQL_FOLD} SELECT * FROM folded")
def _stream_revisit_table(spark: SparkSession, folder: str) -> DataFrame:
    visits = I.visit_log(spark, folder).select("url_md5", "ts", "id", "outcome")
    path, checkpoint = scratch_path(spark, "revisit"), scratch_path(spark, "checkpoint")
    return arriving(visits, "ts", lambda s: incremental.run_revisit_table(s, I.CONFIG, path, checkpoint, digits=1))


@query(
    "stream_index_increment",
    f"""WITH {I.SQL_INDEX}
    SELECT p.field, p.term, p.doc_id, p.tf, p.dl FROM postings p""",
)
def _stream_index_increment(spark: SparkSession, folder: str) -> DataFrame:
    docs = I.documents(spark, folder).select("doc_id", "url", "text")
    path, checkpoint = scratch_path(spark, "stream-index"), scratch_path(spark, "checkpoint")
    arriving(docs, "doc_id", lambda s: incremental.run_index_increment(s, path, checkpoint))
    return read_index(spark, path).postings.select("field", "term", "doc_id", "tf", "dl")


_SQL_TARGETS = f"""WITH {I.SQL_VALID_LINKS}
    SELECT DISTINCT md5(url) AS url_md5, url FROM (
      SELECT {I.sql_canonical('dst_url')} AS url FROM valid_links)"""


def page_links(pages: DataFrame) -> DataFrame:
    return links_valid(extract_links(pages), I.CONFIG)


@query("stream_frontier_dedup", _SQL_TARGETS)
def _stream_frontier_dedup(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "seen"), scratch_path(spark, "checkpoint")
    seen = arriving(
        I.pages(spark, folder), "page_id", lambda s: incremental.run_frontier_dedup(page_links(s), path, checkpoint, digits=1)
    )
    return seen.select("url_md5", "url")


@query("stream_frontier_state", _SQL_TARGETS)
def _stream_frontier_state(spark: SparkSession, folder: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, "seen"), scratch_path(spark, "checkpoint")

    def drain(pages: DataFrame) -> None:
        fresh = incremental.stream_frontier_dedup(page_links(pages))
        writer = fresh.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
        writer.trigger(availableNow=True).start().awaitTermination()

    arriving(I.pages(spark, folder), "page_id", drain)
    return spark.read.schema("url string, url_md5 string").parquet(path)
