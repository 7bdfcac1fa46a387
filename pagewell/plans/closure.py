"""Breadth-first crawl of a stored page corpus."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagewell.config import CrawlConfig
from pagewell.functions.urls import canonical_url, url_allowed, url_key
from pagewell.operators.frontier import as_urls, frontier_take
from pagewell.operators.joins import lookup_join
from pagewell.session import scratch_path


def keyed_edges(edges: DataFrame) -> DataFrame:
    """Distinct edges with the key of their source and the key and URL of their target."""
    target = canonical_url(F.col("dst_url"))
    return (
        edges.select(
            url_key(canonical_url(F.col("src_url"))).alias("src_md5"), target.alias("url")
        )
        .filter(F.col("url") != "")
        .distinct()
        .withColumn("url_md5", url_key(F.col("url")))
    )


_ROUND = "job_id string, url_md5 string, url string, round int"


def _write_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` and return its number of rows, counted while writing."""
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return rows.get["n"]


def crawl_closure(
    edges: DataFrame, seeds: DataFrame, config: CrawlConfig, budget: int | None = None
) -> DataFrame:
    """``url_md5, url, round`` of every page reached from ``seeds(url)`` over ``edges``.

    Each round takes the whole frontier, or what is left of ``budget`` in key order, marks it
    visited and pushes the allowed, unvisited link targets. Pages that are popped but not
    allowed use up budget and are not expanded. Rounds are written to the shared scratch
    folder, so a lost executor never costs more than the round at hand; the driver reads one
    row count per round.
    """
    spark = edges.sparkSession
    base = scratch_path(spark, "closure")
    job = F.lit("closure")
    allowed = url_allowed(F.col("url"), config.allow, config.deny)
    keyed_edges(edges.filter(url_allowed(F.col("dst_url"), config.allow, config.deny))).write.parquet(
        f"{base}/edges"
    )
    links = spark.read.schema("src_md5 string, url string, url_md5 string").parquet(f"{base}/edges")
    frontier_path = f"{base}/frontier/0"
    size = _write_counted(as_urls(seeds, "url", job).withColumn("round", F.lit(0)), frontier_path)
    taken_paths: list[str] = []
    left = budget
    for number in count():
        frontier = spark.read.schema(_ROUND).parquet(frontier_path)
        if size == 0 or left == 0:
            break
        if left is None or size <= left:
            taken, rest = frontier, None
            taken_paths.append(frontier_path)
        else:
            path = f"{base}/visited/{number}"
            best = frontier_take(frontier, frontier, left)
            best.withColumn("round", F.lit(number)).write.parquet(path)
            taken = spark.read.schema(_ROUND).parquet(path)
            rest = frontier.join(taken.select("url_md5"), "url_md5", "left_anti")
            taken_paths.append(path)
        n_taken = size if left is None else min(left, size)
        left = None if left is None else left - n_taken
        visited = spark.read.schema(_ROUND).parquet(*taken_paths).select("url_md5")
        sources = taken.filter(allowed).select(F.col("url_md5").alias("src_md5"))
        found = (
            lookup_join(links, sources, ["src_md5"], ["url_md5"], max_rows=n_taken)
            .groupBy("url_md5")
            .agg(F.first("url").alias("url"))
            .join(visited, "url_md5", "left_anti")
            .select(job.alias("job_id"), "url_md5", "url")
        )
        if rest is not None:
            found = found.join(rest.select("url_md5"), "url_md5", "left_anti").unionByName(
                rest.select("job_id", "url_md5", "url")
            )
        frontier_path = f"{base}/frontier/{number + 1}"
        size = _write_counted(found.withColumn("round", F.lit(number + 1)), frontier_path)
    return spark.read.schema(_ROUND).parquet(*(taken_paths or [frontier_path])).select("url_md5", "url", "round")
