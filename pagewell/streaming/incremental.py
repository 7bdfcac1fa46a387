"""Streaming forms of the revisit state, the index increments and the frontier.

Checkpoints and tables belong in shared storage; the callers pass their paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagewell.config import CrawlConfig
from pagewell.functions.urls import canonical_url, url_key
from pagewell.operators.analysis import Analyser
from pagewell.operators.index import build_docs, index_append
from pagewell.operators.visits import revisit_interval
from pagewell.session import stage
from pagewell.sources.store import KeyedStore

_STATE = "last_time double, next_time double, interval_s double, n_visits long, n_late long"
_OUTPUT = "url_md5 string, " + _STATE


def stream_revisit_state(visits: DataFrame, config: CrawlConfig) -> DataFrame:
    """Visit state per URL, emitted whenever visits arrive (update mode).

    ``visits`` is a stream of ``url_md5, ts, id, outcome``. The rows of a micro-batch are put
    in time order; rows older than the last accepted visit are dropped and counted. The size
    of a group is bounded by the size of a micro-batch, which the source limits.
    """
    default, low, high = config.default_interval, config.min_interval, config.max_interval

    def update(
        key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last, due, interval, n_visits, n_late = state.get if state.exists else (None, None, None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for ts, outcome in zip(rows["ts"], rows["outcome"]):
            if last is not None and ts < last:
                n_late += 1
                continue
            if due is not None and ts < due:
                continue
            if interval is None:
                interval = default
            elif outcome == "changed":
                interval = max(low, interval / 2)
            else:
                interval = min(high, interval * 2)
            last, due, n_visits = float(ts), float(ts) + interval, n_visits + 1
        values = (last, due, interval, n_visits, n_late)
        state.update(values)
        columns = ["last_time", "next_time", "interval_s", "n_visits", "n_late"]
        yield pd.DataFrame([(key[0], *values)], columns=["url_md5", *columns])

    return visits.groupBy("url_md5").applyInPandasWithState(
        update, _OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout
    )


def _by_url(visits: DataFrame, path: str, columns: str, digits: int) -> KeyedStore:
    return KeyedStore(visits.sparkSession, path, ("url_md5",), digits=digits, schema=f"url_md5 string, {columns}")


def run_revisit_state(visits: DataFrame, config: CrawlConfig, path: str, checkpoint: str, digits: int = 2) -> DataFrame:
    """Drain the stream into a store at ``path`` and return the newest state per URL.

    A micro-batch adds the states it changed to the folders of their keys; a repeated one replaces its own.
    """
    store = _by_url(visits, path, _STATE, digits)

    def keep(batch: DataFrame, batch_id: int) -> None:
        store.write(batch, batch_id)

    query = (
        stream_revisit_state(visits, config)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store.rows()


def run_revisit_table(visits: DataFrame, config: CrawlConfig, path: str, checkpoint: str, digits: int = 2) -> DataFrame:
    """Visit state per URL, kept in a store and folded batch by batch with ``revisit_interval``.

    For streams in which one URL may fill a micro-batch: its visits are folded in slices, and
    late visits are never due. Each micro-batch reads the states of its URLs from their folders, as they were before it,
    and writes the states it changed; a repeated one replaces its own.
    """
    store = _by_url(visits, path, "last_time double, next_time double, interval_s double, n_visits bigint", digits)

    def fold(batch: DataFrame, batch_id: int) -> None:
        rows = stage(batch.select("url_md5", "ts", "id", "outcome"), "visits")
        touched = rows.select("url_md5").distinct()
        state = store.rows(touched, before=batch_id) if batch_id > 0 else None
        store.write(revisit_interval(rows, config, state), batch_id)

    query = (
        visits.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(fold)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store.rows()


def run_index_increment(documents: DataFrame, path: str, checkpoint: str, analyser: Analyser | None = None) -> None:
    """Append the documents of a stream ``doc_id, url, text`` to the index, a batch per trigger.

    A repeated micro-batch replaces its own folders, so it leaves one copy.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        index_append(build_docs(batch, batch_id), path, batch_id, analyser=analyser)

    query = (
        documents.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_frontier_dedup(links: DataFrame, path: str, checkpoint: str, digits: int = 2) -> DataFrame:
    """Push only never-seen targets of a stream ``dst_url``; returns the table of seen URLs, each with its micro-batch.

    What was seen lies in a store by key and not in operator state, so it may grow without bound. A micro-batch
    opens only the folders of its own keys, and sees them as they were before it.
    """
    schema = "url_md5 string, url string, batch int"
    store = KeyedStore(links.sparkSession, path, ("url_md5",), digits=digits, schema=schema)

    def push(batch: DataFrame, batch_id: int) -> None:
        canonical = canonical_url(F.col("dst_url"))
        targets = (
            batch.select(canonical.alias("url"))
            .filter(F.col("url") != "")
            .withColumn("url_md5", url_key(F.col("url")))
            .groupBy("url_md5")
            .agg(F.first("url").alias("url"))
        )
        targets = stage(targets, "targets")
        seen = store.rows(targets, before=batch_id).select("url_md5")
        store.write(targets.join(seen, "url_md5", "left_anti").withColumn("batch", F.lit(batch_id)), batch_id)

    query = (
        links.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(push)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store.rows()


def stream_frontier_dedup(links: DataFrame) -> DataFrame:
    """Never-seen targets of a bounded stream; the seen keys are operator state."""
    canonical = canonical_url(F.col("dst_url"))
    return (
        links.select(canonical.alias("url"))
        .filter(F.col("url") != "")
        .withColumn("url_md5", url_key(F.col("url")))
        .dropDuplicates(["url_md5"])
    )
