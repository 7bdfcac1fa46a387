"""Exact deduplication as a stateful stream with disk-backed keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.llm.located import place, stored
from pagewell.operators.joins import fits_broadcast
from pagewell.session import scratch_path, stage

_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A store would else reserve megabytes on disk however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# Files per micro-batch; the state per partition grows with distinct texts, never with a batch.
FILES_PER_BATCH = 10_000
# Repeated digests that are sent to every task, about 20 MB; more are joined by shuffle.
SENT_DIGESTS = 100_000


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier, text and content locator: the file and the row in it."""
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), place().alias("at")
    )


def digest_state(stream: DataFrame) -> DataFrame:
    """State per digest of a stream of ``(id, text, at)``: how often it came, and who stays where.

    Of equal digests the row with the largest id stays, of equal ids the one located last. The
    state has no watermark and never expires; it holds a digest, an id and a locator, no text.
    """
    rows = stream.select(_digest(F.col("text")).alias("digest"), F.struct("id", "at").alias("who"))
    return rows.groupBy("digest").agg(F.max("who").alias("keeper"), F.count(F.lit(1)).alias("n"))


def run_digest_state(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain the stream into versions below ``path`` and return the newest state of each digest.

    A repeated micro-batch replaces its own version. State lives in RocksDB; a restart from
    ``checkpoint`` goes on where the last committed batch ended.
    """
    spark = stream.sparkSession
    before = {key: spark.conf.get(key, None) for key in _STATE_SETTINGS}
    for key, value in _STATE_SETTINGS.items():
        spark.conf.set(key, value)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    try:
        query = (
            digest_state(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(keep)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    versions = spark.read.option("basePath", path).parquet(f"{path}/version=*")
    return versions.groupBy("digest").agg(F.max_by(F.struct("keeper", "n"), "version").alias("s")).select("digest", "s.*")


def exact_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """One row per row of ``docs`` with the id that stays in its group of equal texts.

    Columns: ``<id_col>, keep_id, group_size, kept, text_sha256`` and the locator ``at``. Null texts
    count as empty. Exactly one row of a group is kept, also where ids are repeated or null (null
    is the smallest id). ``docs`` runs through the stream above; rows whose digest came more than
    once are then compared byte by byte with the text that the keeper's locator leads to, and rows
    that differ from it (a digest collision) are grouped by their whole texts. An empty table
    gives no rows; other columns of any name are ignored.
    """
    docs, path = stored(docs)
    located = _located(docs, id_col, text_col)
    rows = located.select("id", "at", _digest(F.col("text")).alias("digest"))
    if not docs.inputFiles() or docs.isEmpty():
        return rows.limit(0).select(
            F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"), "at",
        )
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    root = scratch_path(spark, "exact_dedup")
    state = run_digest_state(_located(stream, id_col, text_col), f"{root}/state", f"{root}/checkpoint")
    state = stage(state, "digest_state")

    # Full bytes of every hit against those of its keeper, fetched by locator. While the repeated
    # digests are few enough to be sent to the tasks, only the texts of hits are moved.
    repeated = state.where("n > 1").select("digest", F.col("keeper.at").alias("at"))
    few = fits_broadcast(repeated, SENT_DIGESTS)
    sent = F.broadcast if few else (lambda side: side)
    keeper_text = located.join(sent(repeated), "at").select("digest", F.col("text").alias("keeper_text"))
    hits = located.select("id", "at", "text", _digest(F.col("text")).alias("digest"))
    hits = hits.join(sent(repeated.select("digest")), "digest", "left_semi")
    # Nothing is grouped above this join, so that a hot digest can be split over tasks.
    unequal = stage(hits.join(keeper_text, "digest").where("text <> keeper_text").select("digest"), "collisions")
    differs = unequal.distinct()
    found = rows.join(state, "digest")
    if not differs.isEmpty():
        apart = hits.join(differs, "digest")
        by_text = apart.groupBy("text").agg(
            F.max(F.struct("id", "at")).alias("keeper"), F.count(F.lit(1)).alias("n")
        )
        again = apart.join(by_text, "text").select("digest", "id", "at", "keeper", "n")
        found = found.join(differs, "digest", "left_anti").select("digest", "id", "at", "keeper", "n").unionByName(again)
    return found.select(
        F.col("id").alias(id_col),
        F.col("keeper.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("keeper.at")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "at",
    )
