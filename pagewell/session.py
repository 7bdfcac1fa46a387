"""Spark session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app_name: str = "pagewell", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset and pass ``spark.checkpoint.dir`` (a shared
    folder) and ``spark.sql.shuffle.partitions`` (about two to three per core).
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Rows that reach Python hold whole texts, so batches are small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder on this machine.
    """
    root = _setting(spark, "spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[sc.applicationId] = tempfile.mkdtemp(prefix="pagewell-")
    return _LOCAL_SCRATCH[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared scratch folder and return it read back.

    For results that several later steps start from: they are computed once, and a lost
    executor costs no more than the step at hand.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
