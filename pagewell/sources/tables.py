"""Readers: page, document and fetch-log tables, loose files, and file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH_SCHEMA = (
    "url string, final_url string, status int, content_type string, body binary, "
    "error_type string, error_message string, fetched_at double"
)


SPREAD_BELOW_BYTES = 1 << 30


def spread_small(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table to all cores; a table of a gigabyte or more is left as it is.

    A small parquet file is often one row group, hence one task, while the text work on its
    rows is heavy. Large tables have row groups enough and are never shuffled for this.
    """
    size = plan_bytes(df)
    if size is None:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SPREAD_BELOW_BYTES else df


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes that the plan expects, those of the files where it reads whole columns; a remote session does not show its plans."""
    plan = getattr(df, "_jdf", None)
    return None if plan is None else int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


TASK_BYTES = 256 << 20
TASKS_PER_CORE = 8


def few_tasks(df: DataFrame) -> DataFrame:
    """Files read by tasks of ``TASK_BYTES``, but by at least ``TASKS_PER_CORE`` tasks a core where there are as many."""
    size = plan_bytes(df)
    if size is None:
        return df
    return df.coalesce(max(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages ``url, html`` (and any further columns) from parquet."""
    return spark.read.parquet(path)


def scan_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages kept as loose ``<md5>.html`` files: ``url_md5, html``."""
    return scan_documents(spark, path).withColumnRenamed("text", "html")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` as ``url_md5, text``; the key is the name up to its first dot.

    Spark puts a few small files into a task, which would be as many tasks as there are pages; ``few_tasks`` joins them.
    """
    files = few_tasks(spark.read.text(path, wholetext=True))
    return files.select(
        F.substring_index(F.col("_metadata.file_name"), ".", 1).alias("url_md5"),
        F.col("value").alias("text"),
    )


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Stored non-HTML files as ``url_md5, ext, body``."""
    files = few_tasks(spark.read.format("binaryFile").load(path))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.substring_index(name, ".", 1).alias("url_md5"),
        F.substring_index(name, ".", -1).alias("ext"),
        F.col("content").alias("body"),
    )


def scan_fetch_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Fetch results with the fixed ``FETCH_SCHEMA``, as a batch table or a file stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(FETCH_SCHEMA).parquet(path)


def stream_table(
    spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
