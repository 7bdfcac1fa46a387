"""Rows of a stored table by file and position, which tells them apart whatever their ids are."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.session import stage


def place() -> Column:
    """File and row of a plain scan's row."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _is_bare(docs: DataFrame) -> bool:
    """Whether ``docs`` is a scan of one folder or file as it lies there, with nothing above the scan."""
    plan = docs._jdf.queryExecution().analyzed()
    # Filters, projections, limits and samples resolve _metadata too, so the plan itself is asked.
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return False
    scan = plan.relation()
    if scan.getClass().getSimpleName() != "HadoopFsRelation" or not scan.partitionSchema().isEmpty():
        return False
    roots = scan.location().rootPaths()
    # Patterns and time limits are options; "path" alone leaves no file of the folder out.
    if roots.size() != 1 or scan.options().keySet().mkString("/").lower() != "path":
        return False
    now = docs.sparkSession.read.schema(docs.schema).parquet(roots.head().toString())
    return sorted(docs.inputFiles()) == sorted(now.inputFiles())


def stored(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a plain scan of one folder or file, and that path; written first if it is no such scan.

    The path holds the rows of ``docs`` and no others, so that a stream of it reads the same table.
    """
    try:
        docs.select("_metadata.row_index").schema  # noqa: B018 - only a file scan has the column
        files = docs.inputFiles() if _is_bare(docs) else []
    except AnalysisException:
        files = []
    folders = {posixpath.dirname(f) for f in files}
    if len(files) == 1:
        # A stream takes a single file only as a pattern.
        name = unquote(files[0])
        return docs, f"{name[:-1]}[{name[-1]}]"
    if len(folders) == 1:
        return docs, unquote(folders.pop())
    written = stage(docs, "dedup_input")
    return written, unquote(posixpath.dirname((written.inputFiles() or [""])[0]))
