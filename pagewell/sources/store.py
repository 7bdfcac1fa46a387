"""Tables of rows by key that are changed a few keys at a time."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMITS = "version bigint, seq bigint, attempt string, base boolean"


def latest_per_key(rows: DataFrame, key: list[str], order_by: str) -> DataFrame:
    """Last row per key; values travel with the maximum, so tasks pre-reduce their rows."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order_by)).alias("_r"))
    return newest.select(*key, "_r.*")


@dataclass(frozen=True)
class KeyedStore:
    """Rows by ``key`` below ``path``, in folders by the first hex digits of the column ``hashed``.

    ``digits`` is 2 for 256 folders; 3 or 4 suit stores of many terabytes. A write adds the rows that changed, and
    marks of the keys that went, to the folders of their keys, in an attempt of its own. One row in ``commits``, written last, makes the attempt part of its version; nothing
    else of an attempt is ever read, and a version written again counts in its last attempt only. Of the
    versions of a key the newest counts. A read of some keys opens only their folders.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...] = ("job_id", "url_md5")
    hashed: str = "url_md5"
    digits: int = 2
    schema: str | None = None

    def _bucket(self) -> Column:
        return F.concat(F.lit("b"), F.lower(F.coalesce(F.substring(self.hashed, 1, self.digits), F.lit(""))))

    def attempts(self, before: int | None = None) -> dict[str, int]:
        """Attempts that count, with their versions: those from the last whole rewrite on, below ``before`` if given."""
        try:
            rows = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").collect()
        except AnalysisException:
            return {}
        last = {r["version"]: r for r in sorted(rows, key=lambda r: r["seq"]) if before is None or r["version"] < before}
        base = max((v for v, r in last.items() if r["base"]), default=-1)
        return {r["attempt"]: v for v, r in last.items() if v >= base}

    def next_version(self) -> int:
        return max(self.attempts().values(), default=-1) + 1

    def write(
        self, rows: DataFrame, version: int | None = None, gone: DataFrame | None = None, order_by: str | None = None, base: bool = False
    ) -> int:
        """Add the rows as a version, and the keys in ``gone`` as marks; returns the version.

        Of several rows for a key the last by ``order_by`` counts; without it keys are unique. Both
        may be empty. ``base`` says that the rows are all there are, whatever was written before.
        """
        number = self.next_version() if version is None else version
        attempt = f"v{number}-{uuid.uuid4().hex}"
        if order_by is not None:
            rows = latest_per_key(rows, list(self.key), order_by)
        marked = rows.withColumn("gone", F.lit(False))
        if gone is not None:
            marks = gone.select(*self.key).distinct().withColumn("gone", F.lit(True))
            marked = marked.unionByName(marks, allowMissingColumns=True)
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # A folder goes to its share of the tasks, so that there are about as many files as tasks and not as both multiplied.
        salt = F.pmod(F.xxhash64(self.hashed), F.lit(max(1, math.ceil(tasks / 16**self.digits))))
        dealt = marked.withColumn("bucket", self._bucket()).withColumn("attempt", F.lit(attempt)).repartition(tasks, "bucket", salt)
        writer = dealt.sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket", "attempt").mode("append")
        # A lookup of a few keys skips the row groups that hold none of them. A filter is as large as its
        # keys need: a fixed one takes a megabyte in every file.
        writer = writer.option(f"parquet.bloom.filter.enabled#{self.hashed}", "true")
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number", "12")
        writer.parquet(f"{self.path}/rows")
        try:
            seq = self.spark.read.schema(_COMMITS).parquet(f"{self.path}/commits").count()
        except AnalysisException:
            seq = 0
        mark = self.spark.createDataFrame([(number, seq, attempt, base)], _COMMITS)
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return number

    def _folders(self, keys: DataFrame | None) -> list[str]:
        """Folders that exist and may hold rows of the keys; there are at most ``16 ** digits`` and one."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/bucket=*")
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(root) or []
        names = {f.getPath().getName() for f in found}
        if keys is not None:
            names &= {f"bucket={r[0]}" for r in keys.select(self._bucket()).distinct().collect()}
        return [f"{self.path}/rows/{n}" for n in sorted(names)]

    def rows(self, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """Stored rows, or those of the given keys, without the keys that went; as they were ``before`` a version."""
        attempts, folders = self.attempts(before), self._folders(keys)
        reader = self.spark.read
        if self.schema is not None:
            reader = reader.schema(f"{self.schema}, gone boolean, bucket string, attempt string")
            if not attempts or not folders:
                return self.spark.createDataFrame([], self.schema)
        elif not folders:
            folders = self._folders(None)[:1]  # for the columns
        stored = reader.option("basePath", f"{self.path}/rows").parquet(*folders).filter(F.col("attempt").isin([*attempts]))
        columns = [c for c in stored.columns if c not in ("gone", "bucket", "attempt")]
        if len(attempts) > 1:
            version = F.regexp_extract("attempt", "^v([0-9]+)-", 1).cast("long")
            stored = latest_per_key(stored.withColumn("_version", version), list(self.key), "_version")
        kept = stored.filter(~F.col("gone")).select(*columns)
        if keys is None:
            return kept
        return kept.join(keys.select(*self.key).distinct(), list(self.key), "left_semi")

    def compact(self) -> int:
        """Rewrite all rows as one version; the attempts before it are read no more and may be deleted."""
        return self.write(self.rows(), base=True)
