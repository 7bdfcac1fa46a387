"""Token totals kept up by signed deltas in idempotent batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.llm.tokens import word_tokenizer

KEYS = ["source", "lang", "version"]
_LEDGER = "id string, source string, lang string, version string, tokens long, live boolean, batch long"
_DELTAS = "source string, lang string, version string, documents long, tokens long, batch long"


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``tokens``, the number of ids of the whole text, in the place of the text; 0 for a null or empty one.

    A column ``tokens`` that the rows bring is replaced; all others stay as they are, whatever their
    names. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_tokenizer(tokenizer_path).ids
        for batch in batches:
            *others, texts = batch.columns
            n = np.fromiter((len(ids(t.as_py() or "")) // 4 for t in texts), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*others, pa.array(n)], [*batch.schema.names[:-1], "tokens"])

    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "tokens")]
    rows = docs.select(*others, F.col(f"`{text_col}`").alias("tokens"))
    return rows.mapInArrow(run, rows.withColumn("tokens", F.lit(0).cast("long")).schema)


class TokenTotals:
    """Totals by source, language and tokenizer version below ``path``.

    A batch holds changes ``(id, op, source, lang, version, tokens)``, at most one per id and version: ``upsert``
    brings a document in or revises it, ``delete`` takes it out. Each batch writes a *ledger* folder
    with the new state of the documents it names and a *delta* folder with the signed sums of what
    left and what came. A delta folder is complete once Spark has marked it, and it is written
    last, so the batch is committed by that mark, and nothing of a batch without it is ever read. Committing a
    number again does nothing; a batch that was cut short is written anew. Batches are committed in the order
    of their numbers: one is refused while an earlier one is begun and not committed, and after a later one.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._spark, self._path = spark, path.rstrip("/")

    def _batches(self, table: str, mark: str = "") -> set[int]:
        """Numbers of the batch folders of a table, of those that hold a file ``mark`` if one is named."""
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._path}/{table}/batch=*/{mark}".rstrip("/"))
        found = path.getFileSystem(self._spark._jsc.hadoopConfiguration()).globStatus(path) or []
        folders = [f.getPath().getParent() if mark else f.getPath() for f in found]
        return {int(f.getName().removeprefix("batch=")) for f in folders}

    def committed(self) -> list[int]:
        """Numbers of the committed batches."""
        return sorted(self._batches("deltas", "_SUCCESS"))

    def _read(self, table: str, schema: str, batches: list[int]) -> DataFrame:
        """Rows of the given batches."""
        folders = [f"{self._path}/{table}/batch={b}" for b in batches]
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).option("basePath", f"{self._path}/{table}").parquet(*folders)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch; False if it was committed before. Null dimensions are values of their own. A batch may be empty.

        Rows with a null id or another ``op`` are refused by an error when they are met. Of several rows
        for one id and version the one with the most tokens counts. Earlier ledgers are joined on the
        id, so the cost of old state is one shuffle of its ids; totals are pre-added in the tasks.
        """
        done = self.committed()
        if batch in done:
            return False
        begun = {b for b in self._batches("ledger") - {*done} if b < batch}
        if begun:
            raise ValueError(f"batch {min(begun)} was begun and not committed; commit it before batch {batch}")
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}, which is committed")
        bad = F.raise_error(F.lit("a change needs an id and the op upsert or delete"))
        new = changes.select(
            F.when(F.col("id").isNotNull() & F.col("op").isin("upsert", "delete"), F.col("id").cast("string")).otherwise(bad).alias("id"),
            "source", "lang", F.col("version").cast("string").alias("version"),
            F.when(F.col("op") == "upsert", F.coalesce("tokens", F.lit(0))).otherwise(0).cast("long").alias("tokens"),
            (F.col("op") == "upsert").alias("live"),
        )
        state = ["source", "lang", "tokens", "live"]
        one = new.groupBy("id", "version").agg(F.max_by(F.struct(*state), F.struct("live", "tokens", "source", "lang")).alias("s"))
        ledger = f"{self._path}/ledger/batch={batch}"
        one.select("id", "version", "s.*").write.mode("overwrite").parquet(ledger)
        now = self._spark.read.parquet(ledger)
        old = (
            self._read("ledger", _LEDGER, done)
            .join(now.select("id", "version"), ["id", "version"], "left_semi")
            .groupBy("id", "version")
            .agg(F.max_by(F.struct(*state), "batch").alias("s"))
            .select("version", "s.*")
        )
        signed = now.select(*KEYS, "tokens", "live", F.lit(1).alias("sign")).unionByName(
            old.select(*KEYS, "tokens", "live", F.lit(-1).alias("sign"))
        )
        deltas = signed.where("live").groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens")
        )
        deltas.write.mode("overwrite").parquet(f"{self._path}/deltas/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, version, documents, tokens)`` over all batches, without groups that are empty."""
        sums = self._read("deltas", _DELTAS, self.committed()).groupBy(*KEYS).agg(
            F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")
        )
        return sums.where("documents <> 0 OR tokens <> 0")
