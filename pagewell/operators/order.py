"""Running sums over the order of a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewell.session import stage


def running_sums(rows: DataFrame, keys: list[str], summed: list[str], label: str) -> DataFrame:
    """``rows`` with each of the ``summed`` columns replaced by its sum up to and with the row, in the order of ``keys``.

    The rows are dealt out by ranges of the keys and written in that order; a range starts from the
    totals of the ranges before it, one row each. Rows with equal keys share a range, so no key
    may stand for a large part of the table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    ordered = stage(dealt.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), label)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in summed])
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in summed])
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    within = ordered.select("*", *[F.sum(c).over(own).alias(f"_own_{c}") for c in summed])
    # A row for each of ``parts`` ranges.
    joined = within.join(F.broadcast(bases), "_part")
    kept = [c for c in rows.columns if c not in summed]
    return joined.select(*kept, *[(F.col(f"_{c}") + F.col(f"_own_{c}")).alias(c) for c in summed])
