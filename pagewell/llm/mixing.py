"""Mixing sources to target weights: exact block quotas split over output shards by a tree of draws."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewell.session import stage

WORD = r"[^\x20\x09-\x0D]+"
# Documents of a source that are put in order together.
_BUCKET_ROWS = 1_024


def source_targets(
    sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, most: float
) -> list[tuple[str | None, int, float]]:
    """``(source, size, target)``: ``share`` of all sizes by weight, none above ``most`` times its size.

    Sources are ordered by code point, null last, and take the weights in turn. What a source cannot
    take goes to the others by weight, until none is above its limit.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    left, targets = share * sum(n for _, n in ordered), [0.0] * len(ordered)
    free = list(range(len(ordered)))
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > most * ordered[i][1]]
        if not over:
            for i in free:
                targets[i] = left * weight[i] / total
            break
        for i in over:
            targets[i] = float(most * ordered[i][1])
        left -= sum(targets[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return [(source, n, t) for (source, n), t in zip(ordered, targets)]


def shard_draws(quotas: list[int], shard: int, shards: int, seed: int) -> list[tuple[int, int]]:
    """``(first, count)`` of each source's permuted blocks that go to one shard.

    A node of the tree splits the quotas it got between its two halves of the shards by a
    multivariate hypergeometric draw. Draws depend on the seed and the node alone, so each shard
    finds its own on the way down from the root, and the ranges of all shards are disjoint and
    use every quota up.
    """
    left = np.array(quotas, dtype=np.int64)
    first = np.zeros_like(left)
    low, high = 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        n = int(left.sum()) * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        drawn = rng.multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros_like(left)
        if shard < middle:
            left, high = drawn, middle
        else:
            left, first, low = left - drawn, first + drawn, middle
    return list(zip(first.tolist(), left.tolist()))


def _stride(n: int) -> int:
    """A step that visits all ``n`` blocks, about the golden section of them."""
    step = max(1, int(n * 0.6180339887))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    cut: bool = True,
    seed: int = 7,
    block_words: int = 65_536,
    shard_blocks: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    order_col: str | None = None,
) -> DataFrame:
    """One row per document: ``<id_col>, <source_col>, size, source_size, target, taken, draws``.

    Each source's documents are laid on a line in a random order of their own. A target of R words
    is the first R words of that line, gone over a second time beyond its end. The line is cut in
    blocks of ``block_words``; a source's blocks are its quota, which :func:`shard_draws` splits among
    shards of about ``shard_blocks`` blocks. ``draws`` lists where the document goes: lap, words,
    shard and its place among the shard's documents after a local shuffle (sort by ``place``).

    With ``cut`` the document on which a target ends gives only the words up to it, so each source
    meets its target to a word; without, it is taken whole when its middle lies before the target.
    Null texts and texts without words have size zero and are never drawn; the null source is a
    source. Rows with the same id are separate documents. The random order follows ``order_col``, by
    default the id. The driver holds one row per source. Reruns
    give the same mix. An empty table gives no rows.
    """
    spark = docs.sparkSession
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(order_col or id_col).cast("string"), F.lit(""))))
    sized = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), order.alias("order"),
        ),
        "sized",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    targets = source_targets([(r["source"], r["n"]) for r in totals], weights, share, most)
    reach = [round(t) for _, _, t in targets]
    quotas = [-(-r // block_words) for r in reach]
    shards = max(1, -(-sum(quotas) // shard_blocks))
    table = spark.createDataFrame(
        [
            (i, s, n, t, r, q, _stride(max(1, q)))
            for i, ((s, n, t), r, q) in enumerate(zip(targets, reach, quotas))
        ],
        "k int, source string, source_size long, target double, reach long, quota long, stride long",
    )

    # Place of every document on its source's line: sums of buckets first, then within a bucket.
    digits = 0
    while max((r["docs"] for r in totals), default=0) > _BUCKET_ROWS * 16**digits:
        digits += 1
    keyed = sized.withColumn("bucket", F.substring("order", 1, digits))
    by_bucket = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("source", "bucket").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("start", F.col("inner") + F.col("offset"))
        .drop("s", "b")
        .join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
    )

    def lap(number: int):
        room = F.col("reach") - number * F.col("source_size") - F.col("start")
        if cut:
            return F.greatest(F.lit(0), F.least("size", room))
        return F.when(F.col("size") < 2 * room, F.col("size")).otherwise(0)

    laps = F.array(*[F.struct(F.lit(i).alias("lap"), lap(i).cast("long").alias("words")) for i in range(math.ceil(most))])
    spread = placed.select("row", "id", "source", "size", "source_size", "target", "k", "quota", "stride", "order", "start",
                           F.explode_outer(F.filter(laps, lambda d: d["words"] > 0)).alias("draw"))
    block = F.floor((F.col("draw.lap") * F.col("source_size") + F.col("start")) / block_words)
    drawn = spread.withColumn("rank", F.pmod(block * F.col("stride") + seed, F.col("quota")))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (shard, k, first, count)
                for shard in batch["id"]
                for k, (first, count) in enumerate(shard_draws(quotas, shard, shards, seed))
                if count
            ]
            yield pd.DataFrame(rows, columns=["shard", "k", "first", "count"])

    owner = (
        spark.range(shards)
        .mapInPandas(leaves, "shard long, k int, first long, count long")
        .select("shard", "k", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("rank"))
    )
    routed = drawn.join(owner, ["k", "rank"], "left").withColumn(
        "place", F.xxhash64(F.lit(seed), "shard", "order", "draw.lap")
    )
    where_to = F.struct("draw.lap", "draw.words", "shard", "place")
    return (
        routed.groupBy("row")
        .agg(
            *[F.first(c).alias(c) for c in ("id", "source", "size", "source_size", "target")],
            F.coalesce(F.sum("draw.words"), F.lit(0)).alias("taken"),
            F.array_sort(F.collect_list(F.when(F.col("draw").isNotNull(), where_to))).alias("draws"),
        )
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "draws")
    )
