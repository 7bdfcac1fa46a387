"""SimHash fingerprints and their exact near-duplicate groups, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.llm.components import components, join_roots
from pagewell.session import stage

_ONE = np.uint64(1)
_BITS = np.arange(64, dtype=np.uint64)
# Fingerprints that are compared at once; larger buckets are cut into tiles of this size.
TILE = 2048
# Words of 64 comparisons that run through the planes together.
_BLOCK = 1 << 14


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterable[bytes] = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce((counts * 2 > len(hashes)).astype(np.uint64) << _BITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)``: the fingerprint of every whole text as a signed long. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, rows.select("id").withColumn("fp", F.lit(0).cast("long")).schema)


def _linked(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """Root position of every fingerprint after linking those of one bucket within ``radius`` bits.

    ``bucket`` is sorted. The planes hold one bit of 64 members of a bucket in a word. Bitwise
    counters in carry-save form add up the differing planes; a block of words is given up
    once every comparison in it is above the radius.
    """
    n = len(fps)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    begin = np.repeat(first, size)
    slot = np.arange(n) - begin
    word_first = np.cumsum(np.r_[0, (size + 63) // 64])[:-1]
    word = np.repeat(word_first, size) + slot // 64
    word_start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    shift = (slot % 64).astype(np.uint64)
    planes = np.stack([np.bitwise_or.reduceat(((fps >> p) & _ONE) << shift, word_start) for p in _BITS])
    filled = np.bitwise_or.reduceat(_ONE << shift, word_start)
    # Every fingerprint meets every word of its bucket.
    n_words = np.repeat((size + 63) // 64, size)
    query = np.repeat(np.arange(n), n_words)
    against = np.repeat(np.repeat(word_first, size), n_words) + (
        np.arange(len(query)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    )
    root = np.arange(n)
    flip = (~((fps[None, :] >> _BITS[:, None]) & _ONE)) + _ONE  # all ones where the bit is set
    for at in range(0, len(query), _BLOCK):
        q, w = query[at : at + _BLOCK], against[at : at + _BLOCK]
        counter = [np.zeros(len(q), dtype=np.uint64) for _ in range((radius + 1).bit_length())]
        over = ~filled[w]
        for p in range(64):
            carry = planes[p][w] ^ flip[p][q]
            for c in range(len(counter)):
                counter[c], carry = counter[c] ^ carry, counter[c] & carry
            over |= carry
            # Counters above the radius: compare from the highest digit down.
            above, equal = np.zeros_like(over), ~np.zeros_like(over)
            for c in reversed(range(len(counter))):
                if (radius >> c) & 1:
                    equal &= counter[c]
                else:
                    above |= equal & counter[c]
                    equal &= ~counter[c]
            over |= above
            if p % 4 == 3 and (over == ~np.uint64(0)).all():
                break
        else:
            hit = np.flatnonzero(over != ~np.uint64(0))
            for part in np.array_split(hit, max(1, len(hit) >> 12)):
                near = np.unpackbits((~over[part]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, bit = np.nonzero(near)
                u, v = q[part][row], word_start[w[part][row]] + bit
                root = join_roots(root, u, v)
    return root


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> pa.RecordBatch:
            key = table.column("g").to_numpy()
            fps = table.column("fp").to_numpy().view(np.uint64)
            root = _linked(fps, key, radius)
            other = np.flatnonzero(root != np.arange(len(root)))
            u, v = fps[root[other]].view(np.int64), fps[other].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < 2 * TILE:
                continue
            rows = pa.Table.from_batches(kept)
            key = rows.column("g").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            kept = rows.slice(cut).to_batches()
            if cut:
                yield emit(rows.slice(0, cut))
        if kept and sum(b.num_rows for b in kept):
            yield emit(pa.Table.from_batches(kept))

    return run


def near_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(u, v)`` that connect all fingerprints of ``fps(fp)`` within ``radius`` bits.

    Fingerprints are cut into ``radius + 2`` blocks; a pair within the radius agrees in two of
    them, so it meets in the bucket of those two. A bucket of more than ``TILE`` fingerprints
    is cut into tiles which meet pairwise in groups of their own. A group gives at most one edge
    per fingerprint: the links inside it are joined before they leave the task. ``fp`` is distinct.
    """
    blocks = radius + 2
    width = 64 // blocks
    ends = [64 if i == blocks - 1 else width * (i + 1) for i in range(blocks)]

    def block(i: int):
        mask = (1 << (ends[i] - width * i)) - 1
        return F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(mask))

    tables = [(i, j) for i in range(blocks) for j in range(i + 1, blocks)]
    keys = F.array(*[F.xxhash64(F.lit(t), block(i), block(j)) for t, (i, j) in enumerate(tables)])
    rows = fps.select("fp", F.explode(keys).alias("key"))
    large = stage(rows.groupBy("key").count().where(F.col("count") > TILE), "large_buckets")
    if large.isEmpty():
        grouped = rows.select(F.col("key").alias("g"), "fp")
    else:
        tiles = large.select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
        paired = rows.join(tiles, "key", "left").select(
            "key", "fp", own.alias("own"),
            F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("other"),
        )
        group = F.when(F.col("own").isNull(), F.col("key")).otherwise(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        )
        grouped = paired.select(group.alias("g"), "fp")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        grouped.repartition(parts, "g").sortWithinPartitions("g", "fp").mapInArrow(_bucket_edges(radius), "u long, v long")
    )


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """``(<id_col>, fingerprint, component_id)`` for every row of ``docs``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable over links. Null and empty texts have fingerprint zero and are linked like
    any other; a text of fewer words than a shingle is one shingle. Repeated rows keep their
    rows. Rows with a null id are linked too, and only a group without any id has a null
    ``component_id``. An empty table gives no rows.
    """
    marked = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "fingerprint_nodes")
    roots = components(near_pairs(nodes.select("fp"), radius))
    placed = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = placed.join(least, "root").select("fp", "component_id")
    return marked.join(groups, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
