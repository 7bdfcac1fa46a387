"""Removal of byte strings that occur more than once, by sharded suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.llm.batches import batched
from pagewell.llm.located import place, stored
from pagewell.llm.rolling import sliding_minima, uncovered, window_hashes
from pagewell.llm.suffix import repeated_starts
from pagewell.session import stage

# Bytes of the hashes that a string's anchor is chosen from; bytes of segments per shard.
_PART = 100
SHARD_BYTES = 4 << 20
# Bytes of one anchor's distinct segments that are sorted together; those of a more common one are cut into pieces.
ANCHOR_BYTES = SHARD_BYTES // 8
# Starts, counted from the anchor, that a piece of a segment keeps together.
_TOGETHER = 32
_EMPTY = hashlib.sha256(b"").hexdigest()
_BYTE_VALUES = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_RUN = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_RUNS = "array<struct<begin: long, end: long>>"
_PIECE = "segment long, begin long, n long, anchor long, content binary, data binary"
_SEGMENT = "row long, anchor long, begin long, n long, content binary, single boolean"


def anchor_segments(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, begin, end, single)`` of each run ``[begin, end)`` of starts whose strings share an anchor.

    The anchor of a string of ``width`` bytes is the least hash of its parts, so equal strings have equal
    anchors. ``single`` is true when the anchor's part occurs once in the run: then no two strings of
    the run are equal.
    """
    empty = np.empty(0, dtype=np.int64)
    if len(data) < width:
        return empty.astype(np.uint64), empty, empty, empty.astype(bool)
    part = min(_PART, width)
    parts = window_hashes(_BYTE_VALUES[np.frombuffer(data, dtype=np.uint8)], part)
    least = sliding_minima(parts, width - part + 1)
    begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[begin[1:], len(least)]
    anchor = least[begin]
    known, own = np.unique(anchor, return_inverse=True)
    near = np.searchsorted(known, parts)
    at = np.flatnonzero(known[np.minimum(near, len(known) - 1)] == parts)
    key = np.sort(near[at] * len(parts) + at)
    n = np.searchsorted(key, own * len(parts) + end - 1 + width - part + 1) - np.searchsorted(key, own * len(parts) + begin)
    return anchor, begin, end, n < 2


def _read_bytes(width: int):
    """``(row, at, id, text)`` to the size, the digest and the anchors, one twice if its run may repeat itself."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, at, own, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            data = text.as_py() or b""
            anchor, _, _, single = anchor_segments(data, width)
            both = np.r_[anchor, anchor[~single]].view(np.int64)
            yield row, at, own, len(data), hashlib.sha256(data).hexdigest(), both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [("n_bytes", pa.int64()), ("digest", pa.string()), ("anchors", pa.list_(pa.int64()))]
            yield from batched(rows(batch), pa.schema([*list(batch.schema)[:3], *(pa.field(*f) for f in new)]))

    return run


def _segments(width: int):
    """``(row, text, shared)`` to the segments whose anchor is shared."""
    schema = pa.schema(
        [("row", pa.int64()), ("anchor", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("content", pa.binary()), ("single", pa.bool_())]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at, row in enumerate(batch.column(0).to_pylist()):
                data = batch.column(1)[at].as_py()
                anchor, begin, end, single = anchor_segments(data, width)
                shared = np.asarray(batch.column(2)[at].values).view(np.uint64)
                for i in np.flatnonzero(np.isin(anchor, shared)).tolist():
                    a, b = int(begin[i]), int(end[i])
                    content = xxhash.xxh3_128_digest(data[a : b + width - 1])
                    yield row, anchor[i : i + 1].view(np.int64)[0], a, b - a, content, bool(single[i])

    return lambda batches: batched(rows(batches), schema, 4096)


def _segment_bytes(width: int):
    """``(text, wanted)`` to the bytes of the wanted segments."""
    schema = pa.schema([("segment", pa.int64()), ("anchor", pa.int64()), ("data", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                data = text.as_py()
                for w in wanted:
                    yield w["segment"], w["anchor"], data[w["begin"] : w["begin"] + w["n"] + width - 1]

    return lambda batches: batched(rows(batches), schema, 1024)


def _pieces(width: int):
    """``(segment, anchor, data)`` to pieces of the segment, whose key stands in the place of the anchor.

    Equal strings hold the anchor's part first at the same place. Starts whose strings do so at the same spot of the segment,
    in one block of ``_TOGETHER`` places, share the bytes that all strings of the block have; these belong to the key. No two
    strings of a piece are equal.
    """
    schema = pa.schema(
        [("segment", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("content", pa.binary()), ("data", pa.binary())]
    )
    part = min(_PART, width)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for segment, anchor, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = len(own) - width + 1
                parts = window_hashes(_BYTE_VALUES[np.frombuffer(own, dtype=np.uint8)], part)
                spots = np.flatnonzero(parts.view(np.int64) == anchor)
                starts = np.arange(n)
                spot = spots[np.searchsorted(spots, starts)]
                block = (spot - starts) // _TOGETHER
                new = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (block[1:] != block[:-1])])
                for i, j in zip(new.tolist(), [*new[1:].tolist(), n]):
                    first = int(spot[i] - block[i] * _TOGETHER)
                    shared = own[first : first - _TOGETHER + 1 + width]
                    key = xxhash.xxh3_64_intdigest(shared, seed=anchor & (1 << 64) - 1) + int(block[i])
                    piece = own[i : j + width - 1]
                    yield segment, i, j - i, (key + (1 << 63)) % (1 << 64) - (1 << 63), xxhash.xxh3_128_digest(piece), piece

    return lambda batches: batched(rows(batches), schema, 1024)


def _strings(width: int):
    """``(segment, data)`` to the digest of each of its strings."""
    schema = pa.schema([("segment", pa.int64()), ("at", pa.int64()), ("content", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i in range(len(data) - width + 1):
                    yield segment, i, xxhash.xxh3_128_digest(data[i : i + width])

    return lambda batches: batched(rows(batches), schema, 4096)


def _shard(width: int):
    """All segments of a shard to the runs of starts that repeat, by segment."""
    schema = pa.schema([("segment", pa.int64()), ("runs", pa.list_(_RUN))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        names, segments = [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            segments += batch.column(2).to_pylist()
        if not segments:
            return
        for name, starts in zip(names, repeated_starts(segments, width)):
            if len(starts):
                yield name, _runs(starts)

    return lambda batches: batched(rows(batches), schema, 4096)


def _runs(starts: np.ndarray) -> list[dict]:
    new = np.r_[True, starts[1:] != starts[:-1] + 1]
    last = np.r_[new[1:], True]
    return [{"begin": a, "end": b + 1} for a, b in zip(starts[new].tolist(), starts[last].tolist())]


def _cut_bytes(width: int):
    """``(row, text, runs)`` to what is left, and the spans removed."""
    schema = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(_RUN))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at, row in enumerate(batch.column(0).to_pylist()):
                data = batch.column(1)[at].as_py()
                runs = batch.column(2)[at].values
                begin = np.asarray(runs.field("begin"))
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.asarray(runs.field("end"))[order] + width - 1
                reach = np.maximum.accumulate(end)
                new = np.r_[True, begin[1:] > reach[:-1]]
                begin, end = begin[new], reach[np.r_[new[1:], True]]
                kept = b"".join(data[a:b] for a, b in uncovered(len(data), begin, end))
                spans = [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())]
                yield row, len(data) - len(kept), hashlib.sha256(kept).hexdigest(), spans

    return lambda batches: batched(rows(batches), schema)


def repeated_bytes(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``<id_col>, n_bytes, n_removed, kept_sha256, spans``.

    A byte is removed when a string of ``width`` bytes covers it that also starts anywhere else, in
    another row or the same one; ``spans`` are the maximal runs ``[begin, end)`` removed. Texts are UTF-8,
    null is empty, and strings do not cross rows. Ids play no part, so null and repeated ones
    do no harm. An empty table gives no rows; other columns are ignored.

    A string whose anchor occurs once cannot repeat, so only *segments* around shared anchors go
    further, each distinct one once. All segments of an anchor meet in one shard, whose suffixes
    are sorted by recursive induction (:mod:`pagewell.llm.suffix`); equal strings are neighbours there. The segments
    of an anchor with more than ``ANCHOR_BYTES`` of them are cut into pieces by their place around the anchor and the bytes
    that their strings share there, at last into single strings, and meet in as many groups. A text that occurs
    twice is removed whole and stands once for its copies.
    """
    spark = docs.sparkSession
    docs, _ = stored(docs)
    texts = docs.select(place().alias("at"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    base = stage(
        texts.select(F.monotonically_increasing_id().alias("row"), "at", "id", "text").mapInArrow(
            _read_bytes(width),
            f"row long, at struct<file: string, row: long>, id {kind}, n_bytes long, digest string, anchors array<long>",
        ),
        "bytes",
    )
    first = stage(
        base.where(F.col("n_bytes") >= width).groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")),
        "distinct_texts",
    )
    ones = base.join(first.select("row"), "row", "left_semi")
    anchors = ones.select("row", F.explode("anchors").alias("anchor"))
    shared = stage(anchors.groupBy("anchor").count().where("count > 1").select("anchor"), "shared_anchors")
    wanted = anchors.join(shared, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("shared"))
    places = base.select("row", "at")

    def with_text(rows: DataFrame) -> DataFrame:
        return rows.join(places, "row").join(texts.select("at", "text"), "at")

    segments = stage(
        with_text(wanted).select("row", "text", "shared").mapInArrow(_segments(width), _SEGMENT),
        "segments",
    )
    distinct = stage(
        segments.groupBy("anchor", "content")
        .agg(F.min(F.struct("row", "begin")).alias("f"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c"), F.min("single").alias("single"))
        .withColumn("segment", F.monotonically_increasing_id()),
        "distinct_segments",
    )
    # A lone segment that cannot repeat itself needs no suffix array, nor does a whole one that came twice alone.
    groups = distinct.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("n") + width - 1).alias("size"), F.min("single").alias("all_single")
    )
    groups = stage(groups.where("k > 1 OR NOT all_single").select("anchor", (F.col("size") > ANCHOR_BYTES).alias("common")), "anchor_groups")
    to_sort, common = groups.select("anchor"), groups.where("common").select("anchor")
    sorted_ones = distinct.join(to_sort, "anchor", "left_semi")
    size = sorted_ones.agg(F.sum(F.col("n") + width - 1)).first()[0] or 0

    def by_text(some: DataFrame) -> DataFrame:
        wanted = F.struct("segment", "anchor", F.col("f.begin").alias("begin"), "n")
        return with_text(some.groupBy(F.col("f.row").alias("row")).agg(F.collect_list(wanted).alias("wanted")))

    data = by_text(sorted_ones).select("text", "wanted").mapInArrow(_segment_bytes(width), "segment long, anchor long, data binary")
    cut_finer = not common.isEmpty()
    if cut_finer:
        data = stage(data, "segment_bytes")
        pieces = stage(data.join(common, "anchor", "left_semi").select("segment", "anchor", "data").mapInArrow(_pieces(width), _PIECE), "pieces")
        # Pieces have numbers below zero, next to those of segments.
        alike = stage(
            pieces.groupBy("anchor", "content")
            .agg(F.first("data").alias("data"), F.first("n").alias("n"), F.count(F.lit(1)).alias("c"))
            .withColumn("segment", -1 - F.monotonically_increasing_id()),
            "distinct_pieces",
        )
        keys = alike.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("data")).alias("size")).where("k > 1")
        keys = stage(keys.select("anchor", "size", (F.col("size") > ANCHOR_BYTES).alias("common")), "piece_groups")
        size += keys.where("NOT common").agg(F.sum("size")).first()[0] or 0
        some = alike.join(keys.where("NOT common"), "anchor", "left_semi").select("segment", "anchor", "data")
        data = data.join(common, "anchor", "left_anti").select("segment", "anchor", "data").unionByName(some)
    found = stage(
        data.repartition(max(1, -(-size // SHARD_BYTES)), F.xxhash64("anchor")).mapInArrow(_shard(width), f"segment long, runs {_RUNS}"),
        "repeated_runs",
    )
    if cut_finer:
        # Pieces of a key that is too common still are cut into strings.
        strings = alike.join(keys.where("common"), "anchor", "left_semi").select("segment", "data").mapInArrow(
            _strings(width), "segment long, at long, content binary"
        )
        strings = stage(strings, "strings")
        twice = strings.groupBy("content").count().where("count > 1").select("content")
        starts = strings.join(twice, "content", "left_semi").groupBy("segment")
        by_string = starts.agg(F.collect_list(F.struct(F.col("at").alias("begin"), (F.col("at") + 1).alias("end"))).alias("runs"))
        all_starts = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))
        of_pieces = (
            alike.join(found.where("segment < 0").unionByName(by_string), "segment", "left")
            .select("anchor", "content", F.when(F.col("c") > 1, all_starts).otherwise(F.col("runs")).alias("runs"))
            .where("runs IS NOT NULL")
        )
        placed = pieces.drop("data").join(of_pieces, ["anchor", "content"]).select("segment", "begin", F.explode("runs").alias("run"))
        run = F.struct((F.col("begin") + F.col("run.begin")).alias("begin"), (F.col("begin") + F.col("run.end")).alias("end"))
        found = found.where("segment >= 0").unionByName(placed.groupBy("segment").agg(F.collect_list(run).alias("runs")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n").alias("end")))
    runs = stage(
        distinct.join(found, "segment", "left")
        .select("anchor", "content", F.when(F.col("c") > 1, whole).otherwise(F.col("runs")).alias("runs"))
        .where("runs IS NOT NULL"),
        "segment_runs",
    )
    by_row = (
        segments.join(runs, ["anchor", "content"])
        .select("row", "begin", F.explode("runs").alias("run"))
        .groupBy("row")
        .agg(F.collect_list(F.struct((F.col("begin") + F.col("run.begin")).alias("begin"), (F.col("begin") + F.col("run.end")).alias("end"))).alias("runs"))
    )
    single_texts = first.where("copies = 1").select("row")
    cut = with_text(by_row.join(single_texts, "row", "left_semi")).select("row", "text", "runs").mapInArrow(
        _cut_bytes(width), f"row long, n_removed long, kept_sha256 string, spans {_RUNS}"
    )
    by_digest = stage(first.join(cut, "row", "left").drop("row"), "cuts")
    copy = F.col("copies") > 1
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    return (
        base.select("id", "n_bytes", "digest")
        .join(by_digest, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            "n_bytes",
            F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
            F.when(copy, all_of_it).otherwise(F.coalesce("spans", F.array().cast(_RUNS.replace("long", "bigint")))).alias("spans"),
        )
    )
