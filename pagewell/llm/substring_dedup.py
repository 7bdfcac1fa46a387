"""Removal of word windows that an earlier document holds too."""

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
from pagewell.llm.rolling import BASES, merged_runs, uncovered, window_anchors, window_hashes
from pagewell.session import stage

# Words of the hashes that a window's anchor is chosen from.
_PART = 16
_NOTHING = hashlib.sha256(b"").hexdigest()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def _read_words(width: int):
    """``(row, at, id, text)`` to the number of words, the digest of the words and the distinct anchors."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, at, own, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            words = (text.as_py() or b"").split()
            anchors = window_anchors(_word_hashes(words), width, min(_PART, width))
            digest = hashlib.sha256(b" ".join(words)).hexdigest()
            yield row, at, own, len(words), digest, np.unique(anchors).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [("n_words", pa.int64()), ("digest", pa.string()), ("anchors", pa.list_(pa.int64()))]
            yield from batched(rows(batch), pa.schema([*list(batch.schema)[:3], *map(lambda k: pa.field(*k), kinds)]))

    return run


def _shared_windows(width: int):
    """``(row, text, shared)`` to the windows whose anchor is shared, with two hashes each."""
    schema = pa.schema(
        [("row", pa.int64()), ("pos", pa.list_(pa.int64())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at, row in enumerate(batch.column(0).to_pylist()):
                hashes = _word_hashes(batch.column(1)[at].as_py().split())
                shared = np.asarray(batch.column(2)[at].values).view(np.uint64)
                pos = np.flatnonzero(np.isin(window_anchors(hashes, width, min(_PART, width)), shared))
                a, b = (window_hashes(hashes, width, base)[pos].view(np.int64) for base in BASES)
                yield row, pos, a, b

    return lambda batches: batched(rows(batches), schema, 16)


def _cut_words(width: int):
    """``(row, text, starts)`` to what is left of the words, and the runs removed."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [("row", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at, row in enumerate(batch.column(0).to_pylist()):
                words = batch.column(1)[at].as_py().split()
                begin, end = merged_runs(np.asarray(batch.column(2)[at].values), width)
                kept = [w for a, b in uncovered(len(words), begin, end) for w in words[a:b]]
                spans = [{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())]
                yield row, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), spans

    return lambda batches: batched(rows(batches), schema)


def repeated_windows(
    docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``<id_col>, n_words, n_removed, kept_sha256, spans``.

    A word is removed when a window of ``width`` consecutive words covers it whose words also start in
    a row with a smaller id; ``spans`` are the maximal runs ``[begin, end)`` of removed words. Words are what
    ASCII white space parts. Null and empty texts have no words. A null id is neither smaller
    nor larger: such rows lose nothing and take nothing away. Rows of the same id do not count
    against each other. An empty table gives no rows; other columns are ignored.

    Every window is hashed where its text is read. Its anchor, the least hash inside the window, goes
    first: only windows whose anchor another text has are counted by their own two hashes, as
    the others cannot repeat. Of equal word sequences one stands for all: a copy with a
    larger id is covered from end to end.
    """
    docs, _ = stored(docs)
    texts = docs.select(place().alias("at"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    base = stage(
        texts.select(F.monotonically_increasing_id().alias("row"), "at", "id", "text").mapInArrow(
            _read_words(width),
            f"row long, at struct<file: string, row: long>, id {kind}, n_words long, digest string, anchors array<long>",
        ),
        "words",
    )

    # One row for all equal word sequences: that of the smallest id.
    enough = base.where((F.col("n_words") >= width) & F.col("id").isNotNull())
    first = stage(
        enough.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("f")).select("digest", "f.id", "f.row"), "firsts"
    )
    ones = enough.join(first.select("row"), "row", "left_semi")
    anchors = ones.select("id", "row", F.explode("anchors").alias("anchor"))
    shared = stage(
        anchors.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"),
        "shared_anchors",
    )
    wanted = anchors.join(shared, "anchor").groupBy("row").agg(F.collect_list("anchor").alias("shared"))
    places = base.select("row", "at", "id")
    with_text = wanted.join(places.select("row", "at"), "row").join(texts.select("at", "text"), "at")
    windows = stage(
        with_text.select("row", "text", "shared")
        .mapInArrow(_shared_windows(width), "row long, pos array<long>, a array<long>, b array<long>")
        .join(places.select("row", "id"), "row"),
        "windows",
    ).select("row", "id", F.explode(F.arrays_zip("pos", "a", "b")).alias("w")).select("row", "id", "w.*")
    earliest = stage(
        windows.groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("a", "b", "low"),
        "repeated_windows",
    )
    covered = windows.join(earliest, ["a", "b"]).where("id > low").groupBy("row").agg(F.collect_list("pos").alias("starts"))
    cut = (
        covered.join(places.select("row", "at"), "row")
        .join(texts.select("at", "text"), "at")
        .select("row", "text", "starts")
        .mapInArrow(
            _cut_words(width),
            "row long, n_removed long, kept_sha256 string, spans array<struct<begin: long, end: long>>",
        )
    )
    by_digest = stage(
        first.select("digest", F.col("id").alias("first_id"), "row").join(cut, "row", "left").drop("row"), "cuts"
    )
    copy = F.col("id") > F.col("first_id")
    own = F.col("id") == F.col("first_id")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end")))
    none = F.lit(0).cast("long")
    return (
        base.drop("anchors", "at", "row")
        .join(by_digest, "digest", "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", none)).otherwise(none).alias("n_removed"),
            F.when(copy, F.lit(_NOTHING)).when(own, F.coalesce("kept_sha256", "digest")).otherwise(F.col("digest")).alias("kept_sha256"),
            F.when(copy, whole).when(own & F.col("spans").isNotNull(), F.col("spans")).otherwise(
                F.array().cast("array<struct<begin: bigint, end: bigint>>")
            ).alias("spans"),
        )
    )
