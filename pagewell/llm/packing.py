"""Packing of documents into sequences of equal length and balanced attention cost."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewell.llm.tokens import word_tokenizer

# Text bytes per packing group: its ids take at most four times as much in a task's memory.
GROUP_BYTES = 16 << 20
_OUT_BYTES = 16 << 20


def pack_lengths(
    lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 6144
) -> list[tuple[int, int, int, int, int]]:
    """``(item, start in item, length, sequence, offset)`` for items of 1 to ``capacity`` tokens.

    The fewest sequences that hold all tokens are opened. Items go down in length, each to the
    sequence of the lowest cost ``linear * n + quadratic * n * n`` summed over its pieces that
    still has room. An item that fits nowhere fills the roomiest sequence and its
    rest takes its turn by its own length, so that no sequence but the last few has padding.
    """
    by_length: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for item, n in enumerate(lengths):
        by_length[n].append((item, 0))
    count = -(-sum(lengths) // capacity)
    room, cost = [capacity] * count, [0.0] * count
    open_, parked = [(0.0, s) for s in range(count)], [[] for _ in range(capacity + 1)]
    out = []
    for n in range(capacity, 0, -1):
        for s in parked[n]:
            heapq.heappush(open_, (cost[s], s))
        parked[n] = []
        for item, start in by_length[n]:
            while open_ and room[open_[0][1]] < n:
                s = heapq.heappop(open_)[1]
                parked[room[s]].append(s)
            if open_:
                s, take = open_[0][1], n
            else:
                r = next(r for r in range(n - 1, 0, -1) if parked[r])
                s, take = parked[r].pop(), r
                by_length[n - r].append((item, start + r))
            out.append((item, start, take, s, capacity - room[s]))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            if take == n:
                if room[s]:
                    heapq.heapreplace(open_, (cost[s], s))
                else:
                    heapq.heappop(open_)
    return out


def _tokenize(path: str, capacity: int, end_id: int):
    """Rows ``(row, id, text)`` to pieces of at most ``capacity`` ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path).ids
        for batch in batches:
            source, start, ids, total, held = [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                taken = pa.array(source, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(start, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    ["row", "id", "start", "ids", "doc_tokens"],
                )

            for at, text in enumerate(batch.column(2)):
                data = encode(text.as_py() or "") + end
                for begin in range(0, len(data), 4 * capacity):
                    piece = data[begin : begin + 4 * capacity]
                    source.append(at)
                    start.append(begin // 4)
                    ids.append(piece)
                    total.append(len(data) // 4)
                    held += len(piece)
                    if held > _OUT_BYTES:
                        yield flush()
                        source, start, ids, total, held = [], [], [], [], 0
            if source:
                yield flush()

    return run


def _pack(capacity: int, linear: float, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        pieces = pa.Table.from_batches(kept).combine_chunks()
        order = np.lexsort((pieces.column("start").to_numpy(), pieces.column("row").to_numpy()))
        ids = pieces.column("ids").chunk(0)
        sizes = np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1])[order] // 4
        full = order[sizes == capacity]
        rest = order[sizes < capacity]
        packed = [(int(p), 0, capacity, s, 0) for s, p in enumerate(full)]
        for item, begin, n, s, offset in pack_lengths(sizes[sizes < capacity].tolist(), capacity, linear, quadratic):
            packed.append((int(rest[item]), begin, n, len(full) + s, offset))
        base = TaskContext.get().partitionId() << 32
        step = max(1, _OUT_BYTES // (4 * capacity))
        for at in range(0, len(packed), step):
            piece, begin, n, s, offset = map(list, zip(*packed[at : at + step]))
            own = pieces.take(pa.array(piece, pa.int64())).combine_chunks()
            cut = [
                memoryview(data.as_buffer())[4 * b : 4 * (b + m)] for data, b, m in zip(own.column("ids").chunk(0), begin, n)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    own.column("id").chunk(0),
                    pa.array(own.column("start").to_numpy() + np.array(begin, dtype=np.int64)),
                    pa.array(n, pa.int64()),
                    pa.array([bytes(c) for c in cut], pa.binary()),
                    own.column("doc_tokens").chunk(0),
                    pa.array(np.array(s, dtype=np.int64) + base),
                    pa.array(offset, pa.int64()),
                ],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    linear: float = 1.0,
    quadratic: float = 1 / 6144,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most ``capacity`` ids.

    Columns: ``<id_col>, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``. A document is its ids and ``end_id``. Every ``capacity`` ids of a longer
    document are a sequence of their own; what remains is packed by cost within groups of about
    ``group_bytes`` of text, dealt out by row and not by id, so repeated or null ids are spread.
    Null texts count as empty: one piece that holds ``end_id``. An empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    pieces = rows.mapInArrow(
        _tokenize(tokenizer_path, capacity, end_id), f"row long, id {kind}, start long, ids binary, doc_tokens long"
    )
    return (
        pieces.repartition(groups, F.xxhash64("row", "start"))
        .mapInArrow(
            _pack(capacity, linear, quadratic),
            f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
        )
        .withColumnRenamed("id", id_col)
    )
