"""Packing by patterns of few lengths, whose repeats are fitted to the histogram of all lengths."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewell.llm.byte_tokens import byte_tokenizer
from pagewell.operators.joins import fits_broadcast
from pagewell.session import stage

_OUT_BYTES = 16 << 20
_FIT_ROUNDS = 300


def full_patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """All multisets of up to three ``present`` lengths that fill ``capacity``, as rows ``a >= b >= c >= 0``.

    ``present[n]`` says whether length ``n`` occurs; 0 stands for no document. There are about
    ``capacity ** 2 / 12`` of them at most, however many documents there are.
    """
    known = present.copy()
    known[0] = True
    lengths, out = np.arange(capacity + 1), []
    for c in np.flatnonzero(known[: capacity // 3 + 1]):
        b = lengths[c : (capacity - c) // 2 + 1]
        a = capacity - c - b
        real = known[a] & known[b]
        out.append(np.stack([a[real], b[real], np.full(real.sum(), c)], axis=1))
    return np.concatenate(out)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = _FIT_ROUNDS) -> np.ndarray:
    """Non-negative repeats ``x`` of the patterns, least squares of ``(used - counts) * length``.

    ``used`` is how often the repeats take each length. Accelerated projected gradient; a missed
    document counts by its length, as a long one is hard to place later.
    """
    bins, total = len(counts), max(1.0, float(counts.sum()))
    weight = (np.arange(bins) / (bins - 1)) ** 2
    goal = counts / total

    def used(x: np.ndarray) -> np.ndarray:
        out = np.zeros(bins)
        for k in range(3):
            out += np.bincount(patterns[:, k], x, bins)
        out[0] = 0
        return out

    def slope(r: np.ndarray) -> np.ndarray:
        r = weight * r
        return r[patterns[:, 0]] + r[patterns[:, 1]] + r[patterns[:, 2]]

    probe = np.ones(len(patterns))
    for _ in range(30):
        probe /= np.linalg.norm(probe)
        probe = slope(used(probe))
    step = 0.95 / max(np.linalg.norm(probe), 1e-12)
    x = ahead = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, ahead - step * slope(used(ahead) - goal))
        if (ahead - new) @ (new - x) > 0:  # it has swung past: start the momentum anew
            t = 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / later * (new - x), new, later
    return x * total


def best_fit(counts: np.ndarray, capacity: int) -> Counter:
    """Patterns of the documents in ``counts`` by best fit, longest first, with their repeats.

    Documents of one length are placed together, so the work grows with the lengths alone.
    """
    by_room: dict[int, Counter] = defaultdict(Counter)

    def place(n: int, many: int, room: int, pattern: tuple) -> int:
        """Fill ``many`` sequences of ``room`` as full as documents of length ``n`` go; returns documents left."""
        nonlocal left
        each = room // n
        whole = min(many, left // each)
        if whole:
            by_room[room - each * n][pattern + (n,) * each] += whole
        left -= whole * each
        if whole < many and left:
            by_room[room - left * n][pattern + (n,) * left] += 1
            whole, left = whole + 1, 0
        return whole

    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            room = min((r for r, open_ in by_room.items() if r >= n and open_), default=None)
            if room is None:
                place(n, -(-left // (capacity // n)), capacity, ())
                continue
            pattern, many = next(iter(by_room[room].items()))
            taken = place(n, many, room, pattern)
            by_room[room][pattern] -= taken
            if not by_room[room][pattern]:
                del by_room[room][pattern]
    out: Counter = Counter()
    for patterns in by_room.values():
        out.update(patterns)
    return out


def pack_plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each, for ``counts[n]`` documents of length ``n``.

    The fitted repeats are rounded so that their running sum stays within one half, never beyond the
    documents there are; what is left is packed by best fit, into patterns again.
    """
    left = counts.astype(np.int64).copy()
    patterns = full_patterns(capacity, left > 0)
    order = np.lexsort((patterns[:, 2], patterns[:, 1], patterns[:, 0]))[::-1]
    patterns = patterns[order]
    repeats = np.diff(np.floor(np.cumsum(fit_repeats(patterns, counts)) + 0.5), prepend=0.0)
    plan: Counter = Counter()
    for at in np.flatnonzero(repeats > 0):
        pattern = Counter(int(n) for n in patterns[at] if n)
        many = min(int(repeats[at]), *(int(left[n]) // m for n, m in pattern.items()))
        if many > 0:
            for n, m in pattern.items():
                left[n] -= many * m
            plan[tuple(sorted(pattern.elements(), reverse=True))] += many
    plan.update(best_fit(left, capacity))
    return sorted(plan.items(), reverse=True)


class Slots:
    """Where the r-th document of a length goes under a plan, by binary search."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]) -> None:
        taken: Counter = Counter()
        rows, sequence = [], 0
        for pattern, many in plan:
            offset = 0
            for n, m in sorted(Counter(pattern).items(), reverse=True):
                rows.append((n, taken[n], m, sequence, offset))
                taken[n] += m * many
                offset += m * n
            sequence += many
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.length, self.first, self.each, self.sequence, self.offset = (np.ascontiguousarray(c) for c in table.T)
        self.begin = np.searchsorted(self.length, np.arange(self.length.max(initial=0) + 2))

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of documents by length and rank within it."""
        at = np.empty(len(length), dtype=np.int64)
        for n in np.unique(length):
            own = length == n
            a, b = self.begin[n], self.begin[n + 1]
            at[own] = a + np.searchsorted(self.first[a:b], rank[own], side="right") - 1
        turn, slot = np.divmod(rank - self.first[at], self.each[at])
        return self.sequence[at] + turn, self.offset[at] + slot * length


def _pieces(path: str, capacity: int, end_id: int):
    """Rows ``(id, text)`` to pieces of at most ``capacity`` ids, numbered by length within the task."""
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["id", "piece", "start", "length", "ids", "part", "turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = byte_tokenizer(path).ids, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, held = [], 0

            def flush() -> pa.RecordBatch:
                source, *columns = zip(*rows)
                types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
                own = batch.column(0).take(pa.array(source, pa.int32()))
                return pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(columns, types))], names)

            for at, text in enumerate(batch.column(1)):
                data = encode(text.as_py() or "") + end
                total = len(data) // 4
                first = (total - 1) % capacity + 1
                for piece, stop in enumerate(range(first, total + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    n = stop - start
                    rows.append((at, piece, start, n, data[4 * start : 4 * stop], part, seen[n]))
                    seen[n] += 1
                    held += 4 * n
                    if held > _OUT_BYTES:
                        yield flush()
                        rows, held = [], 0
            if rows:
                yield flush()

    return run


def _placed(slots: Slots):
    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.place(length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return place


def pattern_pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their place in few sequences of at most ``capacity`` ids.

    Columns: ``<id_col>, piece, start, length, ids`` (little-endian unsigned 32-bit), ``sequence_id,
    offset``. A document is its ids and ``end_id``. One longer than ``capacity`` is cut into pieces of
    ``capacity`` ids, of which the first takes what does not fill one.

    The histogram of lengths, ``capacity`` numbers, is all that the driver sees: it enumerates
    the full patterns of up to three lengths, fits their repeats, rounds them and packs the rest. A piece's
    place follows from its length and its rank among the pieces of that length, so that pieces
    that share a sequence never have to meet. Ranks are sums of counts by task and length.

    Null texts count as empty: one piece that holds ``end_id``. Rows without an id and rows that
    share one are packed row by row. Further columns are not read, whatever their names. Texts of any length are
    encoded whole. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length int, ids binary, part int, turn long"
    pieces = stage(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), schema), "pattern_pieces")
    counts = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pattern_counts")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        histogram[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if fits_broadcast(counts):
        bases = F.broadcast(bases)
    place: Column = _placed(Slots(pack_plan(histogram, capacity)))("length", F.col("base") + F.col("turn"))
    return pieces.join(bases, ["part", "length"]).withColumn("place", place).select(
        F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        "place.sequence_id", "place.offset",
    )
