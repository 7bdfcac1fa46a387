"""Hard negatives by exact integer scores, looked up in subset-sum tables of the anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewell.session import stage

# Most candidates and anchors that meet in one task.
CELL_CANDIDATES = 1 << 18
CELL_ANCHORS = 1 << 13
# Anchors whose tables are built together, and candidates scored against them at once.
_TABLE_ANCHORS = 32
_ROWS = 1 << 13
# With squared lengths below this, no inner product leaves 64 bits.
_MOST_ENERGY = float(1 << 62)


def packed_planes(values: np.ndarray) -> np.ndarray:
    """Integers ``(rows, dimensions)`` as two's complement bit planes, lowest first: bytes ``(rows, planes, groups)``.

    A group is eight dimensions; the k-th of them is bit k. Missing dimensions of the last group are 0.
    """
    rows, size = values.shape
    groups = max(1, -(-size // 8))
    span = int(max(values.max(initial=0), -1 - values.min(initial=0)))
    planes = span.bit_length() + 1
    out = np.zeros((rows, planes, groups), dtype=np.uint8)
    for p in range(planes):
        out[:, p, : -(-size // 8)] = np.packbits((values >> p & 1).astype(np.uint8), axis=1, bitorder="little")
    return out


def unpacked(planes: np.ndarray, size: int) -> np.ndarray:
    """The integers of `packed_planes`."""
    bits = np.unpackbits(planes, axis=2, count=size, bitorder="little").astype(np.int64)
    weight = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    weight[-1] = -weight[-1]
    return np.einsum("rpd,p->rd", bits, weight)


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables ``(groups, 256, anchors)``: the sum of an anchor's dimensions that a byte names."""
    count, size = anchors.shape
    groups = max(1, -(-size // 8))
    wide = np.zeros((count, groups * 8), dtype=np.int64)
    wide[:, :size] = anchors
    by_group = wide.reshape(count, groups, 8).transpose(1, 2, 0)
    tables = np.zeros((groups, 256, count), dtype=np.int64)
    for k in range(8):
        tables[:, 1 << k : 2 << k] = tables[:, : 1 << k] + by_group[:, k : k + 1]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products ``(candidates, anchors)`` from the tables and the candidates' bytes.

    One lookup a group and plane; planes are shifted and added from the highest, which is negative.
    """
    rows, count, groups = planes.shape
    reach = int(np.abs(tables).max(initial=0)) * groups << count
    if reach < 1 << 31:
        tables = tables.astype(np.int32)
    total = np.zeros((rows, tables.shape[2]), dtype=tables.dtype)
    found = np.empty_like(total)
    for p in range(count - 1, -1, -1):
        if p == count - 2:
            np.negative(total, out=total)
        total <<= 1
        for g in range(groups):
            np.take(tables[g], planes[:, p, g], axis=0, out=found, mode="clip")
            total += found
    return -total if count == 1 else total


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores; equal ones in their order."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.argsort(-score[at], kind="stable")[:k]]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(row, id, label, asks, v)``, ``v`` as doubles, to packed rows; rows too long for 64-bit scores go."""
    names = ["row", "id", "label", "asks", "size", "planes"]
    for batch in batches:
        sizes = pc.list_value_length(batch.column("v")).to_numpy()
        for size in np.unique(sizes):
            own = batch.filter(pa.array(sizes == size))
            values = np.asarray(own.column("v").flatten(), dtype=np.float64).reshape(own.num_rows, size)
            real = np.floor(256 * values)
            fits = (real * real).sum(axis=1) < _MOST_ENERGY
            own, real = own.filter(pa.array(fits)), real[fits].astype(np.int64)
            if own.num_rows:
                packed = [r.tobytes() for r in packed_planes(real)]
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in names[:4]), pa.array([size] * len(packed), pa.int32()), pa.array(packed, pa.binary())],
                    names,
                )


def _planes(table: pa.Table, size: int) -> np.ndarray:
    """Packed rows of one length as one array; rows of fewer planes repeat their sign."""
    groups = max(1, -(-size // 8))
    data = table.column("planes").to_pylist()
    counts = np.array([len(d) for d in data]) // groups
    out = np.empty((len(data), counts.max(), groups), dtype=np.uint8)
    for n in np.unique(counts):
        at = np.flatnonzero(counts == n)
        own = np.frombuffer(b"".join([data[i] for i in at]), dtype=np.uint8).reshape(len(at), n, groups)
        out[at, :n] = own
        out[at, n:] = own[:, -1:]
    return out


def _in_cells(pick: Callable[..., Iterator[tuple]], names: list[str]):
    """Score a cell's anchors (left) and candidates (right), and keep what ``pick`` takes of each anchor's scores.

    ``pick(anchor row, its scores, candidates)`` yields ``(positions, *values)``.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        # The order of equal scores; a null id comes last.
        right = right.sort_by([("id", "ascending"), ("row", "ascending")])
        for size in np.intersect1d(left.column("size").to_numpy(), right.column("size").to_numpy()):
            anchors = left.filter(pc.equal(left.column("size"), pa.scalar(size, pa.int32()))).to_pylist()
            candidates = right.filter(pc.equal(right.column("size"), pa.scalar(size, pa.int32()))).combine_chunks()
            row, label = (candidates.column(c).to_numpy() for c in ("row", "label"))
            planes = _planes(candidates, int(size))
            for at in range(0, len(anchors), _TABLE_ANCHORS):
                some = anchors[at : at + _TABLE_ANCHORS]
                own = _planes(pa.table({"planes": [a["planes"] for a in some]}), int(size))
                tables = subset_sums(unpacked(own, int(size)))
                got = np.empty((len(some), len(row)), dtype=np.int64)
                for begin in range(0, len(row), _ROWS):
                    got[:, begin : begin + _ROWS] = scores(tables, planes[begin : begin + _ROWS]).T
                for anchor, score in zip(some, got):
                    for kept, *values in pick(anchor, score, row, label):
                        if len(kept):
                            filled = [np.full(len(kept), v, dtype=np.int64) for v in (anchor["row"], *values)]
                            ids = candidates.column("id").take(pa.array(kept))
                            out.append([*filled, row[kept], score[kept], ids])
        if not out:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        numbers = [pa.array(np.concatenate(c)) for c in list(zip(*out))[:-1]]
        ids = pa.chunked_array([c for o in out for c in o[-1].chunks], pa.int64())
        return pa.table([*numbers, ids], names=names)

    return run


def _nearest_alike(k: int):
    def pick(anchor: dict, score: np.ndarray, row: np.ndarray, label: np.ndarray) -> Iterator[tuple]:
        alike = np.flatnonzero((label == anchor["label"]) & (row != anchor["row"]))
        yield (alike[_first(score[alike], k)],)

    return pick


def _nearest_unlike(k: int, low: int, high: int):
    def pick(anchor: dict, score: np.ndarray, row: np.ndarray, label: np.ndarray) -> Iterator[tuple]:
        unlike = np.flatnonzero(label != anchor["label"])
        own = score[unlike]
        for positive in anchor["positives"]:
            least, most = -(-low * positive // 100), high * positive // 100
            near = np.flatnonzero((own >= least) & (own <= most))
            yield unlike[near[_first(own[near], k)]], positive

    return pick


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite, F.lit(False))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cell_candidates: int = CELL_CANDIDATES,
    cell_anchors: int = CELL_ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of all anchors.

    Components become ``floor(256 * x)``; a score is the integer inner product with the anchor.
    ``anchors`` says which rows of ``vectors`` ask. An anchor's positives are its first ``positives`` other
    rows of its label; a positive's negatives are the first ``negatives`` rows of other labels whose
    score is from ``low`` to ``high`` per cent of the positive's. Higher scores come first, then smaller
    ids, a null id last.

    Every row is indexed as the packed bytes of its bit planes. Anchors and candidates are cut in pieces
    of bounded size that meet in cells, a task each: there the tables of a few anchors at a
    time score all the candidates, and each anchor keeps its best. A window over what the cells kept
    makes the final choice, first of the positives, then of the negatives.

    Rows with a null label, vector or component or one that is not finite take no part, nor do
    vectors so long that scores could leave 64 bits (squared length of 2**62 and more). Vectors of different
    lengths never meet; empty ones meet with score 0. Rows that share an id are told apart: a copy of
    an anchor can be its positive. Further columns are not read. No anchors or an empty table give no rows.
    """
    spark = vectors.sparkSession
    plain = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    )
    usable = plain.where(F.col("label").isNotNull() & _usable(F.col("v")))
    packed = usable.mapInArrow(_index, "row long, id long, label long, asks boolean, size int, planes binary")
    index = stage(packed, "negatives_index")
    counts = index.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-counts[1] // cell_anchors))
    down = max(1, -(-counts[0] // cell_candidates), -(-2 * parts // across))
    cells = max(parts, min(across * down, 4 * parts))
    rows = index.select(
        F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j"),
        F.pmod(F.xxhash64("row"), F.lit(down)).alias("i"), "row", "id", "label", "size", "planes",
    )
    cell = (F.col("i") * across + F.col("j")).alias("cell")
    candidates = rows.select(cell, "row", "id", "label", "size", "planes").repartition(cells, "cell")

    def asked(frame: DataFrame, *more: str) -> DataFrame:
        dealt = frame.select(
            F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"),
            F.pmod(F.xxhash64("row"), F.lit(across)).alias("j"), "row", "label", "size", "planes", *more,
        )
        return dealt.select(cell, "row", "label", "size", "planes", *more).repartition(cells, "cell")

    def best(found: DataFrame, by: list[str], most: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    asking = stage(index.where("asks"), "negatives_anchors")
    names = ["row", "other", "score", "id"]
    near = asked(asking).groupBy("cell").cogroup(candidates.groupBy("cell"))
    near = near.applyInArrow(_in_cells(_nearest_alike(positives), names), "row long, other long, score long, id long")
    alike = stage(best(near, ["row"], positives), "negatives_positives")
    wanted = alike.groupBy("row").agg(F.collect_set("score").alias("positives"))  # at most ``positives`` numbers
    names = ["row", "positive", "other", "score", "id"]
    far = asked(asking.join(wanted, "row"), "positives").groupBy("cell").cogroup(candidates.groupBy("cell"))
    far = far.applyInArrow(
        _in_cells(_nearest_unlike(negatives, low, high), names),
        "row long, positive long, other long, score long, id long",
    )
    unlike = best(far, ["row", "positive"], negatives).select(
        "row", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    chosen = alike.select("row", F.col("score").alias("positive"), F.col("id").alias("positive_id"))
    return (
        unlike.join(chosen, ["row", "positive"])
        .join(asking.select("row", F.col("id").alias("anchor_id")), "row")
        .select(
            "anchor_id", "positive_id", "rank", "negative_id", F.col("positive").alias("positive_score"), "negative_score"
        )
    )

