"""Near-duplicate vectors by cosine: tiles in the order of the leading principal component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewell.llm.components import components, join_roots
from pagewell.session import stage

# Vectors per tile; a task compares two tiles at most.
TILE = 4096
# Leading dimensions after which pairs are given up.
_STEPS = (16, 32)
_ROWS = 1024
_PAIRS = 1 << 15
# Margin of the single-precision bounds; every link is checked in double precision.
_SLACK = 1e-4


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def principal_axes(nodes: DataFrame, size: int) -> np.ndarray:
    """Axes of the vectors of length ``size`` by falling energy, as columns; the driver holds size**2 numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            unit = _unit(batch.column(0))
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    parts = nodes.select("v").mapInArrow(partial, "m array<double>")
    cells = parts.select(F.posexplode("m").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    moment = np.zeros(size * size)
    moment[[r["at"] for r in cells]] = [r["x"] for r in cells]
    moment = moment.reshape(size, size)
    return np.linalg.eigh((moment + moment.T) / 2)[1][:, ::-1].copy()


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, within: bool) -> Iterator[tuple]:
    """Index arrays ``(i, j)`` of the rows of ``a`` and ``b`` with cosine at least ``threshold``.

    Products of the leading dimensions come first. The rest of a product is at most the product of
    the suffix norms, which rides along as one more dimension; a pair goes on only
    while that bound reaches the threshold. With ``within`` the tiles are one and i < j.
    """
    size = a.shape[1]
    steps = [s for s in _STEPS if s < size] or [size]
    turned_a, turned_b = a @ axes, b @ axes
    rest = [
        [np.sqrt(np.maximum(0, (t[:, s:] ** 2).sum(axis=1))) for t in (turned_a, turned_b)] for s in steps
    ]
    lead_a = np.c_[turned_a[:, : steps[0]], rest[0][0]].astype(np.float32)
    lead_b = np.c_[turned_b[:, : steps[0]], rest[0][1]].astype(np.float32).T.copy()
    for at in range(0, len(a), _ROWS):
        rows, cols = np.nonzero(lead_a[at : at + _ROWS] @ lead_b >= threshold - _SLACK)
        rows += at
        if within:
            below = rows < cols
            rows, cols = rows[below], cols[below]
        for part in range(0, len(rows), _PAIRS):
            i, j = rows[part : part + _PAIRS], cols[part : part + _PAIRS]
            known = np.einsum("ij,ij->i", turned_a[i, : steps[0]], turned_b[j, : steps[0]])
            for k in range(1, len(steps)):
                known += np.einsum(
                    "ij,ij->i", turned_a[i, steps[k - 1] : steps[k]], turned_b[j, steps[k - 1] : steps[k]]
                )
                far = known + rest[k][0][i] * rest[k][1][j] >= threshold - _SLACK
                i, j, known = i[far], j[far], known[far]
            near = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
            yield i[near], j[near]


def _tile_links(axes: np.ndarray, threshold: float):
    """Rows ``(tile, node, n, v)`` of two tiles to link counts ``(u, null, n)`` and edges ``(u, v, 0)``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tile = table.column("tile").to_numpy()
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        unit = _unit(table.column("v").chunk(0)) if len(tile) else np.empty((0, len(axes)))
        split = int(table.column("low").to_numpy()[0]), int(table.column("high").to_numpy()[0])
        left = np.flatnonzero(tile == split[0])
        right = left if split[0] == split[1] else np.flatnonzero(tile == split[1])
        count, root = np.zeros(len(tile), dtype=np.int64), np.arange(len(tile))
        if len(left) and len(right):
            for i, j in linked_pairs(unit[left], unit[right], axes, threshold, split[0] == split[1]):
                i, j = left[i], right[j]
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                root = join_roots(root, i, j)
        has, moved = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(root)))
        return pa.table(
            {
                "u": pa.array(np.r_[node[has], node[moved]]),
                "v": pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(node[root[moved]])]),
                "n": pa.array(np.r_[count[has], np.zeros(len(moved), dtype=np.int64)]),
            }
        )

    return run


def _links_of_size(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """Link counts and edges ``(u, v, n)`` among the distinct vectors of one length."""
    spark = nodes.sparkSession
    axes = principal_axes(nodes, size)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = _unit(batch.column(2)) @ axes[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], ["node", "n", "v", "lead"])

    kind = nodes.schema["v"].dataType.simpleString()
    placed = stage(nodes.select("node", "n", "v").mapInArrow(first, f"node long, n long, v {kind}, lead double"), "leads")
    groups = max(1, -(-placed.count() // TILE))
    cuts = placed.approxQuantile("lead", [i / groups for i in range(1, groups)], 0.1 / groups) if groups > 1 else []
    at = np.array(sorted(set(cuts)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.searchsorted(at, batch.column(3).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group)], [*batch.schema.names, "group"])

    grouped = stage(
        placed.mapInArrow(assign, f"node long, n long, v {kind}, lead double, group int"), "groups"
    )
    tiles, number = [], 0
    for r in sorted(
        grouped.groupBy("group").agg(F.count(F.lit(1)).alias("c"), F.min("lead").alias("low"), F.max("lead").alias("high")).collect(),
        key=lambda r: r["group"],
    ):
        parts = -(-r["c"] // (2 * TILE))  # many vectors with one leading value
        for _ in range(parts):
            tiles.append((r["group"], number, parts, r["low"], r["high"]))
            number += 1
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9  # linked unit vectors are at most that far apart
    lows, highs = np.array([t[3] for t in tiles]), np.array([t[4] for t in tiles])
    rows, seen = [], set()
    for g, at, parts, low, high in tiles:
        if g not in seen:
            seen.add(g)
            begin = int(np.searchsorted(highs, low - reach))
            rows.append((g, at, parts, begin, int(np.searchsorted(lows, high + reach, side="right")) - 1))
    table = spark.createDataFrame(rows, "group int, tile int, parts int, begin int, end int")
    dealt = (
        grouped.join(table, "group")
        .withColumn("tile", F.col("tile") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .select("tile", "node", "n", "v", F.explode(F.sequence("begin", "end")).alias("other"))
        .select(F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "n", "v")
    )
    return dealt.groupBy("low", "high").applyInArrow(_tile_links(axes, threshold), "u long, v long, n long")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per row ``<id_col>, n_links, component_id, kept`` of vectors linked by cosine ``>= threshold``.

    ``n_links`` counts the other rows linked directly, copies among them; ``component_id`` is the
    smallest id reachable. Vectors that are null, zero or hold null or non-finite numbers link
    with nothing, nor do vectors of different lengths; such a row is its own component. Rows with
    a null id are linked too; a component without any id is null and its rows are not kept. An empty
    table gives no rows. ``threshold`` is above 0.

    Equal vectors are compared once. Tiles of distinct vectors are cut along the leading principal axis;
    tiles too far apart on it never meet, and all others meet in pairs, a task each.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    usable = rows.where(_usable(F.col("v")))
    nodes = stage(
        usable.groupBy("v")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    sizes = sorted(r[0] for r in nodes.select(F.size("v")).distinct().collect())
    found = None
    for size in sizes:
        part = _links_of_size(nodes.where(F.size("v") == size), size, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "u long, v long, n long")
    found = stage(found, "vector_links")
    links = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("v is not null").select("u", "v"))
    placed = (
        nodes.join(links, "node", "left")
        .join(roots, "node", "left")
        .select("v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    placed = stage(placed, "vector_groups")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = placed.join(least, "root").select("v", "n_links", "component_id")
    joined = rows.withColumn("ok", _usable(F.col("v")))
    alone = joined.where(~F.col("ok")).select(
        F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    linked = joined.where("ok").join(groups, "v").select(F.col("id").alias(id_col), "n_links", "component_id")
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
