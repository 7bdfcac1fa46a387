"""Merkle tree over a dataset's rows, with proofs expanded from one multiproof per leaf partition."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewell.operators.joins import lookup_join
from pagewell.session import stage

# A block of 2**BLOCK_BITS neighbouring leaves is folded in one task; so are as many nodes of a level above.
BLOCK_BITS = 10
# Leaves of a leaf partition: whole blocks that begin within so many rows.
PARTITION_ROWS = 1 << 15
_OUT_ROWS = 2048
# The tree over the subroots, in columns that otherwise hold a run's number.
_TOP = -1
_NODES = "tree long, size long, level int, idx long, digest string"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def leaf_digest(*columns: Column) -> Column:
    """Digest of values: each is ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for column in columns:
        value = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings of a proof, level by level and left to right."""
    steps = F.transform(proof, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(steps, "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """Root that ``leaf`` gives with the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def _parent(nodes: str) -> str:
    return hashlib.sha256(nodes.encode()).hexdigest()


def height(size: int) -> int:
    """Levels above the leaves until one node is left."""
    return max(0, size - 1).bit_length()


def missing_nodes(present: np.ndarray, size: int, level: int = 0) -> list[tuple[int, int]]:
    """Least set of ``(level, index)`` that, with the ``present`` nodes of ``level``, gives the root.

    ``size`` nodes stand on that level. All arms are climbed together: nodes whose sibling is
    present or derived below ask for nothing, and a shared parent is climbed from once.
    """
    out = []
    while size > 1:
        sibling = np.setdiff1d(present ^ 1, present, assume_unique=True)
        out += [(level, int(i)) for i in sibling[sibling < size]]
        present, size, level = np.unique(present >> 1), (size + 1) // 2, level + 1
    return out


def climb(present: dict[int, str], top: int, given: dict[int, dict[int, str]]) -> list[dict[int, str]]:
    """Nodes by index, level by level up to ``top``; ``given`` has the missing siblings by level."""
    levels: list[dict[int, str]] = []
    while True:
        known = present | given.get(len(levels), {})
        levels.append(known)
        if len(levels) > top:
            return levels
        present = {i: _parent(known[2 * i] + known.get(2 * i + 1, "")) for i in {j >> 1 for j in present}}


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches with equal keys."""
    n = len(keys[0])
    if n:
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        yield from zip(np.r_[0, cut].tolist(), np.r_[cut, n].tolist())


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _folded_blocks(bits: int, every_level: bool, level: int):
    """Nodes of one level, whole blocks of ``2**bits``, to the nodes ``bits`` levels above, or to all in between."""

    def run(table: pa.Table) -> Iterator[tuple]:
        table = table.sort_by([("tree", "ascending"), ("idx", "ascending")])
        tree, size, idx = _columns(table, "tree", "size", "idx")
        digest = table.column("digest").to_pylist()
        for a, b in _runs(tree, idx >> bits):
            top = min(bits, height(int(size[a])))
            levels = climb(dict(zip(idx[a:b].tolist(), digest[a:b])), top, {})
            width = int(size[a])
            for up, nodes in enumerate(levels):
                if up == top or every_level and up:
                    for i, d in nodes.items():
                        yield int(tree[a]), width, level + up, i, d
                width = (width + 1) // 2

    return run


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_NODE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
_NODE_NAMES = ["tree", "size", "level", "idx", "digest"]


def _asked(trees: int, bits: int):
    """One leaf partition to its blocks' roots (``part`` null) and the coordinates that it lacks (``digest`` null)."""
    fold = _folded_blocks(bits, False, 0)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part = table.column("part")[0].as_py()
        rows = [(None, *node) for node in fold(table.select(["tree", "size", "idx", "digest"]))]
        blocks = defaultdict(list)
        for _, tree, width, level, i, _ in rows:
            blocks[tree, width, level].append(i)
        asked = []
        for (tree, width, level), idx in blocks.items():
            asked += [(tree, at, i) for at, i in missing_nodes(np.unique(idx), width, level)]
        own = np.unique([tree for tree, _, _ in blocks])
        asked += [(_TOP, at, i) for at, i in missing_nodes(own, trees)]
        rows += [(part, tree, None, at, i, None) for tree, at, i in asked]
        return _table(rows, ["part", *_NODE_NAMES], [pa.int64(), *_NODE_TYPES])

    return run


def _upper(bits: int, level: int):
    def run(table: pa.Table) -> pa.Table:
        return _table(list(_folded_blocks(bits, True, level)(table)), _NODE_NAMES, _NODE_TYPES)

    return run


def _steps(levels: list[dict[int, str]], at: int) -> list[tuple[str, str]]:
    """Siblings of a leaf's path, as what stands left and right of it."""
    out = []
    for nodes in levels[:-1]:
        other = nodes.get(at ^ 1, "")
        out.append((other, "") if at & 1 else ("", other))
        at >>= 1
    return out


def _expanded(table: pa.Table, trees: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of one leaf partition, its leaves and the nodes it fetched, to its leaves with their proofs."""
    fetched = table.filter(pc.is_valid(table.column("level")))
    given: dict[int, dict[int, dict[int, str]]] = defaultdict(lambda: defaultdict(dict))
    for tree, level, i, d in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
        given[tree][level][i] = d
    leaves = table.filter(pc.is_null(table.column("level"))).sort_by([("tree", "ascending"), ("idx", "ascending")])
    tree, size, idx = _columns(leaves, "tree", "size", "idx")
    digest = leaves.column("digest").to_pylist()
    climbed, bounds = {}, list(_runs(tree))
    for a, b in bounds:
        own = dict(zip(idx[a:b].tolist(), digest[a:b]))
        climbed[int(tree[a])] = climb(own, height(int(size[a])), given[int(tree[a])])
    subroots = {t: levels[-1][0] for t, levels in climbed.items()}
    top = climb(subroots, height(trees), given[_TOP])
    root = top[-1][0]
    rows = leaves.column("row").combine_chunks()
    for a, b in bounds:
        levels, above = climbed[int(tree[a])], _steps(top, int(tree[a]))
        for at in range(a, b, _OUT_ROWS):
            end = min(b, at + _OUT_ROWS)
            steps = [_steps(levels, i) + above for i in idx[at:end].tolist()]
            ends = np.cumsum([0, *map(len, steps)], dtype=np.int32)
            sides = list(zip(*(s for each in steps for s in each))) or [(), ()]
            flat = pa.StructArray.from_arrays([pa.array(s, pa.string()) for s in sides], fields=list(_STEP))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.slice(at, end - at), pa.array(digest[at:end]), pa.array(idx[at:end]), pa.array(size[at:end]),
                    pa.array([subroots[int(tree[a])]] * (end - at)), pa.array([root] * (end - at)),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                ],
                schema=schema,
            )


def _expand(trees: int):
    """Rows sorted by ``part``, each part's leaves and fetched nodes, to leaves with proofs; one part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part = schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _expanded(pa.Table.from_batches(held).combine_chunks(), trees, schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    [("row", batch.schema.field("row").type), ("leaf", pa.string()), ("position", pa.int64()),
                     ("size", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(_STEP))]
                )
            for a, b in _runs(batch.column("part").to_numpy()):
                if batch.column("part")[a].as_py() != part:
                    yield from flush()
                    held, part = [], batch.column("part")[a].as_py()
                held.append(batch.slice(a, b - a))
        yield from flush()

    return run


def _sorted(rows: DataFrame, keys: list[str], parts: int, label: str) -> DataFrame:
    """Rows in the order of ``keys`` over written range partitions: ``part`` and ``at``, the row's place in that order of parts."""
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    return stage(ordered.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), label)


def _ranked_trees(trees: DataFrame, parts: int) -> DataFrame:
    """``(run, size, tree, before)``: number in the order of ``run`` and leaves of the runs before."""
    ordered = _sorted(trees, ["run"], parts, "merkle_runs")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range partition, which the number of partitions bounds.
    sums = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    sums = sums.select(
        "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(order), F.lit(0)).alias("s")
    )
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
        .join(sums, "part")
        .select(
            "run", "size", (F.col("n") + F.col("at") - F.shiftleft("part", 33)).alias("tree"),
            (F.col("s") + F.col("own")).alias("before"),
        )
    )


def merkle_proofs(
    rows: DataFrame,
    run_col: str,
    id_col: str,
    leaf_col: str = "leaf",
    block_bits: int = BLOCK_BITS,
    partition_rows: int = PARTITION_ROWS,
) -> DataFrame:
    """Every row of ``rows`` with its place in the dataset's Merkle tree and its proof.

    ``leaf_col`` holds a digest as hex text, for instance of `leaf_digest`. The rows of a ``run_col``
    value are a tree's leaves by ascending ``id_col``; every two neighbours have the digest of their
    concatenated digests as parent, and a last one without neighbour that of its own. Roots of the
    runs, null first and then by bytes, are the leaves of a like tree.

    Columns: ``row`` (the given row as a struct, so that no name can clash), ``leaf, position,
    size`` (of its run), ``subroot, root`` and ``proof``, an array of ``(left, right)`` from the leaf to the root:
    the digests beside the path on that level, empty where none stands. `folded` and
    `proof_digest` take it.

    A leaf partition is a stretch of whole blocks of neighbouring leaves, of runs small and large. It
    folds its blocks, finds the least union of coordinates that all its paths lack, fetches these
    in one join, derives the interiors its paths share once, and cuts each proof out of them.
    No run is ever in one task: a task holds a partition's leaves and its share of the levels above.

    Null ids come first, rows of equal id by digest; equal rows stand side by side in any order, and
    a null digest counts as empty text. A null run is a run. Long texts matter to the digest
    alone. An empty table gives no rows.
    """
    spark = rows.sparkSession
    columns = [F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")]
    leaves = stage(
        rows.select(
            *columns,
            F.coalesce(F.concat(F.lit("="), F.col(run_col).cast("string")), F.lit("")).alias("run"),
            F.col(id_col).alias("id"),
            F.coalesce(F.col(leaf_col), F.lit("")).alias("digest"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "merkle_leaves",
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() >> 20))
    ordered = _sorted(leaves, ["run", "id", "digest", "tie"], parts, "merkle_order")
    shares = ordered.groupBy("part", "run").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    shares = stage(shares, "merkle_shares")
    trees = _ranked_trees(shares.groupBy("run").agg(F.sum("n").alias("size")), parts)
    trees = stage(trees, "merkle_trees")
    before = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start"))
    shares = shares.join(trees, "run").select("part", "run", "base", "size", "tree", "before")
    block = F.shiftleft(F.shiftright("idx", block_bits), block_bits)
    placed = stage(
        lookup_join(ordered, shares, ["part", "run"], ["tie"])
        .withColumn("idx", F.col("base") + F.col("at"))
        .select(
            F.floor((F.col("before") + block) / F.lit(partition_rows)).alias("part"), "tree", "size", "idx", "digest", "row"
        ),
        "merkle_placed",
    )
    totals = trees.agg(F.count(F.lit(1)), F.max("size")).first()
    count, largest = totals[0], totals[1] or 0

    asked = stage(
        placed.select("part", "tree", "size", "idx", "digest").groupBy("part").applyInArrow(_asked(count, block_bits), f"part long, {_NODES}"),
        "merkle_asked",
    )
    nodes = asked.where("part is null").drop("part")
    found = [nodes]

    def folded_up(low: DataFrame, level: int, size: int) -> list[DataFrame]:
        """Levels above ``low`` until trees of ``size`` leaves have ended; a level in blocks, a group each."""
        out = []
        while height(size) > level:
            high = low.where("size > 1").groupBy("tree", F.shiftright("idx", block_bits).alias("block")).applyInArrow(_upper(block_bits, level), _NODES)
            out.append(stage(high, "merkle_level"))
            level += block_bits
            low = out[-1].where(F.col("level") == level)
        return out

    found += folded_up(nodes.where(F.col("level") == block_bits), block_bits, largest)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    top = every.where("size = 1").select(
        F.lit(_TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), F.lit(0).alias("level"),
        F.col("tree").alias("idx"), "digest",
    )
    top = stage(top, "merkle_subroots")
    for more in [top, *folded_up(top, 0, count)]:
        every = every.unionByName(more)
    lacking = asked.where("part is not null").select("part", "tree", "level", "idx")
    fetched = lookup_join(lacking, every.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"], ["part"])
    both = placed.withColumn("level", F.lit(None).cast("int")).unionByName(fetched, allowMissingColumns=True)
    both = both.repartition(parts, "part").sortWithinPartitions("part")
    out = T.StructType([T.StructField("row", placed.schema["row"].dataType)])
    for name, kind in (("leaf", "string"), ("position", "long"), ("size", "long"), ("subroot", "string"), ("root", "string")):
        out.add(name, kind)
    out.add("proof", T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])))
    return both.select("part", "tree", "size", "idx", "digest", "level", "row").mapInArrow(_expand(count), out)
