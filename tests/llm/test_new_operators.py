"""Merkle proofs, pattern packing and hard negatives against brute force on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewell.llm.byte_tokens import ByteTokenizer
from pagewell.llm.catalog import op12_pattern_packing, op13_merkle_manifest
from pagewell.llm.hard_negatives import hard_negatives, packed_planes, scores, subset_sums, unpacked
from pagewell.llm.merkle import folded, merkle_proofs, missing_nodes, proof_digest
from pagewell.llm.pattern_packing import Slots, best_fit, full_patterns, pack_plan, pattern_pack
from tests.llm.conftest import messy_rows

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- merkle

def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(leaves):
    """Root and each leaf's (left, right) steps."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[i : i + 2])) for i in range(0, len(low), 2)])
    proofs = []
    for i in range(len(leaves)):
        steps = []
        for low in levels[:-1]:
            other = low[i ^ 1] if i ^ 1 < len(low) else ""
            steps.append((other, "") if i & 1 else ("", other))
            i >>= 1
        proofs.append(steps)
    return levels[-1][0], proofs


def slow_proofs(rows):
    """Counter of (run, id, leaf, subroot, root, steps) for rows (run, id, leaf)."""
    runs = defaultdict(list)
    for run, key, leaf in rows:
        runs[run].append((key is not None, key or 0, leaf, key))
    order = sorted(runs, key=lambda r: (r is not None, (r or "").encode()))
    low = {run: slow_tree([x[2] for x in sorted(runs[run], key=lambda x: x[:3])]) for run in order}
    root, above = slow_tree([low[run][0] for run in order])
    out = Counter()
    for run, up in zip(order, above):
        for x, steps in zip(sorted(runs[run], key=lambda x: x[:3]), low[run][1]):
            out[run, x[3], x[2], low[run][0], root, tuple(steps + up)] += 1
    return out


@pytest.mark.parametrize("bits,width", [(1, 3), (2, 16), (10, 1 << 15)])
def test_proofs_of_runs_of_all_sizes(spark, bits, width):
    rng = random.Random(bits)
    sizes = {None: 7, "": 1, "a": 70, "b": 1, "é": 33, "z\U0001f600": 64, "~": 2, **{f"r{i}": 1 + i % 3 for i in range(20)}}
    rows = [(run, k, digest(f"{run} {k}")) for run, n in sizes.items() for k in range(n)]
    rows += [("a", None, digest("n1")), ("a", None, digest("n2")), ("a", 5, digest("again")), ("a", 6, digest("a 6"))]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "run string, key long, leaf string, part string, `a b` int")
    got = merkle_proofs(frame.repartition(5), "run", "key", block_bits=bits, partition_rows=width)
    found = got.select("row.run", "row.key", "leaf", "subroot", "root", "proof").collect()
    assert Counter((*r[:5], tuple(map(tuple, r["proof"]))) for r in found) == slow_proofs(rows)
    back = got.select((folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"), "row.part", F.col("row.`a b`").alias("c"))
    assert {tuple(r) for r in back.collect()} == {(True, "x", 1)}


def test_a_multiproof_asks_for_nothing_it_can_derive():
    assert missing_nodes(np.arange(8), 8) == []
    assert missing_nodes(np.array([2, 3]), 8) == [(1, 0), (2, 1)]
    assert missing_nodes(np.array([0, 7]), 8) == [(0, 1), (0, 6), (1, 1), (1, 2)]
    assert missing_nodes(np.array([4]), 5) == [(2, 0)]
    assert missing_nodes(np.array([0]), 1) == []


def test_merkle_query_finds_the_tampered_rows(spark, messy, tmp_path):
    def value(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    messy.write.parquet(str(tmp_path / "documents.parquet"))
    rows, changed = [], {}
    for key, text, lang, source, n, *_ in messy_rows():
        leaf = digest("".join(map(value, (key, source, lang, n, text))))
        rows.append((lang, key, leaf))
        more = digest("".join(map(value, (key, source, lang, n + 1, text))))
        changed[leaf] = more if key is not None and zlib.crc32(str(key).encode()) % 7 == 0 else leaf
    want = Counter()
    for (_, key, leaf, subroot, root, steps), many in slow_proofs(rows).items():
        node = changed[leaf]
        for left, right in steps:
            node = digest(left + node + right)
        beside = digest("".join(a + b for a, b in steps))
        want[key, leaf, subroot, root, beside, node, node == root] += many
    got = op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(map(tuple, got.collect()))
    assert found == want and {r[-1] for r in found} == {True, False}


def test_merkle_of_nothing_and_of_one(spark, none):
    rows = none.select("doc_id", "lang", F.lit("x").alias("leaf"))
    assert merkle_proofs(rows, "lang", "doc_id").count() == 0
    one = merkle_proofs(spark.createDataFrame([(None, None, None)], "k long, run string, leaf string"), "run", "k")
    r = one.select("leaf", "subroot", "root", "proof", proof_digest(F.col("proof")).alias("p")).first()
    assert tuple(r) == ("", "", "", [], digest(""))


# --- pattern packing

def test_byte_tokenizer_agrees_with_the_library():
    own, theirs = ByteTokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    assert own._ranks is not None
    texts = [r[1] or "" for r in messy_rows()]
    texts += ["<|endoftext|><|endoftext|> a<|endoftext|>\n", "'S don't  we'll   \n\n x\t\ty ", "İßé漢字ﬁ ǅ 123,456  a b\x00ć",
              "\U0001f600\U0001f1e9 x٣²", "a" * 50_000, " " * 30_000 + "b", "ab" * 20_000, "\r\n" * 3000, "!?" * 9000]
    for text in texts:
        assert own.ids(text) == np.array(theirs.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_plans_hold_each_document_once():
    rng = np.random.default_rng(4)
    for capacity, lengths in ((1, [1, 1]), (12, [12, 6, 6, 5, 4, 3, 1, 1]), (64, rng.integers(1, 65, 4000)), (100, [51] * 30), (50, [])):
        counts = np.bincount(np.array(lengths, dtype=int), minlength=capacity + 1)
        plan = pack_plan(counts, capacity)
        used = Counter()
        for pattern, many in plan:
            assert many > 0 and 0 < sum(pattern) <= capacity
            for n in pattern:
                used[n] += many
        assert all(used[n] == counts[n] for n in range(capacity + 1))
        least = -(-int(sum(lengths)) // capacity)
        assert sum(many for _, many in plan) <= (30 if capacity == 100 else math.ceil(1.02 * least))
        slots, ends = Slots(plan), defaultdict(list)
        for n in np.flatnonzero(counts):
            for s, o in zip(*slots.place(np.full(counts[n], n), np.arange(counts[n]))):
                ends[s].append((o, o + n))
        assert len(ends) == sum(many for _, many in plan)
        for spans in ends.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity


def test_patterns_fill_the_capacity():
    got = {tuple(p) for p in full_patterns(12, np.array([n in (2, 3, 5, 7, 12) for n in range(13)]))}
    assert got == {(12, 0, 0), (7, 5, 0), (7, 3, 2), (5, 5, 2)}
    assert best_fit(np.array([0, 4, 0, 2, 1]), 4) == Counter({(4,): 1, (3, 1): 2, (1, 1): 1})


def want_pieces(rows, capacity):
    theirs, want = Tokenizer.from_file(VOCABULARY), Counter()
    for key, text in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [2]
        ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
        for piece, stop in enumerate(ends):
            start = max(0, stop - capacity) if piece else 0
            want[key, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], dtype="<u4").tobytes())] += 1
    return want


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pattern_packing_covers_every_id_once(spark, messy, tmp_path, capacity):
    if capacity == 1024:
        messy.write.parquet(str(tmp_path / "documents.parquet"))
        packed = op12_pattern_packing(spark, str(tmp_path))
    else:
        packed = pattern_pack(messy, VOCABULARY, capacity=capacity).withColumn("ids_crc32", F.crc32("ids"))
    rows = packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()
    want = want_pieces([r[:2] for r in messy_rows()], capacity)
    assert Counter(tuple(r)[:5] for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        end = 0
        for offset, n in sorted(spans):
            assert offset == end
            end += n
        assert end <= capacity
    total = sum(k[3] * n for k, n in want.items())
    assert len(by_sequence) <= 1.01 * total / capacity + 3


def test_pattern_packing_nothing(none):
    assert pattern_pack(none, VOCABULARY).count() == 0


# --- hard negatives

@pytest.mark.parametrize("size,reach", [(0, 5), (1, 1), (3, 0), (8, 90), (64, 100), (13, 1 << 28)])
def test_scores_are_inner_products(size, reach):
    rng = np.random.default_rng(size)
    a, c = rng.integers(-reach - 1, reach + 1, (5, size)), rng.integers(-reach - 1, reach + 1, (40, size))
    assert (unpacked(packed_planes(c), size) == c).all()
    assert (scores(subset_sums(a), packed_planes(c)) == c @ a.T).all()


def slow_negatives(rows, positives=5, negatives=10):
    """rows (id, vector, label), the moved labels already; anchors have ids divisible by 4."""
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    own = [(i, [math.floor(256 * x) for x in v], lab, n) for n, (i, v, lab) in enumerate(rows) if lab is not None and good(v)]
    own = [r for r in own if sum(x * x for x in r[1]) < 1 << 62]
    out = Counter()

    def first(found, k):
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:k]

    for key, v, label, n in own:
        if key is None or key % 4:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, lab == label) for i, w, lab, m in own if m != n and len(w) == len(v)]
        for score, positive, _ in first([s for s in scored if s[2]], positives):
            near = first([s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score], negatives)
            for rank, (other, negative, _) in enumerate(near, 1):
                out[key, positive, rank, negative, score, other] += 1
    return out


def test_hard_negatives(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-0.2, 0.9) for _ in range(11)], rng.randrange(3)) for i in range(70)]
    same = [0.5] * 11
    rows += [(i, same, i % 2) for i in range(100, 130)] + [(104, same, 0), (None, same, 0), (None, same, 1), (108, same, 1)]
    rows += [(200, None, 1), (204, [0.1] * 10 + [None], 1), (208, [float("nan")] * 11, 1), (212, [math.inf] * 11, 0), (216, same, None)]
    rows += [(220, [0.0] * 11, 0), (221, [0.0] * 11, 0), (222, [0.0] * 11, 1), (224, [], 0), (225, [], 0), (226, [], 1)]
    rows += [(300 + i, [rng.uniform(-1, 1) * 3e6 for _ in range(3)], i % 2) for i in range(12)]
    rows += [(400, [1e300] * 3, 0), (404, [-0.7] * 11, 0), (405, [0.7] * 11, 0)]
    rows = [(i, None if v is None else [None if x is None else x for x in v], lab) for i, v, lab in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame = frame.select("*", *[F.lit("?").alias(c) for c in ("row", "cell", "size", "planes", "asks", "score", "v", "id", "i", "j")])
    for cells in ({}, {"cell_candidates": 20, "cell_anchors": 7}):
        got = hard_negatives(frame.repartition(6), F.col("vec_id") % 4 == 0, **cells)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert Counter(map(tuple, got.collect())) == slow_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    frame = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 0)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(frame, F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives(frame.where("vec_id > 2"), F.col("vec_id") % 100 == 0).count() == 0
