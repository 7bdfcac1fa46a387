"""Each operator against brute force on nulls, empty and long texts, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewell.llm.components import components
from pagewell.llm.embeddings import near_vectors
from pagewell.llm.mixing import mix_sources, shard_draws, source_targets
from pagewell.llm.packing import pack_documents, pack_lengths
from pagewell.llm.quality import fit_rules
from pagewell.llm.simhash import near_pairs, simhash_groups
from pagewell.llm.streaming_dedup import exact_duplicates
from pagewell.llm.substring_dedup import repeated_windows
from pagewell.llm.suffix import repeated_starts, suffix_blocks
from pagewell.llm.suffix_dedup import repeated_bytes
from pagewell.llm.token_counts import TokenTotals, count_tokens
from pagewell.llm.tokens import WordTokenizer
from pagewell.llm.warc import read_warc, write_warc
from tests.llm.conftest import messy_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def groups(nodes, linked):
    """Smallest position reachable from every position."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(nodes))]


# --- packing

def test_tokenizer_agrees_with_the_library():
    own, theirs = WordTokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = [r[1] or "" for r in messy_rows()]
    texts += ["Ángel b́c İ ΑΣ ß <|endoftext|>x\tq\x1cz 12ab x_y é!? don't!!!　x ﬁ ǅ", "naïve,co-op (x) [y]_^`{~} '''s"]
    for text in texts:
        assert own.ids(text) == np.array(theirs.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_covers_every_id_once(messy):
    theirs = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for key, text in pairs(messy_rows()):
        want[key, tuple(theirs.encode(text or "", add_special_tokens=False).ids) + (1,)] += 1
    rows = pack_documents(messy, VOCABULARY, capacity=64, group_bytes=100_000).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] * 4 == len(r["ids"]) and 0 < r["length"] <= 64
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 64
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert len(by_sequence) <= total / 64 + 10
    for (key, ids), n in want.items():
        if n == 1 and len(by_doc[key, len(ids)]) and sum(1 for k in want if k[0] == key and len(k[1]) == len(ids)) == 1:
            data, end = b"", 0
            for r in sorted(by_doc[key, len(ids)], key=lambda r: r["start"]):
                assert r["start"] == end
                data, end = data + r["ids"], end + r["length"]
            assert zlib.crc32(data) == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert sum(r["length"] for r in rows) == total


def test_packing_is_tight_and_balanced():
    rng = random.Random(3)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    packed = pack_lengths(lengths, 100)
    used = defaultdict(int)
    for _, _, n, s, offset in packed:
        assert offset == used[s]
        used[s] += n
    assert len(used) == math.ceil(sum(lengths) / 100) and max(used.values()) <= 100
    assert sum(n for _, _, n, _, _ in packed) == sum(lengths)
    assert pack_lengths([], 100) == []


def test_packing_nothing(none):
    assert pack_documents(none, VOCABULARY).count() == 0


# --- quality

def test_rules_learn_and_score_whole_texts(spark):
    rng = random.Random(2)
    rows = [(i, ("JUNK!! " if i % 2 else "good words here ") * rng.randint(1, 40) + "x" * rng.randint(0, 5)) for i in range(200)]
    rows += [(900, None), (None, "good words here"), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, 1 - i % 2) for i in range(200)] + [(None, 1), (900, None), (7, 1)], "doc_id long, quality int"
    )
    model = fit_rules(docs, labels, penalty=0.01)
    assert model.rules
    scored = docs.select("doc_id", model.score(F.col("text")).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in scored) and len(scored) == len(rows)
    good = [r["s"] for r in scored if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] % 2 == 0]
    bad = [r["s"] for r in scored if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] % 2 == 1]
    assert min(good) > max(bad)


@pytest.mark.parametrize("labelled", [[], [(1, 1), (4, 1)]])
def test_rules_without_two_classes(spark, messy, labelled):
    model = fit_rules(messy, spark.createDataFrame(labelled, "doc_id long, quality int"))
    scores = {r[0] for r in messy.select(model.score(F.col("text"))).collect()}
    assert model.rules == () and len(scores) == 1 and (scores == {0.5} or not labelled == [])


# --- near duplicates by fingerprint

def slow_fingerprint(text):
    tokens = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(messy, none):
    rows = [(k, slow_fingerprint(t)) for k, t in pairs(messy_rows())]
    root = groups([f for _, f in rows], lambda a, b: (a ^ b).bit_count() <= 2)
    least = {r: min((k for (k, _), q in zip(rows, root) if q == r and k is not None), default=None) for r in set(root)}
    want = Counter((k, f"{f:016x}", least[r]) for (k, f), r in zip(rows, root))
    assert Counter(map(tuple, simhash_groups(messy).collect())) == want
    assert simhash_groups(none).count() == 0


def test_bit_planes_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr("pagewell.llm.simhash.TILE", 16)
    rng = random.Random(1)
    fps = {rng.getrandbits(12) << 40 for _ in range(150)} | {0, 3, 7}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for radius in (0, 1, 2, 3):
        ordered = sorted(fps)
        root = groups(ordered, lambda a, b: (a ^ b).bit_count() <= radius)
        got = {r["node"]: r["root"] for r in components(near_pairs(frame, radius)).collect()}
        ours = defaultdict(set)
        for f in ordered:
            ours[got.get(f, f)].add(f)
        theirs = defaultdict(set)
        for f, r in zip(ordered, root):
            theirs[r].add(f)
        assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (0, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[200 + i] for i in range(50)} | {got[100]}) == 1
    assert got[0] != got[100] and len(got) == 92
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- exact duplicates

def want_exact(rows):
    by_text = defaultdict(list)
    for k, t in rows:
        by_text[t or ""].append(k)
    out = Counter()
    for t, keys in by_text.items():
        keep = max(keys, key=lambda k: (k is not None, k or 0))
        for k in keys:
            out[k, keep, len(keys), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("files", [10_000, 1])
def test_exact_duplicates(spark, messy, files):
    rows = exact_duplicates(spark, messy, files_per_batch=files).collect()
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows)
    assert got == want_exact(pairs(messy_rows()))
    kept = [r for r in rows if r["kept"]]
    assert len({r["text_sha256"] for r in kept}) == len(kept) == len({r["text_sha256"] for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_duplicates_compare_bytes_of_equal_digests(spark, messy, monkeypatch):
    monkeypatch.setattr("pagewell.llm.streaming_dedup._digest", lambda text: F.substring(text, 1, 1))
    rows = exact_duplicates(spark, messy).collect()
    want = Counter((k, keep, n) for (k, keep, n, _), c in want_exact(pairs(messy_rows())).items() for _ in range(c))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in rows) == want
    assert exact_duplicates(spark, spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")).where("kept").count() == 1


DERIVED = {
    "where": lambda docs, files: docs.where("doc_id < 9"),
    "text": lambda docs, files: docs.withColumn("text", F.upper("text")),
    "limit": lambda docs, files: docs.limit(9),
    "distinct": lambda docs, files: docs.select("doc_id", "text").distinct(),
    "files": lambda docs, files: docs.sparkSession.read.parquet(*files[:2]),
    "twice": lambda docs, files: docs.sparkSession.read.parquet(*files, files[0]),
    "pattern": lambda docs, files: docs.sparkSession.read.option("pathGlobFilter", "part-00000*").parquet(files[0].rsplit("/", 1)[0]),
}


@pytest.mark.parametrize("kind", list(DERIVED))
def test_exact_duplicates_of_a_derived_table(spark, messy, kind):
    docs = DERIVED[kind](messy, sorted(messy.inputFiles()))
    rows = exact_duplicates(spark, docs).collect()
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows)
    assert rows and got == want_exact(pairs(docs.select("doc_id", "text").collect()))
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows})


def test_exact_duplicates_of_files_that_came_later_are_left_out(spark, tmp_path):
    path = str(tmp_path / "docs")
    for i in range(2):
        spark.createDataFrame([(2 * i, "a"), (2 * i + 1, "b")], "doc_id long, text string").write.mode("append").parquet(path)
        docs = spark.read.parquet(path) if i == 0 else docs
    rows = exact_duplicates(spark, docs).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {(0, 0, 1, True), (1, 1, 1, True)}


def test_exact_copies_of_a_derived_table_are_dropped_in_the_pipeline(spark, messy):
    from corpus_pipeline import drop_exact_copies

    kept = drop_exact_copies(spark, messy.where("doc_id < 9"), "").collect()
    want = {r[1] or "" for r in messy_rows() if r[0] is not None and r[0] < 9}
    assert sorted(r["text"] or "" for r in kept) == sorted(want)


def test_exact_duplicates_of_nothing(spark, none):
    assert exact_duplicates(spark, none).count() == 0


# --- repeated windows of words

def want_windows(rows, width):
    first = {}
    split = [(k, [w.encode() for w in WORD.findall(t or "")]) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if k is not None:
                first[key] = min(first.get(key, k), k)
    out = Counter()
    for k, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if k is not None and first[tuple(w[i : i + width])] < k:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[k, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("width", [1, 50])
def test_repeated_windows(messy, width):
    rows = repeated_windows(messy, width).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)
    assert got == want_windows(pairs(messy_rows()), width)
    assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in rows)


def test_repeated_windows_of_nothing(none):
    assert repeated_windows(none).count() == 0


# --- repeated bytes

def want_bytes(rows, width):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(d[i : i + width] for _, d in data for i in range(len(d) - width + 1))
    out = Counter()
    for k, d in data:
        hit = np.zeros(len(d) + 1, dtype=np.int64)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                hit[i] += 1
                hit[i + width] -= 1
        gone = np.cumsum(hit[:-1]) > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(d, dtype=np.uint8)[~gone])
        out[k, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("width", [20, 400])
def test_repeated_bytes(messy, width):
    rows = repeated_bytes(messy, width).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows)
    assert got == want_bytes(pairs(messy_rows()), width)


@pytest.mark.parametrize("limit", [1, 1000])
@pytest.mark.parametrize("width", [60, 400])
def test_common_anchors_are_cut_finer(messy, monkeypatch, width, limit):
    monkeypatch.setattr("pagewell.llm.suffix_dedup.ANCHOR_BYTES", limit)
    rows = repeated_bytes(messy, width).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows)
    assert got == want_bytes(pairs(messy_rows()), width)


def test_a_common_line_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr("pagewell.llm.suffix_dedup.ANCHOR_BYTES", 2000)
    rng = random.Random(3)
    line = "".join(rng.choice("abcd ") for _ in range(70))
    rows = [(k, "".join(rng.choice("xy") for _ in range(k % 9)) + line + "".join(rng.choice("xy") for _ in range(k % 7))) for k in range(120)]
    rows += [(500, line * 3), (501, "ab" * 90), (502, "a" * 200)]
    got = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 60).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got)
    assert got == want_bytes(rows, 60)


def test_repeated_bytes_of_nothing(none):
    assert repeated_bytes(none).count() == 0


@pytest.mark.parametrize("symbols", [3, 4096])
@pytest.mark.parametrize("memory", [0, 15, 1 << 20])
@pytest.mark.parametrize("limit", [0, 50, 1 << 20])
def test_induced_order_and_prefixes(monkeypatch, limit, memory, symbols):
    monkeypatch.setattr("pagewell.llm.suffix._SYMBOLS", symbols)
    rng = random.Random(limit + memory)
    for _ in range(40):
        k = rng.choice([1, 2, 3, 26])
        text = [rng.randrange(1, k + 1) for _ in range(rng.randint(0, 90))] * rng.choice([1, 1, 4]) + [0]
        blocks = list(suffix_blocks(np.array(text, dtype=np.uint16), k + 1, 10**6, limit, memory))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert np.concatenate([at for at, _ in blocks]).tolist() == order
        common = [next(c for c, (x, y) in enumerate(zip(text[i:], text[j:])) if x != y) for i, j in zip(order, order[1:])]
        assert np.concatenate([lcp for _, lcp in blocks]).tolist() == [0, *common]
    for _ in range(40):
        width = rng.choice([1, 3, 8, 9, 16])
        segments = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        segments += segments[: rng.randint(0, 2)]
        seen = Counter(s[i : i + width] for s in segments for i in range(len(s) - width + 1))
        for s, starts in zip(segments, repeated_starts(segments, width, limit, memory)):
            assert starts.tolist() == [i for i in range(len(s) - width + 1) if seen[s[i : i + width]] > 1]


# --- archives

def test_archives_round_trip(spark, tmp_path):
    pages = [(5, "http://a/", "<p>é</p>\r\n\r\nWARC/1.1\r\n"), (3, None, None), (None, "http://n\r\nX: y", ""), (9, "u", "dup"),
             (8, "v", "dup"), (8, "w", "dup"), (2, "big", "z" * 300_000), (None, "q", "dup")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "p"))
    write_warc(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "w"))
    records = read_warc(spark, str(tmp_path / "w"))
    rows = records.collect()
    assert len(rows) == len(pages)
    body = Counter(bytes(r["payload"]) for r in rows if r["record_type"] == "response")
    assert body == Counter({(h or "").encode() for _, _, h in pages})
    assert {r["refers_to"] for r in rows if r["record_type"] == "revisit"} == {"<urn:page:8>", "<urn:page:3>"}
    assert {r["target_uri"] for r in rows} >= {None, "http://n%0D%0AX: y"}
    assert all(r["payload"] == b"" for r in rows if r["record_type"] == "revisit")


def test_archive_filters_are_tested_on_headers(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "ab", "y")], "page_id long, url string, html string").write.parquet(
        str(tmp_path / "p")
    )
    write_warc(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "w"))
    records = read_warc(spark, str(tmp_path / "w"))
    chosen = records.where((F.col("record_type") == "revisit") & F.col("target_uri").isin("a", "b"))
    assert [r["record_id"] for r in chosen.collect()] == ["<urn:page:2>"]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert records.where(F.col("target_uri").startswith("a")).count() == 2
    assert read_warc(spark, str(tmp_path / "w"), ["record_id"]).columns == ["record_id"]


def test_archives_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    write_warc(spark.read.parquet(str(tmp_path / "p")), str(tmp_path / "w"))
    assert read_warc(spark, str(tmp_path / "w")).count() == 0


# --- token totals

def test_totals_follow_inserts_revisions_and_deletes(spark, tmp_path):
    schema = "id string, op string, source string, lang string, version string, tokens long"
    totals = TokenTotals(spark, str(tmp_path / "t"))
    assert totals.totals().count() == 0
    first = [("a", "upsert", "s", "en", "v", 5), ("b", "upsert", None, "en", "v", 7), ("c", "upsert", "s", None, "v", 0),
             ("a", "upsert", "s", "en", "w", 50), ("b", "upsert", None, "en", "v", 7)]
    assert totals.commit(0, spark.createDataFrame(first, schema))
    second = [("a", "upsert", "s", "de", "v", 6), ("b", "delete", None, None, "v", None), ("zz", "delete", None, None, "v", 1)]
    assert totals.commit(1, spark.createDataFrame(second, schema))
    assert not totals.commit(1, spark.createDataFrame(second, schema))
    assert totals.commit(2, spark.createDataFrame([], schema))
    assert totals.commit(3, spark.createDataFrame([("b", "upsert", "t", "en", "v", 9)], schema))
    got = {tuple(r) for r in totals.totals().collect()}
    assert got == {("s", "de", "v", 1, 6), ("s", None, "v", 1, 0), ("s", "en", "w", 1, 50), ("t", "en", "v", 1, 9)}


def test_token_counts(messy, none):
    theirs = Tokenizer.from_file(VOCABULARY)
    got = count_tokens(messy.select("doc_id", "text"), VOCABULARY).collect()
    want = Counter((k, len(theirs.encode(t or "", add_special_tokens=False).ids)) for k, t in pairs(messy_rows()))
    assert Counter(map(tuple, got)) == want
    assert count_tokens(none.select("doc_id", "text"), VOCABULARY).count() == 0


def test_counted_rows_keep_their_other_columns(messy):
    got = count_tokens(messy, VOCABULARY)
    assert got.columns == [c for c in messy.columns if c not in ("text", "tokens")] + ["tokens"]
    assert got.schema["tokens"].dataType.simpleString() == "bigint"
    theirs = Tokenizer.from_file(VOCABULARY)
    want = Counter((k, "?", len(theirs.encode(t or "", add_special_tokens=False).ids)) for k, t in pairs(messy_rows()))
    assert Counter(map(tuple, got.select("doc_id", "at", "tokens").collect())) == want


def test_a_batch_without_its_mark_does_not_count(spark, tmp_path):
    schema = "id string, op string, source string, lang string, version string, tokens long"
    totals = TokenTotals(spark, str(tmp_path))

    def change(*rows):
        return spark.createDataFrame([(i, op, "s", "en", "v", n) for i, op, n in rows], schema)

    assert totals.commit(0, change(("a", "upsert", 3)))
    assert totals.commit(1, change(("b", "upsert", 4)))
    (tmp_path / "deltas" / "batch=1" / "_SUCCESS").rename(tmp_path / "taken")  # as after a job that died while files were moved
    assert totals.committed() == [0]
    assert {tuple(r) for r in totals.totals().collect()} == {("s", "en", "v", 1, 3)}
    with pytest.raises(ValueError, match="batch 1 was begun"):
        totals.commit(2, change(("b", "delete", 0)))
    assert totals.commit(1, change(("b", "upsert", 4)))
    assert totals.commit(2, change(("b", "delete", 0)))
    assert {tuple(r) for r in totals.totals().collect()} == {("s", "en", "v", 1, 3)}
    assert totals.commit(9, change(("c", "upsert", 1)))
    with pytest.raises(ValueError, match="batch 9"):
        totals.commit(5, change(("a", "delete", 0)))


def test_only_a_ledger_was_written(spark, tmp_path):
    schema = "id string, source string, lang string, version string, tokens long, live boolean"
    spark.createDataFrame([("b", "s", "en", "v", 4, True)], schema).write.parquet(str(tmp_path / "ledger" / "batch=1"))
    totals = TokenTotals(spark, str(tmp_path))
    gone = spark.createDataFrame([("b", "delete", "s", "en", "v", 0)], "id string, op string, source string, lang string, version string, tokens long")
    with pytest.raises(ValueError, match="batch 1 was begun"):
        totals.commit(2, gone)
    assert totals.commit(1, gone) and totals.totals().count() == 0


def test_token_query_covers_every_row(spark, messy, tmp_path):
    from pagewell.llm.catalog import op7_token_counts

    more = [(20, "a a\na a\nb"), (None, "x\nx"), (21, "c\nc"), (20, "d\nd\nd"), (22, "e\ne")]
    docs = messy.select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame([(*r, "en", "s1") for r in more], "doc_id long, text string, lang string, source string")
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(4, 0), (16, 0), (16, 0), (21, 0), (20, 1), (None, 0), (99, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    theirs = Tokenizer.from_file(VOCABULARY)
    low, documents, tokens = {4, 16, 21}, Counter(), Counter()
    for r in docs.collect():
        if r["doc_id"] not in low:
            text = "\n".join(dict.fromkeys((r["text"] or "").split("\n")))
            documents[r["source"], r["lang"]] += 1
            tokens[r["source"], r["lang"]] += len(theirs.encode(text, add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in op7_token_counts(spark, str(tmp_path)).collect()}
    assert got == {k: (n, tokens[k]) for k, n in documents.items()}


# --- mixing

def test_mix_meets_targets(messy, none):
    rows = mix_sources(messy, block_words=500, shard_blocks=4).collect()
    assert len(rows) == len(messy_rows())
    size, taken = Counter(), Counter()
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == sum(d["words"] for d in r["draws"]) <= 2 * r["size"] and len(r["draws"]) <= 2
        assert all(d["shard"] is not None for d in r["draws"])
    assert Counter(r["size"] for r in rows) == Counter(len(WORD.findall(t or "")) for _, t in pairs(messy_rows()))
    for source, n, target in source_targets(list(size.items()), (3, 1, 2), 1.5, 2.0):
        assert abs(taken[source] - target) <= 0.5 and target <= 2 * n
    again = mix_sources(messy, block_words=500, shard_blocks=4).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    assert mix_sources(none).count() == 0
    whole = mix_sources(messy, cut=False).collect()
    assert all(d["words"] == r["size"] for r in whole for d in r["draws"])


def test_targets_reshare_the_excess():
    got = source_targets([("b", 100), ("a", 10), (None, 1000)], (3, 1, 2), 1.5, 2.0)
    assert [g[0] for g in got] == ["a", "b", None]
    assert got[0][2] == 20 and got[1][2] == 200 and got[2][2] == pytest.approx(1665 - 220)
    assert source_targets([], (3, 1, 2), 1.5, 2.0) == [] and source_targets([("a", 0)], (3,), 1.5, 2.0)[0][2] == 0


def test_tree_uses_every_quota_once():
    quotas = [1000, 5, 0, 333, 78]
    leaves = [shard_draws(quotas, i, 23, 7) for i in range(23)]
    for k, q in enumerate(quotas):
        ranges = sorted((f, f + n) for f, n in (leaf[k] for leaf in leaves) if n)
        assert sum(b - a for a, b in ranges) == q and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    sizes = [sum(n for _, n in leaf) for leaf in leaves]
    assert max(sizes) - min(sizes) <= 1


# --- vectors

def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr("pagewell.llm.embeddings.TILE", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] + rng.normal(size=24) * rng.choice([0.05, 0.3])).tolist()) for i in range(90)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(200, rows[0][1]), (None, rows[1][1])]
    rows += [(300, None), (301, [0.0] * 24), (302, [None] + [1.0] * 23), (303, [float("nan")] * 24), (304, [float("inf")] * 24), (305, []),
             (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [1e200, 2e200])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]

    def linked(a, b):
        return a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95

    root = groups(units, linked)
    least = {q: min((k for (k, _), p in zip(rows, root) if p == q and k is not None), default=None) for q in set(root)}
    want = Counter()
    for i, (k, _) in enumerate(rows):
        n = sum(linked(units[i], units[j]) for j in range(len(rows)) if j != i)
        want[k, n, least[root[i]], k is not None and k == least[root[i]]] += 1
    assert Counter(map(tuple, near_vectors(frame).collect())) == want
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
