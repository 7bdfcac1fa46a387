"""Results of the steps that were made to grow with their input, against brute force, and plans without needless exchanges."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewell.sources.store import KeyedStore
from pagewell.sources.tables import scan_documents, scan_files
from pagewell.config import SearchConfig
from pagewell.operators import analysis, constants, index, phrases, search, weighted


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dictionary_cuts_texts_without_an_exchange(spark):
    docs = spark.createDataFrame([(1, "一二三 abc 二三四"), (2, "三"), (2, "三"), (None, "一二")], "doc_id int, text string")
    words = spark.createDataFrame([("一二",), ("二三四",), ("三四五",)], "word string")
    cut = analysis.segment_dict(docs, "text", ["doc_id"], words)
    rows = sorted((r.doc_id or 0, r.run_pos, r.i, r.term) for r in cut.collect())
    assert rows == [(0, 0, 0, "一二"), (1, 0, 0, "一二"), (1, 0, 1, "三"), (1, 1, 0, "abc"), (1, 2, 0, "二三四"), (2, 0, 0, "三")]
    once = docs.filter("doc_id = 1")
    assert "Exchange" not in plan(analysis.segment_dict(once, "text", ["doc_id"], words))


def test_segmented_postings_need_no_exchange(spark):
    docs = spark.createDataFrame([(1, "http://a", "一二三\n一二"), (2, "http://b", "")], "doc_id bigint, url string, text string")
    analyser = analysis.Analyser(dictionary=spark.createDataFrame([("一二",)], "word string"))
    postings = index.build_postings(index.build_docs(docs), analyser)
    found = {(r.field, r.term): (r.tf, r.dl, r.positions) for r in postings.collect()}
    assert found == {("content", "一二"): (2, 3, [0, 2]), ("content", "三"): (1, 3, [1]), ("title", "一二"): (1, 2, [0]), ("title", "三"): (1, 2, [1])}
    assert "Exchange" not in plan(postings)


def slow_frequency(words, slop):
    """Every tightest window by its definition."""
    total = 0.0
    for i, own in enumerate(words):
        for x in own:
            ahead = [min((y for y in s if y >= x), default=None) for j, s in enumerate(words) if j != i]
            if None in ahead or any(x < y <= min(ahead) for y in own) or max(ahead) - x > slop:
                continue
            total += 1 / (1 + max(ahead) - x)
    return total


def test_sloppy_windows_are_those_of_the_definition(spark):
    rng = random.Random(5)
    cases = [[sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(2, 4))] for _ in range(60)]
    cases += [[[0, 1, 2], [0, 1, 2]], [[5], [5]], [[3, 3, 7], [4]]]
    rows = [(n, [(p, [x + p for x in s]) for p, s in enumerate(words)]) for n, words in enumerate(cases)]
    df = spark.createDataFrame(rows, "n int, parts array<struct<part:int,positions:array<int>>>")
    got = df.select("n", search._phrase_frequency(F.col("parts"), F.lit(3)).alias("f")).collect()
    for r in got:
        assert r.f == pytest.approx(slow_frequency(cases[r.n], 3)), cases[r.n]


def test_sloppy_windows_of_frequent_words_take_one_walk(spark):
    # 40,000 starts a word: every pair of them would be 1.6 billion steps.
    rows = spark.range(1).select(
        F.array(*[F.struct(F.lit(p).alias("part"), F.sequence(F.lit(p), F.lit(40_000 + p)).alias("positions")) for p in (0, 1)]).alias("parts")
    )
    assert rows.select(search._phrase_frequency(F.col("parts"), F.lit(2))).first()[0] == pytest.approx(80_002.0)


def test_best_documents_of_constant_clauses_need_no_row_a_match():
    rng = np.random.default_rng(3)
    held = {
        "queries": np.array([4, 9]), "query": np.array([0, 0, 1, 1]), "pattern": np.array([0, 1, 1, 2]), "weight": np.array([1.0, 0.5, 0.0, 2.0]),
        "lo": np.array([0, 3, 0]), "hi": np.array([5, 4, 0]), "alone": np.array([-7, -2]), "first": np.array([0, 1, 2]), "alone_patterns": np.array([2, 1]),
    }
    docs = [(0, d, np.unique(rng.choice([0, 3, 4, 6, 9, -7, -2, -1], 2))) for d in range(50)]

    def score(query, segments):
        hits = {0: any(0 <= s < 5 for s in segments), 1: any(s in (3, -2) for s in segments), 2: -7 in segments}
        own = [w for q, p, w in zip(held["query"], held["pattern"], held["weight"]) if held["queries"][q] == query and hits[p]]
        return sum(own) if own else None

    wanted = set()
    for query in (4, 9):
        found = sorted((-s, b, d) for b, d, segments in docs if (s := score(query, segments)) is not None)
        wanted |= {(query, -s, b, d) for s, b, d in found[:3]}
    got = constants.best_documents(held, 3, iter(docs))
    assert {(int(q), float(s), int(b), int(d)) for q, s, b, d in zip(*got.values())} == wanted


def test_many_queries_with_one_kind_skip_the_other_kinds(spark, monkeypatch):
    monkeypatch.setattr("pagewell.operators.joins.PIN_ROWS", 5)
    docs = spark.createDataFrame([(i, f"http://d/{i}", f"word{i} all") for i in range(12)], "doc_id bigint, url string, text string")
    opened = index.index_of_docs(index.build_docs(docs))
    wanted = docs.select(F.col("doc_id").cast("int").alias("query_id"), F.lit(0).alias("clause_id"), F.lit("url").alias("kind"), F.col("url").alias("term"))
    ready = search.prepare(wanted)
    assert ready.rows is None and ready.kinds == {"url"} and ready.same is None
    hits = search.search(opened, wanted).hits.collect()
    assert sorted((r.query_id, r.rank, r.score, r.doc_id) for r in hits) == [(i, 1, 1.0, i) for i in range(12)]


def test_store_files_are_few_and_as_small_as_their_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    store = KeyedStore(spark, path, ("url_md5",), digits=1, schema="url_md5 string, n bigint")
    rows = spark.range(400).select(F.md5(F.col("id").cast("string")).alias("url_md5"), F.col("id").alias("n"))
    store.write(rows, 0)
    files = list((tmp_path / "store" / "rows").rglob("*.parquet"))
    assert len(files) <= 16 and sum(f.stat().st_size for f in files) < 2_000_000
    assert sorted(r.n for r in store.rows(rows.limit(50)).collect()) == sorted(r.n for r in rows.limit(50).collect())
    assert store.rows().count() == 400


@pytest.mark.parametrize("low", [0.1, -1.0])
def test_best_documents_of_weighted_terms_equal_all_scores(monkeypatch, low):
    monkeypatch.setattr(weighted, "_CELLS", 12)
    monkeypatch.setattr(weighted, "_PRODUCTS", 7)
    rng = np.random.default_rng(4)
    pairs = {(int(t), int(q)): round(rng.uniform(low, 3), 2) for t, q in zip(rng.integers(0, 12, 40), rng.integers(0, 6, 40))}
    # A document without a number, equal scores, and terms that no query asks for.
    docs = sorted({(int(d) // 20 - 1 if d < 20 else 0, int(d), int(t)): float(rng.integers(1, 3)) for d, t in zip(rng.integers(0, 60, 300), rng.integers(0, 15, 300))}.items())
    scores = {}
    for (batch, doc, term), own in docs:
        for (t, query), weight in pairs.items():
            if t == term:
                scores[query, batch, doc] = scores.get((query, batch, doc), 0.0) + own * weight
    wanted = set()
    for query in {q for _, q in pairs}:
        found = sorted((-round(s, 6), b, d) for (q, b, d), s in scores.items() if q == query)
        wanted |= {(query, round(-s, 6), b, d) for s, b, d in found[:4]}
    rows = [(b, d, t, own) for (b, d, t), own in docs]
    table = pa.table(dict(zip(["batch_id", "doc_id", "number", "own"], map(list, zip(*rows)))))
    held = weighted.held_pairs(pa.table({"number": [t for t, _ in pairs], "query_id": [q for _, q in pairs], "weight": list(pairs.values())}))
    monkeypatch.setattr(weighted, "_ROWS", 10)
    (got,) = weighted.best_of_task(lambda: held, 4)(iter(table.to_batches(max_chunksize=7)))
    assert {(r["query_id"], round(r["score"], 6), r["batch_id"], r["doc_id"]) for r in got.to_pylist()} == wanted


def test_optional_terms_and_fuzzy_words_keep_best_documents_in_tasks(spark, monkeypatch):
    rng = random.Random(7)
    words = ["alpha", "alphas", "beta", "betas", "gamma", "the"]
    docs = spark.createDataFrame([(i, f"http://d/{i}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(50)], "doc_id bigint, url string, text string")
    opened = index.index_of_docs(index.build_docs(docs))
    rows = [(1, 0, "term", "the", 1.0), (1, 1, "fuzzy", "alpha", 2.0), (2, 0, "term", "beta", 0.0), (3, 0, "fuzzy", "betas", 1.0), (4, 0, "term", "nowhere", 1.0)]
    asked = spark.createDataFrame(rows, "query_id int, clause_id int, kind string, term string, boost double")
    ready = search.prepare(asked)
    every = search.matching_docs(opened, ready, search.leaves_of(opened, ready))
    wanted = sorted((r.query_id, r.rank, r.score, r.doc_id) for r in search.top_k_hits(every, 5).collect())
    assert {r[0] for r in wanted} == {1, 2, 3}
    for held in (1_000_000, 2):
        monkeypatch.setattr(search, "_HELD_PAIRS", held)
        hits = search.search(opened, asked, SearchConfig(top_k=5)).hits
        # A row a match would be there before the ranking.
        assert "MapInArrow" in plan(hits)
        got = sorted((r.query_id, r.rank, r.score, r.doc_id) for r in hits.collect())
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in wanted]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in wanted], abs=2e-6)


def test_phrases_are_followed_through_the_positions_of_a_document():
    rng = random.Random(8)
    texts = {(b, d): [rng.choice("abcdef") for _ in range(rng.randint(1, 30))] for b in (0, 1) for d in range(12)}
    asked = [(w, s) for w in ("ab", "abc", "aa", "aba", "d", "bd", "abcd", "aaa") for s in (0, 2, 40)]
    numbers = {w: 3 * i for i, w in enumerate("abcd")}
    words = [(p, i, numbers[w], slop) for p, (text, slop) in enumerate(asked) for i, w in enumerate(text)]
    held = phrases.held_phrases(pa.table(dict(zip(["phrase", "part", "number", "slop"], map(list, zip(*words))))))
    rows = [(b, d, numbers.get(w, 99), len(t), [i for i, x in enumerate(t) if x == w]) for (b, d), t in texts.items() for w in sorted(set(t))]
    table = pa.table({**dict(zip(["batch_id", "doc_id", "number", "dl"], map(list, zip(*[r[:4] for r in rows])))), "positions": pa.array([r[4] for r in rows], pa.list_(pa.int32()))})
    got = {}
    for batch in phrases.phrases_of_task(lambda: held)(iter(table.to_batches(max_chunksize=5))):
        for r in batch.to_pylist():
            assert (r["phrase"], r["batch_id"], r["doc_id"]) not in got and r["dl"] == len(texts[r["batch_id"], r["doc_id"]])
            got[r["phrase"], r["batch_id"], r["doc_id"]] = r["freq"], r["parts"]
    for p, (text, slop) in enumerate(asked):
        for key, t in texts.items():
            found = got.get((p, *key))
            if slop == 0 or len(text) == 1:
                times = sum(t[i : i + len(text)] == list(text) for i in range(len(t)))
                assert (found or (0, None))[0] == times
                continue
            starts = [[i - n for i, x in enumerate(t) if x == w] for n, w in enumerate(text)]
            if all(starts) and slow_frequency(starts, slop) > 0:
                assert [[x - n["part"] for x in n["positions"]] for n in found[1]] == starts and found[0] is None


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    for n in range(200):
        (tmp_path / f"key{n}.a.txt").write_text(f"text {n}\nline", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        for files, column in ((scan_documents(spark, str(tmp_path)), "text"), (scan_files(spark, str(tmp_path)), "body")):
            # A file is a task here, as a few are at the usual setting.
            assert files.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism < 200
            rows = {(r.url_md5, r[column] if column == "text" else bytes(r[column]).decode()) for r in files.collect()}
            assert rows == {(f"key{n}", f"text {n}\nline") for n in range(200)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def random_index(spark, rng, words, n):
    rows = [(i if i % 10 else None, f"http://d/{i}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(n)]
    return index.index_of_docs(index.build_docs(spark.createDataFrame(rows, "doc_id bigint, url string, text string")))


def same_as_every_match(asked, opened, k=5):
    """Hits kept in tasks, and the same of all matches ranked afterwards."""
    ready = search.prepare(asked)
    every = search.matching_docs(opened, ready, search.leaves_of(opened, ready))
    wanted = sorted((r.query_id, r.rank, r.score, r.batch_id, r.doc_id or -1) for r in search.top_k_hits(every, k).collect())
    hits = search.search(opened, asked, SearchConfig(top_k=k)).hits
    # A row a match would be there before the ranking.
    assert "MapInArrow run(" in plan(hits) and "MapInArrow run(" not in plan(every)
    got = sorted((r.query_id, r.rank, r.score, r.batch_id, r.doc_id or -1) for r in hits.collect())
    assert [(r[0], r[1], *r[3:]) for r in got] == [(r[0], r[1], *r[3:]) for r in wanted]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in wanted], abs=2e-6)
    return {r[0] for r in got}


def test_required_and_refused_terms_keep_best_documents_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(weighted, "_CELLS", 40)
    monkeypatch.setattr(weighted, "_PRODUCTS", 9)
    monkeypatch.setattr(weighted, "_ROWS", 20)
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "the", "of"]
    opened = random_index(spark, rng, words, 60)
    occurs = ("must", "should", "must_not")
    rows = [(q, i, rng.choice(occurs), rng.choice([*words, "nowhere"]), rng.choice([0.0, 0.5, 1.0])) for q in range(30) for i in range(rng.randint(1, 4))]
    # Twice the same word, a required word that no document has, only refused words, one word required and refused.
    rows += [(30, 0, "must", "the", 1.0), (30, 1, "must", "the", 1.0), (31, 0, "must", "nowhere", 1.0), (31, 1, "should", "the", 1.0)]
    rows += [(32, 0, "must_not", "the", 1.0), (33, 0, "must", "of", 1.0), (33, 1, "must_not", "of", 1.0), (34, 0, "must", "of", 1.0)]
    asked = spark.createDataFrame(rows, "query_id int, clause_id int, occur string, term string, boost double").withColumn("kind", F.lit("term"))
    found = same_as_every_match(asked, opened)
    assert {30, 34} <= found and not {31, 32, 33} & found


def test_synonyms_keep_best_documents_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(weighted, "_CELLS", 40)
    monkeypatch.setattr(weighted, "_PRODUCTS", 9)
    rng = random.Random(12)
    words = ["alpha", "beta", "gamma", "delta", "the", "of"]
    opened = random_index(spark, rng, words, 60)
    rows = [
        (q, i, rng.choice(("should", "should", "must", "must_not")), rng.choice(("synonyms", "term")), rng.choice(words), rng.choices([*words, "nowhere"], k=rng.randint(1, 3)), rng.choice([0.0, 1.0]))
        for q in range(25) for i in range(rng.randint(1, 3))
    ]
    rows += [(30, 0, "should", "synonyms", None, ["the", "of"], 1.0), (31, 0, "should", "synonyms", None, ["nowhere"], 1.0)]
    asked = spark.createDataFrame(rows, "query_id int, clause_id int, occur string, kind string, term string, terms array<string>, boost double")
    found = same_as_every_match(asked, opened)
    assert 30 in found and 31 not in found
    # All of them optional, as a search for words of one meaning is.
    same_as_every_match(asked.filter("kind = 'synonyms'").withColumn("occur", F.lit("should")), opened)


def test_near_pairs_of_words_are_counted_with_the_documents():
    rng = random.Random(9)
    texts = [[rng.choice("abc") for _ in range(rng.randint(1, 25))] for _ in range(40)]
    asked = [(w, s) for w in ("ab", "ba", "aa", "bc") for s in (0, 1, 2, 5)]
    words = [(p, i, ord(w), slop) for p, (text, slop) in enumerate(asked) for i, w in enumerate(text)]
    held = phrases.held_phrases(pa.table(dict(zip(["phrase", "part", "number", "slop"], map(list, zip(*words))))), count_near=True)
    # A place that is named twice counts twice.
    places = {d: {w: sorted([i for i, x in enumerate(t) if x == w] + [i for i, x in enumerate(t) if x == w and i % 7 == 3]) for w in set(t)} for d, t in enumerate(texts)}
    rows = [(0, d, ord(w), at) for d, found in places.items() for w, at in sorted(found.items())]
    table = pa.table({**dict(zip(["batch_id", "doc_id", "number"], map(list, zip(*[r[:3] for r in rows])))), "positions": pa.array([r[3] for r in rows], pa.list_(pa.int32()))})
    at, phrase, times = phrases.frequencies(held, table)
    got = {(int(p), rows[r][1]): t for r, p, t in zip(at, phrase, times)}
    assert len(got) == len(times) and all(rows[r][2] == ord(asked[p][0][0]) for r, p in zip(at, phrase))
    for p, (text, slop) in enumerate(asked):
        for d, found in places.items():
            starts = [[i - n for i in found.get(w, [])] for n, w in enumerate(text)]
            want = slow_frequency(starts, slop) if slop else len(set(starts[0]) & set(starts[1]))
            assert got.get((p, d), 0.0) == pytest.approx(want)


def test_phrases_keep_best_documents_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(weighted, "_CELLS", 40)
    monkeypatch.setattr(weighted, "_ROWS", 20)
    rng = random.Random(13)
    words = ["alpha", "beta", "gamma", "the", "of"]
    opened = random_index(spark, rng, words, 60)
    rows = [
        (q, i, rng.choice(("should", "should", "must", "must_not")), rng.choice(("phrase", "phrase", "synonyms")), rng.choice(("content", "title")), rng.choices(words, k=rng.randint(1, 2)), rng.choice([0, 2, 3]))
        for q in range(25) for i in range(rng.randint(1, 3))
    ]
    rows += [(30, 0, "should", "phrase", "content", ["the", "of"], 2), (31, 0, "should", "phrase", "content", ["the", "nowhere"], 2)]
    rows += [(32, 0, "must", "phrase", "content", ["of", "the", "of"], 0), (33, 0, "must", "phrase", "content", ["nowhere"], 0), (33, 1, "should", "phrase", "content", ["the"], 0)]
    asked = spark.createDataFrame(rows, "query_id int, clause_id int, occur string, kind string, field string, terms array<string>, slop int")
    # Matches as rows go by the positions in the JVM.
    monkeypatch.setattr(search, "held_phrases", lambda words, count_near=False: phrases.held_phrases(words))
    ready = search.prepare(asked)
    every = search.matching_docs(opened, ready, search.leaves_of(opened, ready))
    wanted = sorted((r.query_id, r.rank, r.score, r.doc_id or -1) for r in search.top_k_hits(every, 5).collect())
    monkeypatch.setattr(search, "held_phrases", phrases.held_phrases)
    hits = search.search(opened, asked, SearchConfig(top_k=5)).hits
    assert "positions" not in plan(hits).split("MapInArrow run(")[0]
    got = sorted((r.query_id, r.rank, r.score, r.doc_id or -1) for r in hits.collect())
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in wanted]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in wanted], abs=2e-6)
    assert 30 in {r[0] for r in got} and not {31, 33} & {r[0] for r in got}


def test_tokens_are_counted_before_others_are_added(spark):
    rng = random.Random(14)
    words = ["a", "b", "c", "d", "e"]
    # Two rows of one document are one text; a document without a number has no postings.
    texts = [(i // 2 if i < 12 else i if i % 5 else None, " ".join(rng.choices(words, k=rng.randint(0, 15)))) for i in range(40)]
    table = spark.createDataFrame([(0, d, "content", t) for d, t in texts], "batch_id bigint, doc_id bigint, field string, text string")
    synonyms = [("a", "b"), ("a", "x"), ("b", "a"), ("c", "c"), ("c", "b"), ("c", "b"), (None, "a")]
    readings = [("x", "y"), ("a", "a2"), ("d", "e")]
    keys = [*index.DOC, "field"]
    cut = analysis.tokenize(table, "text", keys)
    expanded = analysis.expand_synonyms(cut, spark.createDataFrame(synonyms, "term string, syn string"), keys)
    both = analysis.expand_readings(expanded, spark.createDataFrame(readings, "term string, reading string"), keys)
    for df, steps in ((cut.withColumn("is_overlap", F.lit(False)), []), (expanded, [synonyms]), (both, [synonyms, readings]), (both.filter("term <> 'a'"), [synonyms, readings])):
        wanted, lengths = {}, {}
        for doc, text in texts:
            for pos, word in enumerate(text.split()) if doc is not None else ():
                found = [(word, 1)]
                for step in steps:
                    found = [f for w, n in found for f in [(w, n), *[(s, 0) for t, s in step if t == w]]]
                for w, own in found:
                    if df is both or df is expanded or not steps or w != "a":
                        wanted.setdefault((doc, w), []).append(pos)
                        lengths[doc] = lengths.get(doc, 0) + own
        rows = index.postings_of_tokens(df).collect()
        assert {(r.doc_id, r.term): (r.tf, r.dl, r.positions) for r in rows} == {k: (len(p), lengths[k[0]], sorted(p)) for k, p in wanted.items()}
        assert len(rows) == len(wanted)
    # The window over the lengths lies below the rows that tokens multiply to.
    assert "Window" in plan(index.postings_of_tokens(expanded)).split("explode(CASE WHEN isnull(_added")[1]


def test_postings_of_expanded_tokens_are_dealt_out_by_the_bytes_of_documents(spark, tmp_path, monkeypatch):
    from pagewell.catalog import indexing

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha omega")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(indexing, "EXPANDED_TASK_BYTES", 100)
    found = indexing._build_postings_expanded(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 16
    assert {(r.field, r.term, r.tf, r.dl) for r in found.filter("doc_id = 7").collect()} == {(f, t, 1, 3) for f in ("content", "title") for t in ("alpha", "beta", "omega", "7")}
