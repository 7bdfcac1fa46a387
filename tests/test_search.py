"""Index tables, clause kinds and snippets against brute force on a small corpus."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewell.config import SearchConfig
from pagewell.operators import analysis, index, joins, search, snippets
from pagewell.session import scratch_path

WORDS = ["alpha", "alphas", "beta", "betas", "gamma", "gamut", "delta", "deltoid", "épée", "epee", "omega", "the"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    weights = [1] * (len(WORDS) - 1) + [20]
    return {
        i: " ".join(rng.choices(WORDS, weights, k=rng.choice([3, 12, 60, 200]))) + "\nlast line" for i in range(60)
    }


@pytest.fixture(scope="module")
def opened(spark, corpus):
    docs = spark.createDataFrame(
        [(i, f"http://d/{i}", t) for i, t in corpus.items()], "doc_id bigint, url string, text string"
    )
    path = scratch_path(spark, "index")
    index.index_append(index.build_docs(docs), path, 0)
    return index.read_index(spark, path)


def run(spark, opened, clauses, **kw):
    rows = [
        {"query_id": 1, "clause_id": i, "occur": "should", "field": "content", "boost": 1.0, **c}
        for i, c in enumerate(clauses)
    ]
    types = dict(e.split(" ", 1) for e in search.CLAUSE_SCHEMA.split(", "))
    names = [n for n in types if any(n in r for r in rows)]
    df = spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {types[n]}" for n in names)
    )
    hits = search.search(opened, df, SearchConfig(top_k=1000), **kw).hits
    return {r.doc_id: r.score for r in hits.collect()}


class Brute:
    """BM25 by the formula, one document at a time."""

    def __init__(self, corpus):
        self.tokens = {i: t.lower().split() for i, t in corpus.items()}
        self.n = len(corpus)
        self.total = sum(map(len, self.tokens.values()))

    def length(self, i):
        dl = len(self.tokens[i])
        if dl < 40:
            return dl
        shift = max(0, (dl - 24).bit_length() - 4)
        return 24 + ((dl - 24) >> shift << shift)

    def df(self, term):
        return sum(term in t for t in self.tokens.values())

    def score(self, i, tf, idf):
        norm = 1.2 * (0.25 + 0.75 * self.length(i) * self.n / self.total)
        return idf * tf * 2.2 / (tf + norm)

    def idf(self, df):
        return math.log(1 + (self.n - df + 0.5) / (df + 0.5))

    def term(self, term, boost=1.0, df=None):
        idf = self.idf(df or self.df(term))
        return {i: boost * self.score(i, t.count(term), idf) for i, t in self.tokens.items() if term in t}


@pytest.fixture(scope="module")
def brute(corpus):
    return Brute(corpus)


def added(*parts):
    out = {}
    for p in parts:
        for i, s in p.items():
            out[i] = out.get(i, 0.0) + s
    return {i: round(s, 6) for i, s in out.items()}


def test_terms_and_boost(spark, opened, brute):
    got = run(spark, opened, [{"kind": "term", "term": "alpha"}, {"kind": "term", "term": "the", "boost": 2.0}])
    assert got == pytest.approx(added(brute.term("alpha"), brute.term("the", 2.0)), abs=2e-6)


def test_must_and_must_not(spark, opened, brute):
    got = run(
        spark,
        opened,
        [
            {"kind": "term", "term": "alpha", "occur": "must"},
            {"kind": "term", "term": "beta"},
            {"kind": "term", "term": "omega", "occur": "must_not"},
        ],
    )
    want = added(brute.term("alpha"), brute.term("beta"))
    allowed = {i for i, t in brute.tokens.items() if "alpha" in t and "omega" not in t}
    assert got == pytest.approx({i: s for i, s in want.items() if i in allowed}, abs=2e-6)


def test_missing_required_term_has_no_hits(spark, opened):
    clauses = [{"kind": "term", "term": "nosuch", "occur": "must"}, {"kind": "term", "term": "the"}]
    assert run(spark, opened, clauses) == {}
    assert run(spark, opened, [{"kind": "term", "term": "the", "occur": "must_not"}]) == {}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("term,k", [("alpa", 2), ("beta", 1), ("epée", 2), ("x", 2), ("gamme", 0)])
def test_fuzzy_meets_every_near_term(spark, opened, brute, term, k):
    near = {}
    for w in {w for t in brute.tokens.values() for w in t}:
        d = edits(w, term)
        if d <= k and (d == 0 or d < min(len(w), len(term))):
            near[w] = 1.0 - d / min(len(w), len(term))
    most = max((brute.df(w) for w in near), default=1)
    want = added(*[brute.term(w, s, most) for w, s in near.items()])
    got = run(spark, opened, [{"kind": "fuzzy", "term": term, "max_edits": k}])
    assert got == pytest.approx(want, abs=2e-6)


@pytest.fixture(scope="module")
def query_folder(spark, corpus, tmp_path_factory):
    """Tables of the registered queries over the small corpus, with words that nothing or little is near to."""
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", len(t)) for i, t in corpus.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    asked = [(1, "gem bxtx dalt omga"), (2, "alphaxs thx"), (3, "delta alphas epee gamma")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: t.split() for i, t in asked}


def best_scores(spark, folder, name):
    from pagewell.catalog import ENTRIES

    out = {}
    for r in ENTRIES[name].run(spark, folder).collect():
        out.setdefault(r.query_id, {})[r.doc_id] = r.score
    return out


def test_fuzzy_query_allows_every_word_two_edits(spark, brute, query_folder):
    folder, asked = query_folder
    got = best_scores(spark, folder, "search_fuzzy")
    for item, words in asked.items():
        for start, term in enumerate(words):
            near = {}
            for w in {w for t in brute.tokens.values() for w in t}:
                d = edits(w, term)
                if d <= 2 and (d == 0 or d < min(len(w), len(term))):
                    near[w] = 1.0 - d / min(len(w), len(term))
            most = max((brute.df(w) for w in near), default=1)
            want = added(*[brute.term(w, s, most) for w, s in near.items()])
            hits = got.get(item * 1000 + start, {})
            assert sorted(hits.values()) == pytest.approx(sorted(want.values())[-20:], abs=2e-6)
            assert hits == pytest.approx({i: want[i] for i in hits}, abs=2e-6)


def matching(brute, accept):
    return {i: 1.0 for i, t in brute.tokens.items() if any(accept(w) for w in t)}


def test_range_query_covers_ranges_between_neighbouring_words(spark, brute, query_folder):
    folder, asked = query_folder
    got = best_scores(spark, folder, "search_range")
    for item, words in asked.items():
        for start in range(0, len(words), 2):
            a, b = words[start : start + 2]
            accept = [
                lambda w: a <= w < a + "m",
                lambda w: b < w <= b + "t",
                lambda w: min(a, b) < w <= max(a, b),
            ]
            want = added(*[matching(brute, f) for f in accept])
            best = dict(sorted(want.items(), key=lambda e: (-e[1], e[0]))[:20])
            assert got.get(item * 1000 + start, {}) == best


def test_patterns_and_ranges_score_one(spark, opened, brute):
    assert run(spark, opened, [{"kind": "prefix", "term": "del"}]) == matching(brute, lambda w: w.startswith("del"))
    import re

    assert run(spark, opened, [{"kind": "wildcard", "term": "g?m*t"}]) == matching(brute, lambda w: re.fullmatch("g.m.*t", w))
    got = run(spark, opened, [{"kind": "range", "lo": "beta", "hi": "delta", "incl_lo": False, "incl_hi": True}])
    assert got == matching(brute, lambda w: "beta" < w <= "delta")
    got = run(spark, opened, [{"kind": "range", "lo": "omega", "hi": None, "incl_lo": True, "incl_hi": True}])
    assert got == matching(brute, lambda w: w >= "omega")


@pytest.mark.parametrize("terms", [["the", "the"], ["alpha", "the", "beta"], ["the", "alpha"]])
def test_phrase(spark, opened, brute, terms):
    idf = sum(brute.idf(brute.df(t)) for t in terms)
    want = {}
    for i, t in brute.tokens.items():
        n = sum(t[p : p + len(terms)] == terms for p in range(len(t)))
        if n:
            want[i] = round(brute.score(i, n, idf), 6)
    got = run(spark, opened, [{"kind": "phrase", "terms": terms, "slop": 0}])
    assert got == pytest.approx(want, abs=2e-6)


def test_sloppy_phrase_takes_gaps(spark, opened, brute):
    exact = run(spark, opened, [{"kind": "phrase", "terms": ["alpha", "beta"], "slop": 0}])
    loose = run(spark, opened, [{"kind": "phrase", "terms": ["alpha", "beta"], "slop": 3}])
    assert set(exact) <= set(loose) and len(loose) > len(exact)
    for i in loose:
        t = brute.tokens[i]
        a = [p for p, w in enumerate(t) if w == "alpha"]
        b = [p - 1 for p, w in enumerate(t) if w == "beta"]
        assert any(abs(x - y) <= 3 for x in a for y in b)


def test_malformed_clause_empties_its_query_only(spark, opened):
    rows = [
        (1, 0, "term", "the"),
        (1, 1, "wildcard", "*x"),
        (2, 0, "term", "the"),
        (3, 0, "term", None),
        (4, 0, "nokind", "the"),
    ]
    df = spark.createDataFrame(rows, "query_id int, clause_id int, kind string, term string")
    hits = search.search(opened, df).hits.collect()
    assert {r.query_id for r in hits} == {2}


def test_large_query_tables_give_the_same(spark, opened, monkeypatch):
    clauses = [
        {"kind": "range", "lo": "a", "hi": "z", "incl_lo": True, "incl_hi": True},
        {"kind": "term", "term": "the"},
        {"kind": "fuzzy", "term": "alpha", "max_edits": 1},
        {"kind": "phrase", "terms": ["the", "the"], "slop": 0},
        {"kind": "synonyms", "terms": ["epee", "épée"]},
        {"kind": "url", "field": "url", "term": "http://d/7"},
    ]
    small = run(spark, opened, clauses)
    for module in (joins, search):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "PIN_ROWS", 0)
    monkeypatch.setattr(search, "_HOT_SHARE", 20)
    assert run(spark, opened, clauses) == pytest.approx(small, abs=2e-6)


def test_term_filter_reaches_the_scan(spark, opened):
    df = spark.createDataFrame([(1, 0, "term", "alpha")], "query_id int, clause_id int, kind string, term string")
    plan = search.search(opened, df).hits._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "tf#" in line)
    assert "EqualTo(term,alpha)" in scan and "bucket#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "content" not in scan and "CartesianProduct" not in plan


def snippet_by_hand(text, terms, size=128):
    """Fragments token by token, as a highlighter walks the text."""
    import re

    frags, n = [[0, 0, set()]], 1
    end = 0
    for k, m in enumerate(re.finditer(r"\w+", text)):
        if k and m.end() >= size * n:
            n += 1
            frags.append([end, end, set()])
        if m.group().lower() in terms:
            frags[-1][2].add(m.group().lower())
        end = frags[-1][1] = m.end()
    frags[-1][1] = len(text)
    best = max(frags, key=lambda f: len(f[2]))
    if not best[2]:
        return None
    mark = lambda m: f"<b>{m.group()}</b>" if m.group().lower() in terms else m.group()
    return re.sub(r"\w+", mark, text[best[0] : best[1]])


def test_snippets(spark):
    rng = random.Random(4)
    texts = ["alpha " + "x" * 300 + " a b c alpha beta " + "filler " * 40, "\r\n".join(["alpha beta"] * 3)]
    texts += [" ".join(rng.choices(WORDS + ["--- " * 50], k=90)) for _ in range(10)]
    docs = spark.createDataFrame(
        [(i, f"u{i}", t) for i, t in enumerate(texts)], "doc_id bigint, url string, text string"
    )
    opened = index.index_of_docs(index.build_docs(docs))
    query = spark.createDataFrame([(1, "alpha beta")], "query_id int, text string")
    config = SearchConfig(open_tag="<b>", close_tag="</b>")
    ranked = search.search(opened, search.clauses_of_text(query), config)
    rows = snippets.search_snippets(ranked, opened, config).collect()
    assert rows
    for r in rows:
        flat = texts[r.doc_id].replace("\r\n", " ")
        assert r.snippet == snippet_by_hand(flat, {"alpha", "beta"})


def test_title_only_hit_has_null_snippet_when_nothing_matches(spark):
    docs = spark.createDataFrame([(1, "u", "alpha\nbody")], "doc_id bigint, url string, text string")
    opened = index.index_of_docs(index.build_docs(docs))
    clauses = spark.createDataFrame(
        [(1, 0, "url", "url", "u")], "query_id int, clause_id int, kind string, field string, term string"
    )
    ranked = search.search(opened, clauses)
    row = snippets.search_snippets(ranked, opened).first()
    assert (row.doc_id, row.score, row.snippet) == (1, 1.0, None)


def test_segmentation_is_longest_match_from_the_left(spark):
    docs = spark.createDataFrame([(1, "南开大学abc在天津。总书记9号 大")], "doc_id bigint, text string")
    words = spark.createDataFrame([(w,) for w in ("南开", "南开大学", "大学", "天津", "总书记", "书记")], "word string")
    rows = analysis.segment_dict(docs, "text", ["doc_id"], words).orderBy("run_pos", "i").collect()
    assert [r.term for r in rows] == ["南开大学", "abc", "在", "天津", "总书记", "9", "号", "大"]


def test_expansions_share_the_position_and_do_not_lengthen(spark):
    docs = spark.createDataFrame([(1, "u", "car auto\nred car")], "doc_id bigint, url string, text string")
    keys = [*index.DOC, "field"]
    table = analysis.tokenize(index.field_texts(index.build_docs(docs)), "text", keys)
    synonyms = spark.createDataFrame([("car", "auto"), ("car", "vehicle")], "term string, syn string")
    readings = spark.createDataFrame([("red", "rouge")], "term string, reading string")
    expanded = analysis.expand_readings(analysis.expand_synonyms(table, synonyms, keys), readings, keys)
    rows = {
        (r.field, r.term): (r.tf, r.dl, r.positions) for r in index.postings_of_tokens(expanded).collect()
    }
    assert rows[("content", "auto")] == (3, 4, [0, 1, 3])
    assert rows[("content", "vehicle")] == (2, 4, [0, 3])
    assert rows[("content", "rouge")] == (1, 4, [2])
    stats = {r.field: (r.n_docs, r.total_len) for r in index.corpus_stats(index.postings_of_tokens(expanded)).collect()}
    assert stats == {"content": (1, 9), "title": (1, 4)}


def test_repeated_batch_leaves_one_copy_and_flags_are_kept_for_unknown_urls(spark):
    docs = spark.createDataFrame(
        [(1, "k1", "one two"), (2, "k2", "\n"), (3, "k3", "three")], "doc_id bigint, url_md5 string, text string"
    )
    urls = spark.createDataFrame([("k1", "u1"), ("k2", "u2")], "url_md5 string, url string")
    flags = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k9",)], "url_md5 string")
    path = scratch_path(spark, "index")
    for _ in range(2):
        left = index.index_increment(docs, urls, flags, path, 0)
    opened = index.read_index(spark, path)
    assert [(r.doc_id, r.title) for r in opened.docs.collect()] == [(1, "one two")]
    assert opened.postings.filter("field = 'content'").count() == 2
    assert {r.url_md5 for r in left.collect()} == {"k3", "k9"}


def test_postings_are_built_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "u", "a b a")], "doc_id bigint, url string, text string")
    df = index.build_postings(index.build_docs(docs))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, tuple(r.positions)) for r in df.filter("field = 'content'").collect()} == {("a", (0, 2)), ("b", (1,))}


def test_batches_are_published_whole(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame(
        [(1, "alpha beta\ndelta gamma", "u1"), (2, "alpha", "u2")], "doc_id long, text string, url string"
    )

    def state():
        opened = index.read_index(spark, path)
        terms = {(r.field, r.term, r.df) for r in opened.terms.collect() if r.field == "content"}
        return {r.doc_id for r in opened.docs.collect()}, terms, {r.doc_id for r in opened.postings.collect()}

    assert state() == (set(), set(), set())
    index.index_append(index.build_docs(docs.filter("false")), path, 0)
    assert state() == (set(), set(), set())
    index.index_append(index.build_docs(docs, 0), path, 0)
    assert state()[0] == {1, 2} and ("content", "alpha", 2) in state()[1]
    index.index_append(index.build_docs(docs.filter("doc_id = 2"), 0), path, 0)
    assert state() == ({2}, {("content", "alpha", 1)}, {2})
    index.index_append(index.build_docs(docs.filter("doc_id = 1"), 1), path, 1)
    assert state()[0] == {1, 2}
    with pytest.raises(ValueError, match="two documents"):
        index.index_append(index.build_docs(docs.unionByName(docs), 2), path, 2)
    assert state()[0] == {1, 2}


def test_flags_and_urls_belong_to_their_job(spark, tmp_path):
    key = "job_id string, url_md5 string"
    docs = spark.createDataFrame([("a", "k", "alpha"), ("b", "k", "beta")], key + ", text string")
    urls = spark.createDataFrame([("a", "k", "http://k"), ("b", "k", "http://k")], key + ", url string")
    flags = spark.createDataFrame([("b", "k"), ("b", "other")], key)
    left = index.index_increment(docs, urls, flags, str(tmp_path / "i"), 0)
    opened = index.read_index(spark, str(tmp_path / "i"))
    assert [r.content for r in opened.docs.collect()] == ["beta"]
    assert {(r.job_id, r.url_md5) for r in left.collect()} == {("b", "other")}
    # Without the job on the documents' side a key still has one URL.
    alone = docs.filter("job_id = 'a'").drop("job_id")
    assert index.doc_url_lookup(alone, urls).count() == 1
    ids = {r.doc_id for r in index.with_doc_ids(docs).collect()}
    assert len(ids) == 2 and ids == {r.doc_id for r in index.with_doc_ids(docs).collect()}


def test_fuzzy_clauses_are_neither_capped_nor_emptied(spark):
    docs = spark.createDataFrame([(i, f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x", f"u{i}") for i in range(70)], "doc_id long, text string, url string")
    opened = index.index_of_docs(index.build_docs(docs))
    got = run(spark, opened, [{"kind": "fuzzy", "term": "waax", "max_edits": 7}])
    assert len(got) == 70


def test_chinese_text_is_indexed_and_searched_by_words(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "北京大学 opened", "u1"), (2, "大学生在北京", "u2"), (3, "上海 school", "u3")], "doc_id long, text string, url string"
    )
    dictionary = spark.createDataFrame([("北京",), ("北京大学",), ("大学",), ("大学生",), ("上海",)], "word string")
    synonyms = spark.createDataFrame([("上海", "沪")], "term string, syn string")
    built = index.build_docs(docs)
    words = analysis.analyse(index.field_texts(built), "text", [*index.DOC, "field"], dictionary, synonyms)
    index.index_append(built, str(tmp_path / "i"), 0, index.postings_of_tokens(words))
    opened = index.read_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "北京"), (2, "北京大学"), (3, "沪"), (4, "上海")], "query_id int, text string")
    table = analysis.analyse(asked, "text", ["query_id"], dictionary, synonyms)
    hits = search.search(opened, search.clauses_of_tokens(table)).hits.collect()
    found = {q: {r.doc_id for r in hits if r.query_id == q} for q in range(1, 5)}
    assert found == {1: {2}, 2: {1}, 3: {3}, 4: {3}}


def test_equal_queries_are_answered_once_and_handed_to_all(spark, opened):
    rows = [(q, c, "term", t) for q in range(8) for c, t in enumerate(["alpha", "beta"] if q % 2 else ["gamma"])]
    df = spark.createDataFrame(rows, "query_id int, clause_id int, kind string, term string")
    good = search.prepare(df)
    assert {r["query_id"] for r in good.rows} == {0, 1} and good.n_queries == 8
    found = search.search(opened, df)
    by_query = {}
    for r in found.hits.collect():
        by_query.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    assert set(by_query) == set(range(8))
    assert all(sorted(by_query[q]) == sorted(by_query[q % 2]) for q in by_query)
    terms = {(r.query_id, r.term) for r in found.leaves.by_query.collect()}
    assert terms == {(r[0], r[3]) for r in rows}


def test_deletions_are_shared_by_words_within_two_edits(spark):
    rng = random.Random(6)
    words = ["", "a", "ab", "abc", "aab"] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    words += ["x" * 40 + "".join(rng.choice("ab") for _ in range(3)) for _ in range(4)]
    df = spark.createDataFrame([(w,) for w in set(words)], "w string")
    cut = df.select("w", search.deletions(F.col("w"), F.lit(2)).alias("d")).collect()
    for a in cut:
        assert len(a.d) <= 1 + 32 + 32 * 31 / 2
        for b in cut:
            if edits(a.w, b.w) <= 2:
                assert set(a.d) & set(b.d)


def test_ranges_meet_documents_by_nodes_and_never_by_terms(spark, opened):
    rng = random.Random(9)
    vocabulary = sorted({t for r in opened.terms.collect() for t in [r.term]})
    bounds = vocabulary + ["", "b", "zz", "é", "gam"]
    asked = [(i, rng.choice(bounds), rng.choice(bounds), rng.random() < 0.5, rng.random() < 0.5) for i in range(40)]
    asked += [(40, None, "gamma", True, False), (41, "gamma", None, False, True), (42, None, None, True, True)]
    df = spark.createDataFrame(asked, "pattern long, lo string, hi string, incl_lo boolean, incl_hi boolean")
    rows = df.selectExpr("*", "'range' AS kind", "'content' AS field", "CAST(NULL AS STRING) AS term")
    rows = rows.unionByName(spark.createDataFrame([(43, "al"), (44, "the"), (45, "q")], "pattern long, term string").selectExpr(
        "*", "'prefix' AS kind", "'content' AS field", "CAST(NULL AS STRING) lo", "CAST(NULL AS STRING) hi", "true incl_lo", "true incl_hi"))
    cut = search.cut_dictionary(rows, opened.terms)
    met = cut.segments.select("field", "term", F.explode(cut.nodes()).alias("node")).join(cut.cover, "node")
    got = {(r.pattern, r.term) for r in met.filter("field = 'content'").collect()}
    own = {r.term for r in opened.terms.filter("field = 'content'").collect()}
    want = {(43, t) for t in own if t.startswith("al")} | {(44, t) for t in own if t.startswith("the")}
    for i, lo, hi, incl_lo, incl_hi in asked:
        for t in own:
            b, low, high = t.encode(), (lo or "").encode(), (hi or "").encode()
            above = lo is None or b > low or incl_lo and b == low
            if above and (hi is None or b < high or incl_hi and b == high):
                want.add((i, t))
    assert got == want
    most = cut.cover.groupBy("pattern").count().agg(F.max("count")).first()[0]
    assert most <= 2 * len(cut.levels)
    clauses = df.selectExpr("CAST(pattern AS INT) AS query_id", "0 AS clause_id", "'range' AS kind", "lo", "hi", "incl_lo", "incl_hi")
    good = search.prepare(clauses)
    plan = search.matching_docs(opened, good, search.leaves_of(opened, good))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any(" < " in j or " > " in j or "<=" in j or ">=" in j for j in joins)
    assert any("node" in j for j in joins)


def han_corpus(spark):
    docs = spark.createDataFrame(
        [(1, "北京大学 opened\r\n中华人民共和国成立", "u1"), (2, "大学生在北京", "u2"), (3, "İzmir 上海 school Car", "u3")],
        "doc_id long, text string, url string",
    )
    words = ["北京", "北京大学", "大学", "大学生", "上海", "中华人民共和国", "成立", "学生"]
    return docs, analysis.Analyser(
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame([("上海", "沪"), ("car", "auto")], "term string, syn string"),
        spark.createDataFrame([("沪", "hu")], "term string, reading string"),
    )


def test_snippets_of_an_analysed_index_mark_the_words_that_were_searched(spark, tmp_path):
    docs, analyser = han_corpus(spark)
    path = str(tmp_path / "i")
    assert index.index_increment(docs, None, None, path, 0, analyser) is None
    opened = index.read_index(spark, path)
    asked = ["中华人民共和国", "北京", "hu", "auto", "共和国"]
    table = analyser.tokens(spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), "text", ["query_id"])
    config = SearchConfig(open_tag="<", close_tag=">")
    ranked = search.search(opened, search.clauses_of_tokens(table), config)
    rows = snippets.search_snippets(ranked, opened, config, analyser).collect()
    assert {(r.query_id, r.doc_id, r.snippet) for r in rows} == {
        (0, 1, "北京大学 opened <中华人民共和国>成立"),
        (1, 2, "大学生在<北京>"),
        (2, 3, "İzmir <上海> school Car"),
        (3, 3, "İzmir 上海 school <Car>"),
    }


def test_a_fragment_may_end_between_words_of_one_run(spark):
    docs, analyser = han_corpus(spark)
    hits = spark.createDataFrame([(1, 1, "大学生在北京上海" * 3)], "query_id int, rank int, text string")
    terms = spark.createDataFrame([(1, "上海", 1.0)], "query_id int, term string, weight double")
    row = snippets.best_fragment(hits, terms, 10, analyser=analyser).first()
    # Words end at 3, 4, 6, 8 | 11, 12, 14, 16 | ...; the first to reach 10 opens the second fragment.
    assert (row.frag_start, row.frag_end, [tuple(m) for m in row.marks]) == (0, 8, [(6, 2)])


def test_segmentation_equals_a_walk_over_random_dictionaries(spark):
    rng = random.Random(11)
    words = {"".join(rng.choices("天地人", k=rng.choice([1, 2, 3, 4, 5, 7, 9]))) for _ in range(60)}
    texts = ["".join(rng.choices("天地人大a ", weights=[9, 9, 9, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(80)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def walk(run):
        at = 0
        while at < len(run):
            n = max((len(w) for w in words if run.startswith(w, at)), default=1)
            yield run[at : at + n]
            at += n

    for known in (words, set()):
        rows = analysis.segment_dict(docs, "text", ["doc_id"], spark.createDataFrame([(w,) for w in known], "word string"))
        got = {}
        for r in rows.orderBy("doc_id", "run_pos", "i").collect():
            got.setdefault(r.doc_id, []).append(r.term)
        for i, text in enumerate(texts):
            parts = re.findall("[天地人大]+|a+", text or "")
            assert got.get(i, []) == [w for p in parts for w in ([p] if p[0] == "a" else walk(p) if known else p)]


def test_merged_batches_answer_alike_from_one_scan_and_can_be_written_again(spark, tmp_path):
    path = str(tmp_path / "i")
    for b in range(12):
        rows = [(d, f"u{d}", f"alpha w{b} d{d}") for d in range(b, b + 3)] if b != 5 else []
        docs = spark.createDataFrame(rows, "doc_id long, url string, text string").coalesce(1)
        index.index_append(index.build_docs(docs, b), path, b)

    def answers(latest):
        asked = spark.createDataFrame([(1, "alpha"), (2, "w3 d4"), (3, "w11")], "query_id int, text string")
        hits = search.search(index.read_index(spark, path), search.clauses_of_text(asked), SearchConfig(top_k=50), latest_only=latest).hits
        return sorted(map(tuple, hits.collect()))

    before = [answers(False), answers(True)]
    opened = index.read_index(spark, path)
    for table in (opened.docs, opened.postings, opened.terms, opened.fields):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Union" not in plan
    index.index_merge(spark, path, list(range(4)))
    index.index_merge(spark, path)
    index.index_merge(spark, path)
    assert [answers(False), answers(True)] == before
    assert len({r["attempt"] for r in index._published(spark, path)}) == 1
    again = spark.createDataFrame([(90, "u90", "alpha beta")], "doc_id long, url string, text string")
    index.index_append(index.build_docs(again, 3), path, 3)
    opened = index.read_index(spark, path)
    assert [r.doc_id for r in opened.docs.filter("batch_id = 3").collect()] == [90]
    assert opened.docs.count() == 3 * 10 + 1
    assert {r.term for r in opened.terms.filter("batch_id = 3").collect()} == {"alpha", "beta"}


def test_equal_phrases_are_scored_once_for_all_their_clauses(spark):
    texts = ["alpha beta alpha beta", "beta alpha", "alpha alpha gamma", "gamma beta alpha", "beta"]
    docs = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "doc_id long, url string, text string")
    opened = index.index_of_docs(index.build_docs(docs))
    rows = [
        (1, 0, "should", ["alpha", "beta"], 1.0),
        (2, 0, "should", ["alpha", "beta"], 3.0),
        (3, 0, "must", ["beta", "alpha"], 1.0),
        (3, 1, "must_not", ["gamma", "beta"], 1.0),
        (4, 0, "should", ["alpha", "alpha"], 1.0),
        (5, 0, "should", ["gamma"], 1.0),
        (6, 0, "should", ["alpha", "unknown"], 1.0),
        (7, 0, "should", ["gamma", "beta", "alpha"], 1.0),
        (7, 1, "should", ["alpha", "beta"], 1.0),
    ]
    asked = spark.createDataFrame(rows, "query_id int, clause_id int, occur string, terms array<string>, boost double")
    found = search.search(opened, search.complete_clauses(asked.withColumn("kind", F.lit("phrase")))).hits.collect()
    got = {(r.query_id, r.doc_id): r.score for r in found}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (3, 1), (4, 2), (5, 2), (5, 3), (7, 3), (7, 0)}
    assert got[2, 0] == pytest.approx(3 * got[1, 0], abs=3e-6) and got[7, 0] == got[1, 0]
    phrases, clauses = search._distinct_phrases(
        search.leaves_of(opened, search.prepare(search.complete_clauses(asked.withColumn("kind", F.lit("phrase")))), SearchConfig()).table
    )
    assert phrases.count() == 6 and clauses.count() == 8
