"""Frontier, jobs, visits, changes, closure and a whole refresh round."""

import difflib
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewell.config import CrawlConfig
from pagewell.operators import change, frontier, visits
from pagewell.plans.closure import crawl_closure
from pagewell.plans.refresh import CrawlStore, CrawlTables, refresh_round, take_due, write_tables
from pagewell.session import scratch_path
from pagewell.sources.store import KeyedStore
from pagewell.sources.tables import FETCH_SCHEMA

CONFIG = CrawlConfig(start_url="http://s.org/", allow=r"s\.org", deny="secret")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def keys(df):
    return {(r.job_id, r.url_md5) for r in df.collect()}


@pytest.mark.parametrize("limit", [0, 37, 5000])
def test_frontier_take_is_the_lowest_keys(spark, limit):
    rows = [(j, md5(f"{j}{i}"), f"{j}{i}") for j, n in (("a", 300), ("b", 20)) for i in range(n)]
    urls = spark.createDataFrame(rows, "job_id string, url_md5 string, url string")
    got = keys(frontier.frontier_take(urls, urls, limit))
    want = set()
    for job in "ab":
        want |= set(sorted((r[0], r[1]) for r in rows if r[0] == job)[:limit])
    assert got == want


def test_empty_url_and_slash_variants_are_one_key(spark):
    df = spark.createDataFrame([("http://s.org/x/",), ("http://s.org/x",), ("",), ("/",)], "u string")
    rows = frontier.as_urls(df, "u", F.lit("j")).collect()
    assert [(r.url, r.url_md5) for r in rows] == [("http://s.org/x", md5("http://s.org/x"))]


def test_job_seed_modes(spark):
    job = md5("http://s.org")
    schema = "job_id string, url_md5 string, url string"
    known = spark.createDataFrame([(job, "k1", "u1"), (job, "k2", "u2"), ("other", "k3", "u3")], schema)
    waiting = known.filter("url_md5 = 'k2'").select("job_id", "url_md5")
    nothing = known.filter("false")

    def seeds(*args):
        got = frontier.job_seed(*args, CONFIG)
        return None if got is None else {r.url for r in got.collect()}

    assert seeds("new_job", known, waiting) == {"http://s.org"}
    assert seeds("resume", known, waiting) == {"u2"}
    assert seeds("resume", known, nothing) is None
    assert seeds("new_batch", known, nothing) == {"u1", "u2"}
    assert seeds("new_batch", nothing, nothing) == {"http://s.org"}
    assert seeds("auto", known, waiting) == {"u2"}
    assert seeds("auto", known, nothing) == {"u1", "u2"}
    with pytest.raises(ValueError):
        frontier.job_seed("other", known, waiting, CONFIG)


def closure_by_hand(edges, seed, budget):
    """Rounds of the crawl with the frontier taken in key order."""
    waiting, visited, rounds = {seed}, {}, 0
    while waiting and (budget is None or len(visited) < budget):
        room = len(waiting) if budget is None else budget - len(visited)
        taken = sorted(waiting, key=md5)[:room]
        for u in taken:
            visited[u] = rounds
        waiting -= set(taken)
        for u in taken:
            for a, b in edges:
                if a == u and "secret" not in a and "secret" not in b and b not in visited:
                    waiting.add(b)
        rounds += 1
    return visited


@pytest.mark.parametrize("budget", [None, 25])
def test_closure_with_and_without_budget(spark, budget):
    rng = random.Random(3)
    names = [f"http://s.org/{i}{'secret' if i % 11 == 5 else ''}" for i in range(60)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(150)]
    seed = next(a for a, _ in edges if "secret" not in a)
    got = crawl_closure(
        spark.createDataFrame(edges, "src_url string, dst_url string"),
        spark.createDataFrame([(seed,)], "url string"),
        CONFIG,
        budget,
    )
    assert {r.url: r.round for r in got.collect()} == closure_by_hand(edges, seed, budget)


def ratio(a, b):
    strip = lambda s: re.sub("[0-9]", "", s)
    return difflib.SequenceMatcher(None, strip(a), strip(b)).ratio()


def test_change_detect_equals_the_exact_ratio(spark):
    rng = random.Random(5)
    old, new, want = [], [], {}
    for i in range(120):
        a = "".join(rng.choice("abcdefgh 0123\n") for _ in range(rng.choice([0, 30, 700, 1500])))
        b = list(a)
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            b.insert(rng.randint(0, len(b)), rng.choice("xyz12"))
        b = "".join(b)
        key = f"k{i}"
        old.append((key, a))
        new.append((key, b, "ok"))
        want[key] = "unchanged" if ratio(a, b) > 0.998 else "changed"
    new += [("n1", "t", "ok"), ("e1", None, "error"), ("e2", None, "error"), ("v0", "t", "ok")]
    old += [("e1", "t"), ("v0", "t")]
    want |= {"n1": "first", "e1": "unchanged", "e2": "first", "v0": "first"}
    seen = [(f"k{i}",) for i in range(120)] + [("e1",), ("n1",)]
    got = change.change_detect(
        spark.createDataFrame(old, "url_md5 string, text string"),
        spark.createDataFrame(new, "url_md5 string, text string, status string"),
        spark.createDataFrame(seen, "url_md5 string"),
    )
    assert {r.url_md5: r.outcome for r in got.collect()} == want


def fold_by_hand(rows, config, state=None):
    last, due, interval, n = state or (None, None, None, 0)
    for ts, _, outcome in sorted(rows):
        if due is not None and ts < due:
            continue
        if interval is None:
            interval = config.default_interval
        elif outcome == "changed":
            interval = max(config.min_interval, interval / 2)
        else:
            interval = min(config.max_interval, interval * 2)
        last, due, n = ts, ts + interval, n + 1
    return (last, due, interval, n)


@pytest.mark.parametrize("slice_rows,with_state", [(100_000, True), (100_000, False), (80, True), (80, False)])
def test_revisit_fold_with_hot_urls(spark, slice_rows, with_state):
    rng = random.Random(11)
    config = CrawlConfig(start_url="http://s.org", default_interval=40.0, min_interval=10.0, max_interval=300.0)
    rows = []
    for url, n, span in (("hot", 300, 3000), ("busy", 200, 25), ("cold", 5, 400), ("one", 1, 10)):
        for i in range(n):
            rows.append((url, float(rng.randint(0, span)), len(rows), rng.choice(["changed", "unchanged"])))
    state = {"hot": (100.0, 180.0, 80.0, 3), "cold": (0.0, 50.0, 50.0, 1), "gone": (1.0, 2.0, 1.0, 9)}
    start = spark.createDataFrame(
        [(k, *v) for k, v in state.items()],
        "url_md5 string, last_time double, next_time double, interval_s double, n_visits bigint",
    )
    got = visits.revisit_interval(
        spark.createDataFrame(rows, "url_md5 string, ts double, id bigint, outcome string"),
        config,
        start if with_state else None,
        slice_rows,
    )
    want = {
        u: fold_by_hand([r[1:] for r in rows if r[0] == u], config, state.get(u) if with_state else None)
        for u in ("hot", "busy", "cold", "one")
    }
    if with_state:
        want["gone"] = state["gone"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_error_log_keeps_the_last_message_per_kind(spark):
    rows = [("j", "a", "HTTPError", "m1", 1), ("j", "a", "timeout", "m2", 2), ("j", "a", "KeyError", "m3", 0)]
    df = spark.createDataFrame(rows, "job_id string, url_md5 string, error_type string, message string, ts int")
    got = visits.error_log_latest(df.withColumn("kind", visits.error_kind(F.col("error_type"))), ["ts"])
    assert {(r.kind, r.message) for r in got.collect()} == {("known", "m2"), ("unknown", "m3")}


def test_flush_clears_only_the_jobs_crawl_state(spark):
    df = spark.createDataFrame([("a", "k"), ("b", "k")], "job_id string, url_md5 string")
    tables = dict.fromkeys(["urls", "visit_state", "frontier", "visited", "need_index", "errors"], df)
    left = {n: sorted(r.job_id for r in t.collect()) for n, t in frontier.job_flush(tables, "a").items()}
    assert left == {
        **dict.fromkeys(["urls", "visit_state", "frontier", "visited"], ["b"]),
        **dict.fromkeys(["need_index", "errors"], ["a", "b"]),
    }


def test_two_refresh_rounds(spark):
    job = md5("http://s.org")
    key = "job_id string, url_md5 string"

    def table(rows, extra=""):
        return spark.createDataFrame(rows, key + extra)

    start = [(job, job)]
    tables = CrawlTables(
        urls=table([(job, job, "http://s.org")], ", url string"),
        frontier=table(start),
        visited=table([]),
        need_index=table([]),
        visit_state=table([], ", last_time double, next_time double, interval_s double"),
        errors=table([], ", kind string, message string"),
        documents=table([], ", text string"),
        pages=table([], ", html string"),
        files=table([], ", ext string, body binary"),
    )

    def page(title, links):
        anchors = "".join(f'<a href="{l}">link</a>' for l in links)
        return bytearray(f"<title>{title}</title>{anchors}".encode())

    def fetch(url, body, content_type="text/html", error=None, final=None, at=1000.0):
        return (url, final or url, 200, content_type, body, error, "boom" if error else None, at)

    popped, due = take_due(tables, CONFIG, 1000.0, 10)
    assert {r.url for r in due.collect()} == {"http://s.org"}
    log = spark.createDataFrame(
        [fetch("http://s.org", page("home", ["/a", "/b/", "/secret", "http://else.com/", "/f.pdf"]))], FETCH_SCHEMA
    )
    tables = write_tables(refresh_round(tables, popped, log, CONFIG, job, 1000.0), scratch_path(spark, "round"))
    assert {r.url for r in tables.urls.collect()} == {"http://s.org", "http://s.org/a", "http://s.org/b", "http://s.org/f.pdf"}
    assert len(keys(tables.frontier)) == 3 and keys(tables.visited) == {(job, job)}
    state = tables.visit_state.first()
    assert (state.last_time, state.next_time, state.interval_s) == (1000.0, 87400.0, 86400.0)

    popped, due = take_due(tables, CONFIG, 2000.0, 10)
    log = spark.createDataFrame(
        [
            fetch("http://s.org/a", None, None, "HTTPError"),
            fetch("http://s.org/b/", page("old b", ["/old"]), at=1990.0),
            fetch("http://s.org/b", page("b", ["/", "/a", "/c"]), at=2003.0),
            fetch("http://s.org/f.pdf", bytearray(b"%PDF"), "application/pdf", None, "http://cdn.s.org/x.v2.pdf"),
        ],
        FETCH_SCHEMA,
    )
    tables = write_tables(refresh_round(tables, popped, log, CONFIG, job, 2000.0), scratch_path(spark, "round"))
    assert {r.url for r in tables.frontier.join(tables.urls, ["job_id", "url_md5"]).collect()} == {"http://s.org/c"}
    assert [(r.kind, r.message) for r in tables.errors.collect()] == [("known", "HTTPError  boom")]
    assert [(r.ext, bytes(r.body)) for r in tables.files.collect()] == [("pdf", b"%PDF")]
    assert {r.text for r in tables.documents.collect()} == {"home\n" + "link\n" * 5, "b\n" + "link\n" * 3}
    # The later of two answers for one key counts, and a visit has the time of its answer.
    stamps = {r.url_md5: r.last_time for r in tables.visit_state.collect()}
    assert stamps[md5("http://s.org/b")] == 2003.0 and stamps[md5("http://s.org/a")] == 1000.0
    # A failed first fetch is flagged too, though it has no document.
    assert keys(tables.need_index) == {(job, md5(u)) for u in ("http://s.org", "http://s.org/a", "http://s.org/b")}


def test_filter_runs_below_the_anti_join(spark):
    links = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").selectExpr("url AS src_url", "url AS dst_url", "0 AS pos")
    found = frontier.as_urls(frontier.links_valid(links, CONFIG), "dst_url", F.lit("j"))
    visited = found.select("job_id", "url_md5")
    plan = frontier.links_unvisited(found, visited)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("RLIKE(")


def test_keys_without_url_do_not_stall_the_frontier(spark):
    lost = [("j", f"{i:032x}") for i in range(5)]
    known = [("j", md5(f"http://s.org/{i}"), f"http://s.org/{i}") for i in range(3)]
    queue = spark.createDataFrame(lost + [k[:2] for k in known], "job_id string, url_md5 string")
    urls = spark.createDataFrame(known, "job_id string, url_md5 string, url string")
    taken = frontier.frontier_take(queue, urls, 2)
    assert taken.count() == 2
    assert frontier.frontier_rest(queue, taken, urls).count() == 1


def test_a_write_of_some_keys_keeps_the_others(spark, tmp_path):
    from pagewell.sources.sinks import compact_documents, sink_documents, stored_documents

    def rows(*values):
        return spark.createDataFrame(values, "job_id string, url_md5 string, text string, seq int")

    path = str(tmp_path / "store")
    sink_documents(rows(("j", "a", "a1", 1), ("j", "b", "b1", 1), ("k", "a", "other", 1)), path, "seq")
    for _ in range(2):
        sink_documents(rows(("j", "a", "a2", 2), ("j", "a", "a1", 1)), path, "seq", version=1)
    want = {("j", "a", "a2"), ("j", "b", "b1"), ("k", "a", "other")}
    assert {(r.job_id, r.url_md5, r.text) for r in stored_documents(spark, path).collect()} == want
    one = stored_documents(spark, path, keys=spark.createDataFrame([("j", "a")], "job_id string, url_md5 string"))
    assert [r.text for r in one.collect()] == ["a2"]
    before = KeyedStore(spark, path)
    compact_documents(spark, path)
    assert len(before.attempts()) == 1
    assert {(r.job_id, r.url_md5, r.text) for r in stored_documents(spark, path).collect()} == want


def test_an_attempt_without_its_commit_is_never_read(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), schema="job_id string, url_md5 string, text string")
    assert store.rows().count() == 0
    rows = spark.createDataFrame([("j", f"{i:02x}f", f"t{i}") for i in range(40)], store.schema)
    store.write(rows)
    dead = rows.withColumn("text", F.lit("dead")).withColumn("gone", F.lit(False)).withColumn("attempt", F.lit("v1-dead"))
    dead.withColumn("bucket", F.concat(F.lit("b"), F.substring("url_md5", 1, 2))).write.partitionBy("bucket", "attempt").mode("append").parquet(f"{store.path}/rows")
    store.write(rows.limit(0), gone=rows.filter("url_md5 < '03'"))
    assert {r.text for r in store.rows().collect()} == {f"t{i}" for i in range(3, 40)}
    some = store.rows(rows.filter("url_md5 IN ('01f', '05f', '27f')"))
    assert {r.text for r in some.collect()} == {"t5", "t39"}
    assert {f.split("bucket=")[1][:3] for f in some.inputFiles() if "bucket=" in f} <= {"b01", "b05", "b27"}


def test_a_round_with_one_changed_page_writes_one_document(spark, tmp_path):
    store = CrawlStore(spark, str(tmp_path), digits=1)
    urls = [f"http://s.org/{i}" for i in range(120)]
    page = "<title>t{0}</title><p>words of page {0} that stay as they are</p><a href='/1'>x</a>"

    def log(changed):
        return spark.createDataFrame(
            [(u, u, 200, "text/html", bytearray((page.format(i) + ("<p>" + "new " * 60 if i == changed else "")).encode()), None, None, 5.0)
             for i, u in enumerate(urls)], FETCH_SCHEMA)

    key = "job_id string, url_md5 string"
    rows = [("j", md5(u), u) for u in urls]
    none = {n: spark.createDataFrame([], s.schema) for n, s in store.stores.items()}
    none["urls"] = spark.createDataFrame(rows, key + ", url string")
    none["frontier"] = none["urls"].select("job_id", "url_md5")
    store.write(CrawlTables(**none), 0)
    popped, _ = take_due(store.tables(), CONFIG, 0.0, 1000)
    store.refresh(popped, log(None), CONFIG, "j", 5.0, 1)
    assert store.rows("documents").count() == 120 and store.rows("frontier").count() == 0
    for _ in range(2):  # the second time as after a job that died
        store.refresh(none["urls"], log(7), CONFIG, "j", 9.0, 2)
    second = [a for a, v in store.stores["documents"].attempts().items() if v == 2]
    written = spark.read.parquet(f"{tmp_path}/documents/rows").filter(F.col("attempt").isin(second))
    assert [(r.url_md5, r.bucket) for r in written.collect()] == [(md5(urls[7]), "b" + md5(urls[7])[:1])]
    one = store.rows("documents", none["urls"].filter(F.col("url") == urls[7]))
    assert {f.split("bucket=")[1][:2] for f in one.inputFiles() if "bucket=" in f} == {"b" + md5(urls[7])[:1]}
    assert [r.text.count("new") for r in one.collect()] == [60]
    assert store.rows("documents").count() == 120 == store.rows("visit_state").count()
    assert store.rows("visit_state").filter("interval_s = 43200").count() == 1
