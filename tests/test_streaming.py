"""Streaming jobs: late rows, replays and the batch result."""

import hashlib

from pyspark.sql import functions as F

from pagewell.catalog.streams import arriving
from pagewell.config import CrawlConfig
from pagewell.operators.visits import revisit_interval
from pagewell.session import scratch_path
from pagewell.sources.store import KeyedStore
from pagewell.sources.tables import stream_table
from pagewell.streaming import incremental

SCHEMA = "url_md5 string, ts double, id bigint, outcome string"
CONFIG = CrawlConfig(start_url="http://s.org", default_interval=10.0, min_interval=5.0, max_interval=80.0)


def staged(spark, *batches):
    path = scratch_path(spark, "staged")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return stream_table(spark, path, SCHEMA, files_per_trigger=1)


def test_state_equals_batch_and_late_rows_are_counted(spark):
    first = [("a", 0.0, 1, "changed"), ("a", 10.0, 2, "changed"), ("b", 3.0, 3, "unchanged")]
    second = [("a", 15.0, 5, "unchanged"), ("a", 4.0, 4, "changed"), ("c", 9.0, 6, "changed")]
    stream = staged(spark, first, second)
    got = incremental.run_revisit_state(stream, CONFIG, scratch_path(spark, "s"), scratch_path(spark, "c"))
    rows = {r.url_md5: tuple(r)[1:] for r in got.collect()}
    batch = revisit_interval(spark.createDataFrame(first + second, SCHEMA), CONFIG)
    assert {k: v[:4] for k, v in rows.items()} == {r.url_md5: tuple(r)[1:] for r in batch.collect()}
    assert {k: v[4] for k, v in rows.items()} == {"a": 1, "b": 0, "c": 0}

    table = incremental.run_revisit_table(
        staged(spark, first, second), CONFIG, scratch_path(spark, "t"), scratch_path(spark, "c")
    )
    assert {r.url_md5: tuple(r)[1:] for r in table.collect()} == {k: v[:4] for k, v in rows.items()}


def test_seen_urls_are_pushed_once_over_batches(spark):
    path = scratch_path(spark, "links")
    for urls in (["http://s.org/x", "http://s.org/x/"], ["http://s.org/x", "http://s.org/y", ""]):
        spark.createDataFrame([(u,) for u in urls], "dst_url string").coalesce(1).write.mode("append").parquet(path)
    stream = stream_table(spark, path, "dst_url string", files_per_trigger=1)
    seen = incremental.run_frontier_dedup(stream, scratch_path(spark, "seen"), scratch_path(spark, "c"))
    got = [(r.url, r.batch) for r in seen.orderBy("url").collect()]
    assert got == [("http://s.org/x", 0), ("http://s.org/y", 1)]
    assert seen.filter(F.col("url") == "").count() == 0


def test_slices_arrive_as_many_files_and_rows_without_an_order_come_first(spark):
    rows = spark.createDataFrame([(None if i % 50 == 0 else i, f"u{i}") for i in range(200)], "n int, u string").repartition(4)
    batches = []

    def drain(stream):
        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
            lambda b, _: batches.append((b.rdd.getNumPartitions(), {r.n for r in b.collect()}))
        ).trigger(availableNow=True).start()
        query.awaitTermination()

    checkpoint = scratch_path(spark, "c")
    arriving(rows, "n", drain)
    assert len(batches) == 3 and None in batches[0][1] and sum(len(b[1]) for b in batches) == 197
    assert max(x for x in batches[0][1] if x is not None) < min(batches[1][1]) and max(batches[1][1]) < min(batches[2][1])
    arriving(rows.limit(0), "n", lambda stream: None)


def test_a_micro_batch_opens_only_the_folders_of_its_keys(spark):
    path, checkpoint, store = scratch_path(spark, "links"), scratch_path(spark, "c"), scratch_path(spark, "seen")
    for urls in ([f"http://s.org/{i}" for i in range(60)], ["http://s.org/7"]):
        spark.createDataFrame([(u,) for u in urls], "dst_url string").write.mode("append").parquet(path)
        seen = incremental.run_frontier_dedup(stream_table(spark, path, "dst_url string"), store, checkpoint, digits=1)
    assert seen.count() == 60 and {r.batch for r in seen.collect()} == {0}
    kept = KeyedStore(spark, store, ("url_md5",), digits=1, schema="url_md5 string, url string, batch int")
    one = spark.createDataFrame([(hashlib.md5(b"http://s.org/7").hexdigest(),)], "url_md5 string")
    opened = {f.split("bucket=")[1][:2] for f in kept.rows(one, before=1).inputFiles() if "bucket=" in f}
    assert opened == {"b" + one.first()[0][0]}
