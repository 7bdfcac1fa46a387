"""Visit outcomes, revisit intervals, visit state, index flags and the error log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewell.config import CrawlConfig
from pagewell.operators.joins import fits_broadcast
from pagewell.session import scratch_path

# Failures of the network or the browser; any other failure is "unknown".
KNOWN_ERRORS = ("HTTPError", "URLError", "ConnectionResetError", "timeout", "WebDriverException")

_STATE = "struct<last_time:double,next_time:double,interval_s:double,n_visits:bigint>"
_SLICE_ROWS = 100_000


def visit_exception(
    fetches: DataFrame, visit_state: DataFrame, keep: list[str] | None = None
) -> DataFrame:
    """``job_id, url_md5, outcome`` of failed fetches, with the columns to ``keep``.

    A failure counts as ``unchanged`` for a URL that has visit state and as ``first``
    otherwise, even though no document was stored.
    """
    key = ["job_id", "url_md5"]
    seen = visit_state.select(*key, F.lit(True).alias("_seen"))
    return (
        fetches.filter(F.col("error_type").isNotNull())
        .join(seen, key, "left")
        .select(*key, *(keep or []), F.when(F.col("_seen"), "unchanged").otherwise("first").alias("outcome"))
    )


def error_kind(error_type: Column) -> Column:
    """``known`` for network and browser failures, ``unknown`` for the rest."""
    return F.when(error_type.isin(*KNOWN_ERRORS), "known").otherwise("unknown")


def error_log_latest(errors: DataFrame, order_by: list[str]) -> DataFrame:
    """Last message per ``job_id, url_md5, kind``; ``order_by`` gives the order of writing."""
    return errors.groupBy("job_id", "url_md5", "kind").agg(
        F.max_by("message", F.struct(*order_by)).alias("message")
    )


def visit_state_upsert(state: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Visit state after ``updates``; the highest ``seq`` of a key wins, old rows rank lowest."""
    key = ["job_id", "url_md5"]
    values = ["last_time", "next_time", "interval_s"]
    old = state.select(*key, *values).withColumn(seq, F.lit(-1).cast("long"))
    rows = old.unionByName(updates.select(*key, *values, F.col(seq).cast("long").alias(seq)))
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.col(seq)).alias("s"))
    return newest.select(*key, *[F.col(f"s.{v}").alias(v) for v in values])


def need_index_mark(outcomes: DataFrame) -> DataFrame:
    """Keys whose document is new or changed."""
    return outcomes.filter(F.col("outcome").isin("first", "changed")).select(
        "job_id", "url_md5"
    ).distinct()


def next_interval(outcome: Column, interval: Column, config: CrawlConfig) -> Column:
    """Interval after a visit: default when there was none, halved on change, else doubled."""
    return (
        F.when(interval.isNull(), F.lit(config.default_interval))
        .when(outcome == "changed", F.greatest(F.lit(config.min_interval), interval / 2))
        .otherwise(F.least(F.lit(config.max_interval), interval * 2))
    )


def _fold(visits: Column, start: Column, config: CrawlConfig) -> Column:
    """State after an array of ``(ts, id, outcome)`` in order; visits before the due time are skipped."""

    def step(state: Column, visit: Column) -> Column:
        due = state["next_time"].isNull() | (visit["ts"] >= state["next_time"])
        interval = next_interval(visit["outcome"], state["interval_s"], config)
        after = F.struct(
            visit["ts"].alias("last_time"),
            (visit["ts"] + interval).alias("next_time"),
            interval.alias("interval_s"),
            (state["n_visits"] + 1).alias("n_visits"),
        ).cast(_STATE)
        return F.when(due, after).otherwise(state)

    return F.aggregate(visits, start, step)


def _empty_state() -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        none.alias("last_time"),
        none.alias("next_time"),
        none.alias("interval_s"),
        F.lit(0).cast("long").alias("n_visits"),
    ).cast(_STATE)


def revisit_interval(
    visits: DataFrame,
    config: CrawlConfig,
    state: DataFrame | None = None,
    slice_rows: int = _SLICE_ROWS,
) -> DataFrame:
    """Visit state per URL after its visits in time order.

    ``visits(url_md5, ts, id, outcome)``; ``state`` is what earlier visits left. The first
    accepted visit sets the default interval, a changed page halves it, any other outcome
    doubles it, within the limits; a visit before the due time is skipped.

    Visits of one URL depend on each other, so they are folded in order, but never more
    than ``slice_rows`` in one group: a URL with more is cut into time slices that are
    folded round by round, each starting from the state the previous one left. Buckets no
    longer than the shortest interval accept at most one visit, so a bucket that alone
    exceeds the limit needs only its earliest due visit, a plain minimum.
    """
    columns = ["url_md5", "last_time", "next_time", "interval_s", "n_visits"]
    start = None
    if state is not None:
        start = state.select("url_md5", F.struct(*columns[1:]).cast(_STATE).alias("s0"))
    sizes = visits.groupBy("url_md5").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.filter(F.col("n") > slice_rows).select("url_md5")
    if hot.isEmpty():
        return _fold_groups(visits, start, config).select("url_md5", "s.*")
    small_hot = fits_broadcast(hot)
    keys = F.broadcast(hot) if small_hot else hot
    cold_state = _fold_groups(visits.join(keys, "url_md5", "left_anti"), start, config)
    hot_start = None if start is None else start.join(keys, "url_md5", "left_semi")
    if start is not None:
        cold_state = cold_state.unionByName(
            start.join(visits.select("url_md5").distinct(), "url_md5", "left_anti").select(
                "url_md5", F.col("s0").alias("s")
            )
        )
    hot_state = _fold_slices(visits.join(keys, "url_md5", "left_semi"), hot_start, config, slice_rows)
    return cold_state.unionByName(hot_state).select("url_md5", "s.*")


def _fold_groups(visits: DataFrame, start: DataFrame | None, config: CrawlConfig) -> DataFrame:
    grouped = visits.groupBy("url_md5").agg(
        F.sort_array(F.collect_list(F.struct("ts", "id", "outcome"))).alias("v")
    )
    if start is None:
        return grouped.select("url_md5", _fold(F.col("v"), _empty_state(), config).alias("s"))
    both = grouped.join(start, "url_md5", "full")
    begin = F.coalesce(F.col("s0"), _empty_state())
    return both.select(
        "url_md5",
        F.when(F.col("v").isNull(), F.col("s0")).otherwise(_fold(F.col("v"), begin, config)).alias("s"),
    )


def _fold_slices(
    visits: DataFrame, start: DataFrame | None, config: CrawlConfig, slice_rows: int
) -> DataFrame:
    """Fold URLs with many visits slice by slice; see ``revisit_interval``."""
    spark = visits.sparkSession
    # The first visit sets the default interval as it is, so a bucket is no longer than that either.
    width = min(config.min_interval, config.default_interval, config.max_interval)
    bucket = F.floor(F.col("ts") / width)
    # Of the visits at one instant only the first can be accepted.
    firsts = visits.groupBy("url_md5", "ts").agg(
        F.min(F.struct("id", "outcome")).alias("f")
    ).select("url_md5", "ts", "f.id", "f.outcome", bucket.alias("bucket"))
    sizes = firsts.groupBy("url_md5", "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("url_md5").orderBy("bucket")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # A slice ends where the running size passes a multiple of half the limit; a large
    # bucket always stands alone.
    large = F.col("n") > slice_rows // 2
    cut = (
        (F.floor(F.sum(F.when(large, 0).otherwise(F.col("n"))).over(upto) / (slice_rows // 2)))
        + F.sum(F.when(large, 2).otherwise(0)).over(upto)
        - F.when(large, 1).otherwise(0)
    )
    sliced_buckets = (
        sizes.withColumn("cut", cut)
        .withColumn("large", large)
        .withColumn("slice", F.dense_rank().over(Window.partitionBy("url_md5").orderBy("cut")))
        .select("url_md5", "bucket", "slice", "large")
    )
    path = scratch_path(spark, "revisit-slices")
    # The rows of a slice are spread by URL and time over a fixed number of files.
    spread = F.pmod(F.xxhash64("url_md5", "ts"), F.lit(32))
    (
        firsts.join(sliced_buckets, ["url_md5", "bucket"])
        .repartition("slice", spread)
        .write.partitionBy("slice")
        .parquet(path)
    )
    table = spark.read.parquet(path)
    rounds = sliced_buckets.agg(F.max("slice")).first()[0]
    if start is None:
        current = visits.select("url_md5").distinct().withColumn("s0", _empty_state())
    else:
        current = visits.select("url_md5").distinct().join(start, "url_md5", "left").withColumn(
            "s0", F.coalesce("s0", _empty_state())
        )
    for number in range(1, rounds + 1):
        rows = table.filter(F.col("slice") == number).drop("slice", "bucket")
        states = F.broadcast(current) if fits_broadcast(current) else current
        due = rows.join(states, "url_md5").filter(
            F.col("s0.next_time").isNull() | (F.col("ts") >= F.col("s0.next_time"))
        )
        visit = F.struct("ts", "id", "outcome")
        many = due.filter(~F.col("large")).groupBy("url_md5").agg(F.sort_array(F.collect_list(visit)).alias("v"))
        one = due.filter("large").groupBy("url_md5").agg(F.array(F.min(visit)).alias("v"))
        step = (
            current.join(many.unionByName(one), "url_md5", "left")
            .select(
                "url_md5",
                F.when(F.col("v").isNull(), F.col("s0"))
                .otherwise(_fold(F.col("v"), F.col("s0"), config))
                .alias("s0"),
            )
        )
        out = scratch_path(spark, "revisit-state")
        step.write.parquet(out)
        current = spark.read.parquet(out)
    return current.select("url_md5", F.col("s0").alias("s"))
