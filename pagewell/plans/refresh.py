"""One round of a crawl job on its state tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.config import CrawlConfig
from pagewell.functions.fetches import decode_body, parse_charset, route_content
from pagewell.functions.html import extract_text, needs_render
from pagewell.functions.urls import (
    canonical_url,
    file_extension,
    file_type_allowed,
    url_allowed,
    url_key,
)
from pagewell.operators.change import change_detect
from pagewell.operators.frontier import (
    KEY,
    as_urls,
    extract_links,
    frontier_due,
    frontier_rest,
    frontier_take,
    links_unvisited,
    links_valid,
    visited_add,
)
from pagewell.operators.visits import (
    error_kind,
    error_log_latest,
    need_index_mark,
    next_interval,
    visit_state_upsert,
)
from pagewell.session import stage
from pagewell.sources.store import KeyedStore


@dataclass(frozen=True)
class CrawlTables:
    """State of crawl jobs; every table carries ``job_id`` and ``url_md5``.

    ``urls(url)``, ``frontier``, ``visited``, ``need_index``,
    ``visit_state(last_time, next_time, interval_s)``, ``errors(kind, message)``,
    ``documents(text)``, ``pages(html)``, ``files(ext, body)``.
    """

    urls: DataFrame
    frontier: DataFrame
    visited: DataFrame
    need_index: DataFrame
    visit_state: DataFrame
    errors: DataFrame
    documents: DataFrame
    pages: DataFrame
    files: DataFrame


def take_due(tables: CrawlTables, config: CrawlConfig, now: float, budget: int) -> tuple[DataFrame, DataFrame]:
    """URLs popped in this round, and those of them that are due and allowed, to be fetched."""
    popped = frontier_take(tables.frontier, tables.urls, budget)
    due = frontier_due(popped, tables.visit_state, now)
    return popped, due.filter(url_allowed(F.col("url"), config.allow, config.deny))


def read_fetches(fetch_log: DataFrame, job_id: str) -> DataFrame:
    """Fetch log with key, route and decoded text; undecodable or untyped answers are errors.

    Of several answers for one key the one fetched last counts.
    """
    charset = parse_charset(F.col("content_type"))
    failed = F.col("error_type").isNotNull()
    keyed = fetch_log.withColumn("url", canonical_url(F.col("url"))).withColumn("url_md5", url_key(F.col("url")))
    order = F.struct("fetched_at", F.coalesce("status", F.lit(0)), F.xxhash64("body"))
    rest = F.struct(*fetch_log.columns)
    newest = keyed.groupBy("url_md5").agg(F.max_by(rest, order).alias("r")).select("url_md5", "r.*")
    routed = newest.select(
        F.lit(job_id).alias("job_id"),
        "url_md5",
        *fetch_log.columns,
        F.when(failed, "error").otherwise(route_content(F.col("content_type"))).alias("route"),
    )
    is_html = F.col("route") == "html"
    decoded = routed.withColumn(
        "html", decode_body(F.when(is_html, F.col("body")), F.when(is_html, charset))
    )
    lost = is_html & F.col("html").isNull() & F.col("body").isNotNull()
    untyped = F.col("content_type").isNull() & F.col("error_type").isNull()
    return (
        decoded.withColumn(
            "error_type",
            F.when(lost, "LookupError").when(untyped, "TypeError").otherwise(F.col("error_type")),
        )
        .withColumn("route", F.when(F.col("error_type").isNotNull(), "error").otherwise(F.col("route")))
    )


def to_render(fetch_log: DataFrame, job_id: str) -> DataFrame:
    """``job_id, url_md5, url`` of fetched pages that want a browser before they are read."""
    html = read_fetches(fetch_log, job_id).filter("route = 'html'")
    return html.filter(needs_render(F.col("html"))).select(*KEY, "url")


# Columns of the state tables beside job and key, and what their keys have besides.
TABLES = {
    "urls": ("url string", ()),
    "frontier": ("", ()),
    "visited": ("", ()),
    "need_index": ("", ()),
    "visit_state": ("last_time double, next_time double, interval_s double", ()),
    "errors": ("kind string, message string", ("kind",)),
    "documents": ("text string", ()),
    "pages": ("html string", ()),
    "files": ("ext string, body binary", ("ext",)),
}


def round_changes(
    stored: Callable[[str, DataFrame], DataFrame],
    popped: DataFrame,
    fetch_log: DataFrame,
    config: CrawlConfig,
    job_id: str,
    now: float,
    rendered: DataFrame | None = None,
) -> CrawlTables:
    """Rows that a round adds to the state tables or puts in the place of their keys' rows.

    ``stored(name, keys)`` gives a table's rows of some keys; no table is read beyond the keys that were fetched or
    linked to. ``popped`` are the URLs taken from the frontier, which leave it, and ``fetch_log`` the answers for
    those of them that were due; ``rendered(url_md5, html)`` replaces the source of the pages that
    a browser was asked for.
    """
    # Many tables start from the answers: they are read, decoded and reduced once.
    # The bytes of a page are its decoded text from here on; only files keep theirs.
    read = read_fetches(fetch_log, job_id)
    fetches = stage(read.withColumn("body", F.when(F.col("route") == "file", F.col("body"))), "round-fetches")
    html = fetches.filter("route = 'html'")
    if rendered is not None:
        shown = rendered.select("url_md5", F.col("html").alias("shown"))
        html = html.join(shown, "url_md5", "left").withColumn("html", F.coalesce("shown", "html"))
    # Links, texts and outcomes feed several tables each: they are computed once.
    links = links_valid(extract_links(html.select("url", "html")), config)
    found = stage(as_urls(links, "dst_url", F.lit(job_id)), "round-links")
    known = visited_add(stored("visited", found), popped)
    new_links = links_unvisited(found, known)
    texts = stage(
        html.select(
            "url_md5", extract_text(F.col("html")).alias("text"), F.lit("ok").alias("status")
        ),
        "round-texts",
    )
    errors = fetches.filter("route = 'error'").select(
        "url_md5", F.lit(None).cast("string").alias("text"), F.lit("error").alias("status")
    )
    old = stored("documents", fetches)
    state = stage(stored("visit_state", fetches), "round-state")
    judged = change_detect(
        old.select("url_md5", "text"),
        texts.unionByName(errors),
        state.select("url_md5"),
        config.same_ratio,
    )
    outcomes = stage(judged.withColumn("job_id", F.lit(job_id)), "round-outcomes")
    visits = outcomes.join(state.select(*KEY, "interval_s"), KEY, "left").join(
        fetches.select(*KEY, F.coalesce("fetched_at", F.lit(float(now))).alias("at")), KEY, "left"
    )
    at = F.coalesce("at", F.lit(float(now)))
    started = F.when(F.col("outcome") != "first", F.col("interval_s"))
    interval = next_interval(F.col("outcome"), started, config)
    updates = visits.select(
        *KEY,
        at.alias("last_time"),
        (at + interval).alias("next_time"),
        interval.alias("interval_s"),
        F.lit(0).alias("seq"),
    )
    fresh = outcomes.filter(F.col("outcome").isin("first", "changed")).select(*KEY)
    new_documents = texts.withColumn("job_id", F.lit(job_id)).join(fresh, KEY, "left_semi")
    new_pages = html.select(*KEY, "html").join(fresh, KEY, "left_semi")
    new_files = fetches.filter(
        F.lit(config.store_files) & (F.col("route") == "file") & file_type_allowed(F.col("url"), config.deny_file_type)
    ).select(*KEY, file_extension(F.col("final_url")).alias("ext"), "body")
    failures = fetches.filter("route = 'error'").select(
        *KEY,
        error_kind(F.col("error_type")).alias("kind"),
        F.concat_ws("  ", "error_type", "error_message").alias("message"),
        F.lit(1).alias("seq"),
    )
    return CrawlTables(
        urls=found.select(*KEY, "url").join(stored("urls", found).select(*KEY), KEY, "left_anti"),
        frontier=new_links.select(*KEY).join(stored("frontier", new_links).select(*KEY), KEY, "left_anti"),
        visited=popped.select(*KEY).distinct(),
        need_index=need_index_mark(outcomes),
        visit_state=visit_state_upsert(state.limit(0), updates),
        errors=error_log_latest(failures, ["seq"]),
        documents=new_documents.select(*KEY, "text"),
        pages=new_pages,
        files=new_files,
    )


def refresh_round(
    tables: CrawlTables,
    popped: DataFrame,
    fetch_log: DataFrame,
    config: CrawlConfig,
    job_id: str,
    now: float,
    rendered: DataFrame | None = None,
) -> CrawlTables:
    """State tables after a round, whole; see :func:`round_changes`.

    The tables of the result are lazy: write them before the next round. Where the tables are large and the round is
    small, keep them in a :class:`CrawlStore`, which writes the changes alone.
    """

    def stored(name: str, keys: DataFrame) -> DataFrame:
        return getattr(tables, name).join(keys.select(*KEY).distinct(), KEY, "left_semi")

    changes = round_changes(stored, popped, fetch_log, config, job_id, now, rendered)
    after = {}
    for name, (_, more) in TABLES.items():
        new, old = getattr(changes, name), getattr(tables, name)
        if name == "frontier":
            old = frontier_rest(old, popped, tables.urls)
        after[name] = _replace(old.select(*new.columns), new, [*KEY, *more])
    return replace(tables, **after)


class CrawlStore:
    """The state tables of crawl jobs below a folder, written by the keys that changed."""

    def __init__(self, spark: SparkSession, path: str, digits: int = 2) -> None:
        def store(name: str, columns: str, more: tuple[str, ...]) -> KeyedStore:
            schema = "job_id string, url_md5 string" + (f", {columns}" if columns else "")
            return KeyedStore(spark, f"{path}/{name}", (*KEY, *more), digits=digits, schema=schema)

        self.stores = {name: store(name, *spec) for name, spec in TABLES.items()}

    def rows(self, name: str, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """A table's rows, or those of the keys ``job_id, url_md5``, from whose folders alone they are read."""
        store = self.stores[name]
        if keys is None or store.key == tuple(KEY):
            return store.rows(keys, before)
        raise ValueError(f"{name} has further key columns")

    def tables(self) -> CrawlTables:
        """All tables whole."""
        return CrawlTables(**{name: store.rows() for name, store in self.stores.items()})

    def write(self, changes: CrawlTables, version: int, popped: DataFrame | None = None) -> None:
        """Write changed rows as a version of every table; the ``popped`` keys leave the frontier.

        A version written again replaces itself, so a round that died half way is simply run and written anew.
        """
        for name, store in self.stores.items():
            gone = popped if name == "frontier" else None
            store.write(getattr(changes, name), version, gone)

    def refresh(
        self, popped: DataFrame, fetch_log: DataFrame, config: CrawlConfig, job_id: str, now: float, version: int,
        rendered: DataFrame | None = None,
    ) -> None:
        """One round: only the folders of keys fetched or linked to are read, and only changed rows are written.

        The round reads the tables as they were before its version, so running it again gives the same.
        """
        popped = stage(popped.select(*KEY, "url"), "round-popped")

        def stored(name: str, keys: DataFrame) -> DataFrame:
            return self.rows(name, keys, before=version)

        changes = round_changes(stored, popped, fetch_log, config, job_id, now, rendered)
        self.write(changes, version, popped)


def _replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def write_tables(tables: CrawlTables, path: str) -> CrawlTables:
    """Write all tables below ``path`` and return them read back."""
    spark = tables.urls.sparkSession
    written = {}
    for name, df in vars(tables).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        written[name] = spark.read.parquet(f"{path}/{name}")
    return CrawlTables(**written)
