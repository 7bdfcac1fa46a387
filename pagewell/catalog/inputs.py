"""Inputs that the queries derive from the given tables, each with its SQL form.

Pages stand for the raw page store, documents for parsed texts, events for the visit log
(user is the URL, type is the outcome) and benchmark texts for the users' queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.config import CrawlConfig
from pagewell.functions.text import tokens
from pagewell.functions.urls import canonical_url, url_key
from pagewell.operators.frontier import extract_links
from pagewell.operators.index import Index, build_docs, index_append, read_index
from pagewell.session import scratch_path
from pagewell.sources.tables import read_table, spread_small

CONFIG = CrawlConfig(
    start_url="http://start.example.com/",
    allow=r"example\.(com|org)",
    deny=r"(the[a-z]*,)|(/archive/)",
    deny_file_type="html",
)
START_MD5 = "md5('http://start.example.com')"


# --- tables ----------------------------------------------------------------------------


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread_small(read_table(spark, folder, "pages"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the URL they stand for."""
    source = spread_small(read_table(spark, folder, "documents"))
    url = F.concat(
        F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string")
    )
    return source.select("doc_id", "text", "lang", "n_chars", url.alias("url"), url_key(url).alias("url_md5"))


SQL_DOCUMENTS = """
documents_in AS (
  SELECT doc_id, text, lang, n_chars,
         'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS VARCHAR) AS url
  FROM documents)
"""


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever zone the session has."""
    micros = (
        F.unix_date(F.to_date(ts)) * F.lit(86_400_000_000).cast("long")
        + F.hour(ts) * F.lit(3_600_000_000).cast("long")
        + F.minute(ts) * F.lit(60_000_000).cast("long")
        + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    )
    return micros / F.lit(1e6)


def visit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Visits ``url, url_md5, ts, id, event_type, outcome, value, props``."""
    events = read_table(spark, folder, "events")
    url = F.concat(F.lit("http://users.example.com/"), F.col("user_id").cast("string"))
    return events.select(
        url.alias("url"),
        url_key(url).alias("url_md5"),
        seconds(F.col("ts")).alias("ts"),
        F.col("event_id").alias("id"),
        "event_type",
        F.when(F.col("event_type") == "purchase", "changed").otherwise("unchanged").alias("outcome"),
        "value",
        "props",
    )


SQL_VISITS = """
visit_log AS (
  SELECT 'http://users.example.com/' || CAST(user_id AS VARCHAR) AS url,
         md5('http://users.example.com/' || CAST(user_id AS VARCHAR)) AS url_md5,
         epoch_us(ts) / 1e6 AS ts, event_id AS id, event_type,
         CASE WHEN event_type = 'purchase' THEN 'changed' ELSE 'unchanged' END AS outcome,
         value, props
  FROM events)
"""


# --- links -----------------------------------------------------------------------------


def sql_canonical(url: str) -> str:
    """SQL of the canonical form of a URL expression."""
    trimmed = f"regexp_replace({url}, '/\\z', '')"
    return sql_quote(trimmed)


def sql_quote(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({text}, ''), lambda c: "
        r"CASE WHEN regexp_matches(c, '[^\x20-\x7e\t\n\r\x0b\x0c]') THEN url_encode(c) ELSE c END), '')"
    )


SQL_LINKS = r"""
no_script AS (
  SELECT page_id, url, regexp_replace(html,
    '(?is)<script\b[^>]*>.*?</script\s*>(?:[^<]|</[^>]*>|<!--.*?-->)*', '<x>', 'g') AS h
  FROM pages),
no_style AS (
  SELECT page_id, url, regexp_replace(h,
    '(?is)<style\b[^>]*>.*?</style\s*>(?:[^<]|</[^>]*>|<!--.*?-->)*', '<x>', 'g') AS h
  FROM no_script),
visible AS (
  SELECT page_id, url, regexp_replace(h, '(?s)<!--.*?-->', '<x>', 'g') AS h FROM no_style),
anchors AS (
  SELECT page_id, url, regexp_extract_all(h, '(?i)<a\s+href="([^"]*)"[^>]*>', 1) AS l FROM visible),
hrefs AS (
  SELECT page_id, url AS src_url, unnest(l) AS href, generate_subscripts(l, 1) - 1 AS pos FROM anchors),
links AS (
  SELECT page_id, src_url, CAST(pos AS INTEGER) AS pos,
         regexp_extract(src_url, '^https?://[^/?#]*')
           || trim(replace(replace(href, '&quot;', '"'), '&amp;', '&')) AS dst_url
  FROM hrefs)
"""


def links(spark: SparkSession, folder: str) -> DataFrame:
    return extract_links(pages(spark, folder))


SQL_VALID_LINKS = SQL_LINKS + r""",
valid_links AS (
  SELECT * FROM links
  WHERE dst_url <> '' AND regexp_matches(dst_url, 'example\.(com|org)')
    AND NOT regexp_matches(dst_url, '(the[a-z]*,)|(/archive/)'))
"""


# --- job state over the pages ------------------------------------------------------------


def page_urls(spark: SparkSession, folder: str) -> DataFrame:
    """URL map of two jobs: pages whose URL has a query string belong to ``paged``."""
    url = canonical_url(F.col("url"))
    job = F.when(F.col("url").contains("?"), "paged").otherwise("plain")
    return read_table(spark, folder, "pages").select(
        job.alias("job_id"), url_key(url).alias("url_md5"), url.alias("url"), "page_id"
    )


SQL_PAGE_URLS = f"""
page_urls AS (
  SELECT job_id, md5(url) AS url_md5, url, page_id FROM (
    SELECT CASE WHEN contains(url, '?') THEN 'paged' ELSE 'plain' END AS job_id,
           {sql_canonical('url')} AS url, page_id
    FROM pages))
"""


# --- texts before and after a fetch ------------------------------------------------------


def snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Old texts, fetched texts and visited keys, over all documents.

    By key: some were never stored, some fetches fail, and the others come back the same,
    with digits put in, doubled, or with a sign in front that no text has.
    """
    docs = read_table(spark, folder, "documents")
    n = F.col("doc_id")
    key = F.md5(n.cast("string")).alias("url_md5")
    text = (
        F.when(n % 4 == 0, F.col("text"))
        .when(n % 4 == 1, F.regexp_replace("text", "\n", "17\n"))
        .when(n % 4 == 2, F.concat("text", "text"))
        .otherwise(F.concat(F.lit("\u2603"), "text"))
    )
    failed = n % 17 == 0
    new = docs.select(
        key, F.when(~failed, text).alias("text"), F.when(failed, "error").otherwise("ok").alias("status")
    )
    old = docs.filter(n % 10 != 9).select(key, "text")
    return spread_small(old), spread_small(new), old.select("url_md5")


SQL_SNAPSHOTS = r"""
snapshots AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS url_md5, doc_id,
         CASE WHEN doc_id % 10 <> 9 THEN text END AS old_text,
         CASE WHEN doc_id % 17 = 0 THEN NULL
              WHEN doc_id % 4 = 0 THEN text
              WHEN doc_id % 4 = 1 THEN replace(text, chr(10), '17' || chr(10))
              WHEN doc_id % 4 = 2 THEN text || text
              ELSE chr(9731) || text END AS new_text
  FROM documents)
"""


# --- queries and index ---------------------------------------------------------------------


def user_queries(spark: SparkSession, folder: str) -> DataFrame:
    """``query_id, text``: each benchmark text as a query."""
    return read_table(spark, folder, "benchmark").select(F.col("item_id").cast("int").alias("query_id"), "text")


def query_words(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """``query_id, w``: the tokens of each benchmark text, ``n`` by ``n``, each group a query.

    The last group of a text reaches back to have ``n`` words too; a text with fewer words is one
    group. Every word of every text is in a query.
    """
    words = read_table(spark, folder, "benchmark").select("item_id", tokens(F.col("text")).alias("all"))
    last = F.greatest(F.size("all") - n, F.lit(0))
    start = F.explode(F.array_union(F.sequence(F.lit(0), last, F.lit(n)), F.array(last)))
    return words.select("item_id", "all", start.alias("start")).select(
        (F.col("item_id") * 1000 + F.col("start")).cast("int").alias("query_id"),
        F.slice("all", F.col("start") + 1, n).alias("w"),
    )


SQL_QUERIES = "user_queries AS (SELECT CAST(item_id AS INTEGER) AS query_id, text FROM benchmark)"


def sql_query_words(n: int) -> str:
    return rf"""
qw AS (
  SELECT CAST(item_id * 1000 + start AS INTEGER) AS query_id, list_slice(l, start + 1, start + {n}) AS w FROM (
    SELECT item_id, l, unnest(list_distinct(list_append(range(0, last + 1, {n}), last))) AS start FROM (
      SELECT item_id, l, greatest(CAST(len(l) AS BIGINT) - {n}, 0) AS last FROM (
        SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS l FROM benchmark))))
"""

SQL_DOCS = SQL_DOCUMENTS + r""",
docs AS (
  SELECT doc_id, url, text AS content,
         regexp_replace(split_part(text, chr(10), 1), '\r\z', '') AS title
  FROM documents_in
  WHERE text = '' OR regexp_matches(text, '[^\r\n]|\r([^\n]|\z)')),
field_tokens AS (
  SELECT doc_id, 'content' AS field, regexp_extract_all(lower(content), '[\p{L}\p{N}_]+') AS t FROM docs
  UNION ALL
  SELECT doc_id, 'title' AS field, regexp_extract_all(lower(title), '[\p{L}\p{N}_]+') AS t FROM docs),
tokens AS (
  SELECT doc_id, field, unnest(t) AS term, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos
  FROM field_tokens)
"""

SQL_INDEX = SQL_DOCS + r""",
lengths AS (SELECT doc_id, field, CAST(len(t) AS BIGINT) AS dl FROM field_tokens),
counts AS (SELECT field, term, doc_id, count(*) AS tf FROM tokens GROUP BY field, term, doc_id),
postings AS (
  SELECT c.field, c.term, c.doc_id, c.tf, l.dl
  FROM counts c JOIN lengths l ON c.doc_id = l.doc_id AND c.field = l.field),
term_stats AS (
  SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS ttf FROM postings GROUP BY field, term),
field_stats AS (
  SELECT field, count(*) FILTER (WHERE dl > 0) AS n_docs, CAST(sum(dl) AS BIGINT) AS total_len
  FROM lengths GROUP BY field)
"""

_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """State table that a crawl job would have in storage, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        make().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


_INDEXES: dict[tuple[str, str], str] = {}


def documents_index(spark: SparkSession, folder: str) -> Index:
    """Index over all documents, built once per session and folder and read by every search."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        path = scratch_path(spark, "index")
        index_append(build_docs(documents(spark, folder)), path, 0)
        _INDEXES[key] = path
    return read_index(spark, _INDEXES[key])
