"""Scans, sinks, URL and text functions over pages and documents."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pagewell.catalog import inputs as I
from pagewell.catalog.registry import query
from pagewell.functions import fetches, html, text, urls
from pagewell.operators.frontier import extract_links
from pagewell.session import scratch_path
from pagewell.sources.sinks import sink_documents, stored_documents
from pagewell.sources.tables import read_table, scan_documents, scan_fetch_log, scan_pages

# --- scans and sinks -------------------------------------------------------------------


@query("scan_pages", "SELECT page_id, url, html FROM pages")
def _scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    return scan_pages(spark, f"{folder}/pages.parquet").select("page_id", "url", "html")


def write_loose_files(rows: DataFrame, path: str) -> None:
    """Write ``name, text`` rows as one file each, from the tasks that hold them."""
    def write(part: Iterator[Row]) -> None:
        from pyarrow import fs

        target = path if "://" in path or path.startswith("/") else f"/{path}"
        system, base = fs.FileSystem.from_uri(target.replace("file:///", "/").replace("file:/", "/"))
        system.create_dir(base, recursive=True)
        for row in part:
            with system.open_output_stream(f"{base}/{row['name']}") as out:
                out.write(row["text"].encode("utf-8"))

    rows.foreachPartition(write)


@query("scan_documents", "SELECT md5(CAST(doc_id AS VARCHAR)) AS url_md5, text FROM documents")
def _scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "loose-documents")
    docs = read_table(spark, folder, "documents")
    write_loose_files(
        docs.select(F.concat(F.md5(F.col("doc_id").cast("string")), F.lit(".txt")).alias("name"), "text"),
        path,
    )
    return scan_documents(spark, path)


def fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of all pages, with the charset, type and errors that real servers send."""
    n = F.col("page_id") % 7
    content_type = (
        F.when(n == 0, "text/html")
        .when(n == 1, "text/html; charset=UTF-8")
        .when(n == 2, "text/html; charset=ISO-8859-1")
        .when(n == 3, "text/html; charset=x-none")
        .when(n == 4, "application/pdf")
        .when(n == 5, "text/html; charset=utf-8")
    )
    body = F.encode("html", "UTF-8")
    broken = F.concat(F.unhex(F.lit("FFFE")), body)
    return I.pages(spark, folder).select(
        "url",
        F.concat("url", F.when(n == 4, ".pdf").otherwise("")).alias("final_url"),
        F.when(n == 6, 404).otherwise(200).alias("status"),
        content_type.alias("content_type"),
        F.when(n == 5, broken).when(n != 6, body).alias("body"),
        F.when(n == 6, "HTTPError").alias("error_type"),
        F.when(n == 6, "HTTP Error 404: Not Found").alias("error_message"),
        F.col("page_id").cast("double").alias("fetched_at"),
    )


_SQL_FETCH_LOG = r"""
fetch_log AS (
  SELECT url, page_id, html,
         url || CASE WHEN page_id % 7 = 4 THEN '.pdf' ELSE '' END AS final_url,
         CASE WHEN page_id % 7 = 6 THEN 404 ELSE 200 END AS status,
         CASE page_id % 7 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/html; charset=UTF-8'
           WHEN 2 THEN 'text/html; charset=ISO-8859-1' WHEN 3 THEN 'text/html; charset=x-none'
           WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'text/html; charset=utf-8' END AS content_type,
         CASE WHEN page_id % 7 = 6 THEN 'HTTPError' END AS error_type,
         CASE WHEN page_id % 7 = 6 THEN NULL
              WHEN page_id % 7 = 5 THEN 'FFFE' || hex(encode(html)) ELSE hex(encode(html)) END AS body_hex
  FROM pages)
"""


@query(
    "scan_fetch_log",
    f"WITH {_SQL_FETCH_LOG} SELECT url, final_url, CAST(status AS INTEGER) AS status, content_type, "
    "body_hex, error_type, CAST(page_id AS DOUBLE) AS fetched_at FROM fetch_log",
)
def _scan_fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "fetch-log")
    fetch_log(spark, folder).write.parquet(path)
    return scan_fetch_log(spark, path).select(
        *["url", "final_url", "status", "content_type", F.hex("body").alias("body_hex")],
        *["error_type", "fetched_at"],
    )


@query(
    "sink_documents",
    f"WITH {I.SQL_PAGE_URLS} SELECT u.job_id, u.url_md5, "
    "CASE WHEN u.page_id % 3 = 0 THEN p.html ELSE 'first version' END AS text "
    "FROM page_urls u JOIN pages p ON p.page_id = u.page_id",
)
def _sink_documents(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    keyed = I.page_urls(spark, folder).join(read_table(spark, folder, "pages").select("page_id", "html"), "page_id")
    rows = keyed.select("job_id", "url_md5", "page_id", F.col("html").alias("text"), F.lit(2).alias("seq"))
    older = rows.withColumn("text", F.lit("first version")).withColumn("seq", F.lit(1))
    # The second write brings a third of the keys; the others stay as they are.
    changed = rows.unionByName(older).filter("page_id % 3 = 0")
    sink_documents(older, path, "seq")
    sink_documents(changed, path, "seq", version=1)
    sink_documents(changed, path, "seq", version=1)
    return stored_documents(spark, path).select("job_id", "url_md5", "text")


# --- URLs --------------------------------------------------------------------------------


@query("url_key", "SELECT page_id, md5(url) AS url_md5 FROM pages")
def _url_key(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_md5"))


@query("normalize_url", r"SELECT page_id, regexp_replace(url, '/\z', '') AS normalized FROM pages")
def _normalize_url(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select(
        "page_id", urls.normalize_url(F.col("url")).alias("normalized")
    )


@query(
    "quote_url",
    f"WITH {I.SQL_LINKS} SELECT src_url, pos, {I.sql_quote('dst_url')} AS quoted FROM links",
)
def _quote_url(spark: SparkSession, folder: str) -> DataFrame:
    return I.links(spark, folder).select("src_url", "pos", urls.quote_url(F.col("dst_url")).alias("quoted"))


@query("resolve_url", f"WITH {I.SQL_LINKS} SELECT DISTINCT src_url, href, dst_url FROM (SELECT h.src_url, h.href, l.dst_url FROM hrefs h JOIN links l ON h.src_url = l.src_url AND h.pos = l.pos)")
def _resolve_url(spark: SparkSession, folder: str) -> DataFrame:
    hrefs = I.pages(spark, folder).select(
        F.col("url").alias("src_url"), F.explode(html.extract_hrefs(F.col("html"))).alias("href")
    )
    return hrefs.distinct().select(
        "src_url", "href", urls.resolve_url(F.col("src_url"), F.col("href")).alias("dst_url")
    )


@query(
    "url_filter",
    r"SELECT page_id, url FROM pages WHERE regexp_matches(url, 'example\.(com|org)') "
    r"AND NOT regexp_matches(url, 'page=[0-9]+')",
)
def _url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select("page_id", "url").filter(
        urls.url_allowed(F.col("url"), r"example\.(com|org)", r"page=[0-9]+")
    )


@query(
    "file_type_filter",
    "SELECT page_id, url, list_extract(string_split(url, '.'), -1) AS ext FROM pages "
    "WHERE NOT regexp_matches(list_extract(string_split(url, '.'), -1), 'html')",
)
def _file_type_filter(spark: SparkSession, folder: str) -> DataFrame:
    return (
        read_table(spark, folder, "pages")
        .filter(urls.file_type_allowed(F.col("url"), "html"))
        .select("page_id", "url", urls.file_extension(F.col("url")).alias("ext"))
    )


# --- fetch results -------------------------------------------------------------------------


@query(
    "parse_charset",
    f"WITH {_SQL_FETCH_LOG} SELECT url, CASE WHEN contains(content_type, 'charset=') "
    "THEN list_extract(string_split(content_type, 'charset='), -1) ELSE 'UTF-8' END AS charset FROM fetch_log",
)
def _parse_charset(spark: SparkSession, folder: str) -> DataFrame:
    return fetch_log(spark, folder).select("url", fetches.parse_charset(F.col("content_type")).alias("charset"))


@query(
    "decode_body",
    f"""WITH {_SQL_FETCH_LOG}
    SELECT url, CASE
        WHEN page_id % 7 IN (3, 6) THEN NULL
        WHEN page_id % 7 = 2 THEN array_to_string(list_transform(
          range(0, length(body_hex) // 2),
          lambda i: chr(CAST('0x' || substr(body_hex, 2 * i + 1, 2) AS INTEGER))), '')
        ELSE html END AS html
    FROM fetch_log""",
)
def _decode_body(spark: SparkSession, folder: str) -> DataFrame:
    charset = fetches.parse_charset(F.col("content_type"))
    return fetch_log(spark, folder).select("url", fetches.decode_body(F.col("body"), charset).alias("html"))


@query(
    "route_content",
    f"WITH {_SQL_FETCH_LOG} SELECT url, CASE WHEN content_type IS NULL THEN 'error' "
    "WHEN contains(content_type, 'text/html') THEN 'html' ELSE 'file' END AS route FROM fetch_log",
)
def _route_content(spark: SparkSession, folder: str) -> DataFrame:
    return fetch_log(spark, folder).select("url", fetches.route_content(F.col("content_type")).alias("route"))


# --- HTML and text ---------------------------------------------------------------------------


@query(
    "needs_render",
    r"""SELECT page_id, (length(html) < 1000
        OR NOT regexp_matches(html, '(?i)<title\b')
        OR coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script\b.*?</script\s*>'),
             lambda s: length(s))), 0) > length(html) * 0.5) AS needs_render
    FROM pages""",
)
def _needs_render(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "pages").select(
        "page_id", html.needs_render(F.col("html")).alias("needs_render")
    )


SQL_TEXTS = I.SQL_LINKS + r""",
page_runs AS (
  SELECT page_id, list_filter(list_transform(regexp_split_to_array(h, '<[^>]*>'), lambda r:
    regexp_replace(regexp_replace(replace(replace(replace(r, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
      '&amp;?', '&', 'g'), '^[\s\x{a0}]+|[\s\x{a0}]+\z', '', 'g')),
    lambda r: regexp_matches(r, '[\p{L}\p{N}_]')) AS runs
  FROM visible),
page_texts AS (
  SELECT page_id, array_to_string(list_transform(runs, lambda r: r || chr(10)), '') AS text FROM page_runs)
"""


@query("extract_text", f"WITH {SQL_TEXTS} SELECT page_id, text FROM page_texts")
def _extract_text(spark: SparkSession, folder: str) -> DataFrame:
    return I.pages(spark, folder).select("page_id", html.extract_text(F.col("html")).alias("text"))


@query("extract_links", f"WITH {I.SQL_LINKS} SELECT src_url, pos, dst_url FROM links")
def _extract_links(spark: SparkSession, folder: str) -> DataFrame:
    return extract_links(I.pages(spark, folder))


@query("strip_digits", "SELECT doc_id, regexp_replace(text, '[0-9]', '', 'g') AS bare FROM documents")
def _strip_digits(spark: SparkSession, folder: str) -> DataFrame:
    return I.documents(spark, folder).select("doc_id", text.strip_digits(F.col("text")).alias("bare"))


@query("doc_title", f"WITH {I.SQL_DOCS} SELECT doc_id, title FROM docs")
def _doc_title(spark: SparkSession, folder: str) -> DataFrame:
    return (
        I.documents(spark, folder)
        .filter(text.has_title(F.col("text")))
        .select("doc_id", text.doc_title(F.col("text")).alias("title"))
    )


@query(
    "flatten_newlines",
    "SELECT doc_id, replace(replace(text, chr(10) || chr(10), chr(13) || chr(10)), chr(13) || chr(10), ' ') AS flat FROM documents",
)
def _flatten_newlines(spark: SparkSession, folder: str) -> DataFrame:
    # Blank lines become the line breaks of a text saved on another system.
    crlf = F.replace(F.col("text"), F.lit("\n\n"), F.lit("\r\n"))
    return I.documents(spark, folder).select("doc_id", text.flatten_newlines(crlf).alias("flat"))


@query(
    "highlight_terms",
    r"""WITH firsts AS (
      SELECT doc_id, text, [l[1], l[(len(l) + 1) // 2], l[len(l)]] AS w FROM (
        SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS l FROM documents)),
    cut AS (
      SELECT doc_id, w, regexp_split_to_array(text, '[\p{L}\p{N}_]+') AS g,
             list_append(regexp_extract_all(text, '[\p{L}\p{N}_]+'), '') AS t FROM firsts),
    piece AS (
      SELECT doc_id, w, unnest(g) AS g, unnest(t) AS t, generate_subscripts(g, 1) AS i FROM cut)
    SELECT doc_id, string_agg(g || CASE WHEN list_contains(w, lower(t)) AND t <> ''
        THEN '<font color=''red''>' || t || '</font>' ELSE t END, '' ORDER BY i) AS marked
    FROM piece GROUP BY doc_id""",
)
def _highlight_terms(spark: SparkSession, folder: str) -> DataFrame:
    # The first, the middle and the last word.
    words = I.documents(spark, folder).withColumn("l", text.tokens(F.col("text")))
    middle = F.floor((F.size("l") + 1) / 2).cast("int")
    docs = words.withColumn(
        "w", F.filter(F.array(*[F.get("l", i - 1) for i in (F.lit(1), middle, F.size("l"))]), lambda x: x.isNotNull())
    )
    return docs.select(
        "doc_id",
        text.highlight_terms(F.col("text"), F.col("w"), "<font color='red'>", "</font>").alias("marked"),
    )
