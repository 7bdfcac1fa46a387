"""Tokens, dictionary segmentation, expansions and index tables over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewell.catalog import inputs as I
from pagewell.catalog.registry import query
from pagewell.functions.text import tokens
from pagewell.operators import analysis, index
from pagewell.session import scratch_path
from pagewell.sources.tables import plan_bytes, read_table

# --- tokens ----------------------------------------------------------------------------


@query(
    "tokenize",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS l FROM documents)
    SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS term FROM t""",
)
def _tokenize(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.tokenize(I.documents(spark, folder), "text", ["doc_id"])


# The given texts hold no Chinese. Latin letters are mapped to Han characters one by one, so
# that every text becomes runs that need a dictionary.
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_HAN = "".join(chr(0x4E00 + 37 * i) for i in range(26))
SQL_HAN_RUN = r"\p{Han}+|[\p{Latin}\p{N}_]+"


def in_han(text: str) -> Column:
    return F.translate(F.lower(text), _LATIN, _HAN)


def han_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = I.documents(spark, folder)
    return docs.select("doc_id", in_han("text").alias("text"))


def han_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """All words of the benchmark texts."""
    han = in_han("text")
    words = read_table(spark, folder, "benchmark").select(
        F.explode(F.regexp_extract_all(han, F.lit(r"\p{IsHan}+"), F.lit(0))).alias("word")
    )
    return words.distinct()


_SQL_HAN = rf"""
located AS (
  SELECT doc_id, unnest(r) AS run, CAST(generate_subscripts(r, 1) - 1 AS INTEGER) AS run_pos FROM (
    SELECT doc_id, regexp_extract_all(translate(lower(text), '{_LATIN}', '{_HAN}'),
      '\p{{Han}}+|[\p{{Latin}}\p{{N}}_]+') AS r FROM documents)),
"""
_SQL_DICTIONARY = rf"""
dictionary AS (
  SELECT DISTINCT word FROM (
    SELECT unnest(regexp_extract_all(translate(lower(text), '{_LATIN}', '{_HAN}'), '\p{{Han}}+')) AS word
    FROM benchmark)),
lens AS (SELECT DISTINCT length(word) AS l FROM dictionary)
"""
_SQL_CUT = r"""
    runs AS (SELECT DISTINCT run FROM located WHERE regexp_matches(run, '^\p{Han}+$')),
    starts AS (SELECT run, unnest(range(1, length(run) + 1)) AS p FROM runs),
    longest AS (
      SELECT s.run, s.p, max(length(d.word)) AS n FROM starts s CROSS JOIN lens k
      JOIN dictionary d ON d.word = substr(s.run, s.p, k.l)
      WHERE s.p + k.l - 1 <= length(s.run) GROUP BY s.run, s.p),
    cut(run, i, p, n) AS (
      SELECT r.run, 0, CAST(1 AS BIGINT), coalesce(l.n, 1) FROM runs r
      LEFT JOIN longest l ON l.run = r.run AND l.p = 1
      UNION ALL
      SELECT c.run, c.i + 1, c.p + c.n, coalesce(l.n, 1) FROM cut c
      LEFT JOIN longest l ON l.run = c.run AND l.p = c.p + c.n WHERE c.p + c.n <= length(c.run))
"""


@query(
    "segment_dict",
    rf"""WITH RECURSIVE {_SQL_HAN} {_SQL_DICTIONARY}, {_SQL_CUT}
    SELECT o.doc_id, o.run_pos, CAST(coalesce(c.i, 0) AS INTEGER) AS i,
           coalesce(substr(c.run, c.p, c.n), o.run) AS term
    FROM located o LEFT JOIN cut c ON c.run = o.run""",
)
def _segment_dict(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.segment_dict(
        han_documents(spark, folder), "text", ["doc_id"], han_dictionary(spark, folder)
    )


def synonyms(spark: SparkSession, folder: str) -> DataFrame:
    """Each word of a benchmark text has the next one as a synonym."""
    words = read_table(spark, folder, "benchmark").select(tokens(F.col("text")).alias("w"))
    after = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pair = F.explode(F.filter(F.arrays_zip(F.col("w").alias("term"), after.alias("syn")), lambda p: p["syn"].isNotNull()))
    return words.select(pair.alias("p")).select("p.term", "p.syn").distinct()


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Words with accents read as their plain letters."""
    words = read_table(spark, folder, "benchmark").select(F.explode(tokens(F.col("text"))).alias("term"))
    plain = F.translate("term", "áéíóúñäöüßèêç", "aeiounaouseec")
    return words.select("term", plain.alias("reading")).filter("term <> reading").distinct()


_SQL_TABLES = r"""
words AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
synonyms AS (
  SELECT DISTINCT w[i] AS term, w[i + 1] AS syn FROM (SELECT w, unnest(range(1, CAST(len(w) AS BIGINT))) AS i FROM words)),
readings AS (
  SELECT DISTINCT term, translate(term, 'áéíóúñäöüßèêç', 'aeiounaouseec') AS reading
  FROM (SELECT unnest(w) AS term FROM words) WHERE term <> translate(term, 'áéíóúñäöüßèêç', 'aeiounaouseec')),
content_tokens AS (SELECT doc_id, pos, term FROM tokens WHERE field = 'content')
"""


@query(
    "expand_synonyms",
    f"""WITH {I.SQL_DOCS}, {_SQL_TABLES}
    SELECT doc_id, pos, term, false AS is_overlap FROM content_tokens
    UNION ALL SELECT t.doc_id, t.pos, s.syn, true FROM content_tokens t JOIN synonyms s ON s.term = t.term""",
)
def _expand_synonyms(spark: SparkSession, folder: str) -> DataFrame:
    table = analysis.tokenize(I.documents(spark, folder), "text", ["doc_id"])
    return analysis.expand_synonyms(table, synonyms(spark, folder), ["doc_id"])


@query(
    "expand_readings",
    f"""WITH {I.SQL_DOCS}, {_SQL_TABLES}
    SELECT doc_id, pos, term, false AS is_overlap FROM content_tokens
    UNION ALL SELECT t.doc_id, t.pos, r.reading, true FROM content_tokens t JOIN readings r ON r.term = t.term""",
)
def _expand_readings(spark: SparkSession, folder: str) -> DataFrame:
    table = analysis.tokenize(I.documents(spark, folder), "text", ["doc_id"])
    return analysis.expand_readings(table, readings(spark, folder), ["doc_id"])


# --- documents to index ----------------------------------------------------------------


@query(
    "need_index_take",
    f"WITH {I.SQL_DOCUMENTS} SELECT doc_id, md5(url) AS url_md5, text FROM documents_in WHERE lang = 'en'",
)
def _need_index_take(spark: SparkSession, folder: str) -> DataFrame:
    docs = I.documents(spark, folder)
    flags = docs.filter("lang = 'en'").select("url_md5")
    return index.need_index_take(docs, flags).select("doc_id", "url_md5", "text")


@query(
    "doc_url_lookup",
    f"WITH {I.SQL_DOCUMENTS} SELECT doc_id, md5(url) AS url_md5, url FROM documents_in WHERE n_chars > 500",
)
def _doc_url_lookup(spark: SparkSession, folder: str) -> DataFrame:
    docs = I.documents(spark, folder)
    known = docs.filter("n_chars > 500").select("url_md5", "url")
    return index.doc_url_lookup(docs.select("doc_id", "url_md5"), known).select("doc_id", "url_md5", "url")


@query(
    "build_docs",
    f"WITH {I.SQL_DOCS} SELECT doc_id, url, title, content, CAST(0 AS BIGINT) AS batch_id FROM docs",
)
def _build_docs(spark: SparkSession, folder: str) -> DataFrame:
    return index.build_docs(I.documents(spark, folder))


@query(
    "build_postings",
    f"""WITH {I.SQL_DOCS}
    SELECT field, term, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
    FROM tokens GROUP BY field, term, doc_id""",
)
def _build_postings(spark: SparkSession, folder: str) -> DataFrame:
    postings = index.build_postings(index.build_docs(I.documents(spark, folder)))
    listed = F.array_join(F.col("positions").cast("array<string>"), ",")
    return postings.select("field", "term", "doc_id", "tf", listed.alias("positions"))


# Bytes of stored documents whose tokens, with their synonyms, a task counts.
EXPANDED_TASK_BYTES = 1 << 20


@query(
    "build_postings_expanded",
    f"""WITH {I.SQL_DOCS}, {_SQL_TABLES},
    expanded AS (
      SELECT doc_id, field, pos, term FROM tokens UNION ALL
      SELECT t.doc_id, t.field, t.pos, s.syn FROM tokens t JOIN synonyms s ON s.term = t.term),
    own AS (SELECT doc_id, field, count(*) AS dl FROM tokens GROUP BY doc_id, field)
    SELECT e.field, e.term, e.doc_id, count(*) AS tf, any_value(o.dl) AS dl
    FROM expanded e JOIN own o ON o.doc_id = e.doc_id AND o.field = e.field GROUP BY e.field, e.term, e.doc_id""",
)
def _build_postings_expanded(spark: SparkSession, folder: str) -> DataFrame:
    # Documents are dealt out before their tokens multiply, a few to a task, so that a task's postings fit its memory.
    docs = index.build_docs(I.documents(spark, folder))
    tasks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (plan_bytes(docs) or 0) // EXPANDED_TASK_BYTES)
    docs = docs.repartition(tasks, "doc_id")
    keys = [*index.DOC, "field"]
    table = analysis.tokenize(index.field_texts(docs), "text", keys)
    expanded = analysis.expand_synonyms(table, synonyms(spark, folder), keys)
    return index.postings_of_tokens(expanded).select("field", "term", "doc_id", "tf", "dl")


# Documents, fields and queries in Han letters, cut into the words of the dictionary.
SQL_SEGMENTED = rf"""{I.SQL_DOCUMENTS},
    docs AS (
      SELECT doc_id, url, t AS content, regexp_replace(split_part(t, chr(10), 1), '\r\z', '') AS title FROM (
        SELECT doc_id, url, translate(lower(text), '{_LATIN}', '{_HAN}') AS t FROM documents_in)
      WHERE t = '' OR regexp_matches(t, '[^\r\n]|\r([^\n]|\z)')),
    user_queries AS (
      SELECT CAST(item_id AS INTEGER) AS query_id, translate(lower(text), '{_LATIN}', '{_HAN}') AS text FROM benchmark),
    fields AS (
      SELECT doc_id, 'content' AS field, content AS t FROM docs
      UNION ALL SELECT doc_id, 'title', title FROM docs
      UNION ALL SELECT query_id, 'query', text FROM user_queries),
    located AS (
      SELECT doc_id, field, unnest(regexp_extract_all(t, '{SQL_HAN_RUN}')) AS run FROM fields),
    {_SQL_DICTIONARY},
    {_SQL_CUT},
    terms AS (
      SELECT o.doc_id, o.field, coalesce(substr(c.run, c.p, c.n), o.run) AS term
      FROM located o LEFT JOIN cut c ON c.run = o.run),
    sizes AS (SELECT doc_id, field, count(*) AS dl FROM terms WHERE field <> 'query' GROUP BY doc_id, field),
    postings AS (
      SELECT t.field, t.term, t.doc_id, count(*) AS tf, any_value(s.dl) AS dl
      FROM terms t JOIN sizes s ON s.doc_id = t.doc_id AND s.field = t.field GROUP BY t.field, t.term, t.doc_id)
"""


def han_analyser(spark: SparkSession, folder: str) -> analysis.Analyser:
    return analysis.Analyser(dictionary=han_dictionary(spark, folder))


def segmented_index(spark: SparkSession, folder: str) -> index.Index:
    """Index of all documents in Han letters, analysed with the dictionary."""
    path = scratch_path(spark, "segmented")
    han = I.documents(spark, folder).withColumn("text", in_han("text"))
    index.index_increment(han, None, None, path, 0, han_analyser(spark, folder))
    return index.read_index(spark, path)


@query("index_segmented", f"WITH RECURSIVE {SQL_SEGMENTED} SELECT field, term, doc_id, tf, dl FROM postings")
def _index_segmented(spark: SparkSession, folder: str) -> DataFrame:
    """Index of documents that are analysed with a dictionary."""
    return segmented_index(spark, folder).postings.select("field", "term", "doc_id", "tf", "dl")


@query("doc_lengths", f"WITH {I.SQL_INDEX} SELECT field, doc_id, dl FROM lengths")
def _doc_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return index.doc_lengths(index.build_docs(I.documents(spark, folder))).select("field", "doc_id", "dl")


@query("term_stats", f"WITH {I.SQL_INDEX} SELECT field, term, df, ttf FROM term_stats")
def _term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_stats(I.documents_index(spark, folder).postings)


@query("corpus_stats", f"WITH {I.SQL_INDEX} SELECT field, n_docs, total_len FROM field_stats")
def _corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return index.corpus_stats(I.documents_index(spark, folder).postings)


@query("index_count", f"WITH {I.SQL_DOCS} SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS n_docs FROM docs")
def _index_count(spark: SparkSession, folder: str) -> DataFrame:
    return index.index_count(index.build_docs(I.documents(spark, folder)))


# --- batches ---------------------------------------------------------------------------


def two_batches(spark: SparkSession, folder: str) -> str:
    """Index of all flagged documents, then of the English ones again, with their text doubled."""
    path = scratch_path(spark, "batches")
    docs = I.documents(spark, folder)
    known = docs.select("url_md5", "url")
    flags = docs.filter("n_chars > 500").select("url_md5")
    index.index_increment(docs.drop("url"), known, flags, path, 0)
    again = docs.filter("lang = 'en'").drop("url").withColumn("text", F.concat("text", F.lit("\n"), "text"))
    index.index_increment(again, known, None, path, 1)
    return path


SQL_BATCHES = I.SQL_DOCUMENTS + r""",
batched AS (
  SELECT doc_id, url, text AS content, CAST(0 AS BIGINT) AS batch_id FROM documents_in WHERE n_chars > 500
  UNION ALL
  SELECT doc_id, url, text || chr(10) || text, CAST(1 AS BIGINT) FROM documents_in WHERE lang = 'en'),
batch_docs AS (
  SELECT *, regexp_replace(split_part(content, chr(10), 1), '\r\z', '') AS title FROM batched
  WHERE content = '' OR regexp_matches(content, '[^\r\n]|\r([^\n]|\z)'))
"""


@query("index_increment", f"WITH {SQL_BATCHES} SELECT batch_id, doc_id, url, title, content FROM batch_docs")
def _index_increment(spark: SparkSession, folder: str) -> DataFrame:
    docs = index.read_index(spark, two_batches(spark, folder)).docs
    return docs.select("batch_id", "doc_id", "url", "title", "content")


@query(
    "sink_index_append",
    rf"""WITH {SQL_BATCHES},
    t AS (
      SELECT batch_id, doc_id, 'content' AS field, regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_]+') AS l FROM batch_docs
      UNION ALL
      SELECT batch_id, doc_id, 'title', regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+') FROM batch_docs),
    x AS (SELECT batch_id, doc_id, field, CAST(len(l) AS BIGINT) AS dl, unnest(l) AS term FROM t)
    SELECT batch_id, field, term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM x
    GROUP BY batch_id, field, term, doc_id""",
)
def _sink_index_append(spark: SparkSession, folder: str) -> DataFrame:
    postings = index.read_index(spark, two_batches(spark, folder)).postings
    return postings.select("batch_id", "field", "term", "doc_id", "tf", "dl")


@query(
    "index_latest",
    f"""WITH {SQL_BATCHES} SELECT batch_id, doc_id, url, title FROM (
      SELECT *, row_number() OVER (PARTITION BY url ORDER BY batch_id DESC) AS rn FROM batch_docs) WHERE rn = 1""",
)
def _index_latest(spark: SparkSession, folder: str) -> DataFrame:
    docs = index.read_index(spark, two_batches(spark, folder)).docs
    return index.index_latest(docs).select("batch_id", "doc_id", "url", "title")
