"""Inverted index tables.

An index is a folder of four tables, written batch by batch:

* ``docs(doc_id, url, title, content)``
* ``postings(field, term, doc_id, tf, dl, positions)``, partitioned by ``bucket``, a hash of the
  term, and sorted by term: a query opens only the folders of its terms and reads only their row
  groups; ``dl`` is the length of the field
* ``terms(field, term, df, ttf)``, laid out as the postings, and ``fields(field, n_docs,
  total_len)``: counts per batch, summed over batches when read

Every attempt at a batch writes to folders of its own, ``<table>/attempt=<name>``. It is published by one
row of the ``manifest``, in one file; readers open the last published attempt of each batch and nothing
else, so a batch that is repeated, cut short or empty leaves no trace of the attempt before. A merge
writes many batches as one attempt and publishes it for all of them at once.

Indexing only appends: a document indexed again gets a new version and the old one stays
searchable; ``index_latest`` leaves only the newest version of each URL.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewell.functions.text import doc_title, has_title, tokens
from pagewell.operators.analysis import Analyser, term_counts

FIELDS = ("content", "title")
DOC = ["batch_id", "doc_id"]
BUCKETS = 16
# Tokens that are sorted at once.
_TOKENS_AT_ONCE = 2_000_000


def _flag_key(left: DataFrame, right: DataFrame) -> list[str]:
    """Flags and URLs belong to a job where both sides name one."""
    return ["job_id", "url_md5"] if {"job_id"} <= {*left.columns} & {*right.columns} else ["url_md5"]


def need_index_take(documents: DataFrame, flags: DataFrame | None) -> DataFrame:
    """Documents whose key is flagged, by the flag's job; without flags every document is taken."""
    if flags is None:
        return documents
    key = _flag_key(documents, flags)
    return documents.join(flags.select(*key).distinct(), key, "left_semi")


def need_index_rest(flags: DataFrame, taken: DataFrame) -> DataFrame:
    """Flags left after the taken documents were indexed."""
    key = _flag_key(flags, taken)
    return flags.join(taken.select(*key), key, "left_anti")


def doc_url_lookup(documents: DataFrame, urls: DataFrame) -> DataFrame:
    """Documents with their URL; a document whose URL is unknown is skipped.

    A key has one URL, however many jobs know it: where the jobs are not named on both sides, the
    first URL by text stands for all, and no document comes twice.
    """
    key = _flag_key(documents, urls)
    one = urls.groupBy(*key).agg(F.min("url").alias("url"))
    return documents.join(one, key)


def with_doc_ids(documents: DataFrame) -> DataFrame:
    """Documents with a ``doc_id`` made from their key, the same in every round.

    It is a 64-bit hash of job and key. Two documents of one batch with the same number are
    an error that :func:`index_append` raises.
    """
    job = ["job_id"] if "job_id" in documents.columns else []
    return documents.withColumn("doc_id", F.xxhash64(*job, "url_md5"))


def build_docs(documents: DataFrame, batch_id: int = 0) -> DataFrame:
    """Stored fields ``doc_id, url, title, content, batch_id``; texts of only line breaks are skipped.

    Documents without a ``doc_id`` get the one of their key.
    """
    if "doc_id" not in documents.columns:
        documents = with_doc_ids(documents)
    return documents.filter(F.col("url").isNotNull() & has_title(F.col("text"))).select(
        "doc_id",
        "url",
        doc_title(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        F.lit(batch_id).cast("long").alias("batch_id"),
    )


def field_texts(docs: DataFrame) -> DataFrame:
    """``batch_id, doc_id, field, text``: a row per tokenised field."""
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    return docs.select(*DOC, F.explode(both).alias("f")).select(*DOC, "f.field", "f.text")


def _field_tokens(docs: DataFrame) -> DataFrame:
    return field_texts(docs).select(*DOC, "field", tokens(F.col("text")).alias("terms"))


def build_postings(docs: DataFrame, analyser: Analyser | None = None) -> DataFrame:
    """``field, term, doc_id, tf, dl, positions, batch_id``.

    All tokens of a document lie in its own row: a batch of rows is sorted by row and term and cut into
    postings, so nothing is shuffled, and a dictionary only cuts those rows otherwise. An ``analyser`` that adds
    tokens does so by joins, and its postings are grouped by document and term.
    """
    key = [*DOC, "field"]
    if analyser is None or analyser.is_plain:
        listed = _field_tokens(docs)
    else:
        listed = analyser.arrays(field_texts(docs), "text", key)
        if listed is None:
            return postings_of_tokens(analyser.tokens(field_texts(docs), "text", key))
        # As where postings are grouped, a document without a number has none.
        listed = listed.dropna(subset=key)
    number = docs.schema["doc_id"].dataType.simpleString()
    schema = f"field string, term string, doc_id {number}, tf bigint, dl bigint, positions array<int>, batch_id bigint"
    return listed.mapInArrow(_cut_postings, schema)


def _cut_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows ``batch_id, doc_id, field, terms``, at most ``_TOKENS_AT_ONCE`` or one row at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy()
        upto = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + _TOKENS_AT_ONCE, side="right")))
            if upto[end - 1] > before:
                yield _postings_of(batch.slice(start, end - start), sizes[start:end])
            start = end


def _postings_of(rows: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
    coded = pc.list_flatten(rows.column("terms")).dictionary_encode()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = owner * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(first, len(key))
    row = owner[order[first]]
    columns = {
        "field": rows.column("field").take(pa.array(row)),
        "term": coded.dictionary.take(coded.indices.take(pa.array(order[first]))),
        "doc_id": rows.column("doc_id").take(pa.array(row)),
        "tf": pa.array(np.diff(ends).astype(np.int64)),
        "dl": pa.array(sizes[row].astype(np.int64)),
        "positions": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[order].astype(np.int32))),
        "batch_id": rows.column("batch_id").take(pa.array(row)),
    }
    return pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])


def postings_of_tokens(token_table: DataFrame) -> DataFrame:
    """Postings of an exploded token table ``batch_id, doc_id, field, pos, term, is_overlap``.

    Needed where tokens were added by a join; added tokens do not count for the length. The tokens are read
    once, and nothing is shuffled where the documents were dealt out by ``doc_id`` before they were cut. Tokens of a document are
    counted before others are added to them.
    """
    return term_counts(token_table, [*DOC, "field"]).select("field", "term", "doc_id", "tf", "dl", "positions", "batch_id")


def doc_lengths(docs: DataFrame) -> DataFrame:
    """``field, doc_id, dl, batch_id``; a field without tokens has length 0."""
    return _field_tokens(docs).select(
        "field", "doc_id", F.size("terms").cast("long").alias("dl"), "batch_id"
    )


def term_stats(postings: DataFrame, *extra: str) -> DataFrame:
    """``field, term, df, ttf``: documents with the term and its number of occurrences."""
    return postings.groupBy(*extra, "field", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("ttf")
    )


def corpus_stats(postings: DataFrame, *extra: str) -> DataFrame:
    """``field, n_docs, total_len``: documents that have a token in the field, and all tokens.

    The posting at the first position of a field stands for its document, so only one row
    per document goes through the distinct step.
    """
    opening = postings.filter(F.get("positions", F.lit(0)) == 0)
    docs = (
        opening.select(*extra, "field", *[c for c in DOC if c not in extra])
        .distinct()
        .groupBy(*extra, "field")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    sizes = postings.groupBy(*extra, "field").agg(F.sum("tf").alias("total_len"))
    return docs.join(sizes, [*extra, "field"])


def index_count(docs: DataFrame) -> DataFrame:
    """``n_docs`` per batch."""
    return docs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_docs"))


def index_latest(docs: DataFrame) -> DataFrame:
    """Newest version of each URL; older versions are cut off in each task before the shuffle."""
    newest = Window.partitionBy("url").orderBy(F.desc("batch_id"), F.desc("doc_id"))
    return docs.withColumn("_v", F.row_number().over(newest)).filter("_v = 1").drop("_v")


@dataclass
class Index:
    """The tables of an index as DataFrames.

    ``terms`` has a row per batch and term; readers filter it first and then add up.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame
    buckets: int = BUCKETS


def term_bucket(term: Column, buckets: int = BUCKETS) -> Column:
    """Folder of a term: its MD5 by the number of folders."""
    return F.pmod(F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def term_buckets_of(terms: list[str], buckets: int = BUCKETS) -> list[int]:
    """Folders that hold the given terms."""
    return sorted({int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % buckets for t in terms})


_LAID_OUT = {"postings": ["field", "term", "doc_id"], "terms": ["field", "term"]}
_MANIFEST = "batch_id bigint, seq bigint, attempt string, buckets int, merged boolean"
_TABLES = {
    "docs": "doc_id bigint, url string, title string, content string, batch_id bigint",
    "postings": "field string, term string, doc_id bigint, tf bigint, dl bigint, positions array<int>, "
    "batch_id bigint, bucket int",
    "terms": "field string, term string, df bigint, ttf bigint, batch_id bigint, bucket int",
    "fields": "field string, n_docs bigint, total_len bigint, batch_id bigint",
}


def _published(spark: SparkSession, path: str) -> list:
    """Last published attempt of each batch."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException:
        return []
    newest = {r["batch_id"]: r for r in sorted(rows, key=lambda r: r["seq"])}
    return sorted(newest.values(), key=lambda r: r["batch_id"])


def _by_bucket(rows: DataFrame, buckets: int, order: list[str], *spread: str) -> DataFrame:
    """Rows dealt out by bucket and a salt of ``spread``, sorted for the scan."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = rows.withColumn("bucket", term_bucket(F.col("term"), buckets))
    salts = max(1, 4 * math.ceil(tasks / buckets))
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts))
    return bucketed.repartition(tasks, "bucket", salt).sortWithinPartitions("bucket", *order)


class _Attempt:
    """Folders that one attempt writes its tables to."""

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets, self.name = spark, path, buckets, f"a{uuid.uuid4().hex}"

    def write(self, table: str, rows: DataFrame, *spread: str) -> DataFrame:
        """Write a table and return it read back; tables by term are dealt out by bucket and ``spread``."""
        if table in _LAID_OUT:
            writer = _by_bucket(rows, self.buckets, _LAID_OUT[table], *spread).write.partitionBy("bucket")
        else:
            writer = rows.write
        folder = f"{self.path}/{table}/attempt={self.name}"
        writer.parquet(folder)
        return self.spark.read.schema(_TABLES[table]).parquet(folder)

    def publish(self, batches: list[int], before: list) -> None:
        """Make this the attempt that readers open for ``batches``: one file, so for all of them or none."""
        seq = max((r["seq"] for r in before), default=-1) + 1
        rows = [(b, seq, self.name, self.buckets, len(batches) > 1) for b in batches]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("append").parquet(f"{self.path}/manifest")


def index_append(
    docs: DataFrame,
    path: str,
    batch_id: int,
    postings: DataFrame | None = None,
    buckets: int = BUCKETS,
    analyser: Analyser | None = None,
) -> None:
    """Write the documents of one batch to the index at ``path`` and publish it.

    A repeated batch replaces its earlier attempt wholly; a batch may be empty. The documents are
    computed once: postings start from those written, by ``analyser`` where one is given. The postings are dealt out by bucket and
    a salt of the document, so a term that every document holds is spread over as many tasks as
    its bucket has salts. ``buckets`` is fixed by the first batch of an index.
    """
    spark = docs.sparkSession
    before = _published(spark, path)
    attempt = _Attempt(spark, path, before[0]["buckets"] if before else buckets)
    stored = attempt.write("docs", docs)
    twice = stored.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    if not twice.isEmpty():
        raise ValueError(f"batch {batch_id} holds two documents with one doc_id")
    rows = build_postings(stored, analyser) if postings is None else postings
    kept = attempt.write("postings", rows, "doc_id")
    attempt.write("terms", term_stats(kept, "batch_id"), "term")
    attempt.write("fields", corpus_stats(kept, "batch_id"))
    attempt.publish([batch_id], before)


def index_increment(
    documents: DataFrame,
    urls: DataFrame | None,
    flags: DataFrame | None,
    path: str,
    batch_id: int,
    analyser: Analyser | None = None,
) -> DataFrame | None:
    """Index the flagged documents as one batch and return the flags that are left.

    A flag is only given up once its document is part of the published batch.
    """
    taken = need_index_take(documents, flags)
    located = taken if urls is None else doc_url_lookup(taken, urls)
    index_append(build_docs(located, batch_id), path, batch_id, analyser=analyser)
    return None if flags is None else need_index_rest(flags, located)


def _published_table(spark: SparkSession, path: str, name: str, published: list) -> DataFrame:
    """One scan over a table's folders of the published attempts, without the batches that moved on."""
    if not published:
        return spark.createDataFrame([], _TABLES[name])
    own: dict[str, list[int]] = {}
    for r in published:
        own.setdefault(r["attempt"], []).append(r["batch_id"])
    rows = (
        spark.read.schema(f"{_TABLES[name]}, attempt string")
        .option("basePath", f"{path}/{name}")
        .parquet(*[f"{path}/{name}/attempt={a}" for a in own])
    )
    # Only a merged attempt can hold batches that were written again since, or that the caller does not want.
    merged = {r["attempt"] for r in published if r["merged"]}
    if merged:
        keep = ~F.col("attempt").isin(sorted(merged))
        for a in sorted(merged):
            keep = keep | ((F.col("attempt") == a) & F.col("batch_id").isin(own[a]))
        rows = rows.filter(keep)
    return rows.drop("attempt")


def index_merge(spark: SparkSession, path: str, batches: list[int] | None = None) -> None:
    """Write the published batches, or those named, as one attempt, so that readers open fewer and larger files.

    Every row keeps its batch, so results stay the same and a merged batch may still be written again. Readers that
    opened the index before keep the old folders, which are not deleted. Fewer than two attempts need no merge.
    """
    published = _published(spark, path)
    chosen = [r for r in published if batches is None or r["batch_id"] in batches]
    if len({r["attempt"] for r in chosen}) < 2:
        return
    attempt = _Attempt(spark, path, chosen[0]["buckets"])
    attempt.write("docs", _published_table(spark, path, "docs", chosen).hint("rebalance"))
    attempt.write("postings", _published_table(spark, path, "postings", chosen).drop("bucket"), "doc_id")
    attempt.write("terms", _published_table(spark, path, "terms", chosen).drop("bucket"), "term")
    attempt.write("fields", _published_table(spark, path, "fields", chosen).coalesce(1))
    attempt.publish([r["batch_id"] for r in chosen], published)


def read_index(spark: SparkSession, path: str) -> Index:
    """Open the published batches of the index at ``path``."""
    published = _published(spark, path)
    tables = {name: _published_table(spark, path, name, published) for name in _TABLES}
    fields = tables["fields"].groupBy("field")
    return Index(
        docs=tables["docs"],
        postings=tables["postings"],
        terms=tables["terms"],
        fields=fields.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len")),
        buckets=published[0]["buckets"] if published else BUCKETS,
    )


def index_of_docs(docs: DataFrame, postings: DataFrame | None = None) -> Index:
    """Index that is computed on the fly, for small corpora and tests."""
    rows = build_postings(docs) if postings is None else postings
    rows = rows.withColumn("bucket", term_bucket(F.col("term")))
    return Index(docs, rows, term_stats(rows, "batch_id"), corpus_stats(rows))
