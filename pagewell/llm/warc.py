"""WARC archives: written from columns, read by a Python data source that skips what is not asked for."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.datasource import IsNotNull, StringStartsWith
from pyspark.sql.types import StructType

from pagewell.llm.located import place, stored
from pagewell.operators.joins import fits_broadcast
from pagewell.session import stage

_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed value: the alphabet of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# Repeated payloads that are sent to every task, a few dozen bytes each; more are joined by shuffle.
SENT_REPEATS = 100_000
_BATCH_BYTES = 8 << 20

_SCHEMA = (
    "file string, offset long, record_type string, record_id string, target_uri string, payload_digest string, "
    "refers_to string, content_length long, headers map<string, string>, payload binary"
)
# Columns that are headers, by which records can be chosen before their payload is looked at.
_HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column."""
    digest = F.sha1(payload)
    fifths = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fifths), _CONV_DIGITS, _BASE32)


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``(at, refers_to)`` for rows of a plain scan whose payload an earlier id has already.

    Of equal payloads of at least ``min_bytes`` the row with the smallest id (null last, of equal ids the
    first in place) is no revisit. The payload itself is not moved, only its SHA-256.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    marked = pages.select(
        place().alias("at"), F.col(id_col).alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")
    ).where(F.col("n") >= min_bytes).drop("n")
    marked = stage(marked, "payload_digests")
    first = (
        marked.groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", F.col("first.id").alias("refers_to"), F.col("first.at").alias("first_at"))
    )
    first = stage(first, "repeated_payloads")
    return marked.join(first, "digest").where(F.col("at") != F.col("first_at")).select("at", F.col("refers_to"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    records_per_file: int = 50_000,
) -> None:
    """Write one record per row below ``path``: a response, or a revisit of an equal payload.

    Payloads are the column's UTF-8 bytes, a null one is empty; they are dealt with whole. Null URLs give no
    target header, and control characters in a URL are percent-encoded. A revisit keeps digest and length of the
    payload in its header and refers to the response. Files are plain WARC/1.1 of at most
    ``records_per_file`` records, written by Spark, so any file system it knows will do. Rows of an
    empty table give files without records.
    """
    pages, _ = stored(pages)
    again = stage(revisits(pages, id_col, payload_col, min_bytes), "revisits")
    sent = F.broadcast if fits_broadcast(again, SENT_REPEATS) else (lambda side: side)
    rows = (
        pages.select(
            place().alias("at"),
            F.col(id_col).cast("string").alias("id"),
            F.col(url_col).alias("url"),
            F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        )
        .join(sent(again.select("at", F.lit(True).alias("again"), F.col("refers_to").cast("string").alias("refers"))), "at", "left")
    )
    is_again = F.coalesce("again", F.lit(False))

    def name(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column), F.lit("")), F.lit(">"))

    def header(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value, F.lit(_CRLF))

    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    n = F.octet_length("payload")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"),
        header("Content-Length", n.cast("string")),
        F.lit(_CRLF),
    )
    block = F.when(is_again, http).otherwise(F.concat(http, "payload"))
    record = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        header("WARC-Type", F.when(is_again, "revisit").otherwise("response")),
        header("WARC-Record-ID", name("id")),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(header("WARC-Target-URI", url), F.lit("")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        header("X-Payload-Length", n.cast("string")),
        F.when(is_again, F.concat(header("WARC-Refers-To", name("refers")), header("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_CRLF),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", _CRLF * 2).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


@dataclass
class WarcFiles(InputPartition):
    """Whole archive files read by one task."""

    files: list[str]

    def __init__(self, files: list[str]) -> None:
        self.files = files


def _open(uri: str) -> io.BufferedIOBase:
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb", buffering=1 << 20)  # noqa: SIM115
    system, path = pa.fs.FileSystem.from_uri(uri)
    return io.BufferedReader(system.open_input_file(path), 1 << 20)


class WarcReader(DataSourceReader):
    """Reads headers first; a record that the filters refuse costs a seek over its block."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self._columns = schema.fieldNames()
        self._files = [tuple(f) for f in json.loads(options.get("files", "[]"))]
        self._task_bytes = int(options.get("taskbytes", 64 << 20))
        self._tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in _HEADERS and isinstance(f, (EqualTo, EqualNullSafe)):
                self._tests.append((_HEADERS[column], "in", (f.value,)))
            elif column in _HEADERS and isinstance(f, In):
                self._tests.append((_HEADERS[column], "in", tuple(f.value)))
            elif column in _HEADERS and isinstance(f, StringStartsWith):
                self._tests.append((_HEADERS[column], "prefix", (f.value,)))
            elif column in _HEADERS and isinstance(f, IsNotNull):
                self._tests.append((_HEADERS[column], "known", ()))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files in groups of about the task's share of bytes, largest first; empty files are left out."""
        groups: list[tuple[list[str], int]] = []
        for uri, size in sorted(self._files, key=lambda f: (-f[1], f[0])):
            if not size:
                continue
            if groups and groups[-1][1] + size <= self._task_bytes:
                groups[-1] = (groups[-1][0] + [uri], groups[-1][1] + size)
            else:
                groups.append(([uri], size))
        return [WarcFiles(files) for files, _ in groups] or [WarcFiles([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, values in self._tests:
            value = headers.get(name)
            if kind == "in" and value not in values:
                return False
            if kind == "known" and value is None:
                return False
            if kind == "prefix" and not (value or "").startswith(values[0]):
                return False
        return True

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, _ARROW[c]) for c in self._columns])
        rows, held = [], 0
        for uri in partition.files:
            with _open(uri) as stream:
                for row in self._records(stream, uri):
                    rows.append(row)
                    held += 512 + len(row.get("payload") or b"")
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, stream: io.BufferedIOBase, uri: str) -> Iterator[dict]:
        while True:
            at = stream.tell()
            line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{uri} has no record at byte {at}")
            headers: dict[str, str] = {}
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            length = int(headers["content-length"])
            wanted = self._wanted(headers)
            payload = None
            if wanted and "payload" in self._columns:
                block = stream.read(length)
                if len(block) < length:
                    raise ValueError(f"{uri} ends within the record at byte {at}")
                payload = block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block
            else:
                stream.seek(length, io.SEEK_CUR)
            stream.seek(4, io.SEEK_CUR)
            if wanted:
                known = {c: headers.get(h) for c, h in _HEADERS.items()}
                yield known | {
                    "file": uri, "offset": at, "content_length": length, "headers": list(headers.items()), "payload": payload,
                }


_ARROW = {
    **{c: pa.string() for c in ("file", *_HEADERS)},
    "offset": pa.int64(),
    "content_length": pa.int64(),
    "headers": pa.map_(pa.string(), pa.string()),
    "payload": pa.binary(),
}


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; option ``files`` is a JSON list of ``[uri, bytes]``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, task_bytes: int = 64 << 20) -> DataFrame:
    """Records of all archives below ``path``, in the columns wanted; without ``payload`` no block is read.

    Conditions on record type and other header columns are tested on the headers, before a
    payload is read. Files are listed by Spark, and a task reads whole files of about ``task_bytes``.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = [[r["path"], r["length"]] for r in listed.collect()]
    schema = StructType([f for f in StructType.fromDDL(_SCHEMA) if columns is None or f.name in columns])
    return (
        spark.read.format("warc").schema(schema).option("files", json.dumps(files)).option("taskBytes", str(task_bytes)).load()
    )
