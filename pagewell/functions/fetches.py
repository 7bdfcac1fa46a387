"""Reading a fetch result: charset, routing and body decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def parse_charset(content_type: Column) -> Column:
    """Text after the last ``charset=``, UTF-8 when there is none."""
    return F.when(
        content_type.contains("charset="), F.substring_index(content_type, "charset=", -1)
    ).otherwise(F.lit("UTF-8"))


def route_content(content_type: Column) -> Column:
    """``html`` or ``file``; a missing content type is an ``error``."""
    return (
        F.when(content_type.isNull(), "error")
        .when(content_type.contains("text/html"), "html")
        .otherwise("file")
    )


@F.pandas_udf(StringType())
def _decode_with_codec(body: pd.Series, charset: pd.Series) -> pd.Series:
    def one(data: bytes | None, name: str | None) -> str | None:
        if data is None:
            return None
        try:
            return bytes(data).decode(name, "ignore")
        except LookupError:
            return None

    return pd.Series([one(d, n) for d, n in zip(body, charset)], dtype=object)


def decode_body(body: Column, charset: Column) -> Column:
    """Text of the body, undecodable bytes left out; null when the charset is unknown.

    Valid UTF-8 is decoded by the JVM; only other rows are handed to Python.
    """
    native = F.upper(charset).isin("UTF-8", "UTF8") & F.is_valid_utf8(body.cast("string"))
    foreign = _decode_with_codec(F.when(~native, body), F.when(~native, charset))
    return F.when(native, body.cast("string")).otherwise(foreign)
