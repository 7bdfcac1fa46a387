"""Run queries next to their SQL and compare the results."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=repr)


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


TIMES: dict[str, float] = {}


def compare(spark, con, name, entry, folder):
    """None when both results agree, else a description of the difference."""
    df = entry.run(spark, folder)
    got_names, got = normalise(df.columns, [tuple(r) for r in df.collect()])
    if entry.sql is None:
        return None if got else "no rows"
    TIMES[name] = time.time()
    result = con.execute(entry.sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want_names, want = normalise(columns, result.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    for column, kind in df.dtypes:
        if _TYPES.get(kind, types[column]) != types[column]:
            return f"type of {column}: {kind} != {types[column]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if got != want:
        at = next(i for i, (a, b) in enumerate(zip(got, want)) if a != b)
        return f"row {at}: {str(got[at])[:400]} != {str(want[at])[:400]}"
    if not got:
        return "both are empty"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pagewell import build_session
    from pagewell.catalog import ENTRIES

    folder = sys.argv[1]
    wanted = sys.argv[2:] or list(ENTRIES)
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in wanted:
        begin = time.time()
        try:
            problem = compare(spark, con, name, ENTRIES[name], folder)
        except Exception as e:  # noqa: BLE001 - the report names the failing query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        took = TIMES.get(name, time.time()) - begin
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {took:6.2f}s {name} {problem or ''}", flush=True)
    print("failures:", bad)
