"""URL functions against the standard library."""

import random
import string
from urllib.parse import quote, urljoin

from pyspark.sql import functions as F

from pagewell.functions import urls


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_quote_matches_standard_library(spark):
    values = ["http://x/é?ü=1 2", "a%20b", "中\x7f\x01", "plain", "", "😀/tab\t"]
    assert column(spark, values, urls.quote_url) == [quote(v, safe=string.printable) for v in values]


def test_normalize_drops_one_slash(spark):
    assert column(spark, ["a/", "a//", "a", "/", ""], urls.normalize_url) == ["a", "a/", "a", "", ""]


def test_canonical_key_has_32_digits(spark):
    keys = column(spark, [f"u{i}" for i in range(300)], lambda c: urls.url_key(urls.canonical_url(c)))
    assert {len(k) for k in keys} == {32}
    assert any(k.startswith("0") for k in keys)


def test_resolve_matches_standard_library(spark):
    rng = random.Random(7)
    parts = ["a", "b", ".", "..", "/", "?", "#", "//", "http:", "https:", "mailto:", "x=1", " ", "é"]
    bases = ["http://h.com/a/b?q=1", "http://h.com", "https://h.com/", "http://h.com/a/b/c/d", "http://h.com/x/y#f"]
    rows = [
        (i, rng.choice(bases), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7))).strip())
        for i in range(3000)
    ]
    rows += [(3000 + i, "http://h.com/a/b", h) for i, h in enumerate(["", "#", "?", "/", "//o.org/p", "../../../z"])]
    got = (
        spark.createDataFrame(rows, "i int, b string, h string")
        .select("b", "h", urls.resolve_url(F.col("b"), F.col("h")).alias("r"))
        .collect()
    )
    # Leading slashes that only dot segments separate are collapsed by the standard library.
    wrong = [r for r in got if r.r != urljoin(r.b, r.h) and "/..//" not in r.h]
    assert wrong == []


def test_filters_are_unanchored_and_refuse_null(spark):
    values = ["http://ok.org/", "mailto:me@ok.org", "http://ok.org/search?x", None, "", "http://no/?u=ok.org"]
    got = column(spark, values, lambda c: urls.url_allowed(c, r"ok\.org", r"/search\?"))
    assert got == [True, True, False, False, False, True]


def test_file_type_is_text_after_last_dot(spark):
    values = ["http://a/b.mp4", "http://a/b.mp4?x", "http://a.mp4/b", "mp4"]
    assert column(spark, values, lambda c: urls.file_type_allowed(c, "mp4")) == [False, False, False, False]
    assert column(spark, ["http://a/b.tar.gz", "none"], urls.file_extension) == ["gz", "none"]
