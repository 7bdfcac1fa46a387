"""HTML, fetch and text functions against the standard library and hand-worked rows."""

import html as stdlib_html
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagewell.functions import fetches, html, text


class Parser(HTMLParser):
    """Text runs and link values, the plain way."""

    def __init__(self):
        super().__init__()
        self.text, self.links = "", []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "a" and values.get("href") is not None:
            self.links.append(values["href"].strip())

    def handle_data(self, data):
        if self.lasttag not in ("script", "style") and re.search(r"\w", data.strip()):
            self.text += data.strip() + "\n"


EDGES = [
    "<p>a &amp;lt; b &#65;&#x42; &notit; &copy=1 &euro; &NotEqualTilde; &#150; &#0; &#xD800; x&y &unknown; z</p>",
    '<title>t</title><script>var a="<p>x</p>";</script>hid<b>vis</b>tail<style>p{}</style> hid </b> hid <i>v</i>',
    '<a title="x>y" href=" /q?a=1&amp;b=2 ">k</a><a href=/u/v>m</a><A HREF=\'z\' href="w">o</a><abbr href="no">q</abbr>',
    '<!-- c <a href="/no">x</a> --><p>one<!-- c -->two</p>',
    "<p>a < b and c > d</p>",
    "<p>" + "x " * 5000 + "</p>",
    "<p>  nbsp 　</p><p>***</p><p>_</p>",
    "",
]


def test_pages_match_the_standard_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + EDGES
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    rows = df.select(
        "i", html.extract_text(F.col("html")).alias("t"), html.extract_hrefs(F.col("html")).alias("l")
    ).collect()
    for row in rows:
        parser = Parser()
        parser.feed(pages[row.i])
        assert row.t == parser.text
        assert row.l == parser.links


def test_references_match_the_standard_library(spark):
    values = [f"x&{n}y" for n in ("amp;", "amp", "lt;", "hellip;", "hellip", "#8364;", "#x1F600;", "#128;", "#1;", "#99999999999;", "nosuch;", "copyx", "#", "")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").orderBy("i")
    got = [r[0] for r in df.select(html.unescape(F.col("s"))).collect()]
    assert got == [stdlib_html.unescape(v) for v in values]


def test_link_without_value_is_dropped(spark):
    df = spark.createDataFrame([("<a href>n</a><a href=''>e</a><a>z</a>",)], "h string")
    assert df.select(html.extract_hrefs(F.col("h"))).first()[0] == [""]


def test_needs_render(spark):
    long = "<title>t</title>" + "x" * 1000
    values = [long, long.replace("title", "h1"), "<title></title>", long + "<script>" + "y" * 1100 + "</script>", ""]
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").orderBy("i")
    got = [r[0] for r in df.select(html.needs_render(F.col("s"))).collect()]
    assert got == [False, True, True, True, True]


def test_decode_body(spark):
    rows = [
        ("中文".encode("gbk"), "GBK", "中文"),
        (b"a\xffb", "UTF-8", "ab"),
        ("é".encode(), "utf-8", "é"),
        (b"x", "nope", None),
        (b"\xe9", "ISO-8859-1", "é"),
        (None, "UTF-8", None),
    ]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, c) for i, (b, c, _) in enumerate(rows)], "i int, b binary, c string")
    got = df.orderBy("i").select(fetches.decode_body(F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]


def test_charset_and_route(spark):
    rows = ["text/html; charset=GBK", "text/html", "charset=a; charset=b", None, "application/pdf"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string").orderBy("i")
    got = df.select(fetches.parse_charset(F.col("c")), fetches.route_content(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [
        ("GBK", "html"),
        ("UTF-8", "html"),
        ("b", "file"),
        ("UTF-8", "error"),
        ("UTF-8", "file"),
    ]


@pytest.mark.parametrize(
    "content,title,kept",
    [("a\nb", "a", True), ("a\r\nb", "a", True), ("\nb", "", True), ("\n", "", False), ("", "", True), ("\r\n\n", "", False), ("\r", "", True)],
)
def test_title(spark, content, title, kept):
    df = spark.createDataFrame([(content,)], "s string")
    assert tuple(df.select(text.doc_title(F.col("s")), text.has_title(F.col("s"))).first()) == (title, kept)


def test_tokens_and_highlight(spark):
    df = spark.createDataFrame([("Hello 南开大学x the_9 End Ünï",)], "s string")
    got = df.select(
        text.tokens(F.col("s")),
        text.highlight_terms(F.col("s"), F.array(F.lit("the_9"), F.lit("开大"), F.lit("ünï")), "<", ">"),
    ).first()
    assert got[0] == ["hello", "南开", "开大", "大学", "x", "the_9", "end", "ünï"]
    assert got[1] == "Hello 南<开大>学x <the_9> End <Ünï>"


def test_native_functions_have_no_python_node(spark):
    df = spark.createDataFrame([("u", "<p>x</p>")], "url string, html string")
    plan = df.select(html.extract_text(F.col("html")), html.extract_hrefs(F.col("html")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
