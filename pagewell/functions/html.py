"""Text, links and render checks from raw HTML, without leaving the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# A script or style element with the text behind it up to the next start tag: the text
# stays hidden until another element opens. An element never closed hides the rest.
_HIDDEN = (
    r"(?is)<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
    r"(?:[^<]++|</[^>]*+>|<!--.*?-->)*+"
)
_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"""<[A-Za-z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>|<[A-Za-z/!?][^>]*+>|<"""
_ANCHOR = r"""(?i)<a(?=[\s/>])(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
_HREF = r"""(?is)^.*[\s"'/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
_SCRIPT = r"(?is)<script\b.*?</script\s*>"
_OUTER_SPACE = r"(?U)^\s+|\s+\z"
_WORD_CHAR = r"[\p{L}\p{N}_]"
_CHARREF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{0,31};?)"

# Most frequent references, tried before the full table of the HTML standard.
_COMMON = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;", "#39;")


def _table(pairs: dict[str, str]) -> Column:
    """Constant lookup table; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def _named_char(name: Column) -> Column:
    """Text of a named reference; a name without ``;`` may match by its longest known prefix."""
    legacy = {n: c for n, c in html5.items() if not n.endswith(";")}
    longest = max(map(len, legacy))
    prefixes = _table(legacy)
    by_prefix = [
        F.concat(prefixes[F.substring(name, 1, n)], F.substring(name, n + 1, 64))
        for n in range(longest, 1, -1)
    ]
    return F.coalesce(_table(html5)[name], *by_prefix, F.concat(F.lit("&"), name))


def _numbered_char(ref: Column) -> Column:
    """Text of a numeric reference, with the repairs the HTML standard asks for."""
    hexadecimal = ref.rlike("^#[xX]")
    digits = F.regexp_replace(F.regexp_replace(ref, "^#[xX]?", ""), ";", "")
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    too_long = F.length(digits) > 8
    short = F.when(~too_long, digits)
    number = F.when(hexadecimal, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("long")
    windows = {}
    for code in range(0x80, 0xA0):
        windows[str(code)] = bytes([code]).decode("cp1252", "ignore") or chr(code)
    repaired = _table(windows)
    utf32 = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    dropped = (
        number.between(1, 8)
        | number.between(0x0E, 0x1F)
        | (number == 0x0B)
        | (number == 0x7F)
        | number.between(0xFDD0, 0xFDEF)
        | ((number % 0x10000) >= 0xFFFE)
    )
    return (
        F.when(too_long | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "�")
        .when(number.between(0x80, 0x9F), repaired[number.cast("string")])
        .when(dropped, "")
        .otherwise(utf32)
    )


def _char_of(ref: Column) -> Column:
    name = F.substring(ref, 2, 64)
    common = {n: html5.get(n, "'") for n in _COMMON}
    out = F.when(name == _COMMON[0], F.lit(common[_COMMON[0]]))
    for n in _COMMON[1:]:
        out = out.when(name == n, F.lit(common[n]))
    return out.when(name.startswith("#"), _numbered_char(name)).otherwise(_named_char(name))


def unescape(text: Column) -> Column:
    """Replace character references by their characters, each once and left to right."""
    gaps = F.split(text, _CHARREF)
    refs = F.regexp_extract_all(text, F.lit(_CHARREF), F.lit(0))
    pieces = F.zip_with(
        gaps, refs, lambda g, r: F.concat(g, F.when(r.isNull(), F.lit("")).otherwise(_char_of(r)))
    )
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def _visible(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, _HIDDEN, "<x>"), _COMMENT, "<x>")


def extract_text(html: Column) -> Column:
    """Stripped text runs that hold a word character, one per line, each ended by a newline.

    Script and style content is left out, the title is part of the text.
    """
    runs = F.transform(
        F.split(_visible(html), _TAG), lambda r: F.regexp_replace(unescape(r), _OUTER_SPACE, "")
    )
    kept = F.filter(runs, lambda r: r.rlike(_WORD_CHAR))
    return F.array_join(F.transform(kept, lambda r: F.concat(r, F.lit("\n"))), "")


def extract_hrefs(html: Column) -> Column:
    """Every ``<a href>`` value in page order, repeats kept; the last ``href`` of a tag counts.

    Anchors whose ``href`` has no value are dropped.
    """
    tags = F.regexp_extract_all(_visible(html), F.lit(_ANCHOR), F.lit(0))
    tags = F.filter(tags, lambda t: t.rlike(_HREF))
    raw = F.transform(
        tags,
        lambda t: F.concat(*[F.regexp_extract(t, _HREF, g) for g in (1, 2, 3)]),
    )
    return F.transform(raw, lambda h: F.regexp_replace(unescape(h), _OUTER_SPACE, ""))


def needs_render(html: Column) -> Column:
    """True for pages that want a browser: no title, mostly script, or under 1000 characters.

    Script is measured in source characters.
    """
    scripts = F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(0))
    script_chars = F.aggregate(scripts, F.lit(0), lambda acc, s: acc + F.length(s))
    return (
        (F.length(html) < 1000)
        | ~html.rlike(r"(?i)<title\b")
        | (script_chars > F.length(html) * 0.5)
    )
