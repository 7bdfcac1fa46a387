"""URL keys, normalisation, quoting, resolution and filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that percent-encoding leaves alone: printable ASCII and its white space.
_QUOTED = r"[^\x20-\x7e\t\n\r\x0b\x0c]"

# Parts of a URI reference, after RFC 3986 appendix B.
_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_key(url: Column) -> Column:
    """32 hex digits of the MD5 of the UTF-8 bytes; leading zeros are kept."""
    return F.md5(url)


def normalize_url(url: Column) -> Column:
    """Drop one trailing slash."""
    return F.regexp_replace(url, r"/\z", "")


def quote_url(url: Column) -> Column:
    """Percent-encode every character outside printable ASCII; ``%`` stays as it is."""
    escaped = F.transform(
        F.split(url, ""), lambda c: F.when(c.rlike(_QUOTED), F.url_encode(c)).otherwise(c)
    )
    return F.when(url.rlike(_QUOTED), F.array_join(escaped, "")).otherwise(url)


def canonical_url(url: Column) -> Column:
    """The one form under which every table keys a URL: normalised, then quoted."""
    return quote_url(normalize_url(url))


def _part(ref: Column, group: int) -> Column:
    return F.regexp_extract(ref, _REFERENCE, group)


def _remove_dot_segments(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` in an array of path segments; excess ``..`` is dropped."""
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        )
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def _rooted_path(base_path: Column, path: Column) -> Column:
    """Merge a reference path with the base path and give it exactly one leading slash."""
    parent = F.regexp_replace(base_path, r"[^/]*\z", "")
    parent = F.when(parent == "", F.lit("/")).otherwise(parent)
    # Merging with the base collapses empty segments in the middle; a rooted path keeps them.
    merged = F.regexp_replace(F.concat(parent, path), r"(?<=.)/(?=/)", "")
    full = F.when(path.startswith("/"), path).otherwise(merged)
    dotted = full.rlike(r"(^|/)\.\.?(/|\z)")
    body = F.substring(full, 2, 2_000_000_000)
    return F.concat(
        F.lit("/"), F.when(dotted, _remove_dot_segments(F.split(body, "/"))).otherwise(body)
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` found on page ``base`` (RFC 3986, web schemes).

    Empty query and fragment delimiters are dropped and references of another
    scheme come back unchanged. ``;`` is an ordinary path character.
    """
    ref = F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    base_scheme = F.lower(_part(base, 1))
    scheme = F.lower(_part(ref, 1))
    host, path, query, fragment = (_part(ref, g) for g in (2, 3, 4, 5))
    same_page = path == ""
    new_path = (
        F.when(host != "", path)
        .when(same_page, _part(base, 3))
        .otherwise(_rooted_path(_part(base, 3), path))
    )
    new_query = F.when((host == "") & same_page & (query == ""), _part(base, 4)).otherwise(query)
    built = F.concat(
        base_scheme,
        F.lit("://"),
        F.when(host != "", host).otherwise(_part(base, 2)),
        new_path,
        F.when(new_query != "", F.concat(F.lit("?"), new_query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )
    # Most links: a rooted path without dot segments, query or fragment, on a plain web page.
    plain = base.rlike(r"^https?://[^/?#]+") & href.rlike(r"^/(?![/.])(?:(?!/\.)[^?#\x00-\x20])*\z")
    return (
        F.when(plain, F.concat(F.regexp_extract(base, r"^https?://[^/?#]+", 0), href))
        .when(ref == "", base)
        .when((scheme != "") & (scheme != base_scheme), href)
        .otherwise(built)
    )


def url_allowed(url: Column, allow: str, deny: str | None) -> Column:
    """True when ``allow`` is found in the URL and ``deny`` is not; null and empty never pass."""
    passed = (url != "") & url.rlike(allow)
    return F.coalesce(passed if deny is None else passed & ~url.rlike(deny), F.lit(False))


def file_extension(url: Column) -> Column:
    """Text after the last dot, or the whole URL when it has none."""
    return F.substring_index(url, ".", -1)


def file_type_allowed(url: Column, deny: str | None) -> Column:
    """True when ``deny`` is not found in the text after the last dot."""
    return url.isNotNull() if deny is None else ~file_extension(url).rlike(deny)
