"""Settings that callers pass to the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CrawlConfig:
    """Settings of a crawl job. The numbers are seconds.

    The patterns are unanchored regular expressions: a link is followed when
    ``allow`` is found in it and ``deny`` is not; a file is stored when
    ``deny_file_type`` is not found in the text after its last dot. ``None`` denies nothing,
    and with ``store_files`` off no file is.
    """

    start_url: str
    allow: str = "."
    deny: str | None = None
    deny_file_type: str | None = None
    default_interval: float = 86_400.0
    min_interval: float = 3_600.0
    max_interval: float = 8_640_000.0
    same_ratio: float = 0.998
    store_files: bool = True


@dataclass(frozen=True)
class SearchConfig:
    """Settings of ranked search and its snippets.

    A fuzzy clause is searched with at most ``max_edits`` edits, whatever it asks for, and stands
    for all terms that near, or for the nearest ``max_expansions`` where a caller sets a number.
    """

    top_k: int = 20
    snippet_length: int = 128
    k1: float = 1.2
    b: float = 0.75
    max_edits: int = 2
    max_expansions: int | None = None
    open_tag: str = "<font color='red'>"
    close_tag: str = "</font>"
