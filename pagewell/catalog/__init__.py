"""Every operator as a query over the given tables, with the SQL that checks it."""

from pagewell.catalog import content, crawl, indexing, ranking, rounds, streams
from pagewell.catalog.registry import ENTRIES, Entry

__all__ = ["ENTRIES", "Entry", "content", "crawl", "indexing", "ranking", "rounds", "streams"]
