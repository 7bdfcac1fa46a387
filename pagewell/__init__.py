"""pagewell: keep a web corpus fresh and searchable with Spark DataFrames.

Pages, fetch logs and visit logs come in as tables or streams; extracted text,
crawl state, an inverted index and ranked hits come out as tables.
"""

from pagewell.config import CrawlConfig, SearchConfig
from pagewell.session import build_session

__all__ = ["CrawlConfig", "SearchConfig", "build_session"]
