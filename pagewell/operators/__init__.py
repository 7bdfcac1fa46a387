"""DataFrame operators: crawl state, change detection, index building, ranked search."""
