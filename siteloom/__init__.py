"""Site-audit analytics on Spark: parsing, issue rules, queries, crawl diffs, text analytics, sinks and streams."""
