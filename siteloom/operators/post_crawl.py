"""The analysis after a crawl: every per-page and cross-page rule, and its issues attached to their pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cross_issues as X
from .page_issues import post_crawl_page_issues

COLUMNS = ("url", "issue_type", "severity", "category", "detail")


def analysed(pages: DataFrame, links: DataFrame, sitemap: DataFrame, *, start_url: str | None = None, alternates: DataFrame | None = None) -> DataFrame:
    """(url, issue_type, severity, category, detail) of all rules over the pages of one crawl.

    ``pages`` should be written or cached: each rule reads some columns of it. Rules that need columns which ``pages``
    lacks (AMP keys, redirects, keyword maps, alternates) have no issues."""
    has = lambda *names: all(n in pages.columns for n in names)
    found = [post_crawl_page_issues(pages), X.duplicate_titles(pages), X.sitemap_not_crawled(pages, sitemap), X.missing_from_sitemap(pages, sitemap), X.sitemap_errors(pages, sitemap),
             X.orphaned_pages(pages, links, start_url), X.links_to_4xx(pages, links), X.overused_anchors(links)]
    for rule, names in ((X.duplicate_descriptions, ("meta_description",)), (X.duplicate_content, ("content_hash",)), (X.canonical_clusters, ("canonical_url",)), (X.redirect_chains, ("redirect_count",)),
                        (X.keyword_cannibalization, ("keyword_density", "noindex")), (X.amp_pairs, ("amp_normalized", "is_amp", "canonical_normalized")), (X.broken_pagination, ("pagination_next", "pagination_prev"))):
        if has(*names):
            found.append(rule(pages))
    if alternates is not None:
        found += [X.hreflang_targets(pages, alternates), X.hreflang_reciprocity(pages, alternates)]
    return reduce(DataFrame.unionByName, (f.select(*(F.col(c).cast("string").alias(c) for c in COLUMNS)) for f in found))


def persisted(issues: DataFrame, pages: DataFrame, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(issues with their page's id, one row with the count): an issue of no crawled page is dropped but counted, and
    so is one that is stored already."""
    kept = X.attached(issues, pages).where("page_id is not null")
    if stored is not None:
        kept = kept.join(stored.select("page_id", "issue_type", "detail").distinct(), ["page_id", "issue_type", "detail"], "left_anti")
    return kept, issues.agg(F.count("*").alias("issues"))
