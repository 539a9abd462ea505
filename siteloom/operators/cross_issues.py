"""Rules across pages: groups and equi-joins on stored keys. The reported page of a group is its smallest URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NO_DETAIL = ""


def _rows(frame: DataFrame, kind: str, severity: str, category: str, url: Column | str = "url", detail: Column | str = NO_DETAIL) -> DataFrame:
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return frame.select((F.col(url) if isinstance(url, str) else url).alias("url"), F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.cast("string").alias("detail"))


def _groups(pages: DataFrame, key: Column, more_than: int) -> DataFrame:
    """(key, url, n): groups of equal key, the smallest URL, the number of pages. Counts combine before the shuffle;
    members are not gathered (``members`` lists them)."""
    return pages.select(key.alias("key"), "url").where("key is not null").groupBy("key").agg(F.min("url").alias("url"), F.count("*").alias("n")).where(F.col("n") > more_than)


def members(pages: DataFrame, key: Column, groups: DataFrame) -> DataFrame:
    """(key, url) of every page of the groups, a row each: a group may hold most pages."""
    return pages.select(key.alias("key"), "url").join(groups.select("key"), "key", "left_semi")


def folded(c: str) -> Column:
    return F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    return _rows(_groups(pages.where(F.octet_length(folded("title")) > 5), folded("title"), 1), "duplicate_title", "warning", "content", detail=F.col("n"))


def duplicate_descriptions(pages: DataFrame) -> DataFrame:
    return _rows(_groups(pages.where(F.octet_length(folded("meta_description")) > 20), folded("meta_description"), 1), "duplicate_meta_description", "warning", "content", detail=F.col("n"))


def duplicate_content(pages: DataFrame) -> DataFrame:
    return _rows(_groups(pages.where("content_hash <> ''"), F.col("content_hash"), 1), "duplicate_content", "critical", "content", detail=F.col("n"))


def canonical_clusters(pages: DataFrame) -> DataFrame:
    return _rows(_groups(pages.where("canonical_url <> ''"), F.col("canonical_url"), 2), "canonical_cluster", "info", "technical", detail=F.col("n"))


def primary_keywords(pages: DataFrame) -> DataFrame:
    """(url, keyword): the densest term of at least 3 bytes of each page (``keyword_density``: map), ties to the greatest."""
    best = F.array_max(F.transform(F.filter(F.map_entries("keyword_density"), lambda e: (F.octet_length(e["key"]) >= 3) & (e["value"] > 0)), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return pages.select("url", best["k"].alias("keyword")).where("keyword is not null")


def keyword_cannibalization(pages: DataFrame) -> DataFrame:
    shown = pages.where(~F.coalesce(F.col("noindex"), F.lit(False)))
    return _rows(_groups(primary_keywords(shown), F.col("keyword"), 1), "keyword_cannibalization", "warning", "content", detail=F.concat_ws(":", "key", "n"))


def redirect_chains(pages: DataFrame) -> DataFrame:
    return _rows(pages.where("redirect_count > 0"), "redirect_chain", "warning", "technical", detail=F.col("redirect_count"))


def amp_pairs(pages: DataFrame) -> DataFrame:
    """A page's AMP target that is no AMP page, or whose canonical leads elsewhere (``*_normalized`` are stored keys)."""
    target = pages.select(F.col("normalized_url").alias("amp_normalized"), F.col("is_amp").alias("t_amp"), F.col("canonical_normalized").alias("t_canonical"), F.lit(True).alias("met")).dropDuplicates(["amp_normalized"])
    joined = pages.select("url", "normalized_url", "amp_normalized").where("amp_normalized is not null and not amp_normalized <=> normalized_url").join(target, "amp_normalized")
    return _rows(joined.where("not t_amp"), "amp_invalid_target", "warning", "technical", detail=F.col("amp_normalized")).unionByName(
        _rows(joined.where("t_amp and t_canonical is not null and t_canonical <> normalized_url"), "amp_canonical_mismatch", "warning", "technical", detail=F.col("t_canonical")))


def hreflang_targets(pages: DataFrame, alternates: DataFrame) -> DataFrame:
    """``alternates``: (url, href, href_normalized). Targets that are no web address, or whose page answers 400 or more."""
    bad = ~F.lower("href").rlike("^https?://[^/]")
    first = _rows(alternates.where(bad), "hreflang_invalid_target", "warning", "internationalization", detail=F.col("href"))
    failing = pages.where("status_code >= 400").select(F.col("normalized_url").alias("href_normalized")).distinct()
    return first.unionByName(_rows(alternates.where(~bad).join(failing, "href_normalized", "left_semi"), "hreflang_invalid_target", "warning", "internationalization", detail=F.col("href")))


def hreflang_reciprocity(pages: DataFrame, alternates: DataFrame) -> DataFrame:
    """Links to a crawled page that has none back; a page need not link to itself."""
    keyed = alternates.join(pages.select("url", "normalized_url"), "url").where("not href_normalized <=> normalized_url")
    back = keyed.select(F.col("normalized_url").alias("href_normalized"), F.col("href_normalized").alias("normalized_url")).distinct()
    known = pages.select(F.col("normalized_url").alias("href_normalized")).distinct()
    one_way = keyed.join(known, "href_normalized", "left_semi").join(back, ["href_normalized", "normalized_url"], "left_anti")
    return _rows(one_way, "hreflang_missing_reciprocal", "warning", "internationalization", detail=F.col("href"))


def page_key() -> Column:
    return F.lower(F.coalesce("normalized_url", "url"))


def sitemap_not_crawled(pages: DataFrame, sitemap: DataFrame, most: int = 500) -> DataFrame:
    """``sitemap``: (loc). The first ``most`` by URL: the report's limit. Nothing if either side is empty."""
    left = sitemap.select(F.lower("loc").alias("key")).distinct().join(pages.select(page_key().alias("key")), "key", "left_anti").orderBy("key").limit(most)
    any_page = pages.select(F.lit(1).alias("one")).limit(1)
    return _rows(left.join(any_page, F.lit(1) == F.col("one"), "left_semi"), "sitemap_url_not_crawled", "warning", "technical", url="key")


def missing_from_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Indexable pages that the sitemap leaves out; nothing without a sitemap."""
    some = sitemap.select(F.lit(1).alias("one")).limit(1)
    out = pages.where("indexability = 'indexable'").withColumn("key", page_key()).join(sitemap.select(F.lower("loc").alias("key")).distinct(), "key", "left_anti")
    return _rows(out.join(some, F.lit(1) == F.col("one"), "left_semi"), "crawled_url_missing_from_sitemap", "warning", "technical")


def sitemap_errors(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    out = pages.where("status_code >= 400").withColumn("key", page_key()).join(sitemap.select(F.lower("loc").alias("key")).distinct(), "key", "left_semi")
    return _rows(out, "sitemap_url_error_status", "critical", "technical", detail=F.col("status_code"))


def orphaned_pages(pages: DataFrame, links: DataFrame, start_url: str | None = None) -> DataFrame:
    """Indexable pages that no link of the crawl leads to, but the start page."""
    told = links.select(F.col("target_normalized_url").alias("normalized_url"))
    out = pages.where("indexability = 'indexable'").join(told, "normalized_url", "left_anti")
    if start_url is not None:
        out = out.where(F.col("url") != start_url)
    return _rows(out, "orphaned_page", "critical", "links")


def links_to_4xx(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Source pages with internal links to pages of status 400-499, and how many."""
    gone = pages.where("status_code between 400 and 499").select(F.col("normalized_url").alias("target_normalized_url")).distinct()
    out = links.where("is_internal").join(gone, "target_normalized_url", "left_semi").groupBy("source_url").agg(F.count("*").alias("n"))
    return _rows(out, "internal_link_to_4xx", "critical", "links", url="source_url", detail=F.col("n"))


def overused_anchors(links: DataFrame, least: int = 5, share: float = 0.0) -> DataFrame:
    """Targets whose most used anchor text (trimmed, lower-case) occurs ``least`` times or more; and its percentage.

    The counts of (target, anchor) are joined with the target's total, so no target's links meet in one task."""
    counts = links.where("trim(anchor_text) <> ''").groupBy("target_normalized_url", F.lower(F.trim("anchor_text")).alias("anchor")).agg(F.count("*").alias("n"))
    best = counts.groupBy("target_normalized_url").agg(F.max(F.struct("n", "anchor")).alias("m"), F.sum("n").alias("total"))
    out = best.where((F.col("m.n") >= least) & (F.col("m.n") >= share * F.col("total")))
    return _rows(out, "anchor_text_over_optimized", "info", "links", url="target_normalized_url", detail=F.concat_ws("|", F.col("m.anchor"), F.round(100 * F.col("m.n") / F.col("total"), 1)))


def broken_pagination(pages: DataFrame) -> DataFrame:
    known = pages.select(F.lower("url").alias("key")).distinct()
    told = pages.select("url", F.explode(F.array("pagination_next", "pagination_prev")).alias("to")).where("to is not null").withColumn("key", F.lower("to"))
    return _rows(told.join(known, "key", "left_anti"), "broken_pagination_chain", "warning", "technical", detail=F.col("to"))


def attached(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues with their page's id, by URL or else by its normal form; null for issues of no crawled page."""
    from ..functions.urls import normalized

    exact = issues.join(pages.groupBy("url").agg(F.min("page_id").alias("page_id")), "url", "left")
    rest = exact.where("page_id is null").drop("page_id").withColumn("normalized_url", normalized(F.col("url"))).join(pages.groupBy("normalized_url").agg(F.min("page_id").alias("page_id")), "normalized_url", "left").drop("normalized_url")
    return exact.where("page_id is not null").unionByName(rest)


