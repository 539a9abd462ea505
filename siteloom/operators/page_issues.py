"""Rules over one page at a time: a list of conditional structs, filtered and exploded in one pass, no join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host
from ..sources.pages import is_html
from .registry import DEFAULTS

#: Fields that a schema.org type must have.
REQUIRED = {
    "Organization": ["name"], "LocalBusiness": ["name", "address"], "Article": ["headline", "author", "datePublished"],
    "NewsArticle": ["headline", "author", "datePublished", "image"], "BlogPosting": ["headline", "author", "datePublished"],
    "Product": ["name", "description", "offers"], "Recipe": ["name", "image", "recipeInstructions"], "VideoObject": ["name", "thumbnailUrl", "uploadDate"],
    "Event": ["name", "startDate"], "FAQPage": ["mainEntity"], "HowTo": ["name", "step"], "BreadcrumbList": ["itemListElement"],
    "JobPosting": ["title", "datePosted", "hiringOrganization", "jobLocation"],
}
INSECURE_PART = r"(?i)(?:src|href)=[\"']http://|url\([\"']?http://"
HREFLANG_CODE = r"(?i)^(\*|[a-z]{2}(-[A-Z]{2})?|x-default)$"

#: Columns that rules may read, with the type a missing one takes as null.
INPUTS = {
    "status_code": "int", "content_type": "string", "response_time_ms": "double", "final_url": "string", "redirect_count": "int", "headers": "map<string,string>", "html": "string",
    "total_image_size_kb": "double", "title": "string", "meta_description": "string", "canonical_url": "string", "self_referencing_canonical": "boolean", "robots_meta": "string",
    "noindex": "boolean", "h1_count": "int", "has_h1": "boolean", "word_count": "int", "image_count": "int", "images_with_alt": "int", "images_without_alt": "int",
    "images_missing_dimensions": "int", "images_missing_lazy_loading": "int", "open_graph": "map<string,string>", "twitter_card": "map<string,string>", "structured_data": "array<string>",
    "hreflang_alternates": "array<string>", "is_amp": "boolean", "amp_html_url": "string", "normalized_url": "string", "pagination_next": "string", "pagination_prev": "string",
    **{f"headings_h{k}": "array<string>" for k in range(2, 7)},
}


def with_inputs(pages: DataFrame) -> DataFrame:
    return pages.withColumns({c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in pages.columns})


def issue(kind: str, when: Column, detail: Column | str = "", severity: str | Column | None = None, category: str | None = None) -> Column:
    """The struct of an issue where ``when`` holds, else null. Severity and category default to the registry's."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(F.lit(kind).alias("issue_type"), lit(DEFAULTS[kind][0] if severity is None else severity).alias("severity"), lit(category or DEFAULTS[kind][1]).alias("category"), lit(detail).cast("string").alias("detail")))


def blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", "") == "", F.lit(True))


def text_of(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")


def incremental_rules(compat: bool = False) -> list[Column]:
    """The 14 rules that run as a page is fetched."""
    c = F.col
    status, noindex = F.coalesce(c("status_code"), F.lit(0)), F.coalesce(c("noindex"), F.lit(False))
    failed = (status >= 400) if compat else (status >= 400) | (status == 0)
    ok, page = status.between(200, 399), ~failed & is_html(c("content_type"))
    h1, h2 = F.coalesce(c("h1_count"), F.lit(0)), F.coalesce(F.size("headings_h2"), F.lit(0))
    with_alt, without = F.coalesce(c("images_with_alt"), F.lit(0)), F.coalesce(c("images_without_alt"), F.lit(0))
    has_h1 = F.coalesce(c("has_h1"), h1 > 0)
    return [
        issue("non_200_status", failed, status, F.when((status == 404) | (status >= 500), "critical").otherwise("warning")),
        issue("missing_title", page & ok & blank(c("title"))),
        issue("title_too_long", page & (F.length("title") > 60), F.length("title")),
        issue("missing_meta_description", page & ok & blank(c("meta_description"))),
        issue("meta_description_too_long", page & (F.length("meta_description") > 160), F.length("meta_description")),
        issue("thin_content", page & ~noindex & (c("word_count") < 300), c("word_count")),
        issue("missing_h1", page & ~has_h1),
        issue("multiple_h1", page & (h1 > 1), h1),
        issue("missing_h2", page & (h2 <= 0) & (h1 != 0) & has_h1 & (c("word_count") > 50)),
        issue("noindex", page & noindex & ok),
        issue("slow_response", page & (c("response_time_ms") > 3000), c("response_time_ms")),
        issue("missing_canonical", page & ~noindex & ok & c("canonical_url").isNull()),
        issue("non_self_referencing_canonical", page & c("canonical_url").isNotNull() & ~F.coalesce(c("self_referencing_canonical"), F.lit(False)), c("canonical_url")),
        issue("images_without_alt", page & (without > 0) & (with_alt < 0.8 * (with_alt + without)) & (c("image_count") > 2), without),
    ]


def heading_gap(compat: bool) -> Column:
    """The first pair of present heading levels that skips one, as 'from-to'. ``compat`` starts from level -1, as
    the original did, so that the first heading of any page is the pair."""
    sizes = [F.coalesce(F.col("h1_count"), F.lit(0)), *(F.greatest(F.coalesce(F.size(f"headings_h{k}"), F.lit(0)), F.lit(0)) for k in range(2, 7))]
    present = F.filter(F.array(*(F.when(n > 0, F.lit(k)) for k, n in enumerate(sizes, 1))), lambda k: k.isNotNull())
    levels = F.concat(F.array(F.lit(-1 if compat else 0)), present)
    gaps = F.transform(levels, lambda k, i: F.when((i > 0) & (k > F.get(levels, i - 1) + 1), F.concat_ws("-", F.greatest(F.get(levels, i - 1), F.lit(0)), k)))
    return F.get(F.filter(gaps, lambda g: g.isNotNull()), F.lit(0))


def post_crawl_rules(compat: bool = False) -> list[Column]:
    """Rules with at most one issue a page that run after the crawl; severity and category are stated, as they
    often differ from the registry's."""
    c = F.col
    n_title, n_desc = F.length(text_of("title")), F.length(text_of("meta_description"))
    h1, h2 = F.coalesce(c("h1_count"), F.lit(0)), F.greatest(F.coalesce(F.size("headings_h2"), F.lit(0)), F.lit(0))
    canonical, no_canonical = F.coalesce(c("canonical_url"), F.lit("")), F.coalesce(c("canonical_url"), F.lit("")) == ""
    page_host, canonical_host = host(c("url")), host(c("canonical_url"))
    bare = lambda x: F.lower(F.regexp_replace(x, "/+$", ""))
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    robots = F.lower(F.coalesce(c("robots_meta"), F.lit("")))
    header = lambda name: F.element_at(F.coalesce(c("headers"), F.create_map().cast("map<string,string>")), F.lit(name))
    fetched = c("status_code").between(200, 399) & c("headers").isNotNull()
    https = c("url").startswith("https://")
    absent = lambda name: F.coalesce(header(name), F.lit("")) == ""
    keys = ("ogTitle", "ogDescription", "ogImageUrl", "twitterCard", "twitterImageUrl") if compat else ("title", "description", "image", "card", "image")
    has = lambda m, k: ~blank(F.element_at(F.coalesce(c(m), F.create_map().cast("map<string,string>")), F.lit(k)))
    og_title, og_desc, og_image = (has("open_graph", k) for k in keys[:3])
    card, card_image = (has("twitter_card", k) for k in keys[3:])
    amp_bad = c("amp_html_url").isNotNull() & (~F.lower("amp_html_url").rlike("^https?://[^/]") | (c("amp_html_url") == c("url")))
    gap = heading_gap(compat)
    rules = [
        issue("no_canonical_tag", no_canonical),
        issue("external_canonical", ~no_canonical & (page_host.isNotNull()) & ~F.coalesce(page_host == canonical_host, F.lit(False)), canonical, "critical", "technical"),
        issue("canonicalized_url", ~no_canonical & (page_host == canonical_host) & (bare(canonical) != bare(c("url"))), canonical, "warning", "technical"),
        issue("title_too_long", n_title > 60, n_title, "info", "content"),
        issue("title_too_short", (n_title > 0) & (n_title < 30), n_title, "info", "content"),
        issue("missing_title", n_title == 0, "", "critical", "content"),
        issue("meta_description_too_long", n_desc > 160, n_desc, "info", "content"),
        issue("meta_description_too_short", (n_desc > 0) & (n_desc < 70), n_desc, "info", "content"),
        issue("missing_meta_description", n_desc == 0, "", "warning", "content"),
        issue("missing_h1", h1 == 0, "", "warning", "structure"),
        issue("multiple_h1", h1 > 1, h1, "info", "structure"),
        issue("missing_h2", (h2 == 0) & (zero("word_count") > 0), "", "info", "structure"),
        issue("heading_non_sequential", gap.isNotNull(), gap, "warning", "structure"),
        issue("important_page_noindex", robots.contains("noindex") | robots.contains("none") | F.coalesce(c("noindex"), F.lit(False)), "", "critical", "technical"),
        issue("amp_missing_canonical", F.coalesce(c("is_amp"), F.lit(False)) & blank(c("canonical_url")), "", "warning", "technical"),
        issue("amp_invalid_target", amp_bad, c("amp_html_url"), "warning", "technical"),
        issue("image_missing_alt_attribute", zero("images_without_alt") > 0, zero("images_without_alt"), "critical", "content"),
        issue("image_missing_dimensions", zero("images_missing_dimensions") > 0, zero("images_missing_dimensions"), "info", "performance"),
        issue("image_missing_lazy_loading", zero("images_missing_lazy_loading") > 0, zero("images_missing_lazy_loading"), "info", "performance"),
        issue("image_oversized", zero("total_image_size_kb") > 1024, c("total_image_size_kb"), "warning", "performance"),
        issue("insecure_http", fetched & ~https, "", "critical", "security"),
        issue("missing_x_content_type_options", fetched & absent("x-content-type-options"), "", "warning", "security"),
        issue("missing_x_frame_options", fetched & absent("x-frame-options") & ~F.coalesce(F.lower(header("content-security-policy")).contains("frame-ancestors"), F.lit(False)), "", "warning", "security"),
        issue("missing_csp", fetched & absent("content-security-policy"), "", "warning", "security"),
        issue("missing_referrer_policy", fetched & absent("referrer-policy"), "", "info", "security"),
        issue("missing_hsts", fetched & https & absent("strict-transport-security"), "", "warning", "security"),
        issue("mixed_content", fetched & https & F.coalesce(c("html").rlike(INSECURE_PART), F.lit(False)), "", "critical", "security"),
        issue("missing_og_tags", ~og_title & ~og_desc & ~og_image, "", "warning", "social"),
        issue("og_missing_image", (og_title | og_desc) & ~og_image, "", "info", "social"),
        issue("missing_twitter_card", ~card, "", "info", "social"),
        issue("twitter_missing_image", card & ~card_image, "", "info", "social"),
        issue("missing_pagination_canonical", (c("pagination_next").isNotNull() | c("pagination_prev").isNotNull()) & no_canonical, "", "info", "technical"),
    ]
    return rules


def many_issues() -> list[Column]:
    """Rules with several issues a page: arrays of structs."""
    codes = F.coalesce(F.col("hreflang_alternates"), F.array().cast("array<string>"))
    made = lambda kind, severity, category, detail: F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.cast("string").alias("detail"))
    twice = F.filter(F.array_distinct(codes), lambda x: F.size(F.filter(codes, lambda y: y == x)) > 1)
    blocks = F.coalesce(F.col("structured_data"), F.array().cast("array<string>"))
    table = F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))

    def of_block(block: Column) -> Column:
        kind = F.get_json_object(block, "$.@type")
        kinds = F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))

        def missing(k: Column) -> Column:
            field = lambda b, f: F.call_function("get_json_object", b, F.concat(F.lit("$."), f)).isNotNull()
            graph = F.coalesce(F.from_json(F.get_json_object(block, "$.@graph"), "array<string>"), F.array().cast("array<string>"))
            has = lambda f: field(block, f) | F.exists(graph, lambda g: field(g, f))
            return F.filter(F.coalesce(F.element_at(table, k), F.array().cast("array<string>")), lambda f: ~has(f))

        def one(k: Column) -> Column:
            lack = missing(k)
            name = (
                F.when((k == "Product") & F.array_contains(lack, "offers"), "product_missing_price")
                .when(k.isin("Article", "NewsArticle") & F.array_contains(lack, "author"), "article_missing_author")
                .when((k == "BreadcrumbList") & F.array_contains(lack, "itemListElement"), "breadcrumb_invalid").otherwise("structured_data_missing_fields")
            )
            return F.when(F.size(lack) > 0, F.struct(name.alias("issue_type"), F.lit("warning").alias("severity"), F.lit("technical").alias("category"), F.concat(k, F.lit(": "), F.array_join(lack, ",")).alias("detail")))

        return F.filter(F.transform(F.filter(kinds, lambda k: k.isNotNull()), one), lambda s: s.isNotNull())

    return [
        F.transform(twice, lambda x: made("hreflang_duplicate_lang", "critical", "internationalization", x)),
        F.transform(F.filter(codes, lambda x: ~x.rlike(HREFLANG_CODE)), lambda x: made("hreflang_invalid_code", "warning", "internationalization", x)),
        F.flatten(F.transform(blocks, of_block)),
    ]


def evaluated(pages: DataFrame, rules: list[Column], arrays: list[Column] | None = None, keep: tuple[str, ...] = ("page_id", "url"), phase: str = "incremental") -> DataFrame:
    found = F.filter(F.array(*rules), lambda s: s.isNotNull())
    if arrays:
        found = F.concat(found, *arrays)
    return with_inputs(pages).select(*(k for k in keep if k in pages.columns), F.explode(found).alias("i")).select("*", "i.*", F.lit(phase).alias("phase")).drop("i")


def incremental_issues(pages: DataFrame, compat: bool = False) -> DataFrame:
    """(page_id, url, issue_type, severity, category, detail, phase): the fetch-time rules over parsed pages."""
    return evaluated(pages, incremental_rules(compat), phase="incremental")


def post_crawl_page_issues(pages: DataFrame, compat: bool = False) -> DataFrame:
    """The per-page rules after a crawl, over pages whose fetch succeeded as html (or that have no fetch data)."""
    pages = with_inputs(pages)
    good = F.col("status_code").isNull() | ((F.col("status_code") < 400) & is_html(F.col("content_type")))
    if not compat:
        good = good & F.coalesce(F.col("status_code") != 0, F.lit(True))
    return evaluated(pages.where(good), post_crawl_rules(compat), many_issues(), phase="post_crawl")


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
