"""Landed inputs: fetch records, robots texts and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a landed fetch looks like; pages are landed outside Spark and read from here on.
FETCH = T.StructType([T.StructField(n, t) for n, t in (
    ("crawl_id", T.LongType()), ("page_id", T.LongType()), ("url", T.StringType()), ("final_url", T.StringType()), ("status_code", T.IntegerType()), ("headers", T.MapType(T.StringType(), T.StringType())),
    ("content_type", T.StringType()), ("content_length", T.LongType()), ("response_time_ms", T.DoubleType()), ("redirect_count", T.IntegerType()), ("html", T.StringType()), ("error_message", T.StringType()), ("depth", T.IntegerType()), ("fetched_at", T.TimestampType()))])


def read_fetches(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(FETCH).format(form).load(path)


def landed(fetches: DataFrame, max_kb: int = 5120) -> DataFrame:
    """A response over the size limit becomes status 414 without html; a transport error is status 0."""
    over = F.col("content_length") > max_kb * 1024
    return fetches.withColumns({"html": F.when(~F.coalesce(over, F.lit(False)), F.col("html")), "status_code": F.when(F.coalesce(over, F.lit(False)), 414).when(F.col("error_message").isNotNull(), 0).otherwise(F.col("status_code"))})


def robots_rules(robots: DataFrame, compat: bool = False) -> DataFrame:
    """``robots``: (host, text) to (host, position, allow, pattern), longest pattern first in use. Directives are
    case-sensitive, user-agent groups are not told apart, patterns are lower-cased. ``compat`` keeps an empty
    Disallow, which blocks everything not matched earlier, as the original did."""
    lines = robots.select("host", F.posexplode(F.split("text", "\r?\n")).alias("position", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    allow = F.col("line").startswith("Allow:")
    rules = lines.where(allow | F.col("line").startswith("Disallow:")).select("host", "position", allow.alias("allow"), F.lower(F.trim(F.regexp_replace("line", "^[A-Za-z]+:", ""))).alias("pattern"))
    return rules if compat else rules.where("pattern <> ''")


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed`` to rows of (url, host, path): that of the longest rule which is a prefix of the lower-case
    path (``/`` matches all; the earlier of equals); allowed if there is none.

    A path meets rules by equality alone: its prefixes of the lengths that the host's patterns have, which are few, join
    the patterns. So a host of very many rules costs a path as many rows as there are lengths, and not rules."""
    best_rule = rules.groupBy("host", "pattern").agg(F.max_by("allow", -F.col("position")).alias("allow"))
    lengths = best_rule.groupBy("host").agg(F.collect_set(F.length("pattern")).alias("_lengths"))
    path = F.lower(F.coalesce(F.col("path"), F.lit("/")))
    paths = urls.select("url", "host", path.alias("_path")).distinct().join(lengths, "host")
    fitting = F.transform(F.filter("_lengths", lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    met = paths.select("url", "host", F.explode(F.array_union(fitting, F.array(F.lit("/")))).alias("pattern")).join(best_rule, ["host", "pattern"])
    best = met.groupBy("url", "host").agg(F.max_by("allow", F.length("pattern")).alias("_allow"))
    return urls.join(best, ["url", "host"], "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


def _tags(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>"), F.lit(1))


def _one(xml: Column, tag: str) -> Column:
    """The text of the first such element without white space around it; references are decoded, but not in CDATA."""
    raw = F.regexp_replace(F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}>", 1), r"^\s+|\s+\z", "")
    plain = raw
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    text = F.when(raw.startswith("<![CDATA["), F.regexp_replace(raw, r"(?s)\A<!\[CDATA\[\s*|\s*\]\]>\z", "")).otherwise(plain)
    return F.when(text != "", text)


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """``sitemaps``: (sitemap, xml) to (sitemap, loc, lastmod, priority, changefreq)."""
    url = sitemaps.select("sitemap", F.explode(_tags(F.col("xml"), "url")).alias("u"))
    return url.select("sitemap", _one(F.col("u"), "loc").alias("loc"), _one(F.col("u"), "lastmod").alias("lastmod"), _one(F.col("u"), "priority").try_cast("double").alias("priority"), _one(F.col("u"), "changefreq").alias("changefreq")).where("loc is not null")


def sitemap_children(sitemaps: DataFrame) -> DataFrame:
    """(sitemap, child) of the sitemap indexes among them; a document with entries is none."""
    child = sitemaps.where(F.size(_tags(F.col("xml"), "url")) == 0).select("sitemap", F.explode(_tags(F.col("xml"), "sitemap")).alias("s"))
    return child.select("sitemap", _one(F.col("s"), "loc").alias("child")).where("child is not null")


def sitemaps_under(sitemaps: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """The rows of ``sitemaps`` under a root, each once, indexes followed ``depth`` times: a bounded loop of joins."""
    level = sitemaps.where(F.col("sitemap") == root)
    found = level.select("sitemap")
    for _ in range(depth):
        level = sitemaps.join(sitemap_children(level).select(F.col("child").alias("sitemap")).distinct(), "sitemap", "left_semi")
        found = found.unionByName(level.select("sitemap"))
    return sitemaps.join(found.distinct(), "sitemap", "left_semi")


def sitemap_tree(sitemaps: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """Distinct locs under a root sitemap, indexes followed ``depth`` times."""
    return sitemap_entries(sitemaps_under(sitemaps, root, depth)).select("loc").distinct().orderBy("loc")


def default_sitemap(root: str) -> str:
    from urllib.parse import urljoin

    return urljoin(root, "/sitemap.xml")
