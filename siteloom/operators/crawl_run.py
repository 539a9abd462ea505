"""A crawl from its seeds to stored tables, over fetches that were landed outside Spark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_folder
from ..functions.urls import host, normalized
from ..sources import landing
from ..sources.pages import links
from ..sources.stored import read_parse, write_parse
from ..streaming.store import write_batch
from .crawl import Scope, crawl_order


@dataclass
class Settings:
    """What a crawl may do. ``seeds`` are queued after the start, those of sitemaps after them."""

    start_url: str
    max_urls: int = 1000
    max_depth: int = 3
    seeds: Sequence[str] = ()
    scope: Scope | None = None
    respect_robots: bool = True
    sitemap: str | None = None
    extra: dict = field(default_factory=dict)


def closed_to_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    told = urls.select("url", host(F.col("url")).alias("host"), F.try_parse_url(F.col("url"), F.lit("PATH")).alias("path"))
    return landing.robots_allowed(told, rules).where("not allowed").select("url")


def run_crawl(spark: SparkSession, crawl_id: int, settings: Settings, fetches: DataFrame, out: str, *, robots: DataFrame | None = None, sitemaps: DataFrame | None = None, number: int = 0) -> DataFrame:
    """Crawls what is landed and writes pages, links and issues as one batch (see ``streaming.store``). Returns the queue
    with what became of each address: (url, depth, place, crawled, status_code), the status null where nothing was landed.

    ``fetches`` are rows of ``landing.FETCH``; of an address that was landed several times, the last one counts. ``robots``
    is (host, text), ``sitemaps`` (sitemap, xml). The landed pages are parsed once, into the shared folder; levels, budget
    and robots are as in :func:`crawl_order`. A crawl that runs again under the same number replaces what it wrote."""
    scope = settings.scope or Scope(settings.start_url)
    key = normalized(F.col("url"))
    last = fetches.withColumn("_key", key).groupBy("_key").agg(F.max_by(F.struct(*fetches.columns), F.struct("fetched_at", "page_id")).alias("r"))
    held = last.select("_key", "r.*")
    path = f"{shared_folder(spark)}/siteloom/landed-{uuid4().hex}"
    parse = read_parse(spark, path, write_parse(held.select("page_id", "url", "html"), path))
    told = links(parse).where("link_relation = 'HtmlA' and not is_no_follow")
    # Every level reads the links, so their normal forms are made once.
    told = cut(told.join(parse.select(F.col("page_id").alias("source_id"), F.col("normalized_url").alias("source")), "source_id").select("source", F.col("target_normalized_url").alias("target"), "position"))
    # A few addresses given by hand, then those of the sitemap, by name.
    seeds = spark.createDataFrame([(u, k) for k, u in enumerate([settings.start_url, *settings.seeds])], "url string, position int")
    if settings.sitemap and sitemaps is not None:
        seeds = seeds.unionByName(landing.sitemap_tree(sitemaps, settings.sitemap).select(F.col("loc").alias("url"), F.lit(len(settings.seeds) + 1).alias("position")))
    seeds = seeds.withColumn("url", normalized(F.col("url")))
    seeds = seeds.where((F.col("position") == 0) | scope.column(F.col("url")))
    rules = landing.robots_rules(robots) if robots is not None and settings.respect_robots else None
    order = crawl_order(seeds, told, max_depth=settings.max_depth, max_urls=settings.max_urls, in_scope=scope.column, blocked=None if rules is None else lambda urls: closed_to_robots(urls, rules))
    fetched = order.where("crawled").select(F.col("url").alias("_key"), F.col("depth").alias("_depth")).join(held, "_key")
    batch = fetched.withColumns({"crawl_id": F.lit(crawl_id).cast("long"), "depth": F.col("_depth")}).select(*landing.FETCH.names)
    write_batch(batch, number, out)
    status = held.select(F.col("_key").alias("url"), "status_code")
    return order.join(status, "url", "left").withColumn("status_code", F.when(F.col("crawled"), F.col("status_code")))
