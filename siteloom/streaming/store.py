"""Crawled pages as a stream into three tables, so that a batch that runs again, or stopped half way, changes nothing.

Every micro-batch writes folders of its own, and a mark when all three are there; readers see marked batches only, and
of each page what was fetched last, with the links and issues of that fetch. Compaction folds batches into tables that
are partitioned by crawl.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.page_issues import incremental_issues
from ..sources.landing import landed
from ..sources.pages import links, parsed

TABLES = ("pages", "links", "issues")
KEY = ["crawl_id", "url"]


def write_batch(batch: DataFrame, number: int, out: str, closed: bool = False) -> None:
    """Parse one batch of fetches once and write its pages, links and issues. Of a page that the batch holds several
    times, the last fetch counts (of equal times the greatest id). Folders of a batch that stopped are replaced. ``closed``
    is that of :func:`parsed`."""
    spark = batch.sparkSession
    last = batch.groupBy(*KEY).agg(F.max_by(F.struct(*(c for c in batch.columns if c not in KEY)), F.struct("fetched_at", "page_id")).alias("r")).select(*KEY, "r.*")
    rows = parsed(landed(last.select(*batch.columns)), closed=closed).withColumn("batch", F.lit(number))
    # The parse is written first and read back for the others, so it happens once, wherever executors are lost.
    rows.write.mode("overwrite").parquet(f"{out}/pages/{number}")
    whole = spark.read.schema(rows.schema).parquet(f"{out}/pages/{number}")
    keyed = lambda frame: frame.withColumn("batch", F.lit(number)).join(whole.select(F.col("page_id").alias("_id"), *KEY), F.col("_id") == F.col(frame.columns[0]), "inner").drop("_id")
    keyed(links(whole)).write.mode("overwrite").parquet(f"{out}/links/{number}")
    found = incremental_issues(whole)
    found = found.select(F.col("page_id").alias("issue_page"), *(c for c in found.columns if c not in ("page_id", "url")))
    keyed(found).write.mode("overwrite").parquet(f"{out}/issues/{number}")
    spark.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/marks/batch={number}")


def ingest(fetches: DataFrame, out: str, checkpoint: str, closed: bool = False) -> StreamingQuery:
    """A stream of landed fetches (at least page_id, crawl_id, url, html, fetched_at and what :func:`landed` reads), batch
    by batch into the tables under ``out``, as far as they have arrived."""
    return fetches.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, out, closed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, out: str) -> list[int]:
    """The marked batches, in order: one small folder each, listed and not read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/marks")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    done = [s.getPath() for s in fs.listStatus(hadoop) if s.isDirectory()]
    success = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().removeprefix("batch=")) for p in done if fs.exists(success(p, "_SUCCESS")))


def current(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """pages, links and issues as they stand: of each page the last fetch (then the last batch), and the links and
    issues that it had. Two joins by page and batch; no batch, no tables."""
    marked = batches(spark, out)
    if not marked:
        return {}
    read = {t: spark.read.option("mergeSchema", "true").parquet(*(f"{out}/{t}/{n}" for n in marked)) for t in TABLES}
    pages = read["pages"]
    last = pages.groupBy(*KEY).agg(F.max_by("batch", F.struct("fetched_at", "batch")).alias("batch"))
    return {t: frame.join(last, [*KEY, "batch"], "left_semi") for t, frame in read.items()}


def compact(spark: SparkSession, out: str, target: str) -> None:
    """Fold the batches into tables under ``target``, partitioned by crawl: the crawls that they hold are replaced, by
    dynamic partition overwrite, and the files of other crawls stay as they are."""
    for name, frame in current(spark, out).items():
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id").parquet(f"{target}/{name}")


def clear_crawl(spark: SparkSession, target: str, crawl_id: int) -> None:
    """Empty a crawl: its partitions of the three tables leave, no other file is touched. The crawl itself stays; see
    ``operators.queries.cleared`` for its counters."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{target}/{name}/crawl_id={crawl_id}")
        path.getFileSystem(conf).delete(path, True)


def clear_project(spark: SparkSession, target: str, crawls: DataFrame, project_id: int) -> None:
    """Empty every crawl of a project: its crawls' numbers, a few, come to the driver, which drops their partitions."""
    for r in crawls.where(F.col("project_id") == project_id).select("crawl_id").distinct().toLocalIterator():
        clear_crawl(spark, target, r["crawl_id"])
