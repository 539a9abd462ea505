"""The parse of pages as a stored table: partitioned by crawl, dealt by normal form, read by columns."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.lineage import shared_folder
from .pages import parsed

#: Parts of a crawl, by normal form: a crawl that holds most pages is then written by many tasks.
PARTS = 64
CRAWL = "crawl_id"

_known: dict[tuple, tuple[str, StructType]] = {}


def write_parse(pages: DataFrame, path: str, *, url: str = "url", closed: bool = False) -> StructType:
    """Parse ``pages`` once and write the records, with the links, in a folder for each crawl; crawls that ``pages`` hold are
    replaced, others stay. Pages without a crawl go to crawl 0. Returns the schema, for :func:`read_parse`."""
    rows = parsed(pages if CRAWL in pages.columns else pages.withColumn(CRAWL, F.lit(0).cast("long")), url=url, closed=closed)
    dealt = rows.repartition(CRAWL, F.pmod(F.xxhash64("normalized_url"), F.lit(PARTS))).sortWithinPartitions(CRAWL, "normalized_url")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(CRAWL).parquet(path)
    return StructType([f for f in rows.schema if f.name != CRAWL] + [StructField(CRAWL, LongType())])


def read_parse(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The stored parse. With ``schema``, columns that older files lack are null, and those that it lacks are not read;
    without, the files' columns are merged. Filters by crawl choose folders; only the columns in use are read."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", True).parquet(path)


def _mark(spark: SparkSession, path: str) -> tuple:
    """What tells whether the files at ``path`` changed: names, sizes and times, listed by Hadoop."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where)))


def parse_of(spark: SparkSession, path: str, closed: bool = False) -> DataFrame:
    """The stored parse of the pages table at ``path``: made when first asked for in an application, or when the files have
    changed, and read by every query after that. It is in the shared folder, and goes when the driver ends."""
    key = (spark.sparkContext.applicationId, path, closed, _mark(spark, path))
    if key not in _known:
        to = f"{shared_folder(spark)}/siteloom/parse-{uuid4().hex}"
        schema = write_parse(spark.read.parquet(path), to, closed=closed)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        _known[key] = to, schema
    to, schema = _known[key]
    return read_parse(spark, to, schema)
