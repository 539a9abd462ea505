"""Ends of lineage in the folder that all machines share, and ranks over whole tables without one sorted partition."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder, in local mode only."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="siteloom-")
    return _own[app]


def cut(frame: DataFrame) -> DataFrame:
    """The frame as a checkpoint: what reads it, or loses a part of it, doesn't compute what led to it again."""
    sc = frame.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/siteloom/{name}-{uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame as Parquet in the shared folder: made once for all that read it, each by its columns."""
    path = folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Bits of a row's number within its partition, in numbers that increase over partitions.
WITHIN = 33


def _placed(frame: DataFrame, order: list[Column | str], sort: bool) -> tuple[DataFrame, DataFrame]:
    """The rows in partitions by ranges of ``order``, with ``_at``, written out; and (_part, _before, _rows) of each
    partition: as many rows as there are partitions, the only ones that a single task sees."""
    ranged = frame.repartitionByRange(*order)
    placed = cut((ranged.sortWithinPartitions(*order) if sort else ranged).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", WITHIN).alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, sizes.select("_part", before.alias("_before"), "_rows")


def ranked(frame: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds each row's place, from 0, in the order of all rows: places within ranges, and the ranges' offsets."""
    placed, sizes = _placed(frame, order, True)
    out = placed.withColumn("_part", F.shiftright("_at", WITHIN)).join(F.broadcast(sizes), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << WITHIN) - 1))).drop("_part", "_at", "_before", "_rows")


def slice_of(frame: DataFrame, order: list[Column | str], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of the sorted frame, in order. Rows are dealt by ranges and counted; the
    ranges that hold the slice are sorted, no others. ``order`` must be columns of the frame."""
    placed, sizes = _placed(frame, order, False)
    # As many rows as there are partitions; at most a few hold the slice.
    held = sizes.where((F.col("_before") < offset + size) & (F.col("_before") + F.col("_rows") > offset)).orderBy("_part").collect()
    if not held:
        return frame.limit(0)
    mine = placed.where(F.shiftright("_at", WITHIN).between(held[0]["_part"], held[-1]["_part"])).drop("_at")
    return mine.orderBy(*order).offset(offset - held[0]["_before"]).limit(size)
