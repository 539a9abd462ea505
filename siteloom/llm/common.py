"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: A word is a run of anything but these six characters (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves, in local mode only (one machine); a cluster without
    the setting is an error, as executors would not see each other's files.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="siteloom-")
    return _own_dir[app]


def materialize(df: DataFrame, name: str, keep: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: lineage ends here, so a lost
    executor costs a re-read and not a recomputation. Removed when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siteloom/{name}-{uuid.uuid4().hex}"
    # Once it is written, nothing reads the shuffles that led to it: they leave the disks at once.
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEAN, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._siteloom_path = path
    if _scratch and not keep:
        _scratch[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """What is materialized inside and not kept is removed at the end."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            discard(df)


def discard(df: DataFrame) -> None:
    """Remove what :func:`materialize` wrote; nothing may read it afterwards."""
    path = getattr(df, "_siteloom_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared one; nothing happens if it isn't there."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Bound the rows and bytes that one Arrow batch of whole texts may hold. A stricter limit of the session stays; 0
    and below mean none there. The setting is read when the query runs, so it can't be put back before."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        told = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}").strip().lower())
        if not told or not 0 < int(told[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[told[2]] <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def bounded_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose ``column`` holds about ``most`` bytes, and one row at least: what is computed for a
    batch is then bounded too, whatever the session's limits are."""
    for b in batches:
        size, n = max(b.column(column).nbytes, 1), b.num_rows
        if size <= most or n < 2:
            yield b
            continue
        step, at = max(1, n * most // size), 0
        while at < n:
            part = b.slice(at, step)
            while part.num_rows > 1 and sum(len(x) for x in part.column(column).to_pylist() if x is not None) > 2 * most:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_count(text):
    """Column: number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_fields(schema: StructType, **more: str | DataType) -> StructType:
    """A copy of ``schema`` with more fields (name=type)."""
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out
