"""Running counters over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress(events: DataFrame) -> DataFrame:
    """Counters of a stream of events (event_type, value): update mode keeps one state row for each type."""
    return events.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))
