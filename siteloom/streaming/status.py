"""The state of every running crawl over a stream of its events: legal transitions, counters, events in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: What a command makes of a status; anything else leaves it as it is and counts as refused.
TRANSITIONS = {
    ("created", "start"): "crawling", ("crawling", "pause"): "paused", ("paused", "resume"): "crawling", ("crawling", "stop"): "stopped", ("paused", "stop"): "stopped",
    ("crawling", "complete"): "completed", ("crawling", "fail"): "failed", ("paused", "fail"): "failed",
}
#: Statuses that no command leaves.
ENDED = ("stopped", "completed", "failed")
COUNTERS = ("crawled", "queued", "issues", "links")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_longs = lambda *names: [StructField(n, LongType()) for n in names]
#: (seq, at) of the last event that was applied, the status, the counters, and how many events were applied and refused.
STATE = StructType([*_longs("seq", "at"), StructField("status", StringType()), *_longs(*COUNTERS, "applied", "refused")])
WAITING = StructType([*_longs("seq"), StructField("kind", StringType()), *_longs("at", *COUNTERS)])
OUTPUT = StructType([*_longs("crawl_id"), *STATE.fields])
INPUT = "crawl_id long, seq long, ts timestamp, kind string, crawled long, queued long, issues long, links long"


def applied(state: tuple, seq: int, event: tuple) -> tuple:
    """The state (as ``STATE``) after one event (as ``WAITING``, without its number). ``progress`` sets the counters of a crawl that has begun
    and not ended; those it doesn't tell stay."""
    (_, _, status, *rest), (kind, at, *told) = state, event
    counters, done, refused = rest[: len(COUNTERS)], rest[-2], rest[-1]
    if kind == "progress" and status in ("crawling", "paused"):
        counters = [old if new is None else new for old, new in zip(counters, told)]
    elif (status, kind) in TRANSITIONS:
        status = TRANSITIONS[status, kind]
    else:
        refused += 1
    return (seq, at, status, *counters, done + 1, refused)


def _whole(column: pd.Series) -> list[int | None]:
    return [None] * len(column) if column.isna().all() else [None if pd.isna(v) else int(v) for v in column]


class _Status(StatefulProcessor):
    """Events wait in a list until the watermark has passed them; then they are applied by time and number, each number
    once. Lists are written and read whole: a batch of a crawl's events is one message to the state store, as is
    the timer that wakes the crawl for it. What waits is bounded by the watermark's delay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def _state(self) -> tuple:
        return tuple(self.now.get()) if self.now.exists() else (-1, -1, "created", 0, 0, 0, 0, 0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, at = self._state()[:2]
        last = None
        for frame in rows:
            ms = pd.to_datetime(frame["ts"]).to_numpy().astype("datetime64[ms]").astype("int64").tolist()
            told = zip(frame["seq"].astype("int64").tolist(), frame["kind"].tolist(), ms, *(_whole(frame[c]) for c in COUNTERS))
            new = [e for e in told if (e[2], e[0]) > (at, seq)]  # what was applied, or something after it, came before: a repetition
            if new:
                self.waiting.appendList(new)
                last = max([e[2] for e in new] + ([] if last is None else [last]))
        if last is not None:
            self.handle.registerTimer(last)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, state = expiredTimerInfo.getExpiryTimeInMs(), self._state()
        # Of a number that came repeatedly, the last stands.
        held = {e[0]: tuple(e) for e in self.waiting.get()}
        due = sorted((e for e in held.values() if e[2] <= until), key=lambda e: (e[2], e[0]))
        if due:
            for e in due:
                state = applied(state, e[0], e[1:])
            later = [e for e in held.values() if e[2] > until]
            self.waiting.put(later) if later else self.waiting.clear()
            self.now.update(state)
            yield pd.DataFrame([(key[0], *state)], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def statuses(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of (crawl_id, seq, ts, kind, counters) to the crawls' states (``OUTPUT``), a row whenever one changes.

    ``seq`` numbers the events of a crawl. They may come in any order and repeatedly: an event counts once, in order of
    time and number, when the watermark has passed it by ``delay``; what comes later than that is left out. A crawl is a
    key, so crawls are spread over the tasks; its state is one row and the events that wait. Needs :func:`with_store`.
    """
    return events.withWatermark("ts", delay).groupBy("crawl_id").transformWithStateInPandas(statefulProcessor=_Status(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


class with_store:
    """While it lasts, streams of the session keep their state in RocksDB, which these states need."""

    def __init__(self, spark):
        self.conf, self.key = spark.conf, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self):
        self.before = self.conf.get(self.key)
        self.conf.set(self.key, STORE)

    def __exit__(self, *_):
        self.conf.set(self.key, self.before)


def latest(states: DataFrame) -> DataFrame:
    """The last state of each crawl in a table of them: an aggregate that combines before its shuffle."""
    rest = [c for c in states.columns if c != "crawl_id"]
    return states.groupBy("crawl_id").agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("s")).select("crawl_id", "s.*")


def active(states: DataFrame) -> DataFrame:
    return latest(states).where(~F.col("status").isin(*ENDED))
