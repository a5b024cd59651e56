"""Keyed streaming state of containers: which are followed, and how far their lines have been read.

Both are kept by (host_name, container_id) in the state of a stream, so that a batch touches only the containers it speaks of.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logloom.functions.timeutil import nanos

EVENTS_SCHEMA = "host_name string, container_id string, action string, name string, at timestamp"
#: Seconds of events that a collector sends again when it connects.
LOOKBACK_SECS = 60
ATTACH, DETACH = ("start", "restart"), ("die", "stop", "destroy")
TRANSITIONS = T.StructType([T.StructField("host_name", T.StringType()), T.StructField("container_id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("name", T.StringType()), T.StructField("at", T.TimestampType())])
KEY = ("host_name", "container_id")


#: What keyed state needs; without rows no batch is run, since otherwise the clock alone would run one after another.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """While it lasts, streams that are started can have keyed state, kept in RocksDB."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    try:
        for name, value in STATE_CONF.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Following(StatefulProcessor):
    """The state machine of one container.

    start and restart attach it if it is not; die, stop and destroy detach it if it is; rename of one that is attached detaches
    it and attaches it by its new name, and attaches one of which nothing is known. Other actions count for nothing. An event
    that is older than the last that counted, or that counted already at that time, was sent again and is left out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "attached boolean, name string, at long, actions string, gone boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.life.exists()
        attached, name, last, actions, gone = self.life.get() if known else (None, None, -(1 << 62), "", False)
        for r in sorted(rows, key=lambda r: r.at):
            if r.at < last or r.at == last and r.action in actions.split(","):
                continue
            actions = r.action if r.at > last else f"{actions},{r.action}"
            last, steps = r.at, []
            if r.action in ATTACH or r.action == "rename" and attached is None:
                steps = [] if attached else [True]
            elif r.action == "rename":
                steps = [False, True] if attached else []
            elif attached:
                steps = [False]
            for attached in steps:
                name = (r.name or name) if attached else name
                yield Row(host_name=key[0], container_id=key[1], state="attached" if attached else "detached", name=name, at=r.at)
            attached, gone = bool(attached), r.action == "destroy"
        self.life.update((attached, name, last, actions, gone))
        if gone:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 2 * LOOKBACK_SECS * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """A container that was destroyed, and of which no event can be sent again, is forgotten."""
        if self.life.exists() and self.life.get()[4]:
            self.life.clear()
        return iter([])


def transitions(events: DataFrame) -> DataFrame:
    """host_name, container_id, state (attached or detached), name, at: how a stream of events (EVENTS_SCHEMA) changes what is followed.

    Events without container, action or time are left out.
    """
    known = events.where(F.col("container_id").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(*ATTACH, *DETACH, "rename"))
    keyed = known.withColumns({"host_name": F.coalesce("host_name", F.lit("")), "at": F.unix_micros("at")}).select(*KEY, "action", "name", "at").groupBy(*KEY)
    kind = T.StructType([*TRANSITIONS.fields[:4], T.StructField("at", T.LongType())])
    return keyed.transformWithState(Following(), kind, "append", "ProcessingTime").withColumn("at", F.timestamp_micros("at"))


def follow(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Starts the stream of transitions; sink gets those of each batch, and its number, to write so that a replay changes nothing."""
    with keyed_state(events.sparkSession):
        writer = transitions(events).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Unread(StatefulProcessor):
    """Lets lines pass that are later than their container's checkpoint, which ends `ttl_ms` after its last line."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "nanos long", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.last.get()[0] if self.last.exists() else None
        latest = before
        for r in rows:
            fields = r.asDict()
            at = fields.pop("entry_nanos_")
            if at is None or before is None or at > before:
                latest = at if latest is None or at is not None and at > latest else latest
                yield Row(**fields)
        if latest is not None:
            self.last.update((latest,))


def unread(lines: DataFrame, ttl_ms: int) -> DataFrame:
    """Lines (host_name, container_id, timestamp and more) of a stream that are later than what batches before it held of their container.

    Lines whose time can't be read pass. A container that is silent for ttl_ms is forgotten, so ttl_ms is to exceed the time
    for which a collector may send lines again.
    """
    timed = lines.withColumn("entry_nanos_", nanos(F.col("timestamp")))
    return timed.groupBy(*KEY).transformWithState(Unread(ttl_ms), lines.schema, "append", "ProcessingTime")
