"""Timed upkeep inside the driver of the streams: the storage budget, the retention, merges and files that nothing names.

A rate stream is the timer, so that upkeep runs one at a time and ends with the other streams; it holds no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from logloom.settings import Settings
from logloom.streaming.store import LogStore

PURGE_SECS = 3600


def purge(store: LogStore, settings: Settings) -> dict:
    """The retention, and what no version names any more."""
    done = {"purged": store.purge(settings.cutoff())}
    store.vacuum()
    return done


def budget(store: LogStore, settings: Settings) -> dict:
    outcome = store.enforce(settings.budget)
    return {"deleted": outcome.deleted, "write_blocked": outcome.write_blocked}


def compact(store: LogStore, settings: Settings) -> dict:
    return {"merged": store.compact()}


class Upkeep:
    """Does what is due: the budget at the start and then every interval_secs, merges as often, the retention every hour."""

    def __init__(self, store: LogStore, settings: Settings, clock: Callable[[], float] = time.monotonic):
        self.store, self.settings, self.clock = store, settings, clock
        often = settings.budget.interval_secs
        begun = clock()
        self.due = {budget: begun, compact: begun + often, purge: begun + PURGE_SECS}
        self.every = {budget: often, compact: often, purge: PURGE_SECS}

    def run(self) -> dict:
        """What was due and done; a piece that took longer than its interval is not made up for."""
        done: dict = {}
        for piece, at in list(self.due.items()):
            if self.clock() >= at:
                done |= piece(self.store, self.settings)
                self.due[piece] = self.clock() + self.every[piece]
        return done


def keep_up(store: LogStore, settings: Settings, checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Starts the upkeep stream beside the streams that write to the store."""
    upkeep = Upkeep(store, settings)
    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, n: upkeep.run() and None).option("checkpointLocation", checkpoint).queryName("upkeep").trigger(processingTime=every).start()
