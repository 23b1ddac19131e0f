"""Following changes: a debounced stream of events that updates a versioned store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ferrograph.functions import naming

QUIET = "500 milliseconds"


def sessions(events: DataFrame, quiet: str = QUIET, watermark: str | None = None) -> DataFrame:
    """Bursts of events (root, path, ts) that are nowhere apart by ``quiet``: first and last time, number, and distinct relevant paths.

    In a stream a watermark lets finished bursts go; a burst is given out when later events have moved it on.
    """
    rows = events if watermark is None else events.withWatermark("ts", watermark)
    by = rows.filter(naming.relevant(F.col("path"))).groupBy("root", F.session_window("ts", quiet).alias("w"))
    burst = by.agg(F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths"))
    return burst.select("root", F.col("w.start").alias("first_ts"), F.col("w.end").alias("flush_ts"), "events", "paths")


class Debounce(StatefulProcessor):
    """Paths of a root are given out once no event has come for the quiet time, or the first has waited for the longest time."""

    def __init__(self, quiet_ms: int = 500, longest_ms: int = 10_000):
        self.quiet, self.longest = quiet_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "seen long")
        self.since = handle.getValueState("since", "first long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        now = timer_values.getCurrentProcessingTimeInMs()
        for batch in rows:
            for path in batch["path"]:
                self.paths.updateValue((path,), (now,))
        first = now
        if self.since.exists():
            first, timer = self.since.get()
            self.handle.deleteTimer(timer)
        due = min(now + self.quiet, first + self.longest)
        self.since.update((first, due))
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        paths = sorted(k[0] for k in self.paths.keys())
        self.paths.clear()
        self.since.clear()
        yield pd.DataFrame({"root": [key[0]], "paths": [paths]})

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_ms: int = 500, longest_ms: int = 10_000) -> DataFrame:
    """``(root, paths)`` by trailing debounce on the clock. events: a stream of (root, path)."""
    rows = events.filter(naming.relevant(F.col("path"))).select("root", "path")
    return rows.groupBy("root").transformWithStateInPandas(Debounce(quiet_ms, longest_ms), outputStructType="root string, paths array<string>", outputMode="Append", timeMode="ProcessingTime")


def watch(events: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = QUIET, once: bool = False) -> StreamingQuery:
    """Call ``update(paths, batch_id)`` with each micro-batch's distinct relevant paths; the query's stop() ends it.

    ``update`` must be the same for a batch that comes again; a store that takes the batch id as version is.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        paths = batch.filter(naming.relevant(F.col("path"))).select("path").distinct()
        if not paths.isEmpty():
            update(paths, batch_id)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=quiet)).start()
