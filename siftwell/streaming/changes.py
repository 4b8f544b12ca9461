"""Live changes: a stream of file events keeps index and history in step."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.frecency import DAY_MS, MAX_DAYS, MAX_TOUCHES
from siftwell.operators.maintain import forget, refresh, status
from siftwell.operators.trigrams import Index
from siftwell.sources.ignore import Rule
from siftwell.sources.tree import keep

#: Tools whose events touch a path, and those that also change it.
READING, WRITING = ("read", "open"), ("write", "edit", "create")


def last_of_each(batch: DataFrame) -> DataFrame:
    """The last event of every path: what a debounced watcher acts on. Ties: a removal wins."""
    order = Window.partitionBy("path").orderBy(F.desc("at_ms"), F.desc(F.col("op") == "remove"))
    return batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def apply_changes(index: Index, files: DataFrame, batch: DataFrame, rules: list[Rule] = ()) -> tuple[Index, DataFrame]:
    """Index and files after a batch of events (path, op: upsert or remove, at_ms, and for upserts
    file_id, size, mtime_ms, content), under the rules a scan has."""
    events = last_of_each(batch)
    removed, written = events.where("op = 'remove'").select("path"), keep(events.where("op = 'upsert'"), rules)
    index, files = forget(index, files, removed)
    return refresh(index, files, written.select("file_id", "path", "size", "mtime_ms", "content", F.lit(True).alias("alive")))


def watch(events: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Runs `act` on each batch of a stream of events, at most once an interval (the debounce). The
    batch id lets `act` skip a batch that it has already applied."""
    writer = events.writeStream.foreachBatch(lambda batch, number: act(last_of_each(batch), number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def tree_events(known: DataFrame, files: DataFrame, at_ms: int) -> DataFrame:
    """What a watcher would have told since `known`: path, op (upsert or remove), at_ms of every file
    that a new listing shows as created, changed, revived or gone."""
    diff = status(known, files).where("status <> 'same'")
    return diff.select("path", F.when(F.col("status") == "gone", "remove").otherwise("upsert").alias("op"), F.lit(at_ms).cast("long").alias("at_ms"))


def watch_tree(engine, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Keeps an engine in step with its tree: at most once an interval the tree is listed and what
    changed is taken in. Spark's file sources tell of no removals, so the listing is compared."""
    ticks = engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, number: engine.reconcile() and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def route(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool events (tool, path, at_ms) as touches of what was read or written, and refreshes of what was written."""
    live = events.where("path is not null and path <> ''")
    return live.where(F.col("tool").isin(*READING, *WRITING)).select("path", "at_ms"), live.where(F.col("tool").isin(*WRITING)).select("path", "at_ms", F.lit("upsert").alias("op"))


def touch_history(touches: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of touches (path, at timestamp) as path, times: after every batch, the last touches
    of each path that came in it, none older than the retention. State holds at most 128 numbers a
    path and is dropped when its newest touch is too old."""

    def update(key, batches, state):
        kept = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        for part in batches:
            kept += [int(t.value // 1_000_000) for t in part["at"]]
        newest = max(kept)
        kept = [t for t in kept if t >= newest - MAX_DAYS * DAY_MS][-MAX_TOUCHES:]
        state.update((kept,))
        state.setTimeoutTimestamp(max(newest + MAX_DAYS * DAY_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"path": [key[0]], "times": [kept]})

    return touches.withWatermark("at", late).groupBy("path").applyInPandasWithState(update, "path string, times array<bigint>", "times array<bigint>", "update", "EventTimeTimeout")


def touches_per_window(touches: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """How often each path was touched a window; windows close when the watermark passes them."""
    return touches.withWatermark("at", late).groupBy(F.window("at", width), "path").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "path", "n")
