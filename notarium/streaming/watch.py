"""Keeping the store fresh: a schedule with a clock that can be set, and file streams.

A file stream reports new paths only; changed and deleted files come from comparing listings. So new files can be streamed,
and the rest is a batch on its own, slower beat.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Beat:
    """When each kind of work is due; a due time that has passed is set anew from now."""

    new_files: float = 600.0
    changed: float = 86_400.0
    pending: float = 300.0
    due: dict[str, float] = field(default_factory=dict)

    def start(self, now: float, at_once: bool = True) -> None:
        self.due = {"pending": now, "new_files": now if at_once else now + self.new_files, "changed": now if at_once else now + self.changed}

    def take(self, now: float) -> list[str]:
        """Kinds of work that are due, in the order in which they run."""
        ready = [k for k in ("new_files", "changed", "pending") if self.due.get(k, now) <= now]
        for k in ready:
            self.due[k] = now + getattr(self, k)
        return ready


def watch(
    work: dict[str, Callable[[], int]],
    beat: Beat,
    poll: float = 2.0,
    once: bool = False,
    initial: bool = True,
    loops: int | None = None,
    stopped: Callable[[], bool] = lambda: False,
    clock: Callable[[], float] = time.monotonic,
    sleep: Callable[[float], None] = time.sleep,
) -> dict[str, int]:
    """Run the work that is due until stopped; the counts per kind. An error in one kind is counted and does not end the rest."""
    totals = {k: 0 for k in work} | {"errors": 0, "loops": 0}
    beat.start(clock(), at_once=initial)
    while not stopped():
        for kind in beat.take(clock()):
            if kind in work:
                try:
                    totals[kind] += work[kind]()
                except Exception:
                    totals["errors"] += 1
        totals["loops"] += 1
        if once or (loops is not None and totals["loops"] >= loops):
            break
        sleep(poll)
    return totals


def drain(next_batch: Callable[[], int], most: int = 4) -> int:
    """Take batches until one is empty or `most` are done; the rows taken."""
    total = 0
    for _ in range(most):
        n = next_batch()
        total += n
        if not n:
            break
    return total


def stream_new_files(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*.md", per_trigger: int = 1000) -> StreamingQuery:
    """Stream files that appear under root into handle(batch, batch_id); every file comes once, also after a restart."""
    source = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_trigger)
        .load(root)
    )
    return (
        source.select("path", "modificationTime", "length", F.decode("content", "UTF-8").alias("text"))
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, begin, end, events, value): sessions of events with no gap longer than `gap`.

    Works on streams, with rows later than `late` left out, and on tables.
    """
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        own.groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
        .select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events", "value")
    )


def status_rows(spark: SparkSession) -> DataFrame:
    """(name, id, batch, input_rows, message): state of the session's running streams."""
    rows = []
    for q in spark.streams.active:
        last = q.lastProgress or {}
        rows.append((q.name, str(q.id), int(last.get("batchId", -1)), int(last.get("numInputRows", 0)), q.status["message"]))
    return spark.createDataFrame(rows, "name string, id string, batch bigint, input_rows bigint, message string")
