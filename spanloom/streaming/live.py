"""Streaming extension: windowed counts, and appending only what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, kind, n, total of values, in tumbling windows; late events are dropped after the watermark (in a stream)."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size), kind) if events.isStreaming else events.groupBy(F.window(time, size), kind)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def first_seen(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def append_scored(rows: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores all that is there and writes it as JSON lines, each batch to a folder of its own number; a restart goes on after the last committed batch.

    A batch that was written but not committed is written again to the same folder, so no row comes twice.
    """

    def put(d: DataFrame, batch: int) -> None:
        score(d).write.mode("overwrite").json(f"{path}/batch={batch}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
