"""Structured Streaming over feeds: exactly-once ingestion, windows, sessions, late data, incremental extraction.

Functions of a stream take any DataFrame, so the same plans run as batch. State is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources.sinks import VersionedTable


def volume_and_tone(items: DataFrame, ts: str, value: str, size: str, slide: str | None = None, by: list[str] | None = None, late: str = "1 hour") -> DataFrame:
    """start, end, the keys, number and mean by tumbling or sliding windows; rows later than `late` are dropped in a
    stream."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = items.withWatermark(ts, late).groupBy(w, *(by or [])).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), "n", "mean")


def sessions(items: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """key, start, end, n: runs of events no further apart than the gap."""
    g = items.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(items: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; a stream remembers keys for `late`."""
    if items.isStreaming:
        return items.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return items.dropDuplicates(keys)


def ingest(items: DataFrame, store: VersionedTable, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """All that is there, in one run; a batch that is replayed adds no key twice, as the store ignores known keys."""
    return items.writeStream.foreachBatch(lambda df, _: store.insert_ignore(df.select(*store.read().columns), keys, order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_new(items: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs an extraction over what came since the last run; the checkpoint is the cursor."""
    return extract(items).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Into a table of this name in memory: for tests and small aggregates only."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counted_late(items: DataFrame, ts: str, arrived: str, late: Column) -> DataFrame:
    """How many rows came later than allowed, by hour of arrival: a batch report on what a watermark would drop."""
    return items.groupBy(F.date_trunc("hour", arrived).alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col(arrived) - F.col(ts) > late).alias("late"))
