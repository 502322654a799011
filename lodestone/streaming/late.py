"""Rows that come too late for a stream: counted from its progress, and kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.streaming.feeds import once


def dropped_rows(query: StreamingQuery) -> int:
    """The rows that watermarks have dropped, by the progress of a query that has ended."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def run_once(items: DataFrame, keys: list[str], ts: str, late: str, out: str, checkpoint: str) -> int:
    """Runs over what came since the last run and writes the first row of each key to `out`; rows that are further behind the
    newest row of earlier batches than `late` are dropped. The number of those. A folder of `out` and the checkpoint
    belong together: a restarted run writes no row twice."""
    rows = once(items, keys, ts, late)
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return dropped_rows(q)


def set_aside(delivered: DataFrame, out: DataFrame, keys: list[str], counted: int | None = None) -> DataFrame:
    """The delivered rows whose key never came out. counted: what the progress says; raises if it is another number."""
    late = delivered.join(out.select(*keys), keys, "left_anti")
    if counted is not None and (n := late.count()) != counted:
        raise RuntimeError(f"{n} rows are missing, and {counted} were dropped by the watermark")
    return late
