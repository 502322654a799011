"""The status of feed items as a stream: transitions, tickets for what needs a person, and expiry by event time.

State is one row an item: its status, when its ticket expires and the last event that was applied. It is kept by the state
store, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: (status, action) -> status. An item begins with no status; what is not here is illegal and changes nothing.
TRANSITIONS = {
    (None, "discover"): "discovered",
    ("discovered", "fetched"): "ingested",
    ("discovered", "paywalled"): "needs_user",
    ("discovered", "failed"): "failed",
    ("failed", "fetched"): "ingested",
    ("failed", "paywalled"): "needs_user",
    ("failed", "failed"): "failed",
    ("needs_user", "resolved"): "ingested",
    ("needs_user", "dismissed"): "skipped",
}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUTPUT = "item {kind}, event_id bigint, ms bigint, action string, before string, after string, verdict string"


class StatusMachine(StatefulProcessor):
    """Events of an item, in the order of their time and id. verdict: applied, illegal, duplicate (a discovery of a known
    item), repeated (the event applied last, again), late (an earlier one) or expired (the ticket, by time alone)."""

    def __init__(self, transitions: dict[tuple[str | None, str], str], ticket: str, expires_ms: int, expired: str):
        self.transitions, self.ticket, self.expires_ms, self.expired = transitions, ticket, expires_ms, expired

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, deadline bigint, ms bigint, event_id bigint")

    def _now(self) -> list[Any]:
        s = self.state.get()
        return [None, None, None, None] if s is None else list(s)

    def _lapsed(self, key: Any, s: list[Any]) -> Row:
        before, at = s[0], s[1]
        s[0], s[1] = self.expired, None
        return Row(item=key, event_id=None, ms=at, action=None, before=before, after=s[0], verdict="expired")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # each call of the state or a timer is a round trip to the JVM, so an item takes two a batch, and those of a change
        s, item = self._now(), key[0]
        was = list(s)
        for e in sorted(rows, key=lambda r: (r["ms"], r["event_id"])):
            say = lambda after, verdict, e=e, before=s[0]: Row(item=item, event_id=e["event_id"], ms=e["ms"], action=e["action"], before=before, after=after, verdict=verdict)
            if s[2] is not None and (e["ms"], e["event_id"]) <= (s[2], s[3]):
                yield say(s[0], "repeated" if e["event_id"] == s[3] else "late")
                continue
            if s[1] is not None and e["ms"] >= s[1]:
                yield self._lapsed(item, s)
            before, after = s[0], self.transitions.get((s[0], e["action"]))
            s[2], s[3] = e["ms"], e["event_id"]
            if after is None:
                yield Row(item=item, event_id=e["event_id"], ms=e["ms"], action=e["action"], before=before, after=before, verdict="duplicate" if before and (None, e["action"]) in self.transitions else "illegal")
                continue
            s[0], s[1] = after, (e["ms"] + self.expires_ms if after == self.ticket else None)
            yield Row(item=item, event_id=e["event_id"], ms=e["ms"], action=e["action"], before=before, after=after, verdict="applied")
        if s[1] != was[1]:  # an item has one timer, that of its ticket
            if was[1] is not None:
                self.handle.deleteTimer(was[1])
            if s[1] is not None:
                self.handle.registerTimer(s[1])
        if s != was:
            self.state.update(tuple(s))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        s = self._now()
        if s[1] is not None and expiredTimerInfo.getExpiryTimeInMs() >= s[1]:
            yield self._lapsed(key[0], s)
            self.state.update(tuple(s))

    def close(self) -> None:
        pass


def statuses(events: DataFrame, item: str, event_id: str, ts: str, action: str, expires_ms: int = 14 * 86_400_000, late: str = "3 days", transitions: dict[tuple[str | None, str], str] | None = None, ticket: str = "needs_user", expired: str = "failed") -> DataFrame:
    """item, event_id, ms, action, before, after, verdict: what became of each event. ts is a timestamp. An item in the
    status `ticket` has a ticket, which expires if nothing ends that status in time. Events later than `late` behind
    the newest one may be dropped by the watermark before they are seen. Needs the RocksDB state store (`ROCKS`)."""
    rows = events.withWatermark(ts, late).select(ts, item, F.col(event_id).cast("bigint").alias("event_id"), F.unix_millis(ts).alias("ms"), F.col(action).alias("action"))
    machine = StatusMachine(TRANSITIONS if transitions is None else transitions, ticket, expires_ms, expired)
    return rows.groupBy(item).transformWithState(machine, OUTPUT.format(kind=dict(events.dtypes)[item]), "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within use the RocksDB state store."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def tickets(told: DataFrame) -> DataFrame:
    """item, opened, closed, outcome: tickets from what statuses() told. An item has one open ticket at most, so each is
    closed by the item's next row that leaves the status."""
    turns = told.filter("(verdict = 'applied' AND after = 'needs_user') OR (before = 'needs_user' AND after <> 'needs_user')")
    after = Window.partitionBy("item").orderBy("ms", "__opens")
    rows = turns.withColumn("__opens", F.col("after") == "needs_user")
    rows = rows.select("item", "__opens", F.col("ms").alias("opened"), F.lead("ms").over(after).alias("closed"), F.lead("after").over(after).alias("outcome"))
    return rows.filter("__opens").drop("__opens")
