import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import paged
from lodestone.streaming import late, status

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def deliver(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_statuses_over_restarts(spark, tmp_path):
    schema = "item long, event_id long, ts timestamp, action string"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    batches = [
        [(1, 1, at(0), "discover"), (1, 2, at(1), "paywalled"), (2, 3, at(1), "fetched"), (3, 4, at(2), "discover"), (3, 5, at(3), "paywalled")],
        [(1, 1, at(0), "discover"), (1, 2, at(1), "paywalled"), (2, 6, at(4), "discover"), (2, 7, at(5), "failed"), (2, 8, at(6), "fetched"), (3, 9, at(8), "resolved")],
        [(2, 10, at(9), "discover"), (4, 11, at(200), "discover")],  # time goes on: the ticket of 1 expires
        [(1, 12, at(201), "fetched"), (4, 13, at(202), "paywalled"), (4, 14, at(300), "resolved")],
    ]
    with status.rocks(spark):
        for rows in batches:
            deliver(spark, src, rows, schema)
            told = status.statuses(spark.readStream.schema(schema).parquet(src), "item", "event_id", "ts", "action", expires_ms=50 * 3_600_000, late="24 hours")
            told.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(out)
    got = sorted(((r.item, r.event_id or 0, r.before, r.after, r.verdict) for r in told.collect()), key=str)
    assert got == sorted(
        [
            (1, 1, None, "discovered", "applied"), (1, 2, "discovered", "needs_user", "applied"), (1, 1, "needs_user", "needs_user", "late"), (1, 2, "needs_user", "needs_user", "repeated"),
            (1, 0, "needs_user", "failed", "expired"), (1, 12, "failed", "ingested", "applied"),
            (2, 3, None, None, "illegal"), (2, 6, None, "discovered", "applied"), (2, 7, "discovered", "failed", "applied"), (2, 8, "failed", "ingested", "applied"), (2, 10, "ingested", "ingested", "duplicate"),
            (3, 4, None, "discovered", "applied"), (3, 5, "discovered", "needs_user", "applied"), (3, 9, "needs_user", "ingested", "applied"),
            (4, 11, None, "discovered", "applied"), (4, 13, "discovered", "needs_user", "applied"), (4, 0, "needs_user", "failed", "expired"), (4, 14, "failed", "failed", "illegal"),
        ],
        key=str,
    )
    hours = lambda ms: round((ms / 1000 - T0.replace(tzinfo=dt.UTC).timestamp()) / 3600)
    assert sorted((r.item, hours(r.opened), hours(r.closed), r.outcome) for r in status.tickets(told).collect()) == [(1, 1, 51, "failed"), (3, 3, 8, "ingested"), (4, 202, 252, "failed")]


def test_late_rows_are_counted_and_set_aside(spark, tmp_path):
    schema = "k long, ts timestamp"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    deliver(spark, src, [(1, at(0)), (2, at(10)), (2, at(10))], schema)
    assert late.run_once(stream(), ["k"], "ts", "2 hours", out, ck) == 0
    deliver(spark, src, [(3, at(7)), (4, at(9)), (5, at(20)), (6, at(1))], schema)
    n = late.run_once(stream(), ["k"], "ts", "2 hours", out, ck)
    kept, every = spark.read.parquet(out), spark.read.schema(schema).parquet(src)
    assert sorted(r.k for r in kept.collect()) == [1, 2, 4, 5]
    assert sorted(r.k for r in late.set_aside(every, kept, ["k"], n).collect()) == [3, 6] and n == 2
    with pytest.raises(RuntimeError):
        late.set_aside(every, kept, ["k"], 1)
    assert late.run_once(stream(), ["k"], "ts", "2 hours", out, ck) == 0  # nothing came, nothing is written again
    assert spark.read.parquet(out).count() == 4


def test_pages_are_read_once_over_stops_and_failures(spark, tmp_path):
    path, out, ck = (str(tmp_path / x) for x in ("pages", "out", "ck"))
    spark.dataSource.register(paged.PagedFeed)
    items = spark.range(25).select("id", F.concat(F.lit("t"), "id").alias("title"))
    page = F.floor(F.col("id") / 5)
    put = lambda cond: paged.write_pages(items.filter(cond), page, {"id": F.col("id").cast("string"), "title": F.col("title")}, path)

    def run():
        df = spark.readStream.format("paged_feed").option("path", path).option("kind", "works").option("source", "s").load()
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r.external_id) for r in spark.read.parquet(out).collect())

    put("id < 10")
    assert run() == list(range(10)) and run() == list(range(10))
    put("id >= 15 AND id < 20")  # a page is missing before it: it waits
    assert run() == list(range(10))
    (tmp_path / "pages" / "page=2").mkdir()
    broken = tmp_path / "pages" / "page=2" / "part-0.txt"
    broken.write_text('{"results": [')
    with pytest.raises(Exception):
        run()
    broken.write_text(json.dumps({"results": [{"id": str(i), "title": "x"} for i in range(10, 15)]}))
    assert run() == list(range(20))
    put("id >= 20")
    assert run() == list(range(25))
    whole = spark.read.format("paged_feed").option("path", path).option("kind", "works").load()
    assert whole.count() == 25 and whole.rdd.getNumPartitions() == 5


def test_a_partition_reads_some_pages(tmp_path):
    """The number of partitions is bounded, and they hold every page once, in order."""
    from lodestone.sources import paged

    reader = paged._Stream({"path": str(tmp_path)})
    for n in (0, 1, 63, 64, 65, 10_000):
        parts = reader.partitions({"page": 5}, {"page": 5 + n})
        assert len(parts) <= paged.PARTITIONS and [x for p in parts for x in p.numbers] == list(range(5, 5 + n))


def test_status_machine_asks_little_of_its_state():
    """An item's batch reads the state once and writes it once if it changed; its one timer follows its ticket."""
    calls, timers = [], set()

    class State:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            calls.append("register")
            timers.add(at)

        def deleteTimer(self, at):
            calls.append("delete")
            timers.remove(at)

    m = status.StatusMachine(status.TRANSITIONS, "needs_user", 50, "failed")
    m.init(Handle())
    run = lambda *rows: [x["verdict"] for x in m.handleInputRows((7,), iter([{"event_id": i, "ms": ms, "action": a} for i, ms, a in rows]), None)]
    assert run((1, 10, "discover"), (2, 20, "failed"), (3, 30, "paywalled"), (4, 40, "resolved"), (5, 50, "resolved")) == ["applied"] * 4 + ["illegal"]
    assert calls == ["get", "update"] and not timers
    assert run((5, 50, "resolved"), (2, 20, "failed")) == ["late", "repeated"] and calls[2:] == ["get"]
    m.state.value = None
    assert run((1, 10, "discover"), (2, 20, "paywalled")) == ["applied", "applied"] and timers == {70}
    assert run((3, 80, "paywalled")) == ["expired", "applied"] and timers == {130}
    assert run((4, 90, "dismissed")) == ["applied"] and not timers
