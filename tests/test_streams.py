"""Calls by pushes, live timers, deliveries behind a watermark, tables written once, and what a listener counts."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyvoice.plans import streams
from tallyvoice.streaming import calls, delivery, monitor

PUSH = "call_id string, seq long, wave array<double>, eof boolean"


def test_one_verdict_a_push_and_a_last_one():
    call = calls.Call()
    assert call.push(np.array([1.0, 2.0])) is None and call.end() is None  # silence
    total, segments, skipped, p, final = call.push(np.array([3.0, 50.0, 60.0, 70.0, 80.0, 90.0]))
    # onset at the 4th sample, one sample of margin kept: two windows complete, one verdict
    assert (total, segments, skipped, final) == (6, 2, 2, False)
    assert p == pytest.approx(0.7 * np.mean([3, 50, 60, 70, 80, 90]) / 100 + 0.3 * (np.mean([3, 50, 60, 70]) + np.mean([60, 70, 80, 90])) / 200)
    assert call.push(np.array([100.0])) is None  # no window completes
    assert call.end()[0] == 7 and call.end()[4]
    assert call.push(np.ones(3))[4]  # ten samples: final
    long = calls.Call()
    for _ in range(50):
        last = long.push(np.full(7, 40.0))
    assert last[1] == calls.RECENT and len(long.buffer) <= calls.WINDOW + calls.SEG and last[3] == pytest.approx(0.4)


def test_a_short_call_is_repeated_to_fill_a_window():
    call = calls.Call()
    assert call.push(np.array([10.0, 20.0, 30.0])) is None
    total, segments, _, p, final = call.end()
    assert (total, segments, final) == (3, 1, True) and p == pytest.approx((10 + 20 + 30 + 10) / 4 / 100)


def cut(wave, sizes, call="c", eof=True):
    ends = np.cumsum(sizes)
    return [(call, i, [float(x) for x in wave[e - s : e]], eof and i == len(sizes) - 1) for i, (s, e) in enumerate(zip(sizes, ends, strict=True))]


def test_stream_equals_batch_with_repeats_gaps_and_silence(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(40):
        sizes = rng.integers(1, 6, rng.integers(1, 9))
        rows += cut(rng.uniform(0, 6 if n % 5 == 0 else 90, sizes.sum()), sizes, f"c{n}", n % 3 > 0)
    rows += cut([0.0, 1.0], [1, 1], "silent") + cut([9.0], [1], "one") + cut(np.arange(20.0), [20], "whole")
    frame = spark.createDataFrame(rows, PUSH)
    want = sorted(tuple(r) for r in calls.verdicts(frame).withColumn("p", F.round("p", 9)).collect())
    assert {r[0] for r in want} >= {"one", "whole"} and "silent" not in {r[0] for r in want}
    late = frame.union(frame.where("seq % 2 = 0 AND NOT eof"))  # a repeat may come in any micro-batch
    late = late.where("NOT (seq = 0 AND call_id LIKE '%0')").union(frame.where("seq = 0 AND call_id LIKE '%0'"))
    got, query, _ = calls.replay(spark, late, files=5, files_a_batch=1)
    after_end = [r for r in got.withColumn("p", F.round("p", 9)).collect()]
    assert sorted(tuple(r) for r in after_end) == want and query.exception() is None


class Held:
    """A list and a map state, and how often they were asked."""

    def __init__(self):
        self.rows, self.map, self.asked = [], {}, 0

    def __getattr__(self, name):
        self.asked += 1
        return {
            "exists": lambda: bool(self.rows), "get": lambda: iter(self.rows), "put": lambda rows: setattr(self, "rows", rows), "clear": self.rows.clear,
            "updateValue": self.map.__setitem__, "getValue": self.map.get, "removeKey": self.map.pop,
        }[name]


def test_a_slot_of_many_calls_asks_its_state_a_few_times():
    processor = calls.CallProcessor(None)
    processor.calls, processor.waiting = Held(), Held()
    rows = [row for n in range(300) for row in cut(np.full(9, 60.0), [3] * 3, f"c{n}")]
    rows += cut(np.full(300, 60.0), [100] * 3, "long") + cut(np.full(6, 60.0), [3] * 2, "open", False)
    send = lambda some: [r for f in processor.handleInputRows((0,), iter([pd.DataFrame(some, columns=["call_id", "seq", "wave", "eof"])]), None) for r in f.itertuples()]
    assert send([r for r in rows if r[1] > 0]) == []  # all wait for their first push
    assert len(processor.calls.rows) == 302 and set(processor.waiting.map) == {("long", 1), ("long", 2)}
    got = send([r for r in rows if r[1] == 0])
    assert sum(r.ended for r in got) == 301 and [r[0] for r in processor.calls.rows] == ["open"] and not processor.waiting.map
    assert processor.calls.asked <= 6 and processor.waiting.asked <= 6


def test_idle_call_is_dropped_by_its_timer(spark, tmp_path):
    def send(name, rows):
        spark.createDataFrame(rows, PUSH).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    send("a", [("idle", 0, [50.0] * 5, False), ("busy", 0, [50.0] * 5, False)])
    stream = spark.readStream.schema(PUSH).parquet(str(tmp_path / "in" / "*"))
    with calls.stateful(spark):
        query = (
            calls.stream_verdicts(stream, idle_ms=2000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(processingTime="300 milliseconds").start(str(tmp_path / "out"))
        )
    try:
        def state():
            last = query.lastProgress
            return last and last["stateOperators"] and last["stateOperators"][0]["numRowsTotal"]

        def wait_for(holds):
            for _ in range(200):
                if holds():
                    return
                time.sleep(0.2)
            raise AssertionError((query.status, state(), query.exception()))

        wait_for(lambda: state())
        wait_for(lambda: state() == 0)  # both timers have run out
        send("b", [("busy", 1, [50.0] * 5, True)])  # its state is gone: it waits for a push 0 and gives nothing
        wait_for(lambda: state())
        wait_for(lambda: state() == 0)
    finally:
        query.stop()
    assert sorted((r.call_id, r.ended) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("busy", False), ("idle", False)]


def test_watermark_drops_state_and_repeats(spark, tmp_path):
    def day(n, copies):
        rows = spark.range(200).select((F.col("id") + 200 * n).alias("k"), F.timestamp_seconds(F.lit(86400 * (n + 1000)) + F.col("id")).alias("ts"))
        return rows.withColumn("copy", F.explode(F.array(*[F.lit(c) for c in range(copies)])))

    kept = lambda s: delivery.first_deliveries(s, ["k"], "ts", "1 hour")
    # the second run brings the first one's keys again, at the same event times
    rows, ran = delivery.replayed(spark, [day(0, 2), day(0, 3), day(1, 1), day(2, 1), day(3, 1)], kept, str(tmp_path))
    assert rows.count() == 800 == rows.select("k").distinct().count()
    held = [q.lastProgress["stateOperators"][0]["numRowsTotal"] for q in ran]
    assert held[0] == held[1] == 200 and max(held[2:]) <= 400  # older days are dropped, the table has 800 keys


def test_append_once_replaces_what_broke_off(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5)
    assert delivery.append_once(rows, 0, path) and not delivery.append_once(spark.range(9), 0, path)
    (tmp_path / "t" / "batch=1").mkdir()
    (tmp_path / "t" / "batch=1" / "part-0.parquet").write_bytes(b"half")  # no mark that it is whole
    assert delivery.append_once(rows, 1, path)
    assert sorted(map(tuple, spark.read.parquet(path).groupBy("batch").count().collect())) == [(0, 5), (1, 5)]


def test_listener_counts_and_reports_failure(spark, tmp_path):
    totals = monitor.Totals()
    spark.streams.addListener(totals)
    try:
        rows = spark.createDataFrame(cut(np.full(30, 60.0), [3] * 10), PUSH)
        got, query, _ = calls.replay(spark, rows, 3, 1, monitor.observed)
        sums = totals.wait(str(query.id))
        assert sums["rows"] == got.count() and sums["ended"] == 1 and sums["medium"] == sums["rows"] and totals.batches[str(query.id)] >= 3
        rows.write.parquet(str(tmp_path / "in"))
        broken = spark.readStream.schema(PUSH).parquet(str(tmp_path / "in")).select(F.raise_error(F.lit("broken push")).alias("x"))
        query = broken.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        with pytest.raises(Exception, match="broken push"):
            query.awaitTermination()
        totals.wait(str(query.id))
        assert "broken push" in totals.errors[str(query.id)]
    finally:
        spark.streams.removeListener(totals)


def test_totals_where_all_calls_have_ended_in_silence(spark, tmp_path):
    """No verdict and no open call: the counts are 0, as in SQL, and no level is named."""
    rows = pd.DataFrame({"event_id": range(6), "user_id": range(6), "event_type": "error", "value": 1.0})
    rows["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rows["event_id"], unit="min")
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(streams.ENTRIES["stream_totals"][1]).fetchall()
    assert ("open", 0) in want and sorted(map(tuple, streams.stream_totals(spark, str(tmp_path)).collect())) == sorted(want)


def test_totals_of_open_calls_that_share_slots(spark, tmp_path, monkeypatch):
    """Each open call is a row of its slot's state, also one without speech or with pushes that wait."""
    monkeypatch.setattr(calls, "SLOTS", 2)
    rows = pd.DataFrame({"event_id": range(240), "user_id": [k % 30 for k in range(240)], "value": [float(7 * k % 90 + 6) if k % 30 else 1.0 for k in range(240)]})
    rows["event_type"] = ["error" if k % 11 == 0 else "view" for k in range(240)]
    rows["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rows["event_id"], unit="min")
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.sql(streams.ENTRIES["stream_totals"][1]).fetchall()
    assert dict(want)["open"] > 20 and sorted(map(tuple, streams.stream_totals(spark, str(tmp_path)).collect())) == sorted(want)
