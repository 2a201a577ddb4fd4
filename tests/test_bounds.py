"""Streamed verdicts beside the batch form where sums are rounded: equal to the last bit, so levels at a bound agree."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyvoice.plans import sessions as session_plans
from tallyvoice.streaming import calls, monitor, sessions

PUSH = "call_id string, seq long, wave array<double>, eof boolean"


def pushed(n=60):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(n):
        sizes = rng.integers(1, 9, rng.integers(1, 8)) if c % 4 else [int(rng.integers(1, 4))]
        rows += [(f"c{c:02}", i, [float(x) for x in rng.integers(600, 9900, s) / 100], i == len(sizes) - 1) for i, s in enumerate(sizes)]
    return rows


def test_a_call_has_the_scores_of_the_batch_form(spark):
    rows, got, folds = pushed(), [], {}
    for call_id, seq, wave, eof in rows:
        call = folds.setdefault(call_id, calls.Call())
        for found, last in ((call.push(np.array(wave)), False), (call.end() if eof else None, True)):
            if found is not None:
                got.append((call_id, seq, last, found[3]))
    want = calls.verdicts(spark.createDataFrame(rows, PUSH)).select("call_id", "seq", "ended", "p").collect()
    assert len(want) > 100 and sorted(got) == sorted(map(tuple, want))


def test_a_session_has_the_scores_of_the_batch_form(spark):
    class State:
        exists = False
        update = staticmethod(lambda state: None)

    levels = [float(x) for x in [80.0] * 12 + list(np.random.default_rng(3).integers(600, 9900, 200) / 100)]
    rows = pd.DataFrame({"call_id": 1, "seq": range(len(levels)), "ts": pd.Timestamp("2024-01-01"), "p": levels})
    (got,) = sessions.folded((1,), iter([rows]), State())
    want = sessions.verdicts(spark.createDataFrame(rows)).orderBy("k").collect()
    assert list(got["p"]) == [r.p for r in want]


def test_a_listener_counts_the_levels_of_the_batch_form(spark):
    rows = spark.createDataFrame([("c", 0, [80.0] * 2, False), ("c", 1, [80.0] * 3, False)], PUSH)
    totals = monitor.Totals()
    spark.streams.addListener(totals)
    try:
        _, query, _ = calls.replay(spark, rows, files=2, shape=monitor.observed)
        sums = totals.wait(str(query.id))
    finally:
        spark.streams.removeListener(totals)
    (want,) = calls.verdicts(rows).collect()
    assert sums["rows"] == 1 and sums[want.level] == 1


def test_a_session_over_files_in_no_order(spark, tmp_path):
    rows = pd.DataFrame(
        {"event_id": range(60), "user_id": [k % 3 for k in range(60)], "event_type": "view", "value": [float(7 * k % 90 + 6) for k in range(60)]}
    )
    rows["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(rows["event_id"], unit="min")
    for part in (rows[40:], rows[20:40], rows[:20]):  # the latest chunks are in the first file
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got, want = (q(spark, str(tmp_path)).collect() for q in (session_plans.session_verdicts_stream, session_plans.session_verdicts_batch))
    assert len(want) == 57 and sorted(map(tuple, got)) == sorted(map(tuple, want))
