"""Levels beyond full scale, and ones that round to zero, against SQL."""

import duckdb
import pandas as pd
import pytest

from tallyvoice.plans import records, sessions


@pytest.fixture(scope="module")
def loud(spark, tmp_path_factory):
    """A call with levels above full scale (500) within and outside of the slice, a quiet one, one of sines near 1."""
    levels = {1: [560.21 if k in (3, 22) else 1e9 if k == 30 else float(k) for k in range(60)], 2: [10.0] * 50, 3: [1.5708] * 8 + [0.5] * 8}
    rows = [(u, v) for u, values in levels.items() for v in values]
    frame = pd.DataFrame({"event_id": range(len(rows)), "user_id": [u for u, _ in rows], "event_type": "view", "value": [v for _, v in rows]})
    frame["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(frame["event_id"], unit="s")
    at = str(tmp_path_factory.mktemp("loud"))
    spark.createDataFrame(frame).write.parquet(f"{at}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{at}/events.parquet/*.parquet'")
    return at, db


@pytest.mark.parametrize("name", ["nested_audio", "slice_reads"])
def test_levels_beyond_full_scale(spark, loud, name):
    at, db = loud
    query, sql = records.ENTRIES[name]
    got = sorted(tuple(r) for r in query(spark, at).select("call_id", "samples", "total").collect())
    assert got == sorted(db.sql(f"SELECT call_id, samples, total FROM ({sql})").fetchall())


def test_a_level_that_rounds_to_zero_keeps_its_sign(spark, loud):
    at, db = loud
    query, sql = sessions.ENTRIES["frame_db_bounds"]
    got = sorted((r.call_id, str(r.loudest)) for r in query(spark, at).collect())
    assert got == sorted((c, str(x)) for c, x in db.sql(f"SELECT call_id, loudest FROM ({sql})").fetchall())
    assert dict(got)[3] == "-0.0"


def test_calls_without_a_loud_frame(spark, tmp_path):
    """Quiet calls, ones shorter than a frame, null levels and a null call: all columns as in SQL."""
    levels = {1: [0.1] * 9, 2: [0.1] * 3, 3: [0.1] * 4 + [1.5] * 8, 4: [None] * 8, 5: [None, 1.5, 1.5, 1.5, 0.1], 6: [1.5] * 4 + [None] * 4, None: [1.5] * 9}
    rows = [(u, v) for u, values in levels.items() for v in values]
    rows = [(k, u, "view", v) for k, (u, v) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    frame.selectExpr("*", "timestamp_seconds(event_id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    query, sql = sessions.ENTRIES["frame_db_bounds"]
    want = db.sql(f"SELECT call_id, frames, loudest, start, \"end\" FROM ({sql})").fetchall()
    assert sorted(map(str, map(tuple, query(spark, str(tmp_path)).collect()))) == sorted(map(str, want)) and len(want) == 7
