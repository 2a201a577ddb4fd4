"""Call sessions: chunks of a call become window scores, rolling verdicts and a final one.

The rules, in chunks: a call starts at its first chunk above ``GATE`` (earlier ones are skipped); each
chunk from the second on completes a window of two chunks, whose score is their mean level; a verdict
is the mean of the last ``RECENT`` windows; from ``FINAL_AT`` chunks on verdicts are final.

``verdicts`` is the batch form. ``stream_verdicts`` is the same as a keyed stateful stream: the chunks of a
micro-batch are put in order inside the state function, later ones have to come in later micro-batches;
state is bounded (one level and the recent scores), calls that stay silent for ``IDLE_MS`` of processing
time are dropped without a verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

GATE, SCALE, RECENT, FINAL_AT = 5.0, 100.0, 9, 10
HIGH, MEDIUM = 0.8, 0.5
IDLE_MS = 30_000


def with_level(rows: DataFrame) -> DataFrame:
    p = F.col("p")
    return rows.withColumn("level", F.when(p >= HIGH, "high").when(p >= MEDIUM, "medium").otherwise("low"))


def running_mean(values: Sequence[float]) -> float:
    """The mean as Spark's and SQL's avg take it, term by term, so that a level at a bound is the same to the last bit."""
    return float(np.cumsum(values)[-1]) / len(values)


def verdicts(chunks: DataFrame) -> DataFrame:
    """call_id, k (chunks since onset), p, final, level: one row per completed window."""
    order = Window.partitionBy("call_id").orderBy("ts", "seq")
    onset = F.max((F.col("p") > GATE).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    heard = chunks.withColumn("on", onset).where("on = 1").withColumn("k", F.row_number().over(order))
    heard = heard.withColumn("w", (F.col("p") + F.lag("p").over(order)) / 2 / SCALE).where("w is not null")
    mean = F.avg("w").over(order.rowsBetween(1 - RECENT, 0))
    rows = heard.select("call_id", F.col("k").cast("long").alias("k"), mean.alias("p"), (F.col("k") >= FINAL_AT).alias("final"))
    return with_level(rows)


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """``folded`` for live streams: a call that stays silent is dropped without a verdict."""
    if state.hasTimedOut:
        state.remove()
        return
    yield from folded(key, batches, state)
    state.setTimeoutDuration(IDLE_MS)


def folded(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One call's new chunks, in order, onto its state (k, last level, recent window scores)."""
    k, last, recent = state.get if state.exists else (0, 0.0, [])
    recent = list(recent)
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
    out = []
    for level in rows["p"]:
        if k == 0 and not level > GATE:
            continue
        k += 1
        if k > 1:
            recent = [*recent, (level + last) / 2 / SCALE][-RECENT:]
            out.append((key[0], k, running_mean(recent), k >= FINAL_AT))
        last = float(level)
    state.update((k, last, recent))
    if out:
        yield pd.DataFrame(out, columns=["call_id", "k", "p", "final"])


def stream_verdicts(chunks: DataFrame, live: bool = True) -> DataFrame:
    """The verdicts of a streaming DataFrame of chunks; a replay (not live) has no idle timeout and so ends."""
    found = chunks.groupBy("call_id").applyInPandasWithState(
        fold if live else folded, "call_id long, k long, p double, final boolean", "k long, last double, recent array<double>",
        "append", GroupStateTimeout.ProcessingTimeTimeout if live else GroupStateTimeout.NoTimeout,
    )
    return with_level(found)


#: The verdicts in SQL, over the view of chunks.
SQL = f"""chunks AS (SELECT user_id AS call_id, event_id AS seq, ts, value AS p FROM events),
 o AS (SELECT *, max((p > {GATE})::INT) OVER (PARTITION BY call_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS live FROM chunks),
 h AS (SELECT call_id, seq, ts, p, row_number() OVER (PARTITION BY call_id ORDER BY ts, seq) AS k, lag(p) OVER (PARTITION BY call_id ORDER BY ts, seq) AS before FROM o WHERE live = 1),
 w AS (SELECT call_id, k, (p + before) / 2 / {SCALE} AS w FROM h WHERE before IS NOT NULL),
 v AS (SELECT call_id, k, avg(w) OVER (PARTITION BY call_id ORDER BY k ROWS BETWEEN {RECENT - 1} PRECEDING AND CURRENT ROW) AS p FROM w),
 verdicts AS (SELECT call_id, k, p, k >= {FINAL_AT} AS final, CASE WHEN p >= {HIGH} THEN 'high' WHEN p >= {MEDIUM} THEN 'medium' ELSE 'low' END AS level FROM v)"""
