"""Calls pushed as arrays of samples: one verdict a push, a last one at the end of the call.

The rules, in samples:

* Speech starts at the first sample above ``GATE``; ``MARGIN`` samples before it are kept, earlier ones
  are counted as skipped. All places count from the first kept sample.
* Every ``HOP`` samples a window of ``SEG`` completes; its score is its mean level. A push that completes
  windows, one or several, gives one verdict: the mean score of the last ``RECENT`` windows and the mean
  level of the last ``WINDOW`` samples, weighed.
* A verdict is final from ``WINDOW`` samples on. The end mark of a call gives a final verdict of its own;
  a call that is shorter than a window is repeated to fill one. A call without speech has no verdict.

``verdicts`` is the batch form; ``stream_verdicts`` the same with a stateful processor per slot of calls. Pushes
carry running numbers from 0: the processor drops repeats and holds a push that comes before its turn,
in the same or an earlier micro-batch, until the gap is filled. The end mark clears the call's state; a live
call that stays silent for ``idle_ms`` of processing time is dropped without a verdict by a timer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.window import Window

from ..sources.folders import shared_folder
from .sessions import running_mean, with_level

SEG, HOP, WINDOW, GATE, MARGIN, SCALE = 4, 2, 10, 5.0, 1, 100.0
RECENT = (WINDOW - SEG) // HOP + 1
WHOLE, PART = 0.7, 0.3
IDLE_MS = 30_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: ended: the verdict of the end mark; audio: samples of speech; segments: windows that it rests on.
OUT = "call_id string, seq long, ended boolean, audio long, segments int, skipped long, p double, final boolean"
KEPT = "expected long, total long, skipped long, speech boolean, start long, buffer array<double>, scores array<double>"
AHEAD = "struct<seq:bigint,wave:array<double>,eof:boolean>"
#: Samples of a push that may wait in the row of its call.
SHORT = 64
#: Calls are dealt to so many groups of the stream by the hash of their id; a running stream keeps its number.
SLOTS = 1 << 10
COLUMNS = ["call_id", "seq", "ended", "audio", "segments", "skipped", "p", "final"]


@dataclass
class Call:
    """What is kept of a call; the buffer holds what the next window and the last ``WINDOW`` samples need."""

    expected: int = 0  # number of the next push
    total: int = 0
    skipped: int = 0
    speech: bool = False
    start: int = 0  # of the next window
    buffer: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scores: list[float] = field(default_factory=list)

    def push(self, wave: np.ndarray) -> tuple | None:
        self.buffer = np.concatenate([self.buffer, wave])
        if not self.speech:
            loud = np.flatnonzero(self.buffer > GATE)
            self.speech = len(loud) > 0
            drop = max(0, (loud[0] if self.speech else len(self.buffer)) - MARGIN)
            self.skipped += int(drop)
            self.buffer = self.buffer[drop:]
            self.total = len(self.buffer) if self.speech else 0
            if not self.speech:
                return None
        else:
            self.total += len(wave)
        first, before = self.total - len(self.buffer), self.start
        while self.start + SEG <= self.total:
            self.scores.append(running_mean(self.buffer[self.start - first :][:SEG]) / SCALE)
            self.start += HOP
        self.scores = self.scores[-RECENT:]
        found = self.verdict(self.total >= WINDOW) if self.start > before else None
        keep = max(first, min(self.start, self.total - WINDOW))
        self.buffer = self.buffer[keep - first :]
        return found

    def end(self) -> tuple | None:
        if not self.speech:
            return None
        if self.scores:
            return self.verdict(True)
        times = (SEG - 1 - np.arange(self.total)) // self.total + 1
        return self.total, 1, self.skipped, float(np.cumsum(self.buffer * times)[-1]) / SEG / SCALE, True

    def verdict(self, final: bool) -> tuple:
        p = WHOLE * (running_mean(self.buffer[-WINDOW:]) / SCALE) + PART * running_mean(self.scores)
        return self.total, len(self.scores), self.skipped, p, final


class CallProcessor(StatefulProcessor):
    """The calls of a slot. List state: a row for each open call. Map state: long pushes before their turn; short ones stay with their call.

    Spark hands over a slot at a time, and its rows are read and written at once: each group of a stream costs an Arrow
    batch and a frame, and each access to a state a message, so a group and states for each call cost far more than its pushes.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", f"call_id string, {KEPT}, ahead array<{AHEAD}>, until long")
        self.waiting = handle.getMapState("waiting", "call_id string, seq long", "wave array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        come: dict[str, dict[int, tuple]] = {}
        for batch in rows:
            for call_id, seq, wave, eof in zip(*[batch[c] for c in ("call_id", "seq", "wave", "eof")], strict=True):
                come.setdefault(call_id, {})[int(seq)] = wave, bool(eof)
        until = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        open_, out = self.load(), []
        for call_id, pushes in come.items():
            kept = self.fold(call_id, pushes, open_.pop(call_id, None), out)
            if kept is not None:
                open_[call_id] = (*kept, until)
        self.store(open_)
        if open_ and self.idle_ms is not None:
            self.handle.registerTimer(until)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"segments": "int32"})

    def load(self) -> dict[str, tuple]:
        if not self.calls.exists():
            return {}
        # nested rows as plain tuples, which can be written again
        return {call_id: (*kept, [tuple(x) for x in ahead], until) for call_id, *kept, ahead, until in self.calls.get()}

    def store(self, open_: dict[str, tuple]) -> None:
        if open_:  # a list state holds no empty list
            self.calls.put([(call_id, *kept) for call_id, kept in open_.items()])
        else:
            self.calls.clear()

    def fold(self, call_id: str, come: dict[int, tuple], kept: tuple | None, out: list[tuple]) -> tuple | None:
        """New pushes of a call onto what is kept of it; nothing is kept behind its end mark."""
        call, ahead = Call(), {}
        if kept is not None:
            *counters, buffer, scores, early, _ = kept
            call, ahead = Call(*counters, np.array(buffer, float), list(scores)), {x[0]: x for x in early}
        for seq in sorted(come):
            push = come[seq] if seq == call.expected else None
            if seq > call.expected:
                ahead[seq] = self.held(call_id, seq, *come[seq])
            while push is not None:
                wave, ended = push
                for found, last in ((call.push(np.asarray(wave, float)), False), (call.end() if ended else None, True)):
                    if found is not None:
                        out.append((call_id, call.expected, last, *found))
                if ended:
                    self.forget(call_id, ahead.values())
                    return None
                call.expected += 1
                push = self.take(call_id, ahead.pop(call.expected)) if call.expected in ahead else None
        return call.expected, call.total, call.skipped, call.speech, call.start, call.buffer.tolist(), call.scores, list(ahead.values())

    def held(self, call_id: str, seq: int, wave: Iterable[float], eof: bool) -> tuple:
        """A push before its turn; a long one is written once, not with each change of its call."""
        wave = [float(x) for x in wave]
        if len(wave) <= SHORT:
            return seq, wave, eof
        self.waiting.updateValue((call_id, seq), (wave,))
        return seq, None, eof

    def take(self, call_id: str, push: tuple) -> tuple:
        seq, wave, eof = push
        if wave is None:
            (wave,) = self.waiting.getValue((call_id, seq))
            self.waiting.removeKey((call_id, seq))
        return wave, eof

    def forget(self, call_id: str, ahead: Iterable[tuple]) -> None:
        for seq, wave, _ in ahead:
            if wave is None:
                self.waiting.removeKey((call_id, seq))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A timer is that of all calls of the slot with pushes in one micro-batch; those with later ones stay."""
        now, open_ = expiredTimerInfo.getExpiryTimeInMs(), self.load()
        for call_id in [call_id for call_id, kept in open_.items() if kept[-1] <= now]:
            self.forget(call_id, open_.pop(call_id)[-2])
        self.store(open_)
        return iter(())

    def close(self) -> None:
        pass


def stream_verdicts(pushes: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The verdicts of a streaming DataFrame of call_id, seq, wave, eof; without ``idle_ms`` no timers run, so a replay ends.

    The session needs the RocksDB state store, see ``stateful``.
    """
    slot = F.pmod(F.xxhash64("call_id"), F.lit(SLOTS)).cast("int").alias("slot")
    found = pushes.select(slot, "call_id", "seq", "wave", "eof").groupBy("slot").transformWithStateInPandas(
        CallProcessor(idle_ms), OUT, "Append", "None" if idle_ms is None else "ProcessingTime"
    )
    return with_level(found)


class stateful:  # noqa: N801
    """Within it the session starts queries on the RocksDB state store, which named states and timers need."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(STORE, None)
        self.spark.conf.set(STORE, ROCKS)

    def __exit__(self, *error) -> None:
        if self.before is None:
            self.spark.conf.unset(STORE)
        else:
            self.spark.conf.set(STORE, self.before)


def replay(
    spark: SparkSession, pushes: DataFrame, files: int = 6, files_a_batch: int = 2, shape: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, StreamingQuery, str]:
    """Write pushes to files in no order, stream them in several micro-batches, and read the verdicts back.

    Also gives the ended query and its folder, which holds in, checkpoint and out; ``shape`` may add to the verdicts.
    """
    at = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    pushes.repartition(files, F.xxhash64("call_id", "seq")).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(pushes.schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{at}/in")
    found = stream_verdicts(stream, None)
    with stateful(spark):
        query = (
            (shape(found) if shape else found).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint")
            .trigger(availableNow=True).start(f"{at}/out")
        )
        query.awaitTermination()
    return spark.read.parquet(f"{at}/out"), query, at


def verdicts(pushes: DataFrame) -> DataFrame:
    """The batch form over whole calls, numbered pushes of (call_id, seq, wave, eof); what follows an end mark is ignored."""
    by = Window.partitionBy("call_id")
    ends = pushes.where("eof").groupBy("call_id").agg(F.min("seq").alias("last"))
    x = pushes.join(ends, "call_id", "left").where("last IS NULL OR seq <= last").select("call_id", "seq", "last", F.posexplode("wave").alias("i", "x"))
    x = x.withColumn("n", F.row_number().over(by.orderBy("seq", "i")))
    onset = F.min(F.when(F.col("x") > GATE, F.col("n"))).over(by)
    x = x.withColumn("skipped", F.greatest(onset - 1 - MARGIN, F.lit(0)).cast("long")).withColumn("heard", onset.isNotNull())
    x = x.where("heard AND n > skipped").withColumn("k", F.col("n") - F.col("skipped"))
    order = by.orderBy("k")
    mean = lambda c, n: F.avg(c).over(order.rowsBetween(1 - n, 0))
    completes = (F.col("k") >= SEG) & ((F.col("k") - SEG) % HOP == 0)
    x = x.withColumns({"whole": mean("x", WINDOW) / SCALE, "w": F.when(completes, mean("x", SEG) / SCALE)})
    # the last RECENT windows end within so many samples
    x = x.withColumns({"parts": mean("w", RECENT * HOP), "done": F.count("w").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    at_end = [F.max("k").alias("audio"), F.first("skipped").alias("skipped"), *[F.max_by(c, "k").alias(c) for c in ("whole", "parts", "done")]]
    p = WHOLE * F.col("whole") + PART * F.col("parts")
    segments = F.least("done", F.lit(RECENT)).cast("int")
    pushed = x.groupBy("call_id", "seq").agg(F.count("w").alias("new"), *at_end).where("new > 0").select(
        "call_id", "seq", F.lit(False).alias("ended"), "audio", segments.alias("segments"), "skipped", p.alias("p"), (F.col("audio") >= WINDOW).alias("final")
    )
    # a call shorter than a window is repeated until it fills one: how often each of its samples comes up
    head = F.filter(F.sort_array(F.collect_list(F.when(F.col("k") < SEG, F.struct("k", "x")))), lambda c: c["k"] < SEG)
    whole = x.groupBy("call_id").agg(F.first("last").alias("seq"), head.alias("head"), *at_end).where("seq IS NOT NULL")
    filled = F.aggregate("head", F.lit(0.0), lambda s, c: s + c["x"] * (F.floor((SEG - c["k"]) / F.col("audio")) + 1)) / SEG / SCALE
    ended = whole.select(
        "call_id", "seq", F.lit(True).alias("ended"), "audio", F.greatest(segments, F.lit(1)).alias("segments"), "skipped",
        F.when(F.col("audio") < SEG, filled).otherwise(p).alias("p"), F.lit(True).alias("final"),
    )
    return with_level(pushed.union(ended))


#: The verdicts in SQL, over ``pushed`` (call_id, seq, i, x, eof: one row per sample, nothing behind an end mark).
SQL = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seq, i) AS n FROM pushed),
o AS (SELECT *, min(n) FILTER (WHERE x > {GATE}) OVER (PARTITION BY call_id) AS onset FROM n),
k AS (SELECT call_id, seq, x, eof, greatest(onset - 1 - {MARGIN}, 0) AS skipped, n - greatest(onset - 1 - {MARGIN}, 0) AS k
      FROM o WHERE onset IS NOT NULL AND n > greatest(onset - 1 - {MARGIN}, 0)),
m AS (SELECT *, avg(x) OVER (PARTITION BY call_id ORDER BY k ROWS {WINDOW - 1} PRECEDING) / {SCALE} AS whole,
             CASE WHEN k >= {SEG} AND (k - {SEG}) % {HOP} = 0 THEN avg(x) OVER (PARTITION BY call_id ORDER BY k ROWS {SEG - 1} PRECEDING) / {SCALE} END AS w FROM k),
r AS (SELECT *, avg(w) OVER (PARTITION BY call_id ORDER BY k ROWS {RECENT * HOP - 1} PRECEDING) AS parts,
             count(w) OVER (PARTITION BY call_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS done FROM m),
e AS (SELECT call_id, seq, max(k) AS audio, count(w) AS fresh, any_value(skipped) AS skipped, bool_or(eof) AS eof,
             max_by(whole, k) AS whole, max_by(parts, k) AS parts, max_by(done, k) AS done FROM r GROUP BY call_id, seq),
f AS (SELECT call_id, sum((floor(({SEG} - k) / t) + 1) * x) / {SEG} / {SCALE} AS filled
      FROM (SELECT *, max(k) OVER (PARTITION BY call_id) AS t FROM k) WHERE k < {SEG} GROUP BY call_id),
v AS (SELECT call_id, seq, false AS ended, audio, least(done, {RECENT})::INT AS segments, skipped, {WHOLE} * whole + {PART} * parts AS p, audio >= {WINDOW} AS final
      FROM e WHERE fresh > 0
      UNION ALL SELECT e.call_id, seq, true, audio, greatest(least(done, {RECENT}), 1)::INT, skipped,
             CASE WHEN audio < {SEG} THEN filled ELSE {WHOLE} * whole + {PART} * parts END, true
      FROM e LEFT JOIN f ON e.call_id = f.call_id WHERE eof),
verdicts AS (SELECT *, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM v)"""
