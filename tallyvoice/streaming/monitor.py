"""What a running query reports: observed aggregates of its rows, and the rows of its state.

``observed`` adds aggregates to a stream that Spark computes on the way; ``Totals`` is a listener that
adds them up over the micro-batches, so the totals never need a second pass over the rows.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

LEVELS = ("high", "medium", "low")
NAME = "verdicts"


def observed(verdicts: DataFrame) -> DataFrame:
    """The stream with counts of its rows, by level, of final ones and of ended calls."""
    return verdicts.observe(
        NAME, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("level") == x).alias(x) for x in LEVELS],
        F.count_if("final").alias("final"), F.count_if("ended").alias("ended"),
    )


class Totals(StreamingQueryListener):
    """Sums of what ``observed`` reports, batches, and rows of state after the last batch, by query."""

    def __init__(self) -> None:
        self.sums: dict[str, Counter] = {}
        self.state_rows: dict[str, int] = {}
        self.batches: Counter = Counter()
        self.errors: dict[str, str] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended.setdefault(str(event.id), threading.Event())

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress, query = event.progress, str(event.progress.id)
        self.batches[query] += 1
        row = progress.observedMetrics.get(NAME)
        if row is not None:
            self.sums.setdefault(query, Counter()).update({k: v or 0 for k, v in row.asDict().items()})
        if progress.stateOperators:
            self.state_rows[query] = progress.stateOperators[0].numRowsTotal

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self.errors[str(event.id)] = event.exception
        self.ended.setdefault(str(event.id), threading.Event()).set()

    def wait(self, query: str, seconds: float = 60) -> Counter:
        """The totals of a query once its end has been reported; reports come from another thread."""
        if not self.ended.setdefault(query, threading.Event()).wait(seconds):
            raise TimeoutError(f"no report of the end of query {query}")
        return self.sums.get(query, Counter())
