"""Streams that are delivered at least once: repeats dropped behind a watermark, tables written once.

``first_deliveries`` keeps the first delivery of each key. Its state holds a key only until the
watermark has passed the key's time by the delay, so it is bounded by the keys of that span, not by
those of the stream. A delivery that is later than the delay is dropped or kept as Spark documents it;
the delay has to cover the longest way of a repeat.

``append_once`` is a sink for ``foreachBatch``. A batch is a folder of its own, which the committer
marks when it is whole; a batch that is marked is not written again, one that broke off is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.folders import shared_folder, whole
from .calls import stateful


def first_deliveries(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """One delivery of each key whose repeats come within ``delay`` of event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append_once(rows: DataFrame, batch_id: int, path: str) -> bool:
    """Write a batch to ``path``, unless it stands there whole; says whether it wrote."""
    target = f"{path}/batch={batch_id}"
    if whole(rows.sparkSession, target):
        return False
    rows.write.mode("overwrite").parquet(target)
    return True


def once_into(path: str, wrote: list[int] | None = None) -> Callable[[DataFrame, int], None]:
    """``append_once`` for ``foreachBatch``; ``wrote`` gets the ids of the batches that were written."""

    def write(rows: DataFrame, batch_id: int) -> None:
        if append_once(rows, batch_id, path) and wrote is not None:
            wrote.append(batch_id)

    return write


def slots(rows: DataFrame, time: str, n: int) -> list[DataFrame]:
    """Rows by ``n`` equal spans of time; those without a time are in the last."""
    first, last = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    span = max(1, ((last or 0) - (first or 0)) // n + 1)
    at = F.coalesce(F.floor((F.unix_micros(time) - (first or 0)) / span), F.lit(n - 1))
    return [rows.where(at == k) for k in range(n)]


def replayed(
    spark: SparkSession, slots: Iterable[DataFrame], transform: Callable[[DataFrame], DataFrame], at: str | None = None
) -> tuple[DataFrame, list[StreamingQuery]]:
    """Files of one slot after the other arrive; the query is started again for each, from its checkpoint.

    Returns what the sink holds at the end, and the queries that ran.
    """
    at = at or f"{shared_folder(spark)}/deliveries-{uuid.uuid4().hex}"
    ran = []
    with stateful(spark):
        for slot in slots:
            slot.write.mode("append").parquet(f"{at}/in")
            stream = transform(spark.readStream.schema(slot.schema).parquet(f"{at}/in"))
            query = (
                stream.writeStream.option("checkpointLocation", f"{at}/checkpoint").foreachBatch(once_into(f"{at}/out"))
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
            ran.append(query)
    return spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out/batch=*"), ran
