"""Joins with the checks that their results rest on: alignment, as-of, range, hold-outs, blocked similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_lookup(left: DataFrame, right: DataFrame, key: str, agree: tuple[str, str]) -> DataFrame:
    """Inner lookup that fails the job where the two sides disagree."""
    joined = left.join(right, key)
    message = F.concat(F.lit("sides disagree at "), F.col(key).cast("string"))
    same = F.col(agree[0]).eqNullSafe(F.col(agree[1]))
    return joined.withColumn(agree[0], F.when(same, F.col(agree[0])).otherwise(F.raise_error(message).cast(left.schema[agree[0]].dataType)))


def aligned(first: DataFrame, second: DataFrame, key: str, y: str) -> DataFrame:
    """1:1 join of two runs; ``aligned`` is false where a clip is missing or labels differ."""
    a, b = first.alias("f"), second.alias("s")
    return a.join(b, F.col(f"f.{key}") == F.col(f"s.{key}"), "full_outer").select(
        F.coalesce(f"f.{key}", f"s.{key}").alias(key), F.col("f.p").alias("first"), F.col("s.p").alias("second"),
        F.coalesce(F.col(f"f.{y}") == F.col(f"s.{y}"), F.lit(False)).alias("aligned"),
    )


def asof_grid(rows: DataFrame, keys: list[str], time: str, value: str, grid: list[float], slack: float = 1e-3) -> DataFrame:
    """The last value at or before each grid time (plus slack), else the first of the key.

    One aggregate per key with a conditional maximum for each of the few grid times: rows are not
    multiplied by the grid, and partial aggregation carries hot keys.
    """
    found = [F.max_by(value, F.when(F.col(time) <= t + slack, F.col(time))).alias(f"v{i}") for i, t in enumerate(grid)]
    one = rows.groupBy(*keys).agg(*found, F.min_by(value, time).alias("first"))
    each = F.array(*[F.struct(F.lit(t).alias("t"), F.coalesce(f"v{i}", "first").alias(value)) for i, t in enumerate(grid)])
    return one.select(*keys, F.explode(each).alias("g")).select(*keys, F.col("g.t").alias("t"), F.col(f"g.{value}").alias(value))


def mean_until_grid(rows: DataFrame, keys: list[str], time: str, value: str, grid: list[float]) -> DataFrame:
    """Mean and count of the values that end by each grid time, in one pass."""
    sums = [c for i, t in enumerate(grid) for c in (
        F.sum(F.when(F.col(time) <= t, F.col(value))).alias(f"s{i}"), F.count_if(F.col(time) <= t).alias(f"n{i}"))]
    one = rows.groupBy(*keys).agg(*sums)
    each = F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{i}").alias("n"), (F.col(f"s{i}") / F.nullif(F.col(f"n{i}"), F.lit(0))).alias("mean")) for i, t in enumerate(grid)])
    return one.select(*keys, F.explode(each).alias("g")).where("g.n > 0").select(*keys, "g.t", "g.n", "g.mean")


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))


QUERY_BLOCK, ROW_BLOCK = 512, 2048
_BLOCKS = "ids binary, vectors binary, width int"


def packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of (id, vector) as blocks: ids, and vectors of length one end to end. Null, empty and zero vectors are left out."""
    for batch in batches:
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.asarray(vector.values.to_numpy(zero_copy_only=False), float) if vector.is_valid else np.zeros(0)
            norm = np.sqrt((x * x).sum())
            if key is not None and norm > 0:
                by_width.setdefault(len(x), []).append((key, x / norm))
        for width, rows in by_width.items():
            for at in range(0, len(rows), size):
                some = rows[at : at + size]
                ids, vectors = np.array([r[0] for r in some], np.int64), np.stack([r[1] for r in some])
                yield pa.record_batch([pa.array([ids.tobytes()]), pa.array([vectors.tobytes()]), pa.array([width], pa.int32())], names=["ids", "vectors", "width"])


def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks as one row per query: highest and summed cosine with the block's other rows, and their number."""
    for batch in batches:
        for b in batch.to_pylist():
            width = b["width"]
            q, r = (np.frombuffer(b[c]).reshape(-1, width) for c in ("q_vectors", "vectors"))
            q_ids, ids = (np.frombuffer(b[c], np.int64) for c in ("q_ids", "ids"))
            sim, other = q @ r.T, q_ids[:, None] != ids[None, :]
            yield pa.record_batch(
                {
                    "query": pa.array(q_ids), "top": pa.array(np.where(other, sim, -np.inf).max(axis=1)),
                    "total": pa.array(np.where(other, sim, 0.0).sum(axis=1)), "n": pa.array(other.sum(axis=1).astype(np.int64)),
                }
            )


def nearest_of_queries(queries: DataFrame, rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Highest and mean cosine of each stated query vector against all other rows.

    Both sides are packed into blocks; a pair of blocks is one matrix product. Blocks meet, not rows, and
    a query's results of all blocks are merged by partial aggregates. Queries without another row are left out.
    """
    blocks = lambda frame, size: frame.select(F.col(id_col).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(
        lambda b: packed(b, size), _BLOCKS
    )
    asked = blocks(queries, QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("width").alias("q_width"))
    met = blocks(rows, ROW_BLOCK).crossJoin(asked).where("width = q_width").drop("q_width")
    found = met.mapInArrow(multiplied, "query long, top double, total double, n long")
    merged = found.groupBy("query").agg(F.max("top").alias("top"), F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    return merged.select("query", F.round("top", 4).alias("max_sim"), F.round(F.col("total") / F.col("n"), 4).alias("mean_sim"))


def aligned_or_fail(first: DataFrame, second: DataFrame, key: str, y: str) -> DataFrame:
    """``aligned``, where a clip that one run lacks or that the runs label differently fails the job."""
    rows = aligned(first, second, key, y)
    message = F.concat(F.lit("runs do not agree on clip "), F.col(key).cast("string"))
    kept = F.when(F.col("aligned"), F.col(key)).otherwise(F.raise_error(message).cast(rows.schema[key].dataType))
    return rows.select(kept.alias(key), "first", "second")
