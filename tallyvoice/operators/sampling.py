"""Deterministic sampling: membership, halves, strata and plans from md5 digests of ids, never of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def digest_byte(digest: Column, at: int) -> Column:
    """Byte ``at`` of a hex digest as a long."""
    return F.conv(F.substring(digest, 2 * at + 1, 2), 16, 10).cast("long")


def digest_int(digest: Column, at: int, size: int) -> Column:
    """``size`` bytes from ``at`` as a little-endian unsigned number."""
    total = F.lit(0).cast("long")
    for k in range(size):
        total = total + digest_byte(digest, at + k) * F.lit(256**k).cast("long")
    return total


def uniform(digest: Column, at: int, size: int = 2) -> Column:
    return digest_int(digest, at, size) / F.lit(float(256**size))


def half_a(key: Column, salt: str = "cal") -> Column:
    """Whether a key is in half A of the fixed split by its hash."""
    return digest_byte(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 0) % 2 == 0


def member(key: Column, seed: int, share: float) -> Column:
    """Whether a key falls into the first ``share`` of the unit interval."""
    return uniform(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 0, 4) < share


def first_in_hash_order(rows: DataFrame, key: str, seed: int, stratum: str, want: Column, then: Sequence[str]) -> DataFrame:
    """The first rows of each stratum by the hash of seed and key, then by columns; all where ``want`` is null.

    Adds nth, the rank in the stratum, and have, its number of rows. Rows are counted by stratum and slot
    (the first digits of the hash): the slots before a row's are its offset, rows of slots behind the
    wanted ones stay where they are, and no task ranks more than a slot. ``want`` is a column of the strata.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    rows = rows.withColumn("_hash", digest).withColumn("_slot", F.coalesce(F.substring("_hash", 1, 3), F.lit("none")))
    own = Window.partitionBy(stratum)
    before = F.sum("_n").over(own.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    slots = rows.groupBy(stratum, "_slot").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(stratum).alias("_stratum"), F.col("_slot").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("have"), want.alias("_want")
    )
    slots = slots.where("_want IS NULL OR _before < _want")
    met = rows.join(F.broadcast(slots), F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_slot") == F.col("_of")))
    order = Window.partitionBy(stratum, "_slot").orderBy(*[F.asc_nulls_last(c) for c in ("_hash", *then)])
    ranked = met.withColumn("nth", (F.col("_before") + F.row_number().over(order)).cast("int"))
    return ranked.where("_want IS NULL OR nth <= _want").drop("_hash", "_slot", "_stratum", "_of", "_before", "_want")


def stratified(rows: DataFrame, key: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows of each stratum, in hash order."""
    return first_in_hash_order(rows, key, seed, stratum, F.lit(n), [key]).drop("have")


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of the whole table in hash order (a top-n, so no task sees all rows)."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def pick(u: Column, weighted: list[tuple[str, float]]) -> Column:
    """The first choice whose cumulative weight exceeds ``u``; the last one catches the rest."""
    out, total = None, 0.0
    for name, weight in weighted[:-1]:
        total += weight
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    return out.otherwise(weighted[-1][0])


def nth_of(index: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def snr_bin(snr: Column, bins: list[tuple[int, int]]) -> Column:
    """Half-open bins; the last also takes all above."""
    out = None
    for low, high in bins[:-1]:
        out = F.when(snr < high, f"{low}-{high}") if out is None else out.when(snr < high, f"{low}-{high}")
    return out.otherwise(f"{bins[-1][0]}-{bins[-1][1]}")


def selected(rows: DataFrame, key: str, stratum: str, want: Column, seed: int = 0) -> DataFrame:
    """Exactly ``want`` rows of each stratum in hash order, all where it is 0; a stratum with fewer fails the job."""
    ranked = first_in_hash_order(rows, key, seed, stratum, F.when(want != 0, want), [key]).withColumn("want", want)
    message = F.concat(F.lit("only "), F.col("have").cast("string"), F.lit(" rows of "), F.col(stratum).cast("string"), F.lit(", wanted "), F.col("want").cast("string"))
    nth = F.when(F.col("have") >= F.col("want"), F.col("nth")).otherwise(F.raise_error(message).cast("int"))
    return ranked.withColumn("nth", nth).drop("want", "have")
