"""Running sums and exact quantiles over a global order, without one task that sees all rows.

Rows, counted by value before, are dealt to ranges of the value. A range's sums are its offsets for
the ranges behind it, so a running sum is the sum of the ranges before, one row each, and a window
within the range. The bounds of the ranges come from approximate quantiles; they only decide which
task does what, never a result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key that all rows of a table share, so that groups may be empty.
ALL = "_all"
RANGE = "_range"
#: Values of a range on average, and ranges at most; their bounds are held by the driver.
RANGE_VALUES, MOST_RANGES = 1 << 17, 4096
EVERYTHING = (-math.inf, math.inf)


def bounds(rows: DataFrame, value: str, least: int | None = None) -> tuple[float, ...]:
    """Bounds of ranges of about equal numbers of rows, ``least`` or as many as the session has shuffle partitions at least."""
    least = least or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    got = rows.agg(
        F.percentile_approx(F.col(value).cast("double"), shares, 4 * MOST_RANGES).alias("q"), F.approx_count_distinct(value).alias("n")
    ).first()
    n = min(MOST_RANGES, max(least, math.ceil((got.n or 0) / RANGE_VALUES)))
    cuts = sorted({got.q[i * MOST_RANGES // n - 1] for i in range(1, n)}) if got.q else []
    return (-math.inf, *[c for c in cuts if math.isfinite(c)], math.inf)


def dealt_to_ranges(rows: DataFrame, value: str, splits: Sequence[float]) -> DataFrame:
    """Rows with the number of the range that their value lies in; null and NaN are a range of their own, the last one."""
    ranged = Bucketizer(splits=list(splits), inputCol="_value", outputCol=RANGE, handleInvalid="keep")
    return ranged.transform(rows.withColumn("_value", F.col(value).cast("double"))).drop("_value")


def gathered(rows: DataFrame, value: str, splits: Sequence[float]) -> DataFrame:
    """Rows dealt to ranges, each range in one task, where there are more ranges than the session has tasks; else as they are.

    The tasks then grow in number with the values, not in size. ``running`` finds the ranges and moves no row again.
    """
    ranges = len(splits) - 1
    if ranges <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    # whole numbers: Spark normalises a float that it groups by, and then no longer knows that its rows are together
    return dealt_to_ranges(rows, value, splits).withColumn(RANGE, F.col(RANGE).cast("int")).repartition(ranges, RANGE)


def between(rank: Column, low: Column, high: Column) -> Column:
    """The value at a rank between two whole ones, weighed as Spark's percentile does, so that results are equal to the last bit."""
    return F.when(low == high, low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)


def running(
    counts: DataFrame, value: str, sums: Sequence[str], groups: Sequence[str] = (), splits: Sequence[float] = EVERYTHING, descending: bool = False
) -> DataFrame:
    """Add, for each column x of ``sums``: x_to, its sum up to the row's value; x_all, its sum; x_next, that of the next value.

    ``counts`` has one row per value within its groups. Null and NaN values are a range of their own, the last one upwards.
    Rows that ``gathered`` has dealt stay in their tasks: the ranges' sums go to them, a row per range and group.
    """
    turn = F.desc if descending else F.asc
    if len(splits) == 2:  # few values: a group is one range
        by, order = Window.partitionBy(*groups), Window.partitionBy(*groups).orderBy(turn(value))
        return counts.select(
            F.lit(0).alias(ALL), "*", *[F.sum(x).over(by).alias(f"{x}_all") for x in sums],
            *[F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"{x}_to") for x in sums],
            *[F.lead(x).over(order).alias(f"{x}_next") for x in sums],
        )
    ready = RANGE in counts.columns
    dealt = counts if ready else dealt_to_ranges(counts, value, splits)
    part = [ALL, *groups]
    # a column, not a constant: a key that Spark can see through would gather the ranges' rows as one table
    dealt = dealt.withColumn(ALL, F.least(F.col(RANGE), F.lit(0.0)))
    inside = Window.partitionBy(*groups, RANGE).orderBy(turn(value))
    up_to = {x: F.sum(x).over(inside.rowsBetween(Window.unboundedPreceding, 0)) for x in sums}
    edge = F.max_by if descending else F.min_by
    # a column each: sums of fixed width are hashed, a struct would have all rows sorted
    of_range = dealt.groupBy(*part, RANGE).agg(*[F.sum(x).alias(x) for x in sums], *[edge(x, value).alias(f"_{x}_head") for x in sums])
    order = Window.partitionBy(*part).orderBy(turn(RANGE))
    before = lambda x: F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(x)
    offsets = of_range.select(
        *groups, RANGE, *[F.lead(f"_{x}_head").over(order).alias(f"_{x}_head") for x in sums], *[before(x).alias(f"_{x}_before") for x in sums],
        *[F.sum(x).over(Window.partitionBy(*part)).alias(f"{x}_all") for x in sums],
    )
    met = dealt.alias("d").join((F.broadcast(offsets) if ready else offsets).alias("o"), [F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}")) for c in (*groups, RANGE)])
    met = met.select("d.*", *[F.col(f"o.{c}") for c in offsets.columns if c not in (*groups, RANGE)])
    return met.select(
        *[c for c in dealt.columns if c != RANGE], *[f"{x}_all" for x in sums], *[(F.col(f"_{x}_before") + up_to[x]).alias(f"{x}_to") for x in sums],
        *[F.coalesce(F.lead(x).over(inside), F.col(f"_{x}_head")).alias(f"{x}_next") for x in sums],
    )


def quantiles(rows: DataFrame, value: Column | str, shares: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: the groups, n and an array q. Null values are left out.

    A share's place lies between two ranks; the value of a rank is the least one whose running count
    exceeds it, which is a partial aggregate over different values.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = rows.select(*groups, value.cast("double").alias("v")).where("v IS NOT NULL")
    found = running(rows.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("n")), "v", ["n"], groups, bounds(rows, "v"))
    ranks = found.withColumns({f"r{i}": F.lit(float(s)) * (F.col("n_all") - 1) for i, s in enumerate(shares)})
    at = lambda rank: F.min(F.when(F.col("n_to") > rank, F.col("v")))
    one = ranks.groupBy(ALL, *groups).agg(
        F.max("n_all").alias("n"), *[F.max(f"r{i}").alias(f"r{i}") for i in range(len(shares))],
        *[at(f(f"r{i}")).alias(f"{c}{i}") for i in range(len(shares)) for c, f in (("lo", F.floor), ("hi", F.ceil))],
    )
    each = [between(F.col(f"r{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(len(shares))]
    return one.select(*groups, "n", F.array(*each).alias("q"))

