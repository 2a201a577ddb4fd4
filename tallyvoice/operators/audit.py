"""Integrity audits: class statistics, shortcut flags, and a report of failed checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import quantiles


def stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, p5, median and p95 (linear interpolation, 3 decimals) per group."""
    means = rows.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 3).alias("mean"))
    q = quantiles(rows, value, [0.05, 0.5, 0.95], [group]).select(F.col(group).alias("_group"), "q")
    return means.join(q, F.col(group).eqNullSafe(F.col("_group")), "left").select(
        group, "n", "mean", *[F.round(F.col("q")[i], 3).alias(c) for i, c in enumerate(("p5", "median", "p95"))]
    )


def shortcut(low: Column, high: Column, least_gap: float, ratio: float = 1.25, floor: float = 1e-3) -> Column:
    """Whether two class values differ enough, absolutely and relatively, to give the classes away."""
    top, bottom = F.greatest(low, high), F.least(low, high)
    return (top - bottom > least_gap) & (top / F.greatest(bottom, F.lit(floor)) > ratio)


def finding(rows: DataFrame, name: str, failed: Column) -> DataFrame:
    """One line of a report: how many rows fail a check."""
    return rows.agg(F.count_if(failed).alias("n")).select(F.lit(name).alias("finding"), "n")


def report(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def histogram(value: Column, bounds: list[float]) -> list[Column]:
    """Cumulative bucket counts, the last one without bound."""
    return [F.count_if(value <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds] + [F.count(value).alias("le_inf")]
