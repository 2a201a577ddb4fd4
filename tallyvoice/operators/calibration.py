"""A logistic map from scores to probabilities, fitted by aggregates over score counts, and its calibration error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def logistic(score: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(score * F.lit(slope) + F.lit(intercept))))


def fit_logistic(counts: DataFrame, score: str = "score", steps: int = 50, close: float = 1e-9) -> tuple[float, float]:
    """Slope and intercept of the most likely logistic map of counted scores (score, pos, neg).

    Newton's steps: gradient and second derivatives are five sums, so a step is one partial aggregate
    over different scores and brings five numbers to the driver. A step that makes the likelihood worse
    is halved. One class only, or one score, has no finite map: a ValueError.
    """
    s, pos, n = F.col(score).cast("double"), F.col("pos").cast("double"), (F.col("pos") + F.col("neg")).cast("double")
    counts = counts.where(F.col(score).isNotNull()).persist()
    try:
        about = counts.agg(F.sum(pos), F.sum(n), F.min(s), F.max(s)).first()
        if not about[1] or about[0] in (0, about[1]) or about[2] == about[3]:
            raise ValueError("a logistic map needs both classes and two different scores")

        def sums(a: float, b: float):
            q = logistic(s, a, b)
            w, z = q * (1 - q) * n, s * a + b
            # log likelihood without overflow: pos * z - n * log(1 + exp(z))
            likely = pos * z - n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
            return counts.agg(F.sum((q * n - pos) * s), F.sum(q * n - pos), F.sum(w * s * s), F.sum(w * s), F.sum(w), F.sum(likely)).first()

        a, b = 0.0, 0.0
        now = sums(a, b)
        for _ in range(steps):
            ga, gb, haa, hab, hbb, likely = now
            det = haa * hbb - hab * hab
            if not det > 0:
                break
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            share = 1.0
            while share > 1e-6:
                new = sums(a - share * da, b - share * db)
                if math.isfinite(new[5]) and new[5] >= likely - 1e-12 * abs(likely):
                    break
                share /= 2
            a, b, now = a - share * da, b - share * db, new
            if abs(share * da) + abs(share * db) <= close * (1 + abs(a) + abs(b)):
                break
        return a, b
    finally:
        counts.unpersist()


def calibration_error(rows: DataFrame, p: Column, y: str = "y", bins: int = 10) -> DataFrame:
    """One row: the mean gap between probability and share of positives over bins of equal width, weighed by rows."""
    binned = rows.select(p.alias("p"), F.col(y).alias("y")).withColumn("bin", F.least(F.floor(F.round(F.col("p") * bins, 6)), F.lit(bins - 1).cast("long")))
    each = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    return each.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("error"))
