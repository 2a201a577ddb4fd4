"""Thresholds to levels and actions, score fusion, and the choice of fusion weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import eer_of


def risk_level(p: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    if not 0 <= medium <= high <= 1:
        raise ValueError(f"medium {medium} and high {high} have to lie between 0 and 1, medium not above high")
    return F.when(p >= high, "high").when(p >= medium, "medium").otherwise("low")


def action_of(level: Column) -> Column:
    return F.when(level == "high", "escalate").when(level == "medium", "verify").otherwise("allow")


def combined_action(voice: Column, intent: Column) -> Column:
    """Intent only ever raises the voice's action, and only when it is high."""
    raised = F.when(voice == "allow", "verify").otherwise("escalate")
    return F.when(intent == "high", raised).otherwise(voice)


def fuse(weights: dict[str, float]) -> Column:
    """The weighted mean of branch columns; weights are not negative and sum to one."""
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError(f"branch weights {weights} have to add up to 1, none below 0")
    total = F.lit(0.0)
    for branch, weight in weights.items():
        if weight:
            total = total + F.col(branch) * weight
    return total


def gated(a: Column, b: Column, q: Column, low: float, high: float) -> Column:
    """Between two scores, the second the more trusted the better the quality ``q``."""
    w = low + (high - low) * F.greatest(F.least(q, F.lit(1.0)), F.lit(0.0))
    return (1 - w) * a + w * b


def weight_grid(frame: DataFrame, steps: int) -> DataFrame:
    """Weights of three branches on the simplex, in steps."""
    one = lambda c: frame.sparkSession.range(steps + 1).withColumnRenamed("id", c)
    return one("wa").crossJoin(one("wb")).where(F.col("wa") + F.col("wb") <= steps).withColumn(
        "wc", F.lit(steps) - F.col("wa") - F.col("wb")
    )


def grid_eer(rows: DataFrame, steps: int) -> DataFrame:
    """EER of each weight triple; equal branch triples are counted before they meet the grid."""
    counted = rows.groupBy("a", "b", "c").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    fused = F.round((F.col("a") * F.col("wa") + F.col("b") * F.col("wb") + F.col("c") * F.col("wc")) / steps, 6)
    met = counted.crossJoin(F.broadcast(weight_grid(rows, steps))).groupBy("wa", "wb", "wc", fused.alias("score")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return eer_of(met, ["wa", "wb", "wc"])


def closest_to_uniform(grid: DataFrame, band: float = 0.05) -> DataFrame:
    """Of the weights within ``band`` of the best EER, the ones nearest to uniform; ties by weights."""
    best = grid.crossJoin(grid.agg(F.min("eer_pct").alias("best"))).where(F.round(F.col("eer_pct") - F.col("best"), 6) <= band)
    spread = F.greatest("wa", "wb", "wc") - F.least("wa", "wb", "wc")
    order = Window.orderBy(spread, "eer_pct", "wa", "wb", "wc")
    return best.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth", "best")


def fusion_over_times(rows: DataFrame, steps: int = 20, time: str = "t", band: float = 0.05) -> DataFrame:
    """Mean EER over the decision times of every weight triple, and which is chosen.

    Of the triples within ``band`` of the best, the one of the least squared distance to equal weights
    is chosen, then the first one. Weights are in steps, so the distance is a whole number.
    """
    counted = rows.groupBy(time, "a", "b", "c").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    fused = F.round((F.col("a") * F.col("wa") + F.col("b") * F.col("wb") + F.col("c") * F.col("wc")) / steps, 6)
    met = counted.crossJoin(F.broadcast(weight_grid(rows, steps))).groupBy("wa", "wb", "wc", time, fused.alias("score")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    each = eer_of(met, ["wa", "wb", "wc", time]).groupBy("wa", "wb", "wc").agg(F.round(F.avg("eer_pct"), 6).alias("mean_eer"))
    away = sum(((3 * F.col(w) - steps) * (3 * F.col(w) - steps) for w in ("wb", "wc")), (3 * F.col("wa") - steps) * (3 * F.col("wa") - steps))
    near = each.crossJoin(each.agg(F.min("mean_eer").alias("best"))).where(F.round(F.col("mean_eer") - F.col("best"), 6) <= band)
    chosen = near.agg(F.min(F.struct(away.alias("away"), "wa", "wb", "wc")).alias("c"))
    same = (F.col("wa") == F.col("c.wa")) & (F.col("wb") == F.col("c.wb")) & (F.col("wc") == F.col("c.wc"))
    return each.crossJoin(chosen).select("wa", "wb", "wc", "mean_eer", same.alias("chosen"))


def gate_grid(rows: DataFrame, lows: Sequence[float], highs: Sequence[float], time: str = "t", band: float = 0.05) -> DataFrame:
    """Mean EER over the decision times of a gated fusion for each pair of weights, and which pair is chosen.

    rows: scores a and b, trust q, label y and a decision time. Equal rows are counted before they meet
    the grid. Of the pairs within ``band`` of the best, the one with the smallest weights is chosen.
    """
    spark = rows.sparkSession
    grid = spark.createDataFrame([(float(x), float(z)) for x in lows for z in highs if z >= x], "low double, high double")
    counted = rows.groupBy(time, "a", "b", "q").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    w = F.col("low") + (F.col("high") - F.col("low")) * F.greatest(F.least(F.col("q"), F.lit(1.0)), F.lit(0.0))
    fused = F.round((1 - w) * F.col("a") + w * F.col("b"), 6)
    met = counted.crossJoin(F.broadcast(grid)).groupBy("low", "high", time, fused.alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    each = eer_of(met, ["low", "high", time]).groupBy("low", "high").agg(F.round(F.avg("eer_pct"), 6).alias("mean_eer"))
    # a row a pair: the grid is small whatever the rows
    best = each.agg(F.min("mean_eer").alias("best"))
    near = F.round(F.col("mean_eer") - F.col("best"), 6) <= band
    order = F.struct(F.round(F.col("low") + F.col("high"), 6), "low", "high")
    chosen = each.crossJoin(best).where(near).agg(F.min_by(F.struct("low", "high"), order).alias("c"))
    same = (F.col("low") == F.col("c.low")) & (F.col("high") == F.col("c.high"))
    return each.crossJoin(chosen).select("low", "high", "mean_eer", same.alias("chosen"))


def renormalised(weights: Column, kept: Sequence[str]) -> Column:
    """A map of branch weights cut to some branches, adding up to one; equal weights where they add up to nothing.

    Branches that the map lacks weigh nothing.
    """
    names = F.array(*[F.lit(k) for k in kept])
    own = F.transform(names, lambda k: F.coalesce(F.element_at(weights, k), F.lit(0.0)))
    total = F.aggregate(own, F.lit(0.0), lambda s, v: s + v)
    shares = F.when(total > 0, F.transform(own, lambda v: v / total)).otherwise(F.transform(names, lambda k: F.lit(1 / len(kept))))
    return F.map_from_arrays(names, shares)
