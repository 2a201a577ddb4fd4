"""Detection metrics: ROC points, equal error rate, AUC, confusion counts.

Rows are first counted by score within each group. Running sums then go over different scores, not
rows, dealt to ranges of scores, so neither a hot group nor a continuous score gathers in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import ALL, EVERYTHING, RANGE, bounds, gathered, running


def by_score(
    rows: DataFrame, groups: Sequence[str] = (), y: str = "y", score: str = "p", splits: Sequence[float] = EVERYTHING
) -> DataFrame:
    """Positives and negatives of each distinct score within each group; with many ranges in ``splits`` also the score's range."""
    dealt = gathered(rows.select(*groups, F.col(score).alias("score"), y), "score", splits)
    return (
        dealt.groupBy(*groups, *[c for c in dealt.columns if c == RANGE], "score")
        .agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    )


def with_attack_fanout(counts: DataFrame, attack: str = "attack", genuine: str = "-") -> DataFrame:
    """Counts per attack where each attack meets all genuine rows; the fan-out is over distinct scores."""
    attacks = counts.where(F.col(attack) != genuine).select(attack).distinct()
    return fanned(counts, attack, attacks, genuine)


def fanned(
    counts: DataFrame, attack: str, attacks: DataFrame, genuine: str = "-", beside: Sequence[str] = (), sums: Sequence[str] = ("pos", "neg")
) -> DataFrame:
    """Counts per name in ``attack``: each of ``attacks`` with all genuine rows, and each name in the columns ``beside``."""
    names = attacks.agg(F.collect_set(attack).alias("_names"))
    of_row = F.when(F.col(attack) == genuine, F.col("_names")).when(F.col(attack).isNotNull(), F.array(attack)).otherwise(F.array())
    met = counts.crossJoin(F.broadcast(names)).withColumn(attack, F.explode(F.concat(of_row, *[F.array(c) for c in beside])))
    return met.groupBy(*[c for c in counts.columns if c not in (*sums, *beside)]).agg(*[F.sum(c).alias(c) for c in sums])


def roc_points(counts: DataFrame, groups: Sequence[str] = (), splits: Sequence[float] = EVERYTHING) -> DataFrame:
    """Kept ROC points: ends, and scores where the slope of hits or false alarms changes; and (0, 0).

    The point before a score is its sums less its own counts, the one behind it its sums and the next
    score's counts; so a slope changes where two neighbours' counts differ.
    """
    part = [ALL, *groups]
    c = running(counts, "score", ["pos", "neg"], groups, splits, descending=True)
    first = F.col("pos_to") + F.col("neg_to") == F.col("pos") + F.col("neg")
    bend = (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))
    kept = c.where((F.col("pos_all") > 0) & (F.col("neg_all") > 0)).where(first | F.col("pos_next").isNull() | bend)
    point = lambda score, tpr, fpr: F.struct(score.cast("double").alias("score"), tpr.alias("tpr"), fpr.alias("fpr"))
    own = point(F.col("score"), F.col("pos_to") / F.col("pos_all"), F.col("neg_to") / F.col("neg_all"))
    origin = F.when(first, point(F.lit(float("inf")), F.lit(0.0), F.lit(0.0)))
    points = F.explode(F.filter(F.array(own, origin), lambda x: x.isNotNull())).alias("x")
    return kept.select(*part, F.col("pos_all").alias("np"), F.col("neg_all").alias("nn"), points).select(*part, "np", "nn", "x.*")


def eer_of(counts: DataFrame, groups: Sequence[str] = (), splits: Sequence[float] = EVERYTHING) -> DataFrame:
    """Equal error rate in percent and its threshold; groups with one class are left out.

    The point of the smallest gap, of equal ones that of the highest score, is a partial aggregate.
    """
    gap = F.abs(1 - F.col("tpr") - F.col("fpr"))
    best = F.min(F.struct(gap.alias("gap"), (-F.col("score")).alias("down"), "score", "tpr", "fpr", "np", "nn")).alias("best")
    found = roc_points(counts, groups, splits).groupBy(ALL, *groups).agg(best).select(*groups, "best.*")
    return found.select(
        *groups, F.round(100 * (F.col("fpr") + 1 - F.col("tpr")) / 2, 6).alias("eer_pct"), F.round("score", 6).alias("threshold"),
        F.col("np").alias("n_pos"), F.col("nn").alias("n_neg"),
    )


def eer(rows: DataFrame, groups: Sequence[str] = (), y: str = "y", score: str = "p") -> DataFrame:
    splits = bounds(rows, score)
    return eer_of(by_score(rows, groups, y, score, splits), groups, splits)


def auc(rows: DataFrame, groups: Sequence[str] = (), y: str = "y", score: str = "p") -> DataFrame:
    """Area under the ROC curve by mid-ranks; null where one class is missing."""
    splits = bounds(rows, score)
    c = running(by_score(rows, groups, y, score, splits), "score", ["pos", "neg"], groups, splits)
    area = F.sum(F.col("pos") * (F.col("neg_to") - F.col("neg") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return c.groupBy(ALL, *groups).agg(
        F.round(F.when(pairs > 0, area / pairs), 6).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    ).drop(ALL)


def confusion(rows: DataFrame, threshold: Column, groups: Sequence[str] = (), y: str = "y", score: str = "p") -> DataFrame:
    """Confusion counts and ratios of ``score >= threshold``."""
    hit, real = F.col(score) >= threshold, F.col(y) == 1
    counted = rows.groupBy(*groups).agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & ~real).alias("tn"), F.count_if(~hit & real).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return counted.select(
        *groups, "tp", "fp", "tn", "fn",
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(tp, tp + fn).alias("recall"),
        ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def rates_at(rows: DataFrame, thresholds: dict[str, Column], groups: Sequence[str], y: str = "y", score: str = "p") -> DataFrame:
    """Share of each class at or above named thresholds, overall and per group by grouping sets."""
    shares = [
        F.round(F.avg(F.when(F.col(y) == k, (F.col(score) >= t).cast("int"))), 6).alias(f"{kind}_{name}")
        for name, t in thresholds.items() for k, kind in ((0, "flagged"), (1, "caught"))
    ]
    return rows.groupingSets([[], *[[F.col(g)] for g in groups]], *[F.col(g) for g in groups]).agg(F.count(F.lit(1)).alias("n"), *shares)
