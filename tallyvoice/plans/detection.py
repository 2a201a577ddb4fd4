"""Queries on scored clips: error rates, thresholds, breakdowns, resampling, fusion."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import decisions, metrics, prefix, sampling, splits
from .roles import CHUNKS, SCORES, chunks, scores

FPRS = {"verify": 0.05, "block": 0.01}
GRID = (2.0, 4.0, 6.0, 8.0, 10.0)


def eer_sql(source: str, groups: str = "", y: str = "y", p: str = "p", name: str = "e") -> str:
    """CTEs that leave the equal error rate of ``source`` (y, p, groups) in ``name``."""
    g = f"{groups}, " if groups else ""
    by = f"PARTITION BY {groups} " if groups else ""
    return f"""
{name}_p AS (SELECT {g}{p} AS score, sum({y})::DOUBLE AS pos, sum(1 - {y})::DOUBLE AS neg FROM {source} GROUP BY {g}{p}),
{name}_c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {name}_p
             WINDOW w AS ({by}ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
{name}_d AS (SELECT *, lag(tp) OVER o AS tp0, lead(tp) OVER o AS tp2, lag(fp) OVER o AS fp0, lead(fp) OVER o AS fp2,
             max(tp) OVER (PARTITION BY {groups or '1'}) AS np, max(fp) OVER (PARTITION BY {groups or '1'}) AS nn FROM {name}_c
             WINDOW o AS ({by}ORDER BY score DESC)),
{name}_k AS (SELECT {g}score, np, nn, tp / np AS tpr, fp / nn AS fpr FROM {name}_d
             WHERE np > 0 AND nn > 0 AND (tp0 IS NULL OR tp2 IS NULL OR tp2 - 2 * tp + tp0 <> 0 OR fp2 - 2 * fp + fp0 <> 0)),
{name}_z AS (SELECT * FROM {name}_k UNION ALL
             SELECT DISTINCT {g}'Infinity'::DOUBLE AS score, np, nn, 0::DOUBLE AS tpr, 0::DOUBLE AS fpr FROM {name}_k),
{name}_r AS (SELECT *, row_number() OVER ({by}ORDER BY abs(1 - tpr - fpr), score DESC) AS nth FROM {name}_z),
{name} AS (SELECT {g}round(100 * (fpr + 1 - tpr) / 2, 6) AS eer_pct, round(score, 6) AS threshold,
           np::BIGINT AS n_pos, nn::BIGINT AS n_neg FROM {name}_r WHERE nth = 1)"""


def eer_overall(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.eer(scores(spark, sf))


def auc_overall(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(scores(spark, sf))


def eer_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.eer(scores(spark, sf), ["grp"])


def eer_by_attack(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf)
    splits, attacks = prefix.bounds(rows, "p"), rows.where("attack <> '-'").select("attack").distinct()
    counts = metrics.fanned(metrics.by_score(rows, ["attack"], splits=splits), "attack", attacks)
    return metrics.eer_of(counts, ["attack"], splits)


def confusion_at_eer(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf)
    at = metrics.eer(rows).select("threshold")
    return metrics.confusion(rows.crossJoin(at), F.col("threshold"))


def channel_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """Per speaker with 20 of each class: EER, and shares flagged and caught at the global threshold."""
    rows = scores(spark, sf).withColumn("grp", F.concat(F.lit("s"), (F.col("speaker") % 7).cast("string")))
    at = metrics.eer(rows).select("threshold")
    rates = metrics.confusion(rows.crossJoin(at), F.col("threshold"), ["grp"]).where("tp + fn >= 20 and fp + tn >= 20")
    return rates.select("grp", F.col("recall").alias("caught"), F.col("fpr").alias("flagged")).join(
        metrics.eer(rows, ["grp"]), "grp"
    )


def thresholds_of(rows: DataFrame) -> DataFrame:
    """Named thresholds as exact quantiles of the genuine scores (one row)."""
    return prefix.quantiles(rows.where("y = 0"), "p", [1 - f for f in FPRS.values()]).select(
        F.col("n").alias("n_genuine"), *[F.round(F.col("q")[i], 6).alias(name) for i, name in enumerate(FPRS)]
    )


def policy_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """With the check that the genuine rows suffice for the smallest rate."""
    return thresholds_of(scores(spark, sf)).withColumn("enough", F.col("n_genuine") >= 10 / min(FPRS.values()))


def threshold_rates_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf)
    met = rows.crossJoin(thresholds_of(rows).select("verify", "block"))
    return metrics.rates_at(met, {n: F.col(n) for n in FPRS}, ["grp"])


def calibrate_halves(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds from speakers of half A, rates on both halves."""
    rows = scores(spark, sf).withColumn("half", F.when(sampling.half_a(F.col("speaker")), "A").otherwise("B"))
    met = rows.crossJoin(thresholds_of(rows.where("half = 'A'")).select("verify", "block"))
    return metrics.rates_at(met, {n: F.col(n) for n in FPRS}, ["half"]).where("half is not null")


SPLITS = 20


def repeated_split_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Both classes' rates at both thresholds on the other half, over salted splits of the speakers."""
    rows = scores(spark, sf).select("speaker", "y", "p")
    half = lambda k: sampling.digest_byte(F.md5(F.concat(F.lit(f"{k}:"), F.col("speaker").cast("string"))), 0) % 2
    mask = sum((half(k) * (1 << k) for k in range(1, SPLITS)), half(0))
    # the count keeps filters on the mask, and so its digests, from moving to the rows
    masks = rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("n")).select("speaker", F.when(F.col("n") > 0, mask).alias("mask"))
    found = splits.rates_over_splits(rows, masks, SPLITS, [1 - f for f in FPRS.values()])
    names = {f"{n}_{kind}": F.max(F.when(F.col("i") == i, F.col(kind))) for i, n in enumerate(FPRS) for kind in ("flagged", "caught")}
    rates = found.groupBy("seed").agg(*[c.alias(n) for n, c in names.items()])
    return rates.agg(
        F.count(F.lit(1)).alias("splits"),
        *[F.round(f(c), 6).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
    )


def call_threshold_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds for several false-alarm budgets from half A, rates on half B."""
    rows = scores(spark, sf).withColumn("in_a", sampling.half_a(F.col("speaker")))
    budgets = [0.01, 0.02, 0.05, 0.1]
    cut = prefix.quantiles(rows.where("y = 0 and in_a"), "p", [1 - b for b in budgets]).select(
        F.posexplode("q").alias("i", "cut")
    ).select(F.get(F.array(*[F.lit(b) for b in budgets]), "i").alias("budget"), F.round("cut", 6).alias("cut"))
    counted = rows.where("not in_a").groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("p") >= F.col("cut"), F.col("n")).otherwise(0)
    share = lambda k: F.round(F.sum(F.when(F.col("y") == k, hit)) / F.sum(F.when(F.col("y") == k, F.col("n"))), 6)
    return counted.crossJoin(F.broadcast(cut)).groupBy("budget", "cut").agg(share(0).alias("flagged"), share(1).alias("caught"))


REPLICATES = 1000


def poisson(mean: Column, z: Column) -> Column:
    """The Poisson count at a standard normal ``z``, by the first terms of its Cornish-Fisher expansion.

    Its chances are within 0.01 of the law's from a mean of 1 on, and closer for larger means.
    """
    return F.greatest(F.floor(mean + F.sqrt(mean) * z + (z * z - 1) / 6 + 0.5), F.lit(0).cast("long"))


def normal(digest: Column) -> Column:
    """A standard normal number from a digest (Box and Muller's form)."""
    one = (sampling.digest_int(digest, 0, 4) + 0.5) / float(1 << 32)
    return F.sqrt(-2 * F.log(one)) * F.cos(2 * math.pi * sampling.uniform(digest, 4, 4))


def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the EER difference of branches c and a over replicates of the rows.

    Rows are first counted by (label, a, c). Drawing a class's rows with replacement draws about a
    Poisson number of each cell; the draws come from hashes, so they can be replayed, and cost cells
    times replicates, not rows.
    """
    cells = scores(spark, sf).groupBy("y", "a", "c").agg(F.count(F.lit(1)).alias("n"))
    reps = spark.range(REPLICATES).select(F.col("id").cast("int").alias("r"))
    name = F.concat_ws("|", "r", "y", F.round(F.col("a") * 1000).cast("long"), F.round(F.col("c") * 1000).cast("long"))
    drawn = cells.crossJoin(F.broadcast(reps)).withColumn("copies", poisson(F.col("n").cast("double"), normal(F.md5(name))))

    def one(branch: str, out: str) -> DataFrame:
        pos, neg = (F.sum(F.when(F.col("y") == k, F.col("copies")).otherwise(0)) for k in (1, 0))
        counts = drawn.groupBy("r", F.col(branch).alias("score")).agg(pos.alias("pos"), neg.alias("neg"))
        return metrics.eer_of(counts, ["r"]).select("r", F.col("eer_pct").alias(out))

    return interval(one("a", "first").join(one("c", "second"), "r"))


def interval(runs: DataFrame) -> DataFrame:
    """Mean, 2.5 and 97.5 percent quantiles of second less first, and the share of replicates above 0."""
    diff = F.col("second") - F.col("first")
    return runs.agg(
        F.count(F.lit(1)).alias("replicates"), F.round(F.avg(diff), 4).alias("mean_diff"),
        F.round(F.percentile(diff, F.lit(0.025)), 4).alias("low"), F.round(F.percentile(diff, F.lit(0.975)), 4).alias("high"),
        F.round(F.avg((diff > 0).cast("int")), 6).alias("share_above"),
    )


def multinomial(cells):
    """One replicate of one class: its rows drawn with replacement, as counts of its cells."""
    cells = cells.sort_values(["a", "c"])
    n = cells["n"].to_numpy()
    rng = np.random.default_rng([int(cells["r"].iloc[0]), int(cells["y"].iloc[0])])
    return cells.assign(copies=rng.multinomial(n.sum(), n / n.sum()))


def bootstrap_full(spark: SparkSession, sf: str, replicates: int = 1000) -> DataFrame:
    """The reference's paired bootstrap: rows of each class drawn with replacement, 1000 replicates.

    Drawing rows is a multinomial draw over the class's cells (y, a, c), so it costs cells, not rows.
    """
    cells = scores(spark, sf).groupBy("y", "a", "c").agg(F.count(F.lit(1)).alias("n"))
    reps = spark.range(replicates).select(F.col("id").cast("int").alias("r"))
    met = cells.crossJoin(F.broadcast(reps)).select("r", "y", "a", "c", "n")
    drawn = met.groupBy("r", "y").applyInPandas(multinomial, "r int, y int, a double, c double, n long, copies long")

    def one(branch: str, out: str) -> DataFrame:
        pos, neg = (F.sum(F.when(F.col("y") == k, F.col("copies")).otherwise(0)) for k in (1, 0))
        counts = drawn.groupBy("r", F.col(branch).alias("score")).agg(pos.alias("pos"), neg.alias("neg")).where("pos + neg > 0")
        return metrics.eer_of(counts, ["r"]).select("r", F.col("eer_pct").alias(out))

    return interval(one("a", "first").join(one("c", "second"), "r"))


def fusion_grid_best(spark: SparkSession, sf: str) -> DataFrame:
    """Weights in steps of 0.05, 231 triples."""
    return decisions.closest_to_uniform(decisions.grid_eer(scores(spark, sf), 20))


def gated_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).withColumn("p", F.round(decisions.gated(F.col("a"), F.col("c"), F.col("b"), 0.2, 0.8), 6))
    return metrics.eer(rows, ["grp"])


def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).withColumn("p", F.round(decisions.fuse({"a": 0.25, "b": 0.25, "c": 0.5}), 6))
    return rows.groupBy("grp", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


def risk_ladder(spark: SparkSession, sf: str) -> DataFrame:
    level = decisions.risk_level(F.col("p"))
    return scores(spark, sf).select(level.alias("level"), decisions.action_of(level).alias("action"), "y").groupBy("level", "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_fake")
    )


def action_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf)
    voice = decisions.action_of(decisions.risk_level(F.col("p")))
    intent = F.when(F.col("a") >= 0.8, "high").when(F.col("a") >= 0.4, "caution").otherwise("none")
    rows = rows.select(voice.alias("voice"), intent.alias("intent"))
    return rows.groupBy("voice", "intent", decisions.combined_action(F.col("voice"), F.col("intent")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def score_report(spark: SparkSession, sf: str) -> DataFrame:
    """Precision, recall and F1 per group at one half."""
    return metrics.confusion(scores(spark, sf), F.lit(0.5), ["grp"])


def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Ten score bins: mean score, share of fakes, and each bin's part of the calibration error."""
    binned = scores(spark, sf).withColumn("bin", F.least(F.floor(F.round(F.col("p") * 10, 6)), F.lit(9).cast("long")))
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("share_fake"),
        F.round(F.abs(F.avg("p") - F.avg("y")) * F.count(F.lit(1)) / total, 6).alias("error_part"),
    )


def flag_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """P(fake given flag) at base rates, from the likelihood ratio of caught to flagged."""
    rates = metrics.confusion(scores(spark, sf), F.lit(0.5)).select(F.col("recall").alias("caught"), F.col("fpr").alias("flagged"))
    base = spark.createDataFrame([(0.001,), (0.01,), (0.1,)], "base double")
    up = F.col("caught") * F.col("base")
    return rates.crossJoin(F.broadcast(base)).select("base", F.round(up / (up + F.col("flagged") * (1 - F.col("base"))), 6).alias("posterior"))


def weighted_draw(spark: SparkSession, sf: str) -> DataFrame:
    """A weighted sample with replacement: 200 hash draws over classes of weight 1/count, rows by hash place."""
    rows = scores(spark, sf).groupBy("attack").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy().orderBy("attack")
    slots = rows.withColumns({"k": F.row_number().over(order) - 1, "classes": F.count(F.lit(1)).over(Window.partitionBy())})
    draws = spark.range(200).select(F.md5(F.concat(F.lit("draw:"), F.col("id").cast("string"))).alias("d"))
    draws = draws.select(sampling.uniform(F.col("d"), 0, 2).alias("u"))
    met = draws.crossJoin(F.broadcast(slots)).where((F.col("u") * F.col("classes") >= F.col("k")) & (F.col("u") * F.col("classes") < F.col("k") + 1))
    return met.groupBy("attack").agg(F.count(F.lit(1)).alias("drawn"))


def time_to_decision_curve(spark: SparkSession, sf: str) -> DataFrame:
    """EER of the mean score of the chunks so far, at each time of the grid (10 chunks to the second)."""
    order = Window.partitionBy("call_id").orderBy("ts", "seq")
    rows = chunks(spark, sf).withColumns({"k": F.row_number().over(order), "y": (F.col("call_id") % 2).cast("int")})
    mean = F.avg("p").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"end_s": F.col("k") / 5, "mean_p": F.round(mean / 500, 6)})
    grid = spark.createDataFrame([(t,) for t in GRID], "t double")
    met = rows.join(F.broadcast(grid), F.col("end_s") <= F.col("t")).groupBy("call_id", "y", "t").agg(
        F.max_by("mean_p", "k").alias("p")
    )
    return metrics.eer(met, ["t"])


_Q = "quantile_cont(p, {}) FILTER (WHERE y = 0{})"
_MD5 = "('0x' || substr(md5({}), {}, 2))::BIGINT"

_RATES = [f"{n}_{k}" for n in FPRS for k in ("flagged", "caught")]
_SPLITS = f"""WITH {SCORES}, s AS (SELECT *, {_MD5.format("seed::VARCHAR || ':' || speaker::VARCHAR", 1)} % 2 AS half FROM scores, range({SPLITS}) r(seed)),
 c AS (SELECT seed, round(quantile_cont(p, 0.95), 6) AS verify, round(quantile_cont(p, 0.99), 6) AS block FROM s WHERE half = 0 AND y = 0 GROUP BY seed),
 r AS (SELECT seed, {", ".join(f"avg((p >= {n})::INT) FILTER (WHERE y = {k}) AS {n}_{kind}" for n in FPRS for k, kind in ((0, "flagged"), (1, "caught")))}
       FROM s JOIN c USING (seed) WHERE half = 1 GROUP BY seed)
 SELECT count(*) AS splits, {", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in _RATES for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))} FROM r"""
_NAME = "r::VARCHAR || '|' || y::VARCHAR || '|' || round(a * 1000)::BIGINT::VARCHAR || '|' || round(c * 1000)::BIGINT::VARCHAR"
_WORD = lambda at: "(" + " + ".join(f"{256**k} * {_MD5.format('name', 2 * (at + k) + 1)}" for k in range(4)) + ")"
_BOOTSTRAP = f"""WITH {SCORES}, cells AS (SELECT y, a, c, count(*) AS n FROM scores GROUP BY y, a, c),
 m AS (SELECT r, y, a, c, n, {_NAME} AS name FROM cells, range({REPLICATES}) t(r)),
 z AS (SELECT r, y, a, c, n, sqrt(-2 * ln(({_WORD(0)} + 0.5) / 4294967296)) * cos(2 * pi() * ({_WORD(4)} / 4294967296)) AS z FROM m),
 d AS (SELECT r, y, a, c, greatest(floor(n + sqrt(n) * z + (z * z - 1) / 6 + 0.5), 0)::BIGINT AS w FROM z),
 da AS (SELECT r, y * w AS y1, (1 - y) * w AS y0, a AS p FROM d), dc AS (SELECT r, y * w AS y1, (1 - y) * w AS y0, c AS p FROM d),
 {eer_sql('da', 'r', 'y1', name='ea').replace('sum(1 - y1)', 'sum(y0)')}, {eer_sql('dc', 'r', 'y1', name='ec').replace('sum(1 - y1)', 'sum(y0)')},
 x AS (SELECT ec.eer_pct - ea.eer_pct AS diff FROM ea JOIN ec USING (r))
 SELECT count(*) AS replicates, round(avg(diff), 4) AS mean_diff, round(quantile_cont(diff, 0.025), 4) AS low, round(quantile_cont(diff, 0.975), 4) AS high,
 round(avg((diff > 0)::INT), 6) AS share_above FROM x"""
_FUSION = f"""WITH {SCORES}, w AS (SELECT a.x AS wa, b.x AS wb, 20 - a.x - b.x AS wc FROM range(21) a(x), range(21) b(x) WHERE a.x + b.x <= 20),
 s AS (SELECT wa, wb, wc, y, round((a * wa + b * wb + c * wc) / 20, 6) AS p FROM scores, w), {eer_sql('s', 'wa, wb, wc')},
 n AS (SELECT * FROM e WHERE round(eer_pct - (SELECT min(eer_pct) FROM e), 6) <= 0.05)
 SELECT * FROM n ORDER BY greatest(wa, wb, wc) - least(wa, wb, wc), eer_pct, wa, wb, wc LIMIT 1"""

ENTRIES = {
    "eer_overall": (eer_overall, f"WITH {SCORES}, {eer_sql('scores')} SELECT * FROM e"),
    "auc_overall": (auc_overall, f"""WITH {SCORES}, g AS (SELECT p, sum(y)::DOUBLE pos, sum(1 - y)::DOUBLE neg FROM scores GROUP BY p),
 b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
 SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM b"""),
    "eer_by_group": (eer_by_group, f"WITH {SCORES}, {eer_sql('scores', 'grp')} SELECT * FROM e"),
    "eer_by_attack": (eer_by_attack, f"""WITH {SCORES}, fan AS (SELECT y, p, attack FROM scores WHERE attack <> '-' UNION ALL
 SELECT s.y, s.p, a.attack FROM scores s, (SELECT DISTINCT attack FROM scores WHERE attack <> '-') a WHERE s.attack = '-'),
 {eer_sql('fan', 'attack')} SELECT * FROM e"""),
    "confusion_at_eer": (confusion_at_eer, f"""WITH {SCORES}, {eer_sql('scores')}, n AS (
 SELECT count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE p >= threshold AND y = 0) AS fp,
        count(*) FILTER (WHERE p < threshold AND y = 0) AS tn, count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM scores, e)
 SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall,
        round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n"""),
    "channel_breakdown": (channel_breakdown, f"""WITH {SCORES}, s AS (SELECT y, p, 's' || (speaker % 7)::VARCHAR AS grp FROM scores),
 {eer_sql('s')}, {eer_sql('s', 'grp', name='g')},
 r AS (SELECT grp, round(avg((p >= threshold)::INT) FILTER (WHERE y = 1), 6) AS caught, round(avg((p >= threshold)::INT) FILTER (WHERE y = 0), 6) AS flagged
       FROM s, e GROUP BY grp HAVING sum(y) >= 20 AND sum(1 - y) >= 20)
 SELECT g.grp, caught, flagged, eer_pct, threshold, n_pos, n_neg FROM r JOIN g USING (grp)"""),
    "policy_thresholds": (policy_thresholds, f"""WITH {SCORES} SELECT count(*) FILTER (WHERE y = 0) AS n_genuine,
 round({_Q.format(0.95, '')}, 6) AS verify, round({_Q.format(0.99, '')}, 6) AS block, count(*) FILTER (WHERE y = 0) >= 1000 AS enough FROM scores"""),
    "threshold_rates_sets": (threshold_rates_sets, f"""WITH {SCORES}, t AS (SELECT round({_Q.format(0.95, '')}, 6) AS verify, round({_Q.format(0.99, '')}, 6) AS block FROM scores)
 SELECT grp, count(*) AS n, round(avg((p >= verify)::INT) FILTER (WHERE y = 0), 6) AS flagged_verify, round(avg((p >= verify)::INT) FILTER (WHERE y = 1), 6) AS caught_verify,
 round(avg((p >= block)::INT) FILTER (WHERE y = 0), 6) AS flagged_block, round(avg((p >= block)::INT) FILTER (WHERE y = 1), 6) AS caught_block
 FROM scores, t GROUP BY GROUPING SETS ((), (grp))"""),
    "calibrate_halves": (calibrate_halves, f"""WITH {SCORES}, h AS (SELECT *, CASE WHEN {_MD5.format("'cal:' || speaker::VARCHAR", 1)} % 2 = 0 THEN 'A' ELSE 'B' END AS half FROM scores),
 t AS (SELECT round({_Q.format(0.95, " AND half = 'A'")}, 6) AS verify, round({_Q.format(0.99, " AND half = 'A'")}, 6) AS block FROM h)
 SELECT half, count(*) AS n, round(avg((p >= verify)::INT) FILTER (WHERE y = 0), 6) AS flagged_verify, round(avg((p >= verify)::INT) FILTER (WHERE y = 1), 6) AS caught_verify,
 round(avg((p >= block)::INT) FILTER (WHERE y = 0), 6) AS flagged_block, round(avg((p >= block)::INT) FILTER (WHERE y = 1), 6) AS caught_block
 FROM h, t GROUP BY half"""),
    "repeated_split_stats": (repeated_split_stats, _SPLITS),
    "call_threshold_curve": (call_threshold_curve, f"""WITH {SCORES}, h AS (SELECT *, {_MD5.format("'cal:' || speaker::VARCHAR", 1)} % 2 = 0 AS in_a FROM scores),
 b(budget) AS (VALUES (0.01::DOUBLE), (0.02), (0.05), (0.1)),
 c AS (SELECT 0.01::DOUBLE AS budget, round({_Q.format(0.99, ' AND in_a')}, 6) AS cut FROM h UNION ALL SELECT 0.02, round({_Q.format(0.98, ' AND in_a')}, 6) FROM h
       UNION ALL SELECT 0.05, round({_Q.format(0.95, ' AND in_a')}, 6) FROM h UNION ALL SELECT 0.1, round({_Q.format(0.9, ' AND in_a')}, 6) FROM h)
 SELECT budget, cut, round(avg((p >= cut)::INT) FILTER (WHERE y = 0), 6) AS flagged, round(avg((p >= cut)::INT) FILTER (WHERE y = 1), 6) AS caught
 FROM h, c WHERE NOT in_a GROUP BY budget, cut"""),
    "paired_bootstrap": (paired_bootstrap, _BOOTSTRAP),
    "fusion_grid_best": (fusion_grid_best, _FUSION),
    "gated_fusion": (gated_fusion, f"""WITH {SCORES}, s AS (SELECT y, grp, round((1 - (0.2::DOUBLE + (0.8::DOUBLE - 0.2::DOUBLE) * greatest(least(b, 1), 0))) * a + (0.2::DOUBLE + (0.8::DOUBLE - 0.2::DOUBLE) * greatest(least(b, 1), 0)) * c, 6) AS p FROM scores),
 {eer_sql('s', 'grp')} SELECT * FROM e"""),
    "weighted_fusion": (weighted_fusion, f"WITH {SCORES} SELECT grp, y, count(*) AS n, round(avg(round(0.25 * a + 0.25 * b + 0.5 * c, 6)), 6) AS mean_p FROM scores GROUP BY grp, y"),
    "risk_ladder": (risk_ladder, f"""WITH {SCORES} SELECT CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS level,
 CASE WHEN p >= 0.8 THEN 'escalate' WHEN p >= 0.5 THEN 'verify' ELSE 'allow' END AS action, count(*) AS n, sum(y)::BIGINT AS n_fake FROM scores GROUP BY 1, 2"""),
    "action_table": (action_table, f"""WITH {SCORES}, s AS (SELECT CASE WHEN p >= 0.8 THEN 'escalate' WHEN p >= 0.5 THEN 'verify' ELSE 'allow' END AS voice,
 CASE WHEN a >= 0.8 THEN 'high' WHEN a >= 0.4 THEN 'caution' ELSE 'none' END AS intent FROM scores)
 SELECT voice, intent, CASE WHEN intent <> 'high' THEN voice WHEN voice = 'allow' THEN 'verify' ELSE 'escalate' END AS action, count(*) AS n FROM s GROUP BY 1, 2, 3"""),
    "score_report": (score_report, f"""WITH {SCORES}, n AS (
 SELECT grp, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
        count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM scores GROUP BY grp)
 SELECT grp, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fn), 6) AS recall,
        round(fp / (fp + tn), 6) AS fpr, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n"""),
    "calibration_bins": (calibration_bins, f"""WITH {SCORES} SELECT least(floor(round(p * 10, 6)), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share_fake,
 round(abs(avg(p) - avg(y)) * count(*) / sum(count(*)) OVER (), 6) AS error_part FROM scores GROUP BY 1"""),
    "flag_posterior": (flag_posterior, f"""WITH {SCORES}, r AS (SELECT round(avg((p >= 0.5)::INT) FILTER (WHERE y = 1), 6) AS caught, round(avg((p >= 0.5)::INT) FILTER (WHERE y = 0), 6) AS flagged FROM scores),
 b(base) AS (VALUES (0.001::DOUBLE), (0.01), (0.1)) SELECT base, round(caught * base / (caught * base + flagged * (1 - base)), 6) AS posterior FROM r, b"""),
    "weighted_draw": (weighted_draw, f"""WITH {SCORES}, s AS (SELECT attack, row_number() OVER (ORDER BY attack) - 1 AS k, count(*) OVER () AS classes FROM (SELECT DISTINCT attack FROM scores)),
 d AS (SELECT ({_MD5.format("'draw:' || i::VARCHAR", 1)} + 256 * {_MD5.format("'draw:' || i::VARCHAR", 3)}) / 65536 AS u FROM range(200) t(i))
 SELECT attack, count(*) AS drawn FROM d JOIN s ON u * classes >= k AND u * classes < k + 1 GROUP BY attack"""),
    "time_to_decision_curve": (time_to_decision_curve, f"""WITH {CHUNKS}, r AS (SELECT call_id, call_id % 2 AS y, row_number() OVER o AS k, round(avg(p) OVER (PARTITION BY call_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / 500, 6) AS m
 FROM chunks WINDOW o AS (PARTITION BY call_id ORDER BY ts, seq)), g(t) AS (VALUES (2::DOUBLE), (4), (6), (8), (10)),
 s AS (SELECT call_id, y, t, max_by(m, k) AS p FROM r JOIN g ON k / 5 <= t GROUP BY call_id, y, t), {eer_sql('s', 't')} SELECT * FROM e"""),
    "fusion_grid_full": (fusion_grid_best, _FUSION),
    "repeated_split_full": (repeated_split_stats, _SPLITS),
    "bootstrap_full": (bootstrap_full, None),
}
