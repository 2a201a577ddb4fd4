"""Queries on protocols, channels, decision times, masks and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import decisions, metrics, prefix, sampling
from .detection import eer_sql
from .relations import byte
from .roles import CHUNKS, CLIPS, SCORES, chunks, clips, scores, table


def label_attack_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose label and attack disagree: a genuine one with an attack, or a fake one without."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("fake"),
        F.when(F.col("l_linenumber") == 1, "-").otherwise(F.concat(F.lit("A"), F.col("l_linenumber").cast("string"))).alias("attack"),
    )
    return rows.where(F.col("fake") != (F.col("attack") != "-")).groupBy("attack").agg(F.count(F.lit(1)).alias("conflicts"))


def format_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Clips per speaker that are not of the expected format; a missing format is a mismatch too."""
    wrong = ~F.col("dataset").eqNullSafe("en")
    return clips(spark, sf).groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("mismatches"))


def half_half_sample(spark: SparkSession, sf: str) -> DataFrame:
    """100 clips of each label, in hash order."""
    labelled = clips(spark, sf).where("label is not null")
    return sampling.stratified(labelled, "doc_id", "label", 100, 3).select("doc_id", F.col("label").cast("int").alias("label"), "nth")


def channel_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per channel (codec/transmission) and per attack beside all genuine rows: EER, and shares at the global threshold.

    Parts with fewer than 20 rows of a class are left out.
    """
    channel = F.concat(F.col("grp"), F.lit("/"), (F.col("speaker") % 3).cast("string"))
    rows = scores(spark, sf).withColumn("part", channel)
    splits, attacks = prefix.bounds(rows, "p"), rows.where("attack <> '-'").select("attack").distinct()
    parts = metrics.fanned(metrics.by_score(rows, ["part", "attack"], splits=splits), "attack", attacks, beside=["part"])
    found = metrics.eer_of(parts.withColumnRenamed("attack", "part"), ["part"], splits)
    at = metrics.eer_of(metrics.by_score(rows, splits=splits), (), splits).select(F.col("threshold").alias("at"))
    # shares from the rows themselves: a row per channel and attack is left before the fan-out
    hit = lambda c: F.sum(F.when(F.col("p") >= F.col("at"), c).otherwise(0)).alias
    y, z = F.col("y"), 1 - F.col("y")
    counts = rows.crossJoin(F.broadcast(at)).groupBy("part", "attack").agg(
        hit(y)("hit_pos"), hit(z)("hit_neg"), F.sum(y).alias("pos"), F.sum(z).alias("neg")
    )
    sums = metrics.fanned(counts, "attack", attacks, beside=["part"], sums=["hit_pos", "hit_neg", "pos", "neg"])
    rates = sums.where("pos >= 20 and neg >= 20").select(
        F.col("attack").alias("part"), F.round(F.col("hit_neg") / F.col("neg"), 6).alias("flagged"), F.round(F.col("hit_pos") / F.col("pos"), 6).alias("caught")
    )
    return rates.join(found, "part")


def per_mille_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """Missed fakes, asked and blocked genuine rows per 1000 at each decision time, thresholds from all genuine rows."""
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") * 2).cast("int").alias("t"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        (F.col("l_quantity") / 50).alias("p"),
    )
    cuts = prefix.quantiles(rows.where("y = 0"), "p", [0.95, 0.99]).select(
        F.round(F.col("q")[0], 6).alias("verify"), F.round(F.col("q")[1], 6).alias("block")
    )
    mille = lambda k, c: F.round(1000 * F.avg(F.when(F.col("y") == k, c.cast("int"))), 4)
    p, verify, block = F.col("p"), F.col("verify"), F.col("block")
    return rows.crossJoin(cuts).groupBy("t").agg(
        F.count(F.lit(1)).alias("n"), mille(1, p < verify).alias("missed"),
        mille(0, (p >= verify) & (p < block)).alias("asked"), mille(0, p >= block).alias("blocked"),
    )


def weight_scan_best(spark: SparkSession, sf: str) -> DataFrame:
    """One weight between two branches out of 21: the first of the smallest EER. Cells meet the weights, not rows."""
    weights = spark.range(21).select((F.col("id") / 20).alias("weight"))
    cells = scores(spark, sf).groupBy("a", "c").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    fused = F.round(F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("c"), 6)
    counts = cells.crossJoin(weights).groupBy("weight", fused.alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = metrics.eer_of(counts, ["weight"])
    return found.agg(F.min(F.struct("eer_pct", "weight")).alias("best")).select("best.eer_pct", "best.weight")


def seed_mean_eer(spark: SparkSession, sf: str) -> DataFrame:
    """EER of the scores averaged over the runs of a clip."""
    return metrics.eer(scores(spark, sf).groupBy("clip", "y").agg(F.round(F.avg("p"), 6).alias("p")))


def fusion_top(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best weight triples of the whole grid, and every single branch."""
    grid = decisions.grid_eer(scores(spark, sf), 20).select("wa", "wb", "wc", "eer_pct")
    single = grid.where(F.greatest("wa", "wb", "wc") == 20)
    return grid.orderBy("eer_pct", "wa", "wb", "wc").limit(20).union(single).distinct()


def burst_loss_mask(spark: SparkSession, sf: str) -> DataFrame:
    """A two-state chain per call: good turns bad below 0.1 of a hash draw, bad turns good below 0.3.

    A draw below 0.1 flips the state, one up to 0.3 leaves it good, others keep it; so the state is
    the parity of the flips since the last draw that left it good.
    """
    order = Window.partitionBy("call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    draw = sampling.digest_byte(F.md5(F.concat(F.lit("loss:"), F.col("call_id").cast("string"), F.lit(":"), F.col("seq").cast("string"))), 0)
    rows = chunks(spark, sf).select("call_id", "seq", draw.alias("u")).withColumn("flips", F.sum((F.col("u") < 26).cast("int")).over(order))
    rows = rows.withColumn("before", F.max(F.when((F.col("u") >= 26) & (F.col("u") < 77), F.col("flips"))).over(order))
    return rows.select("call_id", "seq", ((F.col("flips") - F.coalesce("before", F.lit(0))) % 2 == 1).alias("lost"))


def serving_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Starts of windows of 4 s every 3 s; a shorter clip has one at 0."""
    n = F.floor("seconds").cast("int")
    starts = F.when(n < 4, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - 4, F.lit(0)), F.lit(3)))
    return clips(spark, sf).where("seconds is not null").select("doc_id", F.explode(starts).alias("start"))


def shuffled_windows(spark: SparkSession, sf: str) -> DataFrame:
    """For two epochs a window of 4 s inside each clip's first 10 s, and the key that an epoch is ordered by."""
    rows = clips(spark, sf).where("seconds is not null").select("doc_id", "seconds", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    key = F.md5(F.concat_ws(":", F.col("epoch").cast("string"), F.col("doc_id").cast("string")))
    room = F.greatest(F.least("seconds", F.lit(10.0)) - 4, F.lit(0.0))
    return rows.select("doc_id", "epoch", F.round(room * sampling.digest_byte(key, 0) / 256, 4).alias("start"), key.alias("place"))


def quiet_quarter(spark: SparkSession, sf: str) -> DataFrame:
    """Mean level of the quietest and of the loudest quarter of each call's chunks, three at least."""
    by = Window.partitionBy("call_id")
    rows = chunks(spark, sf).withColumns(
        {
            "take": F.greatest(F.floor(F.count(F.lit(1)).over(by) / 4), F.lit(3)),
            "low": F.row_number().over(by.orderBy("p", "seq")), "high": F.row_number().over(by.orderBy(F.desc("p"), F.desc("seq"))),
        }
    )
    mean = lambda c: F.round(F.avg(F.when(F.col(c) <= F.col("take"), F.col("p"))) + 1e-7, 4)
    return rows.groupBy("call_id").agg(mean("low").alias("quiet"), mean("high").alias("loud"))


def category_union(spark: SparkSession, sf: str) -> DataFrame:
    """Per call the categories that either of two judges names, sorted."""
    named = lambda c: F.collect_set(F.when(c, F.col("kind")))
    sets = chunks(spark, sf).groupBy("call_id").agg(named(F.col("p") >= 100).alias("first"), named(F.col("seq") % 5 == 0).alias("second"))
    return sets.select("call_id", F.array_join(F.array_sort(F.array_union("first", "second")), ",").alias("categories"))


def chunk_sequence_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per call, in order of time: different chunks, repeats, and chunks that come after a later number."""
    sent = chunks(spark, sf).select("call_id", "seq", "ts")
    arrived = sent.union(sent.where("seq % 7 = 0"))
    counted = arrived.groupBy("call_id", "seq").agg(F.count(F.lit(1)).alias("times"), F.min("ts").alias("ts"))
    before = Window.partitionBy("call_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.max("seq").over(before) > F.col("seq"), F.lit(False))
    return counted.withColumn("late", late).groupBy("call_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(F.col("times") - 1).alias("repeats"), F.count_if("late").alias("late")
    )


_FAN = """parts AS (SELECT y, p, grp || '/' || (speaker % 3)::VARCHAR AS part, attack FROM scores),
fan AS (SELECT y, p, part FROM parts UNION ALL SELECT y, p, attack FROM parts WHERE attack <> '-'
        UNION ALL SELECT s.y, s.p, k.attack FROM parts s, (SELECT DISTINCT attack FROM parts WHERE attack <> '-') k WHERE s.attack = '-')"""
_GRID = f"""w AS (SELECT a.x AS wa, b.x AS wb, 20 - a.x - b.x AS wc FROM range(21) a(x), range(21) b(x) WHERE a.x + b.x <= 20),
cells AS (SELECT a, b, c, y, count(*) AS n FROM scores GROUP BY a, b, c, y),
s AS (SELECT wa, wb, wc, y * n AS y, (1 - y) * n AS z, round((a * wa + b * wb + c * wc) / 20, 6) AS p FROM cells, w), {eer_sql('s', 'wa, wb, wc').replace('sum(1 - y)', 'sum(z)')}"""

ENTRIES = {
    "label_attack_conflicts": (label_attack_conflicts, "WITH r AS (SELECT l_returnflag = 'R' AS fake, CASE WHEN l_linenumber = 1 THEN '-' ELSE 'A' || l_linenumber::VARCHAR END AS attack FROM lineitem) SELECT attack, count(*) AS conflicts FROM r WHERE fake <> (attack <> '-') GROUP BY attack"),
    "format_mismatch": (format_mismatch, f"WITH {CLIPS} SELECT speaker, count(*) AS n, count(*) FILTER (WHERE dataset IS DISTINCT FROM 'en') AS mismatches FROM clips GROUP BY speaker"),
    "half_half_sample": (half_half_sample, f"WITH {CLIPS} SELECT doc_id, label::INT AS label, nth FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3|' || doc_id::VARCHAR), doc_id) AS nth FROM clips WHERE label IS NOT NULL) WHERE nth <= 100"),
    "channel_report": (channel_report, f"WITH {SCORES}, {_FAN}, {eer_sql('scores', name='g')}, {eer_sql('fan', 'part')}, r AS (SELECT part, round(avg(CASE WHEN y = 0 THEN (p >= threshold)::INT END), 6) AS flagged, round(avg(CASE WHEN y = 1 THEN (p >= threshold)::INT END), 6) AS caught FROM fan, g GROUP BY part HAVING sum(y) >= 20 AND sum(1 - y) >= 20) SELECT * FROM r JOIN e USING (part)"),
    "per_mille_by_time": (per_mille_by_time, "WITH r AS (SELECT (l_linenumber * 2)::INT AS t, (l_returnflag = 'R')::INT AS y, l_quantity / 50 AS p FROM lineitem), q AS (SELECT round(quantile_cont(p, 0.95), 6) AS v, round(quantile_cont(p, 0.99), 6) AS k FROM r WHERE y = 0) SELECT t, count(*) AS n, round(1000 * avg(CASE WHEN y = 1 THEN (p < v)::INT END), 4) AS missed, round(1000 * avg(CASE WHEN y = 0 THEN (p >= v AND p < k)::INT END), 4) AS asked, round(1000 * avg(CASE WHEN y = 0 THEN (p >= k)::INT END), 4) AS blocked FROM r, q GROUP BY t"),
    "weight_scan_best": (weight_scan_best, f"WITH {SCORES}, f AS (SELECT y, i / 20 AS weight, round(i / 20 * a + (1 - i / 20) * c, 6) AS p FROM scores, range(21) w(i)), {eer_sql('f', 'weight')} SELECT eer_pct, weight FROM e ORDER BY eer_pct, weight LIMIT 1"),
    "seed_mean_eer": (seed_mean_eer, f"WITH {SCORES}, m AS (SELECT clip, y, round(avg(p), 6) AS p FROM scores GROUP BY clip, y), {eer_sql('m')} SELECT * FROM e"),
    "burst_loss_mask": (burst_loss_mask, f"""WITH {CHUNKS}, u AS (SELECT call_id, seq, {byte("'loss:' || call_id::VARCHAR || ':' || seq::VARCHAR", 0)} AS u FROM chunks),
 f AS (SELECT *, sum((u < 26)::INT) OVER w AS flips FROM u WINDOW w AS (PARTITION BY call_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, max(CASE WHEN u >= 26 AND u < 77 THEN flips END) OVER w AS before FROM f WINDOW w AS (PARTITION BY call_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
 SELECT call_id, seq, (flips - coalesce(before, 0)) % 2 = 1 AS lost FROM b"""),
    "serving_windows": (serving_windows, f"WITH {CLIPS}, n AS (SELECT doc_id, floor(seconds)::INT AS n FROM clips WHERE seconds IS NOT NULL) SELECT doc_id, unnest(CASE WHEN n < 4 THEN [0] ELSE range(0, n - 3, 3) END)::INT AS start FROM n"),
    "shuffled_windows": (shuffled_windows, f"WITH {CLIPS}, k AS (SELECT doc_id, epoch::INT AS epoch, seconds, md5(epoch::VARCHAR || ':' || doc_id::VARCHAR) AS place FROM clips, range(2) e(epoch) WHERE seconds IS NOT NULL) SELECT doc_id, epoch, round(greatest(least(seconds, 10) - 4, 0) * {byte("epoch::VARCHAR || ':' || doc_id::VARCHAR", 0)} / 256, 4) AS start, place FROM k"),
    "quiet_quarter": (quiet_quarter, f"WITH {CHUNKS}, r AS (SELECT *, greatest(count(*) OVER (PARTITION BY call_id) // 4, 3) AS take, row_number() OVER (PARTITION BY call_id ORDER BY p, seq) AS low, row_number() OVER (PARTITION BY call_id ORDER BY p DESC, seq DESC) AS high FROM chunks) SELECT call_id, round(avg(p) FILTER (WHERE low <= take) + 1e-7, 4) AS quiet, round(avg(p) FILTER (WHERE high <= take) + 1e-7, 4) AS loud FROM r GROUP BY call_id"),
    "category_union": (category_union, f"WITH {CHUNKS} SELECT call_id, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind) FILTER (WHERE p >= 100 OR seq % 5 = 0), '') AS categories FROM chunks GROUP BY call_id"),
    "chunk_sequence_audit": (chunk_sequence_audit, f"WITH {CHUNKS}, c AS (SELECT call_id, seq, count(*) + count(*) FILTER (WHERE seq % 7 = 0) AS times, min(ts) AS ts FROM chunks GROUP BY call_id, seq), l AS (SELECT *, coalesce(max(seq) OVER (PARTITION BY call_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > seq, false) AS late FROM c) SELECT call_id, count(*) AS chunks, sum(times - 1)::BIGINT AS repeats, count(*) FILTER (WHERE late) AS late FROM l GROUP BY call_id"),
    "fusion_top": (fusion_top, f"""WITH {SCORES}, {_GRID}, e20 AS (SELECT wa, wb, wc, eer_pct FROM e)
 (SELECT * FROM e20 ORDER BY eer_pct, wa, wb, wc LIMIT 20) UNION SELECT * FROM e20 WHERE greatest(wa, wb, wc) = 20"""),
}
