"""Queries on calibration, gates, branch weights, intent evaluation and channel statistics."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intent
from ..operators import calibration, decisions, metrics, prefix, sampling, spectra
from .detection import _MD5, FPRS, eer_sql
from .records import waves
from .roles import CHUNKS, SCORES, scores, table


def platt_map(spark: SparkSession, sf: str) -> DataFrame:
    """Slope and intercept after the fixed number of Newton's steps, and the calibration error before and after."""
    rows = scores(spark, sf)
    a, b = calibration.fit_logistic(metrics.by_score(rows), steps=STEPS, close=0.0)
    before = calibration.calibration_error(rows, F.col("p")).select(F.round("error", 6).alias("error_before"))
    after = calibration.calibration_error(rows, calibration.logistic(F.col("p"), a, b)).select(F.round("error", 6).alias("error_after"))
    return before.crossJoin(after).select(F.round(F.lit(a), 5).alias("slope"), F.round(F.lit(b), 5).alias("intercept"), "*")


STEPS = 6
STORED = {"verify": 0.9, "block": 0.97}


def calibrate_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Rates on half B at thresholds from half A and at stored ones; too few genuine rows in half A fail the job."""
    rows = scores(spark, sf).withColumn("in_a", sampling.half_a(F.col("speaker")))
    cut = checked_thresholds(rows.where("in_a")).withColumn("of", F.lit("half A"))
    stored = spark.createDataFrame([("stored", *STORED.values())], "of string, verify double, block double")
    b = rows.where("not in_a").select("y", "p").crossJoin(F.broadcast(cut.select("of", "verify", "block").union(stored)))
    share = lambda k, n: F.round(F.avg(F.when(F.col("y") == k, (F.col("p") >= F.col(n)).cast("int"))), 6)
    return b.groupBy("of", "verify", "block").agg(*[share(k, n).alias(f"{kind}_{n}") for n in FPRS for k, kind in ((0, "flagged"), (1, "caught"))])


def checked_thresholds(rows: DataFrame) -> DataFrame:
    """Thresholds as quantiles of the genuine scores; the job fails where they are too few for the smallest rate."""
    need = 10 / min(FPRS.values())
    message = F.concat(F.col("n").cast("string"), F.lit(f" genuine clips are too few, {need:g} are needed"))
    found = prefix.quantiles(rows.where("y = 0"), "p", [1 - f for f in FPRS.values()])
    return found.select(
        *[F.round(F.when(F.col("n") >= need, F.col("q")[i]).otherwise(F.raise_error(message).cast("double")), 6).alias(n) for i, n in enumerate(FPRS)]
    )


def source_selection(spark: SparkSession, sf: str) -> DataFrame:
    """1000 genuine clips and 200 of each attack; a shortage fails the job."""
    want = F.when(F.col("attack") == "-", 1000).otherwise(200)
    rows = scores(spark, sf).select("clip", "attack")
    # parts of about a million rows, however many there are
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 1_000_000 + 1)
    rows = rows.repartition(parts, "clip", "attack").distinct()
    return sampling.selected(rows, "clip", "attack", want).select("clip", "attack", "nth")


LOWS, HIGHS = (0.0, 0.1, 0.2), (0.5, 0.65, 0.8)


def gate_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of gate weights with its mean EER over three decision times, and the chosen one."""
    rows = scores(spark, sf).select("y", "a", F.col("c").alias("b"), F.col("b").alias("q"), (F.col("clip") % 3).alias("t"))
    return decisions.gate_grid(rows, LOWS, HIGHS)


def fusion_over_times(spark: SparkSession, sf: str) -> DataFrame:
    """Every triple of branch weights with its mean EER over three decision times, and the chosen one."""
    return decisions.fusion_over_times(scores(spark, sf).select("y", "a", "b", "c", (F.col("clip") % 3).alias("t")))


def branch_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Mean scores of the branches as weights per speaker, cut to two branches and to two others."""
    means = scores(spark, sf).groupBy("speaker").agg(*[F.avg(F.when(F.col("y") == 1, F.col(x))).alias(x) for x in "abc"])
    weights = F.map_filter(F.create_map(*[y for x in "abc" for y in (F.lit(x), F.col(x))]), lambda k, v: v.isNotNull())
    rows = means.select("speaker", weights.alias("w")).select(
        "speaker", decisions.renormalised(F.col("w"), ["a", "c"]).alias("ac"), decisions.renormalised(F.col("w"), ["b", "none"]).alias("bn")
    )
    return rows.select("speaker", F.round(F.col("ac")["a"], 6).alias("a"), F.round(F.col("ac")["c"], 6).alias("c"), F.round(F.col("bn")["b"], 6).alias("b"))


#: Rules on invented prose, for texts that no real rule would match.
PROSE_RULES = (("article", 0.2, (r"the [a-z]+ing", r"the [a-z]+ion")), ("pair", 0.3, (r"of the", r"in the")), ("join", 0.4, (r"and the", r"ing and")))


def intent_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Per language: how well the rules' score tells good from poor documents, and shares at each level by class."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.lower("text").alias("text"))
    rows = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    rows = intent.analyse(rows, "text", PROSE_RULES).select("lang", "y", F.col("score").alias("p"), "level")
    share = lambda k, holds: F.round(F.avg(F.when(F.col("y") == k, holds.cast("int"))), 6)
    told, high = F.col("level") != "none", F.col("level") == "high"
    shares = rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), share(1, told).alias("told_good"), share(0, told).alias("told_poor"), share(1, high).alias("high_good"), share(0, high).alias("high_poor")
    )
    return shares.join(metrics.auc(rows, ["lang"]).select("lang", "auc"), "lang")


#: 100 frames a second, as with real audio, over few samples.
SMALL = spectra.Framing(rate=400, frame=8, hop=4, size=16, seconds=0.2)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("call_id", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in rows.columns if c != "call_id"])


def channel_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The 35 statistics of each call's first samples."""
    return _rounded(spectra.channel_statistics(waves(spark, sf), SMALL))


def _sum(values: list[str]) -> str:
    return "(" + " + ".join(values) + ")" if values else "0"


def _channel_sql(s: spectra.Framing = SMALL) -> str:
    at, n = s.frequencies(), s.size // 2 + 1
    tilt = [i for i, f in enumerate(at) if spectra.TILT[0] <= f <= spectra.TILT[1]]
    khz = [at[i] * s.rate / 1000 for i in tilt]
    middle = sum(khz) / len(khz)
    spread = sum((f - middle) ** 2 for f in khz)
    pick = lambda name, holds: _sum([f"({name}[{i + 1}] + 1e-12)" for i, f in enumerate(at) if holds(f)])
    shape = lambda name: [
        (f"{name}_flatness", f"exp({_sum([f'ln({name}[{i + 1}] + 1e-12)' for i in range(n)])} / {n}) / ({pick(name, lambda f: True)} / {n})"),
        (f"{name}_centroid_khz", f"{_sum([f'({name}[{i + 1}] + 1e-12) * {at[i] * s.rate / 1000}' for i in range(n)])} / {pick(name, lambda f: True)}"),
        (f"{name}_low500", f"{pick(name, lambda f: f < spectra.LOW)} / {pick(name, lambda f: True)}"),
        (f"{name}_high3k", f"{pick(name, lambda f: f >= spectra.HIGH)} / {pick(name, lambda f: True)}"),
    ]
    tops = [f"mean[{i + 1}]" for i, f in enumerate(at) if f >= spectra.TOP]
    spectrum = [
        *shape("quiet"), *shape("loud"),
        ("ltas_slope_db_per_khz", _sum([f"10 * log10(mean[{i + 1}] + 1e-12) * {(f - middle) / spread!r}" for i, f in zip(tilt, khz, strict=True)])),
        ("hf_ratio_4k", f"{_sum(tops)} / ({_sum([f'mean[{i + 1}]' for i in range(n)])} + 1e-12)"),
    ]
    band = lambda b: f"coalesce(sum(power) FILTER (WHERE hz >= {b[0]} AND hz < {b[1]}), 0)"
    mod = [("mod_" + "_".join(f"{x:g}".replace(".", "p") for x in b), f"{band(b)} / ({band(spectra.WHOLE_BAND)} + 1e-12)") for b in spectra.BANDS]
    energy = [(f"e_p{p}", f"quantile_cont(e, {p / 100})") for p in spectra.ENERGY]
    energy += [("e_p90_p10", "quantile_cont(e, 0.9) - quantile_cont(e, 0.1)"), ("e_p90_p50", "quantile_cont(e, 0.9) - quantile_cont(e, 0.5)"), ("e_p50_p10", "quantile_cont(e, 0.5) - quantile_cont(e, 0.1)")]
    energy += [(f"active_{b}db", f"avg((e > top - {b})::INT)") for b in spectra.BELOW]
    energy += [(f"slope_p{p}", f"quantile_cont(d, {p / 100})") for p in spectra.STEPS]
    energy += [("slope_neg_mean", "coalesce(avg(d) FILTER (WHERE d < 0), 0)"), ("slope_pos_mean", "coalesce(avg(d) FILTER (WHERE d > 0), 0)")]
    shown = lambda some: ", ".join(f"round({x} + 1e-7, 4) AS {name}" for name, x in some)
    return f"""WITH {CHUNKS}, w AS (SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY ts, seq) - 1 AS i, p / 500 AS v FROM chunks),
 l AS (SELECT call_id, greatest(least(count(*), {s.most}), {s.least}) AS n FROM w GROUP BY call_id),
 f AS (SELECT l.call_id, k, j, coalesce(v, 0) AS v FROM (SELECT call_id, unnest(range(0, (n - {s.frame}) // {s.hop} + 1)) AS k FROM l) l CROSS JOIN range({s.frame}) t(j)
       LEFT JOIN w ON w.call_id = l.call_id AND w.i = k * {s.hop} + j AND w.i < {s.most}),
 e AS (SELECT call_id, k, 10 * log10(sum(v * v) / {s.frame} + 1e-10) AS e, sqrt(sum(v * v) / {s.frame}) AS env FROM f GROUP BY call_id, k),
 d AS (SELECT *, e - lag(e) OVER (PARTITION BY call_id ORDER BY k) AS d, quantile_cont(e, 0.95) OVER (PARTITION BY call_id) AS top FROM e),
 x1 AS (SELECT call_id, {shown(energy)} FROM d GROUP BY call_id),
 p AS (SELECT call_id, k, b, pow(sum(v * h * cos(2 * pi() * b * j / {s.size})), 2) + pow(sum(v * h * sin(2 * pi() * b * j / {s.size})), 2) AS power
       FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / {s.frame - 1}) AS h FROM f), range({n}) t(b) GROUP BY call_id, k, b),
 q AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY e, k) AS low, row_number() OVER (PARTITION BY call_id ORDER BY e DESC, k DESC) AS high,
       greatest(count(*) OVER (PARTITION BY call_id) // 4, 3) AS quarter FROM e),
 m AS (SELECT call_id, b, avg(power) FILTER (WHERE low <= quarter) AS quiet, avg(power) FILTER (WHERE high <= quarter) AS loud, avg(power) AS mean FROM p JOIN q USING (call_id, k) GROUP BY call_id, b),
 a AS (SELECT call_id, list(quiet ORDER BY b) AS quiet, list(loud ORDER BY b) AS loud, list(mean ORDER BY b) AS mean FROM m GROUP BY call_id),
 x2 AS (SELECT call_id, {shown(spectrum)} FROM a),
 c AS (SELECT call_id, k, env - avg(env) OVER (PARTITION BY call_id) AS x, count(*) OVER (PARTITION BY call_id) AS n FROM e),
 z AS (SELECT call_id, g, any_value(g * {s.rate / s.hop} / n) AS hz, pow(sum(x * cos(2 * pi() * g * k / n)), 2) + pow(sum(x * sin(2 * pi() * g * k / n)), 2) AS power
       FROM c, range({s.most // s.hop}) t(g) WHERE g <= n // 2 GROUP BY call_id, g),
 x3 AS (SELECT call_id, {shown(mod)} FROM z GROUP BY call_id)
 SELECT * FROM x1 JOIN x2 USING (call_id) JOIN x3 USING (call_id)"""


def _platt_sql() -> str:
    steps = "i0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b)"
    for k in range(STEPS):
        steps += f""",
 g{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum((q * n - pos) * s) AS ga, sum(q * n - pos) AS gb, sum(q * (1 - q) * n * s * s) AS haa, sum(q * (1 - q) * n * s) AS hab, sum(q * (1 - q) * n) AS hbb
          FROM (SELECT *, 1 / (1 + exp(-(s * a + b))) AS q FROM c, i{k})),
 i{k + 1} AS (SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{k})"""
    error = lambda p: f"(SELECT round(sum(gap * n) / sum(n), 6) FROM (SELECT count(*) AS n, abs(avg(x) - avg(y)) AS gap FROM (SELECT y, {p} AS x FROM scores, i{STEPS}) GROUP BY least(floor(round(x * 10, 6)), 9)))"
    return f"""WITH {SCORES}, c AS (SELECT p AS s, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scores GROUP BY p), {steps}
 SELECT round(a, 5) AS slope, round(b, 5) AS intercept, {error("p")} AS error_before, {error(f"1 / (1 + exp(-(p * i{STEPS}.a + i{STEPS}.b)))")} AS error_after FROM i{STEPS}"""


_AT = lambda n, col: f"round(avg((p >= {col})::INT) FILTER (WHERE y = 0), 6) AS flagged_{n}, round(avg((p >= {col})::INT) FILTER (WHERE y = 1), 6) AS caught_{n}"
_GRID = ", ".join(f"({x}::DOUBLE, {z}::DOUBLE)" for x in LOWS for z in HIGHS)
_PROSE = ", ".join(f"(CASE WHEN {' OR '.join(f'''regexp_matches(text, '{p}')''' for p in patterns)} THEN {1 - w:g} ELSE 1 END) AS k{i}" for i, (_, w, patterns) in enumerate(PROSE_RULES))

ENTRIES = {
    "platt_map": (platt_map, _platt_sql()),
    "calibrate_stored": (calibrate_stored, f"""WITH {SCORES}, h AS (SELECT *, {_MD5.format("'cal:' || speaker::VARCHAR", 1)} % 2 = 0 AS in_a FROM scores),
 t AS (SELECT 'half A' AS of, round(quantile_cont(p, 0.95), 6) AS verify, round(quantile_cont(p, 0.99), 6) AS block FROM h WHERE in_a AND y = 0 UNION ALL SELECT 'stored', {STORED['verify']}, {STORED['block']})
 SELECT of, verify, block, {_AT("verify", "verify")}, {_AT("block", "block")} FROM h, t WHERE NOT in_a GROUP BY of, verify, block"""),
    "source_selection": (source_selection, f"""WITH {SCORES}, d AS (SELECT DISTINCT clip, attack FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY attack ORDER BY md5('0|' || clip::VARCHAR), clip)::INT AS nth FROM d)
 SELECT * FROM r WHERE nth <= CASE WHEN attack = '-' THEN 1000 ELSE 200 END"""),
    "gate_weights": (gate_weights, f"""WITH {SCORES}, w(low, high) AS (VALUES {_GRID}), n AS (SELECT clip % 3 AS t, a, b AS q, c, y, count(*) AS n FROM scores GROUP BY ALL),
 s AS (SELECT low, high, t, y * n AS y1, (1 - y) * n AS y0, round((1 - (low + (high - low) * greatest(least(q, 1), 0))) * a + (low + (high - low) * greatest(least(q, 1), 0)) * c, 6) AS p FROM n, w),
 {eer_sql('s', 'low, high, t', 'y1').replace('sum(1 - y1)', 'sum(y0)')}, m AS (SELECT low, high, round(avg(eer_pct), 6) AS mean_eer FROM e GROUP BY low, high),
 k AS (SELECT low, high FROM m WHERE round(mean_eer - (SELECT min(mean_eer) FROM m), 6) <= 0.05 ORDER BY round(low + high, 6), low, high LIMIT 1)
 SELECT m.low, m.high, mean_eer, m.low = k.low AND m.high = k.high AS chosen FROM m, k"""),
    "fusion_over_times": (fusion_over_times, f"""WITH {SCORES}, w AS (SELECT a.x AS wa, b.x AS wb, 20 - a.x - b.x AS wc FROM range(21) a(x), range(21) b(x) WHERE a.x + b.x <= 20),
 n AS (SELECT clip % 3 AS t, a, b, c, y, count(*) AS n FROM scores GROUP BY ALL),
 s AS (SELECT wa, wb, wc, t, y * n AS y1, (1 - y) * n AS y0, round((a * wa + b * wb + c * wc) / 20, 6) AS p FROM n, w),
 {eer_sql('s', 'wa, wb, wc, t', 'y1').replace('sum(1 - y1)', 'sum(y0)')}, m AS (SELECT wa, wb, wc, round(avg(eer_pct), 6) AS mean_eer FROM e GROUP BY wa, wb, wc),
 k AS (SELECT wa, wb, wc FROM m WHERE round(mean_eer - (SELECT min(mean_eer) FROM m), 6) <= 0.05
       ORDER BY (3 * wa - 20) * (3 * wa - 20) + (3 * wb - 20) * (3 * wb - 20) + (3 * wc - 20) * (3 * wc - 20), wa, wb, wc LIMIT 1)
 SELECT m.wa, m.wb, m.wc, mean_eer, m.wa = k.wa AND m.wb = k.wb AND m.wc = k.wc AS chosen FROM m, k"""),
    "branch_weights": (branch_weights, f"""WITH {SCORES}, m AS (SELECT speaker, coalesce(avg(a) FILTER (WHERE y = 1), 0) AS a, coalesce(avg(b) FILTER (WHERE y = 1), 0) AS b, coalesce(avg(c) FILTER (WHERE y = 1), 0) AS c FROM scores GROUP BY speaker)
 SELECT speaker, round(CASE WHEN a + c > 0 THEN a / (a + c) ELSE 0.5 END, 6) AS a, round(CASE WHEN a + c > 0 THEN c / (a + c) ELSE 0.5 END, 6) AS c, round(CASE WHEN b > 0 THEN 1 ELSE 0.5 END, 6) AS b FROM m"""),
    "intent_evaluation": (intent_evaluation, f"""WITH t AS (SELECT lang, quality AS y, lower(text) AS text FROM documents JOIN labels USING (doc_id)), k AS (SELECT lang, y, {_PROSE} FROM t),
 s AS (SELECT lang, y, round(1 - k0 * k1 * k2, 4) AS p FROM k), g AS (SELECT lang, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY lang, p),
 b AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
 a AS (SELECT lang, round(CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) END, 6) AS auc FROM b GROUP BY lang)
 SELECT lang, count(*) AS n, round(avg((p >= {intent.CAUTION})::INT) FILTER (WHERE y = 1), 6) AS told_good, round(avg((p >= {intent.CAUTION})::INT) FILTER (WHERE y = 0), 6) AS told_poor,
 round(avg((p >= {intent.HIGH})::INT) FILTER (WHERE y = 1), 6) AS high_good, round(avg((p >= {intent.HIGH})::INT) FILTER (WHERE y = 0), 6) AS high_poor, any_value(auc) AS auc FROM s JOIN a USING (lang) GROUP BY lang"""),
    "channel_statistics": (channel_statistics, _channel_sql()),
}
