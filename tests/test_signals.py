"""Channel statistics, logistic maps, blocked similarity, gates and the checks that fail a job, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvoice.operators import calibration, decisions, joins, sampling, spectra
from tallyvoice.plans import signals
from tallyvoice.sources import protocols


def statistics(x, f):
    """The 35 statistics of one wave, straight from their definition."""
    x = np.asarray(x, float)[: f.most]
    x = np.pad(x, (0, max(0, f.least - len(x))))
    frames = np.stack([x[i : i + f.frame] for i in range(0, len(x) - f.frame + 1, f.hop)])
    mean = (frames**2).mean(axis=1)
    e = 10 * np.log10(mean + 1e-10)
    out = {f"e_p{p}": np.percentile(e, p) for p in (5, 10, 25, 50, 75, 90, 95)}
    out |= {f"e_p{a}_p{b}": out[f"e_p{a}"] - out[f"e_p{b}"] for a, b in ((90, 10), (90, 50), (50, 10))}
    out |= {f"active_{d}db": (e > out["e_p95"] - d).mean() for d in (10, 20, 35)}
    d = np.diff(e)
    out |= {f"slope_p{p}": np.percentile(d, p) for p in (1, 5, 10, 25, 75, 90, 95)}
    out |= {"slope_neg_mean": d[d < 0].mean() if (d < 0).any() else 0, "slope_pos_mean": d[d > 0].mean() if (d > 0).any() else 0}
    power = np.abs(np.fft.rfft(frames * np.hanning(f.frame), f.size, axis=1)) ** 2
    hz = np.fft.rfftfreq(f.size, 1 / f.rate)
    share = f.rate / 16000
    order, k = np.lexsort((np.arange(len(e)), e)), max(len(e) // 4, 3)
    for name, some in (("quiet", order[:k]), ("loud", order[-k:])):
        m = power[some].mean(axis=0) + 1e-12
        out |= {
            f"{name}_flatness": np.exp(np.log(m).mean()) / m.mean(), f"{name}_centroid_khz": (hz * m).sum() / m.sum() / 1000,
            f"{name}_low500": m[hz < 500 * share].sum() / m.sum(), f"{name}_high3k": m[hz >= 3000 * share].sum() / m.sum(),
        }
    level, sel = 10 * np.log10(power.mean(axis=0) + 1e-12), (hz >= 300 * share) & (hz <= 7500 * share)
    out["ltas_slope_db_per_khz"] = np.polyfit(hz[sel] / 1000, level[sel], 1)[0]
    out["hf_ratio_4k"] = power[:, hz >= 4000 * share].sum() / (power.sum() + 1e-12)
    env = np.sqrt(mean) - np.sqrt(mean).mean()
    ms, mf = np.abs(np.fft.rfft(env)) ** 2, np.fft.rfftfreq(len(env), f.hop / f.rate)
    for lo, hi in ((2, 8), (8, 16), (0.5, 2)):
        total = ms[(mf >= 0.5) & (mf < 32)].sum() + 1e-12
        out[f"mod_{lo:g}_{hi:g}".replace(".", "p")] = ms[(mf >= lo) & (mf < hi)].sum() / total
    return out


@pytest.mark.parametrize("framing", [spectra.Framing(), spectra.Framing(400, 8, 4, 16, 0.2)])
def test_channel_statistics(spark, framing):
    rng = np.random.default_rng(4)
    t = np.arange(int(1.5 * framing.most)) / framing.rate
    waves = {
        1: rng.normal(0, 0.1, len(t) // 2) * (1 + np.sin(2 * np.pi * 5 * t[: len(t) // 2])), 2: 0.3 * np.sin(2 * np.pi * framing.rate / 9 * t) + rng.normal(0, 0.01, len(t)),
        3: rng.normal(0, 0.2, framing.frame + 3), 4: np.concatenate([np.zeros(framing.least), rng.normal(0, 0.5, framing.least)]),
    }
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in waves.items()], "call_id long, wave array<double>")
    got = {r.call_id: r.asDict() for r in spectra.channel_statistics(rows, framing).collect()}
    for k, wave in waves.items():
        want = statistics(wave, framing)
        assert len(want) == 35 and set(want) == set(got[k]) - {"call_id"}
        for name, value in want.items():
            assert got[k][name] == pytest.approx(value, rel=1e-6, abs=1e-6), (k, name)


def test_empty_waves_are_silence(spark):
    rows = spark.createDataFrame([(1, []), (2, None)], "call_id long, wave array<double>")
    for r in spectra.channel_statistics(rows, signals.SMALL).collect():
        assert r.e_p50 == pytest.approx(-100) and r.slope_neg_mean == 0 and r.hf_ratio_4k == 0


def test_logistic_map_is_the_most_likely_one(spark):
    rng = np.random.default_rng(2)
    s = np.round(rng.normal(0, 2, 5000), 1)
    y = rng.random(5000) < 1 / (1 + np.exp(-(1.7 * s - 0.6)))
    a, b = 0.0, 0.0
    for _ in range(60):
        q = 1 / (1 + np.exp(-(a * s + b)))
        g, h = np.array([((q - y) * s).sum(), (q - y).sum()]), np.array([[(q * (1 - q) * s * s).sum(), (q * (1 - q) * s).sum()], [(q * (1 - q) * s).sum(), (q * (1 - q)).sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    rows = spark.createDataFrame(list(zip(s.tolist(), y.astype(int).tolist(), strict=True)), "p double, y int")
    counts = rows.groupBy(F.col("p").alias("score")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    found = calibration.fit_logistic(counts)
    assert found == pytest.approx((a, b), rel=1e-6)
    before = calibration.calibration_error(rows, calibration.logistic(F.col("p"), 0.2, 0.0)).first().error
    assert calibration.calibration_error(rows, calibration.logistic(F.col("p"), *found)).first().error < 0.02 < before
    with pytest.raises(ValueError, match="both classes"):
        calibration.fit_logistic(counts.withColumn("pos", F.lit(0)))


def test_similarity_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (70, 5))
    rows = [(i, [float(v) for v in x[i]]) for i in range(70)] + [(900, None), (901, []), (902, [0.0] * 5), (903, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "i long, v array<double>").repartition(4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(joins, "QUERY_BLOCK", 3)
    monkeypatch.setattr(joins, "ROW_BLOCK", 8)
    found = joins.nearest_of_queries(frame.where("i % 7 = 0 OR i > 800"), frame, "i", "v")
    got = {r.query: (r.max_sim, r.mean_sim) for r in found.collect()}
    assert set(got) == set(range(0, 70, 7))  # 903 meets no other vector of its width
    for q, (top, mean) in got.items():
        sims = np.delete(unit @ unit[q], q)
        assert top == pytest.approx(sims.max(), abs=1e-4) and mean == pytest.approx(sims.mean(), abs=1e-4)


def test_a_gate_of_the_smallest_weights_among_the_best(spark):
    rows = spark.createDataFrame([(y, float(y) / 2, float(y), 0.5, t) for y in (0, 1) for t in (1, 2) for _ in range(3)], "y int, a double, b double, q double, t int")
    got = decisions.gate_grid(rows, (0.0, 0.1), (0.05, 0.5)).collect()
    assert {(r.low, r.high) for r in got} == {(0.0, 0.05), (0.0, 0.5), (0.1, 0.5)}
    assert [(r.low, r.high) for r in got if r.chosen] == [(0.0, 0.05)] and all(r.mean_eer == 0 for r in got)


def test_fusion_weights_nearest_to_equal_ones(spark):
    rows = spark.createDataFrame([(y, float(y), float(y), float(1 - y), t) for y in (0, 1) for t in (1, 2) for _ in range(3)], "y int, a double, b double, c double, t int")
    got = decisions.fusion_over_times(rows, steps=6).collect()
    assert len(got) == 28 and [r.mean_eer for r in got if r.wc == 6] == [100.0]
    # a and b tell the classes apart as long as they outweigh c; of those, the triple nearest to equal weights
    assert [(r.wa, r.wb, r.wc, r.mean_eer) for r in got if r.chosen] == [(2, 2, 2, 0.0)]


def test_weights_of_some_branches_add_up_to_one(spark):
    one = lambda weights, kept: spark.createDataFrame([(weights,)], "w map<string,double>").select(decisions.renormalised(F.col("w"), kept).alias("w")).first().w
    assert one({"a": 0.2, "b": 0.6, "c": 0.2}, ["a", "b"]) == pytest.approx({"a": 0.25, "b": 0.75})
    assert one({"a": 0.0, "c": 1.0}, ["a", "b"]) == {"a": 0.5, "b": 0.5}
    assert math.isclose(sum(one({"a": 0.1, "b": 0.7}, ["a", "b", "d"]).values()), 1)


def test_shortages_and_disagreements_fail_the_job(spark):
    rows = spark.createDataFrame([(i, "A" if i % 4 else "-", i % 2) for i in range(40)], "clip long, attack string, y int")
    want = lambda n: F.when(F.col("attack") == "-", 0).otherwise(n)
    got = sampling.selected(rows, "clip", "attack", want(20)).groupBy("attack").count().collect()
    assert {r.attack: r["count"] for r in got} == {"-": 10, "A": 20}
    with pytest.raises(Exception, match="only 30 rows of A, wanted 31"):
        sampling.selected(rows, "clip", "attack", want(31)).collect()
    scored = rows.select(F.lit(0).alias("y"), (F.col("clip") / 40).alias("p"))
    with pytest.raises(Exception, match="40 genuine clips are too few"):
        signals.checked_thresholds(scored).collect()
    run = lambda labels: spark.createDataFrame(labels, "clip long, y int, p double")
    assert joins.aligned_or_fail(run([(1, 0, 0.5)]), run([(1, 0, 0.7)]), "clip", "y").first().second == 0.7
    for other in ([(1, 1, 0.7)], [(2, 0, 0.7)]):
        with pytest.raises(Exception, match="do not agree on clip"):
            joins.aligned_or_fail(run([(1, 0, 0.5)]), run(other), "clip", "y").collect()


def test_training_splits_are_checked():
    assert protocols.training_splits(["asv5:train", "asv19:dev"]) == [("asv5", "train"), ("asv19", "dev")]
    assert protocols.training_splits(["asv5:dev"], held_out=True) == [("asv5", "dev")]
    for wrong in ("asv5:eval", "asv21:train", "asv5", "asv5:dev"):
        with pytest.raises(ValueError):
            protocols.training_splits([wrong])
