"""Running sums and quantiles over ranges against numpy."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvoice.operators import metrics, prefix
from tallyvoice.plans import checks, detection

SPLITS = (-math.inf, -1.0, 0.0, 0.25, 0.5, 3.0, math.inf)


def values(n=3000, seed=3):
    rng = np.random.default_rng(seed)
    return [(["a", "b", None][i % 3 if i % 7 else 0], float(v), int(k)) for i, (v, k) in enumerate(zip(np.round(rng.normal(0, 1, n), 2), rng.integers(0, 4, n), strict=True))]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("splits", [SPLITS, prefix.EVERYTHING])
def test_running_sums(spark, descending, splits):
    rows = values()
    counts = spark.createDataFrame(rows, "g string, v double, k int").groupBy("g", "v").agg(F.sum("k").alias("k"))
    got = {(r.g, r.v): (r.k_to, r.k_all, r.k_next) for r in prefix.running(counts, "v", ["k"], ["g"], splits, descending).collect()}
    for g in {r[0] for r in rows}:
        sums = {}
        for h, v, k in rows:
            if h == g:
                sums[v] = sums.get(v, 0) + k
        order, so_far = sorted(sums, reverse=descending), 0
        for v, after in zip(order, [*order[1:], None], strict=True):
            so_far += sums[v]
            assert got[g, v] == (so_far, sum(sums.values()), sums.get(after))


def test_quantiles(spark):
    rows = values()
    frame = spark.createDataFrame(rows, "g string, v double, k int").union(spark.createDataFrame([("a", None, 1), ("z", None, 1)], "g string, v double, k int"))
    shares = [0.0, 0.05, 0.5, 0.99, 1.0]
    whole = prefix.quantiles(frame, "v", shares).first()
    assert whole.n == len(rows) and np.allclose(whole.q, np.quantile([r[1] for r in rows], shares))
    for r in prefix.quantiles(frame, F.col("v") * 2, shares, ["g"]).collect():
        assert np.allclose(r.q, np.quantile([2 * x[1] for x in rows if x[0] == r.g], shares)), r
    assert prefix.quantiles(frame.where("v IS NULL"), "v", shares).count() == 0


def test_rates_of_a_continuous_score_in_many_ranges(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    p = rng.normal(y, 1.2)
    rows = spark.createDataFrame(list(zip(y.tolist(), p.tolist(), strict=True)), "y int, p double")
    order = np.argsort(-p)
    tpr, fpr = np.cumsum(y[order]) / y.sum(), np.cumsum(1 - y[order]) / (1 - y).sum()
    at = np.argmin(np.abs(1 - tpr - fpr))
    found = metrics.eer(rows)
    assert abs(found.first().eer_pct - 50 * (fpr[at] + 1 - tpr[at])) < 0.1
    less = (p[y == 0][None, :] < p[y == 1][:, None]).mean()
    assert metrics.auc(rows).first().auc == pytest.approx(less, abs=1e-6)
    for plan in (found, metrics.auc(rows), prefix.quantiles(rows, "p", [0.5])):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in text and "percentile(" not in text


def test_tasks_grow_in_number_with_different_scores(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_VALUES", 100)
    rng = np.random.default_rng(2)
    data = [(int(a), ["-", "A1", "A2", None][a * int(b)], float(p)) for a, b, p in zip(rng.integers(0, 2, 4000), rng.integers(1, 4, 4000), rng.normal(0, 1, 4000), strict=True)]
    rows = spark.createDataFrame([*data, (1, "A1", None), (0, "-", float("nan"))], "y int, attack string, p double")
    splits = prefix.bounds(rows, "p")
    counts = metrics.by_score(rows, ["attack"], splits=splits)
    assert len(splits) > 30 and counts.rdd.getNumPartitions() == len(splits) - 1
    fan = metrics.with_attack_fanout
    found = metrics.eer_of(fan(counts), ["attack"], splits)
    want = metrics.eer_of(fan(metrics.by_score(rows, ["attack"])), ["attack"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 2


@pytest.mark.parametrize("values", [100, prefix.RANGE_VALUES])
@pytest.mark.parametrize("name, entries", [("channel_report", checks.ENTRIES), ("eer_by_attack", detection.ENTRIES)])
def test_parts_are_ordered_by_ranges(spark, monkeypatch, name, entries, values):
    monkeypatch.setattr(prefix, "RANGE_VALUES", values)
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    query, sql = entries[name]
    got = query(spark, sf)
    ordered = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x and "score" in x]
    assert ordered and all(prefix.RANGE in x for x in ordered)
    assert sorted(map(tuple, got.collect())) == sorted(db.sql(sql).fetchall())
