"""Operators on written cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyvoice.functions import intent
from tallyvoice.operators import arrays, audit, decisions, joins, metrics, sampling
from tallyvoice.streaming import sessions

GRID = [2.0, 4.0, 6.0, 8.0, 10.0]


def test_asof_takes_last_at_or_before_else_first(spark):
    data = [(5, s, p) for s, p in zip([2.0, 4.0, 6.0, 7.5], [0.1, 0.2, 0.3, 0.4], strict=True)] + [(9, 3.0, 0.5), (9, 9.0, 0.7)]
    got = joins.asof_grid(spark.createDataFrame(data, "k int, s double, p double"), ["k"], "s", "p", GRID)
    found = {(r.k, r.t): r.p for r in got.collect()}
    assert [found[5, t] for t in GRID] == [0.1, 0.2, 0.3, 0.4, 0.4]
    assert [found[9, t] for t in GRID] == [0.5, 0.5, 0.5, 0.5, 0.7]


def test_cumulative_mean_on_a_grid(spark):
    got = joins.mean_until_grid(spark.createDataFrame([(1, 2.0, 0.1), (1, 4.0, 0.3)], "k int, s double, p double"), ["k"], "s", "p", [1.0, 2.0, 4.0])
    assert {r.t: round(r.mean, 6) for r in got.collect()} == {2.0: 0.1, 4.0: 0.2}


def test_perfect_and_useless_scores(spark):
    good = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, p double")
    assert metrics.eer(good).first().eer_pct == 0.0
    assert metrics.auc(good).first().auc == 1.0
    flat = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")
    assert metrics.auc(flat).first().auc == 0.5


def test_groups_of_one_class_are_left_out(spark):
    rows = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("b", 1, 0.9)], "g string, y int, p double")
    assert [r.g for r in metrics.eer(rows, ["g"]).collect()] == ["a"]
    assert metrics.auc(rows.where("g = 'b'")).first().auc is None


def test_empty_scores(spark):
    rows = spark.createDataFrame([], "y int, p double")
    assert metrics.eer(rows).count() == 0


@pytest.mark.parametrize("voice,level,action", [
    ("allow", "none", "allow"), ("allow", "caution", "allow"), ("allow", "high", "verify"),
    ("verify", "caution", "verify"), ("verify", "high", "escalate"), ("escalate", "none", "escalate"),
])
def test_action_table(spark, voice, level, action):
    assert spark.range(1).select(decisions.combined_action(F.lit(voice), F.lit(level)).alias("a")).first().a == action


def test_thresholds_and_weights_are_checked():
    with pytest.raises(ValueError):
        decisions.risk_level(None, high=0.2, medium=0.5)
    with pytest.raises(ValueError):
        decisions.fuse({"a": 0.5, "b": 0.6})


def test_disagreeing_labels_fail(spark):
    left = spark.createDataFrame([(1, 0)], "k int, y int")
    right = spark.createDataFrame([(1, 1)], "k int, z int")
    with pytest.raises(Exception, match="disagree"):
        joins.checked_lookup(left, right, "k", ("y", "z")).collect()


def test_halves_are_disjoint_and_stable(spark):
    rows = spark.range(500).withColumn("a", sampling.half_a(F.col("id")))
    n = rows.where("a").count()
    assert 200 < n < 300 and rows.where("a").count() == n


def test_shortcut_needs_both_gaps(spark):
    f = lambda a, b: spark.range(1).select(audit.shortcut(F.lit(a), F.lit(b), 1.0).alias("x")).first().x
    assert f(1.0, 4.0) and not f(10.0, 11.5) and not f(0.1, 0.9)


def test_window_grids(spark):
    one = spark.createDataFrame([(5,), (4,), (2,), (0,)], "n int").select(
        "n", arrays.hop_grid(F.col("n"), 4, 3).alias("g"), arrays.hop_grid_aligned(F.col("n"), 4, 3).alias("a"),
        arrays.growing_prefixes(F.col("n"), [2, 4, 6]).alias("p"),
    )
    got = {r.n: (r.g, r.a, r.p) for r in one.collect()}
    assert got == {5: ([0], [0, 1], [2, 4, 5]), 4: ([0], [0], [2, 4]), 2: ([], [0], [2]), 0: ([], [0], [])}


def test_pcm_and_concealment(spark):
    rows = spark.createDataFrame([([0.5, -0.5, 2.0],)], "w array<double>")
    back = rows.select(arrays.from_pcm16(arrays.to_pcm16("w")).alias("b")).first().b
    assert np.allclose(back, [0.5, -0.5, 32767 / 32768], atol=1e-4)
    none = spark.createDataFrame([(None,), ([],)], "w array<double>").select(arrays.from_pcm16(arrays.to_pcm16("w")).alias("b")).collect()
    assert [r.b for r in none] == [None, []]


@pytest.mark.parametrize(("wave", "lost", "packet", "want"), [
    ([1.0, 1.0, 2.0, 2.0, 3.0, 3.0], [False, True, True], 2, [1, 1, 0.6, 0.6, 0.36, 0.36]),
    ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], [True], 4, [0, 0, 0, 0, 5, 6, 7]),  # samples behind the last whole packet stay
    ([1.0, 2.0, 3.0, 4.0, 5.0], [False, True], 2, [1, 2, 0.6, 1.2, 5]),
    ([1.0, 2.0], [False, None], 1, [1, 2]), ([1.0], [], 4, [1]), ([], [], 4, []), ([], [True], 4, []),
])
def test_concealment(spark, wave, lost, packet, want):
    rows = spark.createDataFrame([(wave, lost)], "w array<double>, f array<boolean>")
    assert np.allclose(rows.select(arrays.conceal("w", "f", packet).alias("y")).first().y, want)


def test_speech_bounds(spark):
    wave = [0.0] * 4 + [0.9] * 4 + [0.0] * 4
    rows = spark.createDataFrame([(wave,), ([0.0] * 8,)], "w array<double>").withColumn("db", arrays.frame_db(F.col("w"), 4))
    got = rows.select(arrays.speech_bounds(F.col("db"), F.size("w"), 4, 2, -20.0).alias("b")).collect()
    assert (got[0].b.start, got[0].b.end) == (2, 10) and got[1].b is None


def test_scorer_seam(spark):
    score = arrays.scorer(lambda: lambda w: w.mean())
    rows = spark.createDataFrame([([1.0, 3.0],)], "w array<double>")
    assert rows.select(score("w").alias("s")).first().s == 2.0


def test_intent(spark):
    rows = spark.createDataFrame([("caller: share the otp right now receiver: no",), ("plain talk",)], "t string")
    got = intent.analyse(rows, "t").collect()
    assert got[0].score == 0.7 and got[0].level == "high" and got[0].categories == ["credential_request", "urgency_threat"]
    assert got[1].score == 0.0 and got[1].level == "none"
    own = spark.createDataFrame([("verify our credentials",), ("verify our credentials and read me the cvv",)], "t string")
    assert [r.score for r in intent.analyse(own, "t").collect()] == [0.0, 0.6]
    order = spark.createDataFrame([("we will take legal action so act now",), ("you must pay the fine or send the money",)], "t string")
    first = {e.category: e.phrase for r in intent.analyse(order, "t").collect() for e in r.evidence}
    # the first pattern that matches decides, not the leftmost match
    assert first["urgency_threat"] == "act now" and first["payment_redirect"] == "send the money"
    said = "caller: hello receiver: hi caller: please share the otp right now"
    assert spark.range(1).select(intent.caller_turns(F.lit(said)).alias("c")).first().c == ["hello", "please share the otp right now"]
    turns = rows.select(intent.caller_turns(F.col("t")).alias("c")).collect()
    assert turns[0].c == ["share the otp right now"] and turns[1].c == ["plain talk"]


class State:
    """A stand-in for the state of one call."""

    hasTimedOut, exists = False, False  # noqa: N815

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timeout = ms


def test_state_does_not_depend_on_chunking_and_times_out():
    rows = pd.DataFrame({"ts": range(15), "seq": range(15), "p": [1.0, 2.0, *range(10, 140, 10)]})
    whole, split = State(), State()
    one = pd.concat(sessions.fold((1,), iter([rows[::-1]]), whole))
    two = pd.concat([x for part in (rows[:7], rows[7:]) for x in sessions.fold((1,), iter([part]), split)])
    assert one.values.tolist() == two.values.tolist() and whole.timeout == sessions.IDLE_MS
    whole.hasTimedOut = True
    assert list(sessions.fold((1,), iter([]), whole)) == [] and not whole.exists


def test_whole_fusion_grid_and_splits(spark):
    """231 triples reach a best weight between the coarse points; 20 splits report four rates."""
    from tallyvoice.operators.decisions import weight_grid
    from tallyvoice.plans import registry

    sf = "/root/testdata/sf0.001"
    best = registry.queries()["fusion_grid_best"](spark, sf).first()
    assert best.wa + best.wb + best.wc == 20 and weight_grid(spark.range(1), 20).count() == 231
    got = registry.queries()["repeated_split_stats"](spark, sf).first()
    assert got.splits == 20 and 0 <= got.mean_block_flagged <= got.mean_verify_flagged <= 1
    assert 0 <= got.min_block_caught <= got.max_verify_caught <= 1


def test_whole_order_and_drawn_rows(spark):
    """Every order is in the sorted rows, and the drawn rows fill the quotas."""
    from tallyvoice.plans import registry

    sf = "/root/testdata/sf0.001"
    run = lambda name: registry.queries()[name](spark, sf).collect()
    rows = [(r.o_orderpriority, -r.o_totalprice, r.o_orderkey) for r in run("lexsort_rows")]
    assert len(rows) == spark.read.parquet(f"{sf}/orders.parquet").count() and rows == sorted(rows)
    drawn = run("quota_sample_rows")
    assert {q.attack: q.quota for q in run("quota_sample")} == {a: sum(r.attack == a for r in drawn) for a in {r.attack for r in drawn}}


def test_replayed_draws_agree_with_a_multinomial(spark):
    """The interval from hashes against the one from numpy's draws, and the law of the draws themselves."""
    from tallyvoice.plans import detection, registry

    cells = pd.DataFrame({"r": 3, "y": 1, "a": [0.1, 0.2, 0.3], "c": 0.5, "n": [5, 1000, 7]})
    assert detection.multinomial(cells)["copies"].sum() == 1012
    hashed, drawn = (registry.queries()[n](spark, "/root/testdata/sf0.001").first() for n in ("paired_bootstrap", "bootstrap_full"))
    width = drawn.high - drawn.low
    assert hashed.replicates == drawn.replicates == 1000
    assert abs(hashed.low - drawn.low) < 0.1 * width and abs(hashed.high - drawn.high) < 0.1 * width
    z = detection.normal(F.md5(F.col("id").cast("string")))
    for mean in (1.0, 30.0):
        k = spark.range(20000).select(detection.poisson(F.lit(mean), z).alias("k")).agg(F.avg("k").alias("m"), F.variance("k").alias("v")).first()
        assert abs(k.m / mean - 1) < 0.03 and abs(k.v / mean - 1) < 0.05
