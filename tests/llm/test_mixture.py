"""Operator 12: targets against the shares worked out round by round, the tree against plain Python, and its promises."""

import collections
import random
import re

import pytest

from tallyvoice.llm import mixture

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size int, draw string, target int, name string, node int"


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(*d, 1, "x", 2, "y", 3) for d in docs], SCHEMA).repartition(parts)


def documents():
    rng = random.Random(8)
    docs = []
    # a source of a third and more of all rows, one far too small for its share, one of a single long text
    for name, n in (("b", 400), ("a", 9), ("é", 150), ("Z", 120), (None, 60), ("", 40)):
        for _ in range(n):
            docs.append([len(docs), " ".join(["w"] * rng.choice([1, 2, 7, 30, 31, 33, 60, 200])), name])
    docs.append([len(docs), "long\t" * 5000, "~"])
    docs += [[None, None, "b"], [None, "", "b"], [7, "x y", "b"], [7, "x y", "b"], [None, "x y z", "Z"], [None, "x y z", "Z"]]
    return docs


def targets(sizes):
    """The contract's rounds, with exact fractions: source -> target."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: Fraction(sum(sizes.values()) * weight[s], sum(weight.values())) for s in order}
    capped = set()
    while True:
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over:
            return {s: float(t) for s, t in target.items()}
        excess = sum(target[s] - 3 * sizes[s] for s in over)
        capped |= over
        for s in over:
            target[s] = Fraction(3 * sizes[s])
        free = [s for s in order if s not in capped]
        for s in free:
            target[s] += excess * Fraction(weight[s], sum(weight[f] for f in free))


def test_mixture_keeps_its_targets(spark):
    docs = documents()
    rows = mixture.plan(frame(spark, docs)).collect()
    words = lambda t: len(SPACED.findall(t or ""))
    assert collections.Counter((r.doc_id, r.source, r.size) for r in rows) == collections.Counter((i, s, words(t)) for i, t, s in docs)
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += words(t)
    want = targets(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        ratio = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and (r.size == 0 or abs(r.copies - ratio) < 1)
        taken[r.source] += r.taken
    for s, t in want.items():
        # where the extra copies are fewer words than one document has, that document may be one of them
        extra, largest = t - t // max(1, sizes[s]) * sizes[s], max(words(x) for _, x, y in docs if y == s)
        assert abs(taken[s] - t) <= (8 if largest <= extra <= sizes[s] - largest else largest), (s, taken[s], t)


def test_reruns_agree_however_rows_lie(spark):
    docs = documents()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    first, again = (sorted(map(key, mixture.plan(frame(spark, d, n)).collect())) for d, n in ((docs, 2), (docs[::-1], 5)))
    assert first == again


def test_expected_copies(spark):
    """Over many sources of the same make, a document is taken once more as often as its fraction says."""
    n = 400
    docs = [(10 * s + i, "w " * size, f"s{s:03}") for s in range(n) for i, size in enumerate((3, 2, 40, 3, 2, 9))]
    rows = mixture.plan(frame(spark, docs), weights=(3, 1), most=3).collect()
    for weight, ratio in ((3, 1.5), (1, 0.5)):
        for i in range(6):
            mean = [r.copies for r in rows if r.doc_id % 10 == i and (3, 1)[r.doc_id // 10 % 2] == weight]
            assert len(mean) == n // 2 and abs(sum(mean) / len(mean) - ratio) < 0.13, (weight, i)


def pairs_in_python(units, chance):
    """The rule of a node on a list of (draw, size, p)."""
    left, done = list(units[0]), []
    for b in units[1:]:
        b = list(b)
        up, down = min((1 - left[2]) * left[1], b[2] * b[1]), min(left[2] * left[1], (1 - b[2]) * b[1])
        if chance(left[0], b[0]) * (up + down) < down:
            full = up == (1 - left[2]) * left[1]
            left[2], b[2] = left[2] + up / left[1], b[2] - up / b[1]
        else:
            full = down == left[2] * left[1]
            left[2], b[2] = left[2] - down / left[1], b[2] + down / b[1]
        out, left = (left, b) if full else (b, left)
        assert min(abs(out[2]), abs(1 - out[2])) < 1e-9
        done.append((out[0], out[1], round(out[2])))
    return left, done


def test_node_equals_plain_python(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    units = [(rng.randrange(1 << 40), rng.randint(64, 127), rng.random()) for _ in range(40)]
    lies = [(a[0], b[0]) for a in units for b in units]
    drawn = spark.createDataFrame(lies, "a long, b long").select("a", "b", mixture.chance(1, F.col("a"), F.col("b")).alias("u")).collect()
    table = {(r.a, r.b): r.u for r in drawn}
    assert all(0 <= u < 1 for u in table.values())
    node = spark.createDataFrame([([(d, d, s, p) for d, s, p in units],)], "units array<struct<draw:long,id:long,size:long,p:double>>")
    got = node.select(mixture.paired("units").alias("x")).first().x
    left, done = pairs_in_python(units, lambda a, b: table[a, b])
    assert [(d.id, d.size, d.more) for d in got.done] == done
    assert (got.left.id, got.left.size) == (left[0], left[1]) and got.left.p == pytest.approx(left[2])
    # words are kept
    assert sum(s * p for _, s, p in units) == pytest.approx(sum(d.size * d.more for d in got.done) + got.left.size * got.left.p)


def test_mixed_repeats_documents(spark):
    docs = documents()
    source = frame(spark, docs)
    planned = mixture.plan(source)
    want = collections.Counter()
    for r in planned.collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = mixture.mixed(source, planned)
    assert got.columns == source.columns
    assert collections.Counter((r.doc_id, r.source, len(SPACED.findall(r.text or ""))) for r in got.collect()) == +want


def test_empty_and_wordless_tables(spark):
    assert mixture.report(frame(spark, [])).count() == 0
    rows = mixture.report(frame(spark, [(1, None, "a"), (2, " \n", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 2


def test_no_python_on_the_main_path(spark):
    sizes = mixture.measured(frame(spark, documents()), "doc_id", "source", "text")
    assert "Python" not in sizes._jdf.queryExecution().toString()
