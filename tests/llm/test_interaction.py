"""Operator 13 against brute force over every order, step by step."""

import itertools
import random
import re

import numpy as np

from tallyvoice.llm import interaction

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """(part, order, step) -> counts, from filters applied one after the other."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    low = lambda i: -(2**63) if i is None else i
    failed = []
    for i, t, p in docs:
        words = SPACED.findall(t)
        failed.append(
            {
                "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                "E": any(u == t and low(j) < low(i) for j, u, _ in docs),
            }
        )
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for _, _, p in docs}:
        own = [(d[0], f) for d, f in zip(docs, failed, strict=True) if d[2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [d for d in left if d[1][letter]]
                left = [d for d in left if not d[1][letter]]
                shapley[letter] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(f[letter] for _, f in gone), sum(f[letter] and sum(f.values()) == 1 for _, f in own),
                    sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), letter,
                ]
                gone += removed
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = shapley[v[6]] if isinstance(v[6], str) else v[6]
    return {k: tuple(v) for k, v in out.items()}


def rows():
    rng = random.Random(3)
    docs = [(1, None, "a"), (2, "", None), (3, "", "a"), (None, "", "a"), (None, "x y", "b"), (4, "x y", "b"), (4, "x y", "b"), (5, "x y", "b")]
    for i in range(60):
        n = rng.choice([1, 150, 199, 200, 201, 400])
        words = [rng.choice(["é", "ta", "Ta", "RÉ", "#", "mi o"]) + str(rng.randrange(rng.choice([40, 500]))) for _ in range(n)]
        if rng.random() < 0.5:
            words = [w.replace("#", "").replace("T", "t").replace("R", "r") for w in words]
        docs.append((10 + i, rng.choice([" ", "\n", "\t \r"]).join(words), rng.choice(["a", "b", ""])))
    docs += [(100 + i, docs[10 + i][1], rng.choice(["a", "b"])) for i in range(15)] + [(200 + i, docs[12][1], "c") for i in range(9)]
    labels = [(10 + i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(10, 1, 0), (10, 0, 1), (None, 1, 1), (999, 1, 1), (204, 1, 1)]
    return docs, labels


SCHEMA = "doc_id long, text string, source string, mask int, rank string, id int, good int, digest string"


def test_audit_equals_filters_applied_in_turn(spark):
    docs, labels = rows()
    frame = spark.createDataFrame([(*d, 5, "x", 1, 1, "y") for d in docs], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interaction.report(frame, marks).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == len({r.part for r in got}) * 600
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == brute(docs, labels)


def test_audit_without_documents_or_labels(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.report(spark.createDataFrame([], SCHEMA), marks).count() == 0
    one = interaction.report(spark.createDataFrame([(1, "a", None, 1, "", 1, 1, "")], SCHEMA), marks).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120


def test_matrices():
    orders, matrix = interaction.incidence()
    assert len(set(orders)) == 120 and all(m.shape == (32, 600) for m in matrix.values())
    # a document leaves once in every order, unless it fails nothing
    assert np.array_equal(matrix["removed"].sum(axis=1), np.where(np.arange(32) > 0, 120, 0))
