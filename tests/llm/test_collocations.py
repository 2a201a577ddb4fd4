"""Operator 11 against brute force, in one slice and many, one range and many."""

import collections
import random
import re

import numpy as np
import pytest

from tallyvoice.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n int, slice int, part int, phrase string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, longest=3, least=10, inside=50, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) >= 2 and a >= least}
        inner = collections.defaultdict(int)
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(inner[p[i : i + m]], a)
        rows = []
        for p, a in candidates.items():
            if 100 * inner[p] >= inside * a:
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def documents():
    rng = random.Random(11)
    docs = [(None, "en"), ("", None), (" \t ", "en"), (".,;:!?\n\x0b\x0c\r", "de"), ("alone", "fr"), ("a b", None), ("a b. " * 12, "en\x00"), ("a b. " * 9, "")]
    vocabulary = ["the", "The", "of", "é", "日本", "x\x00y", "a-b", "ÀB"] + [f"w{i}" for i in range(40)]
    for i in range(300):
        words = [rng.choice(vocabulary[: rng.choice([4, 8, 48])]) for _ in range(rng.choice([1, 5, 40]))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)
        docs.append((text, rng.choice(["en", "en", "de", None])))
    docs += [("hot pair of words here", "en")] * 400  # a third of the rows: one text
    docs += [("und so weiter und so fort " * 900, "de")]  # long
    return docs


def got(frame, **how):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = collocations.collocations(frame, **how)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows.withColumn("rank", F.row_number().over(order)).collect())


@pytest.mark.parametrize(("longest", "slice_bytes", "entries"), [(3, 4 << 20, 1 << 20), (3, 900, 300), (4, 3000, 500), (2, 5000, 50)])
def test_equals_brute_force(spark, longest, slice_bytes, entries):
    docs = documents()
    frame = spark.createDataFrame([(1, t, x, 1, 2, 3, "p") for t, x in docs], SCHEMA).repartition(3)
    assert got(frame, longest=longest, slice_bytes=slice_bytes, entries=entries) == brute(docs, longest)


def test_report_has_ranks(spark):
    docs = documents()
    frame = spark.createDataFrame([(1, t, x, 1, 2, 3, "p") for t, x in docs], SCHEMA)
    rows = collocations.report(frame, top=7).collect()
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows) == brute(docs, top=7)


def test_without_documents_or_phrases(spark):
    assert collocations.report(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(1, "a b c", "en", 1, 2, 3, "p"), (None, None, None, 1, 2, 3, "p")], SCHEMA)
    assert collocations.report(few).count() == 0


def test_products_past_64_bits(spark):
    from pyspark.sql import functions as F

    big = [(3 * 10**13 + 7, 5 * 10**13 + 1, 4 * 10**13 + 9), (10, 10, 10), (10, 3, 7)]
    rows = spark.createDataFrame(big, "a long, l long, r long").select("*", collocations.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 10**6 * r.a * r.a // (r.l * r.r) for r in rows.collect())


def test_pack_and_radix_order():
    rng = np.random.default_rng(1)
    for top in (1, 255, 256, 70000, 2**40):
        x = rng.integers(0, top, 500).astype(np.uint64)
        assert np.array_equal(collocations.unpack(collocations.pack(x)), x)
        y = rng.integers(0, 3, 500).astype(np.uint64)
        assert np.array_equal(collocations.radix_order(y, x), np.lexsort([x, y]))
    assert len(collocations.unpack(collocations.pack(np.zeros(0, np.uint64)))) == 0
