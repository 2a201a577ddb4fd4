"""Operator 5: entities of one text make no pairs."""

import time

from tallyvoice.llm import pii


def test_many_entities_beside_many_words(spark):
    """2000 addresses beside 4000 words: as many rows as with one address, and about its time."""
    words = " ".join("w" + "".join("abcdefghij"[int(c)] for c in f"{i:04}") for i in range(4000))
    took = {}
    for n in (1, 2000, 1, 2000):  # the second time of each, when the plans are compiled
        mails = " ".join(f"a{i}@x.org" for i in range(n))
        table = spark.createDataFrame([(1, f"{words} {mails}"), (2, "plain text"), (3, f"{words} b{n}@y.org")], "doc_id long, text string")
        start = time.perf_counter()
        found = {r.doc_id: r for r in pii.report(table).collect()}
        took[n] = time.perf_counter() - start
        assert found[1].n_email == n and found[2].spans == "" and found[3].n_email == 1
    assert took[2000] < 3 * took[1] + 2, took


def test_entities_of_one_and_of_several_texts(spark):
    """Terms by their own counts beside an entity of one text, by joint counts beside one of several."""
    rows = [(i, f"filler{i} common words here") for i in range(40)]
    rows += [(100, "quill one@x.org common"), (101, "vex two@y.org common"), (102, "vex two@y.org words"), (103, "vex words")]
    rows += [(104, "mora mora one@z.org two@y.org"), (105, None), (106, "vex two@y.org words")]
    found = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:0:5" in found[100] and "term:0:3" in found[101] and found[102] == found[106] and "term:0:3" in found[102]
    assert found[103] == "" and found[0] == "" and "term:0:4,term:5:9" in found[104]
