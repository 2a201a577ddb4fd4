"""Rows that grow with the documents are not broadcast on the word of an estimate: joins of two such sides are merges."""

import pytest

from tallyvoice.llm import common, minhash, pii


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that are written, by label."""
    found, write = {}, common._write

    def noted(df, label):
        found.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(common, "_write", noted)
    return found


TEXT = "write to {0}@example.com or to {1}@example.net about the {0} orchard beyond the river that nobody but {0} has seen since spring"


def test_no_exploded_rows_are_broadcast(spark, plans):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower() in ("10485760", "10485760b", "10mb")
    rows = spark.createDataFrame([(TEXT.format(f"{x}ona", f"{x < 'k'}y"),) for x in "abcdefghijklmnopqrst"], "text string")
    assert pii.text_spans(rows).where("size(term) > 0").count() > 0
    docs = spark.createDataFrame([(n, TEXT.format("same", "same") + f" word{n % 4}" * 2) for n in range(20)], "doc_id long, text string")
    assert minhash.keep_one(docs).count() < 20
    for label in ("pii-spans", "classes", "bands", "groups", "stars", "undecided"):
        assert "Join" in plans[label] and "BroadcastExchange" not in plans[label], label
