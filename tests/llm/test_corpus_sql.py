"""Every corpus query with SQL against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

from tallyvoice.llm import quality, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_queries import SF, TABLES, rows  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(queries.oracle_sql()[name]).df())


def test_verdict_by_hand_and_clashing_names(spark):
    prose = " ".join(f"word{i}" for i in range(60)) + "."
    menu = "Home | News | Sport | Mail"
    texts = {1: prose, 2: prose + "\n" + "\n".join([menu.replace(" ", "x" * 9)] * 20), 3: prose + "\n" + menu, 4: None, 5: prose[:-1], 6: prose + "\nsubscribe to us."}
    table = spark.createDataFrame([(i, t, "q", "w") for i, t in texts.items()], "doc_id long, text string, quality string, _quality string")
    found = quality.annotate(table)
    assert found.columns == ["doc_id", "text", "quality", "_quality", "__quality"]
    assert {r.doc_id: r["__quality"].kept for r in found.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: True}
    assert sorted(r.doc_id for r in quality.keep(table).collect()) == [1, 3, 6]
