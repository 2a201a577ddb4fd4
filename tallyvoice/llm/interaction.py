"""Filter interaction audit (operator 13): what each filter removes under every order of the filters.

Incidence matrix product. A document's outcome under any order depends only on the set of filters
that it fails, a mask of five bits. Spark counts masks by part, for all documents and for those that
a label marks, so that a part becomes rows of 32 counts. These rows, stacked, are multiplied by four
fixed integer matrices of 32 masks by 600 (order, step) cells: kept, removed, redundant, unique.

Documents are shuffled as short rows (id, digest, part, mask), never as texts. Whether an equal text
with a smaller id exists is decided on one row per (digest, part, labels), so a large group of copies
is a few rows.

Defined results: a null text is the empty text and equals other empty texts; a null part is the empty
string; a null id comes before all others, so it repeats nothing and is repeated by any id; rows of
equal id and text do not repeat each other; labels of one id in several rows count if any of them
marks it; labels without an id or a document and null labels mark nothing; other columns are ignored; without
documents there are no parts and no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rank_id, text_or_empty
from .quality import without, words_of

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
# The contract's symbol characters.
SYMBOLS = "[#$%&*|]"
#: The counts of a part: all documents, those labelled good, those labelled toxic.
COUNTS = ("all", "good", "toxic")


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """rank, digest, part, mask: the filters that need only the document itself, as bits 0 to 3."""
    rows = docs.select(
        rank_id(id_col, docs.schema).alias("rank"), F.col(id_col).alias("id"), text_or_empty(part_col).alias("part"),
        text_or_empty(text_col).alias("text"),
    ).withColumn("words", words_of(F.col("text")))
    n, chars = F.size("words"), F.length("text").cast("long")
    fails = (
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * n,
        100 * (chars - without(F.col("text"), "[A-Z]+")) > MAX_CAPITAL_PERCENT * chars,
        F.col("text").rlike(SYMBOLS),
    )
    bits = [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)]
    return rows.select(
        "rank", "id", F.unhex(F.sha2("text", 256)).alias("digest"), "part", (bits[0] + bits[1] + bits[2] + bits[3]).alias("mask")
    )


def marks(labels: DataFrame, id_col: str) -> DataFrame:
    """id, good, toxic: one row per labelled id."""
    any_of = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    return labels.groupBy(F.col(id_col).alias("id")).agg(any_of("quality").alias("good"), any_of("toxic").alias("toxic"))


def histograms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """part, mask, and the documents with that mask: all, good, toxic."""
    rows = failures(docs, id_col, text_col, part_col).join(marks(labels, id_col), "id", "left").fillna(0, ["good", "toxic"])
    key = ["digest", "part", "mask", "good", "toxic"]
    # rows of one id first, so that the count beside the smallest id is that of all its rows
    same_id = rows.groupBy("id", "rank", *key).agg(F.count(F.lit(1)).alias("n"))
    met = same_id.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min("rank").alias("first"), F.min_by("n", "rank").alias("n_first")
    )
    earliest = met.groupBy("digest").agg(F.min("first").alias("earliest"))
    met = met.join(earliest, "digest")
    spared = F.when(F.col("first") == F.col("earliest"), F.col("n_first")).otherwise(0)
    last = 1 << 4
    outcomes = F.array(
        F.struct(F.col("mask").alias("mask"), spared.cast("long").alias("n")),
        F.struct((F.col("mask") + last).alias("mask"), (F.col("n") - spared).cast("long").alias("n")),
    )
    split = met.select("part", "good", "toxic", F.explode(outcomes).alias("o"))
    n = F.col("o.n")
    return split.groupBy("part", F.col("o.mask").alias("mask")).agg(
        F.sum(n).alias("all"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def incidence() -> tuple[list[str], dict[str, np.ndarray]]:
    """The orders as strings, and for each outcome the matrix of masks by (order, step)."""
    orders = list(itertools.permutations(range(len(FILTERS))))
    masks = np.arange(MASKS)[:, None]
    steps = np.array(orders)  # order by step: the filter
    bit = 1 << steps
    before = np.cumsum(bit, axis=1) - bit
    bit, before = bit.reshape(1, -1), before.reshape(1, -1)
    fails, gone = (masks & bit) != 0, (masks & before) != 0
    outcome = {
        "kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone,
        "unique_fails": np.broadcast_to(masks == bit, fails.shape),
    }
    return ["".join(FILTERS[i] for i in o) for o in orders], {k: v.astype(np.int64) for k, v in outcome.items()}


OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
    "toxic_lost long, shapley long"
)


def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of 32 counts, three a part, times the matrices; 600 rows a part."""
    orders, matrix = incidence()
    n_orders, n_steps = len(orders), len(FILTERS)
    filter_of = np.array([FILTERS.index(f) for o in orders for f in o])
    # cells of one filter, summed over all orders and handed back to each of its cells
    share = (filter_of[:, None] == filter_of[None, :]).astype(np.int64)
    names = pa.array(np.repeat(orders, n_steps).tolist(), pa.string())
    steps = pa.array(np.tile(np.arange(1, n_steps + 1, dtype=np.int32), n_orders))
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            parts = some.num_rows
            rows = {c: some.column(c).flatten().to_numpy().reshape(parts, MASKS) for c in COUNTS}
            stacked = np.concatenate([rows[c] for c in COUNTS])  # all, good and toxic of every part
            removed = stacked @ matrix["removed"]
            out = {k: rows["all"] @ matrix[k] for k in ("kept", "redundant", "unique_fails")}
            out["removed"], out["good_lost"], out["toxic_lost"] = removed[:parts], removed[parts : 2 * parts], removed[2 * parts :]
            out["shapley"] = out["removed"] @ share
            cells = n_orders * n_steps
            yield pa.record_batch(
                {
                    "part": some.column("part").take(pa.array(np.repeat(np.arange(parts), cells))),
                    "filter_order": pa.concat_arrays([names] * parts), "step": pa.concat_arrays([steps] * parts),
                    **{
                        c: pa.array(out[c].reshape(-1))
                        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
                    },
                }
            )


def audit(
    docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant and unique counts, losses by label, Shapley sums."""
    found = histograms(docs, labels, id_col, text_col, part_col)
    vector = lambda c: F.array(
        *[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(MASKS)]
    ).alias(c)
    return found.groupBy("part").agg(*[vector(c) for c in COUNTS]).mapInArrow(multiplied, OUT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


#: The same in DuckDB's SQL: masks per document, then each order's outcomes by part.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
             + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY text))::INT AS mask
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
h AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT [a.bit, b2.bit, c.bit, e.bit, g.bit] AS bits, a.letter || b2.letter || c.letter || e.letter || g.letter AS filter_order
      FROM b a, b b2, b c, b e, b g WHERE a.bit | b2.bit | c.bit | e.bit | g.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
      FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
