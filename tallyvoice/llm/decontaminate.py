"""Benchmark decontamination by a prefix-filtered set join (operator 4).

A window is ``window`` consecutive words of an item (an item of fewer words is one window); it is a
set of shingles of ``shingle`` words. Exact containment needs every shingle of the window, so its
single rarest shingle is the necessary prefix. Rarity is counted over all documents. Spark joins the
documents' shingles with the windows by that prefix; the shingle's place in the window says where the
window would start (positional bound) and end (length bound); what is left is verified by the words
themselves, which each shingle brings along from its surroundings.

The benchmark is a table at every step: windows, counts and prefixes are made by tasks and met in
joins, of which Spark broadcasts a side only below its own size threshold. Documents are read twice,
to count and to join, whatever the size of the benchmark; only shingles that a Bloom filter of fixed
size (``BLOOM_BITS``, the one thing that passes through the driver) lets through leave a task, and
equal texts meet the windows once. A filter that is too full lets more rows into the join and loses
none.

Defined results: null or empty texts have no words and hit nothing; items without words make no
window; a null item id reads as ''; an item id that repeats counts once; repeated document rows give
equal rows; null document ids stay null; carried columns keep their names and values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, free_name, grown, materialise, slices, text_or_empty, utf8_buffer
from .hashing import Words, union_length

WINDOW = 10
SHINGLE = 3
#: Bytes of text that a task works on at a time; a longer text is worked on alone.
BLOCK_BYTES = 2 << 20
#: Binary logarithm of the filter's bits: 8 MB, two bits a shingle.
BLOOM_BITS = 26
#: Candidates that a task hands on in one batch.
BATCH_ROWS = 1 << 16


def _windows(window: int, shingle: int, block_bytes: int):
    """The windows of items: their words, number of words, and shingles of ``by`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, block_bytes):
                words = Words(*utf8_buffer(batch.column(1)))
                grams = {n: words.shingles(n) for n in range(1, shingle + 1)}
                ids = batch.column(0).to_pylist()
                rows = []
                for item, first, last in zip(ids, words.first, words.first[1:], strict=False):
                    size = int(min(window, last - first))
                    by = min(shingle, size)
                    for start in range(first, last - size + 1) if size else ():
                        keys = grams[by][start : start + size - by + 1].view(np.int64).tolist()
                        rows.append((item, words.words(start, size).decode(), size, by, keys))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["item", "words", "size", "by", "keys"],
                )

    return run


def bloom(keys: DataFrame) -> Broadcast:
    """A Bloom filter of the 64-bit hashes in column ``key``, put together by a partial aggregate.

    The driver gathers its words that are not zero: 2 ** (BLOOM_BITS - 6) at most.
    """
    places = F.array(
        F.shiftrightunsigned("key", 64 - BLOOM_BITS), F.col("key").bitwiseAND(F.lit((1 << BLOOM_BITS) - 1))
    )
    words = (
        keys.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))
        .toPandas()
    )
    table = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def _passing(words: Words, size: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles that the filter lets through: their first words, hashes and texts."""
    grams = words.shingles(size)
    at = np.arange(len(grams))
    for place in (lambda x: x >> np.uint64(64 - BLOOM_BITS), lambda x: x & np.uint64((1 << BLOOM_BITS) - 1)):
        p = place(grams[at])
        at = at[(table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    text = np.searchsorted(words.first, at, side="right") - 1
    inside = at + size <= words.first[text + 1]  # not over the end of a text
    return at[inside], grams[at[inside]].view(np.int64), text[inside]


def _counter(sizes: Sequence[int], table: Broadcast, block_bytes: int):
    """Occurrences of the shingles that the filter lets through, summed per block of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, block_bytes):
                words = Words(*utf8_buffer(batch.column(0)))
                for size in sizes:
                    keys, n = np.unique(_passing(words, size, table.value)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), size, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))],
                        names=["by", "key", "n"],
                    )

    return run


def _candidates(sizes: Sequence[int], table: Broadcast, window: int, block_bytes: int, row_type: pa.DataType):
    """A row per document (its words), and one per shingle that may be a prefix, with the words around it."""
    names = ["row", "digest", "n_words", "by", "key", "at", "before", "around"]
    types = [row_type, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, block_bytes):
                words = Words(*utf8_buffer(batch.column(2)))
                first = words.first
                yield rows(
                    batch.num_rows, row=batch.column(0).cast(row_type), digest=batch.column(1).cast(pa.string()),
                    n_words=pa.array(np.diff(first), pa.int64()),
                )
                for size in sizes:
                    passing = _passing(words, size, table.value)
                    for part in range(0, len(passing[0]), BATCH_ROWS):
                        at, key, text = (x[part : part + BATCH_ROWS] for x in passing)
                        low = np.maximum(first[text], at - (window - size))
                        high = np.minimum(first[text + 1], at + window)
                        around = [words.words(a, b - a).decode() for a, b in zip(low, high, strict=True)]
                        yield rows(
                            len(at), digest=batch.column(1).cast(pa.string()).take(pa.array(text)),
                            by=pa.array(np.full(len(at), size, np.int32)), key=pa.array(key),
                            at=pa.array(at - first[text], pa.int64()), before=pa.array((at - low).astype(np.int32)),
                            around=pa.array(around, pa.string()),
                        )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The occurrences of each text as maximal runs: start and end words in turn."""
    for batch in batches:
        spans = []
        for starts, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            starts, ends = np.array(starts), np.array(ends)
            order = np.argsort(starts, kind="stable")
            spans.append(np.stack(union_length(starts[order], ends[order]), 1).ravel())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(pa.int64()))], names=["digest", "spans"]
        )


def _scan(
    docs: DataFrame, benchmark: DataFrame, carry: Sequence[str], text_col: str, item_col: str, item_text_col: str,
    window: int, shingle: int, block_bytes: int,
) -> tuple[DataFrame, DataFrame]:
    """A row per document (row, digest, n_words), and per text with an occurrence (digest, spans, items)."""
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_or_empty(item_text_col).alias("text")
    )
    made = scratch.keep(
        items.mapInArrow(
            _windows(window, shingle, block_bytes), "item string, words string, size int, by int, keys array<long>"
        ),
        "windows",
    )
    windows = made.dropDuplicates(["words"]).drop("item")
    sizes = sorted(r["by"] for r in made.select("by").distinct().collect())  # of 1 ... shingle

    shingles = windows.select("words", "size", "by", F.posexplode("keys").alias("offset", "key"))
    table = bloom(shingles.select("key").distinct())
    counts = (
        docs.select(text_or_empty(text_col).alias("text"))
        .mapInArrow(_counter(sizes, table, block_bytes), "by int, key long, n long")
        .groupBy("by", "key").agg(F.sum("n").alias("n"))
    )
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset"))
    prefixes = scratch.keep(
        shingles.join(grown(counts), ["by", "key"], "left")
        .groupBy("words", "size", "by").agg(rarest.alias("rarest"))
        .select("words", "size", "by", "rarest.key", "rarest.offset"),
        "prefixes",
    )

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry], F.lit(0).alias("_")).alias("row"),
        F.md5(text_or_empty(text_col)).alias("digest"),
        text_or_empty(text_col).alias("text"),
    )
    fields = [
        StructField("row", rows.schema["row"].dataType), StructField("digest", StringType()),
        StructField("n_words", LongType()),
    ]
    spare = StructType.fromDDL("by int, key long, at long, before int, around string").fields
    row_type = to_arrow_type(rows.schema["row"].dataType)
    scanned = materialise(
        rows.mapInArrow(
            _candidates(sizes, bloom(prefixes), window, block_bytes, row_type), StructType([*fields, *spare])
        ),
        "scanned",
    )
    around = F.split("around", " ")
    start = F.col("before") - F.col("offset")
    matched = scratch.keep(
        scanned.where("at is not null").drop("row", "n_words").dropDuplicates(["digest", "by", "at"])
        .join(prefixes, ["by", "key"])
        .where((start >= 0) & (start + F.col("size") <= F.size(around)))
        .where(F.array_join(F.slice(around, F.greatest(start, F.lit(0)) + 1, F.col("size")), " ") == F.col("words"))
        .select(
            "digest", "words", (F.col("at") - F.col("offset")).alias("start"),
            (F.col("at") - F.col("offset") + F.col("size")).alias("end"),
        ),
        "matched",
    )
    spans = (
        matched.groupBy("digest").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
        .mapInArrow(_merge, "digest string, spans array<long>")
    )
    owners = made.select("words", "item").distinct()
    held = (
        matched.select("digest", "words").distinct().join(owners, "words")
        .groupBy("digest").agg(F.collect_set("item").alias("items"))
    )
    found = materialise(spans.join(held, "digest"), "found")
    scratch.drop()
    return scanned.where("at is null").select("row", "digest", "n_words"), found


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: Sequence[str] = ("doc_id",),
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
    found: str = "found",
) -> DataFrame:
    """The carried columns and a struct ``found``: n_words, spans (start and end words in turn), items."""
    rows, hits = _scan(docs, benchmark, carry, text_col, item_col, item_text_col, window, shingle, block_bytes)
    return rows.join(hits, "digest", "left").select(
        *[F.col(f"row.`{c}`") for c in carry],
        F.struct(
            "n_words",
            F.coalesce("spans", F.array().cast("array<long>")).alias("spans"),
            F.sort_array(F.coalesce("items", F.array().cast("array<string>"))).alias("items"),
        ).alias(found),
    )


def n_hit(found: str = "found"):
    """Words inside any occurrence of a window."""
    spans = F.col(f"{found}.spans")
    return F.aggregate(
        F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The contract's columns."""
    marked = mark(docs, benchmark, carry=(id_col,), **options).withColumn("n_hit", n_hit())
    return marked.select(
        id_col,
        F.col("found.n_words").alias("n_words"),
        "n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    _, hits = _scan(docs, benchmark, (), text_col, item_col, item_text_col, window, shingle, block_bytes)
    digest = free_name(docs, "digest")
    return (
        docs.withColumn(digest, F.md5(text_or_empty(text_col)))
        .join(hits.select(F.col("digest").alias(digest)), digest, "left_anti")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


#: The contract's words, in SQL.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
places AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[s : s + m - 1], ' ') AS words FROM places),
starts AS (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m),
texts AS (SELECT row, m, s, array_to_string(w[s : s + m - 1], ' ') AS words FROM starts),
hits AS (SELECT row, s, m, item FROM texts JOIN windows USING (m, words)),
hit_words AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + m)) AS p FROM hits) GROUP BY row),
hit_items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
"""
