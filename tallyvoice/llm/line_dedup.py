"""Substring dedup by line and paragraph hashing (operator 6).

Units of a text are

* its lines: every one that holds a word, however short;
* its passages: from the start of every clause (behind a line break, or behind one of ``.!?,;:`` and white
  space) the fewest whole clauses that hold ``passage_words`` words together, over line breaks too. What a
  passage is depends on its own words alone, so one that stands inside a longer line or is wrapped otherwise
  meets its copies.

A unit is normalised to its words (runs of digits, letters and non-ASCII characters, A-Z lower-cased) and
hashed to 128 bits. Digests are grouped over all documents; the earliest occurrence (smallest id, then place)
stays, every other is removed. Removed units that touch, or have no word between them, are one span; end
marks behind a span go with it, and lines without a word left go with their line break. Offsets refer to the
original text, in code points.

Scale: a slice of a task settles its own repeats first, so a digest is shuffled once per slice, however often
it occurs. One shuffle of digests and places, one of texts; spans are gathered per document, never per digest.

Defined results: a null text stays null, null and empty texts have no units; rows with a null id rank
first; repeated rows count as one document and give equal rows, rows of equal id and different text
rank by a hash of the text; other columns pass through, and where one is called ``dedup`` the new column gets
underscores in front. Ids are whole numbers; others are refused with a TypeError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, rank_id, text_or_empty, utf8_buffer
from .hashing import LOWER, WORD_BYTES, Words, mix, ranges, sums_of, union_length
from .suffix_array import gathered

PASSAGE_WORDS = 20
SLICE_BYTES = 4 << 20

U = np.uint64
#: Bytes that end a clause, and those that count as white space behind them.
MARKS = np.isin(np.arange(256), np.frombuffer(b".!?,;:", np.uint8))
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))


def heads_of(groups: np.ndarray) -> np.ndarray:
    """Where a new value starts in an array of consecutive groups."""
    return np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)


def units(raw: np.ndarray, ends: np.ndarray, passage_words: int) -> tuple[np.ndarray, ...]:
    """Per unit: its text, first byte, the byte behind its last word, and two hashes of its words."""
    words = Words(raw, ends)
    n = len(words.hashes)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    text = np.searchsorted(words.first, np.arange(n), side="right") - 1
    breaks = raw == 0x0A
    behind = np.append(SPACES[raw[1:]], True)
    behind[ends[1:][np.diff(ends) > 0] - 1] = True
    clause_ends = breaks | (MARKS[raw] & behind)
    at = words.starts
    # a clause or line is known by the marks before it and its text, both of which only grow
    clauses = heads_of(np.cumsum(clause_ends)[at] + text)
    lines = heads_of(np.cumsum(breaks)[at] + text)
    bounds = np.append(clauses, n)
    target = clauses + passage_words
    inside = target <= words.first[text[clauses] + 1]
    first = np.concatenate([lines, clauses[inside]])
    last = np.concatenate([np.append(lines[1:], n), bounds[np.searchsorted(bounds, target[inside])]])
    _, one = np.unique(first * (n + 1) + last, return_index=True)  # a line may be a passage too
    first, last = first[one], last[one]
    sums, other = sums_of(words.hashes), sums_of(mix(words.hashes ^ U(0x5EED)))
    return text[first], at[first], words.ends[last - 1], ranges(sums, first, last), ranges(other, first, last)


def _mapper(passage_words: int, slice_bytes: int):
    """(rank, key, text) to units by digest; what repeats an earlier unit of its slice is gone already."""

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, ends = utf8_buffer(batch.column(2))
        rank, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        text, lo, hi, d1, d2 = units(raw, ends, passage_words)
        by = np.lexsort((key, rank))
        same = (rank[by][1:] == rank[by][:-1]) & (key[by][1:] == key[by][:-1])
        place = np.empty(len(by), np.int64)  # of a document in corpus order; repeated rows share one
        place[by] = np.cumsum(np.concatenate([[0], ~same])) if len(by) else by
        lo, hi = lo - ends[text], hi - ends[text]
        spot = (lo << 32) | hi
        order = np.lexsort((spot, place[text], d2, d1))
        a, b, doc, spot = d1[order], d2[order], place[text[order]], spot[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]
        head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
        gone = ~new & ((doc != doc[head]) | (spot != spot[head]))
        kept = new | gone
        at, gone, spot = order[kept], gone[kept], spot[kept]
        rows = text[at]
        spread = mix(key[rows].view(np.uint64) ^ mix(spot.view(np.uint64)))  # these need not meet their digest
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(gone, spread, d1[at]).view(np.int64)), pa.array(np.where(gone, U(0), d2[at]).view(np.int64)),
                pa.array(rank[rows]), pa.array(key[rows]), pa.array(spot), pa.array(gone),
            ],
            names=["d1", "d2", "rank", "key", "spot", "gone"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2, slice_bytes):
            yield settle(batch)

    return run


def cut(data: bytes, spots: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The spans to take out of a text, in bytes, given the units to remove."""
    raw = np.frombuffer(data, np.uint8)
    word = WORD_BYTES[LOWER[raw]]
    before = np.concatenate([[0], np.cumsum(word)])
    packed = np.sort(np.array(spots, np.int64))
    starts, ends = union_length(packed >> 32, packed & 0xFFFFFFFF)
    # nothing but white space and marks between two spans: one span
    apart = before[starts[1:]] > before[ends[:-1]]
    starts, ends = starts[np.append(True, apart)], ends[np.append(apart, True)]
    breaks = np.flatnonzero(raw == 0x0A)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        n = int(np.searchsorted(breaks, a))
        head = int(breaks[n - 1]) + 1 if n else 0
        m = int(np.searchsorted(breaks, b))
        tail = int(breaks[m]) if m < len(breaks) else len(data)
        whole_head, whole_tail = before[a] == before[head], before[tail] == before[b]
        if not whole_tail:
            while not word[b] and not SPACES[raw[b]]:
                b += 1
        else:
            b = tail
        if whole_head:
            a = head
        if whole_head and whole_tail:
            if b < len(data):
                b += 1
            elif a:
                a -= 1
        starts[k], ends[k] = a, b
    return union_length(starts, ends)


def _finisher():
    """(row, text, spots) to the kept text, and in code points what stayed and what went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, stay, gone, passages, lost = [], [], [], [], []
            for text, spots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not spots:
                    kept.append(text)
                    stay.append([{"start": 0, "end": len(text)}] if text else [])
                    gone.append([])
                    passages.append([])
                    lost.append(0)
                    continue
                data = text.encode()
                starts, ends = cut(data, spots)
                raw = np.frombuffer(data, np.uint8)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                words = Words(raw, np.array([0, len(raw)])).starts
                size = np.searchsorted(words, ends) - np.searchsorted(words, starts)
                outer = list(zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))
                kept.append(b"".join(data[a:b] for a, b in outer).decode())
                stay.append([{"start": int(points[a]), "end": int(points[b])} for a, b in outer if a < b])
                gone.append([{"start": int(points[a]), "end": int(points[b])} for a, b in zip(starts, ends, strict=True)])
                passages.append(size.tolist())
                lost.append(int(size.sum()))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(kept, pa.string()), pa.array(stay, spans), pa.array(gone, spans),
                    pa.array(passages, pa.list_(pa.int64())), pa.array(lost, pa.int64()),
                ],
                names=["row", "text", "kept", "removed", "sizes", "lost"],
            )

    return run


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int = PASSAGE_WORDS, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The input's columns, with repeated units gone from the text, and a struct ``dedup``.

    ``dedup`` holds the original offsets ``kept`` and ``removed``, the words of each removed span
    (``sizes``) and of all (``lost``).
    """
    rest = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text_col]
    rows = docs.select(
        F.struct(F.col(text_col).isNull().alias("none"), *rest).alias("row"),
        rank_id(id_col, docs.schema).alias("rank"), text_or_empty(text_col).alias("text"),
    ).withColumn("key", F.xxhash64("text"))
    found = rows.select("rank", "key", "text").mapInArrow(
        _mapper(passage_words, slice_bytes), "d1 long, d2 long, rank long, key long, spot long, gone boolean"
    )
    nth = F.dense_rank().over(Window.partitionBy("d1", "d2").orderBy("rank", "key", "spot"))
    repeated = found.withColumn("nth", nth).where("gone or nth > 1").groupBy("rank", "key").agg(F.collect_set("spot").alias("spots"))
    joined = rows.join(repeated, ["rank", "key"], "left").select("row", "text", "spots")
    spans = "array<struct<start:bigint,end:bigint>>"
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(
        _finisher(), f"row {kind}, text string, kept {spans}, removed {spans}, sizes array<bigint>, lost bigint"
    )
    text = F.when(~F.col("row.none"), F.col("text"))
    return out.select(
        *[(text if c == text_col else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)],
        F.struct("kept", "removed", "sizes", "lost").alias(free_name(docs, "dedup")),
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_words: int = PASSAGE_WORDS, **options) -> DataFrame:
    """Per document: removed spans, those of a passage's length, removed words, original offsets, a digest of what stays."""
    offsets = F.transform("dedup.removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return dedup(docs.select(id_col, text_col), id_col, text_col, passage_words, **options).select(
        id_col,
        F.size("dedup.removed").cast("long").alias("n_removed"),
        F.size(F.filter("dedup.sizes", lambda n: n >= passage_words)).cast("long").alias("n_passages"),
        F.col("dedup.lost").alias("n_removed_words"),
        F.array_join(offsets, ",").alias("removed_spans"),
        F.sha2(text_or_empty(text_col), 256).alias("kept_sha256"),
    )
