"""Phrase collocation mining (operator 11).

Words that are frequent within their language get numbers; every other word breaks its piece, as no
phrase that holds it can be frequent. A phrase of m words is the pair of numbers of its first and its
last m - 1 words, so every phrase of every length is one binary key of two numbers, and a phrase is
only ever counted where both its parts are frequent.

The texts are cut into slices of some MB. At each length a slice sorts and run-length counts its own
keys and sends them, a block per range, to the ranges of the key order. A range sorts the keys of its
blocks by radix, counts runs, numbers the frequent ones and answers each block with the numbers of
its keys, which the slice needs for the next length. Range bounds come from the counts of the length
before: a range holds about ``ENTRIES`` words of text however often one word or pair occurs. Spark
shuffles blocks, not words: a key is in a slice's block once. Steps are written to the shared folder.

Phrases are then scored with joins of the frequent ones on their parts; products are decimals, exact
to 38 digits.

Defined results: a null text is the empty text and has no words; a null language is ``und``; ids are
not used and repeated rows count again; other columns are ignored; phrases do not cross documents;
equal scores are ordered by count, then by phrase; without documents there are no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, materialise, text_or_empty, utf8_buffer
from .hashing import BYTE_VALUES, LOWER, ranges, sums_of

LONGEST, LEAST, INSIDE_PERCENT, TOP = 3, 10, 50, 2000
#: Bytes of text of a slice, and keys of a range, at most on average.
SLICE_BYTES, ENTRIES = 4 << 20, 1 << 20
#: Places of a row at most: a slice's places are several rows, so that none is a large object of the JVM.
ROW_PLACES = 100_000
#: A place where no frequent phrase starts.
NONE = np.uint32(0xFFFFFFFF)
# The contract's bytes that end a piece, and those that part words.
PIECE_END = np.zeros(256, bool)
PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~PIECE_END
WORD[list(b" \t")] = False

#: A slice's places (its texts as local numbers) by rows of which n is the number, or the n words of one language in it.
TEXTS = "slice long, places binary, lang string, words array<binary>, counts binary, codes binary, n long"
#: A block of keys on its way to a range.
WORD_BLOCK = "part long, slice long, lang string, words array<binary>, counts binary, codes binary"
PAIR_BLOCK = "part long, slice long, codes binary, first binary, second binary, counts binary"
#: What a range gives back: its frequent keys, or an answer to a block.
WORDS_FOUND = "part long, size long, total long, lang string, words array<binary>, freq array<long>, slice long, codes binary, numbers binary, befores binary, freqs binary"
PAIRS_FOUND = "part long, size long, total long, first array<long>, second array<long>, freq array<long>, slice long, codes binary, numbers binary, befores binary, freqs binary"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as planes of bytes, highest first, which compress well; the first byte is their width."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    return bytes([width]) + planes.T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, 8 - width :] = planes.T
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def radix_order(*columns: np.ndarray) -> np.ndarray:
    """The order of fixed-width keys whose digits, foremost first, are those of ``columns``.

    Least significant digits first, 16 bits a pass; numpy sorts 16-bit numbers by counting.
    """
    order = None
    for column in reversed(columns):
        bits = int(column.max()).bit_length() if len(column) else 0
        for shift in range(0, max(bits, 1), 16):
            digit = (column >> np.uint64(shift)).astype(np.uint16)
            turn = np.argsort(digit if order is None else digit[order], kind="stable")
            order = turn if order is None else order[turn]
    return order


def run_heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def place_rows(places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The places by rows: number of the row, and its bytes."""
    for at in range(0, len(places), ROW_PLACES):
        yield at // ROW_PLACES, places[at : at + ROW_PLACES].tobytes()


class small_batches:  # noqa: N801
    """Within it, Arrow batches between Spark and Python hold few rows, whose texts and blocks are long."""

    KEY, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 256

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, self.ROWS)

    def __exit__(self, *error) -> None:
        self.spark.conf.set(self.KEY, self.before)


class Slice:
    """The words of some texts: a local number for each, with NONE between pieces."""

    def __init__(self, texts: list[pa.Array], langs: list[str]):
        parts = [utf8_buffer(t) for t in texts]
        lengths = np.concatenate([np.diff(e) for _, e in parts])
        # a line feed behind each text ends its last piece
        raw = np.insert(LOWER[np.concatenate([r for r, _ in parts])], np.cumsum(lengths), 10)
        ends = np.cumsum(lengths + 1)
        inside = WORD[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, stops = edges[::2], edges[1::2]
        text_of = np.searchsorted(ends, starts, side="right")
        pieces = np.cumsum(PIECE_END[raw], dtype=np.int32)[starts]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        named = pa.array(langs, pa.string()).dictionary_encode()
        kinds, lang_of = named.dictionary.to_pylist(), named.indices.to_numpy()
        # a word of two languages has two numbers
        pair = words.indices.to_numpy().astype(np.uint64) * np.uint64(max(1, len(kinds))) + lang_of[text_of].astype(np.uint64)
        keys, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        gap = np.zeros(len(starts), np.int64)
        gap[1:] = pieces[1:] != pieces[:-1]
        places = np.full(len(starts) + int(gap.sum()), NONE, np.uint32)
        places[np.arange(len(starts)) + np.cumsum(gap)] = inverse
        self.places, self.kinds, self.counts = places, kinds, counts
        self.lang, self.word = (keys % max(1, len(kinds))).astype(np.int64), (keys // max(1, len(kinds))).astype(np.int64)
        self.dictionary = words.dictionary

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        for i, some in place_rows(self.places):
            yield text_rows([number], [some], [None], [None], [None], [None], [i])
        for i, lang in enumerate(self.kinds):
            codes = np.flatnonzero(self.lang == i)
            if len(codes):
                words, counts = self.dictionary.take(pa.array(self.word[codes])), self.counts[codes]
                yield text_rows([number], [None], [lang], [words], [pack(counts)], [pack(codes)], [int(counts.sum())])


def text_rows(number, places, lang, words, counts, codes, n) -> pa.RecordBatch:
    return pa.record_batch(
        [
            pa.array(number, pa.int64()), pa.array(places, pa.binary()), pa.array(lang, pa.string()), lists(words, pa.binary()),
            pa.array(counts, pa.binary()), pa.array(codes, pa.binary()), pa.array(n, pa.int64()),
        ],
        names=["slice", "places", "lang", "words", "counts", "codes", "n"],
    )


def lists(rows: list, kind: pa.DataType) -> pa.Array:
    """A list column of arrays, some of them null."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([0 if r is None else len(r) for r in rows], out=offsets[1:])
    full = [pa.array(r, kind) if not isinstance(r, pa.Array) else r for r in rows if r is not None]
    values = pa.concat_arrays(full) if full else pa.array([], kind)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([r is None for r in rows]))


def sliced(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of (text, lang), slice by slice; a longer text is a slice of its own."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    texts, langs, held = [], [], 0
    for batch in batches:
        _, ends = utf8_buffer(batch.column(0))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + slice_bytes - held, side="right")) - 1
            stop = min(max(stop, at if texts else at + 1), batch.num_rows)
            if stop > at:
                texts.append(batch.column(0).slice(at, stop - at))
                langs += batch.column(1).slice(at, stop - at).to_pylist()
                held += int(ends[stop] - ends[at])
            if stop < batch.num_rows:
                yield from Slice(texts, langs).rows(number)
                number, texts, langs, held = number + 1, [], [], 0
            at = stop
    if texts:
        yield from Slice(texts, langs).rows(number)


def word_blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """The words of a slice by the part that their hash belongs to."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column("words")[i].values
            raw, ends = utf8_buffer(words)
            part = (ranges(sums_of(BYTE_VALUES[raw]), ends[:-1], ends[1:]) % np.uint64(parts)).astype(np.int64)
            counts, codes = unpack(batch.column("counts")[i].as_py()), unpack(batch.column("codes")[i].as_py())
            order = radix_order(part.astype(np.uint64))
            cuts = [*np.flatnonzero(np.diff(part[order], prepend=-1)), len(order)]
            takes = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            n = len(takes)
            yield pa.record_batch(
                [
                    pa.array([int(part[t[0]]) for t in takes], pa.int64()), pa.array([batch.column("slice")[i].as_py()] * n, pa.int64()),
                    pa.array([batch.column("lang")[i].as_py()] * n, pa.string()), lists([words.take(pa.array(t)) for t in takes], pa.binary()),
                    pa.array([pack(counts[t]) for t in takes], pa.binary()), pa.array([pack(codes[t]) for t in takes], pa.binary()),
                ],
                names=["part", "slice", "lang", "words", "counts", "codes"],
            )


def blocks_of(table: pa.Table, key: np.ndarray) -> Iterator[tuple]:
    """(slice, codes, keys) of each block; ``key`` has the keys of all, one block after the other."""
    start = 0
    for where, codes in zip(table.column("slice").to_pylist(), table.column("codes").to_pylist(), strict=True):
        codes = unpack(codes)
        yield where, codes, key[start : start + len(codes)]
        start += len(codes)


def answers(blocks: Iterator[tuple], freq: np.ndarray, number: np.ndarray, before: np.ndarray) -> list[tuple]:
    """(slice, codes, numbers, befores, freqs) for the frequent keys of each block; number is -1 for the others."""
    out = []
    for where, codes, key in blocks:
        hit = number[key] >= 0
        if hit.any():
            key = key[hit]
            out.append((where, pack(codes[hit]), pack(number[key]), pack(before[key]), pack(freq[key])))
    return out


def found_rows(part: int, total: int, found: dict[str, pa.Array], size: int, replies: list[tuple]) -> pa.Table:
    """One row of a range's frequent keys, and its answers."""
    n = len(replies)
    reply = list(zip(*replies, strict=True)) if replies else [[]] * 5
    blank = [None] * n
    columns = {"part": pa.array([part] * (n + 1), pa.int64()), "size": pa.array([size, *blank], pa.int64()), "total": pa.array([total, *blank], pa.int64())}
    for name, values in found.items():
        columns[name] = pa.array([values, *blank], pa.string()) if name == "lang" else lists([values, *blank], values.type)
    columns["slice"] = pa.array([None, *reply[0]], pa.int64())
    for name, values in zip(("codes", "numbers", "befores", "freqs"), reply[1:], strict=True):
        columns[name] = pa.array([None, *values], pa.binary())
    return pa.table(columns)


def numbered(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent keys; the local number of each key or -1; and the words counted before it in the range."""
    frequent = counts >= least
    number = np.where(frequent, np.cumsum(frequent) - 1, -1)
    kept = np.where(frequent, counts, 0)
    return np.flatnonzero(frequent), number, np.cumsum(kept) - kept


def count_words(table: pa.Table, least: int) -> pa.Table:
    """All blocks of a part: words counted by language."""
    part = table.column("part")[0].as_py()
    out = []
    # a language at a time
    for lang in sorted(table.column("lang").unique().to_pylist()):
        own = table.filter(pc.equal(table.column("lang"), lang))
        words = pa.concat_arrays([c.flatten() for c in own.column("words").chunks])
        encoded = words.dictionary_encode()
        key = encoded.indices.to_numpy()
        weight = np.concatenate([unpack(x.as_py()) for x in own.column("counts")]).astype(np.int64)
        counts = np.zeros(len(encoded.dictionary), np.int64)
        np.add.at(counts, key, weight)
        out.append((lang, encoded.dictionary, key, counts, own))
    frequent, number, before = numbered(np.concatenate([o[3] for o in out]), least)
    counts, at, tables = np.concatenate([o[3] for o in out]), 0, []
    for lang, dictionary, key, own_counts, own in out:
        here = frequent[(frequent >= at) & (frequent < at + len(own_counts))]
        replies = answers(blocks_of(own, key + at), counts, number, before)
        # the numbers of a part run on through its languages
        found = {"lang": lang, "words": dictionary.take(pa.array(here - at)), "freq": pa.array(counts[here])}
        tables.append(found_rows(part, int(counts[here].sum()), found, len(here), replies))
        at += len(own_counts)
    return pa.concat_tables(tables)


def count_pairs(table: pa.Table, least: int, last: bool) -> pa.Table:
    """All blocks of a range: keys sorted by radix, runs counted, frequent ones numbered in order."""
    part = table.column("part")[0].as_py()
    cells = {c: [unpack(x) for x in table.column(c).to_pylist()] for c in ("first", "second", "counts")}
    first, second = np.concatenate(cells["first"]), np.concatenate(cells["second"])
    order = radix_order(first, second)
    heads = run_heads(first[order], second[order])
    counts = np.add.reduceat(np.concatenate(cells["counts"])[order].astype(np.int64), heads)
    frequent, number, before = numbered(counts, least)
    key = np.zeros(len(order), np.int64)
    key[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    replies = [] if last else answers(blocks_of(table, key), counts, number, before)
    at = order[heads[frequent]]
    found = {"first": pa.array(first[at].astype(np.int64)), "second": pa.array(second[at].astype(np.int64)), "freq": pa.array(counts[frequent])}
    return found_rows(part, int(counts[frequent].sum()), found, len(frequent), replies)


class Numbers:
    """Where the numbers of each part begin, and the words counted in the parts before it."""

    def __init__(self, found: DataFrame):
        rows = sorted((r.part, r.size, r.total) for r in found.where("size is not null").groupBy("part").agg(F.sum("size").alias("size"), F.sum("total").alias("total")).collect())
        self.parts = np.array([r[0] for r in rows], np.int64)
        self.sizes, self.totals = (np.cumsum([0, *[r[i] for r in rows]]) for i in (1, 2))
        self.total = int(self.totals[-1])

    def offset(self, part: int) -> tuple[int, int]:
        i = int(np.searchsorted(self.parts, part))
        return int(self.sizes[i]), int(self.totals[i])

    def frame(self, spark: SparkSession) -> DataFrame:
        """part, start: a row for each part."""
        return spark.createDataFrame([(int(p), int(s)) for p, s in zip(self.parts, self.sizes, strict=False)], "part long, start long")


def next_pairs(table: pa.Table, numbers: Numbers, parts: int) -> pa.Table:
    """One slice, its places and the answers to it: the next longer phrases, as places and blocks."""
    empty = pa.schema([("slice", pa.int64()), ("places", pa.binary()), ("row", pa.int64()), ("part", pa.int64()), *[(c, pa.binary()) for c in ("codes", "first", "second", "counts")]])
    kind = table.column("places").is_null().to_numpy()
    places = sorted(zip(*(table.filter(pa.array(~kind)).column(c).to_pylist() for c in ("row", "places")), strict=True))
    replies = table.filter(pa.array(kind)).to_pylist()
    if not places or not replies:
        return empty.empty_table()
    places = np.frombuffer(b"".join(x for _, x in places), np.uint32)
    size = max(int(unpack(r["codes"]).max()) for r in replies) + 1
    number, before, freq = np.full(size + 1, -1, np.int64), np.zeros(size + 1), np.zeros(size + 1)
    for r in replies:
        codes = unpack(r["codes"]).astype(np.int64)
        start, total = numbers.offset(r["part"])
        number[codes] = unpack(r["numbers"]).astype(np.int64) + start
        before[codes] = (unpack(r["befores"]) + np.uint64(total)).astype(float)
        freq[codes] = unpack(r["freqs"]).astype(float)
    # codes without an answer, and NONE, look into the spare last cell
    code = np.minimum(places, np.uint32(size)).astype(np.int64)
    known = number[code] >= 0
    at = np.flatnonzero(known[:-1] & known[1:])
    if not len(at):
        return empty.empty_table()
    a, b = code[at], code[at + 1]
    # where the key stands among all words, taking the second number as independent of the first
    where = before[a] + freq[a] * (before[b] / max(1, numbers.total))
    part = np.minimum((where / max(1, numbers.total) * parts).astype(np.int64), parts - 1)
    first, second = number[a].astype(np.uint64), number[b].astype(np.uint64)
    order = radix_order(first, second)
    heads = run_heads(first[order], second[order])
    counts = np.diff(np.append(heads, len(order)))
    inverse = np.zeros(len(order), np.uint32)
    inverse[order] = np.repeat(np.arange(len(heads), dtype=np.uint32), counts)
    # places: the pairs in order, with one NONE where the run of pairs breaks
    gap = np.zeros(len(at), np.int64)
    gap[1:] = np.diff(at) > 1
    spots = np.full(len(at) + int(gap.sum()), NONE, np.uint32)
    spots[np.arange(len(at)) + np.cumsum(gap)] = inverse
    at = order[heads]
    first, second, part = first[at], second[at], part[at]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
    number_of = table.column("slice")[0].as_py()
    rows = [{"slice": number_of, "places": some, "row": i} for i, some in place_rows(spots)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        rows.append(
            {
                "slice": number_of, "part": int(part[x]), "codes": pack(np.arange(x, y, dtype=np.uint64)), "first": pack(first[x:y]),
                "second": pack(second[x:y]), "counts": pack(counts[x:y].astype(np.uint64)),
            }
        )
    return pa.Table.from_pylist(rows, empty)


PAIRS = "slice long, places binary, row long, part long, codes binary, first binary, second binary, counts binary"


def phrases(
    docs: DataFrame, scratch: Scratch, text_col: str, lang_col: str, longest: int, least: int, slice_bytes: int, entries: int
) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Frequent words (id, lang, text, f), frequent phrases of each length (id, first, second, f), words by language.

    The tables of a length are deleted as soon as the next length has its own.
    """
    spark = docs.sparkSession
    rows = docs.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    step = Scratch(spark)
    try:
        state = step.keep(rows.mapInArrow(lambda b: sliced(b, slice_bytes), TEXTS), "phrases-slices")
        words = state.where("lang is not null")
        n = scratch.keep(words.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-n")
        sent = words.agg(F.sum(F.size("words"))).first()[0] or 0
        parts = max(1, math.ceil(sent / entries))
        blocks = words.select("slice", "lang", "words", "counts", "codes").mapInArrow(lambda b: word_blocks(b, parts), WORD_BLOCK)
        found = step.keep(blocks.groupBy("part").applyInArrow(lambda t: count_words(t, least), WORDS_FOUND), "phrases-words")
        numbers = Numbers(found)
        listed = found.where("size > 0").select("part", "lang", "size", "words", "freq").join(numbers.frame(spark), "part")
        running = F.sum("size").over(Window.partitionBy("part").orderBy("lang"))
        listed = listed.select("lang", (F.col("start") + running - F.col("size")).alias("start"), F.arrays_zip("words", "freq").alias("all"))
        singles = listed.select("lang", "start", F.posexplode("all").alias("i", "x")).select(
            (F.col("start") + F.col("i")).alias("id"), "lang", F.col("x.words").cast("string").alias("text"), F.col("x.freq").alias("f")
        )
        singles, levels = scratch.keep(singles, "phrases-1"), []
        state = state.withColumnRenamed("n", "row")
        for length in range(2, longest + 1):
            parts, last = max(1, math.ceil(numbers.total / entries)), length == longest
            reply = ["part", "codes", "numbers", "befores", "freqs"]
            replies = found.where("slice is not null").select("slice", F.lit(None).cast("binary").alias("places"), F.lit(None).cast("long").alias("row"), *reply)
            places = state.where("places is not null").select(
                "slice", "places", "row", *[F.lit(None).cast("long" if c == "part" else "binary").alias(c) for c in reply]
            )
            new = Scratch(spark)
            try:
                state = new.keep(places.union(replies).groupBy("slice").applyInArrow(lambda t: next_pairs(t, numbers, parts), PAIRS), "phrases-pairs")
                blocks = state.where("part is not null").select("part", "slice", "codes", "first", "second", "counts")
                found = new.keep(blocks.groupBy("part").applyInArrow(lambda t: count_pairs(t, least, last), PAIRS_FOUND), "phrases-found")
            finally:
                step.drop()
                step = new
            numbers = Numbers(found)
            listed = found.where("size > 0").join(numbers.frame(spark), "part")
            listed = listed.select("start", F.posexplode(F.arrays_zip("first", "second", "freq")).alias("i", "x"))
            listed = listed.select((F.col("start") + F.col("i")).alias("id"), F.col("x.first").alias("first"), F.col("x.second").alias("second"), F.col("x.freq").alias("f"))
            levels.append(scratch.keep(listed, f"phrases-{length}"))
        return singles, levels, n
    finally:
        step.drop()


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact."""
    big = lambda x: x.cast("decimal(19,0)")
    square = (big(a) * big(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square, (big(left) * big(right)).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    inside_percent: int = INSIDE_PERCENT,
    slice_bytes: int = SLICE_BYTES,
    entries: int = ENTRIES,
) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate that no longer one stands for, and n of its language."""
    scratch = Scratch(docs.sparkSession)
    try:
        with small_batches(docs.sparkSession):
            singles, levels, n = phrases(docs, scratch, text_col, lang_col, longest, least, slice_bytes, entries)
        none = F.array().cast("array<long>")
        known = singles.select("id", "lang", "text", F.col("text").alias("last"), "f", none.alias("heads"), none.alias("tails"))
        out = []
        for i, level in enumerate(levels):
            p, s = known.alias("p"), known.alias("s")
            met = level.alias("x").join(p, F.col("x.first") == F.col("p.id")).join(s, F.col("x.second") == F.col("s.id"))
            # heads and tails: counts of the first and of the last 1, 2, ... words
            known = scratch.keep(
                met.select(
                    "x.id", "p.lang", F.concat("p.text", F.lit(" "), "s.last").alias("text"), "s.last", "x.f",
                    F.concat("p.heads", F.array("p.f")).alias("heads"), F.concat("s.tails", F.array("s.f")).alias("tails"),
                ), "phrases-known",
            )
            size = i + 2
            cuts = F.array(
                *[
                    F.struct(
                        cut_score(F.col("f"), F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(size - k - 1))).alias("score"),
                        F.lit(k).alias("k"), F.get("heads", F.lit(k - 1)).alias("l"), F.get("tails", F.lit(size - k - 1)).alias("r"),
                    )
                    for k in range(1, size)
                ]
            )
            scored = known.select("id", "lang", F.col("text").alias("phrase"), F.lit(size).alias("words"), F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
            if size < longest:
                longer = levels[i + 1]
                # a phrase inside one two words longer is inside one that is one word longer and no rarer
                holders = longer.select(F.col("first").alias("id"), "f").union(longer.select(F.col("second").alias("id"), "f"))
                scored = scored.join(holders.groupBy("id").agg(F.max("f").alias("holder")), "id", "left")
                scored = scored.where(F.col("holder").isNull() | (100 * F.col("holder") < inside_percent * F.col("a"))).drop("holder")
            out.append(scored.select("lang", "phrase", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))
        every = functools.reduce(DataFrame.union, out)
        return materialise(every.join(n, "lang"), "phrases")
    finally:
        scratch.drop()


#: Parts of a language whose first phrases are found before those of the whole language.
SHARES = 64


def report(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The contract's columns: the first phrases of each language.

    A phrase among the first of its language is among the first of its share, so the last task of a
    language sees ``SHARES`` times ``top`` rows at most, however many phrases there are.
    """
    found = collocations(docs).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first(first(found, "lang", "share").drop("rank"), "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB's SQL.
SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 4) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2),
k AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS p1, array_to_string(w[k + 1:], ' ') AS p2 FROM c, range(1, 3) t(k) WHERE k < m),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.p1 AND x.m = k.k JOIN f y ON y.lang = k.lang AND y.phrase = k.p2 AND y.m = k.m - k.k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE m = 3
        UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE m = 3) GROUP BY lang, phrase),
o AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE h.a IS NULL OR 100 * h.a < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
