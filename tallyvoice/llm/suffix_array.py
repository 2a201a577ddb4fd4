"""Suffix-array dedup of long repeated substrings (operator 1).

A window is any string of ``length`` bytes inside a document. A byte is removed where a window that
covers it also starts earlier (smaller document, or same document and earlier start).

The corpus is cut into shards that need no look at each other. Every window holds its smallest
``gram``-byte hash (its anchor); equal windows have equal anchors, so windows are routed by anchor
and all occurrences of one string meet in one shard. A run of consecutive windows of one anchor is
one row. What routing cannot settle, the shard's suffix array does:

* suffixes are classified (larger or smaller than their successor), leftmost-smaller (LMS) positions
  found, LMS substrings named by sorting, and the string of names solved recursively until names are
  unique; the order of all suffixes is then induced from that of the LMS suffixes: up to its next LMS
  position a suffix's (symbol, type) codes are a prefix-free key, behind it stands that LMS rank
  (``suffix_order``; all steps are vectorised over a shard of a few MB);
* common prefixes with the predecessor in suffix order are compared in text order (``plcp_reaches``),
  where neighbours' predecessors are neighbours too, eight bytes at a time;
* a maximal group of suffixes that share ``length`` bytes is one window's occurrences; all but the
  earliest are marked.

Rows pass three sieves. (1) Each map task settles its own slices the same way, so what it sends on
holds each string once: a string in a third of all documents reaches a reducer once per slice, not
once per document. (2) Anchors that occur once are dropped, runs with the bytes of an earlier run
are removed whole by their hashes (two of 64 bits). (3) Only different runs of one anchor are
fetched as bytes, sorted by anchor and handed to suffix arrays in blocks of whole anchors.

Defined results: a null or empty text is empty and loses nothing; documents rank by id, a null id
first, rows of equal id by a hash of the text; rows of equal id and text are one document and give
equal rows; texts shorter than ``length`` bytes lose nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, materialise, rank_id, slices, text_or_empty, utf8_buffer
from .hashing import BYTE_VALUES, expand, mix, powers, ranges, sums_of, union_length

LENGTH = 100
GRAM = 24
#: Bytes of text in a map-side slice, and of runs in a shard's suffix array.
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
#: Longer runs of one anchor (periodic text) are cut.
RUN_WINDOWS = 4096

U = np.uint64


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The suffix array of a string of small non-negative integers, by induced sorting."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    # classes: smaller (S) or larger (L) than the next suffix; behind the end stands the smallest one
    change = np.flatnonzero(s[1:] != s[:-1])
    to = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    smaller = np.zeros(n + 1, bool)
    smaller[:n] = (to < n - 1) & (s[np.minimum(to + 1, n - 1)] > s[to])
    smaller[n] = True
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1  # the end is the last of them
    at = np.arange(n)
    following = np.searchsorted(lms, at, side="right")  # place of the next LMS position
    left = lms[following] - at
    # codes (symbol, type) up to and with the next LMS position, packed; zeros behind it
    code = np.zeros(n + 1, np.uint64)
    code[:n] = ((s.astype(np.uint64) + U(1)) << U(1)) | smaller[:n].astype(np.uint64)
    code[n] = 1
    bits = int(code.max()).bit_length()
    width = min(63 // bits, 6)
    packed = np.zeros(n, np.uint64)
    for k in range(width):
        packed <<= U(bits)
        reach = left >= k
        packed[reach] |= code[at[reach] + k]
    single = code[lms] << U(bits * (width - 1))  # an LMS position's own symbol, as the end of a key
    values, inverse = np.unique(np.concatenate([packed, single]), return_inverse=True)
    key, end_key = inverse[:n].astype(np.uint64), inverse[n:].astype(np.uint64)
    span = width
    while True:
        open_ = np.flatnonzero(left >= span)
        if not len(open_):
            break
        second = np.where(left[open_] == span, end_key[following[open_]], key[np.minimum(open_ + span, n - 1)]) + U(1)
        pair = (key << U(32)).copy()
        pair[open_] |= second
        values, inverse = np.unique(np.concatenate([pair, end_key << U(32)]), return_inverse=True)
        key, end_key = inverse[:n].astype(np.uint64), inverse[n:].astype(np.uint64)
        span *= 2
    # LMS ranks: names where they are unique, else the suffixes of the string of names
    inner = lms[:-1]
    rank = np.zeros(len(lms), np.uint64)  # the end is the smallest
    if len(inner):
        names, named = np.unique(key[inner], return_inverse=True)
        if len(names) == len(inner):
            rank[:-1] = named + 1
        else:
            order = suffix_order(named.astype(np.int64))
            rank[order] = np.arange(1, len(order) + 1, dtype=np.uint64)
    return np.argsort((key << U(32)) | rank[following])


def plcp_reaches(raw: np.ndarray, order: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """By text position: whether ``length`` bytes are shared with the predecessor in suffix order."""
    n = len(raw)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(valid & (before >= 0))
    at = at[valid[before[at]]]
    other = before[at]
    eight = np.ndarray(max(n - 7, 0), "<u8", np.ascontiguousarray(raw), strides=(1,))
    for k in [*range(0, length - 8, 8), length - 8]:
        same = eight[at + k] == eight[other + k]
        at, other = at[same], other[same]
    out = np.zeros(n, bool)
    out[at] = True
    return out


def repeats(data: list[bytes], documents: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Among runs of bytes: (run, offsets of windows) that also start earlier in (document, start) order.

    Bytes outside all windows whose hash recurs cannot matter; they are cut off before the suffix
    array is made, and runs without such windows left out.
    """
    sizes = np.array([len(x) for x in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum(sizes)
    count = np.maximum(sizes - length + 1, 0)
    at = expand(ends - sizes, count)
    hashes = ranges(sums_of(BYTE_VALUES[raw]), at, at + length)
    order = np.argsort(hashes)
    equal = hashes[order][1:] == hashes[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    where = np.flatnonzero(again)
    if not len(where):
        return []
    run = np.repeat(np.arange(len(data)), count)[where]
    kept, first = np.unique(run, return_index=True)
    last = np.append(first[1:], len(where)) - 1
    cut = at[where[first]] - (ends - sizes)[kept]
    stop = at[where[last]] - (ends - sizes)[kept] + length
    parts = [data[r][a:b] for r, a, b in zip(kept.tolist(), cut.tolist(), stop.tolist(), strict=True)]
    found = sorted_repeats(parts, documents[kept], starts[kept] + cut, length)
    return [(int(kept[r]), offsets + cut[r]) for r, offsets in found]


def sorted_repeats(data: list[bytes], documents: np.ndarray, starts: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """The same from the suffix array of all the bytes."""
    sizes = np.array([len(x) for x in data], np.int64)
    raw = np.frombuffer(b"\0".join(data), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    run = np.repeat(np.arange(len(data)), sizes + 1)[: len(raw)]
    offset = np.arange(len(raw)) - first[run]
    valid = offset + length <= sizes[run]
    symbols = raw.astype(np.int64) + 1
    symbols[offset == sizes[run]] = 0  # between the runs
    order = suffix_order(symbols)
    shared = plcp_reaches(raw, order, valid, length)[order]
    group = np.cumsum(~shared) - 1
    place = (documents[run].astype(np.int64) << 40) + starts[run] + offset
    earliest = np.minimum.reduceat(place[order], np.flatnonzero(~shared))
    later = np.zeros(len(raw), bool)
    later[order] = place[order] > earliest[group]
    at = np.flatnonzero(later & valid)
    if not len(at):
        return []
    runs, cuts = np.unique(run[at], return_index=True)
    return list(zip(runs.tolist(), np.split(offset[at], cuts[1:]), strict=True))


def spans_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(offsets) != 1)
    return offsets[np.concatenate([[0], cut + 1])], offsets[np.append(cut, len(offsets) - 1)]


#: Windows whose anchors are found at once; places fit into the low bits of the hashes.
PLACE_BITS = 24
SEGMENT = (1 << PLACE_BITS) - 4096


def anchors(grams: np.ndarray, within: int) -> np.ndarray:
    """For each window of ``within`` grams, the place of the smallest one, the leftmost of equals."""
    low = U((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= within:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < within:
        least = np.minimum(least[: len(least) - (within - span)], least[within - span :])
    return (least & low).astype(np.int64)


def anchored_runs(raw: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of windows of one anchor, and gram sums for hashing.

    Per run: document, first and last window, anchor, and whether the anchor recurs within the run,
    without which no window recurs within it.
    """
    sums = sums_of(BYTE_VALUES[raw])
    _, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        grams = mix((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    within = length - gram + 1
    count = np.maximum(np.diff(ends) - length + 1, 0)
    at = expand(ends[:-1], count)
    document = np.repeat(np.arange(len(count)), count)
    place = np.concatenate(
        [
            start + anchors(grams[start : start + SEGMENT + within - 1], within)
            for start in range(0, len(raw) - length + 1, SEGMENT)
        ]
    )[at]
    anchor = grams[place]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(at)))
    if len(sizes) and sizes.max() > RUN_WINDOWS:
        pieces = -(-sizes // RUN_WINDOWS)
        heads = np.repeat(heads, pieces) + RUN_WINDOWS * expand(np.zeros(len(pieces), np.int64), pieces)
        sizes = np.diff(np.append(heads, len(at)))
    recurs = place[heads] != place[heads + sizes - 1]
    return document[heads], at[heads], at[heads] + sizes - 1, anchor[heads], recurs, sums_of(grams)


def _mapper(length: int, gram: int, slice_bytes: int):
    """(rank, key, text) to removals (a is null) and runs of windows to be settled between slices."""

    def settle(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, ends = utf8_buffer(batch.column(2))
        if len(raw) < length or not (np.diff(ends) >= length).any():
            return None
        rank = batch.column(0).to_numpy(zero_copy_only=False)
        key = batch.column(1).to_numpy(zero_copy_only=False)
        document, lo, hi, anchor, recurs, gram_sums = anchored_runs(raw, ends, length, gram)
        by = np.lexsort((key, rank))
        same = (rank[by][1:] == rank[by][:-1]) & (key[by][1:] == key[by][:-1])
        place = np.empty(len(by), np.int64)  # of a document in corpus order; repeated rows share one
        place[by] = np.cumsum(np.concatenate([[0], ~same]))
        content = ranges(gram_sums, lo, hi + (length - gram + 1))
        gone_doc, gone_lo, gone_hi = [], [], []
        order = np.lexsort((lo - ends[document], place[document], content, anchor))
        a, c = anchor[order], content[order]
        new_a = np.append(True, a[1:] != a[:-1])
        new_c = new_a | np.append(True, c[1:] != c[:-1])
        alive = np.ones(len(order), bool)
        if not new_c.all():
            # the bytes of an earlier run: removed whole (the same place of a repeated row is no repeat)
            head = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
            where = (place[document[order]] << 40) + lo[order] - ends[document[order]]
            whole = ~new_c & (where > where[head])
            alive[order[~new_c]] = False
            gone_doc.append(document[order[whole]])
            gone_lo.append(lo[order[whole]])
            gone_hi.append(hi[order[whole]])
        kinds = np.bincount(np.cumsum(new_a) - 1, weights=new_c)
        several = order[new_c & (recurs[order] | (kinds[np.cumsum(new_a) - 1] > 1))]
        if len(several):
            # different runs of one anchor: suffix arrays, in blocks of whole anchors
            sizes = np.cumsum(hi[several] - lo[several] + length)
            groups = np.flatnonzero(np.append(True, anchor[several][1:] != anchor[several][:-1]))
            for block in blocks(groups, sizes, BLOCK_BYTES):
                these = several[block]
                data = [raw[x : y + length].tobytes() for x, y in zip(lo[these], hi[these], strict=True)]
                for r, offsets in repeats(data, place[document[these]], lo[these] - ends[document[these]], length):
                    run = these[r]
                    x, y = spans_of(offsets)
                    gone_doc.append(np.full(len(x), document[run]))
                    gone_lo.append(lo[run] + x)
                    gone_hi.append(lo[run] + y)
                    left = np.setdiff1d(np.arange(hi[run] - lo[run] + 1), offsets, assume_unique=True)
                    if len(left):
                        lo[run], hi[run] = lo[run] + left[0], lo[run] + left[-1]
                    else:
                        alive[run] = False
        content = ranges(gram_sums, lo, hi + (length - gram + 1)).view(np.int64)
        none = np.zeros(0, np.int64)
        gone_doc, gone_lo, gone_hi = (np.concatenate([none, *x]).astype(np.int64) for x in (gone_doc, gone_lo, gone_hi))
        docs = np.concatenate([gone_doc, document[alive]])
        null = np.arange(len(docs)) < len(gone_doc)
        fill = np.zeros(len(gone_doc), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rank[docs]), pa.array(key[docs]),
                pa.array(np.concatenate([gone_lo, lo[alive]]) - ends[docs]),
                pa.array(np.concatenate([gone_hi, hi[alive]]) - ends[docs]),
                pa.array(np.concatenate([fill, anchor[alive].view(np.int64)]), mask=null),
                pa.array(np.concatenate([fill, content[alive]]), mask=null),
            ],
            names=["rank", "key", "lo", "hi", "a", "c"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 2, slice_bytes):
            out = settle(batch)
            if out is not None:
                yield out

    return run


def gathered(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, small ones joined."""
    held, total = [], 0
    for whole in batches:
        for batch in slices(whole, column, size):
            more = int(utf8_buffer(batch.column(column))[1][-1])
            if held and total + more > size:
                yield pa.concat_batches(held)
                held, total = [], 0
            held.append(batch)
            total += more
    if held:
        yield pa.concat_batches(held)


def blocks(groups: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Ranges of rows of about ``limit`` bytes that hold whole groups; sizes are running sums."""
    n = len(sizes)
    bounds = np.append(groups[1:], n)
    start = 0
    while start < n:
        done = sizes[start - 1] if start else 0
        fit = bounds[(bounds > start) & (sizes[bounds - 1] - done <= limit)]
        stop = int(fit[-1]) if len(fit) else int(bounds[bounds > start][0])
        yield np.arange(start, stop)
        start = stop


def _fetcher(length: int):
    """(rank, key, text, runs) to a row with the bytes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 4 << 20):
                raw, ends = utf8_buffer(batch.column(2))
                cols: list[list] = [[], [], [], [], []]
                for t, (rank, key, runs) in enumerate(
                    zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
                ):
                    for r in runs:
                        data = raw[ends[t] + r["lo"] : ends[t] + r["hi"] + length].tobytes()
                        for col, x in zip(cols, (r["a"], rank, key, r["lo"], data), strict=True):
                            col.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "rank", "key", "lo", "data"]
                )

    return run


def _shard(length: int, block_bytes: int):
    """Rows sorted by anchor to removals, in blocks of whole anchors."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        order = {d: i for i, d in enumerate(sorted({r[1:3] for r in rows}))}
        documents = np.array([order[r[1:3]] for r in rows], np.int64)
        starts = np.array([r[3] for r in rows], np.int64)
        for r, offsets in repeats([r[4] for r in rows], documents, starts, length):
            for x, y in zip(*spans_of(offsets), strict=True):
                for col, v in zip(out, (rows[r][1], rows[r][2], rows[r][3] + int(x), rows[r][3] + int(y)), strict=True):
                    col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["rank", "key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= block_bytes and row[0] != held[-1][0]:
                    yield settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield settle(held)

    return run


def _finisher(length: int):
    """(id, text, spans) to what is removed and what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 4 << 20):
                texts = batch.column(1)
                kept, removed, spans = [], [], []
                for text, found in zip(texts.to_pylist(), batch.column(2).to_pylist(), strict=True):
                    data = text.encode()
                    if found:
                        edges = np.array([(s["lo"], s["hi"] + length) for s in found], np.int64)
                        edges = edges[np.argsort(edges[:, 0], kind="stable")]
                        starts, ends = union_length(edges[:, 0], edges[:, 1])
                        parts, at = [], 0
                        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                            parts.append(data[at:a])
                            at = b
                        kept.append(b"".join([*parts, data[at:]]))
                        removed.append(int((ends - starts).sum()))
                        spans.append(np.stack([starts, ends], 1).ravel().tolist())
                    else:
                        kept.append(data)
                        removed.append(0)
                        spans.append([])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64()),
                        pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()),
                    ],
                    names=["id", "n_bytes", "n_removed", "removed", "kept"],
                )

    return run


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    slice_bytes: int = SLICE_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, ``removed`` (start and end bytes in turn) and the ``kept`` bytes."""
    texts = docs.select(rank_id(id_col).alias("rank"), text_or_empty(text_col).alias("text"))
    texts = texts.select("rank", F.hash("text").cast("long").alias("key"), "text")
    mapped = materialise(
        texts.mapInArrow(_mapper(length, gram, slice_bytes), "rank long, key long, lo long, hi long, a long, c long"), "runs"
    )
    # two longs less to shuffle: 52 bits of the content hash with the run's length (below 4096), and
    # the place in the text with the 32-bit key; order by (rank, place) is order by (rank, key, lo);
    # dealt out by anchor once, for both windows
    size = F.col("hi") - F.col("lo")
    inside = mapped.where("a is not null").select(
        "a", F.shiftleft("c", 12).bitwiseOR(size).alias("content"), "rank", F.shiftleft("key", 32).bitwiseOR(F.col("lo")).alias("place")
    ).repartition("a")
    by_content = Window.partitionBy("a", "content").orderBy("rank", "place")
    by_anchor = Window.partitionBy("a")
    met = inside.withColumn("nth", F.dense_rank().over(by_content)).withColumns(
        {
            "n": F.count(F.lit(1)).over(by_anchor),
            "kinds": F.count(F.when(F.col("nth") == 1, 1)).over(by_anchor),
        }
    )
    lo = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    met = met.where("n > 1").select(
        "a", "rank", F.shiftright("place", 32).alias("key"), lo.alias("lo"),
        (lo + F.col("content").bitwiseAND(F.lit(RUN_WINDOWS - 1))).alias("hi"), "nth", "kinds",
    )
    met = materialise(met, "met")
    whole = met.where("nth > 1").select("rank", "key", "lo", "hi")
    runs = met.where("nth = 1 and kinds > 1").groupBy("rank", "key").agg(F.collect_set(F.struct("a", "lo", "hi")).alias("runs"))
    fetched = texts.join(runs, ["rank", "key"]).select("rank", "key", "text", "runs").mapInArrow(
        _fetcher(length), "a long, rank long, key long, lo long, data binary"
    )
    settled = fetched.repartition("a").sortWithinPartitions("a", "rank", "key", "lo").mapInArrow(
        _shard(length, block_bytes), "rank long, key long, lo long, hi long"
    )
    removals = mapped.where("a is null").select("rank", "key", "lo", "hi").union(whole).union(settled)
    spans = removals.groupBy("rank", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    nothing = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    out = texts.join(spans, ["rank", "key"], "left").select("rank", "text", F.coalesce("spans", nothing).alias("spans")).mapInArrow(
        _finisher(length), "id long, n_bytes long, n_removed long, removed array<long>, kept binary"
    )
    kind = docs.schema[id_col].dataType
    return out.select(F.nullif(F.col("id"), F.lit(NULL_ID)).cast(kind).alias(id_col), "n_bytes", "n_removed", "removed", "kept")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The contract's columns."""
    return dedup(docs, id_col, text_col, **options).select(
        id_col, "n_bytes", "n_removed", (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
