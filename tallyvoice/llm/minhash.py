"""Near-duplicate documents by DartMinHash and banded joining (operator 8).

A document is the weighted set of its word shingles, weighted by how often each occurs (or by 1). For
each unit of weight of an element, darts fall as a Poisson process in rank; their number and places
come from hashes, so every document that holds the unit sees the same darts. With total weight W a
document looks at ranks below ``darts / W``, on average ``darts`` of them, throws each to one of
``coordinates`` by its hash, and keeps the earliest per coordinate; documents with an empty
coordinate look twice as far. Two signatures agree in a coordinate with the probability of their
weighted Jaccard similarity.

Documents with equal weighted sets are one class before any join (its smallest id stands for it).
Classes meet in bands of ``rows`` coordinates. Each is paired with the foremost member of its bands,
the one that shares bands with the most others; pairs are verified exactly on their weighted sets and
accepted ones merged to components. That settles groups of copies in as many pairs as they have members.

Bands whose members are still in different components are refined exactly, without pairing them all.
Over the classes in such bands an element is rare where at most ``rare`` of them hold it; m is a class's
weight in other elements. A similar pair either

* shares a rare element; then the first one that it shares, in order of rarity, is in the prefix of both
  (what is left behind it is too little for the similarity), and pairs meet on prefix elements: each
  brings at most ``rare`` classes together; or
* shares none; then the overlap is at most the smaller m, and pairs meet in their bands where that and
  the weights leave the similarity possible. Bands are first asked, by weight, whether any such partner
  is there.

Both kinds are verified exactly. So every pair of different components that shares a band is decided:
verified, or impossible by its weights. Similar texts are never apart unless no band shows them
(probability 1.5e-5 at similarity 0.8 with 28 bands of 5).

Components come from label propagation in joins with ``checkpoint`` between rounds; nothing but loop
counters reaches the driver. Intermediate tables are deleted when the components are known.

Defined results: a document of fewer words than a shingle is one element; without words it is alone
in a class of its own; null texts are empty; a null id ranks first and keeps its null; rows of equal
id and equal text are one document and give equal rows; other columns are not read. Ids are whole
numbers; others are refused with a TypeError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, free_name, grown, materialise, rank_id, slices, text_or_empty, utf8_buffer
from .hashing import Words, mix

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 28
ROWS = 5
#: An element that at most so many of the undecided classes hold is rare.
RARE = 8
SLICE_BYTES = 1 << 20

U = np.uint64


def elements(words: Words, shingle: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each text as (text, hash of shingle and unit of weight), sorted by both."""
    first = words.first
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < shingle))
    grams = words.shingles(shingle)
    at = np.arange(len(grams))
    text = np.searchsorted(first, at, side="right") - 1
    inside = at + shingle <= first[text + 1]
    text, hashes = text[inside], grams[inside]
    if len(short):
        # a text of fewer words is one element: all of its words
        extra = []
        for t in short:
            h = U(n[t])
            for x in words.hashes[first[t] : first[t + 1]]:
                h = mix(np.array([h ^ x], np.uint64))[0]
            extra.append(h)
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, np.array(extra, np.uint64)])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    if not weighted:
        return text[new], hashes[new]
    heads = np.flatnonzero(new)
    unit = np.arange(len(text)) - np.repeat(heads, np.diff(np.append(heads, len(text))))
    return text, np.where(unit == 0, hashes, mix(hashes ^ mix(unit.astype(np.uint64) + U(0x51))))


#: Chances of 0, 1, ... darts in a cell of area 1.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def signatures(text: np.ndarray, unit: np.ndarray, n_texts: int, coordinates: int, darts: float) -> np.ndarray:
    """The earliest dart of each coordinate for each text; texts without elements get zeros."""
    weight = np.bincount(text, minlength=n_texts)
    out = np.zeros((n_texts, coordinates), np.uint64)
    waiting = np.flatnonzero(weight > 0)
    reach = np.zeros(n_texts)
    reach[waiting] = darts / weight[waiting]
    while len(waiting):
        slot = np.full(n_texts, -1)
        slot[waiting] = np.arange(len(waiting))
        mine = slot[text] >= 0
        own, units = slot[text[mine]], unit[mine]
        limit = reach[waiting][own]
        cells = np.ceil(limit).astype(np.int64)
        who = np.repeat(np.arange(len(units)), cells)
        cell = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = mix(units[who] + mix(cell.astype(np.uint64) + U(1)))
        count = np.searchsorted(_POISSON, (seed >> U(11)).astype(np.float64) * 2.0**-53, side="right")
        dart_of = np.repeat(np.arange(len(who)), count)
        number = np.arange(len(dart_of)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(seed[dart_of] ^ mix(number.astype(np.uint64) + U(0xA5A5)))
        place = cell[dart_of] + (mix(dart ^ U(0x77)) >> U(11)).astype(np.float64) * 2.0**-53
        owner = own[who[dart_of]]
        near = place < limit[who[dart_of]]
        dart, place, owner = dart[near], place[near], owner[near]
        coordinate = owner * coordinates + (dart % U(coordinates)).astype(np.int64)
        order = np.lexsort((place, coordinate))
        coordinate, dart = coordinate[order], dart[order]
        head = np.ones(len(coordinate), bool)
        head[1:] = coordinate[1:] != coordinate[:-1]
        found = np.zeros(len(waiting) * coordinates, np.uint64)
        filled = np.zeros(len(waiting) * coordinates, bool)
        found[coordinate[head]] = dart[head]
        filled[coordinate[head]] = True
        done = filled.reshape(-1, coordinates).all(1)
        out[waiting[done]] = found.reshape(-1, coordinates)[done]
        waiting = waiting[~done]
        reach[waiting] *= 2
    return out


def _fold(columns: np.ndarray) -> np.ndarray:
    """One hash of several columns."""
    h = np.zeros(len(columns), np.uint64)
    for k in range(columns.shape[1]):
        h = mix((h + U(k + 1)) ^ columns[:, k])
    return h


def _signer(shingle: int, weighted: bool, bands: int, rows: int):
    """(rank, key, text) to (rank, key, set digest, weight, band hashes)."""
    coordinates = bands * rows
    darts = coordinates * (np.log(coordinates) + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, SLICE_BYTES):
                n = batch.num_rows
                text, unit = elements(Words(*utf8_buffer(batch.column(2))), shingle, weighted)
                weight = np.bincount(text, minlength=n)
                sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
                for k, total in enumerate(sums):  # order-free digests of the whole set
                    np.add.at(total, text, mix(unit ^ U(0x1234567 + k)))
                sign = signatures(text, unit, n, coordinates, darts)
                band = np.stack([_fold(sign[:, k * rows : (k + 1) * rows]) ^ U(k) for k in range(bands)], 1)
                bands_of = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(band.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                        pa.array(weight, pa.int64()), bands_of,
                    ],
                    names=["rank", "key", "d1", "d2", "weight", "bands"],
                )

    return run


def _sets(shingle: int, weighted: bool):
    """(id, text) to the packed sorted elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, SLICE_BYTES):
                text, unit = elements(Words(*utf8_buffer(batch.column(1))), shingle, weighted)
                order = np.lexsort((unit, text))
                unit, cuts = unit[order], np.cumsum(np.bincount(text, minlength=batch.num_rows))
                packed = [x.tobytes() for x in np.split(unit, cuts[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "set"])

    return run


def _occurrences(rare: int):
    """(id, set) to (element, id, 1); an element of more than ``rare`` sets of a slice is one row of their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            for batch in slices(whole, 1, 8 * SLICE_BYTES):
                raw, ends = utf8_buffer(batch.column(1))
                unit = np.frombuffer(raw.tobytes(), np.uint64)
                owner = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(ends) // 8)
                order = np.argsort(unit, kind="stable")
                unit, owner = unit[order], owner[order]
                heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.zeros(0, np.int64)
                count = np.diff(np.append(heads, len(unit)))
                many = count > rare
                single = np.repeat(~many, count)
                element = np.concatenate([unit[heads[many]], unit[single]]).view(np.int64)
                n_many = int(many.sum())
                none = np.arange(len(element)) < n_many
                ids = np.concatenate([np.zeros(n_many, np.int64), owner[single]])
                n = np.concatenate([count[many], np.ones(len(ids) - n_many, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(element), pa.array(ids, pa.int64(), mask=none), pa.array(n, pa.int64())], names=["e", "id", "n"]
                )

    return run


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                if len(small) < similarity * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep)], names=["a", "b", "similar"])

    return run


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for the ids of ``links`` (a, b); the component is the smallest id.

    Each round takes the smallest label among the neighbours and then that label's own label, so long
    paths halve. Each round's labels are a table, so no lineage builds up.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.distinct(), "edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("id"), "c")
    labels = scratch.keep(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        nearest = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("c").alias("far"))
        moved = scratch.keep(nearest.join(jump, "c").select("id", F.least("c", "far").alias("c"), "old"), "labels")
        labels = moved.select("id", "c")
        if moved.where("c <> old").isEmpty():
            return labels.select("id", F.col("c").alias("component"))


def _undecided(open_: DataFrame, sets: DataFrame, similarity: float, rare: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that may be similar, from the members of undecided bands.

    ``open_`` holds h, band, id, weight and component c; ``sets`` the packed sets by id.
    """
    classes_ = open_.select("id", "weight", "c").distinct()
    spread = sets.join(grown(open_.select("id").distinct()), "id", "left_semi").mapInArrow(_occurrences(rare), "e long, id long, n long")
    counted = spread.withColumn("df", F.sum("n").over(Window.partitionBy("e"))).where("df <= %d and id is not null" % rare)
    own = counted.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_rare"), F.count(F.when(F.col("df") == 1, 1)).alias("n_alone"),
        F.sort_array(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "e")))).alias("shared"),
    )
    # of a class's elements in order of rarity, at least one of the first weight - similarity * weight + 1 is in any similar one
    behind = F.col("weight") - F.ceil(F.col("weight") * F.lit(similarity) - F.lit(1e-9)) + 1 - F.coalesce("n_alone", F.lit(0))
    looked = classes_.join(grown(own), "id", "left").select(
        "id", "weight", "c", (F.col("weight") - F.coalesce("n_rare", F.lit(0))).alias("m"),
        F.transform(
            F.slice(F.coalesce("shared", F.array()), F.lit(1), F.greatest(behind, F.lit(0)).cast("int")), lambda x: x["e"]
        ).alias("prefix"),
    )
    looked = scratch.keep(looked, "undecided")
    apart = (F.col("c") != F.col("c2")) & (F.least("weight", "w2") >= F.lit(similarity) * F.greatest("weight", "w2"))
    one = looked.select("id", "weight", "c", F.explode("prefix").alias("e"))
    two = one.toDF("b", "w2", "c2", "e")
    by_element = one.join(grown(two), "e").where((F.col("id") < F.col("b")) & apart).select(F.col("id").alias("a"), "b")
    # without a rare element in common: the heavier looks for lighter ones in its bands
    possible = lambda w, m, other: m >= F.lit(similarity) * (w + other - m)
    members = open_.select("h", "band", "id").join(looked.select("id", "weight", "c", "m"), "id")
    light = members.where(possible(F.col("weight"), F.col("m"), F.col("weight")))
    heavy = members.where(F.col("m") >= F.lit(similarity) * F.col("weight")).toDF("id", "h", "band", "wa", "ca", "ma")
    fits = (F.col("weight") <= F.col("wa")) & possible(F.col("wa"), F.least("ma", "m"), F.col("weight"))
    weights = light.groupBy("h", "band", "weight", F.hash("h").alias("_part")).agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("m").alias("m")
    ).drop("_part")
    asked = heavy.join(weights, ["h", "band"]).where(fits & ((F.col("lo") != F.col("ca")) | (F.col("hi") != F.col("ca"))))
    asked = asked.select("h", "band", "weight", F.col("id").alias("a"), "wa", "ca", "ma")
    by_band = asked.join(light.withColumnRenamed("id", "b"), ["h", "band", "weight"]).where(fits & (F.col("c") != F.col("ca")))
    return by_element.union(by_band.select("a", "b"))


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    weighted: bool = True,
    bands: int = BANDS,
    rows: int = ROWS,
    rare: int = RARE,
) -> DataFrame:
    """rank and key of each document, its ``set_class`` (hr) and its ``cluster`` (cr, ck): their smallest documents."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select(rank_id(id_col, docs.schema).alias("rank"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("key", F.xxhash64("text")).select("rank", "key", "text")
    signed = scratch.keep(
        base.mapInArrow(
            _signer(shingle, weighted, bands, rows), "rank long, key long, d1 long, d2 long, weight long, bands array<long>"
        ),
        "signatures",
    )
    # documents of equal sets are one class; those without words each their own
    some = signed.where("weight > 0")
    heads = some.groupBy("d1", "d2", "weight").agg(F.min(F.struct("rank", "key")).alias("head"))
    members = some.select("rank", "key", "d1", "d2", "weight").join(heads, ["d1", "d2", "weight"]).select(
        "rank", "key", F.col("head.rank").alias("hr"), F.col("head.key").alias("hk")
    )
    members = scratch.keep(members, "members")
    # a class is known by a number: the hash of its head
    name = lambda r, k: F.xxhash64(r, k)
    reps = some.join(
        grown(members.select(F.col("hr").alias("rank"), F.col("hk").alias("key")).distinct()), ["rank", "key"], "left_semi"
    ).dropDuplicates(["rank", "key"]).select(name("rank", "key").alias("id"), "bands", "weight")
    banded = scratch.keep(reps, "classes").select("id", "weight", F.posexplode("bands").alias("band", "h"))
    sizes = banded.groupBy("h", "band", F.hash("h").alias("_part")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.keep(banded.join(grown(sizes.select("h", "band", "n")), ["h", "band"]), "bands")
    degree = met.groupBy("id").agg(F.sum("n").alias("deg"))
    groups = scratch.keep(met.select("id", "weight", "h", "band").join(grown(degree), "id"), "groups")
    # texts are shuffled once, to pack the sets of those that meet any other
    meeting = grown(groups.select("id").distinct())
    texts = base.select(name("rank", "key").alias("id"), "text").join(meeting, "id", "left_semi")
    sets = scratch.keep(texts.dropDuplicates(["id"]).mapInArrow(_sets(shingle, weighted), "id long, set binary"), "sets")

    def similar(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs whose sets reach the similarity."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        joined = pairs.join(grown(sets.withColumnsRenamed({"id": "a", "set": "set_a"})), "a").join(
            grown(sets.withColumnsRenamed({"id": "b", "set": "set_b"})), "b"
        )
        checked = joined.select("a", "b", "set_a", "set_b").mapInArrow(_verify(similarity), "a long, b long, similar boolean")
        return scratch.keep(checked.where("similar").select("a", "b"), label)

    # each class meets the foremost of its bands' foremost members, the one that shares bands with
    # the most others: of near copies that is the text they were made from, to which most are similar
    leader = groups.groupBy("h", "band", F.hash("h").alias("_part")).agg(F.max(F.struct("deg", "id", "weight")).alias("top"))
    led = groups.join(grown(leader.select("h", "band", "top")), ["h", "band"]).where("id <> top.id")
    led = led.where(F.least("weight", "top.weight") >= F.lit(similarity) * F.greatest("weight", "top.weight"))
    star = led.groupBy("id").agg(F.max("top").alias("top")).select(F.col("top.id").alias("a"), F.col("id").alias("b"))
    links = similar(star, "stars")
    merged = components(links, scratch)
    placed = groups.join(merged, "id", "left").withColumn("c", F.coalesce("component", "id"))
    still = placed.groupBy("h", "band", F.hash("h").alias("_part")).agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    open_ = scratch.keep(placed.join(still.select("h", "band"), ["h", "band"]).select("h", "band", "id", "weight", "c"), "open")
    more = similar(_undecided(open_, sets, similarity, rare, scratch), "links")
    merged = components(links.union(more), scratch)
    placed = members.withColumn("id", name("hr", "hk")).join(merged, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = placed.groupBy("component").agg(F.min(F.struct("rank", "key")).alias("low"))
    clustered = placed.join(lowest, "component").select(
        "rank", "key", "hr", F.col("low.rank").alias("cr"), F.col("low.key").alias("ck")
    )
    alone = signed.where("weight = 0").select("rank", "key", F.col("rank").alias("hr"), F.col("rank").alias("cr"), F.col("key").alias("ck"))
    found = materialise(clustered.union(alone).dropDuplicates(["rank", "key"]), "clusters")
    scratch.drop()
    return found


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: its class of equal sets, its cluster of near-duplicates, whether it stays."""
    found = classes(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), rank_id(id_col, docs.schema).alias("rank"), F.xxhash64(text_or_empty(text_col)).alias("key"))
    return rows.join(found, ["rank", "key"]).select(
        F.col("id").alias(id_col), F.col("hr").alias("class_id"), F.col("cr").alias("cluster_id"),
        ((F.col("rank") == F.col("cr")) & (F.col("key") == F.col("ck"))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all columns, without those whose near-duplicate of smaller id stays."""
    found = classes(docs, id_col, text_col, **options)
    rank, key = free_name(docs, "rank"), free_name(docs, "key")
    gone = found.where("rank <> cr or key <> ck").select(F.col("rank").alias(rank), F.col("key").alias(key))
    condition = (rank_id(id_col, docs.schema) == F.col(rank)) & (F.xxhash64(text_or_empty(text_col)) == F.col(key))
    return docs.join(gone, condition, "left_anti").dropDuplicates([id_col, text_col])
