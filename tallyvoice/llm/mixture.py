"""Mixing sources to target weights (operator 12), with DataFrame functions only.

Pivotal dependent rounding. A source whose target is r times its size wants r copies of each of its
documents: the whole part of r for all, and one more with probability of the fraction. Two documents
with fractional probabilities are paired; words are moved from one to the other, either way with the
probability that keeps both expectations, until one of them is decided. Their expected words stay the
same, so a source's taken words keep to its target, whatever the sizes.

The pairs form a reduction tree. Documents of one source whose sizes have the same number of binary
digits are dealt by a hash to leaves of about ``FAN``; a leaf decides all but one; the undecided ones
of ``FAN`` leaves meet in the next node, and so on. No node holds more rows than a leaf, however large
a source is. The one left per number of digits (63 a source at most) are decided from the largest on,
each handing on to the next smaller one the words it took too many or too few. A document that is more
than 1/``FEW`` of its source is decided before the tree, from the largest on, paired with the pool of
all smaller ones, to which the words go that it takes too many or too few.

Documents travel as short rows (id, hash, size) that are counted once; a level of the tree is written
to the shared folder. All chance comes from hashes of ids and texts, so reruns agree.

Defined results: a null or empty text has size 0, and rows of size 0 take 0 words; a null source is a
source of its own, last in order; null and repeated ids are rows like others, and rows equal in id and
text are interchangeable; other columns are ignored; without documents there are no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, materialise, text_or_empty
from .quality import words_of

#: Weights of the sources in order, repeating, and the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of a leaf on average, and nodes that meet in the next one.
FAN = 64
#: A document of more than one part in so many of its source is decided before the tree; so many a source at most.
FEW = 500
SOURCE = ["name", "missing"]
_EXACT = "decimal(38,0)"


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), f), 1)


def chance(seed: int, *keys: Column) -> Column:
    """A number from 0 to below 1 that depends on the keys only."""
    bits = 53
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 64 - bits) / F.lit(float(1 << bits))


def measured(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """id, name and missing of the source, size in words, and a hash of id and text."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        F.col(source_col).isNull().alias("missing"), F.size(words_of(text)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), text).alias("draw"),
    )


def ordered_sources(sizes: DataFrame, keep, weights: Sequence[int]) -> DataFrame:
    """name, missing, source_size, weight: sources are numbered by ranges of names and offsets of the ranges."""
    sums = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    # written, because the ranges must be the same for the offsets and for the numbers
    dealt = keep(sums.repartitionByRange("missing", "name").withColumn("range", F.spark_partition_id()), "mixture-sources")
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.alias("a").join(F.broadcast(counts.alias("b")), F.col("b.range") < F.col("a.range"), "left").groupBy(
        F.col("a.range").alias("range")
    ).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("missing", "name")) - 1 + F.col("before")
    nth = F.pmod(place, F.lit(len(weights))).cast("int")
    return dealt.join(F.broadcast(before), "range").select(
        *SOURCE, "source_size", F.get(F.array(*[F.lit(w).cast("long") for w in weights]), nth).alias("weight")
    )


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """Add target: shares by weight; what exceeds ``most`` times a source's size is shared again until none does.

    A round is one aggregate over the sources; the capped ones only become more, so rounds end.
    """
    size, weight = F.col("source_size"), F.col("weight")
    whole = sources.agg(F.sum(size).cast(_EXACT).alias("words"), F.sum(weight).alias("free"), F.count(F.lit(1)).alias("n")).first()
    words, free, capped, known = whole["words"] or 0, whole["free"] or 0, F.lit(False), 0
    while free:
        # exact: weight * words / free > most * size
        capped = weight.cast("decimal(10,0)") * F.lit(int(words)).cast("decimal(28,0)") > (
            F.lit(most).cast("decimal(4,0)") * size.cast("decimal(19,0)")
        ) * F.lit(int(free)).cast("decimal(15,0)")
        over = sources.where(capped).agg(F.sum(size).cast(_EXACT).alias("size"), F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n")).first()
        if over["n"] == known:
            break
        known = over["n"]
        words, free = (whole["words"] or 0) - most * (over["size"] or 0), whole["free"] - (over["weight"] or 0)
    level = F.lit(float(words)) * weight / F.lit(float(free or 1))
    if not free:
        capped = F.lit(True)
    return sources.withColumn("capped", capped).withColumn(
        "target", F.when(F.col("capped"), (most * size).cast("double")).otherwise(F.least(level, (most * size).cast("double")))
    )


def paired(units: str) -> Column:
    """Decide all but one of an array of units (draw, id, size, p): a struct of the undecided one and the decided."""

    def changed(x: Column, p: Column) -> Column:
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        return F.struct(x["draw"].alias("draw"), x["id"].alias("id"), x["size"].alias("size"), inside.alias("p"))

    def moved(z: Column) -> Column:
        """z: a and b, the words that may go up (from b to a) or down, and which way they go."""
        a, b, up, down = z["a"], z["b"], z["up"], z["down"]
        a_done = F.when(z["goes_up"], z["up"] == z["full_a"]).otherwise(z["down"] == z["empty_a"])
        p_a = F.when(z["goes_up"], a["p"] + up / a["size"]).otherwise(a["p"] - down / a["size"])
        p_b = F.when(z["goes_up"], b["p"] - up / b["size"]).otherwise(b["p"] + down / b["size"])
        more = F.when(a_done, z["goes_up"]).otherwise(~z["goes_up"])
        return F.struct(
            F.when(a_done, changed(b, p_b)).otherwise(changed(a, p_a)).alias("left"),
            F.concat(z["done"], F.when(a_done, _one(a, more)).otherwise(_one(b, more))).alias("done"),
        )

    def meet(acc: Column, b: Column) -> Column:
        a = acc["left"]
        full_a, empty_a = (1 - a["p"]) * a["size"], a["p"] * a["size"]
        room = F.struct(
            a.alias("a"), b.alias("b"), acc["done"].alias("done"), full_a.alias("full_a"), empty_a.alias("empty_a"),
            F.least(full_a, b["p"] * b["size"]).alias("up"), F.least(empty_a, (1 - b["p"]) * b["size"]).alias("down"),
        )
        drawn = lambda r: F.struct(
            *[r[c].alias(c) for c in ("a", "b", "done", "full_a", "empty_a", "up", "down")],
            (chance(1, r["a"]["draw"], r["b"]["draw"]) * (r["up"] + r["down"]) < r["down"]).alias("goes_up"),
        )
        return bound(bound(room, drawn), moved)

    first = F.element_at(units, 1)
    rest = F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0)))
    return F.aggregate(rest, F.struct(first.alias("left"), _none_of(units).alias("done")), meet)


def _one(x: Column, more: Column) -> Column:
    return F.array(F.struct(x["id"].alias("id"), x["size"].alias("size"), more.cast("int").alias("more")))


def _none_of(units: str) -> Column:
    return F.slice(_one(F.element_at(units, 1), F.lit(0)), 1, 0)


def against_pool(units: str, wanted: Column, room: Column) -> Column:
    """Decide units from the first on, each paired with the pool of all that is left of its source.

    wanted and room: words to take from the source and words that it has. A unit is taken with the
    share that is wanted of the room; what it takes more or less than that share is the pool's.
    """

    def step(acc: Column, x: Column) -> Column:
        def choose(z: Column) -> Column:
            return F.struct(
                (z["wanted"] - F.when(z["more"], x["size"]).otherwise(0)).alias("wanted"), (z["room"] - x["size"]).alias("room"),
                F.concat(z["done"], _one(x, z["more"])).alias("done"),
            )

        more = acc["wanted"] / acc["room"] > chance(2, x["draw"])
        return bound(F.struct(acc["wanted"].alias("wanted"), acc["room"].alias("room"), acc["done"].alias("done"), more.alias("more")), choose)

    return F.aggregate(units, F.struct(wanted.alias("wanted"), room.alias("room"), _none_of(units).alias("done")), step)


def settled_in_turn(units: str) -> Column:
    """Decide units from the first on; each hands on the words it took too many or too few."""

    def step(acc: Column, x: Column) -> Column:
        def choose(z: Column) -> Column:
            more = z["owed"] / x["size"] > chance(2, x["draw"])
            return F.struct(
                (z["owed"] - F.when(more, x["size"]).otherwise(0)).alias("owed"), F.concat(acc["done"], _one(x, more)).alias("done")
            )

        return bound(F.struct((x["p"] * x["size"] + acc["owed"]).alias("owed")), choose)

    return F.aggregate(units, F.struct(F.lit(0.0).alias("owed"), _none_of(units).alias("done")), step)["done"]


def plan(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """id, source, size, source_size, target, copies, taken: one row per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    try:
        found = _plan(spark, scratch.keep(measured(docs, id_col, source_col, text_col), "mixture-sizes"), scratch, weights, most)
        return materialise(found.withColumnRenamed("id", id_col), "mixture")
    finally:
        scratch.drop()


def _plan(spark: SparkSession, sizes: DataFrame, scratch: Scratch, weights: Sequence[int], most: int) -> DataFrame:
    of_source = ["source_size", "target", "whole"]
    sources = with_targets(scratch.keep(ordered_sources(sizes, scratch.keep, weights), "mixture-weights"), most)
    ratio = F.when(F.col("capped"), F.lit(float(most))).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = scratch.keep(
        sources.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("int")).select(
            *SOURCE, *of_source, (F.col("ratio") - F.col("whole")).alias("p")
        ), "mixture-targets",
    )
    unit = lambda x: F.struct(*[x[c].alias(c) for c in ("draw", "id", "size", "p")])
    same = [F.first(c).alias(c) for c in of_source]
    listed = lambda x: F.transform(F.sort_array(F.collect_list(x), asc=False), unit)

    # documents that are a large part of their source, the largest first, against the pool of all smaller ones
    rows = sizes.join(sources, SOURCE).withColumn("large", (F.col("p") > 0) & (F.col("size") * FEW > F.col("source_size")))
    large = rows.where("large").groupBy(*SOURCE).agg(*same, F.first("p").alias("p"), listed(F.struct("size", "draw", "id", "p")).alias("units"))
    large = large.withColumn("pool", against_pool("units", F.col("p") * F.col("source_size"), F.col("source_size")))
    large = scratch.keep(
        large.select(*SOURCE, *of_source, F.col("pool.wanted").alias("wanted"), F.col("pool.room").alias("room"), F.col("pool.done").alias("done")),
        "mixture-large",
    )
    done = [large.select(*SOURCE, *of_source, "done")]
    share = F.when(F.col("room") > 0, F.col("wanted") / F.col("room")).when(F.col("room").isNull(), F.col("p")).otherwise(0.0)
    sources = sources.join(large.select(*SOURCE, "wanted", "room"), SOURCE, "left").select(
        *SOURCE, *of_source, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("p")
    )
    node_key = [*SOURCE, "digits"]
    rows = rows.where("not large").withColumn("digits", F.length(F.bin("size"))).select(*node_key, "id", "draw", "size")
    groups = rows.groupBy(*node_key).agg(F.ceil(F.count(F.lit(1)) / FAN).cast("long").alias("leaves"))
    groups = scratch.keep(groups.join(sources, SOURCE), "mixture-groups")
    rows = rows.join(groups, node_key)
    open_ = (F.col("p") > 0) & (F.col("p") < 1) & (F.col("size") > 0)
    closed = F.array(F.struct("id", "size", (F.col("p") >= 1).cast("int").alias("more")))
    done.append(rows.where(~open_).select(*SOURCE, *of_source, closed.alias("done")))
    level = rows.where(open_).select(*node_key, *of_source, F.pmod("draw", F.col("leaves")).alias("node"), F.struct("draw", "id", "size", "p").alias("unit"))
    nodes = groups.where("p > 0 and p < 1").agg(F.max("leaves")).first()[0] or 1
    while True:
        met = level.groupBy(*node_key, "node").agg(*same, F.sort_array(F.collect_list("unit")).alias("units"))
        met = scratch.keep(met.withColumn("pair", paired("units")).drop("units"), "mixture-level")
        done.append(met.select(*SOURCE, *of_source, F.col("pair.done").alias("done")))
        level = met.select(*node_key, *of_source, F.floor(F.col("node") / FAN).alias("node"), F.col("pair.left").alias("unit"))
        if nodes <= 1:
            break
        nodes = -(-nodes // FAN)
    # one unit per number of digits is left, the largest come first
    last = level.groupBy(*SOURCE).agg(*same, listed(F.struct("unit.size", "unit.draw", "unit.id", "unit.p")).alias("units"))
    done.append(last.select(*SOURCE, *of_source, settled_in_turn("units").alias("done")))
    one = functools.reduce(DataFrame.union, done).select(*SOURCE, *of_source, F.explode("done").alias("d"))
    copies = F.col("whole") + F.col("d.more")
    return one.select(
        F.col("d.id").alias("id"), F.when(~F.col("missing"), F.col("name")).alias("source"), F.col("d.size").alias("size"),
        "source_size", "target", F.when(F.col("d.size") > 0, copies).otherwise(0).alias("copies"),
        (copies * F.col("d.size")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixture itself: each document as often as its row of ``plan`` says, with all its columns.

    Rows of equal id, source and size are matched in any order.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    size = F.size(words_of(text_or_empty(text_col))).cast("long")
    left = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), row)
    right = planned.select(F.col(id_col).alias("id"), "source", "size", "copies")
    same = Window.partitionBy("id", "source", "size")
    left = left.withColumn("nth", F.row_number().over(same.orderBy(F.lit(1)))).alias("l")
    right = right.withColumn("nth", F.row_number().over(same.orderBy(F.desc("copies")))).where("copies > 0").alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("id", "source", "size", "nth")]
    return left.join(right, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns, and the copies."""
    return plan(docs, id_col=id_col).select(id_col, "size", "source_size", "target", "taken", "source", "copies")
