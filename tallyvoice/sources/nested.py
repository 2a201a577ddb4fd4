"""Call audio in nested Parquet columns, written in chunks so that a slice reads only its row groups.

``binary_path`` walks a schema to the column of the bytes; reading it by that path prunes all others.
``write_chunks`` sorts calls by range, one row a chunk with its first and last sample, so that the
row groups' statistics tell which may hold a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from ..operators import arrays

#: Names that audio columns have.
AUDIO = ("audio", "wav", "waveform")


def binary_path(schema: StructType, names: tuple[str, ...] = AUDIO) -> str:
    """The dotted path of the binary column that is named as audio is, or lies within a column named so."""

    def walk(struct: StructType, path: tuple[str, ...], inside: bool):
        for field in struct.fields:
            named = inside or field.name.lower() in names
            here = (*path, field.name)
            if isinstance(field.dataType, BinaryType) and named:
                yield here
            elif isinstance(field.dataType, StructType):
                yield from walk(field.dataType, here, named)

    found = sorted(walk(schema, (), False), key=len)
    if not found:
        raise ValueError(f"no binary column under any of {names} in {schema.simpleString()}")
    return ".".join(f"`{p}`" for p in found[0])


def read_audio(spark: SparkSession, path: str, keep: list[str]) -> DataFrame:
    """Some columns and the audio's bytes as ``pcm``, wherever it is nested; nothing else is read."""
    rows = spark.read.parquet(path)
    return rows.select(*keep, F.col(binary_path(rows.schema)).alias("pcm"))


def write_chunks(waves: DataFrame, path: str, size: int, rows_a_group: int | None = None) -> None:
    """Waves (call_id, wave) as chunks of ``size`` samples in 16-bit steps: call_id, first, last, audio.bytes.

    A chunk with a sample beyond full scale is written wider, so none is cut off.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size("wave") - 1, F.lit(0)), F.lit(size))
    rows = waves.where("size(wave) > 0").select("call_id", "wave", F.explode(starts).alias("first"))
    samples = F.slice("wave", F.col("first") + 1, F.lit(size))
    rows = rows.select(
        "call_id", "first", (F.col("first") + F.size(samples) - 1).alias("last"), arrays.to_pcm(samples).alias("bytes")
    )
    wide = F.octet_length("bytes") > 2 * (F.col("last") - F.col("first") + 1)
    rows = rows.select("call_id", "first", "last", F.struct("bytes", F.when(wide, "pcm64").otherwise("pcm16").alias("kind")).alias("audio"))
    writer = rows.repartitionByRange("call_id", "first").sortWithinPartitions("call_id", "first").write.mode("overwrite")
    (writer.option("parquet.block.row.count.limit", rows_a_group) if rows_a_group else writer).parquet(path)


def slices(spark: SparkSession, path: str, start: int, end: int, calls: Column | None = None) -> DataFrame:
    """Samples from ``start`` to before ``end`` of the calls that ``calls`` holds for: call_id, wave.

    The bounds are compared with plain columns, so they reach the scan and skip row groups.
    """
    rows = spark.read.parquet(path).where((F.col("first") < end) & (F.col("last") >= start))
    rows = rows.where(calls) if calls is not None else rows
    begin = F.greatest(F.lit(start) - F.col("first"), F.lit(0))
    samples = arrays.from_pcm("audio.bytes", F.col("last") - F.col("first") + 1)
    part = F.slice(samples, begin + 1, F.least(F.lit(end) - 1, F.col("last")) - F.col("first") - begin + 1)
    parts = F.array_sort(F.collect_list(F.struct("first", part.alias("x"))))
    return rows.groupBy("call_id").agg(F.flatten(F.transform(parts, lambda p: p["x"])).alias("wave"))
