"""Small helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType, StructType

#: Rank given to rows whose id is null: before every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir`` or ``setCheckpointDir``.

    Where the session has none, a temporary folder is set in local mode only (one machine, as in
    tests); on a cluster a RuntimeError says what to set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyvoice-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    Lost executors do not lose the rows, and several consumers do not recompute them.
    """
    return _write(df, label)[0]


class Scratch:
    """Tables in the shared folder that are only needed until ``drop``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``materialise``, with the folder noted for ``drop``."""
        table, path = _write(df, label)
        self.paths.append(path)
        return table

    def drop(self) -> None:
        """Delete the tables; nothing may read them any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
        self.paths = []


def grown(df: DataFrame) -> DataFrame:
    """One side of a join whose sides both grow with the documents: they meet by a merge at every size.

    Spark's estimate goes by the size of files and the width of rows. It takes exploded or well compressed rows
    for small ones, and would send hundreds of MB of them through the driver to broadcast them.
    """
    return df.hint("merge")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(name: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def rank_id(name: str, schema: StructType | None = None) -> Column:
    """The id as a rank: nulls come before all others. With a schema, ids must be whole numbers."""
    if schema is not None and not isinstance(schema[name].dataType, IntegralType | NullType):
        raise TypeError(f"{name} has to be a whole number, not {schema[name].dataType.simpleString()}")
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def held(name: str, expression: Column) -> Column:
    """``expression``, whose lambdas look into column ``name``, with the column kept as computed.

    The optimizer merges projections when a column is used once; inside a lambda that one use would
    compute the column again for each element. A second use keeps it.
    """
    return F.when(F.col(name).isNotNull(), expression)


def settled(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` behind a generator.

    Filters on it then stay above the projections that compute it. Pushed below, they would hold its
    whole expression again, and inside lambdas for each element.
    """
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != column], F.explode_outer(F.array(column)).alias(column)
    )


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and the n+1 offsets of its rows."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` whose strings in ``column`` hold about ``max_bytes`` at most.

    A single longer text is a part of its own; no text is cut.
    """
    _, ends = utf8_buffer(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield batch.slice(start, stop - start)
        start = stop
