"""The tables in their roles: scored clips, call chunks, documents as clips of speakers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored clips: label y (1 = fake), a continuous score p, branches a, b, c, group, speaker, attack."""
    fake = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip"),
        F.when(fake, 1).otherwise(0).alias("y"),
        (F.col("l_extendedprice") / 105000).alias("p"),
        (F.col("l_discount") * 10 + 0.0).alias("a"), (F.col("l_tax") * 12 + 0.0).alias("b"), (F.col("l_quantity") / 50).alias("c"),
        F.col("l_linestatus").alias("grp"), F.col("l_suppkey").alias("speaker"),
        F.when(fake, F.concat(F.lit("A"), (F.col("l_linenumber") % 4).cast("string"))).otherwise("-").alias("attack"),
    )


SCORES = """scores AS (
  SELECT l_orderkey AS clip, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice / 105000 AS p,
         l_discount * 10 + 0.0 AS a, l_tax * 12 + 0.0 AS b, l_quantity / 50 AS c, l_linestatus AS grp, l_suppkey AS speaker,
         CASE WHEN l_returnflag = 'R' THEN 'A' || (l_linenumber % 4)::VARCHAR ELSE '-' END AS attack
  FROM lineitem)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call chunks: call_id, seq, ts, and a level p."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("kind"), F.col("value").alias("p"),
    )


CHUNKS = """chunks AS (
  SELECT user_id AS call_id, event_id AS seq, ts, event_type AS kind, value AS p FROM events)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clips: id, speaker, dataset, seconds, label (quality; null if unlabelled)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("speaker"), F.col("lang").alias("dataset"), (F.col("n_chars") / 100).alias("seconds")
    ).join(labels, "doc_id", "left")


CLIPS = """clips AS (
  SELECT d.doc_id, source AS speaker, lang AS dataset, n_chars / 100 AS seconds, quality AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
