"""Typed scans of clip protocols, score tables and call audio, and their sinks.

Text layouts are data: how many fields a line has and where the wanted ones are. A line of another
width or an unknown label fails the job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COLUMNS = ("utt_id", "label", "attack", "speaker", "codec", "dataset", "attack_key")


@dataclass(frozen=True)
class Layout:
    """Fields of a whitespace-separated protocol: width, and 0-based places (None: not there)."""

    fields: int
    utt_id: int
    speaker: int
    attack: int
    key: int
    codec: int | None = None


# Widths and places of the public protocol files.
LAYOUTS = {
    "asv19": Layout(5, utt_id=1, speaker=0, attack=3, key=4),
    "asv5": Layout(10, utt_id=1, speaker=0, attack=7, key=8, codec=3),
    "asv21": Layout(8, utt_id=0, speaker=1, attack=4, key=5, codec=2),
    "calls": Layout(9, utt_id=0, speaker=1, attack=7, key=8, codec=2),
}
FAKE = "spoof"
GENUINE = ("bonafide", "bona-fide")
ITW_SCHEMA = "file string, speaker string, label string"


def checked(value: Column, holds: Column, message: Column) -> Column:
    """``value`` where a condition holds; elsewhere the job fails with a message."""
    return F.when(holds, value).otherwise(F.raise_error(message).cast("string"))


def _samples(rows: DataFrame, dataset: str) -> DataFrame:
    """Label and attack key from utt_id, speaker, codec, attack and key."""
    fake = F.col("key") == FAKE
    rows = rows.select(
        "utt_id", fake.cast("int").alias("label"), F.when(fake, F.col("attack")).otherwise("-").alias("attack"),
        "speaker", F.when(F.col("codec") == "none", "-").otherwise(F.coalesce("codec", F.lit("-"))).alias("codec"),
        F.lit(dataset).alias("dataset"),
    )
    return rows.withColumn("attack_key", F.concat_ws(":", "dataset", "attack")).select(*COLUMNS)


def read_text_protocol(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    layout = LAYOUTS[dataset]
    parts = spark.read.text(path).where(F.trim("value") != "").select("value", F.split(F.trim("value"), r"\s+").alias("f"))
    wide = F.size("f") == layout.fields
    message = F.concat(F.lit(f"{dataset}: expected {layout.fields} fields: "), F.col("value"))
    at = lambda i: checked(F.get("f", F.lit(i)), wide, message)
    key = at(layout.key)
    known = F.get("f", F.lit(layout.key)).isin(FAKE, *GENUINE)
    return _samples(
        parts.select(
            at(layout.utt_id).alias("utt_id"), at(layout.speaker).alias("speaker"), at(layout.attack).alias("attack"),
            checked(key, ~wide | known, F.concat(F.lit(f"{dataset}: unknown label: "), F.col("value"))).alias("key"),
            (at(layout.codec) if layout.codec is not None else F.lit("-")).alias("codec"),
        ),
        dataset,
    )


def read_itw(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: file, speaker, label; the extension is no part of the id."""
    rows = spark.read.csv(path, header=True, schema=ITW_SCHEMA, mode="FAILFAST")
    label = F.lower(F.trim("label"))
    known = label.isin(FAKE, "bona-fide")
    return _samples(
        rows.select(
            F.regexp_replace(F.trim("file"), r"\.[^.]*$", "").alias("utt_id"), F.trim("speaker").alias("speaker"),
            F.lit("itw").alias("attack"), checked(label, known, F.concat(F.lit("itw: unknown label: "), F.col("label"))).alias("key"),
            F.lit("-").alias("codec"),
        ),
        "itw",
    )


def read_protocol(
    spark: SparkSession, path: str, dataset: str, limit: int | None = None, available: DataFrame | None = None, seed: int = 0
) -> DataFrame:
    """Any protocol by its dataset's name; only clips in ``available`` (utt_id); a hash sample of ``limit``."""
    if dataset == "itw":
        rows = read_itw(spark, path)
    elif dataset in LAYOUTS:
        rows = read_text_protocol(spark, path, dataset)
    else:
        raise ValueError(f"unknown dataset {dataset!r}; expected one of {sorted([*LAYOUTS, 'itw'])}")
    if available is not None:
        rows = rows.join(available.select("utt_id").distinct(), "utt_id", "left_semi")
    if limit:
        rows = rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("utt_id"))), "utt_id").limit(limit)
    return rows


def audio_inventory(spark: SparkSession, path: str, names: str = "") -> DataFrame:
    """utt_id, path and bytes of the audio files below a folder whose name matches; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{flac,wav}").load(path)
    name = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    return files.select(name.alias("utt_id"), "path", F.col("length").alias("bytes")).where(F.col("utt_id").rlike(names))


def corpora(spark: SparkSession, root: str, required: tuple[str, ...] = ()) -> DataFrame:
    """corpus (the folder below ``root``), files and bytes; a required corpus without files is a ValueError."""
    inside = F.regexp_extract("path", rf"/{root.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/", 1)
    found = audio_inventory(spark, root).groupBy(inside.alias("corpus")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    there = {r.corpus for r in found.where(F.col("corpus").isin(*required)).select("corpus").collect()} if required else set()
    if missing := sorted(set(required) - there):
        raise ValueError(f"no audio files of {missing} below {root}")
    return found


NOTES = "utterance_id string, speaker_id string, codec string, transmission string, attack_id string, phase string, trim string"


def read_noted_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Clips whose attributes stand as JSON in ``notes``; audio is not read; labels must agree with attacks."""
    rows = spark.read.parquet(path).select("label", F.from_json("notes", NOTES).alias("n"))
    key = F.when(F.col("label") == 1, FAKE).otherwise("bonafide")
    agrees = (key == FAKE) == (F.col("n.attack_id") != "bonafide")
    message = F.concat(F.lit("label disagrees with attack: "), F.col("n.utterance_id"))
    return _samples(
        rows.select(
            F.col("n.utterance_id").alias("utt_id"), F.col("n.speaker_id").alias("speaker"), F.col("n.attack_id").alias("attack"),
            checked(key, agrees, message).alias("key"), F.col("n.codec").alias("codec"),
        ),
        "asv21",
    )


def repeated_ids(rows: DataFrame) -> DataFrame:
    """Ids that stand more than once."""
    return rows.groupBy("utt_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_ids(rows: DataFrame) -> DataFrame:
    """The rows; an id that stands more than once fails the job."""
    n = F.count(F.lit(1)).over(Window.partitionBy("utt_id"))
    message = F.concat(F.lit("repeated id: "), F.col("utt_id"))
    checked_id = F.when(n == 1, F.col("utt_id")).otherwise(F.raise_error(message).cast("string"))
    return rows.withColumn("utt_id", checked_id)


def read_scores(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One score column of a wide score table: clip_index, label, attack, codec, p."""
    header = spark.read.csv(path, header=True)
    if column not in header.columns:
        raise ValueError(f"no column {column!r} in {path}")
    return header.select(
        F.col("clip_index").cast("long").alias("clip_index"), F.col("label").cast("int").alias("label"), "attack", "codec",
        F.col(f"`{column}`").cast("double").alias("p"),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header or Parquet, by extension."""
    return spark.read.csv(path, header=True) if path.lower().endswith(".csv") else spark.read.parquet(path)


def write_scores(long: DataFrame, path: str, branches: list[str], times: list[float]) -> None:
    """Long scores (clip_index, label, attack, codec, branch, t, p) as a wide CSV of five decimals."""
    name = F.concat(F.col("branch"), F.lit("_"), F.col("t").cast("int").cast("string"), F.lit("s"))
    wanted = [f"{b}_{int(t)}s" for b in branches for t in times]
    keys = ["clip_index", "label", "attack", "codec"]
    wide = long.withColumn("column", name).groupBy(*keys).pivot("column", wanted).agg(F.round(F.first("p"), 5))
    wide.write.mode("overwrite").csv(path, header=True)


def write_protocol(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Space-separated text; null is '-'. The committer publishes whole files only."""
    rows.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("value")).write.mode("overwrite").text(path)


def write_json_report(row: DataFrame, path: str) -> None:
    row.select(F.to_json(F.struct(*row.columns)).alias("value")).write.mode("overwrite").text(path)


def chunk_calls(waves: DataFrame, size: int) -> DataFrame:
    """Recordings (call_id, wave) as keyed chunk records with seq and an end mark on the last."""
    n = F.greatest(F.ceil(F.size("wave") / size).cast("int"), F.lit(1))
    rows = waves.select("call_id", "wave", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return rows.select("call_id", "seq", F.slice("wave", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("n") - 1).alias("eof"))


def chunk_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Chunk records of a broker topic: call_id, seq, eof, value (needs Spark's connector on the class path)."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true").load()
    header = lambda k: F.filter("headers", lambda h: h["key"] == k)[0]["value"].cast("string")
    return rows.select(
        F.col("key").cast("string").alias("call_id"), header("seq").cast("long").alias("seq"), (header("eof") == "1").alias("eof"),
        "value", F.col("timestamp").alias("ts"),
    )


def verdict_records(verdicts: DataFrame) -> DataFrame:
    """Verdicts as records for a broker sink: key call_id, value JSON."""
    return verdicts.select(F.col("call_id").cast("string").alias("key"), F.to_json(F.struct(*verdicts.columns)).alias("value"))


#: Splits that may be trained on, and the one that tunes unless attacks are held out.
TRAINING, TUNING = ("train", "dev"), "asv5:dev"


def training_splits(entries: list[str], held_out: bool = False, datasets: tuple[str, ...] = ("asv5", "asv19")) -> list[tuple[str, str]]:
    """Checked ``dataset:split`` entries; test splits and unknown sets are refused, the tuning split unless attacks are held out."""
    found = []
    for entry in entries:
        dataset, _, split = entry.partition(":")
        if dataset not in datasets or split not in TRAINING:
            raise ValueError(f"{entry!r} is no training split; expected one of {datasets} and one of {TRAINING}")
        if entry == TUNING and not held_out:
            raise ValueError(f"{TUNING} is the tuning set unless attacks are held out")
        found.append((dataset, split))
    return found
