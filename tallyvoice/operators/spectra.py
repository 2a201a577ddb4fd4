"""Channel statistics of calls: energy, activity, slopes, spectral shape, modulation of the envelope.

Waves become rows of frames, so a long call is many rows. Energies, percentiles, activity and slopes are
plain aggregates; frame spectra are made in Arrow batches, many frames a batch; their means per call and
quarter are the vector aggregates of Spark's ``Summarizer``. Only the envelope of a call, bounded by
``seconds``, is one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Framing:
    """Samples a second, of a frame, between frames, of a transform, and the seconds that are looked at."""

    rate: int = 16000
    frame: int = 400
    hop: int = 160
    size: int = 512
    seconds: float = 10.0

    @property
    def most(self) -> int:
        return int(self.seconds * self.rate)

    @property
    def least(self) -> int:
        return self.frame + 10 * self.hop

    def frequencies(self) -> list[float]:
        """Of the bins, as shares of the rate."""
        return [k / self.size for k in range(self.size // 2 + 1)]


# Percentiles of energies and of their steps, activity limits in dB below the loud ones, modulation bands in Hz.
ENERGY, STEPS, BELOW, BANDS = (5, 10, 25, 50, 75, 90, 95), (1, 5, 10, 25, 75, 90, 95), (10, 20, 35), ((2, 8), (8, 16), (0.5, 2))
WHOLE_BAND = (0.5, 32)
# 500 Hz, 3 kHz, 4 kHz and 0.3 to 7.5 kHz at 16 kHz, as shares of the rate.
LOW, HIGH, TOP, TILT = 500 / 16000, 3000 / 16000, 4000 / 16000, (300 / 16000, 7500 / 16000)


def framed(waves: DataFrame, framing: Framing) -> DataFrame:
    """call_id, k, x: the frames of each call's first seconds; short and empty waves are filled up with silence."""
    wave = F.slice(F.coalesce("wave", F.array().cast("array<double>")), 1, framing.most)
    rows = waves.select("call_id", wave.alias("w"))
    rows = rows.select("call_id", F.concat("w", F.array_repeat(F.lit(0.0), F.greatest(F.lit(framing.least) - F.size("w"), F.lit(0)))).alias("w"))
    last = F.floor((F.size("w") - framing.frame) / framing.hop).cast("int")
    rows = rows.select("call_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    return rows.select("call_id", "k", F.slice("w", F.col("k") * framing.hop + 1, F.lit(framing.frame)).alias("x"))


def with_energy(frames: DataFrame) -> DataFrame:
    """Add env and e: root mean square, and power in dB."""
    power = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v) / F.size("x")
    rows = frames.withColumn("power", power)
    return rows.withColumns({"env": F.sqrt("power"), "e": 10 * F.log10(F.col("power") + 1e-10)}).drop("power")


def energy_statistics(frames: DataFrame) -> DataFrame:
    """Per call: percentiles of energy and of its steps, spreads, shares of active frames, mean falls and rises."""
    step = F.col("e") - F.lag("e").over(Window.partitionBy("call_id").orderBy("k"))
    share = lambda values: F.array(*[F.lit(v / 100) for v in values])
    rows = frames.select("call_id", "k", "e").withColumn("d", step)
    found = rows.groupBy("call_id").agg(
        F.percentile("e", share(ENERGY)).alias("pe"), F.percentile("d", share(STEPS)).alias("pd"), F.collect_list("e").alias("all"),
        F.coalesce(F.avg(F.when(F.col("d") < 0, F.col("d"))), F.lit(0.0)).alias("slope_neg_mean"),
        F.coalesce(F.avg(F.when(F.col("d") > 0, F.col("d"))), F.lit(0.0)).alias("slope_pos_mean"),
    )
    e = {p: F.col("pe")[i] for i, p in enumerate(ENERGY)}
    active = lambda below: F.size(F.filter("all", lambda x: x > e[95] - below)) / F.size("all")
    return found.select(
        "call_id", *[e[p].alias(f"e_p{p}") for p in ENERGY], (e[90] - e[10]).alias("e_p90_p10"), (e[90] - e[50]).alias("e_p90_p50"),
        (e[50] - e[10]).alias("e_p50_p10"), *[active(b).alias(f"active_{b}db") for b in BELOW],
        *[F.col("pd")[i].alias(f"slope_p{p}") for i, p in enumerate(STEPS)], "slope_neg_mean", "slope_pos_mean",
    )


def spectra_of(batches: Iterator[pa.RecordBatch], framing: Framing) -> Iterator[pa.RecordBatch]:
    """Power spectra of frames, a batch at a time."""
    shape = np.hanning(framing.frame)
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, framing.frame)
        power = np.abs(np.fft.rfft(x * shape, framing.size, axis=1)) ** 2
        bins = pa.ListArray.from_arrays(pa.array(np.arange(0, power.size + 1, power.shape[1], dtype=np.int32)), pa.array(power.reshape(-1)))
        yield pa.record_batch([*[batch.column(c) for c in ("call_id", "k", "e")], bins], names=["call_id", "k", "e", "bins"])


def _shape(bins: str, framing: Framing, name: str) -> list[Column]:
    """Flatness, centre in kHz, and the shares below and above, of a mean spectrum."""
    at = framing.frequencies()
    raised = F.transform(bins, lambda v: v + 1e-12)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    within = lambda holds: total(F.filter(raised, lambda v, i: F.get(F.array(*[F.lit(holds(f)) for f in at]), i)))
    centre = total(F.transform(raised, lambda v, i: v * i)) * framing.rate / framing.size / 1000
    flat = F.exp(total(F.transform(raised, lambda v: F.log(v))) / len(at)) / (total(raised) / len(at))
    return [
        flat.alias(f"{name}_flatness"), (centre / total(raised)).alias(f"{name}_centroid_khz"),
        (within(lambda f: f < LOW) / total(raised)).alias(f"{name}_low500"), (within(lambda f: f >= HIGH) / total(raised)).alias(f"{name}_high3k"),
    ]


def spectral_statistics(frames: DataFrame, framing: Framing) -> DataFrame:
    """Per call: shapes of the quietest and the loudest quarter of frames, three at least, tilt, and the share of high power."""
    schema = f"call_id {frames.schema['call_id'].dataType.simpleString()}, k int, e double, bins array<double>"
    rows = frames.select("call_id", "k", "e", "x").mapInArrow(lambda b: spectra_of(b, framing), schema)
    by = Window.partitionBy("call_id")
    some = F.greatest(F.floor(F.count(F.lit(1)).over(by) / 4), F.lit(3))
    rows = rows.withColumns(
        {
            "quiet": (F.row_number().over(by.orderBy("e", "k")) <= some).cast("double"),
            "loud": (F.row_number().over(by.orderBy(F.desc("e"), F.desc("k"))) <= some).cast("double"), "v": array_to_vector("bins"),
        }
    )
    mean = lambda weight: vector_to_array(Summarizer.mean(F.col("v"), weight))
    found = rows.groupBy("call_id").agg(mean(F.col("quiet")).alias("quiet"), mean(F.col("loud")).alias("loud"), mean(F.lit(1.0)).alias("mean"))
    at = framing.frequencies()
    tilt = [i for i, f in enumerate(at) if TILT[0] <= f <= TILT[1]]
    khz = [at[i] * framing.rate / 1000 for i in tilt]
    middle = sum(khz) / len(khz)
    spread = sum((f - middle) ** 2 for f in khz)
    level = lambda i: 10 * F.log10(F.col("mean")[i] + 1e-12)
    slope = sum((level(i) * F.lit((f - middle) / spread) for i, f in zip(tilt, khz, strict=True)), F.lit(0.0))
    top = next(i for i, f in enumerate(at) if f >= TOP)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    # sums over frames are means times their number: the tiny floor under the total is one for all frames
    high = total(F.slice("mean", top + 1, len(at) - top)) / (total(F.col("mean")) + 1e-12)
    return found.select("call_id", *_shape("quiet", framing, "quiet"), *_shape("loud", framing, "loud"), slope.alias("ltas_slope_db_per_khz"), high.alias("hf_ratio_4k"))


def modulation_of(batches: Iterator[pa.RecordBatch], framing: Framing) -> Iterator[pa.RecordBatch]:
    """Shares of the envelope's power in bands of slow frequencies."""
    for batch in batches:
        out = np.zeros((batch.num_rows, len(BANDS)))
        for i, env in enumerate(batch.column("env")):
            x = env.values.to_numpy()
            power = np.abs(np.fft.rfft(x - x.mean())) ** 2
            hz = np.fft.rfftfreq(len(x), framing.hop / framing.rate)
            share = lambda band, power=power, hz=hz: power[(hz >= band[0]) & (hz < band[1])].sum()
            out[i] = [share(b) / (share(WHOLE_BAND) + 1e-12) for b in BANDS]
        names = ["mod_" + "_".join(f"{x:g}".replace(".", "p") for x in b) for b in BANDS]
        yield pa.record_batch([batch.column("call_id"), *[pa.array(out[:, i]) for i in range(len(BANDS))]], names=["call_id", *names])


def modulation_statistics(frames: DataFrame, framing: Framing) -> DataFrame:
    kind = frames.schema["call_id"].dataType.simpleString()
    rows = frames.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "env"))), lambda c: c["env"]).alias("env"))
    return rows.mapInArrow(lambda b: modulation_of(b, framing), f"call_id {kind}, mod_2_8 double, mod_8_16 double, mod_0p5_2 double")


def channel_statistics(waves: DataFrame, framing: Framing | None = None) -> DataFrame:
    """All 35 statistics of each call of (call_id, wave); call ids are not null and not repeated."""
    framing = framing or Framing()
    frames = with_energy(framed(waves, framing))
    parts = (energy_statistics(frames), spectral_statistics(frames, framing), modulation_statistics(frames, framing))
    return parts[0].join(parts[1], "call_id").join(parts[2], "call_id")
