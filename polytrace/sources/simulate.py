"""Generated epochs: zeros, and dipoles in a sphere of sensors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectral import lead_field


def null_source(spark: SparkSession, sfreq: float, n_epochs: int, n_channels: int, before: int, after: int, items: int = 1) -> DataFrame:
    """Epochs of zeros; channels are named by number. Nothing is joined: all axes come out of one range."""
    n = before + after
    each = n_channels * n * items
    df = spark.range(n_epochs * each).withColumn("_k", F.col("id") % each)
    out = df.select(
        F.floor(F.col("id") / each).cast("long").alias("epoch_id"),
        F.floor(F.col("_k") / (n * items)).cast("int").alias("channel_idx"),
        F.floor(F.col("_k") % (n * items) / items).cast("int").alias("point"),
        (F.col("_k") % items).cast("int").alias("item"),
        F.lit(0.0).alias("value"),
    )
    out = out.withColumn("channel", (F.col("channel_idx") + 1).cast("string")).withColumn("x", (F.col("point") - before) / F.lit(sfreq / 1000))
    return out if items > 1 else out.drop("item")


def sensors(n: int) -> np.ndarray:
    """Places spread evenly over the upper half of a sphere of radius 12: a spiral of golden angles."""
    k = np.arange(n)
    z = 1 - (k + 0.5) / n
    turn = math.pi * (3 - math.sqrt(5)) * k
    r = np.sqrt(1 - z * z)
    return 12 * np.stack([r * np.cos(turn), r * np.sin(turn), z], axis=1)


#: Fixed values of the simulated sources: place, moment, phase at the start and phase step of each sample (None: uniform noise from 0 to 1).
SOURCES = [((1.0, 1.0, 9.0), (1.0, 0.0, 0.0), 0.0, 0.5), ((-3.0, -1.0, 8.0), (1.0, 0.0, 0.0), 3.0, 0.2), ((-3.0, -1.0, 9.0), (1.0, 0.0, 0.0), 3.0, None)]


def dip_simulate(spark: SparkSession, sfreq: float, n_epochs: int, before: int, after: int, n_channels: int = 37, seed: int = 1, ramp: bool = False, noise: bool = True) -> DataFrame:
    """Potentials of moving dipoles at channels A1, A2 ...: two oscillate with a fixed phase step from sample to sample, through all epochs, the third is noise (none without ``noise``); ``ramp`` lets them grow through each epoch. The lead field is a handful
    of constants and goes into the plan as literals."""
    n = before + after
    at = sensors(n_channels)
    gain = [lead_field(at, np.array(p)) @ np.array(m) for p, m, _, _ in SOURCES]
    times = spark.range(n_epochs * n).select(F.floor(F.col("id") / n).cast("long").alias("epoch_id"), (F.col("id") % n).cast("int").alias("point"), F.col("id").alias("_t"))
    courses = [F.cos(F.lit(phase) + F.col("_t") * F.lit(step)) if step is not None else F.rand(seed) if noise else F.lit(0.0) for _, _, phase, step in SOURCES]
    scale = (F.col("point") + 1) / F.lit(float(n)) if ramp else F.lit(1.0)
    times = times.select("epoch_id", "point", *[(c * scale).alias(f"_s{k}") for k, c in enumerate(courses)])
    rows = F.array(*[F.struct(F.lit(c).alias("c"), *[F.lit(float(g[c])).alias(f"g{k}") for k, g in enumerate(gain)]) for c in range(n_channels)])
    wide = times.withColumn("_g", F.explode(rows))
    value = sum((F.col(f"_s{k}") * F.col(f"_g.g{k}") for k in range(1, len(gain))), F.col("_s0") * F.col("_g.g0"))
    return wide.select("epoch_id", F.col("_g.c").alias("channel_idx"), F.concat(F.lit("A"), (F.col("_g.c") + 1).cast("string")).alias("channel"), "point", ((F.col("point") - before) / F.lit(sfreq / 1000)).alias("x"), value.alias("value"))
