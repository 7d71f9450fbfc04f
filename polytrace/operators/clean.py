"""Composed corrections: ocular and gradient artefacts, slow drifts, spindles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..epochs import axes
from . import paradigm, spectral


def regress_out(df: DataFrame, reference: str) -> DataFrame:
    """Every channel minus its regression on a reference channel (ocular correction: data - reference(t) * map); the reference itself goes."""
    ref = df.where(F.col("channel") == reference).select("epoch_id", "point", F.col("value").alias("_r"))
    met = df.where(F.col("channel") != reference).join(ref, ["epoch_id", "point"])
    # slopes over all epochs of a channel: summed first, then joined, so that no channel lands in one task
    slope = met.groupBy("channel").agg(F.regr_slope("value", "_r").alias("_b"))
    return met.join(slope, "channel").withColumn("value", F.col("value") - F.col("_b") * F.col("_r")).select(*df.columns)


def template_subtract(df: DataFrame, period: int) -> DataFrame:
    """Minus the mean of an artefact that repeats every ``period`` points, for each trace."""
    phase = F.pmod("point", F.lit(period))
    keys = axes(df, "point")
    mean = df.groupBy(*keys, phase.alias("_k")).agg(F.avg("value").alias("_m"))
    return df.withColumn("_k", phase).join(mean, [*keys, "_k"]).withColumn("value", F.col("value") - F.col("_m")).select(*df.columns)


def drift_correct(df: DataFrame, interval: int) -> DataFrame:
    """Minus the piecewise linear line through the means of consecutive intervals, placed at their middles (a smoothing spline would need a library that is not at hand)."""
    keys = axes(df, "point")
    cell = F.floor(F.col("point") / interval)
    means = df.groupBy(*keys, cell.alias("_c")).agg(F.avg("value").alias("_m"), F.avg("point").alias("_x"))
    w = Window.partitionBy(*keys).orderBy("_c")
    line = means.select(*keys, "_c", "_m", "_x", *[f(c).over(w).alias(f"_{n}{c}") for c in ("_m", "_x") for n, f in (("p", F.lag), ("n", F.lead))])
    met = df.withColumn("_c", cell).join(line, [*keys, "_c"])
    p = F.col("point")
    back = F.col("_m") + (p - F.col("_x")) * (F.col("_m") - F.col("_p_m")) / (F.col("_x") - F.col("_p_x"))
    ahead = F.col("_m") + (p - F.col("_x")) * (F.col("_n_m") - F.col("_m")) / (F.col("_n_x") - F.col("_x"))
    level = F.when(p < F.col("_x"), F.coalesce(back, F.col("_m"))).otherwise(F.coalesce(ahead, F.col("_m")))
    return met.withColumn("value", F.col("value") - level).select(*df.columns)


def spindles(df: DataFrame, sfreq: float, low: float = 11.5, high: float = 15.5, q: float = 0.9, threshold: float = 1.0, min_seconds: float = 0.4) -> DataFrame:
    """Sleep spindles of traces (array form): band-passed, rectified, averaged over 200 ms every 100 ms, over its quantile; ranges above the threshold that last long enough, in points."""
    half = sfreq / 2
    band = [(0.0, 0.0, low / half * 0.98, low / half, 0.0), (high / half, high / half * 1.02, 1.0, 1.0, 0.0)]
    size, step = max(2, round(0.2 * sfreq)), max(1, round(0.1 * sfreq))

    def kernel(x: np.ndarray) -> np.ndarray:
        y = np.abs(spectral.filtered(x, band))
        level = np.array([y[k : k + size].mean() for k in range(0, max(1, len(y) - size + 1), step)])
        return level / max(float(np.quantile(level, q)), 1e-300)

    levels = spectral.map_traces(df, kernel)
    on = levels.select(*[c for c in levels.columns if c != "values"], F.posexplode("values").alias("point", "value")).withColumn("on", F.col("value") >= threshold)
    found = paradigm.true_ranges(on, axes(levels, "point"), min_seconds * sfreq / step, 0.0)
    return found.withColumn("start", F.col("start") * step).withColumn("end", F.col("end") * step + size - step)


def event_density(events: DataFrame, by: list[str], width: float) -> DataFrame:
    """Events in each stretch of ``width``: (by, at, n)."""
    return events.groupBy(*by, (F.floor(F.col("at") / width) * width).alias("at")).count().withColumnRenamed("count", "n")


def heart_rate(beats: DataFrame, by: list[str]) -> DataFrame:
    """From times of beats in seconds: rate per minute, and the deviation of intervals (SDNN) and of their successive differences (RMSSD) in ms."""
    w = Window.partitionBy(*by).orderBy("at")
    d = beats.withColumn("_rr", F.col("at") - F.lag("at").over(w)).withColumn("_dd", F.col("_rr") - F.lag("_rr").over(w))
    return d.groupBy(*by).agg((60 / F.avg("_rr")).alias("rate"), (F.stddev_samp("_rr") * 1000).alias("sdnn"), (F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))) * 1000).alias("rmssd"))


__all__ = ["drift_correct", "event_density", "heart_rate", "regress_out", "spindles", "template_subtract"]
