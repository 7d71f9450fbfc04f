"""Aggregation across epochs: averages with tests, histograms, extrema, concatenation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..epochs import axes, numbered, running, samples, trace, traces
from ..functions import maths as M
from .spectral import map_traces


def average(df: DataFrame, by: list[str] | None = None, weight: str | None = None, sums_only: bool = False, t_test: bool = False, leave_sums: bool = False, sign_test: bool = False, beforetrig: int = 0, leaveright: int = 0) -> DataFrame:
    """Means over epochs of each channel, point and item, or of the groups ``by`` as well.

    ``weight``: a column that counts the epochs behind each value (1 where it is null). ``t_test`` adds t and its two-sided p (``leave_sums``: the raw sums instead);
    ``sign_test`` counts values above and not above the trace's baseline mean. Items at the right that are only
    summed are neither weighted nor divided. A channel is divided by the epochs that have it.
    """
    keys = [*(by or []), *axes(df, "epoch_id")]
    v = F.col("value")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    kept: Column = F.lit(False)
    if "item" in df.columns and leaveright:
        top = F.max("item").over(Window.partitionBy(*axes(df, "item")))
        df = df.withColumn("_kept", F.col("item") > top - leaveright)
        kept = F.first("_kept")
        weighted = F.when(F.col("_kept"), v).otherwise(v * w)
    else:
        weighted = v * w
    agg = [F.sum(weighted).alias("_sum"), F.sum(w).alias("_w"), F.count("*").alias("n"), kept.alias("_only_summed")]
    if t_test or leave_sums:
        agg += [F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq")]
    if sign_test:
        base = F.avg(F.when(F.col("point") < beforetrig, v)).over(trace(df))
        df = df.withColumn("_above", v > base)
        agg += [F.sum(F.col("_above").cast("double")).alias("n_above"), F.sum((~F.col("_above")).cast("double")).alias("n_below")]
    out = df.groupBy(*keys).agg(*agg)
    mean = F.col("_sum") if sums_only else F.when(F.col("_only_summed"), F.col("_sum")).otherwise(F.col("_sum") / F.col("_w"))
    columns: list[Column] = [mean.alias("value"), F.col("n"), F.col("_w").alias("weight")]
    if leave_sums:
        columns += [F.col("sum"), F.col("sumsq")]
    elif t_test:
        n = F.col("n").cast("double")
        t = M.ratio(F.col("sum"), n * M.root((F.col("sumsq") - F.col("sum") * F.col("sum") / n) / (n * (n - 1))))
        out = out.withColumn("t", F.when(n > 1, t).otherwise(F.lit(M.NAN)))
        columns += [F.col("t"), M.student_p(n - 1, F.col("t")).alias("p")]
    if sign_test:
        columns += [F.col("n_above"), F.col("n_below")]
    return out.select(*keys, *columns)


def sign_votes(df: DataFrame, beforetrig: int) -> DataFrame:
    """For each value the mean vote against every single baseline value of its trace but itself (+1 above, -1 not above), averaged over epochs.
    The baseline is sorted once for each trace and asked by rank. Points count from 0."""

    def votes(x: np.ndarray) -> np.ndarray:
        base = np.sort(x[:beforetrig])
        above = np.searchsorted(base, x, "left")
        against = len(base) - (np.arange(len(x)) < beforetrig)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(against > 0, (2 * above - against) / against, np.nan)

    vote = samples(map_traces(traces(df), votes)).where(~F.isnan("value"))
    return vote.groupBy(*axes(df, "epoch_id")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def append_points(df: DataFrame) -> DataFrame:
    """Epochs one after another along the points, in the order of their ids: each is moved by the points of those before."""
    size = df.groupBy("epoch_id").agg((F.max("point") + 1).alias("_n"))
    start = running(size, "epoch_id", F.col("_n"), "_start").drop("_n")
    return df.join(start, "epoch_id").withColumn("point", (F.col("point") + F.col("_start")).cast("long")).drop("_start", "epoch_id")


def append_channels(df: DataFrame) -> DataFrame:
    """Epochs side by side: each keeps its channels under names that tell the epoch."""
    return df.withColumn("channel", F.concat_ws("@", "channel", F.col("epoch_id").cast("string"))).drop("epoch_id")


def append_items(df: DataFrame) -> DataFrame:
    """Epochs as items: one item for each epoch, in the order of their ids."""
    ids = numbered(df.select("epoch_id").distinct(), "epoch_id", "item").withColumn("item", F.col("item").cast("int"))
    return df.drop("item").join(ids, "epoch_id").drop("epoch_id")


def append_datasets(df: DataFrame) -> DataFrame:
    """Epochs as linked data sets, numbered from 1."""
    ids = numbered(df.select("epoch_id").distinct(), "epoch_id", "dataset_no").withColumn("dataset_no", (F.col("dataset_no") + 1).cast("int"))
    return df.join(ids, "epoch_id").drop("epoch_id")


def histogram(df: DataFrame, low: float, high: float, bins: int, by_channel: bool = True, by_point: bool = False, keep_outliers: bool = False, empty: bool = False) -> DataFrame:
    """Counts by bin: rint((value - low) / width), bins centred on low + i width; values outside are dropped or put into the end bins."""
    width = (high - low) / bins
    b = F.rint((F.col("value") - F.lit(float(low))) / F.lit(width)).cast("int")
    if keep_outliers:
        b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), b))
    by = (["channel"] if by_channel else []) + (["point"] if by_point else [])
    out = df.where(~F.isnan("value")).withColumn("bin", b).where(F.col("bin").between(0, bins - 1)).groupBy(*by, "bin").count()
    if empty:
        grid = df.select(*by).distinct() if by else df.sparkSession.range(1).drop("id")
        grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        out = grid.join(out, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.withColumn("x", F.lit(float(low)) + F.col("bin") * F.lit(width))


def minmax(df: DataFrame, by_channel: bool = True, by_point: bool = True) -> DataFrame:
    """Least and greatest value over epochs, for each channel and point or collapsed over either; NaN is passed over."""
    by = [c for c in axes(df, "epoch_id") if by_channel or c not in ("channel", "channel_idx")]
    by = [c for c in by if by_point or c != "point"]
    v = M.number(F.col("value"))
    return df.groupBy(*by).agg(F.min(v).alias("min"), F.max(v).alias("max"))


def null_sink(df: DataFrame) -> None:
    """Run everything, keep nothing."""
    df.write.format("noop").mode("overwrite").save()
