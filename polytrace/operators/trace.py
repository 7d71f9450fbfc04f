"""Operators along traces: differences, sums, resampling, convolution, trends and crossings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..epochs import along, axes, chosen, numbered, running, samples, trace, traces, with_value
from ..functions import maths as M
from .spectral import map_pairs, map_traces


def _before(df: DataFrame, epochwise: bool, after: bool = False) -> DataFrame:
    """``df`` with the value before each (``_a``), and after it (``_b``) if asked. Within a trace a window knows; unless ``epochwise``, the edges of neighbouring
    epochs of a channel are joined by their ordinals, so no window runs over all epochs."""
    out = df.withColumn("_a", F.lag("value").over(along(df)))
    out = out.withColumn("_b", F.lead("value").over(along(df))) if after else out
    if epochwise:
        return out
    by = tuple(c for c in axes(df, "point") if c != "epoch_id")
    edges = df.groupBy(*axes(df, "point")).agg(F.max_by("value", "point").alias("_last"), F.min_by("value", "point").alias("_first"))
    edges = numbered(edges, "epoch_id", "_no", by)
    out = out.join(edges.select(*axes(df, "point"), "_no"), axes(df, "point"))
    out = out.join(edges.select(*by, (F.col("_no") + 1).alias("_no"), "_last"), [*by, "_no"], "left").withColumn("_a", F.coalesce("_a", "_last"))
    if after:
        out = out.join(edges.select(*by, (F.col("_no") - 1).alias("_no"), "_first"), [*by, "_no"], "left").withColumn("_b", F.coalesce("_b", "_first"))
    return out


def differentiate(df: DataFrame, epochwise: bool = True, channels=None, item: int | None = None) -> DataFrame:
    """Each value minus the one before; the first stays. Without ``epochwise`` the last value of an epoch carries over to the next."""
    return with_value(_before(df, epochwise), F.col("value") - F.coalesce("_a", F.lit(0.0)), chosen(df, channels, item)).select(*df.columns)


def integrate(df: DataFrame, epochwise: bool = True, channels=None, item: int | None = None) -> DataFrame:
    """Running sums. Without ``epochwise`` they go on from epoch to epoch: each trace is summed on its own, and the totals of the
    epochs before, one number for each, are added."""
    run = F.sum("value").over(along(df).rowsBetween(Window.unboundedPreceding, 0))
    if epochwise:
        return with_value(df, run, chosen(df, channels, item))
    totals = df.groupBy(*axes(df, "point")).agg(F.sum("value").alias("_sum"))
    before = running(totals, "epoch_id", F.col("_sum"), "_before", tuple(c for c in axes(df, "point") if c != "epoch_id")).drop("_sum")
    return with_value(df.join(before, axes(df, "point")), run + F.col("_before"), chosen(df, channels, item)).select(*df.columns)


def _resampled(df: DataFrame, step: float, rounded: bool) -> DataFrame:
    """For each trace the points k of the result, and the point of the input each is centred on."""
    n = F.count("*")
    size = df.groupBy(*axes(df, "point")).agg(n.alias("_n"))
    n_out = (F.rint(F.col("_n") / F.lit(step)) if rounded else F.floor(F.col("_n") / F.lit(step))).cast("int")
    size = size.withColumn("_n_out", n_out).where("_n_out > 0")
    out = size.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n_out") - 1)))
    return out.withColumn("m", F.floor(F.col("k").cast("float") * F.lit(step).cast("float")).cast("int"))


def sliding_average(df: DataFrame, size: int, step: float, q: float | None = None) -> DataFrame:
    """Resample: point k is the mean (or a quantile) of a window of ``size`` points around floor(k step), cut off at the ends and divided by the
    points it really has. Size 1 interpolates linearly. An epoch that would have no point left is rejected. Mean windows are differences
    of running sums, whatever their size."""
    if size == 1 and step == 1:
        return df
    keys = axes(df, "point")
    right = (size - 1) // 2 + 1
    left = size - right
    value = "value"
    if size == 1:
        at = _resampled(df, step, True).withColumn("_f", F.col("k").cast("float") * F.lit(step).cast("float") - F.col("m"))
        spread = at.withColumn("point", F.explode(F.array(F.col("m"), F.col("m") + 1)))
        weight = F.when(F.col("point") == F.col("m"), 1 - F.col("_f")).otherwise(F.col("_f").cast("double"))
        met = spread.join(df.select(*keys, "point", value), [*keys, "point"])
        # past the last point there is nothing to interpolate towards: the weights present are made whole
        return met.groupBy(*keys, F.col("k").alias("point")).agg((F.sum(F.col(value) * weight) / F.sum(weight)).alias("value"))
    if q is None and step == 1:
        # every point stays: one window pass over each trace, differences of its running sums
        w, n, at = along(df), F.count("*").over(trace(df)), F.row_number().over(along(df)) - 1
        held = df.withColumn("_sum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", n).withColumn("_i", at)
        held = held.withColumn("_all", F.sum(value).over(trace(df)))
        up_to = F.coalesce(F.lead("_sum", right - 1).over(w), F.col("_all"))
        total = up_to - F.coalesce(F.lag("_sum", left + 1).over(w), F.lit(0.0))
        count = F.least(F.col("_i") + right - 1, F.col("_n") - 1) - F.greatest(F.col("_i") - left, F.lit(0)) + 1
        return with_value(held, total / count).select(*df.columns)
    if q is None:
        run = along(df).rowsBetween(Window.unboundedPreceding, 0)
        sums = df.select(*keys, "point", F.sum(value).over(run).alias("_sum"))
        ends = _resampled(df, step, True)
        ends = ends.withColumn("_a", F.greatest(F.col("m") - left, F.lit(0)) - 1).withColumn("_b", F.least(F.col("m") + right - 1, F.col("_n") - 1))
        spread = ends.withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("point", F.when(F.col("_side") < 0, F.col("_a")).otherwise(F.col("_b")))
        met = spread.join(sums, [*keys, "point"], "left").withColumn("_s", F.col("_side") * F.coalesce("_sum", F.lit(0.0)))
        return met.groupBy(*keys, F.col("k").alias("point")).agg((F.sum("_s") / F.first(F.col("_b") - F.col("_a"))).alias("value"))

    def quantiles(x: np.ndarray) -> np.ndarray:
        middle = _centres(len(x), step, True)
        windows = [np.sort(x[max(0, m - left) : min(m + right, len(x))]) for m in middle.tolist()]
        return np.array([M.sorted_quantile(w, q) for w in windows if len(w)])

    return samples(map_traces(traces(df), quantiles)).select(*keys, "point", "value")


def _centres(n: int, step: float, rounded: bool) -> np.ndarray:
    """The points of a trace of n that the result's points are centred on."""
    count = int(np.rint(n / step)) if rounded else int(n / step)
    return np.floor(np.arange(count, dtype=np.float32) * np.float32(step)).astype(np.int64)


def convolved(x: np.ndarray, template: np.ndarray, step: float) -> np.ndarray:
    """The sliding product of one trace with one template; a template longer than the trace is cut."""
    template = template[: len(x)]
    size, n = len(template), len(x)
    if not size:
        return np.zeros(0)
    right = (size - 1) // 2 + 1
    left = size - right
    middle = _centres(n, step, False)
    inside = np.correlate(np.concatenate([x, np.zeros(size)]), template, "valid")  # from each start, zeros past the end
    begin = np.cumsum(x[:size] * template)
    return np.where(middle >= left, inside[np.maximum(middle - left, 0)], begin[np.minimum(middle + right, size) - 1]) / size


def convolve(df: DataFrame, template: list[float] | dict[str, list[float]], step: float = 1) -> DataFrame:
    """The sliding product with a template, or with one for each channel ({channel: template}; others go), centred as the sliding average is, always divided by the template's size; at the start the
    template's beginning meets the first points. The result has floor(n / step) points."""
    keys = axes(df, "point")
    if isinstance(template, dict):
        held = traces(df.where(F.col("channel").isin(list(template)))).withColumn("template", F.create_map(*[x for c, t in template.items() for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in t]))])[F.col("channel")])
        return samples(map_pairs(held, "template", lambda x, t: convolved(x, t, step))).select(*keys, "point", "value")
    one = np.array(template, np.float64)
    return samples(map_traces(traces(df), lambda x: convolved(x, one, step))).select(*keys, "point", "value")


def convolve_epochwise(df: DataFrame, side: DataFrame, step: float = 1, every: bool = True) -> DataFrame:
    """Each epoch with the templates of the side's epoch of the same ordinal (or all with its first epoch, unless ``every``), by channel, or the side's only channel for all. Epochs beyond the side's are rejected."""
    left = numbered(df.select("epoch_id").distinct(), "epoch_id", "_no").withColumn("_no", F.col("_no") if every else F.lit(0).cast("long"))
    right = numbered(side.select("epoch_id").distinct(), "epoch_id", "_no").withColumnRenamed("epoch_id", "_side")
    other = traces(side.select("epoch_id", "channel", "point", "value")).select(F.col("epoch_id").alias("_side"), "channel", F.col("values").alias("template"))
    count = other.groupBy("_side").agg(F.count("*").alias("_channels"), F.first("template").alias("_only"))
    pairs = left.join(right, "_no").drop("_no").join(count, "_side")
    held = traces(df).join(pairs, "epoch_id").join(other, ["_side", "channel"], "left")
    held = held.withColumn("template", F.when(F.col("_channels") == 1, F.col("_only")).otherwise(F.col("template"))).where("template is not null").drop("_side", "_channels", "_only")
    return samples(map_pairs(held, "template", lambda x, t: convolved(x, t, step))).select(*axes(df, "point"), "point", "value")


def detrend(df: DataFrame, mode: str = "line", omit: list[tuple[int, int]] | None = None, at: int | None = None, channels=None, item: int | None = None) -> DataFrame:
    """Minus a regression line over the points that are not omitted (``line``), minus their mean (``mean``), minus the line from the first to the last
    (``ends``), or minus the value at one point (``at``)."""
    w, where = trace(df), chosen(df, channels, item)
    v, p = F.col("value"), F.col("point").cast("double")
    if mode == "at":
        return with_value(df, v - F.max(F.when(F.col("point") == at, v)).over(w), where)
    used = F.lit(True)
    for a, b in omit or []:
        used = used & ~F.col("point").between(a, b)
    y, x = F.when(used, v), F.when(used, p)
    if mode == "mean":
        return with_value(df, v - F.avg(y).over(w), where)
    if mode == "ends":
        a, b = F.min(x).over(w), F.max(x).over(w)
        out = df.withColumn("_a", a).withColumn("_b", b)
        first = F.max(F.when(p == F.col("_a"), v)).over(w)
        last = F.max(F.when(p == F.col("_b"), v)).over(w)
        slope = F.when(F.col("_b") > F.col("_a"), (last - first) / (F.col("_b") - F.col("_a"))).otherwise(0.0)
        return with_value(out, v - first - slope * (p - F.col("_a")), where).select(*df.columns)
    n, sx, sy = F.count(x).over(w), F.sum(x).over(w), F.sum(y).over(w)
    sxx, sxy = F.sum(x * x).over(w), F.sum(x * y).over(w)
    below = n * sxx - sx * sx
    slope = F.when(below != 0, (n * sxy - sx * sy) / below).otherwise(0.0)
    return with_value(df, v - (sy - slope * sx) / n - slope * p, where)


def crossings(df: DataFrame, threshold: float, channels=None, epochwise: bool = True) -> DataFrame:
    """Events where the sign of value - threshold changes (0 counts as +): (axes, point, code +1 or -1)."""
    t = F.lit(float(threshold))
    sign = lambda v: F.when(v >= t, 1).otherwise(-1)
    out = _before(df.where(chosen(df, channels)), epochwise).where("_a is not null")
    return out.withColumn("code", sign(F.col("value"))).where(F.col("code") != sign(F.col("_a"))).select(*axes(df, "point"), "point", "code")


def extrema(df: DataFrame, threshold: float, channels=None, epochwise: bool = True) -> DataFrame:
    """Events at maxima of at least the threshold (+1) and minima of at most minus the threshold (-1): rising before, not rising after."""
    out = _before(df.where(chosen(df, channels)), epochwise, after=True)
    v, t = F.col("value"), F.lit(float(threshold))
    up = (v >= t) & (F.col("_a") < v) & (F.col("_b") <= v)
    down = (v <= -t) & (F.col("_a") > v) & (F.col("_b") >= v)
    return out.withColumn("code", F.when(up, 1).when(down, -1)).where("code is not null").select(*axes(df, "point"), "point", "code")


def refractory(events: DataFrame, period: int) -> DataFrame:
    """Events of each channel that come at least ``period`` points after the last one kept. That is a chain, so each channel of an epoch is walked in order;
    there are far fewer events than samples."""
    keys = axes(events, "point")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point", kind="stable")
        kept, last = [], -math.inf
        for p in pdf["point"]:
            kept.append(p - last >= period)
            if kept[-1]:
                last = p
        return pdf[np.array(kept, bool)]

    return events.groupBy(*keys).applyInPandas(walk, events.schema)
