"""Arithmetic on single values, with statistics of their map or trace where an operator names one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..epochs import along, at_point, axes, chosen, trace, with_value
from ..functions import maths as M

V = lambda: F.col("value")

SCALAR = {
    "log": M.ln,
    "log10": M.log10,
    "logdB": lambda v: 10 * M.log10(v),
    "expdB": lambda v: F.pow(F.lit(10.0), v / 10),
    "exp": F.exp,
    "exp10": lambda v: F.pow(F.lit(10.0), v),
    "atanh": lambda v: F.when(F.abs(v) < 1, F.atanh(v)).when(F.abs(v) == 1, F.signum(v) * F.lit(M.INF)).otherwise(F.lit(M.NAN)),
    "sqrt": M.root,
    "square": lambda v: v * v,
    "neg": lambda v: -v,
    "abs": F.abs,
    "inv": lambda v: M.ratio(F.lit(1.0), v),
    "ceil": lambda v: F.ceil(v).cast("double"),
    "floor": lambda v: F.floor(v).cast("double"),
    "rint": F.rint,
}


def calc(df: DataFrame, function: str, channels=None, item: int | None = None, leaveright: int = 0) -> DataFrame:
    """A function of one value, on the chosen channels and item."""
    if function in TUPLE:
        raise ValueError(f"{function} takes whole tuples: calc_items")
    return with_value(df, SCALAR[function](V()), chosen(df, channels, item, leaveright))


def _modulus(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def _sigma(x: Column, n: Column) -> Column:
    return M.root(M.ratio(x[2] - M.ratio(x[1] * x[1], n), n))


def _t(x: Column, n: Column) -> Column:
    return M.ratio(x[1], n * M.root(M.ratio(x[2] - M.ratio(x[1] * x[1], n), n * (n - 1))))


def _replaced(x: Column, **new: Column) -> Column:
    """The array with elements exchanged: i0=..., i1=..."""
    at = {int(k[1:]): v for k, v in new.items()}
    top = max(at) + 1
    return F.concat(F.array(*[at.get(k, x[k]) for k in range(top)]), F.slice(x, F.lit(top + 1), F.greatest(F.size(x) - top, F.lit(0))))


#: Functions of the array items and the number of averages.
TUPLE = {
    "abs2": lambda x, n: _replaced(x, i0=_modulus(x[0], x[1]), i1=F.lit(0.0)),
    "square2": lambda x, n: _replaced(x, i0=x[0] * x[0] + x[1] * x[1], i1=F.lit(0.0)),
    "norm2": lambda x, n: _replaced(x, i0=M.ratio(x[0], _modulus(x[0], x[1])), i1=M.ratio(x[1], _modulus(x[0], x[1]))),
    "phase": lambda x, n: _replaced(x, i0=F.atan2(x[1], x[0]), i1=F.lit(0.0)),
    "absandphase": lambda x, n: _replaced(x, i0=_modulus(x[0], x[1]), i1=F.atan2(x[1], x[0])),
    "coherence": lambda x, n: _replaced(x, i0=_modulus(x[0], x[1]), i1=F.pow(1 - _modulus(x[0], x[1]), 2 * F.when(F.size(x) == 3, F.rint(F.get(x, F.lit(2)))).otherwise(n) - 1)),
    "stddev": lambda x, n: _replaced(x, i1=_sigma(x, n), i2=M.ratio(_sigma(x, n), M.root(n - 1))),
    "ttest": lambda x, n: _replaced(x, i1=_t(x, n), i2=M.student_p(n - 1, F.abs(_t(x, n)))),
}


def calc_items(df: DataFrame, function: str, averages: Column | float = 1.0) -> DataFrame:
    """A function of a whole tuple (column items). ``averages``: how many epochs were summed; a fourth item of
    ttest and stddev takes its place."""
    x = F.col("items")
    n = averages if isinstance(averages, Column) else F.lit(float(averages))
    if function in ("ttest", "stddev"):
        n = F.when(F.size(x) == 4, F.rint(F.get(x, F.lit(3)))).otherwise(n)
    return df.withColumn("items", TUPLE[function](x, n))


def _statistic(df: DataFrame, kind: str, over: list[str], channels, item, leaveright, q: float) -> tuple[DataFrame, Column]:
    """A statistic of each map or trace over the chosen values, as a column of ``df``."""
    where = chosen(df, channels, item, leaveright)
    v = F.when(where, V())
    if kind == "quantile":
        part = df.where(where).groupBy(*over).agg(M.group_quantile(V(), q).alias("_statistic"))
        return df.join(part, over, "left"), F.col("_statistic")
    of = {"mean": F.avg(v), "min": F.min(M.number(v)), "max": F.max(M.number(v)), "maxabs": F.max(M.number(F.abs(v))), "sum": F.sum(v), "norm": F.sum(v * v), "squarenorm": F.sum(v * v)}
    statistic = of[kind].over(Window.partitionBy(*over))
    return df, F.sqrt(statistic) if kind == "norm" else statistic


def add(df: DataFrame, what: str | float, channels=None, item: int | None = None, leaveright: int = 0, q: float = 0.5, amount: float = 1.0, seed: int = 0, triggers: DataFrame | None = None) -> DataFrame:
    """Add a constant, or minus a statistic of the map (``negmean``, ``negmin``, ``negmax``, ``negquantile``) or of
    the trace (``negpointmean`` ...), ``noise`` (uniform within +-amount), ``gaussnoise``, or the codes of ``triggers``."""
    where = chosen(df, channels, item, leaveright)
    if not isinstance(what, str):
        return with_value(df, V() + F.lit(float(what)), where)
    if what == "noise":
        return with_value(df, V() + (F.rand(seed) * 2 - 1) * amount, where)
    if what == "gaussnoise":
        return with_value(df, V() + F.randn(seed) * amount, where)
    if what == "triggers":
        marks = triggers.groupBy("epoch_id", F.col("position").cast("int").alias("point")).agg(F.sum("code").alias("_code"))
        out = df.join(marks, ["epoch_id", "point"], "left")
        return with_value(out, V() + F.coalesce("_code", F.lit(0)).cast("double"), where).drop("_code").select(*df.columns)
    kind = what.removeprefix("neg")
    by_trace = kind.startswith("point")
    over = axes(df, "point") if by_trace else axes(df, "channel")
    out, s = _statistic(df, kind.removeprefix("point"), over, channels, item, leaveright, q)
    return with_value(out, V() - s, where).select(*df.columns)


def scale_by(df: DataFrame, what: str | float, channels=None, item: int | None = None, leaveright: int = 0, q: float = 0.5, sfreq: float | None = None, averages: float | None = None) -> DataFrame:
    """Multiply by a constant, by pi, by a property of the epoch (``sfreq``, ``nr_of_points``, ``nr_of_channels``, ``nrofaverages``, ``sqrtnrofaverages``),
    by ``xdata``, or divide by any of these (``inv...``) or by a statistic of the map or trace; a divisor of 0 counts as 1."""
    where = chosen(df, channels, item, leaveright)
    if not isinstance(what, str):
        return with_value(df, V() * F.lit(float(what)), where)
    inverse, name = what.startswith("inv"), what.removeprefix("inv")
    out = df
    if name in ("norm", "squarenorm", "sum", "max", "maxabs", "quantile") or name.startswith("point"):
        if not inverse:
            raise ValueError(f"unknown factor {what!r}")
        by_trace = name.startswith("point")
        if channels is not None and not by_trace:
            raise ValueError("maps are scaled as a whole: no channel list")
        out, f = _statistic(df, name.removeprefix("point"), axes(df, "point") if by_trace else axes(df, "channel"), None, item, leaveright, q)
    elif name == "xdata":
        f = F.col("x")
    elif name == "nr_of_points":
        f = F.count("*").over(trace(df)).cast("double")
    elif name == "nr_of_channels":
        f = F.count("*").over(at_point(df)).cast("double")
    else:
        f = F.lit(float({"pi": math.pi, "sfreq": sfreq, "nrofaverages": averages, "sqrtnrofaverages": None if averages is None else math.sqrt(averages)}[name]))
    value = V() / F.when(f == 0, F.lit(1.0)).otherwise(f) if inverse else V() * f
    return with_value(out, value, where).select(*df.columns)


def recode(df: DataFrame, blocks: list[tuple[float, float, float, float]], channels=None, item: int | None = None) -> DataFrame:
    """(from0, from1, to0, to1): the first closed interval that holds a value maps it linearly; a NaN interval maps NaN."""
    v, out = V(), None
    for from0, from1, to0, to1 in blocks:
        if math.isnan(from0):
            inside, new = F.isnan(v), F.lit(float(to0))
        else:
            inside = (v >= F.lit(float(from0))) & (v <= F.lit(float(from1))) & ~F.isnan(v)
            if from0 == from1 or math.isinf(from0) or math.isinf(from1) or to0 == to1:
                new = F.lit(float(to0))
            else:
                new = F.lit(float(to0)) + (v - F.lit(float(from0))) * F.lit((to1 - to0) / (from1 - from0))
        out = F.when(inside, new) if out is None else out.when(inside, new)
    return with_value(df, out.otherwise(v), chosen(df, channels, item)) if out is not None else df


def _baseline(df: DataFrame, beforetrig: int, v: Column) -> Column:
    if beforetrig < 1:
        raise ValueError("there is no baseline: beforetrig is 0")
    return F.avg(F.when(F.col("point") < beforetrig, v)).over(trace(df))


def baseline_subtract(df: DataFrame, beforetrig: int, leaveright: int = 0) -> DataFrame:
    """Minus the mean of the trace's points before the trigger."""
    return with_value(df, V() - _baseline(df, beforetrig, V()), chosen(df, None, None, leaveright))


def baseline_divide(df: DataFrame, beforetrig: int) -> DataFrame:
    """Divided by the baseline mean; tuples by the mean of their lengths."""
    if "item" in df.columns:
        length = F.sqrt(F.sum(V() * V()).over(Window.partitionBy(*axes(df, "item"))))
        inner = df.withColumn("_length", length)
        base = F.avg(F.when(F.col("point") < beforetrig, F.col("_length"))).over(Window.partitionBy(*axes(df, "item", "point")))
        return with_value(inner, M.ratio(V(), base)).drop("_length")
    return with_value(df, M.ratio(V(), _baseline(df, beforetrig, V())))


def demean_maps(df: DataFrame) -> DataFrame:
    """The common-average reference: minus the mean of all channels at each point."""
    return with_value(df, V() - F.avg(V()).over(at_point(df)))


def rereference(df: DataFrame, refs, exclude=None) -> DataFrame:
    """Minus the mean of the reference channels at each point; excluded channels stay as they are."""
    from ..functions.channels import selected

    mean = F.avg(F.when(selected(df, refs), V())).over(at_point(df))
    return with_value(df, V() - F.coalesce(mean, F.lit(0.0)), ~selected(df, exclude) if exclude is not None else None)


def zero_phase(df: DataFrame, channel: str) -> DataFrame:
    """Turn every complex map (items: re, im) so that one channel has phase 0. ``MAXAMP``: the channel of the largest modulus; ``NYQUIST``: by the slope
    of a regression through the map's points in the complex plane."""
    x = F.col("items")
    w = Window.partitionBy(*axes(df, "channel", "item"))
    if channel == "NYQUIST":
        angle = F.atan(F.regr_slope(x[1], x[0]).over(w))
    elif channel == "MAXAMP":
        first = F.col("channel_idx") if "channel_idx" in df.columns else F.col("channel")  # of equal moduli the first channel's counts
        largest = F.struct((-F.hypot(x[0], x[1])).alias("m"), first.alias("c"), F.atan2(x[1], x[0]).alias("a"))
        angle = F.min(largest).over(w)["a"]
    else:
        angle = F.max(F.when(F.col("channel") == channel, F.atan2(x[1], x[0]))).over(w)
    out = df.withColumn("_a", F.coalesce(angle, F.lit(0.0)))
    c, s = F.cos("_a"), F.sin("_a")
    return out.withColumn("items", _replaced(x, i0=x[0] * c + x[1] * s, i1=x[1] * c - x[0] * s)).drop("_a")


#: The smallest normal single-precision number: logarithms of probabilities stop there.
LEAST = 2.0**-126


def binomial_items(df: DataFrame) -> DataFrame:
    """From counts of two outcomes (the last two items) three more: p, its signed logarithm (positive if the first
    outcome leads) and the relative difference."""
    x, n = F.col("items"), F.size("items")
    k1, k2 = F.get(x, n - 2), F.get(x, n - 1)
    out = df.withColumn("_p", M.binomial_two_sided(k1, k2))
    log = M.log10(F.greatest(F.col("_p"), F.lit(LEAST)))
    signed = F.when(k1 > k2, -log).when(k1 < k2, log).otherwise(0.0)
    return out.withColumn("items", F.concat(x, F.array(F.col("_p"), signed, M.ratio(k1 - k2, k1 + k2)))).drop("_p")


__all__ = ["SCALAR", "TUPLE", "add", "along", "baseline_divide", "baseline_subtract", "binomial_items", "calc", "calc_items", "demean_maps", "recode", "rereference", "scale_by", "zero_phase"]
