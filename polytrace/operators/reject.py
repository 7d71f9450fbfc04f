"""Rejection of whole epochs or channels, and assertions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..epochs import axes, running
from ..functions import maths as M


def reject_bandwidth(df: DataFrame, limit: float, thresholds: DataFrame | None = None, peak_only: bool = False, channels_only: bool = False, invert: bool = False) -> DataFrame:
    """Drop epochs in which any channel spans ``limit`` or more (``peak_only``: reaches it); ``channels_only`` drops just those channels, ``invert`` keeps them instead.

    ``thresholds`` (channel, threshold) overrides the limit by channel; it holds a row per channel, which Spark measures before it sends it out.
    """
    v = M.number(F.col("value"))
    keys = [c for c in axes(df, "point") if c != "item"]
    wide = df.groupBy(*keys).agg((F.max(v) if peak_only else F.max(v) - F.min(v)).alias("_span"))
    if thresholds is not None:
        wide = wide.join(thresholds.select("channel", "threshold"), "channel", "left")
    bound = F.coalesce(F.col("threshold"), F.lit(float(limit))) if thresholds is not None else F.lit(float(limit))
    bad = wide.where(F.col("_span") >= bound)
    on = keys if channels_only else [c for c in ("dataset_no", "epoch_id") if c in df.columns]
    return df.join(bad.select(*on).distinct(), on, "left_semi" if invert else "left_anti")


def reject_overflow(df: DataFrame, limit: float = 9998.0) -> DataFrame:
    """Drop epochs with any value beyond +-limit."""
    bad = df.groupBy("epoch_id").agg(F.max(M.number(F.abs("value"))).alias("_top")).where(F.col("_top") > limit)
    return df.join(bad, "epoch_id", "left_anti")


OPS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "=~": lambda a, b: F.contains(a, F.lit(b) if not isinstance(b, Column) else b),
    "!~": lambda a, b: ~F.contains(a, F.lit(b) if not isinstance(b, Column) else b),
}


def assertion(variable: str, op: str, value) -> Column:
    """The condition on a column of epochs. ``== NaN`` asks for NaN; ``channelname`` looks at the array column channels: == at any, all other comparisons at all."""
    if variable == "channelname":
        if op == "==":
            return F.exists("channels", lambda c: c == F.lit(value))
        return F.forall("channels", lambda c: OPS[op](c, value))
    column = F.col(variable)
    if isinstance(value, float) and value != value:
        return F.isnan(column) if op == "==" else ~F.isnan(column)
    return OPS[op](column, F.lit(value) if op not in ("=~", "!~") else value)


def assert_epochs(epochs: DataFrame, variable: str, op: str, value, abort: bool = False, stop: bool = False) -> DataFrame:
    """Epochs for which a comparison holds. ``abort`` fails the query on one that does not; ``stop`` keeps those before the first that does not."""
    holds = assertion(variable, op, value)
    if abort:
        return epochs.where(F.when(holds, F.lit(True)).otherwise(F.raise_error(F.lit(f"assertion failed: {variable} {op} {value}")).cast("boolean")))
    if stop:
        first = epochs.where(~holds).agg(F.min("epoch_id").alias("_end"))
        return epochs.join(F.broadcast(first), F.col("_end").isNull() | (F.col("epoch_id") < F.col("_end")), "inner").drop("_end")
    return epochs.where(holds)


def counters(epochs: DataFrame, accepted: Column) -> DataFrame:
    """How many epochs were accepted and rejected before each, in the order of their ids."""
    ok = accepted.cast("long")
    out = running(epochs, "epoch_id", ok, "accepted_epochs")
    return running(out, "epoch_id", 1 - ok, "rejected_epochs")
