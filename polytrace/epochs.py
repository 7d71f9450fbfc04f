"""The data model: epochs as long tables of samples.

A row of *samples* is one value: ``epoch_id, channel, point, value``, where present also ``dataset_no, shift, channel_idx, item, x``. Items are the parts
of a tuple (real and imaginary part, mean and t); the last ``leaveright`` of them are only ever summed. Metadata of epochs
(``sfreq, beforetrig, condition, nrofaverages`` ...) and triggers live in tables of their own, joined by ``epoch_id``.

A *trace* is one channel of one epoch over its points, a *map* all channels at one point. Operators
are functions from samples to samples and leave columns they don't know alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

AXES = ("dataset_no", "epoch_id", "shift", "channel_idx", "channel", "point", "item")


def axes(df: DataFrame, *without: str) -> list[str]:
    """The axes a table has, but for some; channel_idx goes where channel goes."""
    gone = set(without) | ({"channel_idx"} if "channel" in without else set())
    return [c for c in AXES if c in df.columns and c not in gone]


def trace(df: DataFrame) -> WindowSpec:
    return Window.partitionBy(*axes(df, "point"))


def along(df: DataFrame) -> WindowSpec:
    return trace(df).orderBy("point")


def at_point(df: DataFrame) -> WindowSpec:
    return Window.partitionBy(*axes(df, "channel"))


def with_value(df: DataFrame, value, where=None) -> DataFrame:
    """``df`` with a new value, only where a condition holds if there is one."""
    return df.withColumn("value", value if where is None else F.when(where, value).otherwise(F.col("value")))


def chosen(df: DataFrame, channels=None, item: int | None = None, leaveright: int = 0):
    """Condition of the options that name channels and an item; by default all items but the last ``leaveright`` of each sample."""
    from .functions.channels import selected

    where = selected(df, channels)
    if "item" in df.columns:
        if item is not None:
            where = where & (F.col("item") == item)
        elif leaveright:
            top = F.max("item").over(Window.partitionBy(*axes(df, "item")))
            where = where & (F.col("item") <= top - leaveright)
    return where


def pack_items(df: DataFrame) -> DataFrame:
    """Rows of one item each -> one row per sample with the array column items."""
    keys = axes(df, "item")
    listed = F.array_sort(F.collect_list(F.struct("item", "value")))
    return df.groupBy(*keys).agg(F.transform(listed, lambda s: s["value"]).alias("items"))


def unpack_items(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "items"]
    return df.select(*rest, F.posexplode("items").alias("item", "value"))


def traces(df: DataFrame) -> DataFrame:
    """One row per trace with its values in order: the form that numeric kernels take."""
    listed = F.array_sort(F.collect_list(F.struct("point", "value")))
    return df.groupBy(*axes(df, "point")).agg(F.transform(listed, lambda s: s["value"]).alias("values"))


def samples(df: DataFrame) -> DataFrame:
    """The reverse of ``traces``; points count from 0."""
    rest = [c for c in df.columns if c != "values"]
    return df.select(*rest, F.posexplode("values").alias("point", "value"))


def x_axis(df: DataFrame, sfreq: float, beforetrig: int = 0, unit: float = 1e-3) -> DataFrame:
    """The time of each point, in units of so many seconds, 0 at the trigger."""
    return df.withColumn("x", (F.col("point") - F.lit(beforetrig)) / F.lit(sfreq * unit))


#: Stretches that a total order is cut into: so many, each of so many finer ones.
COARSE = 32


def running(df: DataFrame, order: str, amount, into: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows of smaller ``order`` (numbers), within ``by``.

    A single window over everything would put every row into one task. Instead the order is cut at approximate quantiles into stretches of about as many
    rows, whatever its values: each is summed on its own, and only the stretches' totals go through one window. Where the cuts lie
    changes nothing in the result.
    """
    at = [k / COARSE**2 for k in range(1, COARSE**2)]
    cuts = df.agg(F.percentile_approx(order, at, 10 * COARSE**2).alias("_cuts"))
    held = df.withColumn("_amount", amount).join(F.broadcast(cuts))  # one row is sent out
    top = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(COARSE - 1)), lambda k: F.get("_cuts", k * COARSE - 1)), lambda c: c <= F.col(order)))
    held = held.withColumn("_block", top * COARSE)
    held = held.withColumn("_block", F.col("_block") + F.size(F.filter(F.slice("_cuts", F.col("_block") + 1, F.lit(COARSE - 1)), lambda c: c <= F.col(order)))).drop("_cuts")
    totals = held.groupBy(*by, "_block").agg(F.sum("_amount").alias("_total"))
    ahead = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(ahead), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(totals, [*by, "_block"]).withColumn(into, F.coalesce(F.sum("_amount").over(inside), F.lit(0)) + F.col("_ahead"))
    return out.drop("_amount", "_block", "_ahead")


def numbered(df: DataFrame, order: str, into: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the ordinal of each row from 0; ``order`` must not repeat within ``by``."""
    return running(df, order, F.lit(1).cast("long"), into, by)
