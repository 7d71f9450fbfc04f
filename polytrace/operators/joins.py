"""Operations between tables: windows around triggers, side epochs, matrices, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..epochs import axes, numbered
from ..functions import maths as M


def windows_of(recording: DataFrame, triggers: DataFrame, before: int, after: int, codes: list[int] | None = None, offset: int = 0, first: int = 1, most: int | None = None, by: str = "recording") -> DataFrame:
    """(by, position, code ..., _start, epoch_no): the windows around triggers that lie inside their recording, numbered in trigger order. ``first`` (from 1) and
    ``most`` count windows that qualify."""
    n = before + after
    marks = triggers if codes is None else triggers.where(F.col("code").isin(codes))
    end = recording.groupBy(by).agg((F.max("pos") + 1).alias("_end"))
    start = F.col("position") - F.lit(before) + F.lit(offset)
    marks = marks.join(end, by).withColumn("_start", start).where((F.col("_start") >= 0) & (F.col("_start") + n <= F.col("_end")))
    marks = marks.withColumn("epoch_no", F.row_number().over(Window.partitionBy(by).orderBy("position", "code")))
    return marks.where((F.col("epoch_no") >= first) & (F.lit(True) if most is None else F.col("epoch_no") < first + most)).drop("_end")


def trigger_windows(recording: DataFrame, triggers: DataFrame, before: int, after: int, codes: list[int] | None = None, offset: int = 0, first: int = 1, most: int | None = None, by: str = "recording") -> DataFrame:
    """Epochs of before + after points around triggers: samples of (by, channel, pos, value) with epoch_no in trigger order.

    A window that starts before 0 or ends past the recording is left out. Windows may overlap. Each trigger is
    spread to its positions, so that samples are met by an equality and no nested loop.
    """
    marks = windows_of(recording, triggers, before, after, codes, offset, first, most, by)
    spread = marks.select(by, "epoch_no", F.col("code").alias("condition"), "_start", F.explode(F.sequence(F.col("_start"), F.col("_start") + before + after - 1)).alias("pos"))
    out = spread.join(recording, [by, "pos"])
    return out.withColumn("point", (F.col("pos") - F.col("_start")).cast("int")).drop("_start", "pos")


def continuous_windows(recording: DataFrame, n: int, offset: int = 0, by: str = "recording", first: int = 1, most: int | None = None) -> DataFrame:
    """Epochs of n points, one after another; the last one goes if it is not whole. ``first`` (from 1) and ``most`` count epochs."""
    at = F.col("pos") - F.lit(offset)
    end = recording.groupBy(by).agg((F.max("pos") + 1 - offset).alias("_end"))
    out = recording.where((at >= (first - 1) * n) & (F.lit(True) if most is None else at < (first - 1 + most) * n))
    out = out.withColumn("epoch_no", F.floor(at / n).cast("int") + 1).withColumn("point", F.pmod(at, F.lit(n)).cast("int"))
    return out.join(end, by).where(F.col("epoch_no") * n <= F.col("_end")).drop("_end", "pos")


def transferred_triggers(windows: DataFrame, triggers: DataFrame, n: int, by: str = "recording") -> DataFrame:
    """All triggers inside each window (by, epoch_no, start), with positions in the epoch. Both sides are dealt out by blocks of n positions, so the interval join is an equality join on two neighbouring blocks."""
    left = windows.withColumn("_b", F.explode(F.array(F.floor(F.col("start") / n), F.floor(F.col("start") / n) + 1)))
    right = triggers.withColumn("_b", F.floor(F.col("position") / n))
    met = left.join(right, [by, "_b"]).where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + n))
    return met.select(by, "epoch_no", (F.col("position") - F.col("start")).cast("long").alias("position"), "code")


def _side(df: DataFrame, side: DataFrame, recycle_channels: bool, recycle_points: bool) -> tuple[DataFrame, list[str]]:
    """The side epoch's values next to the matching ones: by point and channel number, wrapped around where asked for. Its size is measured here, once."""
    size = side.agg((F.max("point") + 1).alias("_np"), (F.max("channel_idx") + 1).alias("_nc"))
    point = F.pmod(F.col("point"), F.col("_np")) if recycle_points else F.col("point")
    channel = F.pmod(F.col("channel_idx"), F.col("_nc")) if recycle_channels else F.col("channel_idx")
    out = df.join(F.broadcast(size)).withColumn("_sp", point).withColumn("_sc", channel).drop("_np", "_nc")  # one row is sent out
    right = side.select(F.col("point").alias("_sp"), F.col("channel_idx").alias("_sc"), *[F.col(c).alias(f"_s_{c}") for c in side.columns if c not in ("point", "channel_idx", "channel", "epoch_id")])
    return out.join(right, ["_sp", "_sc"], "left").drop("_sp", "_sc"), df.columns


def subtract(df: DataFrame, side: DataFrame, how: str = "subtract", recycle_channels: bool = False, recycle_points: bool = False, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """A side epoch (channel_idx, point, value) combined with every epoch: subtract, add, mean, wmean, multiply or divide. Where the side has no value, the epoch keeps its own."""
    met, columns = _side(df, side, recycle_channels, recycle_points)
    a, b = F.col("value"), F.col("_s_value")
    new: dict[str, Column] = {
        "add": a + b,
        "subtract": a - b,
        "mean": (a + b) / 2,
        "wmean": (a * weights[0] + b * weights[1]) / sum(weights),
        "multiply": a * b,
        "divide": M.ratio(a, b),
    }
    return met.withColumn("value", F.when(b.isNotNull(), new[how]).otherwise(a)).select(*columns)


def complex_subtract(df: DataFrame, side: DataFrame, how: str = "multiply", recycle_channels: bool = False, recycle_points: bool = False) -> DataFrame:
    """Complex tuples (items: re, im) times the conjugate of the side's, or divided by it."""
    met, columns = _side(df, side, recycle_channels, recycle_points)
    x, y = F.col("items"), F.col("_s_items")
    re, im = (x[0] * y[0] + x[1] * y[1], x[1] * y[0] - x[0] * y[1]) if how == "multiply" else (x[0] * y[0] - x[1] * y[1], x[1] * y[0] + x[0] * y[1])
    if how == "divide":
        below = y[0] * y[0] + y[1] * y[1]
        re, im = M.ratio(re, below), M.ratio(im, below)
    return met.withColumn("items", F.when(y.isNotNull(), F.array(re, im)).otherwise(x)).select(*columns)


def subtract_epochwise(df: DataFrame, side: DataFrame) -> DataFrame:
    """Each epoch minus the side's epoch of the same ordinal; too few of them is an error."""
    left = numbered(df.select("epoch_id").distinct(), "epoch_id", "_no")
    right = numbered(side.select("epoch_id").distinct(), "epoch_id", "_no").select(F.col("epoch_id").alias("_side"), "_no")
    pair = left.join(right, "_no", "left").drop("_no")
    other = side.select(F.col("epoch_id").alias("_side"), "channel", "point", F.col("value").alias("_v"))
    met = df.join(pair, "epoch_id").join(other, ["_side", "channel", "point"], "left")
    missing = F.raise_error(F.lit("the side has fewer epochs")).cast("double")
    return met.withColumn("value", F.when(F.col("_side").isNull(), missing).otherwise(F.col("value") - F.coalesce("_v", F.lit(0.0)))).select(*df.columns)


def two_sample_t(a: DataFrame, b: DataFrame) -> DataFrame:
    """Student's t for the difference of two averages that carry n, sum and sumsq: (axes, value, t, p)."""
    keys = [c for c in axes(a) if c in b.columns]
    other = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "sum", "sumsq")])
    m = a.join(other, keys)
    n1, n2 = F.col("n").cast("double"), F.col("_n").cast("double")
    ss = F.col("sumsq") - F.col("sum") * F.col("sum") / n1 + F.col("_sumsq") - F.col("_sum") * F.col("_sum") / n2
    diff = F.col("sum") / n1 - F.col("_sum") / n2
    t = M.ratio(diff, M.root(ss / (n1 + n2 - 2))) * F.sqrt(n1 * n2 / (n1 + n2))
    return m.select(*keys, diff.alias("value"), t.alias("t"), (n1 + n2 - 2).alias("df")).withColumn("p", M.student_p("df", "t"))


def add_channels(df: DataFrame, side: DataFrame, along: str = "channel") -> DataFrame:
    """Zip a side epoch to every epoch along channels, points or items."""
    if along == "item":
        other = side.select("channel", "point", F.col("items").alias("_more"))
        return df.join(other, ["channel", "point"]).withColumn("items", F.concat("items", "_more")).drop("_more")
    ids = df.select("epoch_id").distinct()
    one = side.drop("epoch_id")
    if along == "point":
        n = df.groupBy("epoch_id").agg((F.max("point") + 1).alias("_n"))
        more = n.join(one).withColumn("point", (F.col("point") + F.col("_n")).cast("int")).drop("_n")
    else:
        more = ids.join(one)
    return df.unionByName(more.select(*df.columns))


def prepared(vectors: DataFrame, axis: str, unit: bool = True, centred: bool = False, orthogonal: bool = False, only=None, zero_others: bool = False) -> DataFrame:
    """Vectors (k, ``axis``, weight) made ready to project on: of mean 0 (``centred``), orthogonal to those before them, of unit norm, in this order. ``only``, a condition on the axis, says which
    elements count in means and norms; ``zero_others`` sets the rest to 0. They are a handful of maps or time courses and go through one task each time."""
    counts = F.lit(True) if only is None else only
    v = vectors.select("k", axis, F.col("weight").cast("double").alias("weight")).withColumn("_on", counts)
    if zero_others:
        v = v.withColumn("weight", F.when(F.col("_on"), F.col("weight")).otherwise(0.0))
    w, on = F.col("weight"), Window.partitionBy("k")
    if centred:
        v = v.withColumn("weight", F.when(F.col("_on") | F.lit(not zero_others), w - F.avg(F.when(F.col("_on"), w)).over(on)).otherwise(w))
    if orthogonal:

        def run(pdf):
            table = pdf.pivot(index="k", columns=axis, values="weight").sort_index()
            x = table.to_numpy(float).copy()
            for i in range(len(x)):
                for j in range(i):
                    below = x[j] @ x[j]
                    x[i] -= (x[i] @ x[j] / below if below else 0) * x[j]
            table[:] = x
            return pdf.drop(columns="weight").merge(table.stack().rename("weight").reset_index(), on=["k", axis])[["k", axis, "weight", "_on"]]

        v = v.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: run(pdf.drop(columns="_all")), v.schema)
    if unit:
        norm = F.sqrt(F.sum(F.when(F.col("_on"), w * w)).over(on))
        v = v.withColumn("weight", w / F.when(F.coalesce(norm, F.lit(0.0)) == 0, F.raise_error(F.lit("a vector of norm 0")).cast("double")).otherwise(norm))
    return v


def project(df: DataFrame, vectors: DataFrame, unit: bool = True, centred: bool = False, orthogonal: bool = False, only: str | None = None, into: str = "k") -> DataFrame:
    """Dot products of every map with vectors (k, channel, weight) over the channels ``only`` (a list; all by default): (epoch_id, point, k, value), or with ``into`` channel or item the
    scalars as channels or items."""
    from ..functions.channels import selected

    ready = prepared(vectors, "channel", unit, centred, orthogonal, selected(vectors, only) if only else None).where("_on").drop("_on")
    out = df.repartition("epoch_id", "point").join(F.broadcast(ready), "channel").groupBy("epoch_id", "point", "k").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
    return _scalars(out, into, "point")


def _scalars(out: DataFrame, into: str, axis: str) -> DataFrame:
    if into == "k":
        return out
    if into == "item":
        return out.withColumn("item", F.col("k").cast("int")).withColumn("channel", F.lit("projected")).withColumn("channel_idx", F.lit(0)).drop("k")
    return out.withColumn("channel", F.concat(F.lit("projected"), (F.col("k") + 1).cast("string"))).withColumn("channel_idx", F.col("k").cast("int")).drop("k")


def correlate(df: DataFrame, templates: DataFrame, unit: bool = True, centred: bool = False, orthogonal: bool = False) -> DataFrame:
    """Dot products of every trace with templates (k, point, weight): (epoch_id, channel, k, value)."""
    met = df.repartition(*axes(df, "point")).join(F.broadcast(prepared(templates, "point", unit, centred, orthogonal).drop("_on")), "point")
    return met.groupBy(*[c for c in axes(df, "point")], "k").agg(F.sum(F.col("value") * F.col("weight")).alias("value"))


def multiplied(weights: DataFrame, vectors: DataFrame, across: str = "channel", unit: bool = True, centred: bool = False, orthogonal: bool = False) -> DataFrame:
    """The reverse of scalars: epochs whose channels (or, of one channel, items) are the weights of vectors (k, ``across``, weight) become the sums of weights times vectors. With
    ``across`` point the vectors are time courses and each channel's items their weights."""
    by_item = across == "point" or "item" in weights.columns
    other = "channel" if across == "point" else "point"
    w = weights.select("epoch_id", *([other] if other in weights.columns else []), F.col("item" if by_item else "channel_idx").alias("k"), F.col("value").alias("_w"))
    ready = prepared(vectors, across, unit, centred, orthogonal).drop("_on")
    keys = [c for c in ("epoch_id", other) if c in w.columns]
    return w.join(ready, "k").groupBy(*keys, across).agg(F.sum(F.col("_w") * F.col("weight")).alias("value"))


def subspace(df: DataFrame, vectors: DataFrame, across: str = "channel", remove: bool = False) -> DataFrame:
    """Maps (or traces, ``across`` point) projected onto the space of orthonormal vectors (k, axis, weight), or with that part removed.
    The vectors, a handful, are sent to the samples: a join by so few keys would put the samples into as few tasks. Maps are dealt out before they are summed, so that a task's groups are those of its share of the samples and not of all that one file holds."""
    other = "point" if across == "channel" else "channel"
    scores = df.repartition("epoch_id", other).join(F.broadcast(vectors), across).groupBy("epoch_id", other, "k").agg(F.sum(F.col("value") * F.col("weight")).alias("_c"))
    part = scores.join(F.broadcast(vectors), "k").groupBy("epoch_id", other, across).agg(F.sum(F.col("_c") * F.col("weight")).alias("_p"))
    met = df.join(part, ["epoch_id", other, across], "left").withColumn("_p", F.coalesce("_p", F.lit(0.0)))
    return met.withColumn("value", F.col("value") - F.col("_p") if remove else F.col("_p")).select(*df.columns)


def overlapping(a: DataFrame, b: DataFrame, by: str, width: float) -> DataFrame:
    """Pairs of intervals (start, end) that overlap, ends excluded. Both sides are spread over cells, so that they meet by equality; a pair is reported in the first cell they share.

    Cells have widths of ``width`` times powers of two. An interval has the level at which a cell is at least as long as it is, and stands in the cells (two at most) of that level and of the
    coarser ones that occur; two meet at the coarser of their levels. So a long interval costs no more rows than a short one.
    """

    def side(df: DataFrame, x: str) -> DataFrame:
        length = (F.col("end") - F.col("start")).cast("double")
        level = F.when(length > width, F.ceil(F.log2(length / F.lit(float(width)))).cast("int")).otherwise(0)
        return df.select(by, F.col("start").alias(f"{x}start"), F.col("end").alias(f"{x}end"), level.alias(f"_{x}level"))

    def spread(df: DataFrame, x: str) -> DataFrame:
        at = df.join(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).where(F.col("_level") >= F.col(f"_{x}level")).drop("_levels")  # one row, a level for each doubling of lengths
        cell = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(2.0), "_level")))
        return at.withColumn("_cell", F.explode(F.sequence(cell(f"{x}start"), cell(f"{x}end"))))

    left, right = side(a, "a_"), side(b, "b_")
    levels = left.select(F.col("_a_level").alias("_l")).union(right.select("_b_level")).agg(F.collect_set("_l").alias("_levels"))
    met = spread(left, "a_").join(spread(right, "b_"), [by, "_level", "_cell"]).where((F.col("_level") == F.greatest("_a_level", "_b_level")) & (F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    first = F.floor(F.greatest("a_start", "b_start") / (F.lit(float(width)) * F.pow(F.lit(2.0), "_level")))
    return met.where(F.col("_cell") == first).select(by, "a_start", "a_end", "b_start", "b_end")


def not_near(events: DataFrame, breaks: DataFrame, by: str, distance: float) -> DataFrame:
    """Events with no break less than ``distance`` away: cells of that width make it an equality join on three cells."""
    cells = breaks.select(by, F.col("at").alias("_b"), F.explode(F.array(*[F.floor(F.col("at") / distance) + k for k in (-1, 0, 1)])).alias("_cell"))
    held = events.withColumn("_cell", F.floor(F.col("at") / distance))
    out = held.join(cells, (held[by] == cells[by]) & (held["_cell"] == cells["_cell"]) & (F.abs(held["at"] - cells["_b"]) < distance), "left_anti")
    return out.drop("_cell")
