"""Selection, renaming and rearrangement of axes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..epochs import axes
from ..functions import channels as C
from ..functions import maths as M

# Channel places (x to the right, y to the front; z is 0) of the two built-in layouts. Names are met in any case.
#: Sleep recordings, on a grid of lines. The names of ``PSG_SENSORS`` are also met after "EEG " and "EEG_", where those of ``PSG_MEANS`` are too.
PSG_SENSORS = {
    "Fp1": (-1.0, 4.0), "Fpz": (0.0, 4.0), "Fp2": (1.0, 4.0), "F7": (-2.0, 3.0), "F3": (-1.0, 3.0), "Fz": (0.0, 3.0), "F4": (1.0, 3.0), "F8": (2.0, 3.0),
    "T3": (-2.0, 2.0), "T7": (-2.0, 2.0), "C3": (-1.0, 2.0), "Cz": (0.0, 2.0), "C4": (1.0, 2.0), "T4": (2.0, 2.0), "T8": (2.0, 2.0),
    "T5": (-2.0, 1.0), "P3": (-1.0, 1.0), "Pz": (0.0, 1.0), "P4": (1.0, 1.0), "T6": (2.0, 1.0), "O1": (-1.0, 0.0), "Oz": (0.0, 0.0), "O2": (1.0, 0.0),
    "A1": (-3.0, 2.0), "A2": (3.0, 2.0), "M1": (-3.0, 2.0), "M2": (3.0, 2.0),
}
PSG_MEANS = {"Pz-AA": (0.0, 1.0), "A1-AA": (-3.0, 2.0), "A2-AA": (3.0, 2.0)}
PSG_OTHER = {
    "vEOG": (1.0, 5.0), "EOG": (1.0, 5.0), "hEOG": (-1.0, 5.0), "hEOGl": (-2.0, 5.0), "hEOGr": (-1.0, 5.0), "EOG LOC": (-2.0, 5.0), "EOG ROC": (-1.0, 5.0), "EOG_LOC": (-2.0, 5.0), "EOG_ROC": (-1.0, 5.0),
    "EKG": (-3.0, -1.0), "ECG": (-3.0, -1.0), "POLY1": (-1.0, -1.0), "POLY2": (0.0, -1.0), "K25": (-2.0, -2.0), "K26": (-1.0, -2.0), "K27": (0.0, -2.0), "EMG": (1.0, -2.0),
    "EMG EMGchin": (-3.0, -2.0), "EMG EMGTible": (-2.0, -2.0), "EMG EMGTibri": (-1.0, -2.0), "EMG_EMGchin": (-3.0, -2.0), "EMG_EMGTible": (-2.0, -2.0), "EMG_EMGTibri": (-1.0, -2.0),
    "ATM": (-2.0, -1.0), "Airflow": (-1.0, -1.0), "Thorax": (0.0, -1.0), "Abdomen": (1.0, -1.0), "Plethysmogram": (2.0, -1.0), "SpO2": (3.0, -1.0), "Pulse": (1.0, -2.0), "Snoring": (2.0, -2.0),
}
#: Scalp positions.
EEG = {
    "Nas": (0.0, 2.4), "Nz": (0.0, 2.4), "IO1": (-0.628435, 2.5), "IO2": (0.628435, 2.5),
    "Fp1": (-0.628435, 1.93413), "Fpz": (0.0, 1.93413), "Fp2": (0.628435, 1.93413),
    "AF7": (-1.2, 1.5), "AF3": (-0.628435, 1.5), "AFz": (0.0, 1.5), "AF4": (0.628435, 1.5), "AF8": (1.2, 1.5),
    "F9": (-2.0, 1.4), "F7": (-1.64527, 1.19536), "F5": (-1.2, 1.0), "F3": (-0.817511, 1.00954), "F1": (-0.5, 1.00954), "Fz": (0.0, 0.938984), "F2": (0.5, 1.00954), "F4": (0.817511, 1.00954), "F6": (1.2, 1.0), "F8": (1.64527, 1.19536), "F10": (2.0, 1.4),
    "T7": (-2.03366, 0.0), "C5": (-1.5, 0.0), "C3": (-0.938984, 0.0), "C1": (-0.5, 0.0), "Cz": (0.0, 0.0), "C2": (0.5, 0.0), "C4": (0.938984, 0.0), "C6": (1.5, 0.0), "T8": (2.03366, 0.0),
    "T3": (-2.03366, 0.0), "T4": (2.03366, 0.0), "T5": (-1.64527, -1.19536), "T6": (1.64527, -1.19536),
    "P9": (-2.03449, -1.5), "P7": (-1.64527, -1.19536), "P5": (-1.2, -1.00954), "P3": (-0.817511, -1.00954), "P1": (-0.4, -1.00954), "P2": (0.4, -1.00954), "Pz": (0.0, -0.938984), "P4": (0.817511, -1.00954), "P6": (1.2, -1.00954), "P8": (1.64527, -1.19536), "P10": (2.03449, -1.5),
    "PO9": (-1.5, -2.0), "PO7": (-1.2, -1.4), "PO3": (-0.5, -1.4), "POz": (0.0, -1.4), "PO4": (0.5, -1.4), "PO8": (1.2, -1.4), "PO10": (1.5, -2.0),
    "O9": (-0.8, -2.2), "O1": (-0.628435, -1.93413), "Oz": (0.0, -1.93413), "O2": (0.628435, -1.93413), "O10": (0.8, -2.2), "Iz": (0.0, -2.4),
    "FT9": (-2.3, 0.5), "FT7": (-2.0, 0.576335), "FC5": (-1.5014, 0.576335), "FC3": (-0.9, 0.431647), "FC1": (-0.431647, 0.431647), "FCz": (0.0, 0.431647), "FC2": (0.431647, 0.431647), "FC4": (0.9, 0.431647), "FC6": (1.5014, 0.576335), "FT8": (2.0, 0.576335), "FT10": (2.3, 0.5),
    "TP9": (-2.03449, -0.740495), "TP7": (-1.75, -0.6), "CP5": (-1.5014, -0.576335), "CP3": (-1.0, -0.5), "CP1": (-0.431647, -0.431647), "CPz": (0.0, -0.431647), "CP2": (0.431647, -0.431647), "CP4": (1.0, -0.5), "CP6": (1.5014, -0.576335), "TP8": (1.75, -0.6), "TP10": (2.03449, -0.740495),
    "A1": (-2.5, 0.0), "A2": (2.5, 0.0), "M1": (-2.5, 0.0), "M2": (2.5, 0.0),
    "VeogO": (1.237002, 2.36252), "VeogU": (0.618501, 2.36252), "Eog": (0.618501, 2.36252), "EOGV": (0.0, 2.36252), "EOGL": (-1.64527, 2.36252), "EOGR": (1.64527, 2.36252),
    "Ekg1": (-1.78836, 2.34242), "Ekg2": (-1.77885, 1.94955), "Ekg": (-1.78836, 2.2), "ECG": (-1.78836, 2.2), "BEMG1": (2.0, 2.34242), "BEMG2": (2.0, 1.94955), "EDA": (0.0, 0.0),
}
#: Channels that a layout does not know stand in a row of their own, at this distance and on this line.
UNKNOWN = (0.5, -3.0)
PSG = PSG_OTHER | PSG_SENSORS | {f"EEG{joint}{n}": p for joint in (" ", "_") for n, p in (PSG_SENSORS | PSG_MEANS).items()}
LAYOUTS = {"PSG": PSG, "EEG": EEG}


def remove_channels(df: DataFrame, names: str) -> DataFrame:
    return df.where(~C.selected(df, names))


def keep_channels(df: DataFrame, names: str) -> DataFrame:
    """Only the named channels, renumbered in the order of the list."""
    if names.lstrip("?!") != names and "!" in names[:2]:
        return df.where(C.selected(df, names))
    listed = C.names(names)
    place = F.array_position(F.array(*[F.lit(n) for n in listed]), F.col("channel"))
    return df.where(C.selected(df, names)).withColumn("channel_idx", (place - 1).cast("int"))


def remove_channel_ranges(df: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Without the channels whose 1-based numbers lie in the ranges, ends included."""
    gone = F.lit(False)
    for a, b in ranges:
        gone = gone | (F.col("channel_idx") + 1).between(a, b)
    return df.where(~gone)


def extract_items(df: DataFrame, order: list[int]) -> DataFrame:
    """Items chosen, reordered or repeated by number."""
    return df.withColumn("items", F.array(*[F.get("items", F.lit(k)) for k in order]))


def collapse_channels(df: DataFrame, sets: dict[str, str] | None = None, how: str = "mean", leaveright: int = 0) -> DataFrame:
    """Aggregate sets of channels into new ones ({new name: list}); without sets all become ``collapsed``. Items that are only summed are never averaged."""
    sets = sets or {"collapsed": "ALL"}
    made = F.array(*[F.when(C.selected(df, spec), F.lit(name)) for name, spec in sets.items()])
    wide = df.withColumn("_new", F.explode(F.filter(made, lambda n: n.isNotNull())))
    keys = [c for c in axes(df, "channel")]
    v = F.col("value")
    agg = {"mean": F.avg(v), "sum": F.sum(v), "max": F.max(M.number(v)), "min": F.min(M.number(v))}[how]
    if how == "mean" and leaveright and "item" in df.columns:
        top = F.max("item").over(Window.partitionBy(*axes(df, "item")))
        wide = wide.withColumn("_kept", F.col("item") > top - leaveright)
        agg = F.when(F.first("_kept"), F.sum(v)).otherwise(F.avg(v))
    return wide.groupBy(*keys, F.col("_new").alias("channel")).agg(agg.alias("value"))


def _ranges(df: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """For each trace its ranges (r, o, l) and the output point that each starts at; length 0 goes to the end."""
    keys = axes(df, "point")
    n = df.groupBy(*keys).agg(F.count("*").cast("int").alias("_n"))
    parts = F.array(*[F.struct(F.lit(k).alias("r"), F.lit(o).alias("o"), F.lit(length).alias("l")) for k, (o, length) in enumerate(ranges)])
    wide = n.withColumn("_p", F.explode(parts)).select(*keys, "_n", "_p.r", "_p.o", "_p.l")
    return _started(wide.withColumn("l", F.when(F.col("l") == 0, F.col("_n") - F.col("o")).otherwise(F.col("l"))), keys)


def _started(wide: DataFrame, keys: list[str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    return wide.withColumn("_start", F.coalesce(F.sum("l").over(before), F.lit(0))).where("l > 0")


def _trimmed(df: DataFrame, wide: DataFrame, how: str | None, q: float) -> DataFrame:
    keys = axes(df, "point")
    with_x = "x" in df.columns
    wide = wide.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("l") - 1))).withColumn("_from", (F.col("o") + F.col("_k")).cast("int"))
    met = wide.join(df.select(*keys, F.col("point").alias("_from"), "value", *(["x"] if with_x else [])), [*keys, "_from"], "left")
    if how is None:
        x = [F.coalesce("x", F.lit(0.0)).alias("x")] if with_x else []
        return met.select(*keys, (F.col("_start") + F.col("_k")).cast("int").alias("point"), *x, F.coalesce("value", F.lit(0.0)).alias("value"))
    v = F.col("value")
    reached = F.sum(F.when(F.col("_from") < F.col("_n"), 1).otherwise(0))
    reached = F.when(reached == 0, 1).otherwise(reached)
    agg = {
        "mean": F.coalesce(F.sum(v), F.lit(0.0)) / reached,
        "sum": F.coalesce(F.sum(v), F.lit(0.0)),
        "max": F.max(M.number(v)),
        "min": F.min(M.number(v)),
        "quantile": M.quantile_of_sorted(F.array_sort(F.collect_list(v)), q),
    }[how]
    x = [(F.coalesce(F.sum("x"), F.lit(0.0)) / reached).alias("x")] if with_x else []  # a sum of x would mean nothing
    return met.groupBy(*keys, F.col("r").cast("int").alias("point")).agg(*x, agg.alias("value"))


def trim(df: DataFrame, ranges: list[tuple[int, int]], how: str | None = None, q: float = 0.5, leaveright: int = 0) -> DataFrame:
    """Concatenate ranges (offset, length) of points. A negative offset or an over-long range is padded with zeros; length 0 goes to the end.
    ``how`` (mean, sum, max, min, quantile) makes one point of each range: a mean's divisor counts zeros in front but none past the end. x, if
    there is one, goes along, and is always averaged."""
    return _trimmed(df, _ranges(df, ranges), how, q) if ranges else df.limit(0)


def _x_ranges(df: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    """For each trace the ranges whose ends are the points nearest to x values (of equally near ones the later)."""
    keys = axes(df, "point")
    ends = [F.min_by("point", F.struct(F.abs(F.col("x") - F.lit(float(v))), -F.col("point"))) for pair in ranges for v in pair]
    n = df.groupBy(*keys).agg(F.count("*").cast("int").alias("_n"), *[e.alias(f"_e{k}") for k, e in enumerate(ends)])
    parts = F.array(*[F.struct(F.lit(k).alias("r"), F.col(f"_e{2 * k}").alias("o"), (F.col(f"_e{2 * k + 1}") - F.col(f"_e{2 * k}") + 1).alias("l")) for k in range(len(ranges))])
    return _started(n.withColumn("_p", F.explode(parts)).select(*keys, "_n", "_p.r", "_p.o", "_p.l"), keys)


def trim_x(df: DataFrame, ranges: list[tuple[float, float]], how: str | None = None, q: float = 0.5) -> DataFrame:
    """The same for ranges (from, to) of x, both ends included; x must grow with the points."""
    return _trimmed(df, _x_ranges(df, ranges), how, q) if ranges else df.limit(0)


def trim_triggers(df: DataFrame, triggers: DataFrame, ranges: list[tuple[int, int]], collapsed: bool = False) -> DataFrame:
    """Triggers (epoch_id, position, code ...) of the epochs ``df`` after ``trim``: those inside a range move with it, the others go."""
    wide = _ranges(df.select("epoch_id", "point").distinct().withColumn("value", F.lit(0.0)), ranges)
    met = triggers.join(wide, "epoch_id").where((F.col("position") >= F.col("o")) & (F.col("position") < F.col("o") + F.col("l")))
    place = F.col("r") if collapsed else F.col("position") - F.col("o") + F.col("_start")
    return met.withColumn("position", place.cast("long")).select(*triggers.columns)


def trim_epochs(epochs: DataFrame, ranges: list[tuple[int, int]], collapsed: bool = False) -> DataFrame:
    """Metadata after ``trim``: beforetrig moves by the first range's start and stays inside the epoch."""
    lengths = [F.when(F.lit(length) == 0, F.col("n_points") - o).otherwise(F.lit(length)) for o, length in ranges]
    n = F.lit(len(ranges)) if collapsed else sum(lengths[1:], lengths[0])
    before = F.greatest(F.lit(0), F.least(F.col("beforetrig") - ranges[0][0], n)).cast("int")
    return epochs.withColumns({"n_points": n.cast("int"), "beforetrig": before})


def runs_where(df: DataFrame, channel: str, low: float, high: float) -> DataFrame:
    """Maximal runs of points at which one channel lies in [low, high]: (epoch_id, offset, length)."""
    inside = df.where((F.col("channel") == channel) & F.col("value").between(low, high))
    w = Window.partitionBy("epoch_id").orderBy("point")
    island = inside.withColumn("_g", F.col("point") - F.row_number().over(w))
    return island.groupBy("epoch_id", "_g").agg(F.min("point").alias("offset"), F.count("*").cast("int").alias("length")).drop("_g")


def trim_runs(df: DataFrame, channel: str, low: float, high: float) -> DataFrame:
    """Only the points in such runs, numbered anew; an epoch without any is rejected."""
    inside = df.where((F.col("channel") == channel) & F.col("value").between(low, high)).select("epoch_id", "point")
    w = Window.partitionBy("epoch_id").orderBy("point")
    new = inside.withColumn("_new", (F.row_number().over(w) - 1).cast("int"))
    return df.join(new, ["epoch_id", "point"]).withColumn("point", F.col("_new")).drop("_new").select(*df.columns)


def swap_fc(df: DataFrame, sfreq: float, step: float, unit: str = "Hz") -> DataFrame:
    """Frequencies become channels, named with two decimals and the unit; the epoch's number over sfreq is its z. Takes one channel."""
    return df.select("epoch_id", F.format_string(f"%.2f{unit}", F.col("point") * F.lit(step)).alias("channel"), F.lit(0).alias("point"), "value", (F.col("epoch_id") / F.lit(sfreq)).alias("z"))


def swap_fc_back(df: DataFrame, sfreq: float) -> DataFrame:
    """The reverse: epochs of one point whose channels are named by frequencies become spectra of one channel ``swapped``; x is the number a name starts with, else the channel's."""
    number = F.regexp_extract("channel", r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)", 1)
    x = F.when(number != "", number.cast("double")).otherwise(F.col("channel_idx").cast("double"))
    more = df.groupBy("epoch_id").agg((F.max("point") > F.min("point")).alias("_more"))
    held = df.join(more, "epoch_id").withColumn("value", F.when(F.col("_more"), F.raise_error(F.lit("swapping takes one channel or one point")).cast("double")).otherwise(F.col("value")))
    return held.select("epoch_id", F.lit("swapped").alias("channel"), F.col("channel_idx").cast("int").alias("point"), x.alias("x"), "value", (F.col("epoch_id") / F.lit(sfreq)).alias("z"))


def swap_ic(df: DataFrame) -> DataFrame:
    """Items become channels and channels items; both lose their names."""
    number = F.dense_rank().over(Window.partitionBy(*[c for c in axes(df, "channel") if c not in ("item", "point")]).orderBy(*[c for c in ("channel_idx", "channel") if c in df.columns]))
    out = df.withColumn("_c", number)
    return out.withColumn("channel", (F.col("item") + 1).cast("string")).withColumn("item", (F.col("_c") - 1).cast("int")).drop("_c", "channel_idx")


def swap_ix(df: DataFrame) -> DataFrame:
    """Items become points and points items; x is lost."""
    return df.withColumn("_p", F.col("point")).withColumn("point", F.col("item")).withColumn("item", F.col("_p")).drop("_p", "x")


def swap_xz(df: DataFrame) -> DataFrame:
    """Points become epochs and epochs points."""
    return df.withColumn("_p", F.col("point")).withColumn("point", F.col("epoch_id")).withColumn("epoch_id", F.col("_p")).drop("_p")


def set_values(epochs: DataFrame, **values) -> DataFrame:
    """Metadata of epochs set to constants or expressions."""
    return epochs.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def add_trigger(triggers: DataFrame, epochs: DataFrame, position: int, code: int, description: str | None = None) -> DataFrame:
    """One more trigger in each epoch, moved into it if it lies outside."""
    place = F.greatest(F.lit(0), F.least(F.lit(position), F.col("n_points") - 1)).cast("long")
    new = epochs.select("epoch_id", place.alias("position"), F.lit(code).alias("code"), F.lit(description).cast("string").alias("description"))
    return triggers.unionByName(new)


def set_comment(epochs: DataFrame, text: str, mode: str = "set") -> DataFrame:
    old = F.coalesce("comment", F.lit(""))
    new = {"set": F.lit(text), "append": F.concat(old, F.lit(text)), "prepend": F.concat(F.lit(text), old)}[mode]
    return epochs.withColumn("comment", new)


def change_axes(df: DataFrame, x_offset: float = 0.0, x_factor: float = 1.0, z_offset: float = 0.0, z_factor: float = 1.0, x_label: str | None = None, z_label: str | None = None) -> DataFrame:
    """x = (x + offset) * factor, and z likewise where there is one; labels become constant columns."""
    new = {"x": (F.col("x") + F.lit(float(x_offset))) * F.lit(float(x_factor))} if "x" in df.columns else {}
    for z in ("z", "z_value"):
        if z in df.columns:
            new[z] = (F.col(z) + F.lit(float(z_offset))) * F.lit(float(z_factor))
    labels = {n: F.lit(v) for n, v in (("x_label", x_label), ("z_label", z_label)) if v is not None}
    return df.withColumns(new | labels)


def grid_positions(channels: list[str]) -> dict[str, tuple[float, float, float]]:
    """Places on a grid about as wide as high, row by row."""
    side = round(math.sqrt(len(channels)))
    return {c: (float(k % side), float(-(k // side)), 0.0) for k, c in enumerate(channels)}


def set_layout(channels: DataFrame, layout: str) -> DataFrame:
    """(channel_idx, channel, px, py, pz ...) with the places of a built-in layout, ``PSG`` or ``EEG``; unknown channels stand in a row of their own, in order."""
    place = F.create_map(*[x for n, p in LAYOUTS[layout].items() for x in (F.lit(n.lower()), F.array(*map(F.lit, p)))])
    found = F.try_element_at(place, F.lower("channel"))
    by = Window.partitionBy(*[c for c in ("epoch_id",) if c in channels.columns] or [F.lit(0)]).orderBy("channel_idx")  # the channels of one epoch
    unknown = F.sum(found.isNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1
    out = channels.withColumn("_place", F.coalesce(found, F.array(unknown * F.lit(UNKNOWN[0]), F.lit(UNKNOWN[1]))))
    return out.withColumns({"px": F.col("_place")[0], "py": F.col("_place")[1], "pz": F.lit(0.0)}).drop("_place")


def rename_channels(df: DataFrame, names: list[str]) -> DataFrame:
    """The first channels, by number, get new names."""
    new = F.get(F.array(*map(F.lit, names)), F.col("channel_idx"))
    return df.withColumn("channel", F.coalesce(new, "channel"))


def set_channel_positions(channels: DataFrame, positions: dict[str, tuple[float, float, float]] | str) -> DataFrame:
    """(channel, px, py, pz ...) with places by name; channels not listed keep theirs. The list is a literal of a few names, or a built-in layout's name."""
    if isinstance(positions, str):
        return set_layout(channels, positions)
    if not positions:
        return channels
    place = F.create_map(*[x for n, p in positions.items() for x in (F.lit(n), F.array(*[F.lit(float(v)) for v in p]))])
    found = F.try_element_at(place, F.col("channel"))
    return channels.withColumns({c: F.coalesce(F.get(found, F.lit(k)), F.col(c) if c in channels.columns else F.lit(None).cast("double")) for k, c in enumerate(("px", "py", "pz"))})


def normalize_channelbox(positions: np.ndarray) -> np.ndarray:
    """Places turned into their principal axes: widest along x, narrowest along z, centred, and scaled to a width of 1. For the few rows of a channel table."""
    centred = positions - positions.mean(axis=0)
    _, _, turn = np.linalg.svd(centred, full_matrices=True)
    turn = turn * np.where(np.abs(turn).max(axis=1) == turn.max(axis=1), 1, -1)[:, None]
    turned = centred @ turn.T
    width = np.ptp(turned[:, 0])
    return turned / width if width > 0 else turned


def normalize_channels(channels: DataFrame) -> DataFrame:
    """(epoch_id, channel_idx, px, py, pz ...) with each epoch's places normalised; its channels go through one task."""

    def run(pdf):
        pdf = pdf.sort_values("channel_idx", kind="stable").copy()
        pdf[["px", "py", "pz"]] = normalize_channelbox(pdf[["px", "py", "pz"]].to_numpy(float))
        return pdf

    return channels.groupBy("epoch_id").applyInPandas(run, channels.schema)


def add_zero_channel(df: DataFrame, name: str) -> DataFrame:
    """One more channel, 0 throughout."""
    new = df.select(*axes(df, "channel")).distinct().withColumn("channel", F.lit(name)).withColumn("value", F.lit(0.0))
    if "channel_idx" in df.columns:
        top = df.groupBy("epoch_id").agg((F.max("channel_idx") + 1).alias("channel_idx"))
        new = new.join(top, "epoch_id")
    return df.unionByName(new, allowMissingColumns=True)


def link_order(df: DataFrame, order: list[int]) -> DataFrame:
    """Data sets reordered by number, from 1; those not named go."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("dataset_no").cast("int"))
    return df.where(place > 0).withColumn("dataset_no", place.cast("int"))


def push(df: DataFrame) -> DataFrame:
    """The top data set, doubled."""
    top = df.agg(F.max("dataset_no").alias("_top"))
    last = df.join(F.broadcast(top), F.col("dataset_no") == F.col("_top")).drop("_top")  # one row
    return df.unionByName(last.withColumn("dataset_no", F.col("dataset_no") + 1))


def pop(df: DataFrame) -> DataFrame:
    """Without the top data set; the only one can't be dropped."""
    top = df.agg(F.max("dataset_no").alias("_top"), F.min("dataset_no").alias("_low"))
    held = df.join(F.broadcast(top))  # one row
    alone = F.col("_top") == F.col("_low")
    kept = F.when(alone, F.raise_error(F.lit("the only data set can't be dropped")).cast("boolean")).otherwise(F.col("dataset_no") < F.col("_top"))
    return held.where(kept).select(*df.columns)


def import_point(df: DataFrame, point: int, values: DataFrame) -> DataFrame:
    """One point overwritten from (channel, value)."""
    new = values.select("channel", F.col("value").alias("_new"))
    return df.join(new, "channel", "left").withColumn("value", F.when(F.col("point") == point, F.coalesce("_new", "value")).otherwise(F.col("value"))).select(*df.columns)


def export_point(df: DataFrame, point: int, channels: DataFrame | None = None) -> DataFrame:
    """The map at one point, with the channels' places if given."""
    out = df.where(F.col("point") == point).select("epoch_id", "channel", "value")
    return out.join(channels, "channel", "left") if channels is not None else out


#: What may be asked of epochs, and the column that answers.
QUERY = ("sfreq", "beforetrig", "aftertrig", "n_points", "itemsize", "leaveright", "condition", "nrofaverages", "file_start_point", "points_in_file", "x_label", "z_label", "z_value", "comment", "basefreq", "basetime", "n_shifts", "windowsize", "shiftwidth", "data_type", "accepted_epochs", "rejected_epochs")


def query(epochs: DataFrame, *variables: str) -> DataFrame:
    """Metadata by name."""
    unknown = [v for v in variables if v not in QUERY]
    if unknown:
        raise KeyError(f"unknown variables: {', '.join(unknown)}")
    derived = {"aftertrig": F.col("n_points") - F.col("beforetrig")} if "aftertrig" in variables and "aftertrig" not in epochs.columns else {}
    return epochs.withColumns(derived).select("epoch_id", *variables)
