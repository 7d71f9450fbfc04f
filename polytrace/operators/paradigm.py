"""Events: trials, reaction times, code sequences, ranges, sections and measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..epochs import samples, traces
from ..functions import maths as M
from . import spectral, trace


def trials(events: DataFrame, stimuli: list, responses: list, min_rt: float, max_rt: float, by: str = "recording") -> DataFrame:
    """Stimulus events with the next stimulus or response after them: answered if that is a response min_rt to max_rt later. Codes of neither kind
    don't count; an empty list accepts every code. ``events``: (by, at, code, tie)."""
    is_s = F.col("code").isin(stimuli) if stimuli else F.lit(True)
    is_r = F.col("code").isin(responses) if responses else F.lit(True)
    w = Window.partitionBy(by).orderBy("at", "tie")
    told = events.where(is_s | is_r).withColumn("_next", F.lead("code").over(w)).withColumn("_at", F.lead("at").over(w))
    rt = F.col("_at") - F.col("at")
    answered = F.coalesce(F.col("_next").isin(responses) if responses else F.col("_next").isNotNull(), F.lit(False)) & F.coalesce(rt.between(min_rt, max_rt), F.lit(False))
    return told.where(is_s).select(by, "at", "code", answered.alias("answered"), F.when(answered, F.col("_next")).alias("response"), F.when(answered, rt).alias("rt"))


def trigger_stats(events: DataFrame, by: list[str]) -> DataFrame:
    """For each group: how many, and mean, sample deviation, extremes and quartiles of the differences between successive times.
    A deviation of a single difference is null."""
    w = Window.partitionBy(*by).orderBy("at", "tie")
    d = events.withColumn("_d", F.col("at") - F.lag("at").over(w))
    x = F.col("_d")
    n = F.count(x).cast("double")
    variance = (F.sum(x * x) - F.sum(x) * F.sum(x) / n) / F.when(n > 1, n - 1)
    listed = F.array_sort(F.collect_list(x))  # nulls are left out
    return d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mean"),
        F.when(variance < 0, 0.0).otherwise(F.sqrt(variance)).alias("sd"),
        F.min(x).alias("min"),
        M.trial_quantile_of_sorted(listed, 0.25).alias("q25"),
        M.trial_quantile_of_sorted(listed, 0.5).alias("q50"),
        M.trial_quantile_of_sorted(listed, 0.75).alias("q75"),
        F.max(x).alias("max"),
    )


def code_sequences(events: DataFrame, sequences: dict[tuple, object], longest: float, by: str = "recording") -> DataFrame:
    """Sequences of codes within ``longest`` replaced by a new code at the first one's time; the longest that fits wins. An automaton, so each recording is walked in order."""
    order = sorted(sequences, key=len, reverse=True)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "tie"], kind="stable").reset_index(drop=True)
        code, at, out, k = pdf["code"].tolist(), pdf["at"].tolist(), [], 0
        while k < len(code):
            for s in order:
                if tuple(code[k : k + len(s)]) == s and at[k + len(s) - 1] - at[k] <= longest:
                    out.append((k, sequences[s]))
                    k += len(s)
                    break
            else:
                out.append((k, code[k]))
                k += 1
        kept = pdf.loc[[k for k, _ in out]].copy()
        kept["code"] = [c for _, c in out]
        return kept

    return events.groupBy(by).applyInPandas(walk, events.schema)


def ranges_from_crossings(crossings: DataFrame, by: list[str], start_sign: int = 1, min_length: float = 0.0, debounce: float = 0.0) -> DataFrame:
    """A range starts at a crossing of the expected sign and ends at the next opposite one; one without an end is dropped, so are those shorter than min_length; then a gap of
    at most ``debounce`` joins a range to the one before. ``crossings``: (by, at, code)."""
    w = Window.partitionBy(*by).orderBy("at")
    # of several crossings with the same sign in a row only the first starts a range
    turned = crossings.withColumn("_p", F.lag("code").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("code")))
    pair = turned.withColumn("end", F.lead("at").over(w)).where((F.col("code") == start_sign) & F.col("end").isNotNull())
    kept = pair.select(*by, F.col("at").alias("start"), "end").where(F.col("end") - F.col("start") >= min_length)
    return joined_ranges(kept, by, debounce)


def joined_ranges(ranges: DataFrame, by: list[str], gap: float = 0.0) -> DataFrame:
    """Ranges whose gaps are at most ``gap`` become one."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") - reach > gap).cast("int"), F.lit(1))
    island = ranges.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return island.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def true_ranges(df: DataFrame, by: list[str], min_true: float = 0.0, min_false: float = 0.0) -> DataFrame:
    """Ranges of consecutive points with ``on``: shorter gaps than or as short as min_false are closed first, then ranges not longer than min_true go."""
    w = Window.partitionBy(*by).orderBy("point")
    inside = df.where("on").withColumn("_g", F.col("point") - F.row_number().over(w))
    runs = inside.groupBy(*by, "_g").agg(F.min("point").alias("start"), (F.max("point") + 1).alias("end")).drop("_g")
    return joined_ranges(runs, by, min_false).where(F.col("end") - F.col("start") > min_true)


def clear_sections(breaks: DataFrame, spans: DataFrame, by: str, margin: float) -> DataFrame:
    """The parts of each span (by, start, end) that no break (by, at), widened by ``margin``, touches."""
    w = Window.partitionBy(by).orderBy("_from", "_to")
    wide = breaks.select(by, (F.col("at") - margin).alias("_from"), (F.col("at") + margin).alias("_to"))
    ends = spans.select(by, F.col("start").alias("_from"), F.col("start").alias("_to")).unionByName(spans.select(by, F.col("end").alias("_from"), F.col("end").alias("_to")))
    reach = F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = wide.unionByName(ends).withColumn("start", reach).withColumn("end", F.col("_from"))
    inside = gaps.join(spans.select(by, F.col("start").alias("_s"), F.col("end").alias("_e")), by)
    cut = inside.select(by, F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end"))
    return cut.where("end > start")


def windows_in_sections(sections: DataFrame, length: float, step: float) -> DataFrame:
    """start, start + step, ... of windows that fit into each section."""
    count = F.floor((F.col("end") - F.col("start") - length) / step)
    out = sections.where(F.col("end") - F.col("start") >= length).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), count)))
    return out.withColumn("at", F.col("start") + F.col("_k") * F.lit(step)).drop("_k")


def measure(df: DataFrame, ranges: list[tuple[str, float, float]], sign: int = 1) -> DataFrame:
    """For each epoch, channel and inclusive x range: the mean amplitude, and the latency of the centre of gravity of value - minimum (of the negated values for sign -1)."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for n, a, b in ranges])
    wide = df.withColumn("_r", F.explode(parts)).where((F.col("x") >= F.col("_r.low")) & (F.col("x") <= F.col("_r.high")))
    keys = ["epoch_id", "channel", "range"]
    wide = wide.select("epoch_id", "channel", F.col("_r.name").alias("range"), "x", "value").withColumn("_v", F.col("value") * sign)
    weight = F.col("_v") - F.min("_v").over(Window.partitionBy(*keys))
    return wide.withColumn("_w", weight).groupBy(*keys).agg(F.avg("value").alias("amplitude"), F.when(F.sum("_w") != 0, F.sum(F.col("_w") * F.col("x")) / F.sum("_w")).alias("latency"))


def jump_scores(df: DataFrame) -> DataFrame:
    """|difference| of each trace over its median, for the detection of jumps and of blocked channels: (epoch_id, point, highest, lowest) over channels."""
    w = Window.partitionBy("epoch_id", "channel").orderBy("point")
    steps = df.withColumn("_d", F.abs(F.col("value") - F.lag("value").over(w))).where("_d is not null")
    middle = steps.groupBy("epoch_id", "channel").agg(M.group_quantile(F.col("_d"), 0.5).alias("_m"))
    scaled = steps.join(middle, ["epoch_id", "channel"]).withColumn("_s", M.ratio(F.col("_d"), F.col("_m")))
    return scaled.groupBy("epoch_id", "point").agg(F.max("_s").alias("highest"), F.min("_s").alias("lowest"))


def _collapsed(scores: DataFrame, column: str) -> DataFrame:
    return scores.select("epoch_id", F.lit("collapsed").alias("channel"), "point", F.col(column).alias("value"))


def artifacts(df: DataFrame, jump: float = 20.0, blocked: float = 0.003, min_points: int = 3) -> tuple[DataFrame, DataFrame]:
    """Jumps (epoch_id, point) and blocked stretches (epoch_id, start, end) of a recording."""
    scores = jump_scores(df)
    jumps = scores.where(F.col("highest") >= jump).select("epoch_id", "point")
    still = scores.select("epoch_id", "point", (F.col("lowest").between(0, blocked)).alias("on"))
    return jumps, true_ranges(still, ["epoch_id"], min_points, 0.0)


def jump_peaks(df: DataFrame, jump: float = 20.0) -> DataFrame:
    """(epoch_id, point) of jumps, each once: where the largest relative difference has a maximum of ``jump`` or more."""
    return trace.extrema(_collapsed(jump_scores(df), "highest"), jump).where("code > 0").select("epoch_id", "point")


def artifact_peaks(df: DataFrame, sfreq: float, threshold: float = 4.0, stop: tuple[float, float] = (30.0, 35.0)) -> DataFrame:
    """(epoch_id, point) of phasic artefacts: maxima of ``threshold`` or more of the largest high-passed modulus over the channels, each divided by the median of its absolute differences.
    What is below the first frequency of ``stop`` goes, what is above the second stays."""
    w = Window.partitionBy("epoch_id", "channel").orderBy("point")
    steps = df.withColumn("_d", F.abs(F.col("value") - F.lag("value").over(w))).where("_d is not null")
    middle = steps.groupBy("epoch_id", "channel").agg(M.group_quantile(F.col("_d"), 0.5).alias("_m"))
    half = sfreq / 2
    passed = samples(spectral.fftfilter(traces(df), [(0.0, 0.0, stop[0] / half, stop[1] / half, 0.0)]))
    scaled = passed.join(middle, ["epoch_id", "channel"]).withColumn("value", F.abs(M.ratio(F.col("value"), F.col("_m"))))
    top = scaled.groupBy("epoch_id", "point").agg(F.max("value").alias("highest"))
    return trace.extrema(_collapsed(top, "highest"), threshold).where("code > 0").select("epoch_id", "point")


def shifted_epochs(recording: DataFrame, trials: DataFrame, before: int, after: int, baseline: bool = True) -> DataFrame:
    """Epochs around a first event of each trial, moved so that a second one stands where it stands in the geometric mean over the trials of a condition: an average then shows both in place.

    ``recording``: (recording, channel, pos, value); ``trials``: (recording, epoch_id, condition, at, second), positions of the two events. The result has before + after points and the column
    shift, the mean distance in points. Each epoch has its baseline (the points before the first event) taken out; what lies before that is 0. A trial that would lie outside
    altogether is left out. The second event must come later.
    """
    n = before + after
    apart = F.col("second") - F.col("at")
    shift = trials.groupBy("condition").agg(F.rint(F.exp(F.avg(F.log(apart)))).cast("int").alias("shift"))
    placed = trials.join(shift, "condition").withColumn("_from", (apart - F.col("shift")).cast("int")).where(F.col("_from") + n > 0)
    rows = placed.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_i", F.col("_from") + F.col("point"))
    rows = rows.withColumn("pos", F.when(F.col("_i") >= 0, F.col("at") - before + F.col("_i")))
    if baseline:
        at = placed.withColumn("pos", F.explode(F.sequence(F.col("at") - before, F.col("at") - 1)))
        means = at.join(recording, ["recording", "pos"]).groupBy("epoch_id", "channel").agg(F.avg("value").alias("_base"))
    else:
        means = placed.select("recording", "epoch_id").join(recording.select("recording", "channel").distinct(), "recording").select("epoch_id", "channel", F.lit(0.0).alias("_base"))
    wide = rows.join(means, "epoch_id").join(recording.select("recording", "channel", "pos", "value"), ["recording", "channel", "pos"], "left")
    value = F.when(F.col("_i") < 0, 0.0).otherwise(F.coalesce(F.col("value") - F.col("_base"), F.lit(0.0)))
    return wide.select("epoch_id", "condition", "channel", "point", "shift", value.alias("value"))


def z_crossings(averages: DataFrame, threshold: float, blocks: list[tuple[float, float, float, float, float]] | None = ((0.5, 0.55, 1.0, 1.0, 0.0),), raw: bool = False) -> DataFrame:
    """Where z-scores of averages (epoch_id, channel, point, x, t, n: t over the root of n epochs) cross a threshold after the trigger. They are low-passed first (``blocks``, as ``fftfilter`` takes them; None: not)."""
    held = averages.select("epoch_id", "channel", "point", F.col("t").alias("value"))
    smooth = samples(spectral.fftfilter(traces(held), list(blocks))) if blocks else held
    met = smooth.join(averages.select("epoch_id", "channel", "point", "x", "n"), ["epoch_id", "channel", "point"]).where("x >= 0")
    scaled = met if raw else met.withColumn("value", F.col("value") / F.sqrt("n"))
    found = trace.crossings(scaled, threshold)
    return found.join(averages.select("epoch_id", "channel", "point", "x"), ["epoch_id", "channel", "point"]).select("epoch_id", "channel", "x", "code")


def artifact_components(artifact: DataFrame, weights: DataFrame, cutoff: float) -> DataFrame:
    """(k, importance) of components (k, channel, weight) that matter for an averaged artefact (channel, point, value): the mean modulus of each one's activation over that of the strongest, ``cutoff`` or more."""
    activation = artifact.join(weights, "channel").groupBy("point", "k").agg(F.sum(F.col("value") * F.col("weight")).alias("_a"))
    mean = activation.groupBy("k").agg(F.avg(F.abs("_a")).alias("_m"))
    top = mean.agg(F.max("_m").alias("_top"))
    return mean.join(F.broadcast(top)).select("k", M.ratio(F.col("_m"), F.col("_top")).alias("importance")).where(F.col("importance") >= cutoff)  # one row


def without_components(df: DataFrame, weights: DataFrame, maps: DataFrame, components: DataFrame) -> DataFrame:
    """Every map minus what the components (k) put into it: activations by ``weights`` (k, channel, weight) times ``maps`` (k, channel, weight)."""
    gone = components.select("k")
    activation = df.join(weights.join(gone, "k", "left_semi"), "channel").groupBy("epoch_id", "point", "k").agg(F.sum(F.col("value") * F.col("weight")).alias("_a"))
    part = activation.join(maps, "k").groupBy("epoch_id", "point", "channel").agg(F.sum(F.col("_a") * F.col("weight")).alias("_p"))
    return df.join(part, ["epoch_id", "point", "channel"], "left").withColumn("value", F.col("value") - F.coalesce("_p", F.lit(0.0))).select(*df.columns)


def slow_waves(extrema: DataFrame, by: list[str]) -> DataFrame:
    """Between successive negative extrema the largest positive one, with times and amplitudes of the three. ``extrema``: (by, at, value, code)."""
    w = Window.partitionBy(*by).orderBy("at")
    told = extrema.withColumn("_g", F.sum((F.col("code") < 0).cast("int")).over(w)).where("_g > 0")
    waves = told.groupBy(*by, "_g").agg(
        F.min(F.when(F.col("code") < 0, F.col("at"))).alias("start"),
        F.max(F.when(F.col("code") < 0, F.col("value"))).alias("trough"),
        F.max_by(F.when(F.col("code") > 0, F.col("at")), F.when(F.col("code") > 0, F.col("value"))).alias("peak_at"),
        F.max(F.when(F.col("code") > 0, F.col("value"))).alias("peak"),
    )
    ends = waves.withColumn("end", F.lead("start").over(Window.partitionBy(*by).orderBy("_g")))
    return ends.where("end is not null and peak is not null").drop("_g")


def sleep_cycles(stages: DataFrame, by: str, minutes: float = 15.0) -> DataFrame:
    """Sleep cycles of a night: one ends where REM (stage 5) is followed by so many minutes without it. Onset is the first stage of 2 or deeper; waking with lights on (stage -1) starts anew.
    ``stages``: (by, at in minutes, stage). One night is a few hundred rows and is walked in order."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", kind="stable").reset_index(drop=True)
        cycle, onset, last_rem, out = 0, False, None, []
        for at, stage in zip(pdf["at"], pdf["stage"], strict=True):
            if stage == -1:
                onset, last_rem = False, None
            elif not onset and stage >= 2:
                onset, cycle = True, cycle + 1
            elif onset and last_rem is not None and stage != 5 and at - last_rem >= minutes:
                cycle, last_rem = cycle + 1, None
            if onset and stage == 5:
                last_rem = at
            out.append(cycle if onset else 0)
        return pdf.assign(cycle=out)

    return stages.groupBy(by).applyInPandas(walk, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in stages.schema] + ["cycle long"]))
