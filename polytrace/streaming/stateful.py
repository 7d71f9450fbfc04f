"""Streams: windows, sessions and running aggregates with watermarks, and operators that carry a channel's state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(df: DataFrame, ts: str, size: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Tumbling (or hopping) windows of event time: count, sum, mean and extremes; rows later than the watermark are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    v = F.col(value)
    out = df.withWatermark(ts, late).groupBy(w, *(by or [])).agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), "n", "sum", "mean", "min", "max")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Bursts: rows of a key no further apart than ``gap``."""
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def running_average(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """The average so far of each channel and point, as update output."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"), F.avg(v).alias("value"))


#: Rows that leave a task's Python at once.
ROWS = 1 << 16


def _walk(step, start: tuple):
    """A function for applyInPandasWithState: ``step(state, pos, value) -> (state, columns)`` on a channel's rows in the order of their positions. Of a batch's rows only the two numbers are held."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(b["pos"].to_numpy(copy=True), b["value"].to_numpy(copy=True)) for b in batches]
        pos, value = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        parts.clear()
        order = np.argsort(pos, kind="stable")
        pos, value = pos[order], value[order]
        now, out = step(state.get if state.exists else start, pos, value)
        state.update(now)
        for at in range(0, len(out["pos"]), ROWS):
            yield pd.DataFrame({"channel": key[0], **{c: x[at : at + ROWS] for c, x in out.items()}})

    return run


def differentiate(df: DataFrame) -> DataFrame:
    """(channel, pos, value) -> value minus the channel's one before, over all batches."""

    def step(state: tuple, pos: np.ndarray, value: np.ndarray) -> tuple[tuple, dict]:
        return (float(value[-1]),), {"pos": pos, "value": np.diff(value, prepend=state[0])}

    return df.groupBy("channel").applyInPandasWithState(_walk(step, (0.0,)), "channel string, pos long, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def integrate(df: DataFrame) -> DataFrame:
    """(channel, pos, value) -> the channel's running sum, over all batches."""

    def step(state: tuple, pos: np.ndarray, value: np.ndarray) -> tuple[tuple, dict]:
        total = pd.Series(value).cumsum().to_numpy() + state[0]
        return (float(total[-1]),), {"pos": pos, "value": total}

    return df.groupBy("channel").applyInPandasWithState(_walk(step, (0.0,)), "channel string, pos long, value double", "total double", "append", GroupStateTimeout.NoTimeout)


def crossings(df: DataFrame, threshold: float, refractory: int = 0) -> DataFrame:
    """(channel, pos, value) -> (channel, pos, code) where the sign of value - threshold changes, none within ``refractory`` positions of the last one; sign and last event are kept for each channel."""

    def step(state: tuple, pos: np.ndarray, value: np.ndarray) -> tuple[tuple, dict]:
        sign, last = state
        above = np.where(value >= threshold, 1, -1)
        before = np.concatenate([[sign or above[0]], above[:-1]])
        kept = []
        for k in np.flatnonzero(above != before).tolist():
            if last < 0 or pos[k] - last >= refractory:
                kept.append(k)
                last = int(pos[k])
        return (int(above[-1]), last), {"pos": pos[kept], "code": above[kept]}

    return df.groupBy("channel").applyInPandasWithState(_walk(step, (0, -1)), "channel string, pos long, code int", "sign int, last long", "append", GroupStateTimeout.NoTimeout)


def trigger_windows(samples: DataFrame, triggers: DataFrame, before: str, after: str, late: str = "10 minutes") -> DataFrame:
    """Samples (recording, ts, value) within ``before`` and ``after`` of triggers (recording, trigger_ts, code): an interval join with watermarks on both sides."""
    s = samples.withWatermark("ts", late)
    t = triggers.withColumnRenamed("recording", "_recording").withWatermark("trigger_ts", late)
    inside = (F.col("ts") >= F.col("trigger_ts") - F.expr(f"interval {before}")) & (F.col("ts") < F.col("trigger_ts") + F.expr(f"interval {after}"))
    return s.join(t, (F.col("recording") == F.col("_recording")) & inside).drop("_recording")
