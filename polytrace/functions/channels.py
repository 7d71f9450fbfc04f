"""The channel-selection language: ``A2-A5,EMG``, ``ALL``, ``?`` to pass over unknown names, ``!`` to invert."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = re.compile(r"^(.*?)(\d+)-(.*?)(\d+)$")


def names(spec: str) -> list[str]:
    """The names a list spells out; a range keeps the zeros its first number leads with."""
    out = []
    for part in (p.strip() for p in spec.split(",")):
        m = _RANGE.match(part)
        if m and m[1] == m[3]:
            first, last = int(m[2]), int(m[4])
            step = 1 if last >= first else -1
            out += [f"{m[1]}{k:0{len(m[2])}d}" for k in range(first, last + step, step)]
        elif part:
            out.append(part)
    return out


def select(spec: str, existing: list[str]) -> list[int]:
    """Positions in ``existing`` that a list selects: in the order listed, every channel of a repeated name;
    inverted lists keep the order of ``existing``. Unknown names raise KeyError unless ``?`` stands in front."""
    if spec == "ALL":
        return list(range(len(existing)))
    lenient = inverted = False
    while spec[:1] in ("?", "!"):
        lenient, inverted, spec = lenient or spec[0] == "?", inverted or spec[0] == "!", spec[1:]
    wanted = names(spec)
    unknown = [n for n in wanted if n not in existing]
    if unknown and not lenient:
        raise KeyError(f"unknown channels: {', '.join(unknown)}")
    if inverted:
        return [k for k, n in enumerate(existing) if n not in wanted]
    return [k for n in wanted for k, e in enumerate(existing) if e == n]


def selected(df: DataFrame, spec: str | list[str] | None):
    """Condition: the row's channel is selected (all, if there is no list). Works without knowing the channels, so names that don't occur select nothing."""
    if spec is None or spec == "ALL":
        return F.lit(True)
    if isinstance(spec, list):
        return F.col("channel").isin(spec) if spec else F.lit(False)
    inverted = "!" in spec[:2]
    listed = names(spec.lstrip("?!"))
    if not listed:
        return F.lit(inverted)
    inside = F.col("channel").isin(listed)
    return ~inside if inverted else inside


def known(df: DataFrame) -> list[str]:
    """The channels of a table of samples; there are few, whatever its length."""
    rows = df.groupBy("channel").agg(F.min("channel_idx" if "channel_idx" in df.columns else "channel").alias("at")).collect()
    return [r.channel for r in sorted(rows, key=lambda r: (r.at, r.channel))]
