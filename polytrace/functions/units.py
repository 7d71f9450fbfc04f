"""Durations, frequencies and number lists as scripts write them."""

from __future__ import annotations

import math
import re

#: Seconds in each unit of time.
UNITS = {"us": 1e-6, "ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0}
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?(?:Inf|NaN)"
_VALUE = re.compile(rf"\s*({_NUMBER})\s*([A-Za-z]*)\s*$", re.I)


def number(text: str) -> tuple[float, str]:
    m = _VALUE.match(str(text))
    if not m:
        raise ValueError(f"not a number: {text!r}")
    return float(m[1]), m[2]


def points(text: str | float, sfreq: float) -> int:
    """A duration in points, halves to even; a bare number counts points."""
    value, unit = number(text)
    if unit and unit not in UNITS:
        raise ValueError(f"unknown unit of time {unit!r}")
    return round(value * UNITS[unit] * sfreq) if unit else round(value)


def fraction(text: str | float, sfreq: float) -> float:
    """A frequency as a fraction of half the sampling frequency; with Hz it is absolute."""
    value, unit = number(text)
    if unit and unit.lower() != "hz":
        raise ValueError(f"unknown unit of frequency {unit!r}")
    return 2 * value / sfreq if unit else value


def real(text: str | float) -> float:
    value, unit = number(text)
    if unit:
        raise ValueError(f"a plain number is needed, not {text!r}")
    return value


def axis_unit(duration: float) -> tuple[str, float]:
    """The unit of time in which a duration has about five whole steps or more."""
    for name in ("h", "min", "s", "ms"):
        if duration / UNITS[name] >= 5 or name == "ms" and duration > 0:
            return name, UNITS[name]
    return "ms", UNITS["ms"]


def is_nan(v: float) -> bool:
    return isinstance(v, float) and math.isnan(v)
