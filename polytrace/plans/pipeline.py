"""A fluent chain of operators: source, transforms, rejections, one collection, and what follows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import collect, elementwise, joins, paradigm, reject, shape, spectral, trace
from ..operators import clean as corrections

#: Where a step's name is looked up, in this order.
MODULES = (elementwise, trace, shape, reject, joins, spectral, corrections, paradigm)
COLLECTS = {"average": collect.average, "append_points": collect.append_points, "append_channels": collect.append_channels, "append_items": collect.append_items, "append_datasets": collect.append_datasets, "histogram": collect.histogram, "minmax": collect.minmax}


class Pipeline:
    """Steps are recorded and only make a plan when ``frame`` is asked for; nothing runs before an action.

    Several sources are processed alike up to the collection and then united: ``branch`` steps belong to the last
    source alone, ``then`` steps to all.
    """

    def __init__(self) -> None:
        self.sources: list[tuple[DataFrame, list[tuple[Callable, tuple, dict]]]] = []
        self.steps: list[tuple[Callable, tuple, dict]] = []
        self.collected: tuple[Callable, tuple, dict] | None = None
        self.after: list[tuple[Callable, tuple, dict]] = []

    @staticmethod
    def operator(name: str | Callable) -> Callable:
        if callable(name):
            return name
        for m in MODULES:
            if callable(found := getattr(m, name, None)):
                return found
        raise KeyError(f"unknown operator {name!r}")

    def source(self, df: DataFrame) -> Pipeline:
        if self.collected:
            raise ValueError("a source comes before the collection")
        self.sources.append((df, []))
        return self

    def branch(self, name: str | Callable, *args, **options) -> Pipeline:
        if not self.sources:
            raise ValueError("a branch needs a source")
        self.sources[-1][1].append((self.operator(name), args, options))
        return self

    def then(self, name: str | Callable, *args, **options) -> Pipeline:
        (self.after if self.collected else self.steps).append((self.operator(name), args, options))
        return self

    def collect(self, name: str, *args, **options) -> Pipeline:
        if self.collected:
            raise ValueError("there is one collection")
        self.collected = (COLLECTS[name], args, options)
        return self

    def frame(self) -> DataFrame:
        if not self.sources:
            raise ValueError("a pipeline starts with a source")
        parts = []
        for df, own in self.sources:
            for f, args, options in own:
                df = f(df, *args, **options)
            parts.append(df)
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        for f, args, options in [*self.steps, *([self.collected] if self.collected else []), *self.after]:
            out = f(out, *args, **options)
        return out
