"""The line-oriented script language: one operator a line, ``#`` comments, ``>`` for a source's own branch, ``Post:`` for what follows
the collection, ``$n`` variables, and a line that starts with ``-`` between scripts.

A line is a name, options in any order, then its positional arguments; what is left over is an error. Sources are
tables registered by the caller (``source NAME``), generated ones, or files that a reader names; scripts can't start programs.

A reader's line is its name, its options and a path, and for recordings the durations before and after a trigger: ``-t 1,2`` only these codes, ``-c`` one epoch after
another without triggers, ``-f`` the first epoch (from 1), ``-e`` how many at most, ``-o`` an offset, ``-R`` a file of triggers instead of the recording's own. It sets the sampling rate and the time
before the trigger for the lines below. Metadata of epochs travel as columns of the samples (``META``).
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..epochs import axes, pack_items, samples, traces, unpack_items
from ..functions import units
from ..operators import collect, elementwise, joins, reject, shape, spectral, trace
from ..sources import files, simulate
from .pipeline import Pipeline

#: Columns that say something of a whole epoch.
META = ("condition", "nrofaverages", "comment", "sfreq", "beforetrig", "z_value", "z_label", "x_label", "recording", "epoch_no")


@dataclass
class Options:
    """A parsed line."""

    flags: dict[str, str | bool]
    args: list[str]
    side: DataFrame | None = None

    def on(self, name: str) -> bool:
        return bool(self.flags.get(name))

    def text(self, name: str) -> str | None:
        v = self.flags.get(name)
        return v if isinstance(v, str) else None

    def whole(self, name: str) -> int | None:
        v = self.text(name)
        return None if v is None else int(v)


@dataclass
class Method:
    """Options with a value, options without, how many positional arguments, and what makes the step."""

    valued: str
    plain: str
    least: int
    most: int
    build: Callable[[Options, float, int], tuple[Callable, tuple, dict]]
    #: The last argument names a table that is joined to the epochs.
    side: bool = False


def _numbers(o: Options) -> list[float]:
    return [units.real(a) for a in o.args]


def _special(o: Options) -> str | float:
    try:
        return units.real(o.args[0])
    except ValueError:
        return o.args[0]


def _pairs(o: Options, sfreq: float) -> list[tuple[int, int]]:
    n = [units.points(a, sfreq) for a in o.args]
    if len(n) % 2:
        raise ValueError("ranges are pairs of offset and length")
    return list(zip(n[::2], n[1::2], strict=True))


def _recode(o: Options) -> list[tuple[float, ...]]:
    n = _numbers(o)
    if len(n) % 4:
        raise ValueError("recode takes blocks of four numbers")
    return [tuple(n[k : k + 4]) for k in range(0, len(n), 4)]


def _sets(o: Options) -> dict[str, str] | None:
    return {name: spec for spec, _, name in (a.rpartition(":") for a in o.args)} or None


def _how(o: Options, names: dict[str, str], otherwise: str | None) -> str | None:
    return next((v for k, v in names.items() if o.on(k)), otherwise)


def _blocks(o: Options, sfreq: float) -> list[tuple[float, ...]]:
    """Blocks of a filter: four frequencies each, before each a factor if it starts with ``x`` (else 0)."""
    out, factor, held = [], 0.0, []
    for a in o.args:
        if a.startswith("x"):
            factor = units.real(a[1:])
        else:
            held.append(units.fraction(a, sfreq))
        if len(held) == 4:
            out.append((*held, factor))
            factor, held = 0.0, []
    if held:
        raise ValueError("fftfilter takes blocks of four frequencies")
    return out


def _kept(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A step whose result gets the epochs' metadata back where it loses them."""

    def run(df: DataFrame) -> DataFrame:
        out = f(df)
        lost = [c for c in META if c in df.columns and c not in out.columns]
        return out.join(df.select("epoch_id", *lost).distinct(), "epoch_id") if lost and "epoch_id" in out.columns else out

    return run


def _kernel(f: Callable, *args, **options) -> tuple[Callable, tuple, dict]:
    """A step that packs traces, applies a kernel and unpacks them again."""
    return _kept(lambda df: samples(f(traces(df), *args, **options))), (), {}


def _items(f: Callable, *args, **options) -> tuple[Callable, tuple, dict]:
    """A step on tuples: items are packed into arrays and unpacked again."""

    def run(df: DataFrame) -> DataFrame:
        held = df if "item" in df.columns else df.withColumn("item", F.lit(0))
        return unpack_items(f(pack_items(held), *args, **options))

    return _kept(run), (), {}


def _set(o: Options, sfreq: float) -> tuple[Callable, tuple, dict]:
    """set NAME VALUE: a metadata column."""
    name, value = o.args
    if name not in META and name not in shape.QUERY:
        raise ValueError(f"set: unknown variable {name!r}")
    try:
        literal: str | float | int = int(value) if re.fullmatch(r"[-+]?\d+", value) else units.real(value)
    except ValueError:
        literal = value
    return shape.set_values, (), {name: literal}


def _comment(o: Options) -> tuple[Callable, tuple, dict]:
    mode = {"-a": "append", "-p": "prepend"}.get(o.text("m") or "", "append" if o.on("a") else "prepend" if o.on("p") else "set")
    text = " ".join(o.args)
    return (lambda df: shape.set_comment(df if "comment" in df.columns else df.withColumn("comment", F.lit("")), text, mode)), (), {}


def _asserted(o: Options) -> tuple[Callable, tuple, dict]:
    """assert NAME COMPARISON VALUE: epochs whose metadata compare so."""
    name, op, value = o.args
    try:
        literal: str | float = units.real(value)
    except ValueError:
        literal = value
    return (lambda df: reject.assert_epochs(df, name, op, literal, o.on("E"), o.on("S"))), (), {}


def _positions(o: Options) -> tuple[Callable, tuple, dict]:
    """set_channelposition =LAYOUT, or names with three numbers each; -s names the first channels so."""
    if o.args[0].startswith("="):
        layout = o.args[0][1:]
        return (lambda df: _placed(df, layout)), (), {}
    if len(o.args) % 4:
        raise ValueError("set_channelposition takes a name and three numbers for each channel")
    places = {o.args[k]: tuple(map(units.real, o.args[k + 1 : k + 4])) for k in range(0, len(o.args), 4)}
    return (lambda df: _placed(shape.rename_channels(df, list(places)) if o.on("s") else df, places)), (), {}


def _placed(df: DataFrame, positions: str | dict[str, tuple[float, ...]]) -> DataFrame:
    """Samples with the places of their channels."""
    channels = df.select("epoch_id", "channel_idx", "channel").distinct()
    if positions == "grid":
        side = F.greatest(F.lit(1), F.round(F.sqrt(F.max("channel_idx") + 1)).cast("int"))
        size = channels.groupBy("epoch_id").agg(side.alias("_side"))
        placed = channels.join(size, "epoch_id").withColumns({"px": (F.col("channel_idx") % F.col("_side")).cast("double"), "py": -F.floor(F.col("channel_idx") / F.col("_side")).cast("double"), "pz": F.lit(0.0)}).drop("_side")
    else:
        placed = shape.set_channel_positions(channels, positions)
    return df.drop("px", "py", "pz").join(placed.drop("channel"), ["epoch_id", "channel_idx"])


def _boxed(df: DataFrame) -> DataFrame:
    channels = shape.normalize_channels(df.select("epoch_id", "channel_idx", "px", "py", "pz").distinct())
    return df.drop("px", "py", "pz").join(channels, ["epoch_id", "channel_idx"])


def _trim(o: Options, sfreq: float) -> tuple[Callable, tuple, dict]:
    how, q = ("quantile" if o.text("q") else _how(o, _AGG, None)), (float(o.text("q")) / 100 if o.text("q") else 0.5)
    if o.on("x"):
        n = _numbers(o)
        return _kept(lambda df: shape.trim_x(df, list(zip(n[::2], n[1::2], strict=True)), how, q)), (), {}
    pairs = _pairs(o, sfreq)
    return _kept(lambda df: shape.trim(df, pairs, how, q)), (), {}


def _vectors(o: Options, axis: str) -> DataFrame:
    """The side table of a projection: (k, axis, weight), or samples of which each epoch's first point (or, for time courses, channel) is a vector."""
    side = o.side
    if "weight" in side.columns:
        return side
    held = side.where(F.col("point") == (int(o.args[1]) if len(o.args) > 2 else 0)) if axis == "channel" else side.where(F.col("channel_idx") == 0)
    return held.select((F.col("epoch_id") - o.whole("f") + 1 if o.text("f") else F.col("epoch_id")).alias("k"), axis, F.col("value").alias("weight"))


def _projected(o: Options, axis: str) -> tuple[Callable, tuple, dict]:
    vectors, ready = _vectors(o, axis), {"unit": not o.on("n"), "centred": o.on("c"), "orthogonal": o.on("o")}
    if o.on("m"):
        return _kept(lambda df: joins.multiplied(df, vectors, axis, **ready)), (), {}
    if o.on("s") or o.on("S"):
        only = None
        if o.text("N"):
            from ..functions.channels import selected

            only = selected(vectors, o.text("N"))
        made = joins.prepared(vectors, axis, only=only, zero_others=o.on("z"), **ready).drop("_on")
        return _kept(lambda df: joins.subspace(df, made, axis, remove=o.on("S"))), (), {}
    if axis == "channel":
        return _kept(lambda df: joins.project(df, vectors, only=o.text("N"), into="channel" if o.on("C") else "item", **ready)), (), {}
    return _kept(lambda df: joins.correlate(df, vectors, **ready).withColumn("point", F.lit(0)).withColumnRenamed("k", "item")), (), {}


def _crossings(o: Options, sfreq: float) -> tuple[Callable, tuple, dict]:
    def run(df: DataFrame) -> DataFrame:
        found = (trace.extrema if o.on("E") else trace.crossings)(df, units.real(o.args[1]), o.args[0], o.on("e"))
        if o.text("R"):
            found = trace.refractory(found, units.points(o.text("R"), sfreq))
        if o.on("x"):
            found = found.join(df.select("epoch_id", "point", "x").distinct(), ["epoch_id", "point"])
        return found.withColumn("point", F.col("point") + units.points(o.text("o"), sfreq)) if o.text("o") else found

    return run, (), {}


def _asked(o: Options) -> tuple[Callable, tuple, dict]:
    """query NAME: one row for each epoch."""
    name = o.args[0]
    if name == "accepted_epochs":
        return (lambda df: reject.counters(df.select("epoch_id").distinct(), F.lit(True)).select("epoch_id", name)), (), {}
    if name == "n_points":
        return (lambda df: df.groupBy("epoch_id").agg((F.max("point") + 1).alias(name))), (), {}
    return (lambda df: shape.query(df.select("epoch_id", name).distinct(), name)), (), {}


def _imported(o: Options) -> tuple[Callable, tuple, dict]:
    return (lambda df: shape.import_point(df, int(o.args[0]), o.side.select("channel", "value"))), (), {}


_MANY = 10_000
_AGG = {"s": "sum", "h": "max", "l": "min", "a": "mean", "M": "quantile"}
METHODS: dict[str, Method] = {
    "calc": Method("n i", "", 1, 1, lambda o, f, b: (elementwise.calc, (o.args[0],), {"channels": o.text("n"), "item": o.whole("i")})),
    "add": Method("n i", "", 1, 2, lambda o, f, b: (elementwise.add, (_special(o),), {"channels": o.text("n"), "item": o.whole("i")})),
    "scale_by": Method("n i", "", 1, 2, lambda o, f, b: (elementwise.scale_by, (_special(o),), {"channels": o.text("n"), "item": o.whole("i"), "sfreq": f})),
    "recode": Method("n i", "", 4, _MANY, lambda o, f, b: (elementwise.recode, (_recode(o),), {"channels": o.text("n"), "item": o.whole("i")})),
    "baseline_subtract": Method("", "", 0, 0, lambda o, f, b: (elementwise.baseline_subtract, (b,), {})),
    "baseline_divide": Method("", "", 0, 0, lambda o, f, b: (elementwise.baseline_divide, (b,), {})),
    "demean_maps": Method("", "", 0, 0, lambda o, f, b: (elementwise.demean_maps, (), {})),
    "rereference": Method("e", "E", 1, 1, lambda o, f, b: (elementwise.rereference, (o.args[0],), {"exclude": o.text("e") or (o.args[0] if o.on("E") else None)})),
    "differentiate": Method("n i", "e", 0, 0, lambda o, f, b: (trace.differentiate, (), {"epochwise": o.on("e"), "channels": o.text("n"), "item": o.whole("i")})),
    "integrate": Method("n i", "e", 0, 0, lambda o, f, b: (trace.integrate, (), {"epochwise": o.on("e"), "channels": o.text("n"), "item": o.whole("i")})),
    "sliding_average": Method("q", "M", 2, 2, lambda o, f, b: (trace.sliding_average, (units.points(o.args[0], f), float(o.args[1]) if re.fullmatch(r"[\d.]+", o.args[1]) else units.points(o.args[1], f)), {"q": 0.5 if o.on("M") else float(o.text("q")) / 100 if o.text("q") else None})),
    "detrend": Method("o n i", "0 I", 0, _MANY, lambda o, f, b: (trace.detrend, (_how(o, {"0": "mean", "I": "ends", "o": "at"}, "line"),), {"omit": [(a, a + n - 1) for a, n in _pairs(o, f)], "at": units.points(o.text("o"), f) if o.text("o") else None})),
    "remove_channel": Method("n k", "", 0, _MANY, lambda o, f, b: (shape.keep_channels, (o.text("k"),), {}) if o.text("k") else (shape.remove_channels, (o.text("n"),), {}) if o.text("n") else (shape.remove_channel_ranges, (list(zip(map(int, o.args[::2]), map(int, o.args[1::2]), strict=True)),), {})),
    "collapse_channels": Method("", "a s h l", 0, _MANY, lambda o, f, b: (_kept(lambda df: shape.collapse_channels(df, _sets(o), _how(o, _AGG, "mean"))), (), {})),
    "trim": Method("q", "a s M h l x", 2, _MANY, lambda o, f, b: _trim(o, f)),
    "change_axes": Method("", "", 2, 6, lambda o, f, b: (shape.change_axes, (units.real(o.args[0]), units.real(o.args[1])), ({"x_label": o.args[2]} if len(o.args) > 2 else {}) | ({"z_offset": units.real(o.args[3]), "z_factor": units.real(o.args[4])} if len(o.args) > 4 else {}) | ({"z_label": o.args[5]} if len(o.args) > 5 else {}))),
    "add_zerochannel": Method("", "", 1, 4, lambda o, f, b: (shape.add_zero_channel, (o.args[0],), {})),
    "reject_bandwidth": Method("i", "m C I", 1, 1, lambda o, f, b: (reject.reject_bandwidth, (units.real(o.args[0]),), {"peak_only": o.on("m"), "channels_only": o.on("C"), "invert": o.on("I")})),
    "fftfilter": Method("", "", 4, _MANY, lambda o, f, b: _kernel(spectral.fftfilter, _blocks(o, f))),
    "fftspect": Method("p", "", 3, 3, lambda o, f, b: _kernel(spectral.fftspect, units.points(o.args[0], f), units.points(o.text("p"), f) if o.text("p") else 0, int(o.args[2]), int(o.args[1]))),
    "svdecomp": Method("", "m", 1, 1, lambda o, f, b: _kernel(spectral.svdecomp, int(o.args[0]), maps=o.on("m"))),
    "orthogonalize": Method("", "m", 0, 0, lambda o, f, b: _kernel(spectral.orthogonalize, maps=o.on("m"))),
    "invert": Method("", "", 0, 0, lambda o, f, b: _kernel(spectral.invert)),
    "subtract": Method("", "C P a s m d mean", 1, 1, lambda o, f, b: (joins.subtract, (o.side, _how(o, {"a": "add", "mean": "mean", "m": "multiply", "d": "divide"}, "subtract"), o.on("C"), o.on("P")), {}), side=True),
    "add_channels": Method("", "c p i", 1, 1, lambda o, f, b: (joins.add_channels, (o.side, "point" if o.on("p") else "item" if o.on("i") else "channel"), {}), side=True),
    "assert": Method("", "E S", 3, 3, lambda o, f, b: _asserted(o)),
    "set": Method("", "", 2, 2, lambda o, f, b: _set(o, f)),
    "set_comment": Method("m", "a p", 1, _MANY, lambda o, f, b: _comment(o)),
    "set_channelposition": Method("", "s", 1, _MANY, lambda o, f, b: _positions(o)),
    "normalize_channelbox": Method("", "", 0, 0, lambda o, f, b: (_boxed, (), {})),
    "extract_item": Method("", "", 1, _MANY, lambda o, f, b: _items(shape.extract_items, [int(a) for a in o.args])),
    "calc_binomial_items": Method("", "", 0, 0, lambda o, f, b: _items(elementwise.binomial_items)),
    "zero_phase": Method("", "", 1, 1, lambda o, f, b: _items(elementwise.zero_phase, o.args[0])),
    "swap_fc": Method("", "", 0, 1, lambda o, f, b: (shape.swap_fc, (f, units.real(o.args[0]) if o.args else 1.0), {})),
    "swap_cf": Method("", "", 0, 0, lambda o, f, b: (shape.swap_fc_back, (f,), {})),
    "swap_ic": Method("", "", 0, 0, lambda o, f, b: (shape.swap_ic, (), {})),
    "swap_ix": Method("", "", 0, 0, lambda o, f, b: (shape.swap_ix, (), {})),
    "swap_xz": Method("", "", 0, 0, lambda o, f, b: (shape.swap_xz, (), {})),
    "push": Method("", "", 0, 0, lambda o, f, b: (shape.push, (), {})),
    "pop": Method("", "", 0, 0, lambda o, f, b: (shape.pop, (), {})),
    "link_order": Method("", "", 1, _MANY, lambda o, f, b: (shape.link_order, ([int(a) for a in o.args],), {})),
    "import_point": Method("", "", 2, 2, lambda o, f, b: _imported(o), side=True),
    "export_point": Method("", "", 1, 1, lambda o, f, b: (shape.export_point, (units.points(o.args[0], f),), {})),
    "query": Method("", "N", 1, 1, lambda o, f, b: _asked(o)),
    "convolve": Method("", "e", 2, 2, lambda o, f, b: (_kept(lambda df: trace.convolve_epochwise(df, o.side, units.points(o.args[0], f), o.on("e"))), (), {}), side=True),
    "write_crossings": Method("i R o", "E e x c", 2, 2, lambda o, f, b: _crossings(o, f)),
    "project": Method("N f e i p", "s S m c C n o x z", 1, 3, lambda o, f, b: _projected(o, "channel"), side=True),
    "correlate": Method("f e i", "s S m c n o", 1, 2, lambda o, f, b: _projected(o, "point"), side=True),
    "icadecomp": Method("e l", "", 1, 1, lambda o, f, b: _kernel(spectral.icadecomp, int(o.args[0]), rate=float(o.text("l") or 0.1), every=o.whole("e") or 1)),
    "raw_fft": Method("", "", 0, 0, lambda o, f, b: (_kept(lambda df: spectral.raw_fft(traces(df))), (), {})),
    "reject_flor": Method("", "", 0, 0, lambda o, f, b: (reject.reject_overflow, (), {})),
}
COLLECT: dict[str, Method] = {
    "average": Method("", "M s t u W", 0, 0, lambda o, f, b: (collect.average, (), {"t_test": o.on("t") and not o.on("u"), "leave_sums": o.on("t") and o.on("u"), "sums_only": o.on("u") and not o.on("t"), "weight": "nrofaverages" if o.on("W") else None, "sign_test": o.on("s"), "beforetrig": b})),
    "append": Method("", "c p i l", 0, 0, lambda o, f, b: (_how(o, {"c": collect.append_channels, "i": collect.append_items, "l": collect.append_datasets}, collect.append_points), (), {})),
    "histogram": Method("", "c p o", 3, 3, lambda o, f, b: (collect.histogram, (units.real(o.args[0]), units.real(o.args[1]), int(o.args[2])), {"by_channel": not o.on("c"), "by_point": not o.on("p"), "keep_outliers": o.on("o")})),
    "minmax": Method("", "c p", 0, 0, lambda o, f, b: (collect.minmax, (), {"by_channel": not o.on("c"), "by_point": not o.on("p")})),
    "null_sink": Method("", "", 0, 0, lambda o, f, b: (lambda df: df, (), {})),
}
#: Readers of recordings and the kind of file each reads.
READERS = {"read_synamps": "cnt", "read_rec": "edf", "read_brainvision": "brainvision", "read_sound": "wave", "read_generic": "generic", "read_tucker": "simple_binary", "read_curry": "parameter_pair", "read_freiburg": "words", "read_neurofile": "differences", "read_sigma": "fields", "read_inomed": "volts", "read_labview": "blocks"}
READ = Method("t f e o R s C", "c T", 3, 4, lambda o, f, b: None)


def read(name: str, words: list[str], spark: SparkSession, sfreq: float) -> tuple[DataFrame, float, int]:
    """What a reader's or a generator's line reads, its sampling rate, and the points before the trigger."""
    if name == "readasc":
        path = words[-1]
        df = files.read_epochs(spark, path, "*")
        rate = df.select("sfreq").first()
        return df.withColumn("epoch_id", F.col("epoch_no")).drop("epoch_no", "comment"), (rate[0] if rate and rate[0] else sfreq), 0
    if name == "dip_simulate":
        rate, n = float(words[0]), int(words[1])
        before, after = units.points(words[2], rate), units.points(words[3], rate)
        return simulate.dip_simulate(spark, rate, n, before, after), rate, before
    if name == "null_source":
        rate, n, channels = float(words[0]), int(words[1]), int(words[2])
        before, after = units.points(words[3], rate), units.points(words[4], rate)
        return simulate.null_source(spark, rate, n, channels, before, after), rate, before
    o, kind = parse_line(words, READ, name), READERS[name]
    options = {"kind": o.args[3]} if kind == "generic" and len(o.args) > 3 else {}
    options |= {"sfreq": float(o.text("s")) if o.text("s") else sfreq, "channels": o.whole("C") or 1} if kind == "generic" else {}
    path, before, after = o.args[:3]
    made = {"generic": lambda d, **k: files.formats.decode_generic(d, **(options | k))}.get(kind)
    rate = options["sfreq"] if made else files.sampling_rate(spark, path, kind)
    codes = [int(c) for c in o.text("t").split(",")] if o.text("t") else None
    df = files.read_windows(spark, path, kind, before, after, o.on("c"), codes, o.whole("f") or 1, o.whole("e"), o.text("o") or 0, o.text("R"), None, rate, **({"decoding": options} if made else {}))
    return df, rate, units.points(before, rate)


REFUSED = {"run": "scripts can't start programs", "posplot": "there is no display", "show_memuse": "Spark's own interface shows memory"}


def parse_line(words: list[str], method: Method, name: str) -> Options:
    valued, plain = method.valued.split(), method.plain.split()
    flags: dict[str, str | bool] = {}
    k = 0
    while k < len(words) and words[k].startswith("-") and not re.fullmatch(r"-[\d.]\S*|-Inf", words[k], re.I):
        key = words[k][1:]
        if key in valued:
            if k + 1 >= len(words):
                raise ValueError(f"{name}: -{key} needs a value")
            flags[key] = words[k + 1]
            k += 2
        elif key in plain:
            flags[key] = True
            k += 1
        else:
            raise ValueError(f"{name}: unknown option -{key}")
    args = words[k:]
    if not method.least <= len(args) <= method.most:
        raise ValueError(f"{name}: {len(args)} arguments, {method.least} to {method.most} expected")
    return Options(flags, args)


def split_scripts(text: str) -> list[str]:
    """Scripts between lines that start with a dash."""
    out: list[list[str]] = [[]]
    for line in text.splitlines():
        if line.startswith("-"):
            out.append([])
        else:
            out[-1].append(line)
    return ["\n".join(x) for x in out if any(y.strip() and not y.strip().startswith("#") for y in x)]


def compile_script(text: str, sources: dict[str, DataFrame], sfreq: float = 100.0, beforetrig: int = 0, variables: list[str] | None = None, spark: SparkSession | None = None) -> Pipeline:
    """A script as a pipeline. Line ``source NAME`` reads a table of ``sources``; readers and generators need ``spark``; all else is named in METHODS and COLLECT. The epochs of later sources
    follow those of earlier ones (ids 2^48 apart)."""
    pipeline, collected, post = Pipeline(), False, False
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*", "", raw).strip()
        if not line:
            continue
        if line == "Post:":
            if not collected:
                raise ValueError("Post: comes after a collection")
            post = True
            continue
        line = re.sub(r"\$(\d+)", lambda m: (variables or [])[int(m[1]) - 1], line)
        own = line.startswith(">")
        name, *words = shlex.split(line.lstrip(">! "))
        if name in REFUSED:
            raise ValueError(f"line {number}: {REFUSED[name]}")
        if name == "source":
            if collected or words[0] not in sources:
                raise ValueError(f"line {number}: no source {words[0]!r} here")
            pipeline.source(sources[words[0]])
        elif name in READERS or name in ("readasc", "dip_simulate", "null_source"):
            if collected or spark is None:
                raise ValueError(f"line {number}: a source is not possible here")
            df, sfreq, beforetrig = read(name, words, spark, sfreq)
            pipeline.source(df.withColumn("epoch_id", F.col("epoch_id") + len(pipeline.sources) * 2**48) if pipeline.sources else df)
        elif name in COLLECT:
            if collected:
                raise ValueError(f"line {number}: a script has one collection")
            collected = True
            f, args, options = COLLECT[name].build(parse_line(words, COLLECT[name], name), sfreq, beforetrig)
            pipeline.collected = (f, args, options)
        elif name in METHODS:
            if collected and not post:
                raise ValueError(f"line {number}: what follows a collection stands under Post:")
            line_options = parse_line(words, METHODS[name], name)
            if METHODS[name].side:
                if line_options.args[-1] not in sources:
                    raise ValueError(f"line {number}: no source {line_options.args[-1]!r} here")
                line_options.side = sources[line_options.args[-1]]
            f, args, options = METHODS[name].build(line_options, sfreq, beforetrig)
            (pipeline.branch if own else pipeline.then)(f, *args, **options)
        else:
            raise ValueError(f"line {number}: unknown method {name!r}")
    if not pipeline.sources:
        raise ValueError("a script starts with a source")
    if not collected:
        raise ValueError("a script ends in a collection")
    return pipeline
