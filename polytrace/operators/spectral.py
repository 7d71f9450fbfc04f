"""Numeric kernels on whole traces or whole epochs: spectra, filters, decompositions.

A kernel takes the array form (one row per trace, ``values``; see ``epochs.traces``) and runs in numpy on Arrow batches,
so consecutive kernels need no regrouping. Kernels over several channels take one epoch at a time. An epoch is the unit that must fit into memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..epochs import axes


def map_traces(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], columns: tuple[str, ...] = ("values",)) -> DataFrame:
    """A kernel on each trace. It returns one array for ``values``, or a tuple of arrays for several ``columns``."""
    rest = [c for c in df.columns if c != "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [kernel(np.array(v, np.float64)) for v in b.column("values").to_pylist()]
            made = [m if isinstance(m, tuple) else (m,) for m in made]
            arrays = [pa.array([m[k] for m in made], pa.list_(pa.float64())) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *arrays], names=[*rest, *columns])

    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns])
    return df.mapInArrow(run, schema)


def map_pairs(df: DataFrame, other: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel on each trace and the array in another column, which goes."""
    rest = [c for c in df.columns if c not in ("values", other)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [kernel(np.array(v, np.float64), np.array(t, np.float64)) for v, t in zip(b.column("values").to_pylist(), b.column(other).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(made, pa.list_(pa.float64()))], names=[*rest, "values"])

    return df.mapInArrow(run, T.StructType([df.schema[c] for c in rest] + [T.StructField("values", T.ArrayType(T.DoubleType()))]))


def map_epochs(df: DataFrame, kernel: Callable[[np.ndarray, list[str]], list[tuple[str, np.ndarray]]] | None = None, by: str = "epoch_id", together: Callable | None = None) -> DataFrame:
    """A kernel on each epoch: channels x points and their names in; (name, values) of new channels out. ``together`` in its place takes and returns lists, for the epochs of a batch."""
    order = "channel_idx" if "channel_idx" in df.columns else "channel"
    schema = T.StructType([df.schema[by], T.StructField("channel_idx", T.IntegerType()), T.StructField("channel", T.StringType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    # epochs are small, so many of them travel in one batch
    held = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "channel", "values"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, numbers, names, values = [], [], [], []
            held = b.column("rows").to_pylist()
            each = ((np.array([r["values"] for r in rows], np.float64), [r["channel"] for r in rows]) for rows in held)
            for k, made in enumerate(together(*map(list, zip(*each, strict=True))) if together and held else (kernel(*e) for e in each)):
                index += [k] * len(made)
                numbers += range(len(made))
                names += [n for n, _ in made]
                values += [v for _, v in made]
            columns = [b.column(by).take(pa.array(index, pa.int64())), pa.array(numbers, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "channel_idx", "channel", "values"])

    return held.mapInArrow(run, schema)


# ------------------------------------------------------------------ Fourier kernels


def next_power(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def looped(x: np.ndarray) -> np.ndarray:
    """The trace lengthened to a power of two by a line from its last value back to its first."""
    size = next_power(len(x))
    gap = size - len(x)
    return np.concatenate([x, x[-1] + (x[0] - x[-1]) * np.arange(1, gap + 1) / (gap + 1)]) if gap else x


def welch_window(n: int) -> np.ndarray:
    """A parabola that is 1 in the middle."""
    middle = (n + 1) / 2
    return 1 - ((np.arange(1, n + 1) - middle) / middle) ** 2


def straightened(x: np.ndarray) -> np.ndarray:
    """Without its regression line."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    below = (t * t).sum()
    return x - x.mean() - (t * ((x * t).sum() / below) if below else 0)


def spectrum_shape(window: int, pad: int = 0, overlaps: int = 1, shifts: int = 1) -> tuple[int, int, int]:
    """(frequencies, overlap count, window) as they will be used: frequencies are a power of two; without shifts as many
    segments overlap as the window has room for."""
    pad = max(pad, window)
    per = 2 * overlaps + 1
    freqs = 1 << max(0, (pad // per).bit_length() - 1)
    if shifts <= 1:
        overlaps = max(1, (pad // freqs - 1) // 2)
        per = 2 * overlaps + 1
    window = min(window, freqs * per)
    return freqs, overlaps, window - window % per


def segments(x: np.ndarray, freqs: int, overlaps: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Complex spectra of 2 * overlaps segments, each overlapping the next by half, straightened and windowed; and the window."""
    size = 2 * (window // (2 * overlaps + 1))
    w = welch_window(size)
    parts = [straightened(x[k * (size // 2) : k * (size // 2) + size]) * w for k in range(2 * overlaps)]
    return np.fft.rfft(np.array(parts), 2 * freqs, axis=1), w


def power(x: np.ndarray, freqs: int, overlaps: int, window: int) -> np.ndarray:
    """Mean power of the segments at freqs frequencies from 0."""
    spectra, w = segments(x, freqs, overlaps, window)
    p = (np.abs(spectra[:, :freqs]) ** 2).sum(axis=0)
    p[1:] *= 2
    return p / (overlaps * (w * w).sum() * 4 * freqs)


def fftspect(df: DataFrame, window: int, pad: int = 0, overlaps: int = 1, shifts: int = 1) -> DataFrame:
    """Power spectra of traces; with ``shifts`` windows a spectrogram: one row for each trace and shift. Point k is the frequency k * sfreq / (2 freqs). Window 0 takes whole traces."""
    if not window:
        if shifts > 1:
            raise ValueError("a spectrogram needs a window")
        return map_traces(df, lambda x: power(x, *spectrum_shape(len(x), pad, overlaps, shifts)))
    freqs, over, size = spectrum_shape(window, pad, overlaps, shifts)
    if shifts <= 1:
        return map_traces(df, lambda x: power(x, freqs, over, size))
    made = map_traces(df, lambda x: np.concatenate([power(x[s * ((len(x) - size) // (shifts - 1)) :], freqs, over, size) for s in range(shifts)]))
    rows = F.transform(F.sequence(F.lit(0), F.lit(shifts - 1)), lambda s: F.slice("values", s * freqs + 1, F.lit(freqs)))
    rest = [c for c in made.columns if c != "values"]
    return made.select(*rest, F.posexplode(rows).alias("shift", "values"))


def cross_spectra(df: DataFrame, reference: str, mode: str = "coherence", window: int = 0, overlaps: int = 1) -> DataFrame:
    """Complex spectra of an epoch's channels against one reference, or against each with ``ALL`` (column reference): ``cross`` the mean of X conj(R),
    ``phase`` that of X with the phase of R taken out, ``coherence`` that of the normalised product over the segments. Columns re and im hold freqs + 1 bins."""
    schema = T.StructType([df.schema["epoch_id"], T.StructField("reference", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("re", T.ArrayType(T.DoubleType())), T.StructField("im", T.ArrayType(T.DoubleType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel", kind="stable")
        x = np.array(pdf["values"].tolist(), np.float64)
        freqs, over, size = spectrum_shape(window or x.shape[1], 0, overlaps)
        s = np.array([segments(row, freqs, over, size)[0] for row in x])
        names, out = pdf["channel"].tolist(), []
        for r in range(len(names)) if reference == "ALL" else [names.index(reference)]:
            for c, name in enumerate(names):
                product = s[c] * np.conj(s[r])
                if mode == "cross":
                    z = product.mean(axis=0)
                elif mode == "phase":
                    z = (product / np.maximum(np.abs(s[r]), 1e-300)).mean(axis=0)
                else:
                    z = product.sum(axis=0) / np.maximum(np.sqrt((np.abs(s[c]) ** 2).sum(axis=0) * (np.abs(s[r]) ** 2).sum(axis=0)), 1e-300)
                out.append((pdf["epoch_id"].iloc[0], names[r], name, z.real.tolist(), z.imag.tolist()))
        return pd.DataFrame(out, columns=[f.name for f in schema])

    return df.groupBy("epoch_id").applyInPandas(run, schema)


def filter_gains(bins: int, blocks: list[tuple[float, float, float, float, float]]) -> np.ndarray:
    """Gain of each frequency from 0 to half the sampling rate (as 0 to 1): each block (start, full, full end, end, factor) goes from 1 to its factor and back along a trapezoid; blocks multiply."""
    r, gain = np.arange(bins) / (bins - 1), np.ones(bins)
    for start, full, full_end, end, factor in blocks:
        up = np.where(r < full, (r - start) / max(full - start, 1e-300), 1.0)
        depth = np.where(r > full_end, 1 - (r - full_end) / max(end - full_end, 1e-300), up)
        gain *= np.where((r < start) | (r > end), 1.0, 1 + (factor - 1) * depth)
    return gain


def filtered(x: np.ndarray, blocks: list[tuple[float, float, float, float, float]]) -> np.ndarray:
    long = looped(x)
    z = np.fft.rfft(long)
    return np.fft.irfft(z * filter_gains(len(z), blocks), len(long))[: len(x)]


def fftfilter(df: DataFrame, blocks: list[tuple[float, float, float, float, float]]) -> DataFrame:
    """Traces filtered in the frequency domain."""
    return map_traces(df, lambda x: filtered(x, blocks))


def raw_fft(df: DataFrame) -> DataFrame:
    """Complex spectra of traces (columns re and im, N/2 + 1 bins), scaled by 2 / N."""

    def kernel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = looped(x)
        z = np.fft.rfft(long) * 2 / len(long)
        return z.real, z.imag

    return map_traces(df, kernel, ("re", "im"))


def raw_ifft(df: DataFrame) -> DataFrame:
    """Traces from re and im; there must be a power of two and one bins."""
    pair = df.withColumn("values", F.concat("re", "im")).drop("re", "im")

    def kernel(x: np.ndarray) -> np.ndarray:
        n = len(x) // 2
        if (n - 1) & (n - 2) or n < 2:
            raise ValueError("an inverse transform needs a power of two and one bins")
        return np.fft.irfft(x[:n] + 1j * x[n:], 2 * (n - 1)) * (n - 1)

    return map_traces(pair, kernel)


# ------------------------------------------------------------------ linear algebra


def signed(u: np.ndarray) -> np.ndarray:
    """+1 or -1 for each row so that its largest element becomes positive: fixes what a decomposition leaves open."""
    top = u[np.arange(len(u)), np.abs(u).argmax(axis=1)]
    return np.where(top < 0, -1.0, 1.0)


def svdecomp(df: DataFrame, n: int, maps: bool = False) -> DataFrame:
    """The n strongest components across an epoch's channels: each a map times its time course, as channels ``name/k``; or with ``maps`` the maps alone (point = channel)."""

    def kernel(x: np.ndarray, names: list[str]) -> list[tuple[str, np.ndarray]]:
        u, w, v = np.linalg.svd(x, full_matrices=False)
        sign = signed(u.T)
        if maps:
            return [(f"component{k + 1}", u[:, k] * sign[k]) for k in range(min(n, len(w)))]
        return [(f"{name}/{k + 1}", u[c, k] * w[k] * v[k]) for c, name in enumerate(names) for k in range(min(n, len(w)))]

    return map_epochs(df, kernel)


#: Values of the epochs that are decomposed together at most, so that they stay near the processor.
TOGETHER = 1 << 15


def infomax(x: np.ndarray, n: int, steps: int = 2000, rate: float = 0.1, seed: int | None = None, every: int = 1, least: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Independent components of channels x points by the extended infomax rule after whitening to n dimensions: (maps as columns, activations).

    It starts from the whitened axes, or from a rotation drawn by ``seed``; the kind of each component is looked at every so many steps, and it ends when a step changes the weights by
    less than ``least`` of their size, or after ``steps``."""
    return infomax_of([x], n, steps, rate, seed, every, least)[0]


def infomax_of(xs: list[np.ndarray], n: int, steps: int = 2000, rate: float = 0.1, seed: int | None = None, every: int = 1, least: float = 1e-6) -> list[tuple[np.ndarray, np.ndarray]]:
    """``infomax`` of several epochs of one shape. They take their steps together, for a step of one is too short to be worth its calls; each ends by itself."""
    bases, scales, whites = [], [], []
    for x in xs:
        centred = x - x.mean(axis=1, keepdims=True)
        values, vectors = np.linalg.eigh(centred @ centred.T / x.shape[1])
        order = np.argsort(-values)[:n]
        bases.append(vectors[:, order])
        scales.append(np.sqrt(np.maximum(values[order], 1e-300)))
        whites.append((bases[-1] / scales[-1]).T @ centred)
    start = np.eye(n) if seed is None else np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
    m, unit, ended = xs[0].shape[1], np.eye(n), np.repeat(start[None], len(xs), axis=0)
    w, white, left, on = ended.copy(), np.array(whites), np.arange(len(xs)), np.ones(len(xs), bool)
    k = np.ones((len(xs), n))
    for step in range(steps):
        u = w @ white
        if step % every == 0:
            square = u * u
            kurtosis = (square * square).mean(axis=2) - 3 * square.mean(axis=2) ** 2
            k = np.where(kurtosis >= 0, 1.0, -1.0)
        turned = u.swapaxes(1, 2)
        change = rate * (unit - k[:, :, None] * (np.tanh(u) @ turned) / m - u @ turned / m) @ w
        w = w + change
        done = on & (np.sqrt((change * change).sum(axis=(1, 2))) < least * np.sqrt((w * w).sum(axis=(1, 2))))
        if done.any():
            ended[left[done]] = w[done]
            on &= ~done
            if not on.any():
                break
            if 4 * on.sum() <= 3 * len(on):  # those that have ended are taken along until they are a quarter
                w, white, left, k, on = w[on], white[on], left[on], k[on], on[on]
    ended[left[on]] = w[on]
    out = []
    for basis, scale, w, white in zip(bases, scales, ended, whites, strict=True):
        maps = (basis * scale) @ np.linalg.inv(w)
        size = np.linalg.norm(maps, axis=0)
        order = np.argsort(-size)
        sign = signed(maps.T[order])
        out.append((maps[:, order] * sign, (w @ white)[order] * sign[:, None]))
    return out


def icadecomp(df: DataFrame, n: int, steps: int = 2000, seed: int | None = None, rate: float = 0.1, every: int = 1) -> DataFrame:
    """Maps of independent components, largest first: channels ``component k`` whose points are the epoch's channels. Options as of ``infomax``."""

    def together(xs: list[np.ndarray], names: list[list[str]]) -> list[list[tuple[str, np.ndarray]]]:
        out: list[list[tuple[str, np.ndarray]]] = [[] for _ in xs]
        alike: dict[tuple[int, ...], list[int]] = {}
        for i, x in enumerate(xs):
            alike.setdefault(x.shape, []).append(i)
        for shape, at in alike.items():
            size = max(1, TOGETHER // max(1, shape[0] * shape[1]))
            for a in range(0, len(at), size):
                own = at[a : a + size]
                for i, (maps, _) in zip(own, infomax_of([xs[j] for j in own], min(n, shape[0]), steps, rate, seed, every), strict=True):
                    out[i] = [(f"component{k + 1}", v) for k, v in enumerate(maps.T)]
        return out

    return map_epochs(df, together=together)


def orthogonal(rows: np.ndarray) -> np.ndarray:
    """Each row without its parts along those before it; lengths are not changed to 1."""
    out: list[np.ndarray] = []
    for r in rows:
        for q in out:
            size = q @ q
            if size > 0:
                r = r - q * (q @ r) / size
        out.append(r)
    return np.array(out)


def orthogonalize(df: DataFrame, maps: bool = False) -> DataFrame:
    """Traces (or maps) made orthogonal in their order."""
    return map_epochs(df, lambda x, names: list(zip(names, orthogonal(x.T).T if maps else orthogonal(x), strict=True)))


def invert(df: DataFrame) -> DataFrame:
    """The pseudoinverse of each epoch as a matrix of channels x points; new channels are named by number."""
    return map_epochs(df, lambda x, names: [(str(k + 1), row) for k, row in enumerate(np.linalg.pinv(x))])


def laplacian_matrix(positions: np.ndarray, neighbours: int = 8) -> np.ndarray:
    """The surface Laplacian as a fixed linear map across channels: at each sensor a quadratic surface is fitted to its nearest neighbours in the plane
    tangent to the sphere of sensors, and the second derivatives are added."""
    n = len(positions)
    centre = positions.mean(axis=0)
    out = np.zeros((n, n))
    for k in range(n):
        near = np.argsort(((positions - positions[k]) ** 2).sum(axis=1), kind="stable")[: neighbours + 1]
        normal = positions[k] - centre
        normal = normal / max(np.linalg.norm(normal), 1e-12)
        base = np.linalg.svd(np.eye(3) - np.outer(normal, normal))[0][:, :2]
        p = (positions[near] - positions[k]) @ base
        design = np.stack([p[:, 0], p[:, 1], p[:, 0] ** 2 / 2, p[:, 1] ** 2 / 2, p[:, 0] * p[:, 1]], axis=1)[1:]
        fit = np.linalg.pinv(design)
        rows = fit[2] + fit[3]
        out[k, near[1:]] += rows
        out[k, k] -= rows.sum()
    return out


def laplacian(df: DataFrame, matrix: np.ndarray, names: list[str]) -> DataFrame:
    """Samples mapped across channels by a matrix (rows: new, columns: old), as a join with its few entries. Whole maps are dealt out before they are summed, so that a task's groups
    are those of its share of the samples and not of all that one file holds."""
    entries = [(names[j], names[i], float(matrix[i, j])) for i in range(len(names)) for j in range(len(names)) if matrix[i, j]]
    m = df.sparkSession.createDataFrame(entries, "channel string, _to string, _w double")
    met = df.repartition(*axes(df, "channel")).join(F.broadcast(m), "channel")
    return met.groupBy(*axes(df, "channel"), F.col("_to").alias("channel")).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))


# ------------------------------------------------------------------ dipoles


def lead_field(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Potential at sensors of unit dipoles along x, y and z at one place in a homogeneous medium."""
    d = positions - at
    r = np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9)
    return d / (4 * math.pi * r**3)


def fitted_sphere(positions: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of the sphere nearest to the sensors."""
    a = np.concatenate([2 * positions, np.ones((len(positions), 1))], axis=1)
    x = np.linalg.lstsq(a, (positions**2).sum(axis=1), rcond=None)[0]
    return x[:3], float(np.sqrt(max(x[3] + x[:3] @ x[:3], 0)))


def fit_dipole(positions: np.ndarray, values: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Place, moment and share of unexplained power of the dipole that explains a map best: a coarse grid in the sphere, then ever smaller steps."""
    centre, radius = fitted_sphere(positions)

    def rest(at: np.ndarray) -> tuple[float, np.ndarray]:
        field = lead_field(positions, at)
        moment = np.linalg.lstsq(field, values, rcond=None)[0]
        return float(((values - field @ moment) ** 2).sum()), moment

    axis = np.linspace(-0.8, 0.8, 9) * radius
    grid = [centre + np.array([a, b, c]) for a in axis for b in axis for c in axis if a * a + b * b + c * c <= (0.85 * radius) ** 2]
    best = min(grid, key=lambda g: rest(g)[0])
    step = 0.1 * radius
    for _ in range(rounds):
        moves = [best + step * d * s for d in np.eye(3) for s in (-1, 1)]
        moves = [m for m in moves if np.linalg.norm(m - centre) <= 0.98 * radius]
        new = min(moves, key=lambda g: rest(g)[0], default=best)
        if rest(new)[0] < rest(best)[0]:
            best = new
        else:
            step /= 2
    error, moment = rest(best)
    return best, moment, error / max(float((values**2).sum()), 1e-300)


def dip_fit(df: DataFrame, point: int, positions: dict[str, tuple[float, float, float]]) -> DataFrame:
    """For each epoch the best dipole at one point: (epoch_id, x, y, z, mx, my, mz, residual)."""
    schema = T.StructType([df.schema["epoch_id"], *(T.StructField(c, T.DoubleType()) for c in ("x", "y", "z", "mx", "my", "mz", "residual"))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["channel"].isin(positions)]
        at, moment, rest = fit_dipole(np.array([positions[c] for c in pdf["channel"]]), pdf["value"].to_numpy(float))
        return pd.DataFrame([[pdf["epoch_id"].iloc[0], *at, *moment, rest]], columns=[f.name for f in schema])

    return df.where(F.col("point") == point).groupBy("epoch_id").applyInPandas(run, schema)
