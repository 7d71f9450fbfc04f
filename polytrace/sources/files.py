"""Files as tables: Spark lists, distributes and reads them, so any store it knows will do. Written files go out from the tasks that
make them, through the store's own file system; a task that is run again puts the same file in place.

No task holds a file whole (``pieces``): samples are packed in blocks of positions, which one task for each recording writes out one after another, and files are
read in ranges, spread over the cluster. Exceptions, which are read whole: text and points-fastest values, ``blocks``, and stores that Spark knows and Arrow doesn't.
For data that is read again, write the samples as Parquet, partitioned by recording and sorted by position: scans then skip what a query doesn't need.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import units
from ..operators import joins
from . import formats, formats_lab, formats_sleep, pieces

DECODERS: dict[str, Callable[..., formats.Recording]] = {"generic": formats.decode_generic, "edf": formats.decode_edf, "simple_binary": formats.decode_simple_binary, "wave": formats.decode_wave, "cnt": formats.decode_cnt, "fields": formats_sleep.decode_fields, "volts": formats_lab.decode_volts, "blocks": formats_lab.decode_blocks}
ENCODERS: dict[str, Callable[..., bytes]] = {"generic": formats.encode_generic, "edf": formats.encode_edf, "simple_binary": formats.encode_simple_binary, "wave": formats.encode_wave, "cnt": formats.encode_cnt, "fields": formats_sleep.encode_fields, "volts": formats_lab.encode_volts, "blocks": formats_lab.encode_blocks}
SUFFIXES = {"edf": "*.{edf,rec,bdf}", "wave": "*.wav", "simple_binary": "*.raw", "cnt": "*.cnt", "fields": "*.dat", "volts": "*.emg", "blocks": "*.lv", "generic": "*"}
#: Rows of a batch, bytes of a range that is decoded at once, points of a block that is packed, and ids of epochs that are.
_ROWS, _RANGE, _BLOCK, _EPOCHS = 1 << 16, 1 << 21, 1 << 14, 256
_SAMPLES = "recording string, sfreq double, channel_idx int, channel string, pos long, value double"
_SPANS = "recording string, beside string, data string, length long, first long, units long, sfreq double"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length): contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


def _in_ranges(spark: SparkSession, path: str) -> bool:
    """Whether Arrow opens files there too."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + "/" + path.lstrip("/")
    if path.startswith("file:"):
        return True
    try:
        return bool(fs.FileSystem.from_uri(path))
    except (OSError, ValueError):
        return False


def _batches(recording: str, r: formats.Recording, first: int, channels: list[str] | None) -> Iterator[pa.RecordBatch]:
    """Rows of a recording whose first point is at position ``first``."""
    for k, name in enumerate(r.channels):
        if channels is not None and name not in channels:
            continue
        for at in range(0, r.values.shape[1], _ROWS):
            v = r.values[k, at : at + _ROWS]
            n = len(v)
            columns = [pa.repeat(pa.scalar(recording), n), pa.array(np.full(n, r.sfreq)), pa.array(np.full(n, k, np.int32)), pa.repeat(pa.scalar(name, pa.string()), n), pa.array(np.arange(first + at, first + at + n)), pa.array(v)]
            yield pa.RecordBatch.from_arrays(columns, names=["recording", "sfreq", "channel_idx", "channel", "pos", "value"])


def _beside(path: str | None) -> bytes:
    if path is None:
        return b""
    with pieces.opened(path) as f:
        return f.read()


def _layout(kind: str, f, length: int, beside: bytes, options: dict) -> pieces.Layout | None:
    for size in (1 << 16, pieces.HEADER):
        found = pieces.layout(kind, f.read_at(min(size, length), 0), length, beside, **options)
        if found or size >= length:
            return found
    return None


def _spans(spark: SparkSession, path: str, kind: str, pattern: str | None, options: dict) -> DataFrame:
    """The ranges of all files of a kind: recording, the small file beside, the file of data, its length, the first unit and how many (-1: the file is read from its beginning on)."""
    group = _pair(kind)
    if group:
        suffixes, header, data, _ = group
        at = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
        parts = _parts(_listed(spark, path, f"*.{{{suffixes}}}"), "path", "length")
        found = parts.groupBy("recording").agg(at(BESIDE[kind], "path").alias("beside"), at(data, "path").alias("data"), at(data, "length").alias("length"), at(header, "path").alias("_head"))
        found = found.where("data is not null and _head is not null").drop("_head")
    else:
        found = _listed(spark, path, pattern or SUFFIXES[kind]).select(F.col("path").alias("recording"), F.lit(None).cast("string").alias("beside"), F.col("path").alias("data"), "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for recording, beside, data, length in zip(*(b.column(c).to_pylist() for c in ("recording", "beside", "data", "length")), strict=True):
                with pieces.opened(data) as f:
                    lay = _layout(kind, f, length, _beside(beside), options)
                if lay is None:
                    rows.append((recording, beside, data, length, 0, -1, None))
                    continue
                rate, step = lay.decode(b"").sfreq, max(1, _RANGE // lay.unit)
                rows += [(recording, beside, data, length, first, min(step, lay.units - first), rate) for first in range(0, lay.units, step)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=[c.split()[0] for c in _SPANS.split(", ")])

    return found.mapInArrow(run, _SPANS)


#: The small file beside the data, of kinds of several files.
BESIDE = {"brainvision": "vhdr", "parameter_pair": "dpa", "words": "coa", "differences": "dsc"}


def _ranges(spark: SparkSession, path: str, kind: str, channels: list[str] | None, pattern: str | None, options: dict) -> DataFrame:
    """Samples of files of a kind, read in ranges."""
    group = _pair(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, b"")
        for b in batches:
            for recording, beside, data, length, first, units in zip(*(b.column(c).to_pylist() for c in ("recording", "beside", "data", "length", "first", "units")), strict=True):
                with pieces.opened(data) as f:
                    if units >= 0:
                        if held[0] != data:
                            held = data, _layout(kind, f, length, _beside(beside), options), b""
                        lay = held[1]
                        yield from _batches(recording, lay.decode(f.read_at(units * lay.unit, lay.start + first * lay.unit)), first * lay.points, channels)
                    elif kind in ("words", "differences"):
                        at = 0
                        for r in pieces.sequential(kind, f, _beside(beside)):
                            yield from _batches(recording, r, at, channels)
                            at += r.values.shape[1]
                    else:
                        r = group[3]({group[1]: _beside(beside), group[2]: f.read()}) if group else DECODERS[kind](f.read(), **options)
                        yield from _batches(recording, r, 0, channels)

    spread = _spans(spark, path, kind, pattern, options).repartition(2 * spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, _SAMPLES).hint("shuffle_merge")  # what is known of its size is that of the list of files


def read_recordings(spark: SparkSession, path: str, kind: str, channels: list[str] | None = None, pattern: str | None = None, decoding: dict | None = None, **options) -> DataFrame:
    """(recording, sfreq, channel_idx, channel, pos, value) of all files under a path. With ``channels`` only those leave the decoder, whose own options may stand in ``decoding``."""
    options = options | (decoding or {})
    if _in_ranges(spark, path):
        return _ranges(spark, path, kind, channels, pattern, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from _batches(path, DECODERS[kind](content, **options), 0, channels)

    return _files(spark, path, pattern or SUFFIXES[kind]).mapInArrow(run, _SAMPLES).hint("shuffle_merge")


def read_triggers(spark: SparkSession, path: str, kind: str, pattern: str | None = None, /, **options) -> DataFrame:
    """(recording, position, code, description) of all files under a path."""
    if _in_ranges(spark, path):
        listed = _listed(spark, path, pattern or SUFFIXES[kind]).select(F.col("path").alias("recording"), F.lit(None).cast("string").alias("beside"), F.col("path").alias("data"), "length")
        return listed.mapInArrow(_trigger_rows(lambda beside, f, length: pieces.triggers(kind, f, length, **options)), _TRIGGERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *t) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for t in DECODERS[kind](c, **options).triggers]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["recording", "position", "code", "description"])

    return _files(spark, path, pattern or SUFFIXES[kind]).mapInArrow(run, _TRIGGERS)


_TRIGGERS = "recording string, position long, code int, description string"


def _trigger_rows(found: Callable):
    """A function for mapInArrow on (recording, beside, data, length): the triggers that ``found`` yields of the text beside and the open file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for recording, beside, data, length in zip(*(b.column(c).to_pylist() for c in ("recording", "beside", "data", "length")), strict=True):
                with pieces.opened(data) as f:
                    rows = iter(found(_beside(beside), f, length))
                    while part := list(itertools.islice(rows, _ROWS)):
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(recording), len(part)), *(pa.array([r[k] for r in part], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string())))], names=["recording", "position", "code", "description"])

    return run


def _pair(kind: str) -> tuple[str, str, str, Callable[[dict[str, bytes]], formats.Recording]] | None:
    """Of kinds that keep a recording in several files: their suffixes, header and data, and the decoder."""
    return {
        "brainvision": ("vhdr,vmrk,eeg", "vhdr", "eeg", lambda by: formats.decode_brainvision(by["vhdr"], by["eeg"], by.get("vmrk", b""))),
        "parameter_pair": ("cdt,dpa", "dpa", "cdt", lambda by: formats.decode_parameter_pair(by["dpa"], by["cdt"])),
        "words": ("co,coa", "co", "co", lambda by: formats_sleep.decode_co(by["co"], by.get("coa", b""))),
        "differences": ("dsc,eeg", "dsc", "eeg", lambda by: formats_sleep.decode_differences(by["dsc"], by["eeg"])),
    }.get(kind)


def samples_of(spark: SparkSession, path: str, kind: str, names: list[str] | None = None, pattern: str | None = None, /, **options) -> DataFrame:
    """Samples of recordings of any kind, single files or groups of files; of the channels ``names`` if given, as the decoder may have options of its own."""
    group = _pair(kind)
    if not group or _in_ranges(spark, path):
        return read_recordings(spark, path, kind, names, pattern, decoding=options)
    out = _grouped(_parts(_files(spark, path, f"*.{{{group[0]}}}"), "content"), *group[1:]).hint("shuffle_merge")
    return out if names is None else out.where(F.col("channel").isin(names))


def triggers_of(spark: SparkSession, path: str, kind: str, pattern: str | None = None, /, **options) -> DataFrame:
    """(recording, position, code, description) of recordings of any kind."""
    group = _pair(kind)
    if not group:
        return read_triggers(spark, path, kind, pattern, **options)
    suffixes, header, data, decode = group
    if _in_ranges(spark, path):
        at = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
        parts = _parts(_listed(spark, path, f"*.{{{suffixes}}}"), "path", "length").groupBy("recording")
        marks = "vmrk" if kind == "brainvision" else header  # of these kinds only one has triggers
        found = parts.agg(at(header, "path").alias("beside"), at(marks, "path").alias("data"), at(marks, "length").alias("length"), at(data, "path").alias("_data")).where("beside is not null and data is not null and _data is not null")
        return found.mapInArrow(_trigger_rows(lambda beside, f, length: decode({header: beside, data: b"", "vmrk": f.read()}).triggers if kind == "brainvision" else []), _TRIGGERS)

    def run(pdf):
        import pandas as pd

        by = dict(zip(pdf["kind"], pdf["content"], strict=True))
        found = decode(by).triggers if header in by and data in by else []
        return pd.DataFrame([(pdf["recording"].iloc[0], *t) for t in found], columns=["recording", "position", "code", "description"])

    return _parts(_files(spark, path, f"*.{{{suffixes}}}"), "content").groupBy("recording").applyInPandas(run, "recording string, position long, code int, description string")


def triggers_in(spark: SparkSession, path: str, sfreq: float, recordings: DataFrame | None = None) -> DataFrame:
    """Triggers of a text file of positions, codes and descriptions. They belong to every recording of ``recordings`` (column recording), or to none."""
    lines = b"".join(r[0] for r in _files(spark, path, "*").select("content").collect()).decode()  # one list of triggers, as one writes it
    rows = spark.createDataFrame(formats.decode_triggers(lines, sfreq), "position long, code int, description string")
    return rows if recordings is None else recordings.select("recording").distinct().join(F.broadcast(rows))


def sampling_rate(spark: SparkSession, path: str, kind: str, /, **options) -> float:
    """Of the first recording found; only its first rows are asked for."""
    found = _spans(spark, path, kind, None, options).select("sfreq").first() if _in_ranges(spark, path) else None
    if found is None or found[0] is None:
        found = samples_of(spark, path, kind, **options).select("sfreq").first()
    if found is None:
        raise ValueError(f"no samples under {path}")
    return found[0]


def read_windows(spark: SparkSession, path: str, kind: str, before: str | int, after: str | int, continuous: bool = False, codes: list[int] | None = None, first: int = 1, most: int | None = None, offset: str | int = 0, trigger_file: str | None = None, channels: list[str] | None = None, sfreq: float | None = None, decoding: dict | None = None) -> DataFrame:
    """Epochs of recordings: (epoch_id, recording, epoch_no, condition, channel_idx, channel, point, value), around triggers or one after another (``continuous``). Durations are
    points, or have a unit; ``first`` (from 1) and ``most`` count the epochs of each recording. Ids count from 0 within a recording, and recordings lie 2^32 apart, by path."""
    options = decoding or {}
    rate = sfreq or sampling_rate(spark, path, kind, **options)
    a, b, o = (units.points(x, rate) for x in (before, after, offset))
    data = samples_of(spark, path, kind, channels, **options).drop("sfreq")
    if continuous:
        out = joins.continuous_windows(data, a + b, o, "recording", first, most).withColumn("condition", F.lit(0))
    else:
        marks = triggers_in(spark, trigger_file, rate, data) if trigger_file else triggers_of(spark, path, kind, **options)
        out = joins.trigger_windows(data, marks, a, b, codes, o, first, most, "recording")
    place = data.select("recording").distinct().withColumn("_r", F.row_number().over(Window.orderBy("recording")) - 1)  # one row for each file
    ids = (F.col("_r").cast("long") * 2**32 + F.col("epoch_no") - first).alias("epoch_id")
    return out.join(place, "recording").select(ids, "recording", "epoch_no", "condition", "channel_idx", "channel", "point", "value")


def transferred(spark: SparkSession, path: str, kind: str, before: str | int, after: str | int, codes: list[int] | None = None, offset: str | int = 0, **options) -> DataFrame:
    """(recording, epoch_no, position, code): all triggers inside each window that ``read_windows`` would read, with positions in the epoch."""
    rate = sampling_rate(spark, path, kind, **options)
    a, b, o = (units.points(x, rate) for x in (before, after, offset))
    marks = triggers_of(spark, path, kind, **options)
    ends = samples_of(spark, path, kind, **options)
    windows = joins.windows_of(ends, marks, a, b, codes, o, by="recording").select("recording", "epoch_no", F.col("_start").alias("start"))
    return joins.transferred_triggers(windows, marks, a + b, "recording")


def read_brainvision(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of header, data and marker files with equal names: the three meet by name, then each recording is decoded alone."""
    return samples_of(spark, path, "brainvision")


def read_parameter_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of a parameter header (.dpa, also .cdt.dpa) and its values (.cdt)."""
    return samples_of(spark, path, "parameter_pair")


def _parts(files: DataFrame, *columns: str) -> DataFrame:
    """(recording, kind, ...) of files that belong together by name."""
    stem = F.regexp_replace("path", r"(\.cdt)?\.[^.]+$", "")
    return files.select(stem.alias("recording"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("kind"), *columns)


def _grouped(files: DataFrame, header: str, data: str, decode: Callable[[dict[str, bytes]], formats.Recording]) -> DataFrame:
    """Samples of recordings that consist of several files (recording, kind, content); those without header or data give none."""

    def run(pdf):
        import pandas as pd

        by = dict(zip(pdf["kind"], pdf["content"], strict=True))
        if header not in by or data not in by:
            return pd.DataFrame({c: [] for c in ("recording", "sfreq", "channel_idx", "channel", "pos", "value")})
        r = decode(by)
        n, points = r.values.shape
        return pd.DataFrame({"recording": pdf["recording"].iloc[0], "sfreq": r.sfreq, "channel_idx": np.repeat(np.arange(n), points), "channel": np.repeat(r.channels, points), "pos": np.tile(np.arange(points), n), "value": r.values.ravel()})

    return files.groupBy("recording").applyInPandas(run, "recording string, sfreq double, channel_idx int, channel string, pos long, value double")


def read_epochs(spark: SparkSession, path: str, pattern: str = "*.asc") -> DataFrame:
    """Samples of epoch files, text or binary: (recording, epoch_no, comment, sfreq, channel_idx, channel, point, item, x, value)."""

    names = ["recording", "epoch_no", "comment", "sfreq", "channel_idx", "channel", "point", "item", "x", "value"]

    def rows(path: str, epochs: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for no, e in enumerate(epochs):
            n, points, items = e["values"].shape
            m = n * points * items
            channel, point, item = (x.reshape(-1) for x in np.indices((n, points, items), np.int32))
            columns = [pa.repeat(pa.scalar(path), m), pa.array(np.full(m, no)), pa.repeat(pa.scalar(e["comment"]), m), pa.array(np.full(m, e["sfreq"], float)), pa.array(channel), pa.array(np.repeat(np.array(e["channels"], object), points * items), pa.string()), pa.array(point), pa.array(item), pa.array(e["x"].astype(float)[point]), pa.array(e["values"].astype(float).reshape(-1))]
            kept.append(pa.RecordBatch.from_arrays(columns, names=names))
            size += m
            if size >= _ROWS:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, size = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("path").to_pylist():
                with pieces.opened(p) as f:
                    yield from rows(p, formats.epochs_in(io.BufferedReader(f, pieces.STRETCH)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from rows(p, iter(formats.decode_epochs(c)))

    schema = "recording string, epoch_no long, comment string, sfreq double, channel_idx int, channel string, point int, item int, x double, value double"
    if not _in_ranges(spark, path):
        return _files(spark, path, pattern).mapInArrow(whole, schema).hint("shuffle_merge")
    listed = _listed(spark, path, pattern).select("path").repartition(2 * spark.sparkContext.defaultParallelism)
    return listed.mapInArrow(run, schema).hint("shuffle_merge")


def encoded(recordings: DataFrame, kind: str, triggers: DataFrame | None = None, encoding: dict | None = None) -> DataFrame:
    """(recording, suffix, content): the bytes of the files of each recording of (recording, sfreq, channel_idx, channel, pos, value), with its triggers
    (recording, position, code); ``encoding`` are the encoder's own options. A recording goes through one task, whole: ``write_recordings`` writes it in pieces."""
    import pandas as pd

    options = encoding or {}

    def made(pdf: pd.DataFrame, marks: list[tuple[int, int, str | None]]) -> pd.DataFrame:
        pdf = pdf.sort_values(["channel_idx", "pos"])
        names, key = pdf.drop_duplicates("channel_idx")["channel"].tolist(), pdf["recording"].iloc[0]
        r = formats.Recording(float(pdf["sfreq"].iloc[0]), names, pdf["value"].to_numpy(float).reshape(len(names), -1), marks)
        if kind == "brainvision":
            parts = formats.encode_brainvision(r, file_name(key), **options)
        elif kind == "parameter_pair":
            parts = formats.encode_parameter_pair(r, **options)
        elif kind == "words":
            parts = formats_sleep.encode_co(r, **options)
        elif kind == "differences":
            parts = formats_sleep.encode_differences(r, **options)
        else:
            parts = {WRITTEN.get(kind, ""): ENCODERS[kind](r, **options)}
        return pd.DataFrame([(key, suffix, content) for suffix, content in parts.items()], columns=["recording", "suffix", "content"])

    schema = "recording string, suffix string, content binary"
    if triggers is None:
        return recordings.groupBy("recording").applyInPandas(lambda pdf: made(pdf, []), schema)

    def together(pdf: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"recording": [], "suffix": [], "content": []})
        marks = marks.sort_values(["position", "code"])
        return made(pdf, [(int(p), int(c), None) for p, c in zip(marks["position"], marks["code"], strict=True)])

    marks = triggers.select(*[F.col(c).alias(c) for c in ("recording", "position", "code")])  # columns of their own, should both sides come from one table
    return recordings.groupBy("recording").cogroup(marks.groupBy("recording")).applyInPandas(together, schema)


WRITTEN = {"edf": ".edf", "wave": ".wav", "simple_binary": ".raw", "cnt": ".cnt", "generic": ".dat", "fields": ".dat", "volts": ".emg", "blocks": ".lv"}


def file_name(recording: str) -> str:
    """A name for a recording's files: its last part without suffix, and only letters, digits and ``._-``."""
    last = re.sub(r"\.[^.]*$", "", recording.rstrip("/").rsplit("/", 1)[-1])
    return re.sub(r"[^\w.-]", "_", last) or "recording"


def store(contents: DataFrame, path: str) -> list[str]:
    """Files of (recording, suffix, content) under a folder. Each is written beside its place and then moved there, so no reader meets half a file. The names written come back; they must differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        local = "/" + path.removeprefix("file:").lstrip("/")
        system, base = fs.FileSystem.from_uri(path if "://" in path and not path.startswith("file:") else local)
        system.create_dir(base, recursive=True)
        for b in batches:
            names = []
            for recording, suffix, content in zip(*(b.column(c).to_pylist() for c in ("recording", "suffix", "content")), strict=True):
                names.append(file_name(recording) + suffix)
                aside = f"{base}/.{names[-1]}-{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as f:
                    f.write(content)
                system.move(aside, f"{base}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    return sorted(r[0] for r in contents.mapInArrow(run, "name string").collect())  # one name for each file


def _put(rows: DataFrame, path: str, made: Callable[[str, Iterator[tuple[int, memoryview]]], Iterator[tuple[str, bytes]] | None]) -> list[str]:
    """Files of rows (recording, block, kind, data), one recording after another in one task: ``made`` takes a recording and its rows' kinds and data in order, and yields (suffix, bytes) to be put
    behind each other. As with ``store``, files are moved into place, and the names come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        local = "/" + path.removeprefix("file:").lstrip("/")
        system, base = fs.FileSystem.from_uri(path if "://" in path and not path.startswith("file:") else local)
        system.create_dir(base, recursive=True)
        every = ((r, k, d.as_buffer()) for b in batches for r, k, d in zip(b.column("recording").to_pylist(), b.column("kind").to_pylist(), b.column("data"), strict=True))
        for recording, group in itertools.groupby(every, lambda x: x[0]):
            own = {}
            for suffix, content in made(recording, ((k, memoryview(d)) for _, k, d in group)) or ():
                if suffix not in own:
                    name = file_name(recording) + suffix
                    own[suffix] = name, f"{base}/.{name}-{uuid.uuid4().hex}"
                    own[suffix] += (system.open_output_stream(own[suffix][1]),)
                own[suffix][2].write(content)
            for name, aside, f in own.values():
                f.close()
                system.move(aside, f"{base}/{name}")
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([name for name, _, _ in own.values()], pa.string())], names=["name"])

    ordered = rows.repartition("recording").sortWithinPartitions("recording", "block", "kind")
    return sorted(r[0] for r in ordered.mapInArrow(run, "name string").collect())  # one name for each file


_BLOCKS = "recording string, block long, kind int, data binary"


def write_recordings(recordings: DataFrame, path: str, kind: str, triggers: DataFrame | None = None, encoding: dict | None = None) -> list[str]:
    """One file (or group of files) for each recording. Its outline comes first, then block by block its triggers and its samples."""
    options, first = encoding or {}, F.lit(-(1 << 62)).cast("long")
    block = lambda c: F.floor(F.col(c) / _BLOCK).cast("long").alias("block")
    samples = recordings.select(F.col("recording").cast("string").alias("recording"), "sfreq", F.col("channel_idx").cast("int").alias("channel_idx"), "channel", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))

    def packed(t: pa.Table) -> pa.Table:
        c, p, v = (t.column(x).to_numpy() for x in ("channel_idx", "pos", "value"))
        x = v[np.lexsort((p, c))].reshape(len(np.unique(c)), -1)
        return pa.table({"recording": pa.array([t.column("recording")[0].as_py()], pa.string()), "block": pa.array([t.column("block")[0].as_py()], pa.int64()), "kind": pa.array([2], pa.int32()), "data": pa.array([x.tobytes()], pa.binary())})

    def marked(t: pa.Table) -> pa.Table:
        p, c = (t.column(x).to_numpy() for x in ("position", "code"))
        order = np.lexsort((c, p))
        return pa.table({"recording": pa.array([t.column("recording")[0].as_py()], pa.string()), "block": pa.array([t.column("block")[0].as_py()], pa.int64()), "kind": pa.array([1], pa.int32()), "data": pa.array([np.stack([p[order], c[order]], axis=1).astype(np.int64).tobytes()], pa.binary())})

    v = F.col("value")
    ends = samples.groupBy("recording", "channel_idx").agg(F.min_by("channel", "pos").alias("channel"), F.min_by("sfreq", "pos").alias("sfreq"), F.count("*").alias("points"), F.max(v).alias("most"), F.when(F.isnan(F.max(v)), F.lit(float("nan"))).otherwise(F.min(v)).alias("least"))
    ends = ends.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("channel_idx", "channel", "sfreq", "points", F.col("least").cast("string").alias("least"), F.col("most").cast("string").alias("most")))).alias("ends"))
    rows = samples.select("recording", block("pos"), "channel_idx", "pos", "value").groupBy("recording", "block").applyInArrow(packed, _BLOCKS)
    if triggers is None:
        outlines = ends.withColumn("codes", F.array().cast("array<int>"))
    else:
        marks = triggers.select(F.col("recording").cast("string").alias("recording"), F.col("position").cast("long").alias("position"), F.col("code").cast("int").alias("code"))
        outlines = ends.join(marks.groupBy("recording").agg(F.array_sort(F.collect_set("code")).alias("codes")), "recording", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<int>")))
        rows = rows.union(marks.withColumn("block", F.greatest(F.floor(F.col("position") / _BLOCK).cast("long"), F.lit(0).cast("long"))).groupBy("recording", "block").applyInArrow(marked, _BLOCKS))
    rows = rows.union(outlines.select("recording", first.alias("block"), F.lit(0).alias("kind"), F.to_json(F.struct("ends", "codes")).cast("binary").alias("data")))

    def made(recording: str, parts: Iterator[tuple[int, memoryview]]) -> Iterator[tuple[str, bytes]] | None:
        what, data = next(parts)
        if what:
            return None  # triggers of no recording
        head = json.loads(bytes(data))
        every = head["ends"]
        if len({e["points"] for e in every}) > 1:
            raise ValueError(f"channels of different lengths in {recording}")
        o = pieces.Outline(float(every[0]["sfreq"]), [e["channel"] for e in every], every[0]["points"], [float(e["least"]) for e in every], [float(e["most"]) for e in every], head["codes"], file_name(recording))

        def blocks() -> Iterator[tuple[np.ndarray, pieces.Marks]]:
            marks: pieces.Marks = []
            for what, data in parts:
                if what == 1:
                    marks += [(p, c, None) for p, c in np.frombuffer(data, np.int64).reshape(-1, 2).tolist()]
                else:
                    yield np.frombuffer(data, np.float64).reshape(len(every), -1), marks
                    marks = []
            if marks:
                yield np.zeros((len(every), 0)), marks

        return pieces.written(kind, o, blocks(), **options)

    return _put(rows, path, made)


def _encoded_epochs(pdf, sfreq: float, binary: bool) -> bytes:
    """A file of epochs in the order of their ids."""
    epochs = []
    for _, e in pdf.groupby("epoch_id", sort=True):
        e = e.sort_values(["channel_idx", "point", *(["item"] if "item" in e else [])], kind="stable")
        names, points = e.drop_duplicates("channel_idx")["channel"].tolist(), e["point"].nunique()
        x = e.drop_duplicates("point").sort_values("point")["x"].to_numpy(float) if "x" in e else np.arange(points) * 1000 / sfreq
        epochs.append({"sfreq": sfreq, "channels": names, "positions": np.zeros((len(names), 3)), "x": x, "values": e["value"].to_numpy(float).reshape(len(names), points, -1)})
    return formats.encode_binary_epochs(epochs) if binary else formats.encode_text_epochs(epochs)


def encoded_epochs(samples: DataFrame, sfreq: float, by: str = "recording", binary: bool = False) -> DataFrame:
    """(recording, suffix, content): for each value of ``by`` a file of its epochs (epoch_id, channel_idx, channel, point, value; item and x where there are), in the order of their ids. A file goes through one task, whole: ``write_epochs`` writes it in pieces."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"recording": [str(pdf[by].iloc[0])], "suffix": [".asc"], "content": [_encoded_epochs(pdf, sfreq, binary)]})

    return samples.groupBy(by).applyInPandas(run, "recording string, suffix string, content binary")


def write_epochs(samples: DataFrame, path: str, sfreq: float, by: str = "recording", binary: bool = False) -> list[str]:
    """Epoch files, text or binary, some epochs after another."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"recording": [str(pdf[by].iloc[0])], "block": [pdf["_block"].iloc[0]], "kind": [0], "data": [_encoded_epochs(pdf, sfreq, binary)]})

    def made(recording: str, parts: Iterator[tuple[int, memoryview]]) -> Iterator[tuple[str, bytes]]:
        for k, (_, data) in enumerate(parts):
            yield ".asc", data if k == 0 else data[formats.epochs_head(bytes(data[:4096])) :]

    columns = [c for c in (by, "epoch_id", "channel_idx", "channel", "point", "item", "x", "value") if c in samples.columns]
    rows = samples.select(*dict.fromkeys(columns), F.floor(F.col("epoch_id") / _EPOCHS).cast("long").alias("_block")).groupBy(by, "_block").applyInPandas(run, _BLOCKS)
    return _put(rows, path, made)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Samples as Parquet: the form to keep. Sorted inside files, so that ranges of points and single channels are skipped over."""
    order = [c for c in ("recording", "epoch_id", "channel", "pos", "point") if c in df.columns and c not in (partition_by or [])]
    w = df.sortWithinPartitions(*order).write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_points(df: DataFrame, path: str, channels: list[str], header: bool = True, mode: str = "errorifexists") -> None:
    """One line per point, a tab between channels. The channels are named, so no pass over the data is needed to find them."""
    keys = [c for c in ("epoch_id", "point") if c in df.columns]
    wide = df.groupBy(*keys).pivot("channel", channels).agg(F.first("value"))
    wide.sortWithinPartitions(*keys).write.mode(mode).csv(path, sep="\t", header=header)
