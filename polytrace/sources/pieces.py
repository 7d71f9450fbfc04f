"""Recording files in pieces: written block by block as the samples come, and read in ranges that are decoded alone. So neither side holds a recording whole.

``written`` gives the same bytes as the encoders of whole recordings. ``layout`` says where a file's values stand, if a range of them can be decoded without those before;
``sequential`` decodes the kinds whose values are differences, a stretch at a time. What neither can do is read whole: text and points-fastest values, and ``blocks``.
"""

from __future__ import annotations

import io
import re
import struct
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from . import formats, formats_lab, formats_sleep

Marks = list[tuple[int, int, str | None]]
#: Bytes read at once, and of a file's beginning that must hold its header.
STRETCH, HEADER = 1 << 20, 1 << 20


@dataclass
class Outline:
    """What a header says of a recording: per channel the least and the largest value, the codes of its triggers, and the name of its files."""

    sfreq: float
    channels: list[str]
    points: int
    least: list[float]
    most: list[float]
    codes: list[int] = field(default_factory=list)
    name: str = ""

    def recording(self, values: np.ndarray | None = None, triggers: Marks | None = None) -> formats.Recording:
        return formats.Recording(self.sfreq, self.channels, np.zeros((len(self.channels), 0)) if values is None else values, triggers or [])


#: Arrays of channels x points in order, each with the triggers that stand in it.
Blocks = Iterator[tuple[np.ndarray, Marks]]


def _recut(blocks: Blocks, per: int) -> Iterator[np.ndarray]:
    """The same values in arrays of a multiple of ``per`` points, but for the last."""
    kept: list[np.ndarray] = []
    for x, _ in blocks:
        x = np.concatenate([*kept, x], axis=1)
        whole = x.shape[1] // per * per
        if whole:
            yield x[:, :whole]
        kept = [x[:, whole:]]
    if kept and kept[0].shape[1]:
        yield kept[0]


def _edf(o: Outline, blocks: Blocks, record_seconds: float = 1.0) -> Iterator[tuple[str, bytes]]:
    head, low, high, per = formats.edf_head(o.sfreq, o.channels, o.points, o.least, o.most, record_seconds)
    yield ".edf", head
    for x in _recut(blocks, per):
        yield ".edf", formats.edf_records(x, low, high, per)


def _cnt(o: Outline, blocks: Blocks) -> Iterator[tuple[str, bytes]]:
    n = len(o.channels)
    head, units = formats.cnt_head(o.sfreq, o.channels, o.points, [max(abs(a), abs(b)) for a, b in zip(o.least, o.most, strict=True)])
    yield ".cnt", head
    with tempfile.SpooledTemporaryFile(STRETCH) as events:  # they stand behind the values
        for x, marks in blocks:
            events.write(formats.cnt_events(marks, n))
            yield ".cnt", formats.cnt_values(x, units)
        yield ".cnt", struct.pack("<BII", 1, events.tell(), 0)
        events.seek(0)
        while part := events.read(STRETCH):
            yield ".cnt", part


def _wave(o: Outline, blocks: Blocks, size: int = 2) -> Iterator[tuple[str, bytes]]:
    yield ".wav", _wave_head(formats.encode_wave(o.recording(), size), o.points * size * len(o.channels))
    for x, _ in blocks:
        yield ".wav", formats.encode_wave(o.recording(x), size)[44:]


def _wave_head(empty: bytes, size: int) -> bytes:
    return empty[:4] + struct.pack("<I", 36 + size) + empty[8:40] + struct.pack("<I", size)


def _simple_binary(o: Outline, blocks: Blocks) -> Iterator[tuple[str, bytes]]:
    empty = formats.encode_simple_binary(o.recording())
    yield ".raw", empty[:30] + struct.pack(">ih", o.points, len(o.codes)) + b"".join(f"{c:04d}".encode()[:4] for c in o.codes)
    done = 0
    for x, marks in blocks:
        events = np.zeros((len(o.codes), x.shape[1]))
        for at, code, _ in marks:
            events[o.codes.index(code), at - done] = 1
        done += x.shape[1]
        yield ".raw", np.concatenate([x, events]).T.astype(">f4").tobytes()


def _brainvision(o: Outline, blocks: Blocks, kind: str = "IEEE_FLOAT_32") -> Iterator[tuple[str, bytes]]:
    empty, no = formats.encode_brainvision(o.recording(), o.name, kind), 0
    yield from empty.items()
    for x, marks in blocks:
        yield ".vmrk", "".join(formats.marker_line(no + k + 1, at, code) + "\n" for k, (at, code, _) in enumerate(marks)).encode()
        no += len(marks)
        yield ".eeg", formats.encode_brainvision(o.recording(x), o.name, kind)[".eeg"]


def _parameter_pair(o: Outline, blocks: Blocks) -> Iterator[tuple[str, bytes]]:
    yield ".dpa", formats.encode_parameter_pair(o.recording())[".dpa"].replace(b"NumSamples = 0\n", f"NumSamples = {o.points}\n".encode(), 1)
    yield ".cdt", b""
    for x, _ in blocks:
        yield ".cdt", formats.encode_parameter_pair(o.recording(x))[".cdt"]


def _words(o: Outline, blocks: Blocks, nanovolts: int = 100) -> Iterator[tuple[str, bytes]]:
    yield from formats_sleep.encode_co(o.recording(), nanovolts).items()
    last = None
    for x, _ in blocks:
        whole = formats_sleep.co_values(x, nanovolts)
        data = formats_sleep.coded_bytes(whole if last is None else np.concatenate([last, whole]))
        yield ".co", data if last is None else data[2 * len(o.channels) :]  # a first point has words only
        last = whole[-1:]


def _differences(o: Outline, blocks: Blocks, gain: float = 1000.0) -> Iterator[tuple[str, bytes]]:
    yield ".dsc", formats_sleep.dsc_head(o.sfreq, o.channels, o.points, gain)
    yield ".eeg", b""
    at = np.zeros(len(o.channels))
    for x, _ in blocks:
        data, at = formats_sleep.difference_bytes(x.T * 1000 / gain, at)
        yield ".eeg", data


def _blocks(o: Outline, blocks: Blocks) -> Iterator[tuple[str, bytes]]:
    per, done = round(o.sfreq), 0
    head, links = formats_lab.block_tables(o.points // per, per, len(o.channels))
    yield ".lv", head
    for x in _recut(blocks, per):
        for at in range(0, x.shape[1] // per * per, per):
            yield ".lv", formats_lab.block_bytes(x[:, at : at + per])
            done += 1
            if done == formats_lab.TABLE_ENTRIES:
                yield ".lv", links
    if done < formats_lab.TABLE_ENTRIES:
        yield ".lv", links


def _headed(suffix: str, encode: Callable[..., bytes], patched: Callable[[bytes, int], bytes] = lambda head, points: head):
    """Of encoders whose values stand alone behind a header that is the same for any of them, but for the number of points."""

    def run(o: Outline, blocks: Blocks, **options) -> Iterator[tuple[str, bytes]]:
        head = encode(o.recording(), **options)
        yield suffix, patched(head, o.points)
        for x, _ in blocks:
            yield suffix, encode(o.recording(x), **options)[len(head) :]

    return run


def _volts_head(head: bytes, points: int) -> bytes:
    at, code = formats_lab.VOLTS_AT["samples"]
    return head[:at] + struct.pack(code, points) + head[at + struct.calcsize(code) :]


def _generic(o: Outline, blocks: Blocks, **options) -> Iterator[tuple[str, bytes]]:
    if options.get("points_fastest"):  # a channel after the other: they are there when the last point is
        yield ".dat", formats.encode_generic(o.recording(np.concatenate([np.zeros((len(o.channels), 0)), *[x for x, _ in blocks]], axis=1)), **options)
        return
    yield ".dat", b""
    for k, (x, _) in enumerate(blocks):
        yield ".dat", formats.encode_generic(o.recording(x), **(options | ({"header": False} if k else {})))


WRITERS: dict[str, Callable[..., Iterator[tuple[str, bytes]]]] = {
    "edf": _edf, "cnt": _cnt, "wave": _wave, "simple_binary": _simple_binary, "brainvision": _brainvision, "parameter_pair": _parameter_pair, "words": _words, "differences": _differences,
    "blocks": _blocks, "fields": _headed(".dat", formats_sleep.encode_fields), "volts": _headed(".emg", formats_lab.encode_volts, _volts_head), "generic": _generic,
}


def written(kind: str, outline: Outline, blocks: Blocks, /, **options) -> Iterator[tuple[str, bytes]]:
    """(suffix, bytes) of the files of a recording; the bytes of a suffix follow one another."""
    return WRITERS[kind](outline, blocks, **options)


# ------------------------------------------------------------------ reading


@dataclass
class Layout:
    """Values from ``start`` to ``end`` in units of so many bytes and points; ``decode`` makes a recording of the bytes of some units."""

    start: int
    end: int
    unit: int
    points: int
    decode: Callable[[bytes], formats.Recording]

    @property
    def units(self) -> int:
        return max(0, self.end - self.start) // self.unit


def _generic_layout(head: bytes, length: int, kind: str = "float32", channels: int = 1, sfreq: float = 100.0, offset: int = 0, points_fastest: bool = False, swap: bool = False, sep: str | None = None) -> Layout | None:
    if kind == "string" or points_fastest:
        return None
    return Layout(offset, length, np.dtype(formats.TYPES[kind]).itemsize * channels, 1, lambda b: formats.decode_generic(b, kind, channels, sfreq, swap=swap))


def _edf_layout(head: bytes, length: int) -> Layout | None:
    n, records = int(head[252:256]), int(head[236:244])
    start = 256 * (n + 1)
    if len(head) < start:
        return None
    at = 256 + n * sum(w for name, w in formats.EDF_CHANNEL[: [name for name, _ in formats.EDF_CHANNEL].index("samples")])
    samples = [int(head[at + 8 * k : at + 8 * k + 8]) for k in range(n)]
    notes = [head[256 + 16 * k : 272 + 16 * k].decode("latin-1").strip() in ("EDF Annotations", "BDF Annotations") for k in range(n)]
    unit = sum(samples) * (3 if head[0] == 0xFF else 2)
    there = (length - start) // unit
    if records > there:
        raise ValueError(f"the file has {there} of {records} records")
    any_number = head[:236] + b"-1".ljust(8) + head[244:start]
    return Layout(start, start + (there if records < 0 else records) * unit, unit, max((s for s, x in zip(samples, notes, strict=True) if not x), default=1), lambda b: formats.decode_edf(any_number + b))


def _cnt_layout(head: bytes, length: int) -> Layout | None:
    f = {k: struct.unpack_from(t, head, at)[0] for k, (at, t) in formats.CNT_AT.items()}
    start, block = formats.CNT_HEADER + formats.CNT_CHANNEL * f["nchannels"], f["block"] // 2 if f["block"] > 1 else 1
    place, code = formats.CNT_AT["events"]
    no_events = head[:place] + struct.pack(code, 0) + head[place + struct.calcsize(code) : start]
    if len(head) < start:
        return None
    return Layout(start, f["events"] if start < f["events"] <= length else length, 2 * f["nchannels"] * block, block, lambda b: formats.decode_cnt(no_events + b))


def _wave_layout(head: bytes, length: int) -> Layout | None:
    at, made = 12, None
    while head[:4] == b"RIFF" and at + 8 <= len(head):
        name, size = struct.unpack_from("<4sI", head, at)
        if name == b"fmt ":
            _, n, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            made = n, rate, (bits + 7) // 8
        if name == b"data" and made:
            n, rate, width = made
            empty = formats.encode_wave(formats.Recording(rate, formats.named(n), np.zeros((n, 0))), width)
            return Layout(at + 8, min(length, at + 8 + size), n * width, 1, lambda b: formats.decode_wave(_wave_head(empty, len(b)) + b))
        at += 8 + size + size % 2
    return None


def _fields_layout(head: bytes, length: int) -> Layout | None:
    place = struct.unpack_from(formats_sleep.FIELDS_AT["channels"][1], head, formats_sleep.FIELDS_AT["channels"][0])[0]
    if len(head) < place + 2:
        return None
    start = place + formats_sleep.RECORDS_FROM + struct.unpack_from("<h", head, place)[0] * formats_sleep.RECORD_SIZE
    if len(head) < start:
        return None
    each = formats_sleep.samples_each(head[:start])
    return Layout(start, length, 2 * sum(each), max(each), lambda b: formats_sleep.decode_fields(head[:start] + b))


def _volts_layout(head: bytes, length: int) -> Layout | None:
    start = formats_lab.VOLTS_HEADER + formats_lab.VOLTS_CHANNELS * formats_lab.VOLTS_RECORD
    n = struct.unpack_from(formats_lab.VOLTS_AT["channels"][1], head, formats_lab.VOLTS_AT["channels"][0])[0]
    return Layout(start, length, 4 * n, 1, lambda b: formats_lab.decode_volts(head[:start] + b))


def _simple_binary_layout(head: bytes, length: int) -> Layout | None:
    size = {2: 2, 4: 4, 6: 8}[struct.unpack(">i", head[:4])[0]]
    n, events = struct.unpack_from(">h", head, 22)[0], struct.unpack_from(">h", head, 34)[0]
    start = 36 + 4 * events
    return Layout(start, length, size * (n + events), 1, lambda b: formats.decode_simple_binary(head[:start] + b))


LAYOUTS: dict[str, Callable[..., Layout | None]] = {"generic": _generic_layout, "edf": _edf_layout, "cnt": _cnt_layout, "wave": _wave_layout, "fields": _fields_layout, "volts": _volts_layout, "simple_binary": _simple_binary_layout}


def layout(kind: str, head: bytes, length: int, beside: bytes = b"", /, **options) -> Layout | None:
    """Of a file with this beginning and length; ``beside`` is the small file that describes it, of kinds that have one. None: it must be read whole."""
    if kind == "brainvision":
        r, common = formats.decode_brainvision(beside, b""), formats.values_of(formats.sections(beside.decode("utf-8", "replace"))["Common Infos"])
        if common.get("DataOrientation", "MULTIPLEXED").upper() == "VECTORIZED":
            return None
        return Layout(0, length, formats.brainvision_width(beside) * len(r.channels), 1, lambda b: formats.decode_brainvision(beside, b))
    if kind == "parameter_pair":
        return Layout(0, length, 4 * len(formats.decode_parameter_pair(beside, b"").channels), 1, lambda b: formats.decode_parameter_pair(beside, b))
    return LAYOUTS[kind](head, length, **options) if kind in LAYOUTS else None


def sequential(kind: str, f, beside: bytes) -> Iterator[formats.Recording]:
    """The recording in an open file of the kinds ``words`` and ``differences``, in stretches one after another."""
    if kind == "words":
        head = f.read(formats_sleep.CO_HEADER)
        sfreq, names, scale = formats_sleep.co_head(head, beside)
        first = np.frombuffer(f.read(2 * len(names)), np.uint8)
        values, kept = formats_sleep.coded_values(first, len(names)), b""
        if len(values):
            yield formats.Recording(sfreq, names, values.T.astype(np.float64) * scale)
        while len(values) and (more := f.read(STRETCH)):
            data, last = np.frombuffer(kept + more, np.uint8), values[-1]
            made, used = formats_sleep.coded_run(data, last)
            kept = data[used:].tobytes()
            if len(made):
                values = made
                yield formats.Recording(sfreq, names, made.T.astype(np.float64) * scale)
        return
    n, kept = len(formats_sleep.decode_differences(beside, b"").channels), b""
    gain, before = struct.unpack_from(formats_sleep.DSC_AT["gain"][1], beside, formats_sleep.DSC_AT["gain"][0])[0], 0
    while more := f.read(STRETCH):
        data = kept + more
        whole = len(data) // n * n
        kept = data[whole:]
        if whole:
            steps = formats_sleep.difference_steps(np.frombuffer(data[:whole], np.int8)).reshape(-1, n)
            yield formats_sleep.decode_differences(beside, data[:whole], before)
            before = before + steps.sum(axis=0)


def triggers(kind: str, f, length: int, /, **options) -> Iterator[tuple[int, int, str | None]]:
    """The triggers of an open file that is not one of several."""
    if kind not in ("cnt", "edf", "simple_binary"):
        return
    head = f.read_at(min(HEADER, length), 0)
    lay = layout(kind, head, length, **options)
    if lay is None:
        raise ValueError("the header is too long")
    if kind == "cnt":
        place, code = formats.CNT_AT["events"]
        moved = head[:place] + struct.pack(code, lay.start + lay.unit) + head[place + struct.calcsize(code) : lay.start]
        yield from formats.decode_cnt(moved + bytes(lay.unit) + f.read_at(length - lay.end, lay.end)).triggers
        return
    step = max(2, STRETCH // lay.unit)
    for first in range(0, lay.units, step):
        back = 1 if kind == "simple_binary" and first else 0  # an event is where a value follows a zero
        found = lay.decode(f.read_at(min(step + back, lay.units - first + back) * lay.unit, lay.start + (first - back) * lay.unit)).triggers
        shift = first - back if kind == "simple_binary" else 0  # annotations have times of their own
        yield from ((at + shift, code, text) for at, code, text in found if not back or at)


def opened(path: str):
    """An open file of Arrow's, for a path or URI."""
    from pyarrow import fs

    local = "/" + path.removeprefix("file:").lstrip("/")
    system, name = fs.FileSystem.from_uri(path if "://" in path and not path.startswith("file:") else local)
    return system.open_input_file(name)
