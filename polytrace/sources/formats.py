"""Recording files of published formats, as pure functions between bytes and arrays.

A decoder takes the bytes of a file and returns a ``Recording``; an encoder does the reverse. How files are found
and distributed is Spark's business (``files``); no function here opens one.
"""

from __future__ import annotations

import io
import re
import struct
import wave
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Recording:
    """Channels x points with a sampling rate, and triggers (position, code, description)."""

    sfreq: float
    channels: list[str]
    values: np.ndarray
    triggers: list[tuple[int, int, str | None]] = field(default_factory=list)
    comment: str = ""


#: Element types of headerless files: numpy's code of each, little-endian.
TYPES = {"uint8": "<u1", "int8": "<i1", "int16": "<i2", "int32": "<i4", "float32": "<f4", "float64": "<f8"}


def named(n: int) -> list[str]:
    return [str(k + 1) for k in range(n)]


# ------------------------------------------------------------------ headerless


def decode_generic(data: bytes, kind: str = "float32", channels: int = 1, sfreq: float = 100.0, offset: int = 0, points_fastest: bool = False, swap: bool = False, sep: str | None = None) -> Recording:
    """Binary values (channels fastest, or points), or text with ``kind`` "string": one line per point. Bytes that make no whole point are left out."""
    if kind == "string":
        rows = [line.split(sep) for line in data[offset:].decode().splitlines() if line.strip() and not line.startswith("#")]
        x = np.array(rows, np.float64).reshape(len(rows), -1).T
    else:
        code = TYPES[kind].replace("<", ">") if swap else TYPES[kind]
        size = np.dtype(code).itemsize * channels
        flat = np.frombuffer(data, code, offset=offset, count=(len(data) - offset) // size * channels).astype(np.float64)
        x = flat.reshape(channels, -1) if points_fastest else flat.reshape(-1, channels).T
    return Recording(sfreq, named(len(x)), x)


def encode_generic(r: Recording, kind: str = "float32", points_fastest: bool = False, swap: bool = False, sep: str = "\t", header: bool = False) -> bytes:
    if kind == "string":
        lines = [sep.join(r.channels)] if header else []
        rows = r.values if points_fastest else r.values.T
        return ("\n".join(lines + [sep.join(f"{v:.17g}" for v in row) for row in rows]) + "\n").encode()
    code = TYPES[kind].replace("<", ">") if swap else TYPES[kind]
    x = r.values if points_fastest else r.values.T
    x = np.rint(x) if "f" not in code else x
    return np.ascontiguousarray(x).astype(code).tobytes()


# ------------------------------------------------------------------ EDF and BDF

#: Fixed widths in bytes of the header's fields, in order, for the file and for each channel.
EDF_FILE = [("version", 8), ("patient", 80), ("recording", 80), ("startdate", 8), ("starttime", 8), ("header_bytes", 8), ("reserved", 44), ("records", 8), ("duration", 8), ("signals", 4)]
EDF_CHANNEL = [("label", 16), ("transducer", 80), ("dimension", 8), ("physmin", 8), ("physmax", 8), ("digmin", 8), ("digmax", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32)]


def decode_edf(data: bytes) -> Recording:
    """European Data Format, and its 24-bit sister BDF. Channels with fewer samples than the fastest are repeated; annotations become triggers of code 1."""
    at, head = 0, {}
    for name, n in EDF_FILE:
        head[name] = data[at : at + n].decode("latin-1").strip()
        at += n
    n = int(head["signals"])
    fields = {}
    for name, width in EDF_CHANNEL:
        fields[name] = [data[at + k * width : at + (k + 1) * width].decode("latin-1").strip() for k in range(n)]
        at += n * width
    wide = data[0] == 0xFF
    size = 3 if wide else 2
    samples = [int(s) for s in fields["samples"]]
    record = sum(samples) * size
    records = (len(data) - at) // record if int(head["records"]) < 0 else int(head["records"])
    raw = np.frombuffer(data, np.uint8, count=records * record, offset=at).reshape(records, record)
    duration = float(head["duration"]) or 1.0
    notes = [k for k in range(n) if fields["label"][k] in ("EDF Annotations", "BDF Annotations")]
    signals = [k for k in range(n) if k not in notes]
    fastest = max((samples[k] for k in signals), default=1)
    start = np.concatenate([[0], np.cumsum(samples)]) * size
    rows = []
    for k in signals:
        b = raw[:, start[k] : start[k + 1]].reshape(-1, size)
        if wide:
            v = b[:, 0].astype(np.int32) | b[:, 1].astype(np.int32) << 8 | b[:, 2].astype(np.int8).astype(np.int32) << 16
        else:
            v = np.ascontiguousarray(b).view("<i2")[:, 0]
        low, high, dlow, dhigh = (float(fields[f][k]) for f in ("physmin", "physmax", "digmin", "digmax"))
        v = (v - dlow) * ((high - low) / (dhigh - dlow)) + low
        rows.append(np.repeat(v, fastest // samples[k]) if fastest % samples[k] == 0 else v[np.arange(records * fastest) * samples[k] // fastest])
    triggers = []
    for k in notes:
        for r in range(records):
            for tal in raw[r, start[k] : start[k + 1]].tobytes().split(b"\0"):
                parts = tal.split(b"\x14")
                m = re.match(rb"([+-][\d.]+)", parts[0])
                for text in parts[1:] if m else []:
                    if text:
                        triggers.append((round(float(m[1]) * fastest / duration), 1, text.decode("utf-8", "replace")))
    return Recording(fastest / duration, [fields["label"][k] for k in signals], np.array(rows).reshape(len(signals), -1), sorted(triggers, key=lambda t: t[0]), head["recording"])


def edf_head(sfreq: float, channels: list[str], points: int, least: list[float], most: list[float], record_seconds: float = 1.0, comment: str = "") -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """The header of a recording whose channels lie between ``least`` and ``most``; the bounds as the header holds them, and the points of a record."""
    per, n = max(1, round(sfreq * record_seconds)), len(channels)

    def put(value, width: int) -> bytes:
        text = f"{value:.{width}g}" if isinstance(value, float) else str(value)
        return text[:width].ljust(width).encode("latin-1", "replace")

    low, high = [], []
    for a, b in zip(least, most, strict=True):
        a, b = (a, b) if b > a else (a - 1, a + 1)
        # what the field can hold, rounded outwards
        low.append(float(put(float(np.floor(a)) if abs(a) > 1e3 else a - abs(a) * 1e-5, 8).decode()))
        high.append(float(put(float(np.ceil(b)) if abs(b) > 1e3 else b + abs(b) * 1e-5, 8).decode()))
    file = {"version": "0", "patient": "X X X X", "recording": comment or "Startdate X X X X", "startdate": "01.01.00", "starttime": "00.00.00", "header_bytes": 256 * (n + 1), "reserved": "", "records": -(-points // per), "duration": per / sfreq, "signals": n}
    out = [put(file[name], width) for name, width in EDF_FILE]
    columns = {"label": channels, "transducer": [""] * n, "dimension": ["uV"] * n, "physmin": low, "physmax": high, "digmin": [-32768] * n, "digmax": [32767] * n, "prefilter": [""] * n, "samples": [per] * n, "reserved": [""] * n}
    out += [put(v, width) for name, width in EDF_CHANNEL for v in columns[name]]
    return b"".join(out), np.array(low)[:, None], np.array(high)[:, None], per


def edf_records(x: np.ndarray, low: np.ndarray, high: np.ndarray, per: int) -> bytes:
    """Records of 16 bits over each channel's range; the last one is filled up with the last value."""
    n, points = x.shape
    records = -(-points // per)
    x = np.concatenate([x, np.repeat(x[:, -1:], records * per - points, axis=1)], axis=1) if points else x
    digital = np.clip(np.rint((x - low) / (high - low) * 65535 - 32768), -32768, 32767).astype("<i2")
    return digital.reshape(n, records, per).transpose(1, 0, 2).tobytes()


def encode_edf(r: Recording, record_seconds: float = 1.0) -> bytes:
    """EDF with 16 bits over each channel's range; the last record is filled up with the last value."""
    points = r.values.shape[1]
    least, most = ([float(v) for v in (f(r.values, axis=1) if points else np.full(len(r.channels), none))] for f, none in ((np.min, 0.0), (np.max, 1.0)))
    head, low, high, per = edf_head(r.sfreq, r.channels, points, least, most, record_seconds, r.comment)
    return head + edf_records(r.values, low, high, per)


# ------------------------------------------------------------------ BrainVision

BRAINVISION_TYPES = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4", "UINT_16": "<u2"}


def sections(text: str) -> dict[str, list[str]]:
    """Lines of an .ini-like file by section, without comments."""
    out: dict[str, list[str]] = {}
    name = ""
    for line in text.splitlines():
        line = line.strip()
        if m := re.fullmatch(r"\[(.+)\]", line):
            name = m[1]
        elif line and not line.startswith(";"):
            out.setdefault(name, []).append(line)
    return out


def values_of(lines: list[str]) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines)}


def decode_brainvision(header: bytes, data: bytes, markers: bytes = b"") -> Recording:
    """A header (.vhdr), its data (.eeg) and its markers (.vmrk)."""
    parts = sections(header.decode("utf-8", "replace"))
    common, binary = values_of(parts["Common Infos"]), values_of(parts.get("Binary Infos", []))
    n = int(common["NumberOfChannels"])
    names, scale = [], []
    for k in range(n):
        f = values_of(parts["Channel Infos"]).get(f"Ch{k + 1}", f"{k + 1},,1").split(",")
        names.append(f[0].replace("\\1", ","))
        scale.append(float(f[2]) if len(f) > 2 and f[2] else 1.0)
    code = BRAINVISION_TYPES[binary.get("BinaryFormat", "INT_16")]
    flat = np.frombuffer(data, code, count=len(data) // (np.dtype(code).itemsize * n) * n).astype(np.float64)
    x = flat.reshape(n, -1) if common.get("DataOrientation", "MULTIPLEXED").upper() == "VECTORIZED" else flat.reshape(-1, n).T
    triggers = []
    for line in sections(markers.decode("utf-8", "replace")).get("Marker Infos", []):
        f = line.partition("=")[2].split(",")
        if len(f) > 2:
            digits = re.search(r"\d+", f[1])
            triggers.append((int(f[2]) - 1, int(digits[0]) if digits else 1, f[1] or f[0]))
    return Recording(1e6 / float(common["SamplingInterval"]), names, x * np.array(scale)[:, None], triggers)


def brainvision_width(header: bytes) -> int:
    """Bytes of a value."""
    binary = values_of(sections(header.decode("utf-8", "replace")).get("Binary Infos", []))
    return np.dtype(BRAINVISION_TYPES[binary.get("BinaryFormat", "INT_16")]).itemsize


def marker_line(no: int, at: int, code: int) -> str:
    return f"Mk{no}=Stimulus,S{code:3d},{at + 1},1,0"


def encode_brainvision(r: Recording, name: str, kind: str = "IEEE_FLOAT_32") -> dict[str, bytes]:
    """The three files of a recording by suffix."""
    code = {"INT_16": "<i2", "INT_32": "<i4", "IEEE_FLOAT_32": "<f4"}[kind]
    head = ["Brain Vision Data Exchange Header File Version 1.0", "[Common Infos]", f"DataFile={name}.eeg", f"MarkerFile={name}.vmrk", "DataFormat=BINARY", "DataOrientation=MULTIPLEXED", f"NumberOfChannels={len(r.channels)}", f"SamplingInterval={1e6 / r.sfreq:.10g}", "[Binary Infos]", f"BinaryFormat={kind}", "[Channel Infos]"]
    head += [f"Ch{k + 1}={c.replace(',', chr(92) + '1')},,1,uV" for k, c in enumerate(r.channels)]
    marks = ["Brain Vision Data Exchange Marker File, Version 1.0", "[Common Infos]", f"DataFile={name}.eeg", "[Marker Infos]"]
    marks += [marker_line(k + 1, at, code_) for k, (at, code_, _) in enumerate(r.triggers)]
    x = r.values.T if "f" in code else np.rint(r.values.T)
    return {".vhdr": "\n".join(head).encode() + b"\n", ".vmrk": "\n".join(marks).encode() + b"\n", ".eeg": np.ascontiguousarray(x).astype(code).tobytes()}


# ------------------------------------------------------------------ simple binary of dense arrays


def decode_simple_binary(data: bytes) -> Recording:
    """The big-endian unsegmented simple-binary format: versions 2 (16-bit), 4 (float) and 6 (double), with event channels."""
    version = struct.unpack(">i", data[:4])[0]
    code = {2: ">i2", 4: ">f4", 6: ">f8"}[version]
    _, _, _, _, _, _, _, sfreq, n, gain, bits, scale, points, events = struct.unpack(">6hihhhhhih", data[4:36])
    codes = [data[36 + 4 * k : 40 + 4 * k].decode("latin-1") for k in range(events)]
    at = 36 + 4 * events
    x = np.frombuffer(data, code, offset=at).astype(np.float64)
    x = x[: len(x) // (n + events) * (n + events)].reshape(-1, n + events).T
    values = x[:n] * (scale / 2**bits) if bits and scale else x[:n]
    triggers = []
    for k in range(events):
        on = x[n + k] != 0
        triggers += [(int(p), k + 1, codes[k]) for p in np.flatnonzero(on & ~np.append(False, on[:-1]))]
    return Recording(float(sfreq), named(n), values, sorted(triggers, key=lambda t: t[0]), f"gain {gain}")


def encode_simple_binary(r: Recording) -> bytes:
    """Version 4, one event channel for each trigger code."""
    codes = sorted({c for _, c, _ in r.triggers})
    n, points = r.values.shape
    head = struct.pack(">i6hihhhhhih", 4, 2000, 1, 1, 0, 0, 0, 0, round(r.sfreq), n, 1, 0, 0, points, len(codes))
    events = np.zeros((len(codes), points))
    for at, code, _ in r.triggers:
        events[codes.index(code), at] = 1
    return head + b"".join(f"{c:04d}".encode()[:4] for c in codes) + np.concatenate([r.values, events]).T.astype(">f4").tobytes()


# ------------------------------------------------------------------ sound


def decode_wave(data: bytes) -> Recording:
    with wave.open(io.BytesIO(data)) as w:
        n, size, raw = w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
        rate = w.getframerate()
    if size == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = b[:, 0].astype(np.int32) | b[:, 1].astype(np.int32) << 8 | b[:, 2].astype(np.int8).astype(np.int32) << 16
    else:
        x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[size]).astype(np.int64) - (128 if size == 1 else 0)
    return Recording(float(rate), named(n), x.reshape(-1, n).T / float(1 << (8 * size - 1)))


def encode_wave(r: Recording, size: int = 2) -> bytes:
    top = (1 << (8 * size - 1)) - 1
    x = np.rint(np.clip(r.values.T, -1, 1) * top).astype(np.int64)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(r.channels))
        w.setsampwidth(size)
        w.setframerate(round(r.sfreq))
        w.writeframes((x + 128).astype("u1").tobytes() if size == 1 else x.astype({2: "<i2", 4: "<i4"}[size]).tobytes())
    return out.getvalue()


# ------------------------------------------------------------------ the self-describing text format


#: Fixed values of the binary variant: first two bytes for each element type, and what parts a comment from its z axis.
BINARY_MAGIC = {0xBFFB: "f4", 0xBDDB: "f8"}
Z_AXIS = ";Zaxis:"


def parted(comment: str) -> tuple[str, str | None, float | None]:
    """Comment, z label and z value."""
    text, found, z = comment.partition(Z_AXIS)
    label, _, value = z.rpartition("=")
    return (text, label, float(value)) if found else (text, None, None)


def decode_epochs(data: bytes) -> list[dict]:
    """Epochs of a file in the self-describing format, binary or text."""
    for order in "<>":
        kind = BINARY_MAGIC.get(struct.unpack_from(order + "H", data)[0]) if len(data) > 4 else None
        if kind:
            break
    else:
        return decode_text_epochs(data)
    size = struct.unpack_from(order + "h", data, 2)[0]
    head = dict(line.partition("=")[::2] for line in data[4 : 4 + size].rstrip(b"\0").decode().splitlines() if "=" in line)
    at, out = 4 + size, []

    def take(code: str, n: int) -> np.ndarray:
        nonlocal at
        v = np.frombuffer(data, order + code, n, at).astype(np.float64)
        at += v.size * np.dtype(code).itemsize
        return v

    while at + 20 <= len(data):
        n, points, items, mixed, strings = struct.unpack_from(order + "5i", data, at)
        at += 20
        comment, x_label, *names = data[at : at + strings].decode().split("\0")[: n + 2]
        at += strings
        places, x, v = take("f8", 3 * n).reshape(n, 3), take(kind, points), take(kind, points * n * items)
        values = v.reshape(points, n, items).transpose(1, 0, 2) if mixed else v.reshape(n, points, items)
        at += 4  # the length of this epoch, for reading backwards
        text, z_label, z_value = parted(comment)
        out.append({"sfreq": float(head.get("Sfreq", 0) or 0), "comment": text, "z_label": z_label, "z_value": z_value, "x_label": x_label, "channels": names, "positions": places, "x": x, "values": values})
    return out


def epochs_head(data: bytes) -> int:
    """The bytes before the first epoch of a file that the encoders here made."""
    if struct.unpack_from("<H", data)[0] in BINARY_MAGIC:
        return 4 + struct.unpack_from("<h", data, 2)[0]
    return data.index(b"\n") + 1


def epochs_in(f) -> Iterator[dict]:
    """The epochs of an open file, binary or text, read one after another."""
    first = f.read(4)
    order = next((o for o in "<>" if len(first) == 4 and struct.unpack_from(o + "H", first)[0] in BINARY_MAGIC), None)
    if order is None:
        yield from _text_epochs_in(io.TextIOWrapper(io.BufferedReader(_Rest(first, f)), newline="\n"))
        return
    width = np.dtype(BINARY_MAGIC[struct.unpack_from(order + "H", first)[0]]).itemsize
    head = first + f.read(struct.unpack_from(order + "h", first, 2)[0])
    while len(sizes := f.read(20)) == 20:
        n, points, items, _, strings = struct.unpack(order + "5i", sizes)
        yield from decode_epochs(head + sizes + f.read(strings + 24 * n + width * points * (1 + n * items) + 4))


class _Rest(io.RawIOBase):
    """A file whose first bytes have been read already."""

    def __init__(self, first: bytes, f):
        self.first, self.f = first, f

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        got = self.first[: len(b)] or self.f.read(len(b))
        self.first = self.first[len(b) :]
        b[: len(got)] = got
        return len(got)


def _text_epochs_in(lines: Iterator[str]) -> Iterator[dict]:
    """Each epoch begins at the line before ``channels=``; what stands before the first is the file's header."""
    head, kept = [], []
    for line in lines:
        kept.append(line)
        if line.startswith("channels=") and len(kept) > 1:
            sizes = dict(x.strip().split("=") for x in line.split(","))
            head, kept = head + kept[:-2], kept[-2:]
            kept += [x for _, x in zip(range(4 + int(sizes["points"])), lines, strict=False)]
            yield from decode_text_epochs("".join(head + kept).encode())
            kept = []


def encode_binary_epochs(epochs: list[dict], kind: str = "f8") -> bytes:
    """The binary variant, little-endian, channels adjacent."""
    head = (f"Sfreq={epochs[0]['sfreq']:.10g}\n" if epochs else "").encode()
    out = [struct.pack("<Hh", {v: k for k, v in BINARY_MAGIC.items()}[kind], len(head)), head]
    for e in epochs:
        n, points, items = e["values"].shape
        z = f"{Z_AXIS}{e['z_label']}={e['z_value']:.17g}" if e.get("z_label") is not None else ""
        strings = "".join(x + "\0" for x in (e.get("comment", "") + z, e.get("x_label", "x"), *e["channels"])).encode()
        one = struct.pack("<5i", n, points, items, 1, len(strings)) + strings + np.asarray(e["positions"]).astype("<f8").tobytes()
        one += np.asarray(e["x"]).astype("<" + kind).tobytes() + np.ascontiguousarray(e["values"].transpose(1, 0, 2)).astype("<" + kind).tobytes()
        out.append(one + struct.pack("<i", len(one) + 4))
    return b"".join(out)


def decode_text_epochs(data: bytes) -> list[dict]:
    """Epochs of a text file: header lines keyword=value, then for each epoch a comment, its sizes, channel names, three lines of places, and rows of x and values (tuples in braces)."""
    lines = data.decode().split("\n")
    head, at = {}, 0
    while at < len(lines) and "=" in lines[at] and not lines[at].startswith("channels="):
        if at + 1 < len(lines) and lines[at + 1].startswith("channels="):
            break
        k, _, v = lines[at].partition("=")
        head[k.strip()] = v.strip()
        at += 1
    out = []
    while at + 1 < len(lines) and lines[at + 1].startswith("channels="):
        sizes = dict(x.strip().split("=") for x in lines[at + 1].split(","))
        n, points, items = int(sizes["channels"]), int(sizes["points"]), int(sizes.get("itemsize", 1))
        names = lines[at + 2].split("\t") if "\t" in lines[at + 2] else lines[at + 2].split()
        places = np.array([re.split(r"\s+", lines[at + 3 + k].strip())[1:] for k in range(3)], np.float64).T
        rows = [[float(v) for v in re.sub(r"[{}]", " ", lines[at + 6 + p]).split()] for p in range(points)]
        x = np.array(rows, np.float64).reshape(points, 1 + n * items)
        out.append({"sfreq": float(head.get("Sfreq", 0) or 0), "comment": parted(lines[at])[0], "z_label": parted(lines[at])[1], "z_value": parted(lines[at])[2], "x_label": names[0], "channels": names[1 : n + 1], "positions": places, "x": x[:, 0], "values": x[:, 1:].reshape(points, n, items).transpose(1, 0, 2)})
        at += 6 + points
    return out


def encode_text_epochs(epochs: list[dict]) -> bytes:
    out = [f"Sfreq={epochs[0]['sfreq']:.10g}"] if epochs else []
    for e in epochs:
        n, points, items = e["values"].shape
        out += [e.get("comment", ""), f"channels={n}, points={points}" + (f", itemsize={items}" if items > 1 else ""), "\t".join([e.get("x_label", "x"), *e["channels"]])]
        out += ["\t".join(["-", *(f"{p[k]:.10g}" for p in e["positions"])]) for k in range(3)]
        for p in range(points):
            cells = [f"{v[p, 0]:.17g}" if items == 1 else "{" + " ".join(f"{y:.17g}" for y in v[p]) + "}" for v in e["values"]]
            out.append("\t".join([f"{e['x'][p]:.17g}", *cells]))
    return ("\n".join(out) + "\n").encode()


def decode_triggers(text: str, sfreq: float) -> list[tuple[int, int, str | None]]:
    """Lines of position (points, or with s or ms), code and description; # comments; a missing code is 1; code 0 ends the list."""
    out = []
    for line in text.splitlines():
        f = line.split("#")[0].strip().split(None, 2)
        if not f:
            continue
        m = re.fullmatch(r"([-+.\deE]+)(ms|s)?", f[0])
        if not m:
            raise ValueError(f"not a position: {f[0]!r}")
        at = round(float(m[1]) * {None: 1.0, "s": sfreq, "ms": sfreq / 1000}[m[2]])
        code = int(f[1]) if len(f) > 1 else 1
        if code == 0:
            break
        out.append((at, code, f[2] if len(f) > 2 else None))
    return out


# ------------------------------------------------------------------ continuous files with a 900-byte header

#: Fixed places in the header and in each channel's record, their types, and the scale of one unit.
CNT_HEADER, CNT_CHANNEL, CNT_UNIT = 900, 75, 204.8
CNT_AT = {"type": (20, "<B"), "nchannels": (370, "<H"), "rate": (376, "<H"), "samples": (864, "<I"), "events": (886, "<I"), "block": (890, "<I")}
CNT_CHANNEL_AT = {"baseline": (47, "<h"), "sensitivity": (59, "<f"), "calibration": (71, "<f")}


def decode_cnt(data: bytes) -> Recording:
    """Continuous 16-bit recordings: header, channel records, values (channels fastest, or in blocks), event table with 8- or 19-byte events."""
    head = {k: struct.unpack_from(t, data, at)[0] for k, (at, t) in CNT_AT.items()}
    n = head["nchannels"]
    start = CNT_HEADER + CNT_CHANNEL * n
    names, factors, bases = [], [], []
    for k in range(n):
        at = CNT_HEADER + CNT_CHANNEL * k
        one = {f: struct.unpack_from(t, data, at + o)[0] for f, (o, t) in CNT_CHANNEL_AT.items()}
        names.append(data[at : at + 10].split(b"\0")[0].decode("latin-1"))
        factors.append(one["sensitivity"] * one["calibration"] / CNT_UNIT)
        bases.append(one["baseline"])
    end = head["events"] if start < head["events"] <= len(data) else len(data)
    block = head["block"] // 2 if head["block"] > 1 else 1
    x = np.frombuffer(data, "<i2", offset=start, count=(end - start) // (2 * n * block) * n * block).astype(np.float64)
    x = x.reshape(-1, n, block).transpose(1, 0, 2).reshape(n, -1)
    triggers = []
    if end + 9 <= len(data):
        kind, size = struct.unpack_from("<BI", data, end)
        width = {1: 8, 2: 19, 3: 19}.get(kind, 8)
        for at in range(end + 9, min(end + 9 + size, len(data)) - width + 1, width):
            code, keyboard, keypad, offset = struct.unpack_from("<HBBI", data, at)
            pos = offset if kind == 3 else (offset - start) // (2 * n)
            # key presses and rejection marks have codes of their own: negative
            triggers.append((pos, code if code else -max(1, (keypad & 15) or keyboard), None))
    return Recording(float(head["rate"]), names, (x - np.array(bases)[:, None]) * np.array(factors)[:, None], sorted(triggers, key=lambda t: t[0]))


def cnt_head(sfreq: float, channels: list[str], points: int, top: list[float]) -> tuple[bytes, np.ndarray]:
    """Header and channel records, and the size of each channel's unit, for channels of these largest absolute values."""
    n = len(channels)
    start = CNT_HEADER + CNT_CHANNEL * n
    head = bytearray(CNT_HEADER)
    head[:12] = b"Version 3.0\0"
    for k, v in {"type": 1, "nchannels": n, "rate": round(sfreq), "samples": points, "events": start + 2 * n * points, "block": 0}.items():
        struct.pack_into(CNT_AT[k][1], head, CNT_AT[k][0], v)
    rows, units = [], []
    for name, t in zip(channels, top, strict=True):
        scale = np.float32((t or 1.0) / 32767 * CNT_UNIT)
        one = bytearray(CNT_CHANNEL)
        one[:9] = name.encode("latin-1", "replace")[:9].ljust(9, b"\0")
        struct.pack_into("<f", one, CNT_CHANNEL_AT["sensitivity"][0], scale)
        struct.pack_into("<f", one, CNT_CHANNEL_AT["calibration"][0], 1.0)
        units.append(float(scale) / CNT_UNIT)
        rows.append(bytes(one))
    return bytes(head) + b"".join(rows), np.array(units)[:, None]


def cnt_values(x: np.ndarray, units: np.ndarray) -> bytes:
    return np.clip(np.rint(x / units), -32768, 32767).T.astype("<i2").tobytes()


def cnt_events(triggers: list[tuple[int, int, str | None]], n: int) -> bytes:
    return b"".join(struct.pack("<HBBI", max(0, code), 0, max(0, -code), CNT_HEADER + CNT_CHANNEL * n + 2 * n * at) for at, code, _ in triggers)


def encode_cnt(r: Recording) -> bytes:
    """Values in full 16-bit range of each channel, 8-byte events."""
    n, points = r.values.shape
    head, units = cnt_head(r.sfreq, r.channels, points, [float(np.abs(row).max(initial=0)) for row in r.values])
    events = cnt_events(r.triggers, n)
    return head + cnt_values(r.values, units) + struct.pack("<BII", 1, len(events), 0) + events


# ------------------------------------------------------------------ float files with a text header of parameters


def decode_parameter_pair(header: bytes, data: bytes) -> Recording:
    """A text header of ``key = value`` lines and label lists between START_LIST and END_LIST, with 32-bit floats (channels fastest) in a second file."""
    values, labels, inside = {}, [], False
    for line in header.decode("utf-8", "replace").splitlines():
        word = line.strip()
        if "START_LIST" in word:
            inside = word.startswith("LABELS")
        elif "END_LIST" in word:
            inside = False
        elif inside and word:
            labels.append(word)
        elif "=" in word:
            k, _, v = word.partition("=")
            values[k.strip()] = v.strip()
    n = int(values["NumChannels"])
    x = np.frombuffer(data, "<f4", count=len(data) // (4 * n) * n).astype(np.float64).reshape(-1, n).T
    names = (labels + named(n)[len(labels) :])[:n]
    return Recording(float(values["SampleFreqHz"]), names, x)


def encode_parameter_pair(r: Recording) -> dict[str, bytes]:
    n, points = r.values.shape
    lines = ["DATA_PARAMETERS START", f"   NumSamples = {points}", f"   NumChannels = {n}", f"   SampleFreqHz = {r.sfreq:.10g}", "DATA_PARAMETERS END", "LABELS START_LIST", *r.channels, "LABELS END_LIST"]
    return {".dpa": ("\n".join(lines) + "\n").encode(), ".cdt": np.ascontiguousarray(r.values.T).astype("<f4").tobytes()}
