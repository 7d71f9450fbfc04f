"""Recording files of sleep laboratories, as pure functions between bytes and arrays: difference-coded streams, and text fields in fixed places."""

from __future__ import annotations

import re
import struct

import numpy as np

from .formats import Recording, named

# ------------------------------------------------------------------ words and differences (.co, with .coa beside)

#: The header's length, and the sensitivity in microvolts that stands for none.
CO_HEADER, CO_SENSITIVITY = 64, 0.086


def coded_values(data: np.ndarray, channels: int) -> np.ndarray:
    """Points x channels of a stream of bytes: a value is a word of two bytes, the higher first, whose top bit is set and whose next bit is its sign, or one byte with the difference to the
    channel's last value, of 7 bits. The first point has words only. Part of a point at the end is left out.

    A byte starts a value if an even number of bytes with a set top bit lie between it and the last byte without one.
    """
    head = data[: 2 * channels]
    if len(head) < 2 * channels:
        return np.zeros((0, channels), np.int16)
    words = _signed(head[0::2].astype(np.int32) << 8 | head[1::2].astype(np.int32))
    return np.concatenate([words.astype(np.int16)[None], coded_run(data[2 * channels :], words)[0]])


def coded_run(rest: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, int]:
    """The points of a stream behind a point of the values ``last``, and how many bytes they take."""
    channels = len(last)
    high = rest >= 0x80
    at = np.arange(len(rest))
    last_low = np.maximum.accumulate(np.where(high, -1, at)) if len(rest) else at
    before = np.concatenate([[-1], last_low[:-1]]) if len(rest) else at
    start = (at - before - 1) % 2 == 0
    where = np.flatnonzero(start)
    where = where[~(high[where] & (where + 1 >= len(rest)))]
    where = where[: len(where) // channels * channels]
    first, whole = rest[where].astype(np.int32), high[where]
    second = rest[np.minimum(where + 1, max(len(rest) - 1, 0))].astype(np.int32)
    value = np.where(whole, _signed(first << 8 | second), np.where(first & 0x40, first - 0x80, first))
    used = int(where[-1]) + 1 + int(whole[-1]) if len(where) else 0
    value = np.concatenate([last.astype(np.int32), value]).reshape(-1, channels)
    whole = np.concatenate([np.ones(channels, bool), whole]).reshape(-1, channels)
    run = np.cumsum(np.where(whole, 0, value), axis=0, dtype=np.int64)
    point = np.maximum.accumulate(np.where(whole, np.arange(len(value))[:, None], 0), axis=0)
    base = np.take_along_axis(value, point, 0) - np.take_along_axis(run, point, 0)
    return (base + run).astype(np.int16)[1:], used


def _signed(word: np.ndarray) -> np.ndarray:
    """Words of 15 bits and a mark: bit 14 is the sign."""
    return np.where(word & 0x4000, (word | 0x8000) - 0x10000, word & 0x3FFF)


def coded_bytes(values: np.ndarray) -> bytes:
    """The reverse for points x channels of -16384 to 16383."""
    x = values.astype(np.int32)
    step = np.diff(x, axis=0, prepend=x[:1])
    small = np.abs(step) <= 63
    small[:1] = False
    word = np.where(x < 0, (x & 0x3FFF) | 0xC000, (x & 0x3FFF) | 0x8000)
    one, step, word = small.ravel(), step.ravel(), word.ravel()
    at = np.cumsum(2 - one) - (2 - one)
    out = np.zeros(int((2 - one).sum()), np.uint8)
    out[at] = np.where(one, step & 0x7F, word >> 8 & 0xFF)
    out[at[~one] + 1] = word[~one] & 0xFF
    return out.tobytes()


def decode_co(data: bytes, table: bytes = b"") -> Recording:
    """A stream (.co) and, if there is one, the text beside it (.coa) whose ``Channel_Table`` lines hold number, nanovolts a bit and name of each channel."""
    sfreq, names, scale = co_head(data, table)
    return Recording(sfreq, names, coded_values(np.frombuffer(data, np.uint8, offset=CO_HEADER), len(names)).T.astype(np.float64) * scale)


def co_head(data: bytes, table: bytes = b"") -> tuple[float, list[str], np.ndarray]:
    """Sampling rate, names and what a bit is worth in each channel."""
    n, interval = struct.unpack("<2h", data[:4])
    names, scale, on = [], [], False
    for line in table.decode("latin-1").splitlines():
        if line.startswith("Channel_Table"):
            on = True
        elif on and re.match(r"\d", line):
            f = line.split()
            names.append(f[-1] if not line.startswith("0 0 ") else str(len(names) + 1))
            scale.append(float(f[1]) / 1000 or CO_SENSITIVITY)
        else:
            on = False
    names, scale = names or named(n), scale or [1.0] * n
    return 1e6 / interval, names, np.array(scale)[:, None]


def encode_co(r: Recording, nanovolts: int = 100) -> dict[str, bytes]:
    """The two files of a recording by suffix; values are rounded to ``nanovolts`` and must fit into 15 bits."""
    n = len(r.channels)
    whole = co_values(r.values, nanovolts)
    head = struct.pack("<16h32s", n, round(1e6 / r.sfreq), *[0] * 14, b"")
    table = ["Channel_Table "] + [f"{k + 1} {nanovolts} {re.sub(r'\s', '_', c)}" for k, c in enumerate(r.channels)]
    return {".co": head + coded_bytes(whole), ".coa": ("\n".join(table) + "\n\n").encode("latin-1", "replace")}


def co_values(values: np.ndarray, nanovolts: int) -> np.ndarray:
    """Points x channels in units of so many nanovolts."""
    whole = np.rint(values.T * 1000 / nanovolts)
    if len(whole) and (whole.min() < -16384 or whole.max() > 16383):
        raise ValueError("values do not fit into 15 bits")
    return whole


# ------------------------------------------------------------------ one byte for each difference (.eeg, with .dsc beside)

#: Fixed places in the header of 332 bytes, and the sampling rate of each of its codes.
DSC_AT = {"length": (46, "<H"), "channels": (60, "<H"), "gain": (322, "<f"), "rate": (326, "<B")}
DSC_NAMES, DSC_SIZE, DSC_RATES = 66, 332, {1: 128.0, 2: 256.0}


def decode_differences(header: bytes, data: bytes, before: np.ndarray | int = 0) -> Recording:
    """Each byte is the difference to the channel's last value: its lower two bits say how far the upper six move to the left (by 0, 2 or 4), or 3 that they stand as they are. ``before``: the values before the first, undivided by the gain."""
    f = {k: struct.unpack_from(code, header, at)[0] for k, (at, code) in DSC_AT.items()}
    n = f["channels"]
    names = [header[DSC_NAMES + 4 * k : DSC_NAMES + 4 * k + 4].split(b"\0")[0].decode("latin-1") or str(k + 1) for k in range(n)]
    step = difference_steps(np.frombuffer(data, np.int8, count=len(data) // n * n))
    x = (np.cumsum(step.reshape(-1, n), axis=0) + before).T * (f["gain"] / 1000.0)
    return Recording(DSC_RATES[f["rate"]], names, x)


def difference_steps(codes: np.ndarray) -> np.ndarray:
    b = codes.astype(np.int32)
    how = b & 3
    return np.where(how == 3, b >> 2, (b & ~3) << (2 * how))


def encode_differences(r: Recording, gain: float = 1000.0) -> dict[str, bytes]:
    """The two files by suffix. Each byte takes the representable step nearest to where the channel should be, so errors do not add up."""
    values, _ = difference_bytes(r.values.T * 1000 / gain, np.zeros(len(r.channels)))
    return {".dsc": dsc_head(r.sfreq, r.channels, r.values.shape[1], gain), ".eeg": values}


def difference_bytes(want: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of points x channels behind a point where the channels are ``at``, and where they are then."""
    codes = np.arange(-128, 128)
    how = codes & 3
    steps = np.where(how == 3, codes >> 2, (codes & ~3) << (2 * how))
    order = np.argsort(steps, kind="stable")
    steps, codes = steps[order], codes[order]
    middle = (steps[1:] + steps[:-1]) / 2
    out = np.empty(want.shape, np.int8)
    for t in range(len(want)):
        k = np.searchsorted(middle, want[t] - at)
        out[t] = codes[k]
        at = at + steps[k]
    return out.tobytes(), at


def dsc_head(sfreq: float, channels: list[str], points: int, gain: float) -> bytes:
    head = bytearray(DSC_SIZE)
    rate = next((k for k, v in DSC_RATES.items() if v == sfreq), None)
    if rate is None:
        raise ValueError("the sampling rate must be 128 or 256 Hz")
    for k, v in {"length": -(-points // 256), "channels": len(channels), "gain": gain, "rate": rate}.items():
        struct.pack_into(DSC_AT[k][1], head, DSC_AT[k][0], v)
    for k, name in enumerate(channels):
        head[DSC_NAMES + 4 * k : DSC_NAMES + 4 * k + 4] = name.encode("latin-1", "replace")[:4].ljust(4, b"\0")
    return bytes(head)


# ------------------------------------------------------------------ text fields in fixed places

#: Places of the file's fields, of the channel records behind the place that the file names, and in a record.
FIELDS_AT = {"header": (16, "<i"), "channels": (20, "<i")}
RECORDS_FROM, RECORD_SIZE = 35, 203
RECORD_TEXT = {"rate": (4, 5, 18), "factor": (82, 83, 18), "label": (166, 167, 8)}
RECORD_OFFSET = 80


def decode_fields(data: bytes) -> Recording:
    """16-bit samples of channels whose rate, factor and offset stand in records of fixed width, texts after their lengths. A channel of a lower rate has more samples in a record, as the format counts them."""
    place = struct.unpack_from(FIELDS_AT["channels"][1], data, FIELDS_AT["channels"][0])[0]
    n = struct.unpack_from("<h", data, place)[0]
    at, rates, factors, offsets, labels = place + RECORDS_FROM, [], [], [], []
    for k in range(n):
        record = data[at + k * RECORD_SIZE : at + (k + 1) * RECORD_SIZE]
        text = {name: record[start : start + min(record[length], most)].split(b"\0")[0].decode("latin-1").strip() for name, (length, start, most) in RECORD_TEXT.items()}
        rates.append(float(text["rate"]))
        factors.append(float(text["factor"]))
        offsets.append(struct.unpack_from("<h", record, RECORD_OFFSET)[0])
        labels.append(text["label"])
    top = max(rates)
    each = [round(top / r) for r in rates]
    longest, total = max(each), sum(each)
    raw = np.frombuffer(data, "<i2", offset=at + n * RECORD_SIZE)
    raw = raw[: len(raw) // total * total].reshape(-1, total).astype(np.float64)
    start = np.concatenate([[0], np.cumsum(each)[:-1]])
    rows = [raw[:, start[k] + (np.arange(longest) * each[k] // longest)].reshape(-1) for k in range(n)]
    f, o = np.array(factors)[:, None], np.array(offsets)[:, None]
    return Recording(top, labels, np.array(rows).reshape(n, -1) * f + o * f)


def samples_each(head: bytes) -> list[int]:
    """Samples of each channel in a record of values."""
    place = struct.unpack_from(FIELDS_AT["channels"][1], head, FIELDS_AT["channels"][0])[0]
    length, start, most = RECORD_TEXT["rate"]
    records = [head[at : at + RECORD_SIZE] for at in range(place + RECORDS_FROM, place + RECORDS_FROM + struct.unpack_from("<h", head, place)[0] * RECORD_SIZE, RECORD_SIZE)]
    rates = [float(r[start : start + min(r[length], most)].split(b"\0")[0].decode("latin-1").strip()) for r in records]
    return [round(max(rates) / r) for r in rates]


def encode_fields(r: Recording, factor: float = 0.01) -> bytes:
    """All channels of one rate; values are rounded to the factor."""
    place = 148
    head = bytearray(place + RECORDS_FROM)
    for name, v in (("header", place + RECORDS_FROM + RECORD_SIZE * len(r.channels)), ("channels", place)):
        struct.pack_into(FIELDS_AT[name][1], head, FIELDS_AT[name][0], v)
    struct.pack_into("<h", head, place, len(r.channels))
    records = []
    for c in r.channels:
        record = bytearray(RECORD_SIZE)
        for name, text in (("rate", f"{r.sfreq:g}"), ("factor", f"{factor:g}"), ("label", c)):
            length, start, most = RECORD_TEXT[name]
            b = text.encode("latin-1", "replace")[:most]
            record[length], record[start : start + len(b)] = len(b), b
        records.append(bytes(record))
    return bytes(head) + b"".join(records) + np.rint(r.values.T / factor).astype("<i2").tobytes()
