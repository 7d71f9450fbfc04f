"""Recording files of laboratory systems, as pure functions between bytes and arrays."""

from __future__ import annotations

import struct

import numpy as np

from .formats import Recording, named

# ------------------------------------------------------------------ volts behind a header for 32 channels

#: Fixed places in the header and in each channel's record; all 32 records are there, whatever the number of channels.
VOLTS_AT = {"channels": (42, "<h"), "sfreq": (76, "<f"), "samples": (80, "<I")}
VOLTS_HEADER, VOLTS_RECORD, VOLTS_CHANNELS, VOLTS_SITE = 1108, 580, 32, (32, 30)


def decode_volts(data: bytes) -> Recording:
    """Single-precision values in volts, channels adjacent; they become microvolts. Channels are named by their sites, or by number."""
    f = {k: struct.unpack_from(code, data, at)[0] for k, (at, code) in VOLTS_AT.items()}
    n, (site, width), names = f["channels"], VOLTS_SITE, []
    for k in range(n):
        at = VOLTS_HEADER + k * VOLTS_RECORD + site
        names.append(data[at : at + width].split(b"\0")[0].decode("latin-1").strip() or str(k + 1))
    x = np.frombuffer(data, "<f4", offset=VOLTS_HEADER + VOLTS_CHANNELS * VOLTS_RECORD, count=max(0, len(data) - VOLTS_HEADER - VOLTS_CHANNELS * VOLTS_RECORD) // (4 * n) * n)
    return Recording(float(f["sfreq"]), names, x.astype(np.float64).reshape(-1, n).T * 1e6)


def encode_volts(r: Recording) -> bytes:
    n = len(r.channels)
    if n > VOLTS_CHANNELS:
        raise ValueError(f"the header has room for {VOLTS_CHANNELS} channels")
    head = bytearray(VOLTS_HEADER + VOLTS_CHANNELS * VOLTS_RECORD)
    for k, v in {"channels": n, "sfreq": r.sfreq, "samples": r.values.shape[1]}.items():
        struct.pack_into(VOLTS_AT[k][1], head, VOLTS_AT[k][0], v)
    site, width = VOLTS_SITE
    for k, name in enumerate(r.channels):
        b = name.encode("latin-1", "replace")[: width - 1]
        at = VOLTS_HEADER + k * VOLTS_RECORD + site
        head[at : at + len(b)] = b
    return bytes(head) + (r.values.T / 1e6).astype("<f4").tobytes()


# ------------------------------------------------------------------ blocks found through tables of their places

#: Fixed values, big-endian: where the first table is, its entries, and the two parts of a block's header.
TABLE_AT, TABLE_ENTRIES, BLOCK_TIMES, BLOCK_SIZES = 192, 128, 26, ">2I"


def block_places(data: bytes) -> list[int]:
    """Where the blocks are: the first table's entries up to a zero; behind its last block stand the places of further tables, up to a zero."""

    def table(at: int) -> list[int]:
        entries = np.frombuffer(data, ">i4", TABLE_ENTRIES, at).tolist()
        return entries[: entries.index(0)] if 0 in entries else entries

    out = table(TABLE_AT)
    if not out:
        return []
    points, channels = struct.unpack_from(BLOCK_SIZES, data, out[-1] + BLOCK_TIMES)
    at = out[-1] + BLOCK_TIMES + 8 + 4 * points * channels + 4
    while at + 4 <= len(data) and (more := struct.unpack_from(">i", data, at)[0]):
        out += table(more)
        at += 4
    return out


def decode_blocks(data: bytes) -> Recording:
    """Blocks of one second each, one after another; the points of a block are the sampling rate. A block of other sizes than the first begins what is not read."""
    parts, size = [], None
    for at in block_places(data):
        points, channels = struct.unpack_from(BLOCK_SIZES, data, at + BLOCK_TIMES)
        if (points, channels) != (size := size or (points, channels)):
            break
        parts.append(np.frombuffer(data, ">f4", points * channels, at + BLOCK_TIMES + 8).reshape(points, channels))
    if not parts:
        return Recording(0.0, [], np.zeros((0, 0)))
    return Recording(float(size[0]), named(size[1]), np.concatenate(parts).T.astype(np.float64))


def encode_blocks(r: Recording) -> bytes:
    """Whole seconds only; the tables stand before the blocks, each of 128 places."""
    per, n = round(r.sfreq), len(r.channels)
    blocks = r.values.shape[1] // per
    head, links = block_tables(blocks, per, n)
    body = [block_bytes(r.values[:, k * per : (k + 1) * per]) for k in range(blocks)]
    return head + b"".join([*body[:TABLE_ENTRIES], links, *body[TABLE_ENTRIES:]])


def block_tables(blocks: int, per: int, n: int) -> tuple[bytes, bytes]:
    """What stands before the first block, and behind the first table's last one."""
    tables = max(1, -(-blocks // TABLE_ENTRIES))
    size = BLOCK_TIMES + 8 + 4 * per * n
    first_end = min(blocks, TABLE_ENTRIES)
    start = TABLE_AT + 4 * TABLE_ENTRIES * tables
    gap = 4 + 4 * tables  # behind the first table's last block: the way back, the places of further tables and a zero
    at = [start + k * size + (gap if k >= first_end else 0) for k in range(blocks)]
    head = bytearray(start)
    for k, place in enumerate(at):
        struct.pack_into(">i", head, TABLE_AT + 4 * k, place)
    return bytes(head), struct.pack(f">{1 + tables}i", 0, *[TABLE_AT + 4 * TABLE_ENTRIES * k for k in range(1, tables)], 0)


def block_bytes(x: np.ndarray) -> bytes:
    """A block of channels x points."""
    n, per = x.shape
    return struct.pack(">9H2I", *[0] * 11) + struct.pack(BLOCK_SIZES, per, n) + x.T.astype(">f4").tobytes()
