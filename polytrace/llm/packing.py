"""Packing tokenised documents into fixed windows by minimum bin slack.

Documents are tokenised and packed where they are read: a task takes documents
until it holds ``block_tokens`` ids, packs that block, keeps what fills no
window for its next block, and goes on. Nothing is shuffled, memory is bounded by
the block and the longest document, and a task that is run again gives the same
windows from the same rows.

In a block, documents of a window or more give full windows from their start. The
remainders go into a multiset of lengths. Each window starts with the longest
remainder; a subset-sum dynamic program over the other lengths, in a bitset
(one big integer, a bit for each reachable sum), finds the multiset with the least slack,
and the bitsets of each stage are walked back to get how many of each length it takes. Where some
slack is left, one document is cut to fill it. So all windows are full but for the last of a task,
whose rest is cut at powers of two, which need no padding.

Defined results: null or empty text is the end token alone; an empty table gives no rows;
repeated rows are packed as separate documents; of equal lengths the one read first is placed first; very long texts fill whole windows from
their start; other columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import CACHE, byte_letters, latin_words, lowered

CAPACITY = 4096
END_ID = 2


class ChunkTokenizer:
    """The library's tokenizer, with the ids of chunks between ASCII white space remembered.

    A chunk goes through the library's normaliser and its BPE model; texts that hold a special token's
    marks go through the library whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merge = self.whole.model.tokenize
        self.normalize, self.cut = self.whole.normalizer.normalize_str, self.whole.pre_tokenizer.pre_tokenize_str
        spec = json.loads(self.whole.to_str())
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.marks = {t["content"][:2].encode() for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}

    def chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            words = [chunk.decode()]
        elif chunk[:-1].isalpha() and chunk[-1:] in (b".", b","):
            left, right = self.known.get(chunk[:-1]), self.known.get(chunk[-1:])
            if left and right:
                return left + right
            words = [chunk[:-1].decode(), chunk[-1:].decode()]
        elif (text := chunk.decode()).isascii() and text.isprintable():
            words = self.words.findall(text)
        elif (latin := latin_words(text)) is not None:
            words = ["".join([self.letters[b] for b in w.encode()]) for w in latin]
        else:
            words = [w for w, _ in self.cut(self.normalize(text))]
        ids = [t.id for w in words for t in self.merge(w)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole UTF-8 text."""
        if any(m in text for m in self.marks):
            ids = self.whole.encode(text.decode(), add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        known = self.known
        chunks = lowered(text)
        found = list(map(known.get, chunks))
        if None in found:
            for k, got in enumerate(found):
                if got is None:
                    chunk = chunks[k]
                    got = known.get(chunk)
                    if got is None:
                        got = self.chunk(chunk)
                        if len(known) < CACHE and len(chunk) < 64:
                            known[chunk] = got
                    found[k] = got
        return b"".join(found)


_LOADED: dict[str, ChunkTokenizer] = {}


def loaded(path: str) -> ChunkTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]


def least_slack(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The multiset of ``lengths`` (ascending, with ``counts``) whose sum comes closest to ``room``
    from below, as (length, how many); longer ones are tried first.

    Bit s of a stage's bitset says that sum s can be reached with the lengths so far. A length with count c
    takes the binary parts of c, so a stage costs log2(c) shifts.
    """
    mask = (1 << (room + 1)) - 1
    reach, stages = 1, []
    for k in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[k]
        left = min(counts[length], room // length)
        stages.append((length, left, reach))
        part = 1
        while left > 0:
            take = min(part, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, []
    for length, most, before in reversed(stages):
        took = 0
        while not before >> total & 1:
            total -= length
            took += 1
        if took:
            out.append((length, took))
    return out


class Packer:
    """Windows of one task. ``pool`` maps a remaining length to its documents (key, start)."""

    def __init__(self, capacity: int):
        self.capacity, self.pool, self.lengths, self.counts, self.total = capacity, {}, [], {}, 0

    def put(self, key: int, start: int, length: int) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
            self.counts[length], self.pool[length] = 0, []
        self.counts[length] += 1
        self.pool[length].append((key, start))
        self.total += length

    def get(self, length: int) -> tuple[int, int]:
        key, start = self.pool[length].pop()
        self.counts[length] -= 1
        self.total -= length
        if not self.counts[length]:
            del self.counts[length], self.pool[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return key, start

    def fill(self, room: int) -> list[tuple[int, int, int]]:
        """Pieces (key, start, length) that fill ``room`` exactly; needs a total of at least that."""
        pieces, free = [], room
        first = self.lengths[min(bisect_left(self.lengths, room + 1), len(self.lengths)) - 1] if self.lengths[0] <= room else 0
        if first:
            pieces.append((*self.get(first), first))
            free -= first
            for length, n in least_slack(self.lengths, self.counts, free) if free else []:
                for _ in range(n):
                    pieces.append((*self.get(length), length))
                    free -= length
        if free:
            longest = self.lengths[-1]
            key, start = self.get(longest)
            pieces.append((key, start, free))
            self.put(key, start + free, longest - free)
        return pieces

    def add(self, key: int, n: int) -> Iterator[list[tuple[int, int, int]]]:
        """A document's full windows; its remainder goes to the pool."""
        for start in range(0, n - n % self.capacity, self.capacity):
            yield [(key, start, self.capacity)]
        if n % self.capacity:
            self.put(key, n - n % self.capacity, n % self.capacity)

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        while self.total >= self.capacity:
            yield self.fill(self.capacity)

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        while self.total:
            yield self.fill(1 << (self.total.bit_length() - 1))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block_tokens: int = 1 << 21, emit_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``emit_ids`` the piece's ids. ``capacity`` must be a power of two."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if emit_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer, crc = loaded(tokenizer), Packer(capacity), zlib.crc32
        end = struct.pack("<I", END_ID)
        docs: dict[int, tuple[object, bytes]] = {}
        base, sequence, key, held, id_type = TaskContext.get().partitionId() << 36, 0, 0, 0, None

        def rows(windows: Iterator[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in range(8)]
            for pieces in windows:
                offset = 0
                for k, start, length in pieces:
                    name, ids = docs[k]
                    part = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(out, (name, start, length, crc(part), len(ids) // 4, base + sequence, offset, part), strict=True):
                        c.append(v)
                    offset += length
                sequence += 1
            ids = out.pop()
            columns = [pa.array(out[0], id_type), *(pa.array(c, pa.int64()) for c in out[1:])]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if emit_ids:
                columns.append(pa.array([struct.unpack(f"<{len(x) // 4}I", x) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names=names)

        def block(new: list[int]) -> Iterator[list[tuple[int, int, int]]]:
            for k in new:
                yield from packer.add(k, len(docs[k][1]) // 4)
            yield from packer.windows()

        new: list[int] = []
        for b in batches:
            id_type = b.schema.field("id").type
            for name, text in zip(b.column("id").to_pylist(), common.raw(b, "text"), strict=True):
                ids = tok.ids(text) + end
                docs[key] = (name, ids)
                new.append(key)
                held += len(ids) // 4
                key += 1
                if held >= block_tokens:
                    yield rows(block(new))
                    left = {k for x in packer.pool.values() for k, _ in x}
                    docs = {k: docs[k] for k in left}
                    new, held = [], 0
        if docs:
            yield rows(block(new))
            yield rows(packer.rest())

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
