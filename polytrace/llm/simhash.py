"""Near-duplicates by SimHash with a bit-sliced comparison.

A document's fingerprint has a bit for each majority among the XXH64 hashes of its
3-word shingles. Fingerprints link at ``radius`` or fewer differing bits.

Finding all links: a fingerprint is cut into ``BLOCKS`` blocks; two that differ in at most
``radius`` bits agree on all but ``radius`` blocks, so each fingerprint is dealt out once for each choice
of the other blocks (28 keys of 48 bits for radius 2), and linked ones meet under some key. A key leaves 16
bits free, so no group exceeds 2^16 distinct fingerprints however hot a document is: copies are merged first.
Within groups the comparison is vertical: bit planes hold one bit of many
fingerprints, carry-save counters add up the differences of 64 fingerprints in a few word
operations, and words whose 64 lanes all exceed the radius are abandoned. Groups emit a
spanning forest of their links, not all pairs.

Components come from contracting the link graph round by round on the cluster, each round written to the shared folder.

Defined results: null or empty text has fingerprint 0 and links like any other; fewer than
three words are one shingle; a bit set in exactly half the hashes is 0; very long texts are hashed whole, 65,536 shingles at a time; rows with equal ids are separate rows of one component each by its own text;
a null id never names a component (one of null ids only has a null component_id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, SEED, RADIUS, BLOCKS = 3, 42, 2, 8
#: Groups above so many fingerprints are searched one query against all, breadth first.
LAGGED = 32


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends]]
    xx = xxhash.xxh64_intdigest
    set_bits, n = np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        h = np.array([xx(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + SHINGLE - 1 : to + SHINGLE - 1], strict=True)], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col`` and fp, the fingerprint as a signed 64-bit integer."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 2000):
            fp = np.array([fingerprint(t) for t in common.raw(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], names=["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


# ------------------------------------------------------------------ bit-sliced comparison


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes of uint64 words, 64 for each word of a fingerprint: bit i of plane b is bit b of fingerprint i."""
    n = len(fps)
    own = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    bits = np.zeros((own.shape[1], -(-n // 64) * 64), np.uint8)
    bits[:, :n] = own.T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def words_of(mask: np.ndarray) -> np.ndarray:
    """A boolean array as uint64 words."""
    bits = np.zeros(-(-len(mask) // 64) * 64, np.uint8)
    bits[: len(mask)] = mask
    return np.packbits(bits, bitorder="little").view(np.uint64)


def lanes_of(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


class Counter64:
    """Carry-save counters, one in each bit lane: add a word of ones, ask which lanes exceed a radius."""

    def __init__(self, words: int, radius: int):
        self.radius = radius
        self.digits = [np.zeros(words, np.uint64) for _ in range(max(1, (radius + 1).bit_length()))]
        self.over = np.zeros(words, np.uint64)

    def add(self, x: np.ndarray) -> None:
        for d in self.digits:
            carry = d & x
            d ^= x
            x = carry
        self.over |= x

    def exceeded(self) -> np.ndarray:
        greater, equal = self.over.copy(), ~np.zeros_like(self.over)
        for k in range(len(self.digits) - 1, -1, -1):
            if self.radius >> k & 1:
                equal &= self.digits[k]
            else:
                greater |= equal & self.digits[k]
                equal &= ~self.digits[k]
        return greater

    def keep(self, at: np.ndarray) -> None:
        self.digits = [d[at] for d in self.digits]
        self.over = self.over[at]


def within(diff, alive: np.ndarray, radius: int, order: list[int], step: int = 8) -> np.ndarray:
    """Lanes of ``alive`` whose differing bits number at most ``radius``. ``diff(plane, words)`` gives the differences in
    one plane at some words. After every ``step`` planes, words without a lane left are abandoned."""
    out = np.zeros_like(alive)
    at = np.flatnonzero(alive)
    left, count = alive[at], Counter64(len(at), radius)
    for k in range(0, len(order), step):
        if not len(at):
            return out
        for b in order[k : k + step]:
            count.add(diff(b, at))
        left = left & ~count.exceeded()
        on = left != 0
        if not on.all():
            at, left = at[on], left[on]
            count.keep(on)
    out[at] = left
    return out


def shifted(plane: np.ndarray, lag: int) -> np.ndarray:
    """Bit i of the result is bit i + lag of the plane."""
    words, bits = divmod(lag, 64)
    out = np.zeros_like(plane)
    out[: len(plane) - words] = plane[words:]
    if bits:
        out >>= np.uint64(bits)
        out[: len(plane) - words - 1] |= plane[words + 1 :] << np.uint64(64 - bits)
    return out


def forest_edges(run: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each run of equal ``run`` numbers, as positions (a, b).

    ``fps`` are sorted by run, distinct within one.
    """
    n = len(fps)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(heads, n))
    a_out, b_out = [], []
    small = np.repeat((sizes > 1) & (sizes <= LAGGED), sizes)
    if small.any():
        where = np.flatnonzero(small)
        r, planes = run[where], planes_of(fps[where])
        a_all, b_all = [], []
        for lag in range(1, min(LAGGED, len(where))):
            same = np.zeros(len(where), bool)
            same[:-lag] = r[:-lag] == r[lag:]
            if not same.any():
                break
            moved: dict[int, np.ndarray] = {}

            def diff(b: int, at: np.ndarray, moved=moved, lag=lag) -> np.ndarray:
                if b not in moved:
                    moved[b] = planes[b] ^ shifted(planes[b], lag)
                return moved[b][at]

            hit = lanes_of(within(diff, words_of(same), radius, list(range(64))), len(where))
            a_all.append(hit)
            b_all.append(hit + lag)
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        root = np.arange(len(where))
        while True:  # each linked pair takes the smaller root until nothing changes
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        moved_to = np.flatnonzero(root != np.arange(len(where)))
        a_out.append(where[root[moved_to]])
        b_out.append(where[moved_to])
    for head, size in zip(heads[sizes > LAGGED].tolist(), sizes[sizes > LAGGED].tolist(), strict=True):
        x = fps[head : head + size]
        planes, free, queue = planes_of(x), words_of(np.ones(size, bool)), []
        varied = [b for b in range(64) if (bits := (x >> np.uint64(b)) & np.uint64(1)).any() and not bits.all()]
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        for first in range(size):
            if not int(free[first >> 6]) >> (first & 63) & 1:
                continue
            free[first >> 6] &= ~np.uint64(1 << (first & 63))
            queue = [first]
            while queue:
                q = queue.pop()
                v = int(x[q])
                near = within(lambda b, at, v=v: planes[b][at] ^ (ones if v >> b & 1 else np.uint64(0)), free, radius, varied)
                hit = lanes_of(near, size)
                if len(hit):
                    free &= ~near
                    queue += hit.tolist()
                    a_out.append(np.full(len(hit), head + q))
                    b_out.append(head + hit)
    if not a_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a_out), np.concatenate(b_out)


# ------------------------------------------------------------------ links and components


def masks(radius: int, blocks: int) -> list[int]:
    """One mask for each choice of ``blocks - radius`` of the blocks, as signed integers."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    out = [sum(block) - sum(gone) for gone in combinations(block, radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(unique: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that are linked."""
    keys = F.explode(F.array(*[F.struct(F.lit(k).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks(radius, blocks))])).alias("key")
    dealt = unique.select("fp", keys).select("key.choice", "key.part", "fp").repartition("choice", "part").sortWithinPartitions("choice", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int16), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def edges(choice: np.ndarray, part: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (choice[1:] != choice[:-1]) | (part[1:] != part[:-1])) if len(fps) else np.zeros(0, bool)
            run = np.cumsum(new)
            a, b = forest_edges(run, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

        for batch in batches:
            own = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            choice, part, fps = (np.concatenate(x) for x in zip(kept, own, strict=True))
            last = np.flatnonzero((choice != choice[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            yield edges(choice[:cut], part[:cut], fps[:cut])
            kept = [choice[cut:], part[cut:], fps[cut:]]
        yield edges(*kept)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: 64-bit integers): equal roots where connected.

    Each round every node points to its smallest neighbour, pointers are doubled once, and edges are redrawn between the
    ends; loops go. Nodes are numbered by a hash (one-to-one on 64-bit integers), so chains are short
    and rounds few. Minima are summed before they are dealt out, and joins on hot nodes can be split.
    """
    now = common.stored(edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).where("a != b"), "edges")
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), f"to-{len(rounds)}")
        twice = to.select(F.col("node").alias("to"), F.col("to").alias("end"))
        to = common.stored(to.join(twice, "to").select("node", F.col("end").alias("to")), f"round-{len(rounds)}")
        rounds.append(to)
        a = to.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("y"))
        redrawn = now.join(a, "a").join(b, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        now = common.stored(redrawn.distinct(), f"edges-{len(rounds)}")
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select("node", F.col("to").alias("root"))
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per row: ``id_col``, fp (signed) and component_id, the smallest id that links lead to."""
    fps = common.stored(fingerprints(df, id_col, text_col), "fingerprints")
    unique = common.stored(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "unique")
    found = components(links(unique, radius, blocks))
    rooted = common.stored(unique.select("fp", "least", F.xxhash64("fp").alias("node")).join(found, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = common.stored(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row with the smallest id stays, once. A row without an id stays."""
    found = common.stored(near_duplicates(df, id_col, text_col, radius, blocks), "components")
    first = found.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = df.join(first, id_col, "left_semi")
    again = found.where(F.col(id_col).isNotNull()).groupBy(id_col, "fp").count().where("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept.unionByName(df.where(F.col(id_col).isNull()))
