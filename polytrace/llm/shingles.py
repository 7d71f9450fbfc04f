"""Near-copies by the Jaccard similarity of their 5-word shingles: all pairs at 4/5 or more are linked.

A document is the set of XXH64 hashes of its shingles (of lower-cased words; fewer than five are one shingle). Documents of equal
sets are merged first, under the hash of the set. Sets with 9 |a & b| >= 4 (|a| + |b|) link.

Finding all links: shingles have one order for all documents, those common in a sample last. A set of n that links shares at
least 4/5 n, so two linked sets share a shingle among the first n - ceil(4/5 n) + 1 of each: only these are dealt out, and sets that
meet are compared by fingerprints, bit-sliced as in ``simhash`` (vertical planes, carry-save counters, blocks abandoned):

* fingerprints hold the parity of the shingles that fall on each bit (512 or 1024 of them): their differing bits are at most the differing
  shingles, so no link is dropped;
* sets of more than ``MIDDLE`` shingles are cut by hash into 2, 4, 8, ... pieces of about half of that or more, of any length of text. What two sets share, and
  their sizes, are the sums of their pieces', so of two that link some piece links with its like: pieces are dealt out and compared in the place of their
  sets, each by parities of its own. Rows and bytes grow with the shingles.

What is left is compared shingle by shingle, as whole sets. The sample decides only how many meet, never what links. SimHash keys alone can't find these links: fingerprints
of linked sets differ in too many bits for a choice of blocks.

Hot groups: the first round compares a spanning forest of the pairs left in each group. Sets that these pairs connect, whether they link or not, hold all links
between each other. Where they are not all connected by links, they are dealt out whole in a second round, in chunks of which each meets each other one (``TILE``) in some task. It counts
the shingles that sets share and returns a spanning forest of the links; pairs that do not link are nowhere written out.

Defined results: null or empty texts are copies of each other; of each component the row with the smallest id stays, once; a row
without an id stays; very long texts are read whole; columns of any name may stand beside; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE, SEED = 5, 42
#: Sets up to SMALL compare by parities of 512 bits, larger ones, which above MIDDLE are pieces, by parities of 1024. A set has a fingerprint of a kind if one
#: that links to it may be compared by it: sizes of linked sets differ by a quarter at most. BITS and RADIUS are those of SimHashes, by which sets above MIDDLE
#: can be compared whole, but not without loss: the stage does not.
SMALL, MIDDLE, PARITIES, BITS, RADIUS = 640, 1600, (512, 1024), 1024, 241
#: Shingles and sets of a chunk at most, on average, and into how many chunks of so many sets smaller groups are cut to spread them.
TILE, TILE_SETS, SPREAD, SPREAD_SETS = 1 << 20, 4096, 8, 256
#: Pairs that a task remembers, so as not to report them again.
REMEMBERED = 500_000
#: Bits of the filter that says which sets are needed: 4 MB at most.
FILTER = 1 << 25
SAMPLE_DOCS, SAMPLE_HEAD = 12_000, 131_072


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.lower().split()
    joined = b" ".join(words)
    xx = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([xx(joined, SEED)] if words else [], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends]]
    return np.unique(np.fromiter((xx(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)), np.uint64, len(words) - SHINGLE + 1))


def key_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of 4/5 or more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def parity(own: np.ndarray, bits: int) -> bytes:
    """The parity of how many shingles fall on each of so many bits."""
    return np.packbits(np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def majority(own: np.ndarray) -> bytes:
    """The SimHash of a set, of ``BITS`` bits."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(own), 4096):
        words = np.empty((min(4096, len(own) - at), BITS // 64), np.uint64)
        for k in range(BITS // 64):
            x = (own[at : at + 4096] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            words[:, k] = x ^ x >> np.uint64(31)
        count += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(own)).tobytes()


def prints_of(own: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The fingerprints of a set by kind; empty where no set that links is compared by them."""
    n = len(own)
    return (
        parity(own, PARITIES[0]) if n <= SMALL else b"",
        parity(own, PARITIES[1]) if 4 * SMALL < 5 * n and n <= MIDDLE else b"",
        majority(own) if 4 * MIDDLE < 5 * n else b"",
    )


def parities_of(own: np.ndarray) -> tuple[bytes, bytes]:
    """The parities of a set or piece by kind; the larger ones serve any size."""
    n = len(own)
    return parity(own, PARITIES[0]) if n <= SMALL else b"", parity(own, PARITIES[1]) if 5 * n > 4 * SMALL else b""


def pieces(own: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """What a sorted set is dealt out as: (number, shingles). The number 0 is the whole set, 2^k + i the i-th of 2^k pieces. It is cut by its own size and,
    where one that links to it may be so large, as the next size is."""
    k = ((len(own) - 1) // MIDDLE).bit_length() if len(own) else 0
    out = [] if k else [(0, own)]
    for level in (k, k + 1) if 5 * len(own) > 4 * (MIDDLE << k) else (k,):
        if level:
            ends = [0, *np.searchsorted(own, np.arange(1, 1 << level, dtype=np.uint64) << np.uint64(64 - level)).tolist(), len(own)]
            out += [((1 << level) + i, own[a:b]) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
    return out


def mixed(x: int, number: int) -> int:
    """A signed key for a piece's number (or level) with a hash; that of 0 is the hash."""
    return ((x ^ number * 0x9E3779B97F4A7C15) + (1 << 63)) % (1 << 64) - (1 << 63)


class Prints:
    """Sizes and fingerprints of some sets, and which of them may link."""

    def __init__(self, sizes: np.ndarray, rows: list[np.ndarray]):
        self.sizes, self.rows = sizes, rows
        self.planes = [simhash.planes_of(x) for x in rows] if len(sizes) > simhash.LAGGED else None

    def near(self, q: int, at: np.ndarray) -> np.ndarray:
        """Those of the positions ``at`` that sizes and fingerprints do not keep from linking with position q."""
        n = self.sizes[q]
        at = at[(5 * self.sizes[at] >= 4 * n) & (4 * self.sizes[at] <= 5 * n)]
        if not len(at):
            return at
        larger = np.maximum(self.sizes[at], n)
        kind = np.minimum((larger > SMALL).astype(int) + (larger > MIDDLE), len(self.rows) - 1)
        return np.concatenate([self._within(k, q, at[kind == k]) for k in range(len(self.rows))])

    def _within(self, kind: int, q: int, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return at
        rows = self.rows[kind]
        if self.planes and 4 * len(at) > len(rows) and len(at) > simhash.LAGGED:
            planes = self.planes[kind]
            most = (int(self.sizes[at].max()) + int(self.sizes[q])) // 9 if kind < 2 else RADIUS
            on = np.zeros(len(rows), bool)
            on[at] = True
            bits = np.unpackbits(rows[q].view(np.uint8), bitorder="little").astype(bool).tolist()
            near = simhash.within(lambda b, w: ~planes[b][w] if bits[b] else planes[b][w], simhash.words_of(on), most, list(range(len(bits))), 32)
            at = simhash.lanes_of(near, len(rows))
        differ = np.bitwise_count(rows[at] ^ rows[q]).sum(axis=1, dtype=np.int64)
        return at[9 * differ <= self.sizes[at] + self.sizes[q]] if kind < 2 else at[differ <= RADIUS]


class Fresh:
    """Leaves out pairs that a task has reported before: a pair meets under many shingles."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()

    def __call__(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = set(pairs) - self.seen
        self.seen |= new
        return sorted(new)


def print_rows(prints: list[bytes], bits: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words; absent ones are zero and not looked at."""
    return np.frombuffer(b"".join([x or bytes(bits // 8) for x in prints]), np.uint64).reshape(-1, bits // 64)


def forest(prints: Prints) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that may link."""
    out, free = [], np.arange(len(prints.sizes))
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            q = queue.pop()
            hit = prints.near(q, free)
            if len(hit):
                free = np.setdiff1d(free, hit, assume_unique=True)
                queue += hit.tolist()
                out += [(q, k) for k in hit.tolist()]
    return out


def joined(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links from the sets of ``left`` to those of ``right`` (boolean) over the roots, found by counting shared shingles."""
    out, size, label = [], np.array([len(x) for x in sets]), np.unique(roots, return_inverse=True)[1]
    at = np.flatnonzero(right)
    if not len(at):
        return out
    flat, owner = np.concatenate([sets[k] for k in at.tolist()]), np.repeat(at, size[at])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for q in np.flatnonzero(left).tolist():
        far = right & (label != label[q])
        if not far.any():
            continue
        first = np.searchsorted(flat, sets[q], "left")
        met = np.searchsorted(flat, sets[q], "right") - first
        every = np.repeat(first - np.cumsum(met) + met, met) + np.arange(met.sum())
        shared = np.bincount(owner[every], minlength=len(sets))
        for k in np.flatnonzero(far & (9 * shared >= 4 * (size + size[q]))).tolist():
            if label[k] != label[q]:
                label[label == label[k]] = label[q]
                out.append((q, k))
    return out


def tiles(rows: DataFrame) -> DataFrame:
    """Rows (_key, n, root, blob) of blobs with several roots, once for each tile of their blob: h, _key, root, and whether on the left and on the right of it."""
    size = rows.groupBy("blob").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    chunks = F.greatest(F.ceil(F.col("shingles") / TILE), F.ceil(F.col("sets") / TILE_SETS), F.least(F.lit(SPREAD), F.ceil(F.col("sets") / SPREAD_SETS)))
    several = size.where("low != high").select("blob", chunks.cast("long").alias("chunks"))
    own, other = F.pmod("_key", "chunks"), F.col("other")
    dealt = rows.join(several, "blob").select("_key", "root", "blob", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    return dealt.select(F.xxhash64("blob", F.least("own", other), F.greatest("own", other)).alias("h"), "_key", "root", (F.col("own") <= other).alias("left"), (F.col("own") >= other).alias("right"))


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by column h, in tables that end with a group."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column("h").to_numpy()
        last = np.flatnonzero(h != h[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut or (kept and kept[-1].column("h")[-1].as_py() != h[0]):
            yield pa.Table.from_batches([*kept, b.slice(0, cut)])
            kept = []
        kept.append(b.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def heads(h: np.ndarray) -> list[tuple[int, int]]:
    at = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def once(batches: Iterator[pa.RecordBatch], at_most: int = 1_000_000) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Keys and sets of a task's rows; copies that a task meets again are left out, so no hot text is dealt out whole."""
    seen: set[int] = set()
    for b in common.sliced(batches, 500):
        found = {}
        for text in common.raw(b, "text"):
            own = shingle_set(text)
            if (key := key_of(own)) not in seen:
                seen.add(key)
                found[key] = own
        if len(seen) > at_most:
            seen.clear()
        if found:
            yield list(found), list(found.values())


def common_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a bounded sample of different texts, sorted, and their counts."""
    sample = docs.select("text")
    if total > SAMPLE_DOCS:
        sample = sample.where(F.xxhash64("text") <= int(SAMPLE_DOCS / total * 2**64) - 2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in once(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["h"])

    met = sample.mapInArrow(run, "h long").groupBy("h").count().where("count > 1")
    rows = sorted((r[0], r[1]) for r in met.orderBy(F.desc("count"), "h").limit(SAMPLE_HEAD).collect())
    return np.array([h for h, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def prefix(own: np.ndarray, hot: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first shingles (signed) of a set in the common order, of which two linked sets share one."""
    signed, n = own.view(np.int64), len(own)
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, signed), len(hot) - 1)
        signed = signed[np.argsort(np.where(hot[at] == signed, count[at], 0), kind="stable")]
    return signed[: n - (4 * n + 4) // 5 + 1] if n else signed


def positions(key: np.ndarray, bits: int) -> np.ndarray:
    """A place in a filter of ``bits`` bits, a power of two, for each key; keys are hashes."""
    return key & (bits - 1)


def filter_of(keys: DataFrame, n: int) -> np.ndarray:
    """A bitmap with the places of all keys (column _key, about n): 16 bits for each, ``FILTER`` at most."""
    bits = 1 << 15
    while bits < FILTER and bits < 16 * n:
        bits *= 2
    parts = keys.select(F.col("_key").bitwiseAND(F.lit(bits - 1).cast("long")).alias("at")).groupBy(F.floor(F.col("at") / 32768).alias("part")).agg(F.bitmap_construct_agg((F.col("at") % 32768).cast("long")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for part, data in parts.collect():  # 4 KB for each part, FILTER / 8 bytes in all
        out[part * 4096 : part * 4096 + 4096] = np.frombuffer(data, np.uint8)
    return out


def links(docs: DataFrame, prints: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) between keys that connect all that are linked; docs: text; prints: of all keys' pieces _key, piece, n, and the fingerprints p0 and p1; total: about how many rows."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(common_shingles(docs, total))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = order.value
        for keys, sets in once(batches):
            cut = [(mixed(k, number), number, x) for k, own in zip(keys, sets, strict=True) for number, x in pieces(own)]
            own = [prefix(x, hot, count) for _, _, x in cut]
            # pieces meet their likes only: the level enters into the shingle's hash, which tells the rest
            own = [x ^ np.int64(mixed(0, number.bit_length())) if number else x for x, (_, number, _) in zip(own, cut, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(np.array([k for k, _, _ in cut], np.int64), [len(x) for x in own]))], names=["h", "piece"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            h, piece = (t.column(c).to_numpy() for c in ("h", "piece"))
            new = np.append(True, (h[1:] != h[:-1]) | (piece[1:] != piece[:-1]))
            h, piece = h[new], piece[new]
            same = np.append(h[1:] == h[:-1], False)
            same[1:] |= same[:-1].copy()
            yield pa.RecordBatch.from_arrays([pa.array(h[same]), pa.array(piece[same])], names=["h", "piece"])

    dealt = docs.select("text").mapInArrow(deal, "h long, piece long")
    met = common.stored(dealt.repartition("h").sortWithinPartitions("h", "piece").mapInArrow(shared, "h long, piece long"), "met")
    groups = met.join(prints, "piece").drop("piece")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for t in whole_groups(batches):
            h, key, size = (t.column(c).to_numpy() for c in ("h", "_key", "n"))
            rows = [print_rows(t.column(f"p{k}").to_pylist(), bits) for k, bits in enumerate(PARITIES)]
            found = []
            for a, b in heads(h):
                if b - a > 1:
                    found += [(a + x, a + y) for x, y in forest(Prints(size[a:b], [r[a:b] for r in rows]))]
            x, y = (key[np.array([f[k] for f in found], np.int64)] for k in (0, 1))
            new = fresh(list(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in new], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 500):
            x, y = ([np.frombuffer(s, np.uint64) for s in b.column(c).to_pylist()] for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([linked(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())], names=["a", "b", "ok"])

    def within_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            h, key, root, left, right = (t.column(c).to_numpy() for c in ("h", "_key", "root", "left", "right"))
            for a, b in heads(h):
                own = [np.frombuffer(x, np.uint64) for x in t.column("own").slice(a, b - a).to_pylist()]
                new = joined(own, root[a:b], left[a:b], right[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([key[a + p[k]] for p in new], pa.int64()) for k in (0, 1)], names=["a", "b"])

    found = common.stored(groups.repartition("h").sortWithinPartitions("h", "_key").mapInArrow(pairs, "a long, b long").distinct(), "first-pairs")
    needed = filter_of(found.select(F.explode(F.array("a", "b")).alias("_key")).distinct(), 2 * found.count())
    wanted = spark.sparkContext.broadcast(needed)  # so that only sets of some pair travel, and a few more

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, own in once(batches):
            at = positions(np.array(keys, np.int64), 8 * len(wanted.value))
            on = np.flatnonzero(wanted.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()
            if on:
                yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in on], pa.int64()), pa.array([own[k].tobytes() for k in on], pa.binary())], names=["_key", "own"])

    sets = common.stored(docs.select("text").mapInArrow(whole, "_key long, own binary").dropDuplicates(["_key"]), "first-sets")
    x, y = (sets.select(F.col("_key").alias(k), F.col("own").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    first = common.stored(found.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long, ok boolean"), "first")
    edges = first.where("ok").select("a", "b")
    if first.where("not ok").isEmpty():
        return edges
    blob = simhash.components(found).withColumnRenamed("root", "blob")
    nodes = sets.select("_key", (F.octet_length("own") / 8).cast("long").alias("n"), F.xxhash64("_key").alias("node")).join(blob, "node")
    rooted = nodes.join(simhash.components(edges), "node", "left").select("_key", "n", "blob", F.coalesce("root", "node").alias("root"))
    dealt = common.stored(tiles(common.stored(rooted, "rooted")), "tiles").join(sets, "_key")
    second = dealt.repartition("h").sortWithinPartitions("h", "_key").mapInArrow(within_tiles, "a long, b long")
    return edges.union(common.stored(second, "second"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near-copies: of each component the row with the smallest id stays, once. A row without an id stays."""
    key, text = common.unused(df, "key"), common.unused(df, "text")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 500):
            own = [shingle_set(t) for t in common.raw(b, "text")]
            keys, cut = [key_of(x) for x in own], [pieces(x) for x in own]
            prints = [parities_of(x) for c in cut for _, x in c]
            columns = [pa.array([mixed(k, number) for k, c in zip(keys, cut, strict=True) for number, _ in c], pa.int64()), pa.array([len(x) for c in cut for _, x in c], pa.int64())]
            columns += [pa.array([p[k] for p in prints], pa.binary()) for k in range(2)]
            held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cut)]), pa.int32()), pa.StructArray.from_arrays(columns, names=["piece", "n", "p0", "p1"]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.int64()), held], names=["id", "_key", "pieces"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 500):
            keys = [key_of(shingle_set(t)) for t in common.raw(b, text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, key])

    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = common.stored(docs.mapInArrow(described, f"id {docs.schema['id'].dataType.simpleString()}, _key long, pieces array<struct<piece:bigint,n:bigint,p0:binary,p1:binary>>"), "rows")
    unique = common.stored(rows.groupBy("_key").agg(F.min("id").alias("least"), F.first("pieces").alias("pieces")), "unique-sets")
    found = simhash.components(links(docs, unique.select("_key", F.inline("pieces")), rows.count()))
    rooted = unique.select("_key", "least", F.xxhash64("_key").alias("node")).join(found, "node", "left").select("_key", "least", F.coalesce("root", "node").alias("root"))
    first = rooted.where("least is not null").groupBy("root").agg(F.min(F.struct("least", "_key")).alias("first"))
    first = common.stored(first.select(F.col("first.least").alias(id_col), F.col("first._key").alias(key)), "first-rows")
    if rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        kept = df.join(first, id_col, "left_semi")
    else:  # an id of several rows does not tell which of them stays
        source = df.withColumn(text, F.col(text_col).cast("string"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
        kept = source.mapInArrow(keyed, f"{columns}, `{key}` long").join(first, [id_col, key], "left_semi").dropDuplicates([id_col, key]).select(*df.columns)
    return kept.unionByName(df.where(F.col(id_col).isNull()))
