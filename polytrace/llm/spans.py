"""Repeated passages: runs of several consecutive sentences that occurred before go.

A text is cut into sentences at ``.``, ``!`` or ``?`` before white space and at line
ends. A sentence of over ``LONG`` words is cut further after words whose checksum says so, which depends on the
words alone and so falls alike in every copy, wherever it stands. From every sentence on, the run of the
next few (``RUN`` at least, and as many as hold ``WORDS`` words) is hashed (XXH64 of its lower-cased words). Runs are joined over the whole
table: the document with the smallest id that holds a run keeps it, in all others the sentences it covers go; within one
document the first occurrence stays.

Runs are summed to a first and a last holder before they are dealt out, and the join back can be split, so a passage that a third of
all documents share lands in no single task. A hash of 64 bits makes
one wrong link in N^2 / 2^65 for N different runs.

Defined results: null text stays null, empty stays empty; a document without an id gives nobody's passage a first holder and
loses only its own repeats; rows with equal ids count as one document, so of repeated rows each keeps its passages; very long texts are cut and hashed whole; an empty table gives no rows; all other columns stay,
except that names of the four result columns are taken over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN, WORDS, LONG, CUT = 3, 12, 16, 4

_END = re.compile(rb"[.!?][)\"'\]]*[ \t\r\x0b\x0c]+|\n[ \t\n\r\x0b\x0c]*")
_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*")


def sentences(text: bytes, long: int = LONG, cut: int = CUT) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, lower-cased words) of the sentences; they cover the text, and each but perhaps the last has words."""
    out, at = [], 0
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    lower = text.lower()
    for end in ends:
        words = lower[at:end].split()
        if not words and end < len(text):
            continue  # white space goes to the next sentence
        if len(words) <= long:
            out.append((at, end, words))
        else:
            start, held, to = at, [], at
            for m in _WORD.finditer(lower, at, end):
                w = m[0].split()[0]
                held.append(w)
                to = m.end()
                if zlib.crc32(w) % cut == 0:
                    out.append((start, to, held))
                    start, held = to, []
            if held:
                out.append((start, end, held))
        at = end
    return out


def run_hashes(parts: list[tuple[int, int, list[bytes]]], run: int = RUN, words: int = WORDS) -> list[tuple[int, int]]:
    """(hash, end) of the run that starts at each sentence: the fewest sentences, at least ``run``, with at least ``words`` words.
    Starts without enough text after them give none."""
    joined = [b" ".join(p[2]) for p in parts]
    n, out, end, held = [len(p[2]) for p in parts], [], 0, 0
    xx = xxhash.xxh64_intdigest
    for k in range(len(parts)):
        while end < len(parts) and (end - k < run or held < words):
            held += n[end]
            end += 1
        if end - k < run or held < words:
            break
        out.append((xx(b"\n".join(joined[k:end])) - (1 << 63), end))
        held -= n[k]
    return out


def covered(hashes: list[tuple[int, int]], gone: set[int], n: int) -> list[bool]:
    """Which of n sentences lie in a run that is in ``gone`` or occurred before in this text."""
    out, seen = [False] * n, set()
    for k, (h, end) in enumerate(hashes):
        if h in gone or h in seen:
            out[k:end] = [True] * (end - k)
        seen.add(h)
    return out


def clean(text: bytes, gone: set[int], run: int = RUN, words: int = WORDS) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The text without covered sentences, the number of sentences, and the byte ranges removed."""
    parts = sentences(text)
    hashes = run_hashes(parts, run, words)
    drop = covered(hashes, gone, len(parts))
    if True not in drop:
        return text, len(parts), []
    kept = b"".join([text[a:b] for (a, b, _), d in zip(parts, drop, strict=True) if not d])
    ranges: list[list[int]] = []
    for (a, b, _), d in zip(parts, drop, strict=True):
        if d and ranges and ranges[-1][1] == a:
            ranges[-1][1] = b
        elif d:
            ranges.append([a, b])
    return kept.rstrip(common.ASCII_SPACE), len(parts), [tuple(r) for r in ranges]


def repeated_runs(df: DataFrame, id_col: str, text_col: str, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(id, gone): for each document the hashes of its runs that a document with a smaller id holds."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 500):
            index, values = [], []
            for k, text in enumerate(common.raw(b, "text")):
                own = {h for h, _ in run_hashes(sentences(text), run, words)}
                index += [k] * len(own)
                values += own
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(index, pa.int64())), pa.array(np.array(values, np.int64))], names=["id", "h"])

    kind = source.schema["id"].dataType.simpleString()
    runs = common.stored(source.mapInArrow(hashes, f"id {kind}, h long"), "runs")
    first = runs.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "first")
    later = runs.join(first, "h").where(F.col("id") > F.col("first"))
    return later.groupBy("id").agg(F.collect_set("h").alias("gone"))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """``df`` with repeated passages removed from ``text_col``, and n_sentences, n_removed (ranges), removed_bytes and emptied
    (the text had words and has none left)."""
    gone = repeated_runs(df, id_col, text_col, run, words)
    added = ["n_sentences", "n_removed", "removed_bytes", "emptied"]
    rest = [c for c in df.columns if c not in added]
    inner = [f"c{k}" for k in range(len(rest))]
    source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, inner, strict=True)])
    the_id, the_text = inner[rest.index(id_col)], inner[rest.index(text_col)]
    joined = source.withColumn(the_text, F.col(the_text).cast("string")).join(gone, F.col(the_id) == F.col("id"), "left").drop("id")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 500):
            out = []
            for text, hashes in zip(b.column(the_text).cast(pa.binary()).to_pylist(), b.column("gone").to_pylist(), strict=True):
                if text is None:
                    out.append((None, 0, 0, 0, False))
                    continue
                kept, n, ranges = clean(text, set(hashes or ()), run, words)
                out.append((kept.decode(), n, len(ranges), sum(y - x for x, y in ranges), bool(ranges) and not kept.split()))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([made[0] if n == the_text else b.column(n) for n in inner] + made[1:], names=[*inner, *added])

    schema = ", ".join(f"{n} {joined.schema[n].dataType.simpleString()}" for n in inner) + ", n_sentences long, n_removed long, removed_bytes long, emptied boolean"
    return joined.mapInArrow(apply, schema).toDF(*rest, *added)
