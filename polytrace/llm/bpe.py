"""Byte-pair encoding and decoding with a published vocabulary.

``encode_word`` merges by a priority queue: every adjacent pair that has a
merge enters a heap as (rank, position); symbols form a doubly linked list, so a
merge is two pointer updates; a heap entry whose pair has changed since is stale
and skipped. Decoding concatenates vocabulary strings.

Text is cut at ASCII white space first. The vocabulary's normaliser and its
word pattern never look across white space, so a chunk always has the same ids,
and each worker remembers the chunks it has met (at most ``CACHE`` of them, which
bounds its memory; later ones are encoded each time). Chunks beyond ASCII are lowered and cut into words by the
library's own normaliser and pre-tokenizer, as Unicode tables differ between libraries; merging is done here for all.

Defined results: null or empty text has no ids and decodes to the empty string; of equal ranks the leftmost pair merges first;
very long texts and words are encoded whole; rows are independent, so repeated rows give repeated results; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Chunks of text that one worker remembers, about 300 bytes each.
CACHE = 500_000
#: The bytes that occur in UTF-8 text up to U+00FF: no combining marks are among its characters.
LATIN = bytes(range(0xC4))
_LATIN_WORD = regex.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBPE:
    """The vocabulary in a tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_file(path)
        self.normalize, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        #: pair of ids in one number -> (rank, id of the merged symbol)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = (rank, self.vocab[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.marks = {x[:2].encode() for x in self.special}
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word, given as UTF-8."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        heap = []
        for at in range(n - 1):
            m = merges.get(ids[at] << 20 | ids[at + 1])
            if m is not None:
                heap.append(m[0] << 32 | at)
        if not heap:
            return ids
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            at = top & 0xFFFFFFFF
            if ids[at] < 0:
                continue
            right = after[at]
            if right < 0:
                continue
            m = merges.get(ids[at] << 20 | ids[right])
            if m is None or m[0] != top >> 32:
                continue  # stale: one of the two symbols has changed
            ids[at] = new = m[1]
            ids[right] = -1
            after[at] = right = after[right]
            if right >= 0:
                before[right] = at
                m = merges.get(new << 20 | ids[right])
                if m is not None:
                    push(heap, m[0] << 32 | at)
            left = before[at]
            if left >= 0:
                m = merges.get(ids[left] << 20 | new)
                if m is not None:
                    push(heap, m[0] << 32 | left)
        return [i for i in ids if i >= 0]

    def split(self, text: str) -> list[bytes]:
        """The words of a text without special tokens, as UTF-8."""
        if text.isascii():
            return [w.encode() for w in self.words.findall(text.lower())]
        byte = self.byte
        return [bytes([byte[c] for c in w]) for w, _ in self.cut(self.normalize(text))]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special tokens in it included; nothing is remembered."""
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [i for w in self.split(text[at : m.start()]) for i in self.encode_word(w)]
            out.append(self.special[m[0]])
            at = m.end()
        return out + [i for w in self.split(text[at:]) for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings in order; this vocabulary names no decoder, so a space stands between two."""
        return " ".join([self.strings[i] for i in ids])

    def chunk(self, chunk: bytes) -> tuple[bytes, bytes]:
        """Ids and decoded text of text without ASCII white space; ASCII letters are lower-case unless others stand beside them."""
        if chunk.isalpha():
            words = [chunk]
        elif chunk[:-1].isalpha() and chunk[-1:] in (b".", b","):
            left, right = self.known.get(chunk[:-1]), self.known.get(chunk[-1:])
            if left and right:
                return left[0] + right[0], left[1] + b" " + right[1]
            words = [chunk[:-1], chunk[-1:]]
        else:
            text = chunk.decode()
            latin = latin_words(text)
            words = self.split(text) if latin is None else [w.encode() for w in latin]
        ids = [i for w in words for i in self.encode_word(w)]
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode()

    def both(self, text: bytes) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of a whole UTF-8 text."""
        if any(m in text for m in self.marks) and self.special_at.search(text.decode()):
            ids = self.encode(text.decode())
            return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode()
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
        return b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[1]])


def lowered(text: bytes) -> list[bytes]:
    """The chunks of a text between ASCII white space, lower-case where they are ASCII. In a text beyond Latin-1 the others stay as they are: there case and composition may depend on each other."""
    if text.isascii() or not text.translate(None, LATIN):
        return text.lower().split()
    return [c.lower() if c.isascii() else c for c in text.split()]


def latin_words(chunk: str) -> list[str] | None:
    """The lower-case words of a chunk of Latin-1 letters, with a full stop or a comma at the end or without; None for other chunks."""
    if not _LATIN_WORD.fullmatch(chunk):
        return None
    chunk = chunk.lower()
    return [chunk[:-1], chunk[-1]] if chunk[-1] in ".," else [chunk]


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """One vocabulary for each worker and path; workers are reused, and so are the chunks they know."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: bool = True) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_tokens, the SHA-256 of ids and of decoded
    text, and with ``outputs`` the ids (array) and the decoded text themselves.

    Other columns of ``df`` are not read, so their names can't clash.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType
    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    fields += [("ids", "array<int>"), ("decoded", "string")] if outputs else []
    out = f"id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(tokenizer), hashlib.sha256
        for b in common.sliced(batches, 2000):
            n, a, d, ids, decoded = [], [], [], [], []
            for text in common.raw(b, "text"):
                x, y = bpe.both(text)
                n.append(len(x) // 4)
                a.append(sha(x).hexdigest())
                d.append(sha(y).hexdigest())
                if outputs:
                    ids.append(struct.unpack(f"<{len(x) // 4}I", x))
                    decoded.append(y.decode())
            columns = [b.column("id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            if outputs:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *(f for f, _ in fields)])

    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)
