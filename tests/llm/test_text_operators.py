"""Operators on single texts: BPE, packing, personal data, media."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from polytrace.llm import bpe, media, packing, pii

ODD = "aAbzé Σσςİ\x1c\x1f\x85\xa0  ñé²Ⅷ٣'sll中\U0001f600_-.!\t\n\x0b9 ǅŉẞ<|endoftext|>"


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD + "abc ") for _ in range(rng.randint(0, 40))) for _ in range(n)]


# ------------------------------------------------------------------ BPE


def test_bpe_equals_library(tokenizer, rows):
    lib, own, chunks = Tokenizer.from_file(tokenizer), bpe.WordBPE(tokenizer), packing.ChunkTokenizer(tokenizer)
    for text in [t or "" for _, t, _ in rows] + odd_texts(400) + ["<|ENDOFTEXT|>a<|startoftext|><|endoftext|>"]:
        want = lib.encode(text, add_special_tokens=False).ids
        ids, decoded = own.both(text.encode())
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want == own.encode(text)
        assert decoded.decode() == lib.decode(want, skip_special_tokens=False) == own.decode(want)
        assert chunks.ids(text.encode()) == ids


def test_encode_decode(docs, empty, rows, tokenizer):
    lib = Tokenizer.from_file(tokenizer)
    got = bpe.encode_decode(docs, tokenizer).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode_decode(empty, tokenizer).count() == 0


# ------------------------------------------------------------------ packing


def check_packing(pieces, documents, capacity):
    """Every id in exactly one piece, sequences gapless, padded only to the capacity or not at all at a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    totals = Counter()
    for i, ids in documents:
        totals[i] += len(ids)
    for i, ps in by_doc.items():
        assert sum(p.length for p in ps) == totals[i]
    assert set(by_doc) == set(totals)
    padding = 0
    for ps in by_sequence.values():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("capacity,block", [(64, 500), (4096, 1 << 21)])
def test_pack(docs, empty, rows, tokenizer, capacity, block):
    lib = Tokenizer.from_file(tokenizer)
    documents = [(i, [*lib.encode(t or "", add_special_tokens=False).ids, packing.END_ID]) for i, t, _ in rows]
    pieces = packing.pack(docs, tokenizer, capacity=capacity, block_tokens=block).collect()
    assert check_packing(pieces, documents, capacity) == 0
    of = defaultdict(list)
    for i, ids in documents:
        of[i].append(ids)
    for p in pieces:
        assert any(ids[p.start : p.start + p.length] == list(p.ids) and len(ids) == p.doc_tokens for ids in of[p.doc_id])
        assert zlib.crc32(struct.pack(f"<{len(p.ids)}I", *p.ids)) == p.ids_crc32
    assert packing.pack(empty, tokenizer).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.integers(1, 80))
def test_least_slack_is_optimal(items, room):
    counts = dict(Counter(items))
    taken = packing.least_slack(sorted(counts), counts, room)
    assert all(n <= counts[length] for length, n in taken)
    best = {0}
    for x in items:
        best |= {b + x for b in best if b + x <= room}
    assert sum(length * n for length, n in taken) == max(best)


# ------------------------------------------------------------------ personal data

BASE = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
}


def brute(text):
    found = [(m.start(), list(BASE).index(k), m.end(), k) for k, (pattern, fine) in BASE.items() for m in pattern.finditer(text) if fine(m[0])]
    return [(a, b, k) for a, _, b, k in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@@..--++  ()0123456789999/é_%\n", max_size=80))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_base_spans_on_documents(spark, rows):
    for text in [t or "" for i, t, _ in rows if i != 12] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]:
        assert pii.base_spans(text) == brute(text)


def test_further_spans_and_masks():
    text = "Bank account DE89 3704 0044 0532 0130 00; phone 555-123-4567; card 4111.1111.1111.1111; token = abcdef0123456789abcdef. 555-123-4567"
    kinds = [s[0] for s in pii.spans(text)]
    assert kinds == ["iban", "phone", "card", "secret"]  # the number at the end has no context
    assert "[IBAN]" in pii.masked(text) and "4111" not in pii.masked(text)
    assert not pii.mod97("DE88370400440532013000") and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_find_and_mask(docs, empty, rows):
    got = pii.find_pii(docs).collect()
    assert len(got) == len(rows)
    eight = next(r for r in got if r.doc_id == 8)
    assert [s.kind for s in eight.pii] == ["email", "ip", "card", "phone"]
    out = {r.doc_id: r for r in pii.mask_pii(docs).collect()}
    assert out[3].text is None and out[8].text.startswith("mail [EMAIL] or ip [IP]") and out[8].score == 0.5
    assert pii.find_pii(empty).count() == 0 == pii.mask_pii(empty).count()


# ------------------------------------------------------------------ media


@pytest.mark.parametrize("kind", ["none", "sub", "up", "average", "paeth", "auto"])
def test_png_round_trip(kind):
    rng = np.random.default_rng(1)
    for payload in (rng.integers(0, 256, 576 * 3, np.uint8).tobytes(), np.arange(576 * 4).astype(np.uint8).tobytes(), b"\xff" * 576):
        data = media.png_encode(payload, filter=kind)
        assert media.png_decode(data).tobytes() == payload


def test_png_damage_is_found():
    data = bytearray(media.png_encode(b"abc" * 192))
    for at in (0, 20, len(data) - 20):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.png_decode(bytes(bad))
    with pytest.raises(ValueError):
        media.png_decode(bytes(data[:-6]))


def test_cosine_rows_are_orthonormal():
    c = media.cosines(32, 32)
    assert np.allclose(c @ c.T, np.eye(32))


def test_media_column(docs, empty, rows):
    got = media.media_column(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = next((t or "").encode() for i, t, _ in rows if i == r.doc_id)
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and media.png_decode(bytes(r.media)).tobytes() == payload
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and re.fullmatch("[0-9a-f]{16}", r.feature)
    same = {r.feature for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1
    assert media.media_column(empty).count() == 0


def test_ids_equal_the_library_on_every_code_point(tokenizer):
    """Each code point inside a word, alone, and after a digit and capitals that may compose with it."""
    library = Tokenizer.from_file(tokenizer)
    library.no_truncation()
    library.no_padding()
    own, packer = bpe.WordBPE(tokenizer), packing.ChunkTokenizer(tokenizer)
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200))]
    texts = [f"ab{c}cd {c} H{d}I{d} 1{d}" for c, d in zip(points[::2], points[1::2], strict=True)]
    for at in range(0, len(texts), 10_000):
        part = texts[at : at + 10_000]
        for text, e in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True):
            want, raw = struct.pack(f"<{len(e.ids)}I", *e.ids), text.encode()
            assert own.both(raw)[0] == want and packer.ids(raw) == want, ascii(text)
        own.known.clear()
        packer.known.clear()
