"""Further spans of personal data that end where the data ends."""

import pytest

from polytrace.llm import pii


def found(text, kind):
    return [text[a:b] for k, a, b, _, _ in pii.spans(text) if k == kind]


@pytest.mark.parametrize("n", [16, 256, 257, 320, 100_000])
def test_secrets_of_any_length(n):
    assert found(f"password={'aB3' * n}"[: 9 + n] + " and more", "secret") == [("aB3" * n)[:n]]
    assert pii.masked("password=" + "x" * n) == "password=[SECRET]"


@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " BIC", " AND OTHER CAPITALS THAT GO ON", ", then"])
def test_account_numbers_before_capitals(after):
    assert found(f"IBAN DE89 3704 0044 0532 0130 00{after}", "iban") == ["DE89 3704 0044 0532 0130 00"]


def test_account_numbers_in_a_row():
    both = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert found(" ".join(both), "iban") == both
    assert found("AB12 CODE THEN 1234 " + both[0], "iban") == both[:1]
    assert found("DE88 3704 0044 0532 0130 00", "iban") == []


def test_overlaps_equal_pairwise_ones():
    import random

    rng = random.Random(4)
    pieces = ["password=", "abcdefgh12345678", " ", "4111 1111 1111 1111", "4111.1111.1111.1111", "tel 030 555 1234", "10.0.0.1", "a@b.example", "DE89 3704 0044 0532 0130 00", " IBAN ", "key: ", "+1 555 123 4567", "/", "x"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        base = pii.base_spans(text)
        want, taken = [], [(a, b) for a, b, _ in base]
        for a, b, kind, confirmed in sorted(pii.further_spans(text), key=lambda s: (s[0], pii.ORDER[s[2]])):
            near = pii._WORDS[kind].search(text[max(0, a - pii.NEAR) : a])
            score = round(pii.ALONE[kind] + pii.CHECKSUM * confirmed + pii.CONTEXT * bool(near), 2)
            if score >= pii.THRESHOLD and not any(x < b and a < y for x, y in taken):
                want.append((kind, a, b))
                taken.append((a, b))
        assert [s[:3] for s in pii.spans(text) if not s[4]] == sorted(want, key=lambda s: (s[1], pii.ORDER[s[0]])), text


def test_many_spans_take_time_in_proportion():
    import time

    text, began = "password=abcdefgh12345678 a@b.example " * 50_000, time.process_time()
    assert len(pii.spans(text)) == 100_000
    assert time.process_time() - began < 30
