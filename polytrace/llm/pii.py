"""Personal data in whole texts: patterns propose, checksums confirm, context adjusts.

Each proposed span gets a score: what its pattern is worth alone, more where a
checksum confirms it (Luhn for cards, mod-97 for account numbers), more where a
word that announces such data stands shortly before it. The base kinds (email, ip,
card, phone) are reported whatever their score; further spans need
``THRESHOLD`` and may not overlap a base span or an earlier one:

* card: four groups of digits with dots, slashes or no-break spaces between, passing Luhn;
* phone: a national number without ``+`` whose context speaks of a telephone;
* iban: an account number passing mod-97;
* secret: a long token after a word such as ``token`` or ``password`` and ``=`` or ``:``.

Offsets count code points, the end is exclusive. Defined results: null or empty text has no spans;
spans of one start stand in the order of ``KINDS``; rows are independent, so repeated rows agree; an empty table gives no rows; other columns are not read.
Patterns and the check for overlaps take time in proportion to the text, so very long texts need no limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
ORDER = {k: n for n, k in enumerate(KINDS)}

#: Score of a proposal, and what a checksum and a context word add.
ALONE = {"email": 0.7, "ip": 0.5, "card": 0.4, "phone": 0.4, "iban": 0.4, "secret": 0.4}
CHECKSUM, CONTEXT, THRESHOLD = 0.4, 0.2, 0.6
NEAR = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits is entered at its start only: from its middle the rest could match no better
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPACED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}([./\u00a0\u2009\u202f])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?![0-9.])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|key)\b)\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9_+/=-]{16,}+)")
_WORDS = {
    "email": re.compile(r"(?i)e-?mail|contact|write|mailto"),
    "ip": re.compile(r"(?i)\bip\b|server|host|address|adresse"),
    "card": re.compile(r"(?i)card|visa|master|credit|karte|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|\btel|call|mobile|fax|\bappel|llam|anruf"),
    "iban": re.compile(r"(?i)iban|account|bank|konto|compte|cuenta"),
    "secret": re.compile(r"(?i)token|secret|password|key"),
}
_DIGIT_OR_AT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the rest."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the rearranged account number leaves 1 after division by 97; letters count 10 to 35."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and dotted domain: found from each @, so that long words cost nothing."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", m.end() if m else at + 1)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind."""
    out = [(a, b, "email") for a, b in emails(text)]
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers passing mod-97: of each start the longest, as capitals that follow may match the pattern too."""
    m = _IBAN.search(text)
    while m:
        at, end = m.start() + 1, m.end()
        while end > m.start() and len(account := text[m.start() : end].replace(" ", "")) >= 15:
            if mod97(account):
                yield m.start(), end
                at = end
                break
            end = text.rfind(" ", m.start(), end)
        m = _IBAN.search(text, at)


def further_spans(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Proposals beyond the base kinds, with whether a checksum confirms each."""
    for m in _SPACED_CARD.finditer(text):
        if 13 <= len(d := digits_of(m[0])) and luhn(d):
            yield *m.span(), "card", True
    for m in _NATIONAL.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 12:
            yield *m.span(), "phone", False
    yield from ((*s, "iban", True) for s in ibans(text))
    for m in _SECRET.finditer(text):
        yield *m.span(1), "secret", False


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) of all personal data in a text, by start and then kind."""
    if not _DIGIT_OR_AT.search(text) and "=" not in text and ":" not in text:
        return []

    def score(start: int, kind: str, confirmed: bool) -> float:
        near = _WORDS[kind].search(text[max(0, start - NEAR) : start])
        return round(ALONE[kind] + CHECKSUM * confirmed + CONTEXT * bool(near), 2)

    base = base_spans(text)
    out = [(k, a, b, score(a, k, k == "card"), True) for a, b, k in base]
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))  # by start, so a later one's end so far is the largest
    done = 0
    for a, b, kind, confirmed in sorted(further_spans(text), key=lambda s: (s[0], ORDER[s[2]])):
        before = bisect_left(starts, b)
        if a >= done and not (before and ends[before - 1] > a) and (s := score(a, kind, confirmed)) >= THRESHOLD:
            out.append((kind, a, b, s, False))
            done = b
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col`` and pii, an array of (kind, start, end, score, base)."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.sliced(batches, 2000):
            found = [[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in spans(t)] for t in common.texts(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(_SPAN))], names=["id", "pii"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, pii {_SPANS}").withColumnRenamed("id", id_col)


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end, _, _ in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in ``text_col`` masked; null stays null, all other columns stay."""

    @F.pandas_udf("string")
    def mask(text):
        return text.map(lambda t: t if t is None else masked(t))

    return df.withColumn(text_col, mask(F.col(text_col)))


def joined(pii: Column, base_only: bool = False) -> Column:
    """The spans as kind:start:end, comma-joined."""
    kept = F.filter(pii, lambda s: s["base"]) if base_only else pii
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(pii: Column, kind: str) -> Column:
    """How many base spans of a kind there are."""
    return F.size(F.filter(pii, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
