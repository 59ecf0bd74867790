"""Operator 3: personal data, by anchors and local parsers.

One Aho-Corasick pass finds at-signs, schemes, plus signs, digits and identifier cues; small parsers expand
each anchor to the left and right and validate what they find. Base kinds are email, ip, card and phone;
the method adds url_user (credentials in an address), iban (after a cue, as long as its country says) and account (a number after a
cue: 6 to 17 digits that are neither a date nor a telephone number, and no IBAN with a wrong checksum). Of what follows a number only
parts that have digits of their own belong to it.

Defined results: null or empty text has no spans; repeated rows give repeated rows; ids may be null; an empty table gives no rows;
spans of different kinds may overlap, those at one place come in the order of the kinds; a text of any length is searched
whole, in one task; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.common import texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_user", "iban", "account")
#: Words before an account number.
CUES = ("account", "acct", "konto", "cuenta", "compte", "iban", "passport", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LEAD = re.compile(r"[\x20]*(?:(?:no|nr|number)\.?)?[\x20]*[:#=]?[\x20]*(?=[A-Z]{0,2}[0-9])")
_NUMBER = re.compile(r"[A-Z]{0,2}[0-9][0-9A-Z]{0,30}(?:[\x20-][A-Z]{0,2}[0-9][0-9A-Z]{0,30}){0,15}(?![0-9A-Za-z])")
_USER = re.compile(r"([A-Za-z0-9._%+-]+):([^\s:/@]+)@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}")
#: How many characters an IBAN has, by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LENGTH_OF = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
#: Numbers that are no account: dates, and telephone numbers without a plus.
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-\x20]?(?:0[1-9]|1[0-2])[-\x20]?(?:0[1-9]|[12][0-9]|3[01])(?![0-9])|(?:0[1-9]|[12][0-9]|3[01])[-\x20](?:0[1-9]|1[0-2])[-\x20](?:19|20)[0-9]{2}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?:[0-9]{3}[-\x20])?[0-9]{3}[-\x20][0-9]{4}")
LEAST_DIGITS, MOST_DIGITS = 6, 17
Span = tuple[int, int, int]


@cache
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, (0, 1))
    for c, kind in (("@", 1), ("+", 2), ("://", 3)):
        found.add_word(c, (kind, len(c)))
    for cue in CUES:
        for word in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(word, (4, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    moved = value[4:] + value[:4]
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str, at: list[int]) -> list[Span]:
    out, last = [], 0
    for p in at:
        if p < last:
            continue
        start = p
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < p and (m := _DOMAIN.match(text, p + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
    return out


def _runs(digits: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for p in digits:
        if runs and runs[-1][1] == p:
            runs[-1] = (runs[-1][0], p + 1)
        else:
            runs.append((p, p + 1))
    return runs


def _chains(text: str, runs: list[tuple[int, int]], links: str) -> Iterator[list[tuple[int, int]]]:
    """Neighbouring runs with one character of links between them."""
    chain: list[tuple[int, int]] = []
    for r in runs:
        if chain and not (r[0] == chain[-1][1] + 1 and text[r[0] - 1] in links):
            yield chain
            chain = []
        chain.append(r)
    if chain:
        yield chain


def numbers(text: str, digits: list[int]) -> list[Span]:
    out, runs = [], _runs(digits)
    for chain in _chains(text, runs, "."):
        for k in range(0, len(chain) - 3, 4):
            four = chain[k : k + 4]
            if all(b - a < 4 or not text[a : b - 3].strip("0") for a, b in four) and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in four):
                out.append((four[0][0], 1, four[3][1]))
    for chain in _chains(text, runs, " -"):
        if 14 <= sum(b - a for a, b in chain) <= 19 and luhn("".join(text[a:b] for a, b in chain)):
            out.append((chain[0][0], 2, chain[-1][1]))
    return out


def phones(text: str, plus: list[int]) -> list[Span]:
    found = (_PHONE.match(text, p) for p in plus)
    return [(m.start(), 3, m.end()) for m in found if m and 10 <= sum(c.isdigit() for c in m[0]) <= 15]


def _iban_end(text: str, start: int) -> int:
    """Where as many characters as the country's IBANs have end, with single blanks between them; 0 if there are not so many."""
    left, p = _LENGTH_OF.get(text[start : start + 2], 0), start
    while left and p < len(text):
        if text[p] == " " and text[p - 1] != " ":
            p += 1
        elif text[p].isascii() and (text[p].isdigit() or text[p].isupper()):
            p, left = p + 1, left - 1
        else:
            return 0
    return p if p > start and not left and not text[p : p + 1].isalnum() else 0


def number_at(text: str, start: int) -> Span | None:
    """What begins after a cue: an IBAN (5), an account (6) or neither. What has an IBAN's form but not its checksum is neither."""
    if _IBAN.match(text, start) and (end := _iban_end(text, start)):
        return (start, 5, end) if iban_valid(text[start:end].replace(" ", "")) else None
    m = _NUMBER.match(text, start)
    if not m or _DATE.match(m[0]) or _LOCAL_PHONE.fullmatch(m[0]):
        return None
    return (start, 6, m.end()) if LEAST_DIGITS <= sum(c.isdigit() for c in m[0]) <= MOST_DIGITS else None


def spans(text: str) -> list[Span]:
    """(start, number of the kind, end) of all spans, by start and kind, in code points."""
    at: list[list[int]] = [[], [], [], [], []]
    for end, (kind, size) in _anchors().iter(text):
        at[kind].append(end + (1 if kind > 2 else 1 - size))
    digits, ats, plus, schemes, cues = at
    out = []
    if ats:
        out += emails(text, ats)
    if digits:
        out += numbers(text, digits)
        if plus:
            out += phones(text, plus)
    for p in schemes:
        if m := _USER.match(text, p):
            out.append((m.start(), 4, m.end()))
    for p in cues if digits else ():
        if (m := _LEAD.match(text, p)) and (found := number_at(text, m.end())):
            out.append(found)
    return sorted(set(out))


def written(found: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, kind)], names=["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def span_digests(docs: DataFrame, spans_of: Callable[[str], list[Span]], base: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """For each document the number of each base kind, the SHA-256 of its base spans, and all spans, in one pass over the texts."""
    names = ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans_of(t) for t in b["text"].to_pylist()]
            first = [[x for x in own if x[1] < len(base)] for own in found]
            counts = [pa.array([sum(x[1] == k for x in own) for own in first], pa.int64()) for k in range(len(base))]
            hashes = pa.array([hashlib.sha256(written(own, kinds).encode()).hexdigest() for own in first], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *counts, hashes, pa.array([written(own, kinds) for own in found], pa.string())], names=names)

    return texts(docs).mapInArrow(rows, "doc_id long, " + ", ".join(f"{n} long" for n in names[1:-2]) + ", base_sha256 string, spans string")


def digests(docs: DataFrame) -> DataFrame:
    return span_digests(docs, spans, BASE, KINDS)
