"""Operator 5: secrets, by fixed forms and by a token-efficiency test.

Besides assignments, access keys and long hex strings, strings of ``MIN_RANDOM`` characters or more that a
BPE vocabulary spends many tokens on (under ``MAX_RATIO`` characters a token) are taken for random, unless
they are digests of a known length, UUIDs, dates, plain numbers or names in one letter case without digits. Words that - and _ join (slugs,
file names, identifiers) cost many tokens too, so words, numbers and short forms of both between such marks are no evidence (``evidence``).
A run of characters is tested in what the fixed forms leave of it: as a whole (with digits, and without / . = inside), in all
windows of tokens of each segment between / . and =, and in windows over several segments if they hold both letter cases and digits, as
base64 does and most paths don't. So words around a random string don't hide it; a window is widened to the next of / . =.

Defined results: null or empty text has no spans; repeated rows give repeated rows; ids may be null; an empty table gives no rows;
spans of different kinds may overlap, those at one place come in the order of the kinds; a text of any length is searched
whole, in one task; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bpe import Vocabulary
from sievework.llm.common import texts
from sievework.llm.pii import Span, span_digests

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
MIN_RANDOM = 20
MAX_RATIO = 2.1
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hex.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
MASK = "[SECRET]"

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KNOWN = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9.+/_=-]+")
#: Digests as pages write them.
_INTEGRITY = r"sha(?:256|384|512)-[A-Za-z0-9+/]{43,86}={0,2}"
#: Forms that are left out wherever they stand by themselves; the rest of the run is tested.
_APART = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_]?[0-9][0-9.+-]*Z?)?|"
    + "|".join(f"[0-9a-fA-F]{{{n}}}" for n in DIGEST_LENGTHS)
    + r")(?![A-Za-z0-9])|(?<![A-Za-z0-9])"
    + _INTEGRITY
)
#: What stands between - and _ in names: words, numbers, versions and short codes.
_ORDINARY = re.compile("[A-Z]{1,15}|[A-Z]?[a-z]{1,15}|[A-Z]?[a-z]{2,15}(?:[A-Z][a-z]{2,15})+|[0-9]+|0x[0-9a-fA-F]{1,16}|[A-Za-z]{1,8}[0-9]{1,6}|[0-9]{1,6}[A-Za-z]{1,4}")
_JOINTS = re.compile("[-_/.=]")
#: So many characters of a string must not be of an ordinary form.
LEAST_EVIDENCE = 16
_PARTED = "/.="
_PARTS = re.compile("[/.]|=(?!=*$)")
_SEGMENT = re.compile("[^/.=]{20,}")


def _mixed(value: str) -> bool:
    """Whether it is neither a number nor a name in one letter case without digits."""
    lower, upper = any(c.islower() for c in value), any(c.isupper() for c in value)
    return (lower and upper) or ((lower or upper) and any(c.isdigit() for c in value))


def _of_all_kinds(value: str) -> bool:
    return any(c.islower() for c in value) and any(c.isupper() for c in value) and any(c.isdigit() for c in value)


def evidence(value: str) -> int:
    """The characters of a string without the parts of an ordinary form between its marks."""
    parts = _JOINTS.split(value)
    ordinary = [p for p in parts if not p or _ORDINARY.fullmatch(p)]
    return len(value) - sum(map(len, ordinary)) - min(len(ordinary), len(parts) - 1)


def looks_random(value: str, vocabulary: Vocabulary) -> bool:
    """Whether the vocabulary spends so many tokens on it that it can't be made of words."""
    if len(value) < MIN_RANDOM or not _mixed(value):
        return False
    if _KNOWN.fullmatch(value) or (len(value) in DIGEST_LENGTHS and re.fullmatch("[0-9a-fA-F]+", value)):
        return False
    return evidence(value) >= LEAST_EVIDENCE and len(value) < MAX_RATIO * len(vocabulary.encoding().encode_ordinary(value))


def _window(tokens: list[int], gains: list[float]) -> tuple[int, int] | None:
    """The tokens with the largest sum of gains that have MIN_RANDOM characters or more; None without a gain."""
    sums, ends = [0.0, *accumulate(gains)], [0, *accumulate(tokens)]
    best, found = 0.0, None
    first, i = 0, -1  # the least sum before the windows that may end here
    for j in range(1, len(ends)):
        while ends[j] - ends[i + 1] >= MIN_RANDOM:
            i += 1
            if sums[i] < sums[first]:
                first = i
        if i >= 0 and sums[j] - sums[first] > best:
            best, found = sums[j] - sums[first], (first, j)
    return found


def _windows(value: str, vocabulary: Vocabulary, telling: Callable[[str], bool]) -> list[tuple[int, int]]:
    """The windows of tokens that look random, the best first and then what stands beside it."""
    if len(value) < MIN_RANDOM or not telling(value):
        return []
    encoding = vocabulary.encoding()
    sizes = [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(value)]
    ends = [0, *accumulate(sizes)]
    out, left = [], [(0, len(sizes))]
    while left:
        x, y = left.pop()
        if ends[y] - ends[x] < MIN_RANDOM or not (w := _window(sizes[x:y], [MAX_RATIO - n for n in sizes[x:y]])):
            continue
        i, j = x + w[0], x + w[1]
        left += [(x, i), (j, y)]
        a, b = ends[i], ends[j]
        if telling(value[a:b]) and evidence(value[a:b]) >= LEAST_EVIDENCE:
            while a and value[a - 1] not in _PARTED and value[a] not in _PARTED:
                a -= 1
            while b < len(value) and value[b] not in _PARTED and value[b - 1] not in _PARTED:
                b += 1
            out.append((a, b))
    return out


def random_spans(value: str, vocabulary: Vocabulary) -> list[tuple[int, int]]:
    """Where random strings stand in a run of characters."""
    if len(value) < MIN_RANDOM:
        return []
    if not _PARTS.search(value) and any(c.isdigit() for c in value) and looks_random(value, vocabulary):
        return [(0, len(value))]
    out = _windows(value, vocabulary, _of_all_kinds)
    for m in _SEGMENT.finditer(value):
        out += [(m.start() + a, m.start() + b) for a, b in _windows(m[0], vocabulary, _mixed)]
    return merged(out)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str, vocabulary: Vocabulary) -> list[Span]:
    """(start, number of the kind, end) of all spans, by start and kind, in code points."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    taken = [(a, b) for a, _, b in out]
    for run in _RUN.finditer(text):
        a, b = run.span()
        found = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text, a, b) if m.end() - m.start() >= 20] if "AKIA" in run[0] else []
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, a, b)]
        out += found
        apart = [(x, y) for x, y in taken if x < b and a < y] + [(x, y) for x, _, y in found] + [m.span() for m in _APART.finditer(text, a, b)]
        at = a
        for x, y in [*merged(apart), (b, b)]:
            out += [(at + i, 3, at + j) for i, j in random_spans(text[at:x], vocabulary)]
            at = max(at, y)
    return sorted(out)


def find(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t, vocabulary)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found, kind)], names=["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(rows, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def masked_text(text: str, found: list[Span]) -> str:
    """The text with each secret (overlapping ones together) replaced by MASK."""
    out, last = [], 0
    for a, _, b in found:
        if a >= last:
            out += [text[last:a], MASK]
        last = max(last, b)
    return "".join(out) + text[last:]


def masked(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in the text masked; null stays null."""

    def rows(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in column:
            yield pa.array([None if t is None else masked_text(t, spans(t, vocabulary)) for t in c.to_pylist()], pa.string())

    return docs.withColumn(text_col, F.arrow_udf(rows, "string")(F.col(text_col)))


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """For each document the number of each base kind, the SHA-256 of its base spans, and all spans."""
    return span_digests(docs, lambda t: spans(t, vocabulary), BASE, KINDS)
