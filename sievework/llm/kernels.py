"""Numpy work on the UTF-8 bytes of a batch of texts, as used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: The bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.RandomState(20240501)
_VALUE = _random.randint(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C17 | 3)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins (one more: the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``most`` bytes, one row at least."""
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i over the first i, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, the same for the same content wherever it lies."""
    return mixed((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _VALUE[data]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row."""
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    rows = off[:-1][off[:-1] < off[1:]]
    start[rows] = word[rows]
    rows = off[1:][off[:-1] < off[1:]] - 1
    end[rows] = word[rows]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, off)


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.StringArray:
    """The strings between neighbouring bounds; no bytes are copied."""
    bounds = np.ascontiguousarray(bounds, np.int32)
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))


def word_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for each word, the distinct words, and the number of words before each row."""
    start, end, words = word_spans(data, off)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), words
    both = np.empty(2 * len(start) + 1, np.int64)
    both[0:-1:2], both[1::2], both[-1] = start, end, len(data)
    coded = strings(data, both).dictionary_encode()
    codes = coded.indices.to_numpy()[::2]  # every other string is a gap between words
    used, codes = np.unique(codes, return_inverse=True)
    return codes, coded.dictionary.take(pa.array(used)), words


@cache
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for k, kind in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(kind, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = k
    out[0xD800:0xE000] = 0
    return out


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each match of the tokenizers' pattern begins, in bytes, and the number of matches before each row.

    The pattern parts a text into runs of letters, of numbers and of other characters, each with one
    blank before it, into 's 't 're 've 'm 'll 'd, and into runs of white space.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    if data.max() < 128:
        chars, at = data, None
        rows = off
    else:
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        rows = np.searchsorted(at, off)
    n = len(chars)
    kind = _classes()[chars]
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    first = np.zeros(n + 1, bool)
    first[rows] = True
    start |= first
    # The last character of white space before other text: a blank joins what follows, another stands alone.
    after = np.flatnonzero(start[1:n] & (kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[chars[after - 1] == 32]] = False
    quote = np.flatnonzero((chars == 39) & start[:n])
    if len(quote):
        last = np.append(rows[1:], n)[np.searchsorted(rows, quote, "right") - 1]
        padded = np.concatenate([chars, np.zeros(2, chars.dtype)])
        one = np.where(quote + 1 < last, padded[quote + 1], 0)
        two = np.where(quote + 2 < last, padded[np.minimum(quote + 2, n)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        for taken, size in ((short, 2), (long & ~short, 3)):
            start[quote[taken] + 1] = False
            start[quote[taken] + size] = True
    found = np.flatnonzero(start[:n])
    return (found if at is None else at[found]), np.searchsorted(found, rows)


def pretoken_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for each match of the pattern, the distinct matches, and the number of matches before each row."""
    starts, before, n = [], [np.zeros(1, np.int64)], 0
    for i, j in slices(off):
        found, rows = pretokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
        starts.append(found + off[i])
        before.append(rows[1:] + n)
        n += len(found)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(len(off), np.int64)
    coded = strings(data, np.append(np.concatenate(starts), len(data))).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.concatenate(before)


def gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each code's range, one after another, and where each begins (one more: the end)."""
    sizes = size[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    step = np.repeat(begin[codes] - ends[:-1], sizes)
    step += np.arange(ends[-1])
    return values[step], ends
