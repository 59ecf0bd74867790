"""Fingerprints of word sequences by winnowing, as numpy work on the bytes of Arrow batches.

Of each run of ``size`` words the smallest hash of its ``GRAM``-word parts is kept (a minimiser). Texts that share a run of ``size`` words share
its minimiser, wherever the run lies in them; neighbouring runs mostly have the same one, so a text has far fewer of them than words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in the parts that are hashed.
GRAM = 4
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all rows, and the row of each."""
    column = column.fill_null("").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    word = ~_SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[off] = True
    bounds = np.flatnonzero(edge)
    if len(bounds) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    spans = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    hashes = np.array([int.from_bytes(blake2b(w.as_buffer(), digest_size=8).digest(), "little") for w in spans.dictionary.cast(pa.large_binary())], np.uint64)
    kept = np.flatnonzero(word[bounds[:-1]])
    return hashes[spans.indices.to_numpy()[kept]], np.searchsorted(off, bounds[kept], "right") - 1


def minimisers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their minimisers, of all rows with ``size`` words or more; of equal ones in a row of runs the first."""
    hashes, row = _words(column)
    gram = min(GRAM, size)
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        parts = (parts ^ hashes[k : k + len(parts)]) * _ODD
        parts ^= parts >> np.uint64(29)
    least = parts[:n]
    for k in range(1, size - gram + 1):
        least = np.minimum(least, parts[k : k + n])
    whole = row[:n] == row[size - 1 :]
    row, least = row[:n][whole], least[whole].view(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    return row[new], least[new]


def fingerprints(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key and fingerprint of the minimisers of each text."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, fingerprint long"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, least = minimisers(b.column(1), size)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(least)], names=[key, "fingerprint"])

    return rows.select(key, text).mapInArrow(found, schema)
