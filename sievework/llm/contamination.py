"""Operator 9: benchmark passages in documents, by spaced seeds.

A pair is reported if a stretch of the item is found in the document in which matches count 1 and other words -2, with a
sum of ``MIN_SCORE`` or more, or of 80 % of a shorter item.

A seed is a hash of the words that a fixed mask picks from a window; the others may differ. No row of matches and other words
can reach a sum of 7 without a place where one of ``MASKS`` fits (a walk over all histories of such rows
shows that 6 is the most; the tests repeat it). Items of fewer than ``SHORT`` words need less, but all of it in one run, so these
have the mask ``SHORT_MASK``. So no passage is missed, wherever the other words stand.

1. The items' seeds become a table of distinct (hash, item). A bit table of a bounded size (16 MB at most) that says which
   hashes occur goes to all tasks.
2. Every document gives its distinct seeds that the bit table lets through; they are joined with the items' seeds by hash. The
   items' side is broadcast if it is small by count; otherwise both are shuffled, salted by document.
3. Candidate pairs meet their texts again, and every diagonal (document word minus item word) on which a seed
   matches is compared word by word.

Documents are told apart by a hash of id and text; documents with the same hash only share candidates.

Defined results: null or empty texts and items match nothing; items of fewer than ``MIN_ITEM`` words are too short to tell and
match nothing, as do items without an id; repeated documents are reported as often as they stand, repeated items once; null ids
are kept; of several best stretches the first counts; empty tables give no rows; texts of any length are
searched whole, in one task; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import staged, texts
from sievework.llm.kernels import LOWER, byte_values, mixed, prefix, slices, span_hashes, utf8, word_spans

#: Seeds: 1 is a word that must match.
MASKS = ("11010101", "1111001")
SHORT_MASK, SHORT = "1111", 8
MIN_SCORE = 12
MIN_ITEM = 5
#: The bit table has 16 bits for each seed up to this many bits.
MOST_BITS = 27
#: Tables of this many rows of 16 bytes, or lists of so many words, are sent to all tasks; longer ones are shuffled.
BROADCAST_ROWS = 1_000_000
SALTS = 16
#: Matches of seeds that are held at a time.
PAIRS = 1 << 22
FOUND = "doc_id long, item_id long, n_matched long, n_item_words long, first_word long"


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of rows: its first row, the hash of each lower-cased word, and the words before each row."""
    data, off = utf8(column)
    for i, j in slices(off):
        own = data[off[i] : off[j]]
        start, end, before = word_spans(own, off[i : j + 1] - off[i])
        yield i, span_hashes(prefix(byte_values(LOWER[own])), start, end), before


def least_score(size: int) -> int:
    """The sum that a stretch of an item of so many words must have."""
    return min(MIN_SCORE, math.ceil(0.8 * size))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the masked words of every window."""
    n = max(0, len(words) - len(mask) + 1)
    key = np.full(n, len(mask) * 1000 + mask.count("1"), np.uint64)
    for k, picked in enumerate(mask):
        if picked == "1":
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mixed(key)


def masks_of(size: int) -> tuple[str, ...]:
    """The masks that an item of so many words is found by."""
    return (SHORT_MASK,) if size < SHORT else MASKS


def row_key(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_key, item_id and word hashes of every item that is long enough, each once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, words, before in word_hashes(b["text"]):
                own = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(words.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b["item_key"].slice(i, len(own)), b["doc_id"].slice(i, len(own)), own], names=["item_key", "item_id", "words"])

    rows_of = texts(benchmark, id_col, text_col).where("doc_id IS NOT NULL").withColumn("item_key", row_key()).dropDuplicates(["item_key"])
    return rows_of.mapInArrow(rows, "item_key long, item_id long, words array<long>").where(F.size("words") >= MIN_ITEM)


def item_seeds(items: DataFrame) -> DataFrame:
    """Distinct (hash, item_key)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, keys = [], []
            for key, words in zip(b["item_key"].to_pylist(), b["words"], strict=True):
                words = words.values.to_numpy().view(np.uint64)
                own = np.unique(np.concatenate([seeds(words, m) for m in masks_of(len(words))]))
                hashes.append(own.view(np.int64))
                keys.append(np.full(len(own), key))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(keys))], names=["hash", "item_key"])

    return items.mapInArrow(rows, "hash long, item_key long")


def _bit_table(of_items: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Which leading bits of a hash occur; made by Spark, 2**MOST_BITS bits at most on the driver."""
    bits = min(MOST_BITS, max(16, n.bit_length() + 4))
    slot = F.shiftrightunsigned("hash", 64 - bits)
    words = of_items.select(slot.alias("slot")).groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table, bits


def document_seeds(docs: DataFrame, table: np.ndarray, bits: int) -> DataFrame:
    """Distinct (row_key, hash) of the seeds in each text that the bit table lets through; docs has row_key and text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b["row_key"].to_numpy()
            for i, words, before in word_hashes(b["text"]):
                found, of = [], []
                for mask in (*MASKS, SHORT_MASK):
                    key = seeds(words, mask)
                    slot = key >> np.uint64(64 - bits)
                    at = np.flatnonzero((table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(before, at, "right") - 1
                    inside = at + len(mask) <= before[row + 1]  # not over the end of a text
                    found.append(key[at[inside]])
                    of.append(row[inside])
                found, of = np.concatenate(found), np.concatenate(of)
                once = np.unique(np.stack([of.astype(np.uint64), found]), axis=1) if len(of) else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + once[0].astype(np.int64)]), pa.array(once[1].view(np.int64))], names=["row_key", "hash"])

    return docs.select("row_key", "text").mapInArrow(rows, "row_key long, hash long")


class _Document:
    """The words of a text, with its seeds by mask, sorted."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.seeds: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, mask: str) -> tuple[np.ndarray, np.ndarray]:
        if mask not in self.seeds:
            keys = seeds(self.words, mask)
            order = np.argsort(keys, kind="stable")
            self.seeds[mask] = keys[order], order
        return self.seeds[mask]

    def shifts(self, item: np.ndarray) -> np.ndarray:
        """The diagonals on which a seed matches."""
        out = [np.zeros(0, np.int64)]
        for mask in masks_of(len(item)):
            keys, order = self.places(mask)
            own = seeds(item, mask)
            a, b = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            at = np.flatnonzero(b > a)
            ends = np.cumsum((b - a)[at])
            i = 0
            while i < len(at):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
                n = (b - a)[at[i:j]]
                place = np.repeat(a[at[i:j]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                out.append(np.unique(order[place] - np.repeat(at[i:j], n)))
                i = j
        return np.unique(np.concatenate(out))

    def best(self, item: np.ndarray) -> tuple[int, int] | None:
        """Matches and first document word of the best stretch of an item, if it is long enough."""
        most, found = least_score(len(item)) - 1, None
        for shift in self.shifts(item).tolist():
            a, b = max(0, -shift), min(len(item), len(self.words) - shift)
            same = item[a:b] == self.words[a + shift : b + shift]
            sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
            gain = sums[1:] - np.minimum.accumulate(sums[:-1])
            end = int(np.argmax(gain))
            if gain[end] > most:
                start = int(np.argmin(sums[: end + 1]))
                most, found = gain[end], (int(same[start : end + 1].sum()), a + start + shift)
        return found


def _small(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def _found(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    docs = texts(docs, id_col, text_col).withColumn("row_key", row_key())
    items = staged(items_of(benchmark, item_id_col, item_text_col))
    words = items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    of_items = staged(item_seeds(items))
    n = of_items.count()
    hits = document_seeds(docs, *_bit_table(of_items, n))
    if n <= broadcast_rows:
        pairs = hits.join(F.broadcast(of_items), "hash")
    else:
        salted = of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = hits.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    # A document's items come in lists of about broadcast_rows words at most, however large the benchmark is.
    lists = max(1, math.ceil(words / max(1, broadcast_rows)))
    with_words = pairs.select("row_key", "item_key").distinct().join(_small(items, words, broadcast_rows), "item_key")
    candidates = staged(with_words.groupBy("row_key", F.pmod("item_key", F.lit(lists)).alias("list")).agg(F.collect_list(F.struct("item_id", "words")).alias("items")).drop("list"))
    keys = candidates.select("row_key").distinct()
    few = keys.count()
    if few <= broadcast_rows:
        docs = docs.join(F.broadcast(keys), "row_key", "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, words, before in word_hashes(b["text"]):
                for k in range(len(before) - 1):
                    document = _Document(words[before[k] : before[k + 1]])
                    best: dict[int, tuple[int, int, int]] = {}
                    for item in b["items"][i + k]:
                        own = item["words"].values.to_numpy().view(np.uint64)
                        if found := document.best(own):
                            number = item["item_id"].as_py()
                            best[number] = max(best.get(number, (0, 0, 0)), (found[0], len(own), found[1]))
                    out += [(b["row_key"][i + k].as_py(), b["doc_id"][i + k].as_py(), number, *x) for number, x in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], names=["row_key", "doc_id", "item_id", "n_matched", "n_item_words", "first_word"])

    return docs.join(candidates, "row_key").select("row_key", "doc_id", "text", "items").mapInArrow(verify, "row_key long, " + FOUND)


def find(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item of which it holds a long stretch."""
    return _found(docs, benchmark, broadcast_rows, id_col, text_col, item_id_col, item_text_col).drop("row_key")


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that hold no long stretch of any item, with all their columns."""
    key = f"row_{uuid.uuid4().hex}"
    found = staged(_found(docs, benchmark, broadcast_rows, id_col, text_col, item_id_col, item_text_col).select("row_key", "doc_id").distinct())
    found = _small(found.select(F.col("row_key").alias(key), F.col("doc_id").alias(f"{key}_id")), found.count(), broadcast_rows)
    return docs.join(found, (row_key(id_col, text_col) == F.col(key)) & F.col(id_col).cast("long").eqNullSafe(F.col(f"{key}_id")), "left_anti")
