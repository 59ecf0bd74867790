"""Operator 1: byte-level BPE encoding and decoding with a public vocabulary.

Encoding is a global distinct-word shuffle. Each block of documents finds its pre-tokens and their
positions and keeps each distinct one once; those that are a token by themselves are looked up in the
vocabulary (a table of fixed size), the others are dealt by a hash, so that each distinct pre-token
of the corpus is encoded once, and the ids are joined back to the blocks and put in order of position.
Decoding joins the ids with the token-byte table and concatenates the bytes in order.

Defined results: null or empty text has no ids; repeated rows give repeated rows; ids may be null; an empty table gives no
rows; other columns are ignored, whatever their names; a text of any length is encoded whole, in one task. Which rows
share a block changes nothing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.llm.common import block_count, by_part, dealt, in_blocks, pack, pack_words, parts_of, texts, unpack, unpack_words, unpacked
from sievework.llm.kernels import gathered, pretoken_codes

ENCODED = "doc_id long, ids array<int>"
#: Distinct words of a part that a task remembers at a time; the others are encoded again.
KNOWN = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """The ranks of a tiktoken file, as read on the driver; it goes to the tasks with the code (under 1 MB)."""

    content: bytes
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return _ranks(self)

    def encoding(self):
        return _encoding(self)


@cache
def _ranks(vocabulary: Vocabulary) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.content.splitlines()) if a}


@cache
def _encoding(vocabulary: Vocabulary):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=_ranks(vocabulary), special_tokens={})


@cache
def _token_bytes(vocabulary: Vocabulary) -> pa.Array:
    ranks = _ranks(vocabulary)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return pa.array(out, pa.binary())


def public_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path(name), public_tokenizers.PATTERN)


def _word_parts(data: np.ndarray, off: np.ndarray, vocabulary: Vocabulary, n: int):
    """Codes, distinct words, their own token (or -1), and for each of n parts the places of its words, in order.

    The words of a part are the same in the same order however the rows of the block are ordered.
    """
    codes, words, before = pretoken_codes(data, off)
    ranks = vocabulary.ranks()
    raw = words.cast(pa.binary()).to_pylist()
    single = np.fromiter((ranks.get(w, -1) for w in raw), np.int32, len(raw))
    return codes, raw, single, before, dealt(raw, np.flatnonzero(single < 0), n)


def _encode(docs: DataFrame, vocabulary: Vocabulary, finish: Callable[[pa.Array, pa.Array], pa.Table], schema: str) -> DataFrame:
    """``finish`` gets the doc_ids and ids of a block."""
    n = block_count(docs)
    blocks, n = in_blocks(docs, n), parts_of(n)
    kind = np.uint16 if max(vocabulary.ranks().values()) < 1 << 16 else np.uint32

    def words(table: pa.Table) -> pa.Table:
        _, data, off = unpacked(table)
        _, raw, _, _, places = _word_parts(data, off, vocabulary, n)
        block = table["block"][0].as_py()
        rows = [(p, block, *pack_words([raw[i] for i in x])) for p, x in enumerate(places) if x]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.binary()), (3, pa.binary()))], names=["part", "block", "sizes", "words"])

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding()
        known: dict[bytes, np.ndarray] = {}
        part = None
        for b in batches:
            out = []
            for p, sizes, joined in zip(b["part"].to_pylist(), b["sizes"], b["words"], strict=True):
                if p != part or len(known) > KNOWN:
                    known, part = {}, p
                ids = []
                for w in unpack_words(sizes, joined):
                    if (x := known.get(w)) is None:
                        x = known[w] = np.array(encoding._encode_single_piece(w), kind)
                    ids.append(x)
                out.append((pack(np.array([len(x) for x in ids], np.uint32)), pack(np.concatenate(ids))))
            yield pa.RecordBatch.from_arrays([b["block"], b["part"], pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["block", "part", "sizes", "ids"])

    def assembled(table: pa.Table, back: pa.Table) -> pa.Table:
        doc_ids, data, off = unpacked(table)
        codes, raw, single, before, places = _word_parts(data, off, vocabulary, n)
        size, begin = np.ones(len(raw), np.int64), np.arange(len(raw), dtype=np.int64)
        values, end = [np.maximum(single, 0)], len(raw)
        for p, sizes, ids in zip(back["part"], back["sizes"], back["ids"], strict=True):
            at = np.array(places[p.as_py()], np.int64)
            sizes, ids = unpack(sizes, np.uint32), unpack(ids, kind)
            size[at], begin[at] = sizes, end + np.cumsum(sizes, dtype=np.int64) - sizes
            values.append(ids.astype(np.int32))
            end += len(ids)
        flat, ends = gathered(np.concatenate(values), begin, size, codes)
        return finish(doc_ids, pa.ListArray.from_arrays(pa.array(ends[before].astype(np.int32)), pa.array(flat)))

    asked = blocks.groupBy("block").applyInArrow(words, "part int, block int, sizes binary, words binary")
    back = by_part(asked, n, ids_of, "block int, part int, sizes binary, ids binary")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assembled, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, as tiktoken's encode_ordinary gives them, for every row."""
    return _encode(texts(docs, id_col, text_col), vocabulary, lambda i, x: pa.table([i, x], names=["doc_id", "ids"]), ENCODED)


def token_bytes(ids: pa.Array, vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of each row of ids: each id is joined with its row of the token-byte table."""
    flat = ids.flatten()
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    found = _token_bytes(vocabulary).take(flat)
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    at = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, found.offset * 4)[ends] if len(found) else np.zeros(len(ends), np.int32)
    data = found.buffers()[2]
    data = memoryview(data) if data else memoryview(b"")
    return [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and the decoded bytes of every row with doc_id and ids (null: empty)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(token_bytes(b["ids"], vocabulary), pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """For each document the number of ids, and the SHA-256 of the ids and of the bytes they decode to."""

    def finish(doc_ids: pa.Array, ids: pa.Array) -> pa.Table:
        flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), "<u4")
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        digests = [hashlib.sha256(flat[a:e]).hexdigest() for a, e in zip(ends - sizes, ends, strict=True)]
        decoded = [hashlib.sha256(x).hexdigest() for x in token_bytes(ids, vocabulary)]
        return pa.table([doc_ids, pa.array(sizes), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encode(texts(docs), vocabulary, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded_documents(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids and decoded text of every row."""

    def finish(doc_ids: pa.Array, ids: pa.Array) -> pa.Table:
        return pa.table([doc_ids, ids, pa.array([x.decode("utf-8") for x in token_bytes(ids, vocabulary)], pa.string())], names=["doc_id", "ids", "decoded"])

    return _encode(texts(docs), vocabulary, finish, "doc_id long, ids array<int>, decoded string")
