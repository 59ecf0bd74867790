"""Operator 11: groups of tokens of two tokenizers that cover the same bytes, and how often ids meet in them.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece model with byte fallback (B). Some megabytes of text
are one *chunk*: a chunk's distinct pre-tokens (A) and its distinct words (B: white space and what follows it; no piece has a space after
another character, so merges never leave a word) are encoded once and gathered back. Each byte has a label: none, an end of A, an end of B, or
both. A regular expression scans the label string for spans up to each ``both``; the labels in a span count the tokens of a group.

The chunks are written once, each with its groups and the pairs of ids that share one, so no text is shuffled and nothing is encoded
twice. A chunk gives a row for each distinct pair with the documents that hold it; these are summed over the corpus, the highest count of each A id is
found among its pairs (32,000 at most), and the sums are joined back to the chunks.

Defined results: null and empty texts, and texts that B does not give back byte for byte (with U+2581 for example), have no tokens,
zeros and an empty digest; repeated rows count as documents of their own; ids may be null; equal counts are all the highest; other
columns are ignored, whatever their names; a text of any length is encoded whole, in one task; an empty table gives no rows. Which rows share a chunk changes nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import pack, staged, unpack
from sievework.llm.kernels import gathered, pretoken_codes, strings, utf8

#: Bytes of text in a chunk, unless one text has more.
CHUNK_BYTES = 2 << 20
#: Groups that make more pairs than this have equal ids counted before they are paired.
MANY = 1 << 12
NONE, A_END, B_END, BOTH = b"-AB*"
SPANS = re.compile(rb"[^*]*\*")

CHUNK = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, pairs binary, docs binary, sizes binary, places binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass(frozen=True)
class Tokenizers:
    """The contents of a tokenizer file (A) and of a piece model (B); they go to the tasks with the code (2 MB)."""

    a: str
    b: bytes

    @classmethod
    def read(cls, a: str, b: str) -> Tokenizers:
        with open(a, encoding="utf-8") as f, open(b, "rb") as g:
            return cls(f.read(), g.read())


def public_tokenizers_pair(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> Tokenizers:
    import public_tokenizers

    return Tokenizers.read(public_tokenizers.path(a), public_tokenizers.path(b))


@cache
def _a(content: str):
    """The tokenizer, and its ids' bytes: an entry has a character for each byte."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.encode_special_tokens = True
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    entries = tokenizer.get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(byte[c] for c in entry)
    return tokenizer, out


@cache
def _b(content: bytes):
    """The model, and its ids' bytes. No piece may have a space after another character."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=content)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any("▁" in x.lstrip("▁") for x in pieces):
        raise ValueError("the model's pieces reach over words, so words can't be encoded by themselves")
    out = [bytes([int(x[3:-1], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
    return model, out


def _encoded(words: list[str], encode, token: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all distinct words in a row, how many each has, and whether their bytes are the word's."""
    ids = encode(words)
    right = np.fromiter((b"".join([token[k] for k in x]) == w.encode() for w, x in zip(words, ids, strict=True)), bool, len(ids))
    return np.array([k for x in ids for k in x], np.int64), np.fromiter(map(len, ids), np.int64, len(ids)), right


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for each run of spaces with what follows it, the distinct ones, and their number before each row."""
    if not len(data):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(len(off), np.int64)
    start = data == 0x20
    start[1:] &= data[:-1] != 0x20
    start[off[:-1][off[:-1] < off[1:]]] = True
    start = np.flatnonzero(start)
    coded = strings(data, np.append(start, len(data))).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(start, off)


def _side(codes: np.ndarray, words: list[str], before: np.ndarray, encode, token: list[bytes]):
    """All ids in order, the end of each in bytes, how many there are before each row, and which rows are not given back."""
    ids, sizes, right = _encoded(words, encode, token)
    flat, ends = gathered(ids, np.cumsum(sizes) - sizes, sizes, codes)
    lengths = np.fromiter(map(len, token), np.int64, len(token))
    wrong = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(~right[codes], out=wrong[1:])
    return flat, np.cumsum(lengths[flat]), ends[before], np.flatnonzero(np.diff(wrong[before]))


def _tokens(data: np.ndarray, off: np.ndarray, t: Tokenizers):
    """Ids, ends and numbers before each row for A and for B, and the rows that one of them does not give back."""
    tokenizer, a_bytes = _a(t.a)
    model, b_bytes = _b(t.b)
    space = model.piece_to_id("▁")
    codes, words, before = pretoken_codes(data, off)
    a = _side(codes, words.to_pylist(), before, lambda w: [x.ids for x in tokenizer.encode_batch_fast(w, add_special_tokens=False)], a_bytes)
    codes, words, before = _words(data, off)
    # The model adds the first space itself, but not to an empty text.
    b = _side(codes, words.to_pylist(), before, lambda w: [x or [space] for x in model.encode([x[1:] for x in w], num_threads=1)], b_bytes)
    return a[:3], b[:3], np.union1d(a[3], b[3])


def _digits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of ids, each with a byte after it, and where each begins."""
    table = pa.array([f"{i}," for i in range(int(ids.max()) + 1)] if len(ids) else [], pa.string())
    text = table.take(pa.array(ids))
    off = np.frombuffer(text.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8).copy(), off


def _digests(a_ids: np.ndarray, b_ids: np.ndarray, a_before: np.ndarray, b_before: np.ndarray, row_groups: np.ndarray) -> list[str]:
    """SHA-256 of a1,a2|b1;a3|b2,b3 for each row with tokens; *_before: the tokens before each group, row_groups: the groups before each row."""
    n_a, n_b = np.diff(a_before), np.diff(b_before)
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    out[np.arange(len(a_ids)) + np.repeat(b_before[:-1], n_a)] = a_ids
    out[np.arange(len(b_ids)) + np.repeat(a_before[1:], n_b)] = b_ids
    text, off = _digits(out)
    text[off[a_before[1:] + b_before[:-1]] - 1] = ord("|")
    text[off[a_before[1:] + b_before[1:]] - 1] = ord(";")
    edges = off[(a_before + b_before)[row_groups]]
    return [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(edges[:-1], edges[1:], strict=True)]


def _group_pairs(a_ids: np.ndarray, b_ids: np.ndarray, a_before: np.ndarray, b_before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of ids that share a group: the group, the pair (A id * width + B id), and how often."""
    n_a, n_b = np.diff(a_before), np.diff(b_before)
    links = n_a * n_b
    few = np.flatnonzero(links <= MANY)
    group = np.repeat(few, links[few])
    turn = np.arange(len(group)) - np.repeat(np.cumsum(links[few]) - links[few], links[few])
    i, j = np.divmod(turn, n_b[group])
    groups, pairs, times = [group], [a_ids[a_before[group] + i] * width + b_ids[b_before[group] + j]], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(links > MANY):
        a, a_times = np.unique(a_ids[a_before[g] : a_before[g + 1]], return_counts=True)
        b, b_times = np.unique(b_ids[b_before[g] : b_before[g + 1]], return_counts=True)
        pairs.append((a[:, None] * width + b[None, :]).ravel())
        times.append((a_times[:, None] * b_times[None, :]).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)


def group_spans(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The end of each group in bytes, and the tokens of A and of B before each (one more: all).

    Bytes get the labels none, A end, B end or both; the spans up to each both are found by a regular expression.
    """
    kind = np.zeros(size, np.uint8)
    kind[a_ends - 1] += 1
    kind[b_ends - 1] += 2
    spans = SPANS.findall(np.array([NONE, A_END, B_END, BOTH], np.uint8)[kind].tobytes())
    ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
    before = [np.concatenate([[0], np.cumsum(np.add.reduceat((kind >> k) & 1, ends - np.diff(ends, prepend=0), dtype=np.int64))]) if len(ends) else np.zeros(1, np.int64) for k in (0, 1)]
    return ends, *before


def _chunk(number: int, doc_ids: pa.Array, data: np.ndarray, off: np.ndarray, t: Tokenizers) -> pa.RecordBatch:
    (a_ids, a_ends, a_rows), (b_ids, b_ends, b_rows), wrong = _tokens(data, off, t)
    if len(wrong):
        sizes = np.diff(off)
        keep = np.ones(len(sizes), bool)
        keep[wrong] = False
        return _chunk(number, doc_ids, data[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes * keep)]), t)
    ends, a_before, b_before = group_spans(a_ends, b_ends, len(data))
    row_groups = np.searchsorted(ends, off, "right")
    links = np.concatenate([[0], np.cumsum(np.diff(a_before) * np.diff(b_before))])[row_groups]
    width = len(_b(t.b)[1])
    group, pairs, times = _group_pairs(a_ids, b_ids, a_before, b_before, width)
    row = np.searchsorted(row_groups, group, "right") - 1
    # Equal pairs of a row become one with its times; the chunk keeps its distinct pairs, and the rows their places among them.
    distinct, place = np.unique(pairs, return_inverse=True)
    held, at = np.unique(row * max(1, len(distinct)) + place, return_inverse=True)
    held_times = np.zeros(len(held), np.int64)
    np.add.at(held_times, at, times)
    row, place = np.divmod(held, max(1, len(distinct)))
    docs, sizes = np.bincount(place, minlength=len(distinct)), np.bincount(row, minlength=len(off) - 1)
    sha = _digests(a_ids, b_ids, a_before, b_before, row_groups)
    lists = [doc_ids, *(pa.array(np.diff(x)) for x in (a_rows, b_rows, row_groups, links)), pa.array(sha, pa.string())]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    packed = [pack(distinct), pack(docs.astype(np.uint32)), pack(sizes.astype(np.uint32)), pack(place.astype(np.uint32)), pack(held_times)]
    names = [x.split()[0] for x in CHUNK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([number]), *map(one, lists), *(pa.array([x], pa.binary()) for x in packed)], names=names)


def _chunks(docs: DataFrame, t: Tokenizers, chunk_bytes: int) -> DataFrame:
    """The documents' groups and pairs, a row for each chunk, written once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return _chunk(number, table["doc_id"].combine_chunks(), *utf8(table["text"]), t)

        for b in batches:
            begin = 0
            sizes = np.diff(utf8(b["text"])[1])
            for k, n in enumerate(sizes.tolist()):
                if size and size + n > chunk_bytes:
                    held.append(b.slice(begin, k - begin))
                    yield chunk()
                    number, held, size, begin = number + 1, [], 0, k
                size += n
            held.append(b.slice(begin))
        if held:
            yield chunk()

    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.when(text != "", F.concat(F.lit(" "), text)).otherwise(F.lit("")).alias("text")
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced).mapInArrow(rows, CHUNK))


def pair_documents(chunks: DataFrame, width: int) -> DataFrame:
    """chunk, a, b and docs: the documents of a chunk that hold a pair of ids in a group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, pairs, docs in zip(b["chunk"].to_pylist(), b["pairs"], b["docs"], strict=True):
                x, y = np.divmod(unpack(pairs, np.int64), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), chunk)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(unpack(docs, np.uint32).astype(np.int64))], names=["chunk", "a", "b", "docs"])

    return chunks.select("chunk", "pairs", "docs").mapInArrow(rows, "chunk long, a int, b int, docs long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair) and best (whether no other pair of the A id has more)."""
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("n"))
    return counts.select("a", "b", "n", (F.col("n") == F.max("n").over(Window.partitionBy("a"))).alias("best"))


def _settled(chunks: pa.Table, counts: pa.Table, width: int) -> pa.Table:
    """The documents of one chunk with the sums over their links."""
    column = lambda name: chunks[name][0].values
    key = counts["a"].to_numpy().astype(np.int64) * width + counts["b"].to_numpy()
    order = np.argsort(key)
    n, best = counts["n"].to_numpy()[order], counts["best"].to_numpy()[order].astype(np.int64)
    place, times, sizes = (unpack(chunks[name][0], kind) for name, kind in (("places", np.uint32), ("times", np.int64), ("sizes", np.uint32)))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    sums = [np.diff(np.concatenate([[0], np.cumsum(times * x[place])])[ends]) for x in (best, n)]
    fields = [column("doc_ids"), *(column(x) for x in ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), column("sha")]
    return pa.table(fields, names=[x.split()[0] for x in RESULT.split(", ")])


def alignment(docs: DataFrame, tokenizers: Tokenizers, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """For each document its tokens, groups and links, how many links are the best of their A id, the links' counts, and a digest of the groups."""
    width = len(_b(tokenizers.b)[1])
    chunks = _chunks(docs, tokenizers, chunk_bytes)
    pairs = pair_documents(chunks, width)
    back = pairs.select("chunk", "a", "b").join(pair_counts(pairs), ["a", "b"]).select("chunk", "a", "b", "n", "best")
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lambda x, y: _settled(x, y, width), RESULT)


def aligned(docs: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """doc_id and groups, [([A ids], [B ids]), ...] in order, of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, data in zip(b["doc_id"], b["text"], strict=True):
                found = _groups(data, tokenizers)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([found], pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))], names=["doc_id", "groups"])

    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.when(text != "", F.concat(F.lit(" "), text)).otherwise(F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced).mapInArrow(rows, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def _groups(text: pa.Scalar, t: Tokenizers) -> list[dict[str, list[int]]]:
    data, off = utf8(pa.array([text.as_py()], pa.string()))
    (a_ids, a_ends, _), (b_ids, b_ends, _), wrong = _tokens(data, off, t)
    if len(wrong) or not len(data):
        return []
    _, a, b = group_spans(a_ends, b_ends, len(data))
    return [{"a": a_ids[i:j].tolist(), "b": b_ids[k:m].tolist()} for i, j, k, m in zip(a[:-1], a[1:], b[:-1], b[1:], strict=True)]
