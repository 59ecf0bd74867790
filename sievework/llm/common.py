"""Staged tables and document blocks that several operators share.

A *block* is a set of documents picked by a hash of their id and text, of about ``BLOCK_BYTES`` of text; rows that
are alike are spread over several blocks once they hold ``ALIKE_BYTES`` together, in whatever tasks they lie. Operators that need one fact about every
distinct word (or q-gram) of the corpus first make the distinct keys of each block, deal those to *parts* by key, settle
each key once, and send the answers back to the blocks. So a frequent key costs one row for each block and never one for
each occurrence. Words have ``PARTS`` parts at most, however many blocks there are, and a part's messages are
streamed, so the number of messages grows with the blocks alone and no task holds more than a part's distinct words.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.sources.staging import release_staged, shared_folder, staged

__all__ = ["release_staged", "shared_folder", "staged"]

BLOCK_BYTES = 8 << 20
#: Texts that a task gathers before it packs them by block.
GATHERED_BYTES = 32 << 20
ALIKE_BYTES = 1 << 20
PARTS = 1024
#: Partitions of a table of blocks; more blocks share them.
TASKS = 1 << 14
PACKED = "block int, ids array<long>, sizes binary, data binary"

def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null as empty; other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that hold about ``block_bytes`` of text each, and enough of them to keep all cores busy."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    wanted = min(docs.sparkSession.sparkContext.defaultParallelism, total >> 20)
    return max(1, wanted, math.ceil(total / block_bytes))


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes | pa.Scalar, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data if isinstance(data, bytes) else data.as_py()), kind)


def parts_of(n: int) -> int:
    """Parts for the distinct words of n blocks."""
    return min(n, PARTS)


def in_blocks(docs: DataFrame, n: int) -> DataFrame:
    """The documents of ``texts`` dealt to n blocks, packed: a row holds what one task has for one block, compressed.

    ``docs`` should be a table (or staged), so that a task that is run again has the same rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= GATHERED_BYTES:
                yield from _by_block(held, n)
                held, size = [], 0
        if held:
            yield from _by_block(held, n)

    return _with_turns(docs).mapInArrow(packed, PACKED).repartition(min(n, TASKS), "block")


def _with_turns(docs: DataFrame) -> DataFrame:
    """The rows with their key, and a turn that goes up with every ``ALIKE_BYTES`` of rows that are alike.

    Rows that are alike and hold so much are counted over all tasks, taken once and made again with running numbers, so neither
    their order nor their partitions matter.
    """
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    size = F.octet_length("text")
    many = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max(size).alias("size")).where((F.col("n") > 1) & (F.col("n") * F.col("size") >= ALIKE_BYTES))
    many = staged(many.select("key"))
    if many.isEmpty():
        return keyed.withColumn("turn", F.lit(0).cast("long"))
    rest = keyed.join(many, "key", "left_anti").select("doc_id", "text", "key", F.lit(0).cast("long").alias("turn"))
    once = keyed.join(many, "key", "left_semi").groupBy("doc_id", "text", "key").agg(F.count("*").alias("n"))
    again = once.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rest.unionAll(again.select("doc_id", "text", "key", F.floor(F.col("k") * size / ALIKE_BYTES).cast("long").alias("turn")))


# Messages (part, block, data) between blocks and parts where a part has to see all of its messages at once.

MESSAGE = "part int, block int, data binary"
#: Up to so many blocks and parts, a block sends a row to each part; beyond, rows go in bundles by way of a hop.
DIRECT = 2048
#: Blocks whose messages one part takes, beyond DIRECT.
SHARE = 16
REGROUPED_BYTES = 64 << 20


@dataclass(frozen=True)
class Exchange:
    """n blocks and n parts that send each other messages; about n * sqrt(n) rows, not n * n, beyond ``direct``."""

    blocks: int
    direct: int = DIRECT

    @property
    def parts(self) -> int:
        return self.blocks if self.blocks <= self.direct else max(self.direct, math.ceil(self.blocks / SHARE))

    @property
    def bundled(self) -> bool:
        return self.blocks > self.direct

    def rows(self, sender: int, messages: dict[int, bytes], to: str) -> pa.Table:
        """One block's messages by part (to = 'part'), or one part's by block."""
        if self.bundled:
            width = math.isqrt(self.parts if to == "part" else self.blocks) + 1
            bundles: dict[int, list[tuple[int, bytes]]] = {}
            for k, m in messages.items():
                bundles.setdefault(k // width, []).append((k, m))
            messages = {k: pickle.dumps(x, 5) for k, x in bundles.items()}
        keys, senders, data = pa.array(list(messages), pa.int32()), pa.array([sender] * len(messages), pa.int32()), pa.array(list(messages.values()), pa.binary())
        return pa.table([keys, senders, data] if to == "part" else [senders, keys, data], names=["part", "block", "data"])

    def arrived(self, messages: DataFrame, to: str) -> DataFrame:
        """The messages, those to one receiver in a few rows; ``read`` takes them apart."""
        if not self.bundled:
            return messages
        sender = "block" if to == "part" else "part"

        def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[int, bytes]]] = {}
            size, bundle = 0, None

            def rows() -> pa.RecordBatch:
                keys = pa.array(list(held), pa.int32())
                nobody = pa.array([-1] * len(held), pa.int32())
                data = pa.array([pickle.dumps(x, 5) for x in held.values()], pa.binary())
                return pa.RecordBatch.from_arrays([keys, nobody, data] if to == "part" else [nobody, keys, data], names=["part", "block", "data"])

            for b in batches:
                for own, who, data in zip(b[to].to_pylist(), b[sender].to_pylist(), b["data"], strict=True):
                    if held and (own != bundle or size >= REGROUPED_BYTES):
                        yield rows()
                        held, size = {}, 0
                    bundle = own
                    for k, m in pickle.loads(data.as_buffer()):
                        held.setdefault(k, []).append((who, m))
                        size += len(m)
            if held:
                yield rows()

        width = math.isqrt(self.parts if to == "part" else self.blocks) + 1
        return messages.repartition(width, to).sortWithinPartitions(to, sender).mapInArrow(regroup, MESSAGE)

    def read(self, table: pa.Table, to: str) -> list[tuple[int, bytes]]:
        """(sender, message) of the rows of one receiver, by sender."""
        if not self.bundled:
            sender = "block" if to == "part" else "part"
            return sorted(zip(table[sender].to_pylist(), table["data"].to_pylist(), strict=True))
        return sorted(x for data in table["data"] for x in pickle.loads(data.as_buffer()))


def _blocks(keys: np.ndarray, turns: np.ndarray, n: int) -> np.ndarray:
    """The block of each row, by its key and turn."""
    from sievework.llm.kernels import mixed

    return (mixed(keys.astype(np.uint64) + turns.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int32)


def _by_block(held: list[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    from sievework.llm.kernels import utf8

    table = pa.Table.from_batches(held)
    if not table.num_rows:
        return
    blocks = _blocks(table["key"].to_numpy(), table["turn"].to_numpy(), n)
    order = np.argsort(blocks, kind="stable")
    table, blocks = table.take(pa.array(order)), blocks[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = table.slice(a, b - a)
        data, off = utf8(part["text"])
        ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), part["doc_id"].combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([blocks[a]], pa.int32()), ids, pa.array([pack(np.diff(off).astype(np.uint32))], pa.binary()), pa.array([pack(data)], pa.binary())], names=["block", "ids", "sizes", "data"])


def by_part(messages: DataFrame, n: int, answer: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *order: str) -> DataFrame:
    """``answer`` streams the messages, those of a part one after another, by ``order``; nothing holds a whole part."""
    return messages.repartition(n, "part").sortWithinPartitions("part", *order).mapInArrow(answer, schema)


def unpacked(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, bytes and row offsets of all documents in the packed rows."""
    ids = pa.concat_arrays([x.flatten() for x in table["ids"].chunks])
    off = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(np.concatenate([unpack(x, np.uint32) for x in table["sizes"]]), out=off[1:])
    data = np.empty(off[-1], np.uint8)
    at = 0
    for x in table["data"]:
        part = unpack(x)
        data[at : at + len(part)] = part
        at += len(part)
    return ids, data, off


def dealt(words: list[bytes], which: Iterable[int], n: int) -> list[list[int]]:
    """The places of the chosen distinct words, dealt to n parts by a hash; those of a part are in the words' order."""
    places: list[list[int]] = [[] for _ in range(n)]
    for w, i in sorted((words[i], i) for i in which):
        places[crc32(w) % n].append(i)
    return places


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    """Sizes and joined bytes of words."""
    return pack(np.array([len(w) for w in words], np.uint32)), zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(sizes: bytes | pa.Scalar, joined: bytes | pa.Scalar) -> list[bytes]:
    data = unpack(joined).tobytes()
    ends = np.cumsum(unpack(sizes, np.uint32), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]
