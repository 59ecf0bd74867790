"""Operator 7: a log-bilinear language model, trained with noise-contrastive estimation.

Each block of documents is cut into words once. Its distinct words go to parts by their hash with their training counts,
so all words of the corpus are counted exactly, and the counts come back to the blocks.

The most frequent words get vectors of their own: ``16 * N**(1/3)`` of them for N training tokens, so the vocabulary grows
with the corpus. All other words share hashed classes (one vector in ``TAIL``); inside a class a word has its add-one share
of the class's exact counts. The end of a text is a token too, and as a context the beginning.

The context is the ``CONTEXT`` tokens before a place: their vectors, each weighted by its position's own vector, add up to a
prediction, and a token scores the product of prediction and its vector, plus a bias. Tokens of like frequency form groups of
about the square root of the vocabulary: the probability of a token is that of its group times that inside its group,
each normalised by a batched matrix product.

In each round every block starts from the same model and takes numpy gradient steps that tell its tokens from noise (of
groups, and of tokens of the same group); each of its tokens is a target in one of the rounds, and in all of them in a small corpus; the models are averaged by their number of tokens in whole numbers, so neither the
order nor the partitions matter. Blocks and their number follow from the documents alone: the same documents
give the same model and scores on every cluster.

Defined results: null or empty text is one end token; a null doc_id counts as a training document; without training
documents N and V are 0 and all scores are finite; repeated rows count each; an empty table gives no rows; a text of any
length is scored whole, in one task; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import by_part, in_blocks, pack, pack_words, parts_of, staged, texts, unpack, unpack_words, unpacked
from sievework.llm.kernels import LOWER, word_codes

FOLDS, HELD = 7, 2
BLOCK_BYTES = 8 << 20
CONTEXT, WIDTH, TAIL = 3, 16, 8
#: In each round a block takes steps over its own share of its tokens, so that all rounds together have every token as a target once.
ROUNDS, BATCH, RATE = 2, 2048, 0.06
#: Noise samples that count for each token, and the groups drawn for a batch.
NOISE, SHARED_NOISE, GROUP_NOISE = 8.0, 24, 3
#: Steps of a block in a round, at least; a corpus of a few documents is gone over several times.
MIN_STEPS = 150
#: Parameters are averaged as multiples of this, in slices of so many.
UNIT, SLICE = 2.0**-24, 1 << 17
_DEALS = 64
_END = 0


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))


def _trains(ids: pa.Array) -> np.ndarray:
    return np.array([i is None or crc32(str(i).encode()) % FOLDS != HELD for i in ids.to_pylist()], bool)


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """The number of blocks, by the size of the texts alone."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(1, math.ceil(total / block_bytes))


# Words and their counts.

CODED = "kind int, part int, block int, ids array<long>, sizes binary, words binary, counts binary, n long"


def _in_order(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids, bytes and row offsets of a block, in an order that doesn't depend on how the rows came."""
    ids, data, off = unpacked(table)
    data = np.ascontiguousarray(data)
    known = ids.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.lexsort((np.array([crc32(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint32), np.diff(off), known))
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(off), pa.py_buffer(data)]).take(pa.array(order))
    off = np.frombuffer(both.buffers()[1], np.int64, len(ids) + 1)
    return ids.take(pa.array(order)), np.frombuffer(both.buffers()[2] or b"", np.uint8), off


def coded(docs: DataFrame, n: int) -> DataFrame:
    """For each block one row of kind 0 (ids, words a document, codes of all words, words of each part, training documents) and for each part one of kind 1 (its words, their training counts)."""
    parts = parts_of(n)

    def code(table: pa.Table) -> pa.Table:
        ids, data, off = _in_order(table)
        codes, words, before = word_codes(LOWER[data], off)
        raw = words.cast(pa.binary()).to_pylist()
        part = np.fromiter((crc32(w) % parts for w in raw), np.int32, len(raw))
        order = np.argsort(part, kind="stable")
        place = np.empty(len(raw), np.uint32)
        place[order] = np.arange(len(raw))
        trains = _trains(ids)
        counts = np.bincount(codes[np.repeat(trains, np.diff(before))], minlength=len(raw))
        sizes = np.bincount(part, minlength=parts)
        ends = np.cumsum(sizes)
        block = table["block"][0].as_py()
        rows = [(0, -1, block, ids.to_pylist(), pack(np.diff(before).astype(np.uint32)), pack(place[codes]), pack(sizes.astype(np.uint32)), int(trains.sum()))]
        for p in np.flatnonzero(sizes):
            own = order[ends[p] - sizes[p] : ends[p]]
            rows.append((1, int(p), block, None, *pack_words([raw[i] for i in own]), pack(counts[own].astype(np.uint32)), 0))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "part", "block", "ids", "sizes", "words", "counts", "n"])

    return in_blocks(docs, n).groupBy("block").applyInArrow(code, CODED)


TOTALS = "part int, sizes binary, words binary, counts binary, n long, v long"


def word_counts(messages: DataFrame, parts: int) -> DataFrame:
    """One row for each part: its training words, their counts, and the sum and number of these."""

    def row(part: int, found: dict[bytes, int]) -> pa.RecordBatch:
        words = [w for w, c in found.items() if c]
        counts = np.array([found[w] for w in words], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in pack_words(words)), pa.array([pack(counts)], pa.binary()), pa.array([int(counts.sum())]), pa.array([len(words)])], names=["part", "sizes", "words", "counts", "n", "v"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = None, {}
        for b in batches:
            for p, sizes, words, counts in zip(b["part"].to_pylist(), b["sizes"], b["words"], b["counts"], strict=True):
                if p != part:
                    if found:
                        yield row(part, found)
                    part, found = p, {}
                for w, c in zip(unpack_words(sizes, words), unpack(counts, np.uint32).tolist(), strict=True):
                    found[w] = found.get(w, 0) + c
        if found:
            yield row(part, found)

    return by_part(messages.select("part", "sizes", "words", "counts"), parts, total, TOTALS)


def frequent_words(totals: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words with their counts."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sizes, words, c in zip(b["sizes"], b["words"], b["counts"], strict=True):
                words, c = unpack_words(sizes, words), unpack(c, np.int64)
                # Ties at the last place are settled by the word.
                best = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))[:most] if len(words) > most else range(len(words))
                yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in best], pa.binary()), pa.array(c[list(best)], pa.int64())], names=["word", "n"])

    rows = totals.mapInArrow(top, "word binary, n long").orderBy(F.col("n").desc(), "word").limit(most).collect()
    return [(bytes(r["word"]), r["n"]) for r in rows]


# The model.


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by their number: the end, then classes and words, most frequent first."""

    words: dict[bytes, int]
    classes: np.ndarray  # the token of each class of other words
    counts: np.ndarray  # of each token
    kinds: np.ndarray  # distinct words of each token (1 but for classes)
    total: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.counts)

    @cached_property
    def width(self) -> int:
        """Tokens in a group."""
        return max(2, math.ceil(math.sqrt(self.size)))

    @cached_property
    def groups(self) -> int:
        return math.ceil(self.size / self.width)

    def token(self, word: bytes, parts: int) -> int:
        found = self.words.get(word)
        return int(self.classes[class_of(word, parts, len(self.classes))]) if found is None else found

    def shares(self) -> np.ndarray:
        """The add-one share of each token, with zeros up to whole groups."""
        q = np.zeros(self.groups * self.width)
        q[: self.size] = self.counts + 1.0
        return q / q.sum()


def class_of(word: bytes, parts: int, classes: int) -> int:
    return crc32(word) // parts % classes


def vocabulary_of(totals: DataFrame, ends: int, parts: int) -> Vocabulary:
    n, v = totals.agg(F.sum("n"), F.sum("v")).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    size = math.ceil(16 * n ** (1 / 3))
    classes = max(1, size // TAIL)
    frequent = dict(frequent_words(totals, max(1, size - classes - 1)))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, classes), np.int64)
        for b in batches:
            for sizes, words, c in zip(b["sizes"], b["words"], b["counts"], strict=True):
                for w, x in zip(unpack_words(sizes, words), unpack(c, np.int64).tolist(), strict=True):
                    if w not in frequent:
                        k = class_of(w, parts, classes)
                        found[0, k] += x
                        found[1, k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(found[0]), pa.array(found[1])], names=["class", "n", "v"])

    counts, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in totals.mapInArrow(rest, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # one row a class
        counts[r["class"]], kinds[r["class"]] = r["n"], r["v"]
    keys: list[bytes | int] = [*frequent, *range(classes)]
    own = np.concatenate([np.array(list(frequent.values()), np.int64), counts])
    kinds = np.concatenate([np.ones(len(frequent), np.int64), kinds])
    order = np.argsort(-own, kind="stable")
    words, tokens = {}, np.zeros(classes, np.int64)
    for k, i in enumerate(order.tolist()):
        if isinstance(keys[i], bytes):
            words[keys[i]] = k + 1
        else:
            tokens[keys[i]] = k + 1
    return Vocabulary(words, tokens, np.concatenate([[ends], own[order]]), np.concatenate([[1], kinds[order]]), n, v)


class Parameters:
    """Vectors of contexts, of positions, of tokens and of groups, and biases, as views of one array."""

    def __init__(self, vocabulary: Vocabulary, values: np.ndarray | None = None):
        groups, width = vocabulary.groups, vocabulary.width
        k = groups * width
        shapes = [(k, WIDTH), (CONTEXT, WIDTH), (k, WIDTH), (groups, WIDTH), (k,), (groups,)]
        ends = np.cumsum([0, *(math.prod(s) for s in shapes)])
        if values is None:
            values = np.random.RandomState(7).normal(0, 0.1, ends[-1]).astype(np.float32)
            q = vocabulary.shares()
            of_group = q.reshape(groups, width).sum(1)
            values[ends[1] : ends[2]] = np.repeat(1 / (1 + np.arange(CONTEXT)), WIDTH)
            values[ends[4] : ends[5]] = np.log(np.maximum(q / np.repeat(of_group, width), 1e-12))
            values[ends[5] :] = np.log(of_group)
        self.values = np.array(values, np.float32)
        self.context, self.position, self.token, self.group, self.bias, self.group_bias = (self.values[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True))


def contexts(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The CONTEXT tokens before each place, the nearest first; before the beginning stands the end token."""
    out = np.full((CONTEXT, len(tokens)), _END, np.int64)
    for j in range(1, CONTEXT + 1):
        out[j - 1, j:] = np.where(np.arange(j, len(tokens)) - j >= begin[j:], tokens[: len(tokens) - j], _END)
    return out


def _runs(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal rows together, where each run of them begins, and the row of each run."""
    order = np.argsort(rows.astype(np.uint16) if most <= 1 << 16 else rows, kind="stable")  # short numbers are sorted by radix
    rows = rows[order]
    first = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
    return order, first, rows[first]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def targets(tokens: int, block: int, number: int) -> np.ndarray:
    """The places of a block's tokens that a round goes over, in random order: each place in one of the rounds."""
    return np.random.RandomState(block).permutation(tokens)[number::ROUNDS]


def contrastive_steps(vocabulary: Vocabulary, start: np.ndarray | None, tokens: np.ndarray, begin: np.ndarray, order: np.ndarray, seed: int) -> np.ndarray:
    """Noise-contrastive gradient steps (AdaGrad) over the places in ``order``; gives all parameters in one array.

    The last step is filled up with other places, and where there are few, all are gone over until ``MIN_STEPS`` are taken.
    """
    steps = max(MIN_STEPS, math.ceil(len(order) / BATCH))
    p = Parameters(vocabulary, start)
    width = vocabulary.width
    q = vocabulary.shares()
    of_group = q.reshape(-1, width).sum(1)
    group_ends, token_ends = np.cumsum(of_group), np.concatenate([[0.0], np.cumsum(q)])
    group_offset = np.log(NOISE * of_group).astype(np.float32)
    offset = np.log(GROUP_NOISE * np.maximum(q / np.repeat(of_group, width), 1e-12)).astype(np.float32)
    around = contexts(tokens, begin)
    random = np.random.RandomState(seed)
    seen = {k: np.full(len(a), 1e-2, np.float32) for k, a in (("context", p.context), ("position", p.position), ("token", p.token), ("group", p.group), ("bias", p.bias), ("group_bias", p.group_bias))}

    def step(name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        array, squares = getattr(p, name), seen[name]
        if gradient.ndim == 2:
            squares[rows] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
            array[rows] += gradient * (RATE / np.sqrt(squares[rows]))[:, None]
        else:
            squares[rows] += gradient**2
            array[rows] += gradient * (RATE / np.sqrt(squares[rows]))

    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    for _ in range(steps):
        while len(order) < BATCH:
            order = np.concatenate([order, random.permutation(len(tokens))])
        at, order = order[:BATCH], order[BATCH:]
        w = tokens[at]
        by_token, first, row = _runs(w, len(p.bias))  # tokens of a group are neighbours, so this brings groups together too
        at, w = at[by_token], w[by_token]
        c, g = around.take(at, axis=1), w // width
        held = p.context.take(c, axis=0)  # CONTEXT x BATCH x WIDTH
        guess = np.einsum("jbd,jd->bd", held, p.position)
        # Groups: noise that the whole batch shares.
        noise = np.minimum(np.searchsorted(group_ends, random.random_sample(SHARED_NOISE)), len(group_ends) - 1)
        vg, vn = p.group.take(g, axis=0), p.group[noise]
        up = _sigmoid(group_offset[g] - dot(guess, vg) - p.group_bias[g])
        down = (NOISE / SHARED_NOISE) * _sigmoid(guess @ vn.T + p.group_bias[noise] - group_offset[noise])
        back = up[:, None] * vg - down @ vn
        # Tokens: noise of the same group, which its tokens in the batch share.
        edge = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
        group = g[edge]
        low = token_ends[group * width]
        drawn = low[:, None] + random.random_sample((len(group), GROUP_NOISE)) * (token_ends[(group + 1) * width] - low)[:, None]
        other = np.clip(np.searchsorted(token_ends, drawn, "right") - 1, 0, vocabulary.size - 1)
        of = np.repeat(np.arange(len(group)), np.diff(np.append(edge, BATCH)))
        vw = p.token.take(w, axis=0)
        up_own = _sigmoid(offset[w] - dot(guess, vw) - p.bias[w])
        back += up_own[:, None] * vw
        apart = []
        for k in range(GROUP_NOISE):
            o = other[:, k]
            vo = p.token[o].take(of, axis=0)
            away = _sigmoid(dot(guess, vo) + (p.bias[o] - offset[o]).take(of))
            back -= away[:, None] * vo
            apart.append((o, -np.add.reduceat(away[:, None] * guess, edge, axis=0), -np.add.reduceat(away, edge)))
        for o, vectors, biases in apart:  # a token may be drawn again
            for_row, start_at, drawn_row = _runs(o, len(p.bias))
            step("token", drawn_row, np.add.reduceat(vectors[for_row], start_at, axis=0))
            step("bias", drawn_row, np.add.reduceat(biases[for_row], start_at))
        step("token", row, np.add.reduceat(up_own[:, None] * guess, first, axis=0))
        step("bias", row, np.add.reduceat(up_own, first))
        step("group", group, np.add.reduceat(up[:, None] * guess, edge, axis=0))
        step("group_bias", group, np.add.reduceat(up, edge))
        by_noise, start_at, noise_row = _runs(noise, len(p.group_bias))
        step("group", noise_row, np.add.reduceat(-(down.T @ guess)[by_noise], start_at, axis=0))
        step("group_bias", noise_row, np.add.reduceat(-down.sum(0)[by_noise], start_at))
        by_context, start_at, context_row = _runs(c.ravel(), len(p.bias))
        step("context", context_row, np.add.reduceat((p.position[:, None, :] * back).reshape(-1, WIDTH).take(by_context, axis=0), start_at, axis=0))
        step("position", np.arange(CONTEXT), np.einsum("jbd,bd->jd", held, back) / 16)  # every token moves these, so they go slower
    return p.values


def log10_chances(vocabulary: Vocabulary, p: Parameters, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    """log10 of the normalised probability of each token after its context."""
    width = vocabulary.width
    guess = np.zeros((len(tokens), WIDTH), np.float32)
    for j in range(CONTEXT):
        guess += (p.context * p.position[j]).take(around[j], axis=0)

    def chance(logits: np.ndarray, own: np.ndarray) -> np.ndarray:
        if logits.max(initial=0) > 80 or logits.min(initial=0) < -80:
            logits -= logits.max(1, keepdims=True)
        chosen = logits[np.arange(len(own)), own]
        np.exp(logits, out=logits)
        return chosen - np.log(logits @ np.ones(logits.shape[1], np.float32))

    g = tokens // width
    out = chance(guess @ p.group.T + p.group_bias, g)
    order = np.argsort(g, kind="stable")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(g[order])) + 1, [len(g)]]) if len(g) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        first = int(g[own[0]]) * width
        last = min(first + width, vocabulary.size)
        out[own] += chance(guess.take(own, axis=0) @ p.token[first:last].T + p.bias[first:last], tokens[own] - first)
    return out.astype(np.float64) / math.log(10)


# Sequences of tokens.

SEQUENCES = "block int, ids array<long>, sizes binary, known binary, base binary, rare binary, tokens binary"


def sequences(rows: DataFrame, totals: DataFrame, vocabulary: Vocabulary, parts: int) -> DataFrame:
    """For each block: ids, tokens a document, known tokens, base score, the log10 counts of words in classes, and all tokens."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for b in batches:
            out = []
            for i, (kind, sizes, words) in enumerate(zip(b["kind"].to_pylist(), b["sizes"], b["words"], strict=True)):
                own = unpack_words(sizes, words)
                if kind == 0:
                    found = dict(zip(own, unpack(b["counts"][i], np.int64).tolist(), strict=True))
                    found[b""] = b["part"][i].as_py()  # no word is empty
                    continue
                if found.get(b"") != b["part"][i].as_py():
                    found = {}  # a part without training words
                counts = np.fromiter((found.get(w, 0) for w in own), np.int64, len(own))
                tokens = np.fromiter((vocabulary.token(w, parts) for w in own), np.uint32, len(own))
                out.append((b["block"][i].as_py(), b["part"][i].as_py(), pack(counts.view(np.uint8).reshape(-1, 8).T.copy()), pack(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int32() if k < 2 else pa.binary()) for k in range(4)], names=["block", "part", "counts", "tokens"])

    own = totals.select(F.lit(0).alias("kind"), "part", F.lit(-1).alias("block"), "sizes", "words", "counts")
    asked = rows.where("kind = 1").select("kind", "part", "block", "sizes", "words", F.lit(None).cast("binary").alias("counts"))
    back = by_part(own.unionAll(asked), parts, tell, "block int, part int, counts binary, tokens binary", "kind", "block")
    base = math.log10(vocabulary.total + vocabulary.distinct + 1)
    own_class = np.zeros(vocabulary.size, bool)
    own_class[vocabulary.classes] = True
    ends = int(vocabulary.counts[_END])

    def assembled(table: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for i in range(table.num_rows):
            sizes, codes = unpack(table["sizes"][i], np.uint32).astype(np.int64), unpack(table["words"][i], np.uint32)
            order = np.argsort(back["part"].to_numpy()).tolist()
            counts = np.concatenate([np.zeros(0, np.int64), *(np.ascontiguousarray(unpack(back["counts"][k]).reshape(8, -1).T).reshape(-1).view(np.int64) for k in order)])
            tokens = np.concatenate([np.zeros(0, np.uint32), *(unpack(back["tokens"][k], np.uint32) for k in order)])
            row = np.repeat(np.arange(len(sizes)), sizes)
            rare = np.log10(counts + 1.0)
            sums = lambda x: np.bincount(row, x[codes], len(sizes))
            known = sums((counts > 0).astype(np.float64)).astype(np.int64) + (ends > 0)
            score = sums(rare - base) + math.log10(ends + 1) - base
            every = np.full(len(codes) + len(sizes), _END, np.uint32)
            every[np.arange(len(codes)) + row] = tokens[codes]
            out.append((table["block"][i].as_py(), table["ids"][i].as_py(), pack(sizes + 1), pack(known), pack(score), pack(sums(np.where(own_class[tokens], rare, 0.0))), pack(every)))
        kinds = (pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 5)
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["block", "ids", "sizes", "known", "base", "rare", "tokens"])

    blocks = rows.where("kind = 0").select("block", "ids", "sizes", "words")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assembled, SEQUENCES)


def _training(ids: pa.ListScalar, sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a block's training documents, and where each one's document begins."""
    trains = _trains(ids.values)
    kept = tokens[np.repeat(trains, sizes)].astype(np.int64)
    sizes = sizes[trains]
    return kept, np.repeat(np.cumsum(sizes) - sizes, sizes)


def train_round(blocks: DataFrame, vocabulary: Vocabulary, start: np.ndarray | None, number: int) -> np.ndarray | None:
    """Every block trains from the same model; the parameters are averaged by the number of its tokens."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0
        for b in batches:
            for block, ids, sizes, tokens in zip(b["block"].to_pylist(), b["ids"], b["sizes"], b["tokens"], strict=True):
                tokens, begin = _training(ids, unpack(sizes, np.int64), unpack(tokens, np.uint32))
                if not len(tokens):
                    continue
                x = contrastive_steps(vocabulary, start, tokens, begin, targets(len(tokens), block, number), block * ROUNDS + number)
                own = 1 + len(tokens) // 1024
                x = np.rint(x / UNIT).astype(np.int64) * own
                total, weight = (x if total is None else total + x), weight + own
        if weight:
            deal = TaskContext.get().partitionId() % _DEALS
            slices = [total[i : i + SLICE] for i in range(0, len(total), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array([deal] * len(slices), pa.int32()), pa.array([weight] * len(slices)), pa.array([pack(x) for x in slices], pa.binary())], names=["slice", "deal", "weight", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, weight, total = None, 0, np.zeros(0, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([weight]), pa.array([pack(total)], pa.binary())], names=["slice", "deal", "weight", "total"])

        for b in batches:
            for own, w, x in zip(zip(b["slice"].to_pylist(), b["deal"].to_pylist(), strict=True), b["weight"].to_pylist(), b["total"], strict=True):
                if own != key:
                    if key is not None:
                        yield row()
                    key, weight, total = own, 0, np.zeros(1, np.int64)
                weight, total = weight + w, total + unpack(x, np.int64)
        if key is not None:
            yield row()

    schema = "slice int, deal int, weight long, total binary"
    rows = blocks.mapInArrow(train, schema)
    for keys in (("slice", "deal"), ("slice",)):
        rows = rows.repartition(*keys).sortWithinPartitions("slice", "deal").mapInArrow(add, schema)
        rows = rows.withColumn("deal", F.lit(0))
    found = rows.orderBy("slice").collect()  # one model, or none
    if not found:
        return start
    return (UNIT * np.concatenate([unpack(bytes(r["total"]), np.int64) / r["weight"] for r in found])).astype(np.float32)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    values: np.ndarray | None


def fit(blocks: DataFrame, vocabulary: Vocabulary) -> Model:
    """The model of staged sequences, one block a row."""
    values = None
    for k in range(ROUNDS):
        values = train_round(blocks, vocabulary, values, k)
    return Model(vocabulary, values)


# Scores.

#: Tokens that are scored at a time.
AT_A_TIME = 1 << 16


def scores(blocks: DataFrame, model: Model) -> DataFrame:
    """Tokens, known tokens, base score and the model's log10 probability of every document of the sequences."""
    vocabulary = model.vocabulary
    # A word of a class has a share of the class; one share is left for all words that training never met.
    inside = np.zeros(vocabulary.size)
    inside[vocabulary.classes] = np.log10(vocabulary.counts[vocabulary.classes] + vocabulary.kinds[vocabulary.classes] + 1.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parameters(vocabulary, model.values)
        for b in batches:
            for i in range(b.num_rows):
                sizes, tokens = unpack(b["sizes"][i], np.int64), unpack(b["tokens"][i], np.uint32).astype(np.int64)
                ends = np.cumsum(sizes)
                around = contexts(tokens, np.repeat(ends - sizes, sizes))
                chance = np.empty(len(tokens))
                for k in range(0, len(tokens), AT_A_TIME):
                    own = slice(k, k + AT_A_TIME)
                    chance[own] = log10_chances(vocabulary, p, tokens[own], around[:, own])
                chance -= inside[tokens]
                total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), chance, len(sizes)) + unpack(b["rare"][i], np.float64)
                yield pa.RecordBatch.from_arrays([b["ids"][i].values, pa.array(sizes), pa.array(unpack(b["known"][i], np.int64)), pa.array(unpack(b["base"][i], np.float64)), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return blocks.mapInArrow(rows, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def _prepared(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, Vocabulary]:
    """Staged sequences of the blocks, and the vocabulary."""
    n = blocks_of(docs, block_bytes)
    parts = parts_of(n)
    rows = staged(coded(docs, n), "kind")
    totals = staged(word_counts(rows.where("kind = 1"), parts))
    vocabulary = vocabulary_of(totals, rows.where("kind = 0").agg(F.sum("n").alias("n")).first()["n"] or 0, parts)
    return staged(sequences(rows, totals, vocabulary, parts)), vocabulary


def base_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What can be said without the model: doc_id, held_out, n_tokens, n_known, train_tokens and base_score of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, sizes, known, base in zip(b["ids"], b["sizes"], b["known"], b["base"], strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(unpack(sizes, np.int64)), pa.array(unpack(known, np.int64)), pa.array(unpack(base, np.float64))], names=["doc_id", "n_tokens", "n_known", "base_score"])

    blocks, vocabulary = _prepared(texts(documents, id_col, text_col), block_bytes)
    found = blocks.select("ids", "sizes", "known", "base").mapInArrow(rows, "doc_id long, n_tokens long, n_known long, base_score double")
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score")


def scored(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    blocks, vocabulary = _prepared(texts(documents, id_col, text_col), block_bytes)
    return scores(blocks, fit(blocks, vocabulary)).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")
