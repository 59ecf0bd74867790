"""Operator 6: removes repeated 50-byte strings, by bucket-pointer refinement of q-gram buckets.

Sorting all suffixes by 50 bytes would move every byte of the corpus. Instead a sparse set of suffixes is kept:
in every 50-byte string the q-gram (``Q`` bytes) with the smallest hash is an anchor, so equal strings have equal
anchors at equal offsets. The initial buckets are those of the anchors' q-grams, and only suffixes whose bucket is still
shared go on:

1. The bucket of an anchor is its q-gram. Buckets that lie in one document only are done.
2. Copies are taken together: anchors with the same context (all bytes of the strings that can hold the anchor) count as
   one, which belongs to the smallest doc_id that has it. A context that a smaller doc_id has too settles its strings at once;
   so does a bucket with a single context.
3. Buckets with several contexts are refined. In a part, every offset of its contexts begins with the bucket of its first
   8 bytes. Offsets of shared buckets are then sorted by their bucket identifier and that of the offset 8 later, which
   gives identifiers of 16 bytes; these are used again for 32 bytes and for all 50. Then each string's bucket tells the smallest
   doc_id that has it. Identifiers stand for the bytes themselves, so no two strings are confused.
   A bucket with more than ``HOT`` contexts would be too large for a part; its strings are dealt by a 128-bit hash instead.

Each step deals the distinct keys of a block once (a frequent one costs a row for each block), and the answer goes
back to the block. Bucket numbers are 48-bit hashes, where a clash costs only work; contexts are compared by 128-bit hashes.
Above some thousands of blocks, messages travel in bundles (``common.Exchange``).

Defined results: null or empty text is kept as it is; documents with the same doc_id don't remove from each other;
a null doc_id counts as the largest; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored,
whatever their names; a text of any length is handled whole, in one task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from sievework.llm.common import BLOCK_BYTES, DIRECT, MESSAGE, Exchange, block_count, in_blocks, texts, unpacked
from sievework.llm.kernels import byte_values, mixed, prefix, slices, span_hashes

SIZE, Q = 50, 26
W = SIZE - Q + 1
HOT = 2000
_TOP = np.uint64(16)
_ODD, _ODD_TOO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_OTHER = np.random.RandomState(77).randint(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_ID = np.iinfo(np.int64).max
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: The bytes that identifiers stand for, by round; each is made of two of the round before.
FIRST, ROUNDS = 8, (16, 32, SIZE)
#: Contexts that are refined at a time.
REFINED_BYTES = 1 << 20


def _dump(**arrays: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, 5))


def _load(data: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second, and so on: small numbers compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _of_planes(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _steps(x: np.ndarray) -> bytes:
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _of_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(data), dtype=np.uint64)


def _bits(x: np.ndarray) -> tuple[bytes, int]:
    return np.packbits(x).tobytes(), len(x)


def _of_bits(x: tuple[bytes, int]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x[0], np.uint8), count=x[1]).astype(bool)


def _sliding(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each W neighbours, by doubling."""
    span = 1
    while 2 * span <= W:
        x = pick(x[: len(x) - span], x[span:])
        span *= 2
    rest = W - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def _in_order(table: pa.Table) -> pa.Table:
    """The packed rows of a block by what they hold, since a block's rows come in another order in each step."""
    ids = [x.values.fill_null(_NO_ID).to_numpy(zero_copy_only=False).tobytes() for x in table["ids"]]
    held = list(zip(table["sizes"].to_pylist(), ids, table["data"].to_pylist(), strict=True))
    return table.take(pa.array(sorted(range(len(held)), key=held.__getitem__), pa.int64()))


class _Anchors:
    """The anchors of a block: place, row and bucket; and, once it is known where they are, context and the bytes before and after that belong to it.

    The first step finds the anchors; the answers bring their places back as bits, so later steps only hash what they need.
    """

    def __init__(self, table: pa.Table, told: list[dict] | None = None):
        ids, self.data, self.off = unpacked(_in_order(table))
        self.ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.doc_ids = ids
        bits = None if told is None else np.unpackbits(np.frombuffer(b"".join(x["p"] for x in told), np.uint8), count=len(self.data)).astype(bool)
        found = [self._first(i, j) if bits is None else self._known(bits, i, j) for i, j in slices(self.off)]
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.int64)
        self.at, self.row, self.bucket, *rest = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate(kinds[: 3 if bits is None else 7]))
        if bits is not None:
            self.context, self.other, self.left, self.right = rest
        self.id = self.ids[self.row]
        self.buckets, self.of_bucket = np.unique(self.bucket, return_inverse=True)

    def places(self, parts: int) -> list[bytes]:
        """The anchors' places as bits, cut into a piece for each part."""
        bits = np.zeros(len(self.data), bool)
        bits[self.at] = True
        packed = np.packbits(bits).tobytes()
        size = -(-len(packed) // parts)
        return [packed[k * size : (k + 1) * size] for k in range(parts)]

    def _first(self, i: int, j: int) -> tuple[np.ndarray, ...]:
        data, off = self.data[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i]
        none = np.zeros(0, np.int64)
        if len(data) < SIZE:
            return none, none, none.astype(np.uint64)
        sums = prefix(byte_values(data))
        n = len(data) - Q + 1
        start = np.arange(n)
        h = span_hashes(sums, start, start + Q)
        end = np.repeat(off[1:], np.diff(off))
        h[start + Q > end[:n]] = np.iinfo(np.uint64).max
        low = _sliding(h, np.minimum)  # of the string that begins here
        low[np.arange(len(low)) + SIZE > end[: len(low)]] = 0
        pad = np.zeros(W - 1, np.uint64)
        high = _sliding(np.concatenate([pad, low, pad]), np.maximum)  # of the strings that hold this q-gram
        at = np.flatnonzero((h == high) & (start + Q <= end[:n]) & (high > 0))
        return at + self.off[i], np.searchsorted(off, at, "right") - 1 + i, h[at] >> _TOP

    def _known(self, bits: np.ndarray, i: int, j: int) -> tuple[np.ndarray, ...]:
        data, off = self.data[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i]
        at = np.flatnonzero(bits[self.off[i] : self.off[j]])
        row = np.searchsorted(off, at, "right") - 1
        left = np.minimum(W - 1, at - off[row])
        right = np.minimum(SIZE, off[row + 1] - at)
        sums = prefix(byte_values(data))
        context = mixed(span_hashes(sums, at - left, at + right) + left.astype(np.uint64) * _ODD)
        other = span_hashes(prefix(_OTHER[data]), at - left, at + right)
        return at + self.off[i], row + i, span_hashes(sums, at, at + Q) >> _TOP, context, other, left, right

    def pairs(self, shared: np.ndarray) -> None:
        """The distinct (bucket, context) of the anchors in shared buckets, and the smallest id of each."""
        self.kept = np.flatnonzero(shared[self.of_bucket])
        key, other = mixed(self.context[self.kept] + self.bucket[self.kept] * _ODD), self.other[self.kept]
        first, self.of_key = _distinct(key, other)
        self.keys, self.others = key[first], other[first]
        self.first = self.kept[first]
        self.least = np.full(len(self.keys), _NO_ID)
        np.minimum.at(self.least, self.of_key, self.id[self.kept])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct pairs, in order, the place of one with each; and the pair of every place."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _edges(values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins in sorted values."""
    bounds = np.array([-(-(k << bits) // n) for k in range(n)], np.uint64)
    return np.append(np.searchsorted(values, bounds), len(values))


def _answers(exchange: Exchange, back: pa.Table) -> list[dict]:
    return [_load(m) for _, m in exchange.read(back, "block")]


def _asked(exchange: Exchange, table: pa.Table) -> tuple[list[int], list[dict]]:
    """The blocks that ask a part, and their messages."""
    found = exchange.read(table, "part")
    return [b for b, _ in found], [_load(m) for _, m in found]


# What blocks ask (a list of messages, one for each part) and what parts tell (one for each block that asked).


def _ask_shared(table: pa.Table, parts: int) -> list[bytes]:
    a = _Anchors(table)
    low, high = np.full(len(a.buckets), _NO_ID), np.full(len(a.buckets), -1)
    np.minimum.at(low, a.of_bucket, a.row)
    np.maximum.at(high, a.of_bucket, a.row)
    e = _edges(a.buckets, parts, 48)
    return [_dump(b=_steps(a.buckets[s:t]), m=_bits(low[s:t] != high[s:t]), p=p) for s, t, p in zip(e[:-1], e[1:], a.places(parts), strict=True)]


def _tell_shared(asked: list[dict]) -> list[bytes]:
    each = [_of_steps(x["b"]) for x in asked]
    buckets, of, counts = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
    counts[of[np.concatenate([_of_bits(x["m"]) for x in asked])]] += 1
    shared = counts[of] > 1
    ends = np.cumsum([len(x) for x in each])
    return [_dump(s=_bits(shared[t - len(x) : t]), p=q["p"]) for x, t, q in zip(each, ends, asked, strict=True)]


def _ask_contexts(table: pa.Table, told: list[dict], parts: int) -> list[bytes]:
    a = _Anchors(table, told)
    shared = np.concatenate([_of_bits(x["s"]) for x in told])
    a.pairs(shared)
    # Of each shared bucket: its contexts here, and the least and greatest short hash of them.
    place = np.searchsorted(a.buckets, a.bucket[a.first])
    short = (a.context[a.first] >> np.uint64(32)).astype(np.int64)
    count, low, high = np.zeros(len(shared), np.int64), np.full(len(shared), _NO_ID), np.full(len(shared), -1)
    np.add.at(count, place, 1)
    np.minimum.at(low, place, short)
    np.maximum.at(high, place, short)
    by_bucket, by_key = _edges(a.buckets, parts, 48), _edges(a.keys, parts, 64)
    out = []
    for k in range(parts):
        s, t = by_bucket[k : k + 2]
        own = s + np.flatnonzero(shared[s:t])
        several = low[own] != high[own]
        u, v = by_key[k : k + 2]
        out.append(
            _dump(
                b=_steps(a.buckets[own]), c=np.minimum(count[own], 60_000).astype(np.uint16), l=low[own].astype(np.uint32), h=high[own][several].astype(np.uint32), v=_bits(several), s=_bits(shared[s:t]),
                k=_steps(a.keys[u:v]), q=_planes(a.others[u:v]), d=_planes(a.least[u:v]), p=told[k]["p"],
            )
        )
    return out


def _tell_contexts(asked: list[dict], hot_contexts: int) -> list[bytes]:
    own = [_of_planes(x["d"], np.int64) for x in asked]
    first, of = _distinct(np.concatenate([_of_steps(x["k"]) for x in asked]), np.concatenate([_of_planes(x["q"]) for x in asked]))
    least = np.full(len(first), _NO_ID)
    np.minimum.at(least, of, np.concatenate(own))
    key_ends = np.cumsum([len(x) for x in own])
    each = [_of_steps(x["b"]) for x in asked]
    buckets, in_bucket = np.unique(np.concatenate(each), return_inverse=True)
    total, low, high = np.zeros(len(buckets), np.int64), np.full(len(buckets), _NO_ID), np.full(len(buckets), -1)
    lows = [x["l"].astype(np.int64) for x in asked]
    highs = []
    for x, smallest in zip(asked, lows, strict=True):
        greatest = smallest.copy()
        greatest[_of_bits(x["v"])] = x["h"]
        highs.append(greatest)
    np.add.at(total, in_bucket, np.concatenate([x["c"] for x in asked]))
    np.minimum.at(low, in_bucket, np.concatenate(lows))
    np.maximum.at(high, in_bucket, np.concatenate(highs))
    several, hot = (low != high)[in_bucket], ((low != high) & (total > hot_contexts))[in_bucket]
    ends, out = np.cumsum([len(x) for x in each]), []
    for x, t, q, ids, u in zip(each, ends, asked, own, key_ends, strict=True):
        found = least[of[u - len(ids) : u]]
        out.append(_dump(m=_bits(several[t - len(x) : t]), h=_bits(hot[t - len(x) : t]), s=q["s"], p=q["p"], o=_bits(found == ids), d=_planes(found[found != ids])))
    return out


class _State:
    """What a block knows after the answers on contexts."""

    def __init__(self, table: pa.Table, told: list[dict]):
        self.a = a = _Anchors(table, told)
        shared = np.concatenate([_of_bits(x["s"]) for x in told])
        a.pairs(shared)
        several, hot = np.zeros(len(shared), bool), np.zeros(len(shared), bool)
        several[shared] = np.concatenate([_of_bits(x["m"]) for x in told])
        hot[shared] = np.concatenate([_of_bits(x["h"]) for x in told])
        self.least = np.concatenate([self._least(x) for x in told])
        own = np.concatenate([_of_bits(x["o"]) for x in told])
        self.least[own] = a.least[own]
        place = a.of_bucket[a.first]
        self.ask = own & several[place] & ~hot[place]
        self.ask_single = own & hot[place]
        # Whole contexts that a smaller document has.
        self.covered = a.id[a.kept] > self.least[a.of_key]

    @staticmethod
    def _least(x: dict) -> np.ndarray:
        own = _of_bits(x["o"])
        out = np.zeros(len(own), np.int64)
        out[~own] = _of_planes(x["d"], np.int64)
        return out

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys whose context is asked about in their bucket, by bucket, and an anchor that has each."""
        asked = np.flatnonzero(self.ask)
        asked = asked[np.argsort(self.a.bucket[self.a.first[asked]], kind="stable")]
        return asked, self.a.first[asked]

    def singles(self) -> tuple[np.ndarray, ...]:
        """Distinct strings (two hashes) of the contexts in hot buckets and the smallest id that has each; and for every (key, offset) its string."""
        asked = np.flatnonzero(self.ask_single)
        keys, offsets, starts = [], [], []
        for o, valid in _offsets(self.a.left[self.a.first[asked]], self.a.right[self.a.first[asked]]):
            keys.append(asked[valid])
            offsets.append(np.full(len(valid), o))
            starts.append(self.a.at[self.a.first[asked[valid]]] - o)
        keys, offsets, starts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, offsets, starts))
        found, other = _string_hashes(self.a.data, starts)
        first, of = _distinct(found, other)
        least = np.full(len(first), _NO_ID)
        np.minimum.at(least, of, self.a.least[keys])
        return found[first], other[first], least, keys, offsets, of


def _offsets(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each offset of an anchor in a string: which anchors have such a string in their document."""
    for o in range(W):
        yield o, np.flatnonzero((left >= o) & (right >= SIZE - o))


def _string_hashes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the strings that begin at start, place by place."""
    a, b = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for k in range(SIZE):
        own = data[start + k]
        a, b = (a + byte_values(own)) * _ODD, (b + _OTHER[own]) * _ODD_TOO
    return mixed(a), mixed(b)


def refined(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A bucket identifier of each 50-byte string of data that begins at start: the same for the same bytes, and only then.

    Offsets begin in the bucket of their first 8 bytes. In each round, offsets whose bucket is shared are sorted by their
    identifier and that of the bytes which follow; the new identifiers serve the next round. What is alone in its bucket stays so.
    """
    padded = np.concatenate([data, np.zeros(SIZE, np.uint8)])
    code = np.zeros(len(data), np.uint64)
    for k in range(FIRST):
        code = code << np.uint64(8) | padded[k : k + len(data)]
    bucket, counts = np.unique(code, return_inverse=True, return_counts=True)[1:]
    length = FIRST
    for size in ROUNDS:
        # Only offsets in shared buckets can have a fellow; the others keep an identifier of their own.
        active = np.flatnonzero(counts[bucket] > 1)
        later = bucket[np.minimum(active + (size - length), len(data) - 1)]
        key = bucket[active] * np.int64(len(counts)) + later
        found, of, own = np.unique(key, return_inverse=True, return_counts=True)
        alone = np.ones(len(data), bool)
        alone[active] = False
        new = np.empty(len(data), np.int64)
        new[active] = of
        new[alone] = len(found) + np.arange(alone.sum())
        bucket, counts, length = new, np.concatenate([own, np.ones(alone.sum(), own.dtype)]), size
    return bucket[start]


def _ask_strings(table: pa.Table, told: list[dict], parts: int) -> list[bytes]:
    state = _State(table, told)
    a = state.a
    asked, anchor = state.contexts()
    buckets, left, right = a.bucket[anchor], a.left[anchor], a.right[anchor]
    size = left + right
    ends = np.concatenate([[0], np.cumsum(size)])
    held = a.data[np.repeat(a.at[anchor] - left - ends[:-1], size) + np.arange(ends[-1])]
    found, other, least = state.singles()[:3]
    by_bucket, by_string = _edges(buckets, parts, 48), _edges(found, parts, 64)
    out = []
    for k in range(parts):
        (s, t), (u, v) = by_bucket[k : k + 2], by_string[k : k + 2]
        own = dict(b=_steps(buckets[s:t]), l=left[s:t].astype(np.uint8), r=right[s:t].astype(np.uint8), d=_planes(a.least[asked[s:t]]), x=held[ends[s] : ends[t]], e=told[k])
        out.append(_dump(k=_steps(found[u:v]), q=_planes(other[u:v]), i=_planes(least[u:v]), **own))
    return out


def _by_whole_buckets(buckets: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The contexts of some buckets at a time, about ``REFINED_BYTES``; a bucket is never parted."""
    order = np.argsort(buckets, kind="stable")
    if not len(order):
        return
    first = np.concatenate([[True], buckets[order][1:] != buckets[order][:-1]])
    before = np.cumsum(size[order]) - size[order]
    turn = np.maximum.accumulate(np.where(first, before // REFINED_BYTES, 0))
    edges = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1, [len(order)]])
    for s, t in zip(edges[:-1], edges[1:], strict=True):
        yield order[s:t]


def _covered(data: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """For each context a bit for each offset whose string a smaller document has too."""
    size = left + right
    start = np.cumsum(size) - size
    own = data[np.repeat(begin - start, size) + np.arange(size.sum())]
    which, offset = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o, valid in _offsets(left, right):
        which.append(valid)
        offset.append(np.full(len(valid), o))
    which, offset = np.concatenate(which), np.concatenate(offset)
    mask = np.zeros(len(left), np.uint32)
    if len(which):
        bucket = refined(own, start[which] + left[which] - offset)
        smallest = np.full(bucket.max() + 1, _NO_ID)
        np.minimum.at(smallest, bucket, owners[which])
        hit = smallest[bucket] < owners[which]
        np.bitwise_or.at(mask, which[hit], np.uint32(1) << offset[hit].astype(np.uint32))
    return mask


def _tell_strings(asked: list[dict]) -> list[bytes]:
    ids = np.concatenate([_of_planes(x["i"], np.int64) for x in asked])
    first, of = _distinct(np.concatenate([_of_steps(x["k"]) for x in asked]), np.concatenate([_of_planes(x["q"]) for x in asked]))
    least = np.full(len(first), _NO_ID)
    np.minimum.at(least, of, ids)
    earlier = least[of] < ids
    single_ends = np.cumsum([len(_of_steps(x["k"])) for x in asked])

    left, right = (np.concatenate([x[k] for x in asked]).astype(np.int64) for k in "lr")
    owners = np.concatenate([_of_planes(x["d"], np.int64) for x in asked])
    data = np.concatenate([x["x"] for x in asked])
    begin = np.cumsum(left + right) - left - right
    mask = np.zeros(len(left), np.uint32)
    for own in _by_whole_buckets(np.concatenate([_of_steps(x["b"]) for x in asked]), left + right):
        mask[own] = _covered(data, begin[own], left[own], right[own], owners[own])
    ends, out = np.cumsum([len(x["l"]) for x in asked]), []
    start = 0
    for x, t, u in zip(asked, ends, single_ends, strict=True):
        out.append(_dump(c=mask[t - len(x["l"]) : t], g=_bits(earlier[start:u]), e=x["e"]))
        start = u
    return out


def _removed(table: pa.Table, told: list[dict]) -> tuple[_Anchors, np.ndarray]:
    """The block, and which of its bytes go."""
    state = _State(table, [x["e"] for x in told])
    a = state.a
    change = np.zeros(len(a.data) + 1, np.int64)

    def remove(start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)

    whole = a.kept[state.covered]
    first, last = np.minimum(W - 1, a.left[whole]), np.maximum(0, SIZE - a.right[whole])
    some = first >= last
    remove(a.at[whole[some]] - first[some], a.at[whole[some]] - last[some] + SIZE)

    # Strings that are settled one by one, in every place that has the asking context in its first document.
    asked, _ = state.contexts()
    mask = np.zeros(len(a.keys), np.uint32)
    if len(asked):
        mask[asked] = np.concatenate([x["c"] for x in told])
    _, _, least, keys, offsets, of = state.singles()
    if len(keys):
        earlier = np.concatenate([_of_bits(x["g"]) for x in told])
        hit = earlier[of] | (a.least[keys] > least[of])
        np.bitwise_or.at(mask, keys[hit], np.uint32(1) << offsets[hit].astype(np.uint32))
    rest = np.flatnonzero(~state.covered)
    own = mask[a.of_key[rest]]
    for o in range(W):
        at = a.at[a.kept[rest[(own >> np.uint32(o)) & np.uint32(1) > 0]]] - o
        remove(at, at + SIZE)
    return a, np.cumsum(change[:-1]) > 0


def _digested(table: pa.Table, told: list[dict]) -> pa.Table:
    rows = []
    if table.num_rows:
        a, gone = _removed(table, told)
        for i, (s, t) in enumerate(zip(a.off[:-1], a.off[1:], strict=True)):
            own = gone[s:t]
            rows.append((a.doc_ids[i].as_py(), t - s, own.sum(), (np.diff(own.astype(np.int8), prepend=0) > 0).sum(), hashlib.sha256(a.data[s:t][~own].tobytes()).hexdigest()))
    return pa.table([pa.array([r[k] for r in rows], pa.string() if k == 4 else pa.int64()) for k in range(5)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(table: pa.Table, told: list[dict]) -> pa.Table:
    ids, out = [], []
    if table.num_rows:
        a, gone = _removed(table, told)
        ids = a.doc_ids.to_pylist()
        out = [a.data[s:t][~gone[s:t]].tobytes() for s, t in zip(a.off[:-1], a.off[1:], strict=True)]
    return pa.table([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "kept"])


def _deduplicated(documents: DataFrame, finish: Callable, schema: str, id_col: str, text_col: str, hot: int, block_bytes: int, direct: int) -> DataFrame:
    docs = texts(documents, id_col, text_col)
    exchange = Exchange(block_count(docs, block_bytes), direct)
    parts = exchange.parts
    blocks = in_blocks(docs, exchange.blocks)

    def asks(ask: Callable) -> Callable:
        def rows(table: pa.Table, back: pa.Table | None = None) -> pa.Table:
            if not table.num_rows:
                return exchange.rows(0, {}, "part")
            told = () if back is None else (_answers(exchange, back),)
            return exchange.rows(table["block"][0].as_py(), dict(enumerate(ask(table, *told, parts))), "part")

        return rows if ask is not _ask_shared else lambda table: rows(table)

    def tells(messages: DataFrame, tell: Callable) -> DataFrame:
        def rows(table: pa.Table) -> pa.Table:
            who, asked = _asked(exchange, table)
            return exchange.rows(table["part"][0].as_py(), dict(zip(who, tell(asked), strict=True)), "block")

        return exchange.arrived(exchange.arrived(messages, "part").groupBy("part").applyInArrow(rows, MESSAGE), "block")

    own = lambda: blocks.groupBy("block")
    back = tells(own().applyInArrow(asks(_ask_shared), MESSAGE), _tell_shared)
    back = tells(own().cogroup(back.groupBy("block")).applyInArrow(asks(_ask_contexts), MESSAGE), lambda x: _tell_contexts(x, hot))
    back = tells(own().cogroup(back.groupBy("block")).applyInArrow(asks(_ask_strings), MESSAGE), _tell_strings)
    return own().cogroup(back.groupBy("block")).applyInArrow(lambda t, b: finish(t, _answers(exchange, b)), schema)


def remaining(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block_bytes: int = BLOCK_BYTES, direct: int = DIRECT) -> DataFrame:
    """doc_id and the bytes that remain, of every row."""
    return _deduplicated(documents, _kept, "doc_id long, kept binary", id_col, text_col, hot, block_bytes, direct)


def digests(documents: DataFrame, hot: int = HOT, block_bytes: int = BLOCK_BYTES, direct: int = DIRECT) -> DataFrame:
    """For each document its bytes, the removed bytes and runs, and the SHA-256 of what remains."""
    return _deduplicated(documents, _digested, RESULT, "doc_id", "text", hot, block_bytes, direct)
