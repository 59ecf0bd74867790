"""Operator 8: near-duplicates by a chosen-path set similarity join.

Documents become sets of word shingles. Equal sets are one class, named by its smallest doc_id. Each class has
``COORDINATES`` minwise tokens. ``TREES`` independent trees branch the classes by chosen minwise tokens: the
first level follows one coordinate of the tree, each later level one or two coordinates that a hash of the
node picks (1 / threshold of them on average). Nodes of up to ``LEAF`` classes are compared exhaustively by their
minwise tokens; of larger nodes, all classes are compared with the smallest. What is alike is tied to it and has its label. A node
of which all but ``LEAF`` classes are tied is through, as these are compared with all of it, in chunks. So a group of copies that differ
doesn't go down the trees again and again. Other nodes branch on, and what has not come apart after ``LEVELS`` levels is tied to the
node's smallest class. That gives candidate clusters; in these the full sets are compared, so that every link is exact. A pair at the threshold is missed by all trees with a chance of about 0.25**16 in small nodes.

Within a cluster some pivots are compared with all members at once, so that a group of m copies that differ costs about m
comparisons. What they leave apart is compared by prefixes: the shingles of a set in order of their frequency in the cluster, of which
sets that link share one of the first quarter. So pages that share a template, but not enough to link, are not compared pair by pair.
Clusters with more than ``CLUSTER_SHINGLES`` shingles don't go to one task: there the prefixes of growing numbers of pivots are joined
with those of all members by (cluster, shingle), so no task holds a cluster.

Nodes with many classes are few; their numbers are broadcast (up to ``BROADCAST_ROWS``), so that their rows are never brought together.

Defined results: null or empty text, or text without words, has no shingles and is linked with nothing; a null
doc_id can't name a component, so such a row has a null component and is kept; repeated doc_ids share a component; an empty
table gives no rows; a text of any length is shingled whole, in one task; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import staged, texts
from sievework.llm.kernels import LOWER, byte_values, mixed, prefix, slices, span_hashes, utf8, word_spans

WORDS, THRESHOLD = 5, 75
COORDINATES, TREES, LEVELS, LEAF = 64, 16, 4, 64
#: Classes of a large node that are compared at a time with those that are not tied.
CHUNK = 2048
#: Pairs whose minwise tokens agree in a smaller share are no candidates: 4.6 standard deviations below the threshold.
CANDIDATE = 0.5
CLUSTER_SHINGLES = 4_000_000
#: Pivots that a small cluster begins with, and a large one in its first round; it takes four times as many in each later round.
PIVOTS = 32
#: Tables of nodes of 16 bytes a row are sent to all tasks up to this size.
BROADCAST_ROWS = 1_000_000
#: Tables of sketches (256 bytes a row) up to this one.
BROADCAST_SKETCHES = 60_000

_random = np.random.RandomState(8)
_TIMES = _random.randint(0, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xBF58476D1CE4E5B9)
SIGNATURE = "doc_id long, n_shingles long, key_a long, key_b long, sketch binary"


def shingle_sets(column: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data, off = utf8(column)
    for i, j in slices(off):
        own = data[off[i] : off[j]]
        start, end, before = word_spans(own, off[i : j + 1] - off[i])
        words = span_hashes(prefix(byte_values(LOWER[own])), start, end)
        n = len(words) - size + 1
        if n > 0:
            all_of = np.zeros(n, np.uint64)
            for k in range(size):
                all_of = (all_of + words[k : k + n]) * _STEP
            all_of = mixed(all_of)
        for a, b in zip(before[:-1], before[1:], strict=True):
            if b - a >= size:
                yield np.unique(all_of[a : b - size + 1])
            elif b > a:
                one = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    one = (one + w) * _STEP
                yield mixed(one)
            else:
                yield np.zeros(0, np.uint64)


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minwise tokens of each set, none of them empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((flat ^ (flat >> np.uint64(29))) * _TIMES[k] >> np.uint64(32)).astype(np.uint32), at)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """Size, 128-bit key and minwise tokens of each row's set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, a, z, sketches = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
            held: list[np.ndarray] = []
            rows: list[int] = []
            for i, s in enumerate(shingle_sets(b["text"])):
                sizes[i] = len(s)
                if len(s):
                    a[i] = mixed(s + np.uint64(1)).sum().astype(np.int64)
                    z[i] = mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)
                    held.append(s)
                    rows.append(i)
                if held and (sum(map(len, held[-64:])) > 1 << 16 or len(held) >= 256 or i == b.num_rows - 1):
                    for r, m in zip(rows, minwise(held), strict=True):
                        sketches[r] = m.tobytes()
                    held, rows = [], []
            if held:
                for r, m in zip(rows, minwise(held), strict=True):
                    sketches[r] = m.tobytes()
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes), pa.array(a), pa.array(z), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "key_a", "key_b", "sketch"])

    return docs.mapInArrow(rows, SIGNATURE)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _first_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = _sketches(b["sketch"])[:, :TREES].astype(np.uint64)
        nodes = mixed(tokens + (np.arange(1, TREES + 1, dtype=np.uint64) << np.uint64(33)))
        rep = pa.array(np.tile(b["rep"].to_numpy(), TREES))
        yield pa.RecordBatch.from_arrays([pa.array(nodes.T.ravel().astype(np.int64)), rep, rep], names=["node", "rep", "label"])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class of a large node beside the node's smallest: alike by their sketches, tied if so or if they have one label already; what is tied takes its label."""
    for b in batches:
        alike = (_sketches(b["sketch"]) == _sketches(b["pivot"])).mean(1) >= CANDIDATE
        label, of_pivot = b["label"].to_numpy(), b["pivot_label"].to_numpy()
        tied = alike | (label == of_pivot)
        yield pa.RecordBatch.from_arrays([b["node"], b["rep"], pa.array(np.where(tied, of_pivot, label)), b["least"], pa.array(alike), pa.array(tied)], names=["node", "rep", "label", "least", "alike", "tied"])


def _next_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, rep, label = _sketches(b["sketch"]), b["rep"].to_numpy(), b["label"].to_numpy()
        node = b["node"].to_numpy().astype(np.uint64)
        out, of, labels = [], [], []
        for k in (1, 2):
            pick = mixed(node * np.uint64(k) + np.uint64(k))
            coordinate = TREES + pick % np.uint64(COORDINATES - TREES)
            taken = np.ones(len(rep), bool) if k == 1 else (pick >> np.uint64(40)) % np.uint64(3) == 0  # one node in three branches twice
            token = np.take_along_axis(tokens, coordinate.astype(np.int64)[:, None], 1)[:, 0].astype(np.uint64)
            out.append(mixed(node ^ mixed(token + (coordinate << np.uint64(33))))[taken])
            of.append(rep[taken])
            labels.append(label[taken])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64)), pa.array(np.concatenate(of)), pa.array(np.concatenate(labels))], names=["node", "rep", "label"])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by key: tables of whole groups, and where each group begins (one more: the end)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b[key].to_numpy()
        edges = np.flatnonzero(np.diff(keys)) + 1
        cut = int(edges[-1]) if len(edges) else 0
        if held and held[-1][key][-1].as_py() != keys[0]:
            yield _grouped(held, key)
            held = []
        if cut:
            held.append(b.slice(0, cut))
            yield _grouped(held, key)
            held = []
        held.append(b.slice(cut))
    if held:
        yield _grouped(held, key)


def _grouped(held: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    edges = np.flatnonzero(np.diff(table[key].to_numpy())) + 1
    return table, np.concatenate([[0], edges, [table.num_rows]])


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _leaf_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each node that tie its similar classes together, without those that follow from others."""
    for table, at in whole_groups(batches, "node"):
        tokens, rep = _sketches(table["sketch"]), table["rep"].to_numpy()
        size = np.diff(at)
        two = at[:-1][size == 2]
        like = (tokens[two] == tokens[two + 1]).mean(1) >= CANDIDATE
        a, b = [rep[two[like]]], [rep[two[like] + 1]]
        for s, n in zip(at[:-1][size > 2], size[size > 2], strict=True):
            own = tokens[s : s + n]
            parent = np.arange(n)
            for i in range(n - 1):
                for j in np.flatnonzero((own[i + 1 :] == own[i]).mean(1) >= CANDIDATE) + i + 1:
                    x, y = _find(parent, i), _find(parent, int(j))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        a.append(rep[s + i : s + i + 1])
                        b.append(rep[s + j : s + j + 1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _apart_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each class that is not tied with the others of its chunk, one for each of their labels."""
    for table, at in whole_groups(batches, "chunk"):
        tokens, rep, label, tied = _sketches(table["sketch"]), table["rep"].to_numpy(), table["label"].to_numpy(), table["tied"].to_numpy()
        a, b = [rep[:0]], [rep[:0]]
        for s, e in zip(at[:-1], at[1:], strict=True):
            for u in np.flatnonzero(~tied[s:e]) + s:
                like = np.flatnonzero(((tokens[s:e] == tokens[u]).mean(1) >= CANDIDATE) & (label[s:e] != label[u])) + s
                first = like[np.unique(label[like], return_index=True)[1]]
                a.append(np.full(len(first), rep[u]))
                b.append(rep[first])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _rest_edges(rows: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Candidate pairs in large nodes of which up to LEAF classes are not tied: these are compared with all of the node, in chunks of it that each have them."""
    chunks = F.ceil(F.col("n") / CHUNK)
    own = F.when(F.col("tied"), F.array(F.pmod(F.xxhash64("rep"), chunks))).otherwise(F.sequence(F.lit(0).cast("long"), chunks - 1))
    dealt = rows.select("node", "rep", "label", "tied", F.explode(own).alias("k")).select(F.xxhash64("node", "k").alias("chunk"), "rep", "label", "tied")
    with_sketches = dealt.repartition(n, "rep").join(classes, "rep")
    return with_sketches.repartition(n, "chunk").sortWithinPartitions("chunk", "rep").mapInArrow(_apart_edges, "a long, b long")


def _small(df: DataFrame, n: int, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that tie together all that the trees bring together; classes has rep and sketch.

    Rows are (node, rep, label); classes with one label are tied by pairs that are found already.
    """
    rows = staged(classes.mapInArrow(_first_nodes, "node long, rep long, label long"))
    leaves, rests, ties = [], [], []
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for level in range(LEVELS + 1):
        pivot = F.min(F.struct("rep", "label"))
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), pivot["rep"].alias("least"), pivot["label"].alias("pivot_label"), F.min("label").alias("low"), F.max("label").alias("high"))
        sizes = staged(sizes.where("n > 1 AND low < high").drop("low", "high"))  # a node of one label has no more to find
        most, of_large = sizes.agg(F.max("n"), F.count_if(F.col("n") > LEAF)).first()
        if most is None:
            break
        # Large nodes are told by a broadcast, so that only the rows of leaves are dealt by their node.
        large = sizes.where(F.col("n") > LEAF).select("node", "least", "pivot_label")
        told = rows.join(_small(large, of_large), "node", "left")
        crowded = told.where("least IS NOT NULL")
        leaves.append(told.where("least IS NULL").select("node", "rep").join(sizes.where(F.col("n") <= LEAF).select("node"), "node"))
        if most <= LEAF:
            break
        if level == LEVELS:
            ties.append(crowded.select(F.col("least").alias("a"), F.col("rep").alias("b")))
            break
        # Dealt by class, so that no task branches most of a large node.
        pivots = large.select("node", F.col("least").alias("rep")).join(classes, "rep").select("node", F.col("sketch").alias("pivot"))
        beside = crowded.repartition(n, "rep").join(classes, "rep").join(_small(pivots, of_large, BROADCAST_SKETCHES), "node")
        judged = staged(beside.mapInArrow(_tied, "node long, rep long, label long, least long, alike boolean, tied boolean"))
        ties.append(judged.where("alike AND rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")))
        apart = judged.groupBy("node").agg(F.count("*").alias("n"), F.count_if(~F.col("tied")).alias("n_apart")).where("n_apart > 0")
        told = judged.join(_small(apart, of_large), "node")
        rests.append(told.where(F.col("n_apart") <= LEAF))
        branching = told.where(F.col("n_apart") > LEAF).select("node", "rep", "label")
        rows = staged(branching.repartition(n, "rep").join(classes, "rep").mapInArrow(_next_nodes, "node long, rep long, label long").distinct())
    if not leaves:
        return classes.sparkSession.createDataFrame([], "a long, b long")
    # Nodes of all levels have numbers of their own, so they are dealt and compared together.
    in_leaves = reduce(DataFrame.unionByName, leaves).join(classes, "rep")
    edges = in_leaves.repartition(n, "node").sortWithinPartitions("node", "rep").mapInArrow(_leaf_edges, "a long, b long")
    if rests:
        edges = edges.unionAll(_rest_edges(reduce(DataFrame.unionByName, rests), classes, n))
    edges = reduce(DataFrame.unionAll, ties, edges)
    return edges.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node), for all nodes of edges (a, b); labels move along edges and jump to labels of labels."""
    both = staged(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        moved = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = staged(moved.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("changed")))
        changed = after.where("changed").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")


def linked(n_shared: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    return 100 * n_shared >= THRESHOLD * (n + m - n_shared)


def prefix_size(size: np.ndarray) -> np.ndarray:
    """Sets that link share one of so many first shingles, in any order that holds for all sets."""
    return size - -(-THRESHOLD * size // 100) + 1


class _Cluster:
    """Sets as numbers of the shingles that two or more of them have; label is the component of each."""

    def __init__(self, sets: list[np.ndarray]):
        m = len(sets)
        self.size = np.array([len(s) for s in sets])
        ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        shared = counts[ids] > 1
        self.owner, ids = np.repeat(np.arange(m), self.size)[shared], ids[shared]
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        self.ids = self.rank[ids]  # numbered by frequency, the rarest first
        self.at = np.searchsorted(self.owner, np.arange(m + 1))
        self.label, self.tested, self.mark = np.arange(m), np.zeros(m, bool), np.zeros(len(counts), bool)

    def join(self, p: int, others: np.ndarray, n_shared: np.ndarray) -> None:
        joined = np.unique(self.label[np.append(others[linked(n_shared, self.size[others], int(self.size[p]))], p)])
        if len(joined) > 1:
            self.label[np.isin(self.label, joined)] = joined[0]

    def apart(self) -> np.ndarray:
        """What is not tested and not in the largest component; the rest needs no test of its own."""
        largest = np.bincount(self.label).argmax()
        return np.flatnonzero(~self.tested & (self.label != largest))

    def by_pivots(self) -> None:
        every = np.arange(len(self.size))
        for _ in range(PIVOTS):
            left = self.apart()
            if not len(left):
                return
            p = left[0]
            self.tested[p] = True
            own = self.ids[self.at[p] : self.at[p + 1]]
            self.mark[own] = True
            self.join(p, every, np.bincount(self.owner[self.mark[self.ids]], minlength=len(every)))
            self.mark[own] = False

    def by_prefixes(self) -> None:
        left = self.apart()
        if not len(left):
            return
        order = np.lexsort((self.ids, self.owner))
        ids = self.ids[order]
        # Shingles that no other set has come first in every order; what a prefix has left for shared ones.
        n_shared = np.diff(self.at)
        most = np.maximum(0, prefix_size(self.size) - (self.size - n_shared))
        place = np.arange(len(ids)) - self.at[self.owner]
        inside = place < most[self.owner]
        prefix, owner = ids[inside], self.owner[inside]
        begin = np.searchsorted(owner, np.arange(len(self.size) + 1))
        by_token = np.argsort(prefix, kind="stable")
        tokens, owners = prefix[by_token], owner[by_token]
        for p in left:
            if self.tested[p]:
                continue
            self.tested[p] = True
            own = prefix[begin[p] : begin[p + 1]]
            a, b = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            near = [owners[x:y] for x, y in zip(a, b, strict=True)]
            others = np.unique(np.concatenate(near)) if near else np.zeros(0, np.int64)
            small, large = np.minimum(self.size[others], self.size[p]), np.maximum(self.size[others], self.size[p])
            others = others[(self.label[others] != self.label[p]) & (100 * small >= THRESHOLD * large)]
            if len(others):
                whole = self.ids[self.at[p] : self.at[p + 1]]
                self.mark[whole] = True
                counts = np.array([self.mark[self.ids[self.at[o] : self.at[o + 1]]].sum() for o in others])
                self.mark[whole] = False
                self.join(p, others, counts)


def exact_components(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the smallest place that links lead to."""
    cluster = _Cluster(sets)
    cluster.by_pivots()
    cluster.by_prefixes()
    return cluster.label


def _cluster_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, at in whole_groups(batches, "cluster"):
        rep = table["rep"].to_numpy()
        shingles = table["shingles"].combine_chunks() if isinstance(table["shingles"], pa.ChunkedArray) else table["shingles"]
        out = np.empty(len(rep), np.int64)
        for a, b in zip(at[:-1], at[1:], strict=True):
            sets = [np.frombuffer(shingles[i].as_py(), np.uint64) for i in range(a, b)]
            out[a:b] = rep[a:b][exact_components(sets)]  # rows come by rep, so the first is the smallest
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(out)], names=["rep", "component"])


def _large_components(members: DataFrame) -> DataFrame:
    """The same for clusters that are too large for one task: rounds of pivots that are joined with all members."""

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.frombuffer(x, np.int64) for x in b["shingles"].to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["cluster"], b["rep"], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))], names=["cluster", "rep", "shingles"])

    sets = staged(members.select("cluster", "rep", "shingles").mapInArrow(arrays, "cluster long, rep long, shingles array<long>"))
    tokens = sets.select("cluster", "rep", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    shared = tokens.groupBy("cluster", "token").agg(F.count("*").alias("n")).where("n > 1")
    ranked = tokens.join(shared, ["cluster", "token"]).groupBy("cluster", "rep", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("s"))  # one set
    most = F.greatest(F.lit(0), F.expr(f"size - ceil({THRESHOLD} * size / 100) + 1 - (size - size(s))")).cast("int")
    prefixes = staged(ranked.select("cluster", "rep", "size", F.explode(F.slice("s", F.lit(1), most)).alias("x")).select("cluster", "rep", "size", F.col("x.token").alias("token")))
    state = staged(sets.select("cluster", "rep", F.col("rep").alias("component"), F.lit(False).alias("tested")))
    wanted = PIVOTS
    while True:
        counts = state.groupBy("cluster", "component").agg(F.count("*").alias("n"))
        largest = counts.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("most")).select("cluster", F.col("most.component").alias("largest"))
        left = staged(state.join(largest, "cluster").where("NOT tested AND component <> largest").select("cluster", "rep", "component"))
        n = left.count()
        if not n:
            return state.select("rep", "component")
        # A round's pivots are picked by a hash; whole groups that link are one component before most of their members would be pivots.
        pivots = staged(left.where(F.pmod(F.xxhash64("rep", F.lit(wanted)), F.lit(max(1, n // wanted))) == 0))
        wanted *= 4
        own = prefixes.join(pivots.select("rep", F.col("component").alias("own")), "rep").select("cluster", "token", F.col("rep").alias("pivot"), F.col("size").alias("pivot_size"), "own")
        sized = (100 * F.least("size", "pivot_size") >= THRESHOLD * F.greatest("size", "pivot_size")) & (F.col("rep") != F.col("pivot"))
        pairs = own.join(prefixes, ["cluster", "token"]).where(sized).select("pivot", "own", "rep").distinct()
        pairs = pairs.join(state.select("rep", "component"), "rep").where("own <> component")
        overlap = F.size(F.array_intersect("shingles", "theirs"))
        with_sets = pairs.join(sets.select("rep", "shingles"), "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("theirs")), "pivot")
        edges = with_sets.where(100 * overlap >= THRESHOLD * (F.size("shingles") + F.size("theirs") - overlap)).select(F.col("component").alias("a"), F.col("own").alias("b"))
        merged = components(edges).select(F.col("node").alias("component"), F.col("component").alias("next"))
        now = pivots.select("rep", F.lit(True).alias("now"))
        state = staged(state.join(merged, "component", "left").join(now, "rep", "left").select("cluster", "rep", F.coalesce("next", "component").alias("component"), (F.col("tested") | F.coalesce("now", F.lit(False))).alias("tested")))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = texts(documents, id_col, text_col)
    found = staged(signatures(docs))
    classes = staged(found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    edges = candidate_edges(classes.select("rep", "sketch"))
    clusters = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(classes.select("rep", "n_shingles"), "rep")
    clusters = staged(clusters)
    large = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("n")).where(F.col("n") > cluster_shingles).select("cluster")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["cluster"], b["rep"], pa.array([s.tobytes() for s in shingle_sets(b["text"])], pa.binary())], names=["cluster", "rep", "shingles"])

    # The ids grow with the corpus, so they are never broadcast; as the build side of a hash join they spare the texts a sort.
    members = docs.join(clusters.select(F.col("rep").alias("doc_id"), "cluster").distinct().hint("shuffle_hash"), "doc_id").select("cluster", F.col("doc_id").alias("rep"), "text")
    members = members.mapInArrow(sets, "cluster long, rep long, shingles binary").where(F.length("shingles") > 0).dropDuplicates(["cluster", "rep", "shingles"])
    some_large = large.limit(1).count() > 0
    if some_large:
        members = staged(members)
    small = members.join(large, "cluster", "left_anti") if some_large else members
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exact = small.repartition(n, "cluster").sortWithinPartitions("cluster", "rep").mapInArrow(_cluster_components, "rep long, component long")
    if some_large:
        exact = exact.unionAll(_large_components(members.join(large, "cluster", "left_semi")))
    exact = exact.where("rep <> component").groupBy("rep").agg(F.min("component").alias("component"))
    of_class = classes.select("key_a", "key_b", "rep").join(exact, "rep", "left").select("key_a", "key_b", F.coalesce("component", "rep").alias("component"))
    linked_rows = found.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "key_a", "key_b").join(of_class, ["key_a", "key_b"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = found.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_rows.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def representatives(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each component, and all rows without id or words.

    Of several rows with one id the one with the smallest text stays.
    """
    found = staged(near_duplicates(documents, id_col, text_col).select("doc_id", "n_shingles", "kept"))
    mark = f"n_{uuid.uuid4().hex}"
    gone = found.where("NOT kept").select(F.col("doc_id").alias(mark)).distinct()
    own = F.col(id_col).cast("long")
    out = documents.join(gone.hint("shuffle_hash"), own == F.col(mark), "left_anti")
    again = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark))
    if not again.limit(1).count():
        return out
    # The smallest text of each id that is there more than once; of equal rows one.
    rows = out.join(again, own == F.col(mark), "left_semi")
    order = F.struct(F.col(text_col).isNull().alias("a"), F.col(text_col).alias("b"), F.xxhash64(F.to_json(F.struct(*out.columns))).alias("c"))
    some = rows.groupBy(own.alias(mark)).agg(F.min_by(F.struct(*out.columns), order).alias(f"{mark}_r")).select(f"{mark}_r.*")
    return out.join(again, own == F.col(mark), "left_anti").unionByName(some)
