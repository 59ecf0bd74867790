"""Operators 4, 6, 7, 8, 9 and the pipeline against brute force, and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from sievework.llm import bpe, common, contamination, lm, neardup, pii, quality, secrets, substrings, toxicity

import recall


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


# Toxicity.


def toxic_tables(spark, n=900):
    r = random.Random(1)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = [r.choice(plain) for _ in range(r.randint(20, 300))]
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randint(1, 4)):
                t.insert(r.randrange(len(t)), r.choice(["vile", "nasty", "horridly", "horrider"]))
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_tables(spark)
    got = toxicity.predictions(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_a_null_id_is_not_held_out(spark, awkward):
    docs, labels = toxic_tables(spark)
    rows = toxicity.predictions(docs.unionByName(awkward.select("doc_id", "text")), labels).collect()
    assert len(rows) == docs.count() + awkward.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_labels_are_about_as_many_as_allowed(spark):
    docs, labels = toxic_tables(spark)
    n = toxicity._labelled(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), 200, True).count()
    assert 150 <= n <= 250


def test_toxic_passages_lie_where_the_words_are(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    text = "w1 w2 w3 " * 30 + "vile nasty " + "w4 w5 " * 30
    found = toxicity.passages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [text[r["start"] : r["end"]] for r in found] == ["vile nasty"]


def test_toxicity_without_labels_or_text(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.predictions(awkward, none).collect()
    assert len(rows) == awkward.count() and all(r["predicted"] == 0 for r in rows)
    assert toxicity.predictions(nothing, none).count() == 0


def test_segments():
    r = random.Random(0)
    for _ in range(300):
        x = np.array([r.choice([-3, -1, -0.5, 1, 2]) for _ in range(r.randint(0, 25))], np.float32)
        best = max([0, *(x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
        assert math.isclose(toxicity.best_segments(x, np.array([0, len(x)]))[0], best, abs_tol=1e-4)
        found = toxicity.maximal_segments(x)
        assert all(math.isclose(x[a:b].sum(), s, abs_tol=1e-4) for a, b, s in found)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))
        assert not found or math.isclose(max(s for *_, s in found), best, abs_tol=1e-4)


# Repeated strings.


def removed(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            first[s] = min(first.get(s, 1 << 63), i if i is not None else 1 << 62)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (i if i is not None else 1 << 62):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone))), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_places_of_anchors_hold_for_any_order_of_rows():
    r = random.Random(3)
    rows = []
    for k in range(6):
        own = ["".join(r.choice("abcd ") for _ in range(r.randint(0, 300))).encode() for _ in range(5)]
        rows.append((0, [k, None, k + 1, 7, 8], common.pack(np.array([len(t) for t in own], np.uint32)), common.pack(np.frombuffer(b"".join(own), np.uint8))))
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    table = lambda x: pa.table([pa.array([y[k] for y in x], t) for k, t in enumerate(kinds)], names=["block", "ids", "sizes", "data"])
    one, other = substrings._Anchors(table(rows)), substrings._Anchors(table(rows[::-1]))
    assert one.places(4) == other.places(4) and one.doc_ids.equals(other.doc_ids)
    known = substrings._Anchors(table(rows[3:] + rows[:3]), [{"p": p} for p in one.places(4)])
    assert (known.at == one.at).all() and (known.bucket == one.bucket).all()


def test_refined_buckets_are_the_strings():
    r = random.Random(8)
    for _ in range(30):
        data = "".join(r.choice(["ab", "a", "b", "abab" * 9, "c"]) for _ in range(r.randint(20, 300))).encode()
        if len(data) < 60:
            continue
        start = np.array([r.randrange(len(data) - 50 + 1) for _ in range(60)])
        bucket = substrings.refined(np.frombuffer(data, np.uint8), start)
        for i in range(60):
            for j in range(i):
                assert (bucket[i] == bucket[j]) == (data[start[i] : start[i] + 50] == data[start[j] : start[j] + 50])


@pytest.mark.parametrize(("hot", "direct"), [(0, substrings.DIRECT), (3, substrings.DIRECT), (substrings.HOT, substrings.DIRECT), (3, 1)])
def test_removed_strings(spark, hot, direct):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(150):
        parts = [(b := r.choice(base))[(s := r.randint(0, 380)) : s + r.randint(5, 160)] + r.choice(["", "x", "é", "a" * 70]) for _ in range(r.randint(0, 8))]
        rows.append((i, "".join(parts)))
    r.shuffle(rows)
    got = substrings.digests(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot, block_bytes=2_000 if direct == 1 else 20_000, direct=direct).collect()
    assert collections.Counter(tuple(x) for x in got) == removed(rows)


@pytest.mark.parametrize("name", ["awkward", "nothing"])
def test_removed_strings_of_awkward_rows(request, name):
    docs = request.getfixturevalue(name)
    got = substrings.digests(docs).collect()
    assert collections.Counter(tuple(x) for x in got) == removed([(r["doc_id"], r["text"]) for r in docs.collect()])


# The language model.


def test_language_model_base_and_held_out_gain(spark, sample):
    got = {r["doc_id"]: r for r in lm.scored(sample).collect()}
    tokens = {r["doc_id"]: words(r["text"]) + ["\n"] for r in sample.collect()}
    counts = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        x = got[i]
        assert x["train_tokens"] == n and x["n_tokens"] == len(t) and x["n_known"] == sum(counts[w] > 0 for w in t)
        assert math.isclose(x["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and x["score"] < 0


def test_the_end_is_counted_where_many_words_are_more_frequent(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    rows = [(i, " ".join(f"w{k}" for k in range(2100) for _ in range(3))) for i in ids]
    for x in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        n, v = 2 * 6301, 2101
        assert (x["train_tokens"], x["n_tokens"], x["n_known"]) == (n, 6301, 6301)
        assert math.isclose(x["base_score"], 6300 * math.log10(7 / (n + v + 1)) + math.log10(3 / (n + v + 1)), rel_tol=1e-9)


def test_language_model_learns_order(spark):
    """Every b follows from its a, so half of the bits can be known."""
    r = random.Random(0)
    rows = [(i, " ".join(f"a{k} b{k}" for k in (r.randrange(20) for _ in range(400)))) for i in range(60)]
    got = lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and all(x["score"] > x["base_score"] * 0.5 for x in got)


def test_language_model_of_unseen_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.scored(docs).collect() if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    # log10 a token; what the base score gives, and the model's gain on documents that it never saw.
    assert (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / tokens >= 0.1


def test_scores_do_not_depend_on_partitions(spark, sample):
    found = [{(r["doc_id"], r["score"]) for r in lm.scored(d, block_bytes=100_000).collect()} for d in (sample.coalesce(1), sample.repartition(8))]
    assert found[0] == found[1]


def a_vocabulary(r, size):
    counts = np.sort(r.randint(1, 1000, size))[::-1]
    return lm.Vocabulary({b"w%d" % i: i for i in range(3, size)}, np.array([1, 2]), counts, np.ones(size, np.int64), int(counts.sum()), size)


def test_chances_are_normalised():
    r = np.random.RandomState(0)
    v = a_vocabulary(r, 23)
    p = lm.Parameters(v, lm.Parameters(v).values + r.normal(0, 0.5, len(lm.Parameters(v).values)))
    around = np.repeat(np.array([[4], [7], [0]]), v.size, 1)
    assert math.isclose((10 ** lm.log10_chances(v, p, np.arange(v.size), around)).sum(), 1, abs_tol=1e-5)
    far = lm.Parameters(v, lm.Parameters(v).values * 100)
    assert math.isclose((10 ** lm.log10_chances(v, far, np.arange(v.size), around)).sum(), 1, abs_tol=1e-5)


def test_contrastive_steps_find_what_follows():
    r = np.random.RandomState(0)
    v = a_vocabulary(r, 23)
    tokens = np.concatenate([[(k := r.randint(3, 13)), k + 10] for _ in range(5000)])
    p = lm.Parameters(v, lm.contrastive_steps(v, None, tokens, np.zeros(len(tokens), np.int64), 300, 0))
    around = lm.contexts(tokens, np.zeros(len(tokens), np.int64))
    assert np.median(lm.log10_chances(v, p, tokens, around)[1::2]) > math.log10(0.5)


def test_contexts_end_at_the_beginning():
    assert lm.contexts(np.array([5, 6, 0, 7, 8, 0]), np.array([0, 0, 0, 3, 3, 3])).tolist() == [[0, 5, 6, 0, 7, 8], [0, 0, 5, 0, 0, 7], [0, 0, 0, 0, 0, 0]]


def test_equal_rows_are_spread_over_blocks():
    keys, turns = np.full(50_000, 7, np.int64), np.arange(50_000) * 300 // common.ALIKE_BYTES
    found = common._blocks(keys, turns, 8)
    assert len(set(found.tolist())) >= 6
    few = common._blocks(np.array([7, 8, 7, 9]), np.zeros(4, np.int64), 8)
    assert few[0] == few[2]  # a few equal rows stay together


def test_language_model_of_awkward_rows(awkward, nothing):
    rows = lm.scored(awkward).collect()
    assert len(rows) == awkward.count() and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert lm.scored(nothing).count() == 0


# Near-duplicates.


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        s = set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()
        if i is not None:
            sets.setdefault(i, s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("name", "limit"), [("sample", neardup.CLUSTER_SHINGLES), ("sample", 500), ("awkward", neardup.CLUSTER_SHINGLES), ("chain", 100), ("chain", neardup.CLUSTER_SHINGLES)])
def test_components(request, spark, name, limit):
    if name == "chain":  # each is near the next, the ends are far apart; and copies
        base = [f"w{i}" for i in range(60)]
        rows = [(i, " ".join(base[: 60 - i] + [f"z{k}" for k in range(i)])) for i in range(30)] + [(100 + i, " ".join(base)) for i in range(5)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = request.getfixturevalue(name)
    expected = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = neardup.near_duplicates(docs, cluster_shingles=limit).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_recall_of_a_fixed_set_of_queries_against_all_rows(spark):
    total, found = recall.recall(spark, "/root/testdata/sf0.1/documents.parquet")
    assert total > 50 and found == total


def test_large_nodes_branch_and_lose_nothing(spark, monkeypatch):
    r = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join([f"d{i}_{k}" for k in range(100)][:50] + common + [f"e{i}_{k}" for k in range(50)])) for i in range(200)]
    near = [f"n{i}" for i in range(200)]
    for i in range(150):
        t = list(near)
        t[r.randrange(200)] = f"x{i}"
        rows.append((1000 + i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(docs).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


@pytest.mark.parametrize(("leaf", "chunk"), [(4, 16), (2, 500), (64, 2048)])
def test_tied_nodes_keep_their_links(spark, monkeypatch, leaf, chunk):
    """A group of copies that differ beside some texts that link with few of them, with each other, or with nothing."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        t = list(base)
        t[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(t)))
    for i in range(12):  # ever further from the copies, each near the one before
        rows.append((500 + i, " ".join(base[10 * (i + 1) :] + [f"y{k}" for k in range(10 * (i + 1))])))
    for i in range(6):  # half of the template and nothing else in common
        rows.append((600 + i, " ".join(base[:100] + [f"z{i}_{k}" for k in range(100)])))
    rows += [(700, rows[-1][1] + " more"), (701, rows[0][1]), (702, None)]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()}


def brute_labels(sets):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_clusters_that_hardly_link(monkeypatch):
    """Templates with parts of their own, near the threshold and on both sides of it, beside groups that link."""
    r = np.random.RandomState(5)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    for share in (0.5, 0.74, 0.8, 0.86, 0.9):
        template = r.randint(0, 1 << 62, 200, dtype=np.uint64)
        sets = []
        for _ in range(70):
            n = int(200 * share)
            kept = r.permutation(200)[: n + r.randint(0, 5)]
            sets.append(np.unique(np.concatenate([template[kept], r.randint(0, 1 << 62, 200 - n, dtype=np.uint64)])))
        sets += [np.unique(np.append(sets[0], r.randint(0, 1 << 62, 3, dtype=np.uint64))) for _ in range(10)]
        assert neardup.exact_components(sets).tolist() == brute_labels(sets)


def test_many_templates_are_not_compared_pair_by_pair():
    r = np.random.RandomState(6)
    template = r.randint(0, 1 << 62, 140, dtype=np.uint64)
    sets = [np.unique(np.concatenate([template, r.randint(0, 1 << 62, 60, dtype=np.uint64)])) for _ in range(4000)]
    start = time.time()
    assert len(set(neardup.exact_components(sets).tolist())) == 4000
    assert time.time() - start < 20


def test_representatives(awkward, nothing):
    kept = neardup.representatives(awkward)
    assert kept.columns == awkward.columns
    expected = brute_components([(r["doc_id"], r["text"]) for r in awkward.collect()])
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(i for i, (_, c) in expected.items() if i == c)
    assert neardup.representatives(nothing).count() == 0 == neardup.near_duplicates(nothing).count()


# Decontamination.


def test_passages_of_the_benchmark(spark, awkward, nothing):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(10)] + [(10, "only seven words are in this item"), (11, None), (12, "too short"), (13, "")]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs, planted = [], set()
    for i in range(300):
        k = i % 11 if i % 3 == 0 else None
        parts = [noise(r.randint(0, 80))]
        if k is not None:
            own = items[k][1].split()
            if k < 10:
                for p in r.sample(range(30), 3):
                    own[p] = "other"
            parts.append(" ".join(own).upper())
            planted.add((i, k))
        docs.append((i, " ".join([*parts, noise(r.randint(0, 80))])))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in contamination.find(table, benchmark).collect()}
    # Three substitutions in thirty words may leave no long stretch; nearly all are found and nothing else.
    assert got <= planted and len(got) >= 0.9 * len(planted)
    assert {(x["doc_id"], x["item_id"]) for x in contamination.find(table, benchmark, broadcast_rows=0).collect()} == got
    left = {x["doc_id"] for x in contamination.clean(table, benchmark).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}
    assert contamination.find(awkward, benchmark).count() == 0
    assert contamination.find(nothing, benchmark).count() == 0
    assert contamination.find(table, benchmark.limit(0)).count() == 0


def test_exact_passages_are_always_found(spark, sample):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], " ".join(words(r["text"]))) for r in benchmark.collect()]
    texts = [(r["doc_id"], " ".join(words(r["text"]))) for r in sample.collect()]
    exact = {(d, i) for d, t in texts for i, x in items if x and f" {x} " in f" {t} "}
    assert exact <= {(r["doc_id"], r["item_id"]) for r in contamination.find(sample, benchmark).collect()}


def test_every_passage_that_counts_is_found(spark):
    """All diagonals by brute force, for other words in periods and at random."""
    r = random.Random(12)
    fresh = iter(range(10**9))
    items, docs = [], []
    for n in [*range(5, 20), 30, 50, 60, 150, 400]:
        for kind in ("every 3", "every 4", "every 5", "every 6", "every 7", "mmxmmmx", 0.1, 0.15, 0.2, 0.25):
            item = [f"w{r.randrange(40)}" if n % 2 else f"i{next(fresh)}" for _ in range(n)]
            put = [k % int(kind[6:]) == int(kind[6:]) - 1 if str(kind).startswith("every") else "mmxmmmx"[k % 7] == "x" if kind == "mmxmmmx" else r.random() < kind for k in range(n)]
            noise = lambda: [f"w{r.randrange(40)}" for _ in range(r.randrange(30))]
            docs.append((len(docs), " ".join([*noise(), *(f"x{next(fresh)}" if p else w for p, w in zip(put, item, strict=True)), *noise()])))
            items.append((len(items), " ".join(item)))
    brute = set()
    split = [[hash(w) for w in t.split()] for _, t in docs]
    for i, t in items:
        item = np.array([hash(w) for w in t.split()])
        for d, w in enumerate(split):
            w = np.array(w)
            if len(set(w.tolist()) & set(item.tolist())) == 0:
                continue
            for shift in range(1 - len(item), len(w)):
                a, b = max(0, -shift), min(len(item), len(w) - shift)
                same, best, now = item[a:b] == w[a + shift : b + shift], 0, 0
                if same.sum() < 4:
                    continue
                for x in same.tolist():
                    now = max(0, now + (1 if x else -2))
                    best = max(best, now)
                if best >= min(12, math.ceil(0.8 * len(item))):
                    brute.add((d, i))
                    break
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in contamination.find(table, benchmark).collect()} == brute
    assert {(x["doc_id"], x["item_id"]) for x in contamination.find(table, benchmark, broadcast_rows=100).collect()} == brute
    assert {x["doc_id"] for x in contamination.clean(table, benchmark).collect()} == {d for d, _ in docs} - {d for d, _ in brute}


def most_without_a_seed(masks, limit):
    """The highest sum of a row of matches (1) and other words (-2) in which no mask fits, over all histories of such rows."""
    span = max(map(len, masks))
    picks = [sum(1 << (len(m) - 1 - k) for k, c in enumerate(m) if c == "1") for m in masks]
    best = {0: 0}  # the highest sum by the last words
    while True:
        after = dict(best)
        for history, total in best.items():
            for same in (0, 1):
                full = history << 1 | same
                if not any(full & p == p for p in picks):
                    now, x = full & ((1 << (span - 1)) - 1), total + (1 if same else -2)
                    after[now] = max(after.get(now, 0), x)
        if after == best or max(after.values()) > limit:
            return max(after.values())
        best = after


def test_no_stretch_that_counts_is_without_a_seed():
    assert most_without_a_seed(contamination.MASKS, 30) == 6
    assert all(contamination.least_score(n) > 6 for n in range(contamination.SHORT, 100))
    # With one other word a shorter item has less than it needs, or it has a run of four beside it.
    for n in range(contamination.MIN_ITEM, contamination.SHORT):
        for row in range(1 << n):
            bits = [row >> k & 1 for k in range(n)]
            best = now = 0
            for x in bits:
                now = max(0, now + (1 if x else -2))
                best = max(best, now)
            assert best < contamination.least_score(n) or "1111" in "".join(map(str, bits))


def test_clean_documents_keep_their_columns(awkward, nothing, spark):
    benchmark = spark.createDataFrame([(1, awkward.where("doc_id = 8").first()["text"]), (2, None)], "item_id long, text string")
    left = contamination.clean(awkward, benchmark)
    assert left.columns == awkward.columns
    gone = {r["doc_id"] for r in contamination.find(awkward, benchmark).collect()}
    assert gone >= {8, 50, 51, 52, 60, None} and 7 not in gone
    assert left.count() == sum(1 for r in awkward.collect() if not (r["doc_id"] in gone and r["text"]))
    assert contamination.clean(nothing, benchmark).count() == 0
    assert contamination.clean(awkward, benchmark.limit(0)).count() == awkward.count()


# The pipeline.


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]
    out = corpus_pipeline.run(spark, sf).collect()
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    from sievework.llm import bpe, secrets

    vocabulary = bpe.public_vocabulary()
    assert 0 < len(out) < len(documents) and len({r["doc_id"] for r in out}) == len(out)
    for r in out[:50]:
        text = secrets.masked_text(documents[r["doc_id"]], secrets.spans(documents[r["doc_id"]], vocabulary))
        assert r["text"] == text and r["ids"] == vocabulary.encoding().encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
    kept = brute_components([(r["doc_id"], documents[r["doc_id"]]) for r in out])
    assert all(i == c for i, (_, c) in kept.items())


def test_pipeline_of_awkward_rows(spark, awkward, tmp_path):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (60, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count()


@pytest.mark.parametrize("name", ["awkward", "nothing"])
def test_pipeline_keeps_other_columns(spark, request, tmp_path, name):
    docs = request.getfixturevalue(name)
    docs.limit(0).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).select(F.col("doc_id").alias("item_id"), "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
    n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(out) == n and (n > 0) == (name == "awkward")


def test_secrets_stage_without_length(spark, sample):
    docs = sample.select("doc_id", "text").limit(5)
    out = dict(corpus_pipeline.STAGES)["secrets"](spark, docs, "")
    assert out.columns == ["doc_id", "text"] and out.count() == 5


def test_very_long_texts(spark):
    """One document of three million characters beside short ones."""
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(500_000)) + " " + "x" * 100_000
    rows = [(1, "a short one"), (2, long), (3, long[:5000]), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("h")).repartition(2)
    vocabulary = bpe.public_vocabulary()
    ids = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip_digests(docs, vocabulary).collect()}
    assert ids[2] == len(vocabulary.encoding().encode_ordinary(long))
    assert {r["doc_id"]: r["n_words"] for r in quality.filtered(docs).collect()}[2] == 500_001
    assert pii.digests(docs).count() == 4 == secrets.digests(docs, vocabulary).count()
    gone = {r["doc_id"]: r["n_removed"] for r in substrings.digests(docs).collect()}
    assert gone[3] == 5000 and gone[1] == 0
    assert {r["doc_id"]: r["n_tokens"] for r in lm.scored(docs).collect()} == {1: 4, 2: 500_002, 3: len(long[:5000].split()) + 1, 4: 1}
    sizes = {r["doc_id"]: r["n_shingles"] for r in neardup.near_duplicates(docs).collect()}
    words_ = long.split()
    assert sizes[2] == len(set(zip(*(words_[k:] for k in range(5)))))
    item = spark.createDataFrame([(1, " ".join(words_[-200:]))], "item_id long, text string")
    assert [(x["doc_id"], x["n_matched"]) for x in contamination.find(docs, item).collect()] == [(2, 200)]
    none = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.predictions(docs, none).count() == 4


def test_equal_rows_of_many_tasks_are_spread(spark):
    from pyspark.sql import functions as F

    from sievework.llm import common

    rows = spark.range(40, numPartitions=8).select(F.lit(5).cast("long").alias("doc_id"), F.repeat(F.lit("word "), F.lit(40_000)).alias("text"))
    rows = rows.unionAll(spark.range(30).select("id", F.concat(F.lit("other "), "id").alias("text")))
    layouts = []
    for parts in (1, 8):
        found = common.in_blocks(rows.repartition(parts), 16).select("block", F.explode("ids").alias("id")).groupBy("block", "id").count().collect()
        layouts.append({(r["block"], r["id"]): r["count"] for r in found})
    assert layouts[0] == layouts[1] and sum(layouts[0].values()) == 70
    assert len([1 for _, i in layouts[0] if i == 5]) >= 4


def test_every_training_token_is_a_target():
    from sievework.llm import lm

    for n in (0, 1, 7, 10_000):
        places = np.concatenate([lm.targets(n, 3, k) for k in range(lm.ROUNDS)])
        assert sorted(places.tolist()) == list(range(n))


def test_language_model_does_not_depend_on_the_partitions_of_equal_rows(spark):
    from pyspark.sql import functions as F

    from sievework.llm import lm

    long = spark.range(24).select(F.lit(9).cast("long").alias("doc_id"), F.repeat(F.lit("one two three "), F.lit(10_000)).alias("text"))
    docs = long.unionAll(spark.range(60).select((F.col("id") + 100).alias("doc_id"), F.concat(F.lit("some words of "), F.col("id").cast("string"), F.lit(" one two")).alias("text")))
    scores = [sorted((r["doc_id"], r["score"]) for r in lm.scored(docs.repartition(k), block_bytes=1 << 20).collect()) for k in (1, 8)]
    assert scores[0] == scores[1] and len(scores[0]) == 84
