"""Operators 11, 12 and 13 against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievework.llm import alignment, divergence, sharding

PIECES = st.lists(st.sampled_from(["a", "the", "B", " ", "  ", "\n", "\t", "'s", "1", "é", "漢字", "!", "...", "\x00", "\x1c", "😀", "　", "▁", "<s>", "<0x41>", "<|endoftext|>", "ing", "�", "ﬁ", "​", "é", "xxxx"]), max_size=25).map("".join)


def brute_groups(text):
    """By the libraries on the whole text, byte for byte."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(brute_groups, "both"):
        a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        brute_groups.both = a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a, b = brute_groups.both
    if not text:
        return []
    from tokenizers.decoders import ByteLevel

    whole = (" " + text).encode()
    table = brute_groups.__dict__.setdefault("table", {})
    if not table:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printable]
        table.update({chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)})
        assert ByteLevel().decode(["Ġa", "Ċ"]) == " a\n"
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    a_bytes = [bytes(table[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    groups, i, j, left, right = [], 0, 0, 0, 0
    own, other = [], []
    while i < len(a_ids) or j < len(b_ids):
        if left <= right and i < len(a_ids):
            own.append(a_ids[i])
            left += len(a_bytes[i])
            i += 1
        else:
            other.append(b_ids[j])
            right += len(b_bytes[j])
            j += 1
        if left == right:
            groups.append((own, other))
            own, other = [], []
    return groups


def brute_alignment(texts):
    found = [brute_groups(t or "") for t in texts]
    links = [collections.Counter((a, b) for own, other in g for a in own for b in other) for g in found]
    held = collections.Counter(p for x in links for p in x)
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, x in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, own)) + "|" + ",".join(map(str, other)) for own, other in g)
        sums = sum(x.values()), sum(n for p, n in x.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in x.items())
        out.append((sum(len(o) for o, _ in g), sum(len(o) for _, o in g), len(g), *sums, hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4))
def test_tokens_and_groups_are_the_libraries(texts):
    import pyarrow as pa

    pair = alignment.public_tokenizers_pair()
    for t in texts:
        got = alignment._groups(pa.scalar(" " + t if t else ""), pair)
        assert [(g["a"], g["b"]) for g in got] == brute_groups(t)


@pytest.mark.parametrize("name, chunk", [("awkward", 1 << 22), ("awkward", 1000), ("sample", 1 << 22), ("sample", 20_000)])
def test_alignment_is_brute_force(request, name, chunk):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    brute = [(r["doc_id"], *x) for r, x in zip(rows, brute_alignment([r["text"] for r in rows]), strict=True)]
    got = alignment.alignment(docs, alignment.public_tokenizers_pair(), chunk).collect()
    assert collections.Counter((r["doc_id"], *(r[c] for c in ALIGNED)) for r in got) == collections.Counter(brute)


def test_long_groups_count_equal_ids_first(monkeypatch):
    monkeypatch.setattr(alignment, "MANY", 2)
    r = np.random.RandomState(3)
    a, b = r.randint(0, 5, 40), r.randint(0, 5, 40)
    before_a, before_b = np.array([0, 1, 10, 40]), np.array([0, 2, 3, 40])
    got = collections.Counter()
    for g, p, n in zip(*alignment._group_pairs(a, b, before_a, before_b, 10), strict=True):
        got[g, p] += n
    want = collections.Counter((g, x * 10 + y) for g in range(3) for x in a[before_a[g] : before_a[g + 1]] for y in b[before_b[g] : before_b[g + 1]])
    assert got == want


def test_aligned_texts_and_nothing(awkward, nothing):
    pair = alignment.public_tokenizers_pair()
    texts = {r["doc_id"]: r["text"] for r in awkward.where("doc_id < 10").select("doc_id", "text").collect()}
    for r in alignment.aligned(awkward.where("doc_id < 10"), pair).collect():
        assert [(g["a"], g["b"]) for g in r["groups"]] == brute_groups(texts[r["doc_id"]] or "")
    assert alignment.alignment(nothing, pair).count() == 0


def law_holds(rows, shards):
    sizes = collections.Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(shards))
    n = [sizes[k] for k in range(shards)]
    assert max(n) - min(n) <= 1
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("name", ["awkward", "sample", "nothing"])
@pytest.mark.parametrize("shards", [1, 7, 24])
def test_shards_hold_all_rows_evenly(request, name, shards):
    docs = request.getfixturevalue(name)
    rows = sharding.placements(docs, shards).collect()
    law_holds(rows, shards)
    text = lambda r: (r["text"] or "").encode()
    want = collections.Counter((r["doc_id"], len(text(r)) + 8, zlib.crc32(text(r))) for r in docs.select("doc_id", "text").collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_the_order_is_a_shuffle_that_a_seed_repeats(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 100).alias("text"), F.lit(1).alias("bucket"), F.lit(2).alias("slot"), F.lit(3).alias("turn"))
    order = lambda df: [r["doc_id"] for r in df.orderBy("shard", "slot").collect()]
    one, again, other = (order(sharding.sharded(docs, 5, seed, bucket_bytes=20_000)) for seed in (1, 1, 2))
    assert one == again and one != other and sorted(one) == list(range(4000))
    assert abs(np.corrcoef(one, range(4000))[0, 1]) < 0.06 and abs(np.corrcoef(one, other)[0, 1]) < 0.06
    found = sharding.sharded(docs, 5, 1)
    assert sorted(found.columns) == sorted([*docs.columns, "shard"])  # the slot is new, the others stay
    assert {r["bucket"] for r in found.collect()} == {1}


def test_rows_that_are_alike_lie_in_all_shards_and_buckets(spark):
    same = spark.range(30_000, numPartitions=50).select(F.lit(7).alias("doc_id"), F.lit("same text").alias("text"))
    counts = [r["count"] for r in sharding.sharded(same, 24, bucket_bytes=9 * 3000).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 1
    rows = same.select(F.monotonically_increasing_id().alias("number")).withColumn("bucket", F.pmod(F.xxhash64("number", F.lit(1)), F.lit(10)))
    sizes = [r["count"] for r in rows.groupBy("bucket").count().collect()]
    assert max(sizes) < 1.1 * 3000


def test_shards_are_written_in_order(spark, sample, tmp_path):
    sharding.write_shards(sample, str(tmp_path / "out"), 6, bucket_bytes=20_000)
    found = spark.read.parquet(str(tmp_path / "out"))
    law_holds(found.select("shard", "slot").collect(), 6)
    assert found.select("doc_id", "text").exceptAll(sample.select("doc_id", "text")).count() == 0
    import pyarrow.parquet as pq

    for file in (tmp_path / "out").rglob("*.parquet"):
        slots = pq.ParquetFile(file).read(["slot"])["slot"].to_pylist()
        assert slots == sorted(slots)


def brute_divergences(rows, most):
    rows = [((t or ""), (g or ""), (s or "")) for t, g, s in rows]
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    n, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for t, g, s in rows:
        found = collections.Counter(terms(t))
        n[g, s].update(found)
        docs[g].update(found.keys())
    out = []
    for lang in docs.keys() | {g for _, g, _ in rows}:
        kept = sorted(w for w, k in docs[lang].items() if k >= 3)
        groups = sorted({s for _, g, s in rows if g == lang}, key=str.encode)
        whole = collections.Counter()
        for s in groups:
            whole.update({w: n[lang, s][w] for w in kept})

        def share(c):
            total = sum(c[x] for x in kept) + len(kept)  # noqa: B023
            return [1 + 10**9 * (c[w] + 1) // total for w in kept]  # noqa: B023

        p = {s: share({w: n[lang, s][w] for w in kept}) for s in groups}
        q = share(whole)
        for s in groups:
            pairs = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in groups if o != s]
            tops = [(-((a - b) ** 2 // b), w.encode()) for a, b, w in zip(p[s], q, kept, strict=True) if a > b and n[lang, s][w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(tops)[:most])):
                out += [(lang, s, part, o.decode(), -v, k) for k, (v, o) in enumerate(found, 1)]
    return collections.Counter(out)


def divergence_rows(docs, *args, **more):
    return collections.Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.divergences(docs, *args, **more).collect())


@pytest.mark.parametrize("name", ["awkward", "sample", "nothing"])
@pytest.mark.parametrize("slice_rows, tile_groups", [(1 << 16, 128), (40, 2)])
def test_divergences_are_brute_force(request, name, slice_rows, tile_groups):
    docs = request.getfixturevalue(name)
    want = brute_divergences([tuple(r) for r in docs.select("text", "lang", "source").collect()], 200)
    assert divergence_rows(docs, slice_rows=slice_rows, tile_groups=tile_groups) == want


def test_divergences_of_odd_groups(spark):
    r = random.Random(5)
    words = ["Eins", "zwei", "DREI", "vier", "fünf", "x1y", "日本", " ", "a", "b", "c", "d"]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 30))), r.choice(["en", "", None, "de"]), r.choice(["s", "t", "", None, "ü", "zz", "S", "e:n"])) for _ in range(300)]
    rows += [("only here", "fr", "s"), (None, "fr", "t"), ("12 34", "fr", None), (None, "it", "s")] + [("a a a b", "en", "s")] * 20
    docs = spark.createDataFrame([(k, *x, 5, "y") for k, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string")
    for most, tiles in ((200, 3), (2, 128)):
        assert divergence_rows(docs, most, tile_groups=tiles, slice_rows=30) == brute_divergences(rows, most)


def test_shares_are_exact_for_large_counts():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randint(1, 10 ** r.randint(1, 15))
        count = r.randint(0, total - 1)
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


def test_terms_are_counted_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(divergence, "COUNTED_BYTES", 100)
    texts, sources = ["One two\nTWO é", None, "", "two " * 60] * 10, ["a", "b", "a", "b"] * 10
    held = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(["x"] * 40), pa.array(sources)], names=["text", "lang", "source"])
    n, docs, parts = collections.Counter(), collections.Counter(), 0
    for b in divergence._counted([held]):
        parts += 1
        for r in b.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    assert parts > 10
    assert n == {("a", "one"): 10, ("a", "two"): 20, ("a", "é"): 10, ("b", "two"): 600}
    assert docs == {("a", "one"): 10, ("a", "two"): 10, ("a", "é"): 10, ("b", "two"): 10}
