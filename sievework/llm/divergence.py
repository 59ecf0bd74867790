"""Operator 13: how far the sources of a language differ, in shares of terms, by dense matrices of term blocks.

Terms are runs of letters (A-Z lower-cased) and characters beyond ASCII. A task counts the terms of some megabytes of text and gives a
row for each group (language and source) and term of them; these are summed. Terms in ``MIN_DOCS`` documents of a language
are kept and dealt to *slices* by a hash, so that a slice has about ``SLICE_ROWS`` counts, and the groups of a language to
*tiles* of ``TILE_GROUPS``. A task gets one slice for two tiles and turns it, some terms at a time, into two matrices, group by
term, of shares in billionths; all pairs of groups are compared by broadcasting one against the other, and the partial pair matrices are summed
over the slices (terms that neither tile has are one product). With a tile's own matrix go the ``MOST_TERMS`` terms of each group with the largest values in the slice; these heaps
are merged by rank. A hot source or language is so spread over its slices, a frequent term is one row for each group.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)), exact in 64 bits while a language has under 10^15 terms; the value of a
term is floor((p - q)^2 / q).

Defined results: null text, language and source are ''; a group without terms, or a language that keeps none, still has its pairs
(value 0 where nothing is kept); ids may be null; repeated rows count as documents of their own; texts of any length are counted whole, in
one task; equal values are ranked by the item's bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import staged
from sievework.llm.kernels import LOWER, slices, strings, utf8

MIN_DOCS = 3
MOST_TERMS = 200
BILLION = 10**9
#: Bytes of text whose terms are counted together.
GATHERED_BYTES = 16 << 20
#: Bytes of these whose terms are in work at a time, at some twenty bytes each; one text at least.
COUNTED_BYTES = 4 << 20
SLICE_ROWS = 1 << 16
TILE_GROUPS = 128
#: Cells that a comparison of two tiles holds at a time.
CELLS = 1 << 20

COUNTED = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, source string, part string, item string, value long"


@cache
def _in_term() -> np.ndarray:
    """The bytes of UTF-8 that belong to terms: letters and all beyond ASCII."""
    out = np.zeros(256, bool)
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return out


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A code for each term, the distinct terms, and the row of each term."""
    data = LOWER[data]
    inside = _in_term()[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True  # a row ends here
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge |= cut
    bounds = np.flatnonzero(edge)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    term = np.flatnonzero(inside[bounds[:-1]])
    coded = strings(data, bounds).dictionary_encode()
    used, codes = np.unique(coded.indices.to_numpy()[term], return_inverse=True)
    return codes, coded.dictionary.take(pa.array(used)), np.searchsorted(off, bounds[term], "right") - 1


def _counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group and term of some rows: how often it occurs, and in how many rows; a batch for each ``COUNTED_BYTES`` of them."""
    table = pa.Table.from_batches(held)
    groups = pa.table([table["lang"], table["source"]], names=["lang", "source"])
    key = pc.binary_join_element_wise(pc.cast(pc.binary_length(groups["lang"]), pa.string()), groups["lang"], groups["source"], ":").combine_chunks()
    coded = key.dictionary_encode()
    group = coded.indices.to_numpy()
    first = np.unique(group, return_index=True)[1]
    data, off = utf8(table["text"])
    for i, j in slices(off, COUNTED_BYTES):
        codes, terms, row = _terms(data[off[i] : off[j]], off[i : j + 1] - off[i])
        # A row for each document and term, and from these a row for each group and term.
        seen, n = np.unique(row * len(terms) + codes, return_counts=True)
        row, codes = np.divmod(seen, max(len(terms), 1))
        cells, at = np.unique(group[i + row].astype(np.int64) * len(terms) + codes, return_inverse=True)
        of, codes = np.divmod(cells, max(len(terms), 1))
        picked = pa.array(first[of])
        total = np.zeros(len(cells), np.int64)
        np.add.at(total, at, n)
        yield from pa.table([groups["lang"].take(picked), groups["source"].take(picked), terms.take(pa.array(codes)), pa.array(total), pa.array(np.bincount(at, minlength=len(cells)))], names=["lang", "source", "term", "n", "docs"]).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= GATHERED_BYTES:
                yield from _counted(held)
                held, size = [], 0
        if held:
            yield from _counted(held)

    return docs.mapInArrow(rows, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total) in 64 bits: three digits of the quotient at a time."""
    share, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        share = share * 1000 + digits
    return share + 1


def values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _pairs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sums over all terms of the values of each group of p against each of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    width = max(1, CELLS // max(1, out.size))
    for a in range(0, p.shape[1], width):
        out += values(p[:, None, a : a + width], q[None, :, a : a + width]).sum(axis=2)
    return out


def _compared(counts: pa.Table, groups: pa.Table, most: int) -> pa.Table:
    """One slice of a language's terms for two tiles of its groups: their pairs, and if the tiles are one, the groups' heaps."""
    lang, own, other = groups["lang"][0].as_py(), groups["own"][0].as_py(), groups["other"][0].as_py()
    tile, sources = groups["tile"].to_numpy(), groups["source"].to_pylist()
    place = np.full(int(groups["member"].to_numpy().max()) + 1, -1)
    totals, mine, theirs = groups["total"].to_numpy() + groups["kept"].to_numpy(), np.flatnonzero(tile == own), np.flatnonzero(tile == other)
    for rows in (mine, theirs):
        place[groups["member"].to_numpy()[rows]] = np.arange(len(rows))
    coded = counts["term"].combine_chunks().dictionary_encode() if len(counts) else pa.array([], pa.string()).dictionary_encode()
    code, terms = coded.indices.to_numpy(), coded.dictionary
    at, n, its_tile = place[counts["member"].to_numpy()], counts["n"].to_numpy(), counts["tile"].to_numpy()
    sums = np.zeros((len(mine), len(theirs)), np.int64)
    width = max(1, CELLS // max(1, max(len(mine), len(theirs))))
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(0, len(terms) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = order[a:b]
        p, q = (np.zeros((len(rows), min(width, len(terms) - k * width)), np.int64) for rows in (mine, theirs))
        for matrix, rows, t in ((p, mine, own), (q, theirs, other)):
            here = part[its_tile[part] == t]
            matrix[at[here], code[here] - k * width] = n[here]
            matrix[:] = shares(matrix, totals[rows][:, None])
        sums += _pairs(p, q)
    # Terms of the slice that neither tile has count too.
    absent = groups["terms"].to_numpy()[0] - len(terms)
    if absent:
        zero = [shares(np.zeros(len(rows), np.int64), totals[rows]) for rows in (mine, theirs)]
        sums += absent * values(zero[0][:, None], zero[1][None, :])
    i, j = np.divmod(np.arange(sums.size), max(1, len(theirs)))
    i, j, flat = i[mine[i] != theirs[j]], j[mine[i] != theirs[j]], sums.ravel()[mine[i] != theirs[j]]
    part, source, item, value = ["pair"] * len(i), [sources[x] for x in mine[i]], [sources[x] for x in theirs[j]], flat.tolist()
    if own == other and len(counts):
        p = shares(n, totals[mine][at])
        q = shares(counts["lang_n"].to_numpy(), counts["lang_total"].to_numpy() + groups["kept"].to_numpy()[0])
        f, rank = values(p, q), np.argsort(np.argsort(np.array(terms.cast(pa.binary()).to_pylist(), object), kind="stable"))
        more = np.flatnonzero(p > q)
        more = more[np.lexsort((rank[code[more]], -f[more], at[more]))]
        begin = np.searchsorted(at[more], at[more])
        more = more[np.arange(len(more)) - begin < most]  # a heap for each group
        part += ["term"] * len(more)
        source += [sources[mine[x]] for x in at[more]]
        item += terms.take(pa.array(code[more])).to_pylist()
        value += f[more].tolist()
    return pa.table([pa.array([lang] * len(part), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def divergences(docs: DataFrame, most: int = MOST_TERMS, min_docs: int = MIN_DOCS, slice_rows: int = SLICE_ROWS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank: the other sources of a group's language by their distance, and
    the ``most`` terms that set the group apart from its language."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("docs"))
    kept = staged(counts.where(F.col("docs") >= min_docs).drop("docs"))

    # Small tables: a row for each group, and for each language.
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "rows"])
    terms = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("rows").alias("rows"), F.count("*").alias("members")).join(terms, "lang", "left").fillna(0, ["kept"])
    tiles = F.ceil(F.col("members") / tile_groups).cast("int")
    langs = langs.select("lang", "lang_total", "kept", tiles.alias("tiles"), F.greatest(F.lit(1), F.ceil(2 * F.col("rows") / (slice_rows * tiles))).cast("int").alias("slices"))
    member = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = staged(groups.select("lang", "source", "total", member.alias("member")).join(langs, "lang").withColumn("tile", F.floor(F.col("member") / tile_groups).cast("int")))

    # A tile meets each tile of its language: as the first of the pair, and as the second.
    tile = F.col("tile")
    meeting = lambda own, other: F.named_struct(F.lit("own"), own, F.lit("other"), other)
    tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    met = F.explode(F.array_union(F.transform(tiles, lambda t: meeting(tile, t)), F.transform(tiles, lambda t: meeting(t, tile)))).alias("pair")
    slice_ = F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice")
    rows = kept.join(groups.select("lang", "source", "member", "tile", "tiles", "slices", "lang_total"), ["lang", "source"])
    rows = rows.select("lang", "term", "n", "lang_n", "lang_total", "member", "tile", slice_, met).select("*", "pair.*").drop("pair")
    sizes = kept.select("lang", "term").distinct().join(langs, "lang").groupBy("lang", slice_).agg(F.count("*").alias("terms"))
    everywhere = groups.select("*", met, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(sizes, ["lang", "slice"], "left").fillna(0, ["terms"])
    everywhere = everywhere.select("lang", "source", "total", "kept", "terms", "member", "tile", "slice", "pair.*")
    everywhere = everywhere.select(*(F.col(c).alias(c) for c in everywhere.columns))  # columns of its own, for both sides come from ``groups``
    unit = ["lang", "own", "other", "slice"]

    def compared(counts: pa.Table, groups: pa.Table) -> pa.Table:
        return _compared(counts, groups, most)

    partial = staged(rows.groupBy(*unit).cogroup(everywhere.groupBy(*unit)).applyInArrow(compared, PARTIAL))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    return pairs.unionByName(partial.where("part = 'term'").select("*", rank).where(F.col("rank") <= most))
