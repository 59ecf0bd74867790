"""Set and join checks between what is expected and what is there."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.fingerprints import fingerprints
from sievework.operators.contracts import variant
from sievework.operators.ordering import numbered_from_zero
from sievework.sources.staging import staged


def _only_first(key: str, first: DataFrame, *others: DataFrame) -> DataFrame:
    """Keys (not null) that only the first table has, and in how many rows.

    All are counted in one aggregate: in a join, Spark broadcasts a side whose file is small, however many keys it has, or sorts every row.
    """
    both = reduce(DataFrame.unionAll, (d.select(key, F.lit(k == 0).alias("helper__first")) for k, d in enumerate((first, *others))))
    counts = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if("helper__first").alias("helper__n"), F.bool_and("helper__first").alias("helper__only"))
    return counts.where("helper__only").select(F.col(key).cast(first.schema[key].dataType).alias(key), "helper__n")


def ungrounded(cited: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Distinct cited keys that the corpus does not have."""
    return _only_first(key, cited, corpus).select(key)


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and which side."""
    left, right = a.select(key).distinct().withColumn("helper__a", F.lit(True)), b.select(key).distinct().withColumn("helper__b", F.lit(True))
    both = left.join(right, key, "full_outer")
    return both.where("helper__a IS NULL OR helper__b IS NULL").select(key, F.when(F.col("helper__a").isNull(), "unexpected").otherwise("missing").alias("defect"))


def last_by_key(df: DataFrame, key: str, position: str) -> DataFrame:
    """Of several rows with one key the last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("helper__r")).select(key, "helper__r.*")


def pin_findings(pinned: DataFrame, present: DataFrame, key: str, content: str = "sha256") -> DataFrame:
    """missing, drifted and stray keys by content hash."""
    a, b = pinned.select(key, F.col(content).alias("helper__want")), present.select(key, F.col(content).alias("helper__have"))
    defect = F.when(F.col("helper__have").isNull(), "missing").when(F.col("helper__want").isNull(), "stray").when(F.col("helper__want") != F.col("helper__have"), "drifted")
    return a.join(b, key, "full_outer").select(key, defect.alias("defect")).where("defect IS NOT NULL")


def incomplete(expected: DataFrame, key: str, *answers: DataFrame) -> DataFrame:
    """Expected keys that none of the answers has, each as often as it is expected; an answer is never to null."""
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("helper__n")))
    return _only_first(key, expected, *answers).select(key, each).select(key).unionAll(expected.select(key).where(F.col(key).isNull()))


def completeness(expected: DataFrame, given: DataFrame, key: str, answers: Column) -> DataFrame:
    """Both in one aggregate: expected keys that no given row answers (unanswered), and distinct given keys that are not expected (foreign)."""
    columns = lambda d, first, answered: d.select(key, F.lit(first).alias("helper__first"), answered.alias("helper__answered"))
    both = columns(expected, True, F.lit(False)).unionAll(columns(given, False, answers)).where(F.col(key).isNotNull())
    counts = both.groupBy(key).agg(F.count_if("helper__first").alias("helper__n"), F.bool_or("helper__answered").alias("helper__answered"))
    defect = F.when(F.col("helper__n") == 0, "foreign").when(F.coalesce("helper__answered", F.lit(False)), None).otherwise("unanswered")
    found = counts.select(key, defect.alias("defect"), F.greatest("helper__n", F.lit(1)).alias("helper__n")).where("defect IS NOT NULL")
    each = found.select(key, "defect", F.explode(F.sequence(F.lit(1).cast("long"), F.col("helper__n")))).select(key, "defect")
    return each.unionAll(expected.where(F.col(key).isNull()).select(key, F.lit("unanswered").alias("defect")))


def swapped(selection: DataFrame, reference: DataFrame, key: str, compared: Sequence[str], normal=lambda c: c) -> DataFrame:
    """Selected keys that the reference does not have (invented) or has with other content (content_swap)."""
    theirs = reference.select(key, *(normal(F.col(c)).alias(f"helper__{c}") for c in compared), F.lit(True).alias("helper__there"))
    differs = F.lit(False)
    for c in compared:
        differs = differs | ~normal(F.col(c)).eqNullSafe(F.col(f"helper__{c}"))
    both = selection.join(theirs, key, "left")
    return both.select(key, F.when(F.col("helper__there").isNull(), "invented").when(differs, "content_swap").alias("defect")).where("defect IS NOT NULL")


def open_prerequisites(edges: DataFrame, selected: DataFrame, node: str, needs: str) -> DataFrame:
    """Edges of selected nodes whose prerequisite is not selected; direct edges suffice as they hold for all that is selected."""
    own = edges.join(selected.select(node), node, "left_semi")
    return own.join(selected.select(F.col(node).alias(needs)), needs, "left_anti").select(node, needs)


#: Cells of a grid that a bitmap of one long holds.
WORD = 64
#: An axis of so many values is numbered by one task.
SHORT_AXIS = 100_000


def unseen_grid(seen: DataFrame, axes: Sequence[DataFrame]) -> DataFrame:
    """Combinations of the axes (distinct rows each) that were not seen, of any number.

    The values of the longest axis are keys; the places in the grid of the other axes are numbered. What a key has been seen with are bitmaps,
    64 places a row, and its unseen places are the bits that are not set in them. So there are as many rows before the last step as a
    64th of the grid has cells, which are all either seen or in the result. Null is a value like any other.
    """
    axes = [staged(a.distinct()) for a in axes]
    sizes = [a.count() for a in axes]
    longest = sizes.index(max(sizes))
    key, keys = F.struct(*axes[longest].columns).alias("grid__key"), axes[longest]
    others = [a for k, a in enumerate(axes) if k != longest]
    cells = math.prod(n for k, n in enumerate(sizes) if k != longest)
    if not cells or not sizes[longest]:
        return reduce(DataFrame.crossJoin, axes).limit(0)
    placed, place, stride, values = seen, F.lit(0).cast("long"), 1, []
    for k, a in enumerate(others):
        n = sizes[k if k < longest else k + 1]
        number = (lambda d, c: d.withColumn(c, (F.row_number().over(Window.orderBy(*a.columns)) - 1).cast("long"))) if n <= SHORT_AXIS else numbered_from_zero  # noqa: B023
        own = staged(number(a, f"grid__{k}").select(F.struct(*a.columns).alias(f"grid__value{k}"), f"grid__{k}"))
        placed = placed.withColumn(f"grid__value{k}", F.struct(*a.columns)).join(own, f"grid__value{k}")
        place = place + F.col(f"grid__{k}") * stride
        values.append((own, stride, n))
        stride *= n
    word = lambda x: F.floor(x / WORD).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("grid__place") % WORD).cast("int"))
    masks = placed.select(key, place.alias("grid__place")).groupBy("grid__key", word(F.col("grid__place")).alias("grid__word")).agg(F.bit_or(bit).alias("grid__mask"))
    words = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((cells - 1) // WORD).cast("long"))).alias("grid__word")
    every = keys.select(key, words).join(masks, ["grid__key", "grid__word"], "left")
    free = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: (F.col("grid__word") * WORD + i < cells) & (F.coalesce(F.bit_get("grid__mask", i), F.lit(0)) == 0))
    out = every.select("grid__key", "grid__word", F.explode(free).alias("grid__bit")).withColumn("grid__place", F.col("grid__word") * WORD + F.col("grid__bit"))
    for k, (own, step, n) in enumerate(values):
        out = out.withColumn(f"grid__{k}", F.floor(F.col("grid__place") / step).cast("long") % n).join(own, f"grid__{k}")
    columns = {k: f"grid__value{k}.*" for k in range(len(others))}
    return out.select("grid__key.*", *columns.values()).select(*(c for a in axes for c in a.columns))


def graded(rows: DataFrame, key: str, facts: Sequence[DataFrame], cases: Sequence[tuple[Column, str]], otherwise: str) -> DataFrame:
    """One status for each row: the first case that holds after joining all facts by key."""
    out = rows
    for f in facts:
        out = out.join(f, key, "left")
    status = F.lit(otherwise)
    for condition, name in reversed(cases):
        status = F.when(condition, name).otherwise(status)
    return out.withColumn("status", status)


def shared_shingles(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, size: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """For each document and item: how many distinct word n-grams they share.

    Documents that have no gram of any item fall out first: texts that share one share a fingerprint of it, of which there are few
    (those of the items are broadcast if they are few by count). Only the others' grams are written out as words, and joined by these.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
        rows = df.select(key, words.alias("helper__w")).where(F.size("helper__w") >= size)
        at = F.sequence(F.lit(1), F.size("helper__w") - (size - 1))
        return rows.select(key, F.explode(F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("helper__w", i, F.lit(size)), " ")))).alias("gram"))

    marks = staged(fingerprints(items, item_key, text, size).select("fingerprint").distinct())
    few = marks.count() <= broadcast_rows
    near = staged(fingerprints(docs, doc_key, text, size).join(F.broadcast(marks) if few else marks, "fingerprint", "left_semi").select(doc_key).distinct())
    near = F.broadcast(near) if near.count() <= broadcast_rows else near
    own = grams(docs.select(doc_key, text).join(near, doc_key, "left_semi"), doc_key)
    return own.join(grams(items, item_key), "gram").groupBy(doc_key, item_key).agg(F.count("*").alias("n_shared"))


def contained(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, size: int = 8) -> DataFrame:
    """Documents that hold an item's whole text: pairs that share words near the item's beginning, then compared exactly.

    The first word of an item may be the end of a longer one, so the key is made of the words after it. Items of
    fewer than ``size`` words are left out: too many texts hold them by chance.
    """
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    k = size - 2
    own = items.select(item_key, F.col(text).alias("helper__item"), F.xxhash64(F.array_join(F.slice(words, 2, k), " ")).alias("helper__key")).where(F.size(F.filter(F.split("helper__item", r"\s+"), lambda w: w != "")) >= size)
    rows = docs.select(doc_key, words.alias("helper__w")).where(F.size("helper__w") >= size)
    at = F.sequence(F.lit(2), F.size("helper__w") - k)
    keyed = rows.select(doc_key, F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice("helper__w", i, F.lit(k)), " "))))).alias("helper__key"))
    pairs = keyed.join(own.select(item_key, "helper__key"), "helper__key").select(doc_key, item_key).distinct()
    return docs.select(doc_key, text).join(pairs, doc_key).join(own.select(item_key, "helper__item"), item_key).where(F.contains(F.col(text), F.col("helper__item"))).select(doc_key, item_key)


def cited_subset(files: DataFrame, cited: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The cited files, and the cited keys that have no file."""
    names = cited.select(key).distinct()
    return files.join(names, key, "left_semi"), names.join(files.select(key), key, "left_anti")


def record_differences(a: DataFrame, b: DataFrame, key: str, json: str) -> DataFrame:
    """Fields of JSON records that differ (key, field, defect); a record on one side only has a null field.

    Values are compared at any depth and with their types; the order of an object's keys does not matter.
    """
    fields = lambda c: F.transform_values(F.try_variant_get(variant(F.col(c)), "$", "map<string, variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    left, right = (d.select(key, F.col(json).alias(f"helper__{s}"), F.lit(True).alias(f"helper__{s}_there")) for d, s in ((a, "l"), (b, "r")))
    # Texts are joined, which are smaller than their fields; what reads them is then spread by key, however few parts a file has.
    both = left.join(right, key, "full_outer").withColumns({c: fields(c) for c in ("helper__l", "helper__r")})
    gone = F.when(F.col("helper__r_there").isNull(), "missing").when(F.col("helper__l_there").isNull(), "unexpected").when(F.col("helper__l").isNull() != F.col("helper__r").isNull(), "differs")
    found = lambda field, defect: F.struct(field.cast("string").alias("field"), defect.alias("defect"))
    in_l, in_r = (lambda n, m=m: F.map_contains_key(m, n) for m in ("helper__l", "helper__r"))
    same = lambda n: F.col("helper__l")[n].eqNullSafe(F.col("helper__r")[n])
    names = F.array_union(F.map_keys("helper__l"), F.map_keys("helper__r"))
    each = F.transform(names, lambda n: found(n, F.when(~in_r(n), "missing").when(~in_l(n), "unexpected").when(~same(n), "differs")))
    # One array for each record, so that both sides are read and joined once.
    whole = F.when(gone.isNotNull(), F.array(found(F.lit(None), gone))).otherwise(F.filter(each, lambda x: x["defect"].isNotNull()))
    return both.select(key, F.explode(whole).alias("helper__d")).select(key, "helper__d.field", "helper__d.defect")


def contamination_verdict(docs: DataFrame, held: DataFrame, controls: Sequence[DataFrame], doc_key: str, item_key: str, text: str, size: int) -> str:
    """blocked if the check misses one of the poisoned controls, else contaminated or clean."""
    found = lambda d: shared_shingles(d, held, doc_key, item_key, text, size).limit(1).count() > 0
    if not all(found(c) for c in controls):
        return "blocked"
    return "contaminated" if found(docs) else "clean"
